"""Match positions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def spans(text: Column, pattern: Column) -> Column:
    """Array of (start, stop, hit): leftmost matches of ``pattern``, code points, stop exclusive.

    The pieces between the matches give the offsets: match i starts after pieces 0..i and matches 0..i-1.
    """
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.split(text, pattern, -1)
    state = F.struct(F.lit(0).alias("at"), F.expr(
        "cast(array() as array<struct<start:int,stop:int,hit:string>>)").alias("out"))

    def step(acc, x):
        start = acc["at"] + F.length(x["gap"])
        stop = start + F.length(x["hit"])
        return F.struct(stop.alias("at"), F.concat(acc["out"], F.array(F.struct(
            start.alias("start"), stop.alias("stop"), x["hit"].alias("hit")))).alias("out"))

    paired = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits,
                        lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    return F.when(F.regexp_like(text, pattern),
                  F.aggregate(paired, state, step, lambda acc: acc["out"])).otherwise(state["out"])
