"""Row positions and position chunks.

A series may be longer than any single task can hold, so no operator sorts a whole series in one
place. Rows are first numbered with two small steps (count per time block, prefix sum over blocks),
then cut into chunks of equal length. Windows run per ``(series, chunk)``; a chunk also receives
the few neighbouring rows its frames reach into (the halo).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = "_chunk"
OWN = "_own"


def number_rows(df: DataFrame, keys: Sequence[str], ts: str = "timestamp", *,
                block_seconds: int = 30 * 86_400, pos: str = "pos",
                count: str | None = None) -> DataFrame:
    """Add the zero-based position of every row in its series, ordered by ``ts``.

    ``block_seconds`` bounds how much of one series a task sorts. ``count`` optionally names a
    column that receives the series length.
    """
    keys = list(keys)
    blocked = df.withColumn(
        "_block", F.floor(F.unix_micros(ts) / F.lit(block_seconds * 1_000_000)).cast("long")
    )
    inside = Window.partitionBy(*keys, "_block").orderBy(ts)
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    base = (
        blocked.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_n"))
        .select(
            *keys, "_block",
            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"),
            F.sum("_n").over(Window.partitionBy(*keys)).alias("_total"),
        )
    )
    numbered = blocked.withColumn("_rank", F.row_number().over(inside)).join(
        base, [*keys, "_block"]
    )
    out = numbered.withColumn(pos, F.col("_base") + F.col("_rank") - 1)
    if count:
        out = out.withColumn(count, F.col("_total"))
    return out.drop("_block", "_rank", "_base", "_total")


def chunk_of(pos: str | Column, chunk_rows: int) -> Column:
    """Chunk number of a position."""
    p = F.col(pos) if isinstance(pos, str) else pos
    return F.floor(p / F.lit(chunk_rows)).cast("long")


def spread_to_chunks(df: DataFrame, chunk_rows: int, *, before: int = 0, after: int = 0,
                     pos: str = "pos") -> DataFrame:
    """Assign rows to chunks, copying edge rows into the neighbour that looks back or ahead.

    At most ``(before + after) / chunk_rows`` of the rows are copied. ``_own`` marks the rows a
    chunk has to emit.
    """
    if before > chunk_rows or after > chunk_rows:
        raise ValueError("a halo cannot exceed the chunk length")
    home = chunk_of(pos, chunk_rows)
    offset = F.pmod(F.col(pos), F.lit(chunk_rows))
    targets = [home]
    if before:
        targets.append(F.when(offset >= chunk_rows - before, home + 1))
    if after:
        targets.append(F.when((offset < after) & (home > 0), home - 1))
    if len(targets) == 1:
        return df.withColumn(CHUNK, home).withColumn(OWN, F.lit(True))
    return (
        df.withColumn(CHUNK, F.explode(F.array_compact(F.array(*targets))))
        .withColumn(OWN, F.col(CHUNK) == home)
    )


def chunk_window(keys: Sequence[str], pos: str = "pos"):
    """Ordered window over one chunk of one series."""
    return Window.partitionBy(*keys, CHUNK).orderBy(pos)
