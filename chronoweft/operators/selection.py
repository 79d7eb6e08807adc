"""Greedy selection of non-overlapping, fixed-length holdings.

Taking a signal at position ``p`` makes the series busy through ``p + horizon``; the next eligible
signal is at ``p + horizon + 1`` or later. The choice at one row depends on all earlier rows, but only
through one number: how many rows into the next chunk the series stays busy (0 … horizon). A chunk
is therefore a small map from that number on entry to that number on exit. Maps compose, so chunks
are folded into blocks, blocks are chained per series, and the known entry states are sent back down.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK_ROWS = 4096
BLOCK_CHUNKS = 2048


def _walk(offsets: Column, start: Column, horizon: int) -> Column:
    """First free offset after walking the signals of a chunk."""
    return F.reduce(
        offsets, start,
        lambda free, o: F.when(o >= free, o + F.lit(horizon + 1)).otherwise(free),
    )


def _exit_map(offsets: Column, horizon: int, chunk_rows: int) -> Column:
    """Busy rows carried out of a chunk, for every number carried in."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(horizon)),
        lambda s: F.greatest(F.lit(0), _walk(offsets, s, horizon) - F.lit(chunk_rows)),
    )


def _apply(maps: Column, state: Column) -> Column:
    return F.get(maps, state)


def _chain(entries: Column, first: Column, start: Column) -> Column:
    """State after a run of maps; a missing chunk holds no signal and clears the state."""
    zero = F.struct((first - 1).alias("at"), start.alias("state"))
    return F.reduce(
        entries, zero,
        lambda acc, e: F.struct(
            e["at"].alias("at"),
            _apply(e["m"], F.when(e["at"] == acc["at"] + 1, acc["state"]).otherwise(F.lit(0)))
            .alias("state"),
        ),
    )


def _entry_states(entries: Column, first: Column, start: Column) -> Column:
    """Entry state of every chunk in a run, in order."""
    zero = F.struct(
        (first - 1).alias("at"), start.alias("state"),
        F.array().cast("array<struct<at:bigint,start:int>>").alias("out"),
    )

    def step(acc: Column, e: Column) -> Column:
        state = F.when(e["at"] == acc["at"] + 1, acc["state"]).otherwise(F.lit(0))
        return F.struct(
            e["at"].alias("at"), _apply(e["m"], state).alias("state"),
            F.array_append(acc["out"], F.struct(e["at"].alias("at"), state.alias("start")))
            .alias("out"),
        )

    return F.reduce(entries, zero, step)["out"]


def select_non_overlapping(signals: DataFrame, keys: Sequence[str], horizon: int, *,
                           pos: str = "pos", chunk_rows: int = CHUNK_ROWS,
                           block_chunks: int = BLOCK_CHUNKS) -> DataFrame:
    """Positions taken by the greedy rule, as ``(keys…, pos)``.

    ``signals`` holds one row per eligible signal. Arrays are bounded: a chunk by ``chunk_rows``
    offsets, a block by ``block_chunks`` maps, a series by its length over
    ``chunk_rows·block_chunks`` (8 million rows per entry by default).
    """
    if horizon + 1 > chunk_rows:
        raise ValueError("horizon must be shorter than a chunk")
    keys = list(keys)
    p = F.col(pos)
    chunks = (
        signals.select(
            *keys, F.floor(p / F.lit(chunk_rows)).cast("long").alias("_at"),
            F.pmod(p, F.lit(chunk_rows)).cast("int").alias("_o"),
        )
        .groupBy(*keys, "_at").agg(F.array_sort(F.collect_list("_o")).alias("_offsets"))
    )
    maps = chunks.select(
        *keys, "_at", F.floor(F.col("_at") / F.lit(block_chunks)).cast("long").alias("_block"),
        _exit_map(F.col("_offsets"), horizon, chunk_rows).alias("_m"),
    )
    entry = F.struct(F.col("_at").alias("at"), F.col("_m").alias("m"))
    blocks = maps.groupBy(*keys, "_block").agg(
        F.array_sort(F.collect_list(entry)).alias("_entries")
    )
    first = F.col("_block") * F.lit(block_chunks)
    last = first + F.lit(block_chunks - 1)

    def block_exit(s: Column) -> Column:
        end = _chain(F.col("_entries"), first, s.cast("int"))
        return F.when(end["at"] == last, end["state"]).otherwise(F.lit(0))

    block_maps = blocks.select(
        *keys, F.struct(
            F.col("_block").alias("at"),
            F.transform(F.sequence(F.lit(0), F.lit(horizon)), block_exit).alias("m"),
        ).alias("_e"),
    )
    series = block_maps.groupBy(*keys).agg(F.array_sort(F.collect_list("_e")).alias("_blocks"))
    block_starts = series.select(
        *keys,
        F.inline(_entry_states(F.col("_blocks"), F.lit(0).cast("long"), F.lit(0))),
    ).select(*keys, F.col("at").alias("_block"), F.col("start").alias("_s"))
    chunk_starts = blocks.join(block_starts, [*keys, "_block"]).select(
        *keys, F.inline(_entry_states(F.col("_entries"), first, F.col("_s"))),
    ).select(*keys, F.col("at").alias("_at"), F.col("start").alias("_s"))

    picked = F.reduce(
        F.col("_offsets"),
        F.struct(F.col("_s").alias("free"), F.array().cast("array<int>").alias("out")),
        lambda acc, o: F.when(
            o >= acc["free"],
            F.struct((o + F.lit(horizon + 1)).alias("free"),
                     F.array_append(acc["out"], o).alias("out")),
        ).otherwise(acc),
    )["out"]
    return (
        chunks.join(chunk_starts, [*keys, "_at"])
        .select(*keys, "_at", F.explode(picked).alias("_o"))
        .select(*keys, (F.col("_at") * chunk_rows + F.col("_o")).alias(pos))
    )
