"""Decaying recurrences ``y[t] = q·y[t−1] + u[t]`` as a distributed scan.

Every chunk is scanned on its own with a running sum of ``u[i]·q^(−i)``. One row per chunk (its
state at the hand-over position) is then folded over the few predecessors whose weight has not
underflowed to zero, and that carry is added back, decayed. The result equals the sequential loop
up to rounding, while no task ever sees more than one chunk of a series.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweft.operators.positions import CHUNK, OWN, chunk_window, spread_to_chunks

_LN_TINY = 745.2  # −ln of the smallest positive double
_LN_SAFE = 600.0  # keeps q^(−j) well inside the double range


@dataclass(frozen=True)
class Decay:
    """One recurrence. ``inp`` is the column holding ``u``; the caller weights the seed row."""

    name: str
    q: float
    inp: str


@dataclass(frozen=True)
class Cascade:
    """A recurrence driven by a weighted sum of other recurrences, seeded at ``start_pos``."""

    name: str
    q: float
    gain: float
    terms: dict[str, float] = field(default_factory=dict)
    start_pos: int = 0


def _gain_of_state(c: Cascade, q: float, n: Column) -> Column:
    """Effect on a cascade after ``n`` rows of one unit in a driving state just before them."""
    if math.isclose(c.q, q):
        return c.gain * F.lit(q) * n * F.pow(F.lit(q), n - 1)
    scale = c.gain * q / (q - c.q)
    return F.lit(scale) * (F.pow(F.lit(q), n) - F.pow(F.lit(c.q), n))


def scan_rows(df: DataFrame, chunk_rows: int, before: int, pos: str = "pos") -> DataFrame:
    """Chunk a table for :func:`decay_scan`: ``before`` look-back rows plus one for ``lag``."""
    return spread_to_chunks(df, chunk_rows, before=before + 1, pos=pos)


def decay_scan(df: DataFrame, keys: Sequence[str], decays: Sequence[Decay],
               cascades: Sequence[Cascade] = (), *, chunk_rows: int, before: int,
               pos: str = "pos") -> DataFrame:
    """Add one column per recurrence to rows prepared by :func:`scan_rows`.

    Rows at the hand-over (one before the look-back) are only there to feed ``lag`` and leave.
    """
    keys = list(keys)
    steepest = max(-math.log(d.q) for d in [*decays, *cascades])
    slowest = min(-math.log(d.q) for d in [*decays, *cascades])
    if steepest * (chunk_rows + before) > _LN_SAFE:
        raise ValueError("chunk_rows is too large for the fastest decay")
    if chunk_rows <= 2 * before + 2 or any(c.start_pos >= chunk_rows - before for c in cascades):
        raise ValueError("chunk_rows is too small for the look-back")
    depth = max(1, math.ceil(_LN_TINY / (slowest * chunk_rows)) + 1)

    first = F.greatest(F.lit(0), F.col(CHUNK) * chunk_rows - before)
    rows = df.withColumn("_j", (F.col(pos) - first).cast("double")).filter("_j >= 0")
    w = chunk_window(keys, pos).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    j = F.col("_j")
    local = rows.withColumns({
        f"_l_{d.name}": F.pow(F.lit(d.q), j)
        * F.sum(F.col(d.inp) * F.pow(F.lit(d.q), -j)).over(w)
        for d in decays
    })
    if cascades:
        q_of = {d.name: d.q for d in decays}

        def drive(c: Cascade) -> Column:
            total = sum((F.col(f"_l_{n}") * k for n, k in c.terms.items()), F.lit(0.0))
            return (
                F.when(F.col(pos) == c.start_pos, total)
                .when(F.col(pos) > c.start_pos, total * c.gain)
                .otherwise(F.lit(0.0))
            )

        local = local.withColumns({
            f"_l_{c.name}": F.pow(F.lit(c.q), j)
            * F.sum(drive(c) * F.pow(F.lit(c.q), -j)).over(w)
            for c in cascades
        })

    names = [d.name for d in [*decays, *cascades]]
    handover = local.filter(
        F.col(pos) == (F.col(CHUNK) + 1) * chunk_rows - before - 1
    ).select(*keys, F.col(CHUNK).alias("_seg"), *[f"_l_{n}" for n in names])
    carry = _carries(handover, keys, decays, cascades, chunk_rows, depth)

    joined = local.join(carry, [*keys, CHUNK], "left")
    n = j + 1.0
    out = {}
    for d in decays:
        c0 = F.coalesce(F.col(f"_c_{d.name}"), F.lit(0.0))
        out[d.name] = F.col(f"_l_{d.name}") + F.pow(F.lit(d.q), n) * c0
    for c in cascades:
        value = F.col(f"_l_{c.name}") + F.pow(F.lit(c.q), n) * F.coalesce(
            F.col(f"_c_{c.name}"), F.lit(0.0)
        )
        for name, k in c.terms.items():
            value = value + k * _gain_of_state(c, q_of[name], n) * F.coalesce(
                F.col(f"_c_{name}"), F.lit(0.0)
            )
        out[c.name] = value
    drop = ["_j", *[f"_l_{x}" for x in names], *[f"_c_{x}" for x in names]]
    return joined.withColumns(out).drop(*drop)


def _carries(handover: DataFrame, keys: list[str], decays, cascades, chunk_rows: int,
             depth: int) -> DataFrame:
    """Fold hand-over states into the state every following chunk starts from."""
    names = [d.name for d in [*decays, *cascades]]
    q_of = {d.name: d.q for d in decays}
    length = F.lit(float(chunk_rows))
    span = max(4096, 8 * depth)
    near = spread_to_chunks(handover, span, before=depth, pos="_seg")
    recent = (
        Window.partitionBy(*keys, CHUNK).orderBy("_seg").rowsBetween(-(depth - 1), 0)
    )
    states = F.collect_list(F.struct(*[F.col(f"_l_{n}").alias(n) for n in names])).over(recent)

    def step(acc: Column, x: Column) -> Column:
        parts = {}
        for d in decays:
            parts[d.name] = x[d.name] + F.pow(F.lit(d.q), length) * acc[d.name]
        for c in cascades:
            v = x[c.name] + F.pow(F.lit(c.q), length) * acc[c.name]
            for name, k in c.terms.items():
                v = v + k * _gain_of_state(c, q_of[name], length) * acc[name]
            parts[c.name] = v
        return F.struct(*[parts[n].alias(n) for n in names])

    zero = F.struct(*[F.lit(0.0).alias(n) for n in names])
    folded = near.withColumn("_state", F.reduce(states, zero, step)).filter(OWN)
    return folded.select(
        *keys, (F.col("_seg") + 1).alias(CHUNK),
        *[F.col("_state")[n].alias(f"_c_{n}") for n in names],
    )


def exponential_average(df: DataFrame, keys: Sequence[str], value: str, span: int, *,
                        name: str = "ema", chunk_rows: int = 2048, pos: str = "pos") -> DataFrame:
    """Recursive exponential average with ``α = 2/(span+1)``; null for the first ``span−1`` rows."""
    alpha = 2.0 / (span + 1.0)
    fed = scan_rows(df, chunk_rows, 0, pos).withColumn(
        "_u", F.when(F.col(pos) == 0, F.col(value)).otherwise(F.col(value) * alpha)
    )
    out = decay_scan(fed, keys, [Decay(name, 1.0 - alpha, "_u")], chunk_rows=chunk_rows,
                     before=0, pos=pos)
    return (
        out.filter(OWN).drop(CHUNK, OWN, "_u")
        .withColumn(name, F.when(F.col(pos) >= span - 1, F.col(name)))
    )
