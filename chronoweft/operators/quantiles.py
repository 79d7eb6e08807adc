"""Exact quantiles and ordered cumulative sums for groups too large for one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cut_by_quantiles(df: DataFrame, keys: Sequence[str], value: str, *, cuts: int = 64,
                     bucket: str = "_bucket") -> DataFrame:
    """Add a bucket number that splits each group into about ``cuts`` equal, ordered parts.

    The cut points come from a bounded sketch; equal values always share a bucket, so results
    built on the buckets are exact however coarse the sketch is.
    """
    keys = list(keys)
    shares = F.array(*[F.lit(i / cuts) for i in range(1, cuts)])
    points = df.groupBy(*keys).agg(
        F.array_distinct(F.percentile_approx(value, shares, F.lit(20 * cuts))).alias("_cuts")
    )
    out = df.join(points, keys) if keys else df.crossJoin(F.broadcast(points))
    return out.withColumn(
        bucket, F.size(F.filter("_cuts", lambda c: c < F.col(value)))
    ).drop("_cuts")


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float],
                    *, cuts: int = 64) -> DataFrame:
    """Linearly interpolated quantiles, one column per entry of ``shares``.

    Values are counted, cut into ordered buckets, and only the buckets that hold a wanted rank are
    sorted. Null values are ignored; groups without a value are absent.
    """
    keys = list(keys)
    counted = (
        df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
        .groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n"))
    )
    cut = cut_by_quantiles(counted, keys, "_v", cuts=cuts)
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    totals = cut.groupBy(*keys, "_bucket").agg(F.sum("_n").alias("_b")).select(
        *keys, "_bucket", "_b", F.coalesce(F.sum("_b").over(before), F.lit(0)).alias("_base"),
        F.sum("_b").over(Window.partitionBy(*keys)).alias("_total"),
    )
    targets = []
    for name, q in shares.items():
        rank = (F.col("_total") - 1) * F.lit(float(q))
        for side, at in (("lo", F.floor(rank)), ("hi", F.ceil(rank))):
            targets.append(F.struct(
                F.lit(name).alias("name"), F.lit(side).alias("side"), at.cast("long").alias("at"),
                (rank - F.floor(rank)).alias("part"),
            ))
    wanted = (
        totals.withColumn("_w", F.filter(F.array(*targets), lambda t: (
            t["at"] >= F.col("_base")) & (t["at"] < F.col("_base") + F.col("_b"))))
        .filter(F.size("_w") > 0).select(*keys, "_bucket", "_base", "_w")
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_v")
    upto = F.sum("_n").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    hits = (
        cut.join(wanted, [*keys, "_bucket"])
        .withColumn("_hi", F.col("_base") + upto).withColumn("_lo", F.col("_hi") - F.col("_n"))
        .select(*keys, "_v", F.explode(F.filter("_w", lambda t: (
            t["at"] >= F.col("_lo")) & (t["at"] < F.col("_hi")))).alias("_t"))
    )

    def pick(name: str, side: str) -> Column:
        return F.max(F.when(
            (F.col("_t.name") == name) & (F.col("_t.side") == side), F.col("_v")))

    out = hits.groupBy(*keys).agg(*[
        (pick(n, "lo") + (pick(n, "hi") - pick(n, "lo")) * F.max(
            F.when(F.col("_t.name") == n, F.col("_t.part")))).alias(n)
        for n in shares
    ])
    return out


def ordered_totals(df: DataFrame, keys: Sequence[str], order: str, sums: Sequence[str], *,
                   descending: bool = True, cuts: int = 64) -> DataFrame:
    """Add ``cum_<c>`` (through this row) for rows ordered within a group.

    Running sums stay inside quantile buckets; one small row per bucket carries the base.
    """
    keys = list(keys)
    cut = cut_by_quantiles(df, keys, order, cuts=cuts)
    ranked = F.desc(order) if descending else F.asc(order)
    bucket_order = F.desc("_bucket") if descending else F.asc("_bucket")
    prior = Window.partitionBy(*keys).orderBy(bucket_order).rowsBetween(
        Window.unboundedPreceding, -1
    )
    base = cut.groupBy(*keys, "_bucket").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums]).select(
        *keys, "_bucket",
        *[F.coalesce(F.sum(f"_t_{c}").over(prior), F.lit(0)).alias(f"_b_{c}") for c in sums],
    )
    w = Window.partitionBy(*keys, "_bucket").orderBy(ranked).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    local = cut.withColumns({f"cum_{c}": F.sum(c).over(w) for c in sums})
    return local.join(base, [*keys, "_bucket"]).withColumns({
        f"cum_{c}": F.col(f"cum_{c}") + F.col(f"_b_{c}") for c in sums
    }).drop("_bucket", *[f"_b_{c}" for c in sums])
