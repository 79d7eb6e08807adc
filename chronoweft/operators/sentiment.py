"""Point-in-time news features on decision rows.

A duplicate group enters the window by its first-seen time and shows, at every decision, the newest
version of its anchor known by then. Every group version is therefore visible on one time interval;
it is cut to the hours of that interval (at most 25) and meets decisions by hour. Decisions are few,
so the join is usually a broadcast that AQE chooses by size. What meets is dealt by decision over as
many partitions as its number of rows asks for; all later sums and windows stay inside them, so that a
task's memory does not grow with the table. Spread is summed about each source's own mean and merged as
(weight, mean, squared deviations), so it keeps its digits on scores far from zero.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweft import settings
from chronoweft.session import materialise

HOUR_US = 3_600_000_000
PART_ROWS = 100_000
NEWS_FEATURES = [
    "sentiment_mean_6h", "sentiment_mean_24h", "news_count_1h", "news_count_6h",
    "news_count_24h", "sentiment_recency_6h", "sentiment_recency_24h", "positive_share_24h",
    "negative_share_24h", "sentiment_dispersion_24h", "source_count_24h",
    "hours_since_latest_article", "news_missing_24h",
]
DIAGNOSTICS = [f"scoring_failure_{k}_{w}h" for k in ("count", "rate") for w in (6, 24)]


def visible_versions(versions: DataFrame, keys: Sequence[str] = (), *,
                     window_hours: int = 24) -> DataFrame:
    """Interval ``[visible_from, visible_to)`` of every anchor version within its window.

    ``versions``: ``(keys…, group_id, group_first_seen, version_first_seen, source, state,
    sentiment, relevance)``. Every revision counts from its own microsecond on; of several rows of one
    anchor at one instant the largest by state, sentiment and relevance stands.
    """
    keys = list(keys)
    ids = [*keys, "group_id"]
    g, v = F.unix_micros("group_first_seen"), F.unix_micros("version_first_seen")
    end = g + F.lit(window_hours * HOUR_US)
    kept = versions.filter(v < end).groupBy(*ids, "version_first_seen").agg(
        F.max(F.struct("state", "sentiment", "relevance", "source", "group_first_seen")).alias("_v")
    ).select(*ids, "version_first_seen", "_v.*")
    following = F.lead(v, 1).over(Window.partitionBy(*ids).orderBy("version_first_seen"))
    return kept.withColumns({
        "visible_from": v, "visible_to": F.least(F.coalesce(following, end), end),
    })


def _parts(hours: DataFrame, decisions: DataFrame, keys: list[str]) -> int:
    """Partitions that hold about ``PART_ROWS`` rows each when ``hours`` meet ``decisions``."""
    held = hours.agg(F.sum("_n")).first()[0] or 0
    many, apart = decisions.agg(F.count(F.lit(1)), F.count_distinct(F.struct(*keys, "_h"))).first()
    return max(1, int(-(-held * many // max(apart, 1) // PART_ROWS)))


def _contributions(visible: DataFrame, decisions: DataFrame, keys: list[str],
                   ts: str) -> DataFrame:
    """Visible version rows matched to the decisions that can see them, dealt by decision.

    Partitions are counted from the rows to come: the bytes of a shuffle say little here, as a version
    repeats hour by hour and grows by two dozen sums.
    """
    first = F.floor(F.col("visible_from") / HOUR_US).cast("long")
    last = F.floor(F.col("visible_to") / HOUR_US).cast("long")
    visible = materialise(visible.withColumn("_n", last - first + 1), "visible")
    t = F.unix_micros(F.col(ts))
    rows = decisions.select(*keys, ts).withColumn(
        "_h", F.floor(t / F.lit(HOUR_US)).cast("long")
    ).withColumn("_t", t)
    parts = _parts(visible, rows, keys)
    # the hint keeps the rows off a broadcast: their size is estimated before they repeat by hour
    cut = visible.withColumn("_h", F.explode(F.sequence(first, last))).repartition(
        parts, *keys, "_h").hint("merge")
    return cut.join(rows, [*keys, "_h"]).filter(
        (F.col("visible_from") <= F.col("_t")) & (F.col("_t") < F.col("visible_to"))
    ).withColumn("_age", (F.col("_t") - F.unix_micros("group_first_seen")) / float(HOUR_US)
                 ).repartition(parts, *keys, ts)


def _valid() -> Column:
    return (F.col("state") == "succeeded") & (F.col("relevance") >= settings.RELEVANCE_FLOOR)


def _partials() -> dict[str, Column]:
    s, r, age = F.col("sentiment"), F.col("relevance"), F.col("_age")
    valid = _valid()
    failed = F.coalesce(F.col("state") != "succeeded", F.lit(True))

    def total(value: Column, when: Column) -> Column:
        return F.sum(F.when(when, value).otherwise(0.0))

    out: dict[str, Column] = {"_latest": F.min("_age")}
    for w in (1, 6, 24):
        out[f"_n{w}"] = F.count_if(age < w)
    for w in (6, 24):
        fresh = valid & (age < w)
        decay = F.pow(F.lit(2.0), -age / w)
        out[f"_r{w}"] = total(r, fresh)
        out[f"_rs{w}"] = total(r * s, fresh)
        out[f"_d{w}"] = total(r * decay, fresh)
        out[f"_ds{w}"] = total(r * decay * s, fresh)
        out[f"_f{w}"] = F.count_if(failed & (age < w))
    out["_pos"] = total(r, valid & (s > settings.SENTIMENT_NEUTRAL))
    out["_neg"] = total(r, valid & (s < -settings.SENTIMENT_NEUTRAL))
    return out


def _finish(df: DataFrame, others: list[str]) -> DataFrame:
    def ratio(a: str, b: str) -> Column:
        return F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))

    mean = ratio("_rs24", "_r24")
    spread = F.sqrt(F.greatest(ratio("_m2", "_r24"), F.lit(0.0)))
    n24 = F.coalesce("_n24", F.lit(0))
    return df.select(
        *others, ratio("_rs6", "_r6").alias("sentiment_mean_6h"),
        mean.alias("sentiment_mean_24h"),
        *[F.coalesce(f"_n{w}", F.lit(0)).alias(f"news_count_{w}h") for w in (1, 6, 24)],
        ratio("_ds6", "_d6").alias("sentiment_recency_6h"),
        ratio("_ds24", "_d24").alias("sentiment_recency_24h"),
        ratio("_pos", "_r24").alias("positive_share_24h"),
        ratio("_neg", "_r24").alias("negative_share_24h"),
        spread.alias("sentiment_dispersion_24h"),
        F.coalesce("_sources", F.lit(0)).alias("source_count_24h"),
        F.least(F.lit(24.0), F.coalesce("_latest", F.lit(24.0)))
        .alias("hours_since_latest_article"),
        (n24 == 0).cast("int").alias("news_missing_24h"),
        *[F.coalesce(f"_f{w}", F.lit(0)).alias(f"scoring_failure_count_{w}h") for w in (6, 24)],
        *[ratio(f"_f{w}", f"_n{w}").alias(f"scoring_failure_rate_{w}h") for w in (6, 24)],
    )


UNITS = {"source": "source", "group": "group_id",
         "day": "date_format(timestamp_micros(unix_micros(group_first_seen)), 'yyyy-MM-dd')"}
_SUMS = ["_n1", "_n6", "_n24", *[f"_{n}{w}" for w in (6, 24) for n in ("r", "rs", "d", "ds", "f")],
         "_pos", "_neg"]


def _mean() -> Column:
    return F.coalesce(F.try_divide("_rs24", "_r24"), F.lit(0.0))


def _cells(decisions: DataFrame, versions: DataFrame, keys: list[str], ts: str,
           unit: Column) -> DataFrame:
    """Partial sums per decision, unit and source, with squared deviations from the cell's mean."""
    rows = _contributions(visible_versions(versions, keys), decisions, keys, ts).withColumn(
        "_unit", unit)
    ids = [*keys, ts, "_unit", "source"]
    cell = Window.partitionBy(*ids)
    weight = F.when(_valid(), F.col("relevance"))
    centre = F.coalesce(F.try_divide(F.sum(weight * F.col("sentiment")).over(cell),
                                     F.sum(weight).over(cell)), F.lit(0.0))
    off = F.col("sentiment") - F.col("_centre")
    return rows.withColumn("_centre", centre).groupBy(*ids).agg(
        *[c.alias(n) for n, c in _partials().items()],
        F.coalesce(F.sum(weight * off * off), F.lit(0.0)).alias("_m2"))


def _merge(cells: DataFrame, by: list[str], *more: Column) -> DataFrame:
    """Sums of cells; squared deviations by the weights and means of the parts."""
    over = Window.partitionBy(*by)
    centre = F.coalesce(F.try_divide(F.sum("_rs24").over(over), F.sum("_r24").over(over)), F.lit(0.0))
    off = _mean() - F.col("_centre")
    return cells.withColumn("_centre", centre).withColumn(
        "_m2", F.col("_m2") + F.col("_r24") * off * off
    ).groupBy(*by).agg(F.min("_latest").alias("_latest"),
                       *[F.sum(n).alias(n) for n in [*_SUMS, "_m2"]], *more)


def news_features(decisions: DataFrame, versions: DataFrame, keys: Sequence[str] = (), *,
                  ts: str = "decision_at") -> DataFrame:
    """The 13 features and the failure diagnostics of every decision; no row is ever lost."""
    keys = list(keys)
    cells = _cells(decisions, versions, keys, ts, F.lit("all"))
    sums = _merge(cells, [*keys, ts], F.count_if(F.col("_n24") > 0).alias("_sources"))
    return _finish(decisions.join(sums, [*keys, ts], "left"), decisions.columns)


def leave_one_out(decisions: DataFrame, versions: DataFrame, unit: str, keys: Sequence[str] = (), *,
                  ts: str = "decision_at") -> DataFrame:
    """All features of each decision without each unit (source, day or group) present in its window.

    What is left is the merge of the units before and after the removed one in a fixed order: two
    running windows per decision, no pairs of units, and no sum is taken off another. A decision that
    did not see a unit is unchanged by its removal and not repeated. Spread inside a unit is exact;
    between units it is summed about the mean of the decision.
    """
    keys = list(keys)
    by = [*keys, ts]
    cells = _cells(decisions, versions, keys, ts, F.expr(UNITS[unit]))
    shared = F.count(F.lit(1)).over(Window.partitionBy(*by, "source"))
    # a source counts once, with the first unit that holds it
    first = F.row_number().over(Window.partitionBy(*by, "source").orderBy("_unit")) == 1
    units = _merge(cells.withColumns({"_only": (shared == 1).cast("int"), "_first": first.cast("int")}),
                   [*by, "_unit"], F.sum("_only").alias("_only"), F.sum("_first").alias("_first"))
    whole = Window.partitionBy(*by)
    centre = F.coalesce(F.try_divide(F.sum("_rs24").over(whole), F.sum("_r24").over(whole)),
                        F.lit(0.0))
    shift = F.col("_r24") * (_mean() - F.col("_centre"))
    prepared = units.withColumn("_centre", centre).withColumns({
        "_s1": shift, "_s2": shift * (_mean() - F.col("_centre")), "_all": F.sum("_first").over(whole)})
    before = Window.partitionBy(*by).orderBy("_unit").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*by).orderBy(F.desc("_unit")).rowsBetween(
        Window.unboundedPreceding, -1)
    added = [*_SUMS, "_m2", "_s1", "_s2"]
    rest = prepared.select(
        *by, F.col("_unit").alias("removed"), (F.col("_all") - F.col("_only")).alias("_sources"),
        F.least(F.min("_latest").over(before), F.min("_latest").over(after)).alias("_latest"),
        *[(F.coalesce(F.sum(n).over(before), F.lit(0)) + F.coalesce(F.sum(n).over(after), F.lit(0)))
          .alias(n) for n in added])
    between = F.col("_s2") - F.coalesce(F.try_divide(F.col("_s1") * F.col("_s1"), F.col("_r24")),
                                        F.lit(0.0))
    merged = rest.withColumn("_m2", F.col("_m2") + F.greatest(between, F.lit(0.0)))
    return _finish(merged, [*by, "removed"])


def leave_one_source_out(decisions: DataFrame, versions: DataFrame, keys: Sequence[str] = (), *,
                         ts: str = "decision_at") -> DataFrame:
    """Features of each decision without each source that was present in its window."""
    return leave_one_out(decisions, versions, "source", keys, ts=ts).withColumnRenamed(
        "removed", "removed_source")


def drop_gap_decisions(decisions: DataFrame, touched: DataFrame, keys: Sequence[str] = (), *,
                       ts: str = "decision_at") -> DataFrame:
    """Decisions outside provider gaps; their uncut positions stay as they were."""
    return decisions.join(touched.select(*keys, ts), [*keys, ts], "left_anti")


def missingness_cube(features: DataFrame, dimensions: Sequence[str],
                     sets: Sequence[Sequence[str]] | None = None) -> DataFrame:
    """Missing-news and failure shares over grouping sets: every margin and crossing by default.

    ``level`` names the dimensions of a row, so that a null dimension and a margin stay apart.
    """
    level = F.concat_ws(",", *[
        F.when(F.grouping(d) == 0, F.lit(d)) for d in dimensions])
    names = list(dimensions)
    grouped = features.cube(*names) if sets is None else features.groupingSets(
        [[F.col(c) for c in one] for one in sets], *[F.col(c) for c in names])
    return grouped.agg(
        level.alias("level"), F.count(F.lit(1)).alias("decisions"),
        F.avg(F.col("news_missing_24h").cast("double")).alias("missing_rate"),
        F.avg(F.col("scoring_failure_rate_24h")).alias("failure_rate"),
    )


def gate_table(metrics: DataFrame, gates: Sequence[tuple[str, str, float]],
               by: Sequence[str] = ()) -> DataFrame:
    """One row per gate: value, bound and pass. A null value fails."""
    tests = {">=": lambda a, b: a >= b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b,
             "<": lambda a, b: a < b}
    rows = F.array(*[
        F.struct(F.lit(column).alias("gate"), F.lit(sign).alias("comparison"),
                 F.lit(float(bound)).alias("bound"), F.col(column).cast("double").alias("value"),
                 F.coalesce(tests[sign](F.col(column), F.lit(float(bound))), F.lit(False))
                 .alias("passed"))
        for column, sign, bound in gates
    ])
    return metrics.select(*by, F.inline(rows))
