"""Registered queries over candle tables: reading, checking, updating, labelling, splitting."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoweft import settings
from chronoweft.functions.costs import (
    default_label_threshold, net_return, required_gross_return, scenario_table,
)
from chronoweft.functions.timefns import periods_per_year, timeframe_ms_col
from chronoweft.operators import candles as cd
from chronoweft.operators import quality as ql
from chronoweft.operators import splits as sp
from chronoweft.operators.features import technical_features
from chronoweft.operators.labels import next_open_labels
from chronoweft.operators.positions import number_rows
from chronoweft.plans.common import (
    CHUNK, HOUR, hourly, numbered, pseudo_score, query, r, sql_candles, sql_score, table, tidy,
)
from chronoweft.session import materialise, scratch_path
from chronoweft.settings import IndicatorSpec
from chronoweft.sources.candle_files import (
    load_feature_table, load_labeled_table, prepare_tables, read_candle_csv, write_candle_csv,
)

TAU = default_label_threshold()
AS_OF = "2024-01-31 00:00:00"
MID = "2024-01-20 00:00:00"
OVERLAP = "2024-01-15 12:00:00"


def ts(text: str):
    return F.lit(text).cast("timestamp")


OHLC = f"{r('o')} AS open, {r('h')} AS high, {r('l')} AS low, {r('c')} AS \"close\", v AS volume"


@query("candle_rollup", f"""
WITH {sql_candles()}
SELECT symbol, t AS timestamp, {OHLC} FROM bars""")
def candle_rollup(spark, sf):
    """Events to hourly candles of each type and of all types."""
    return tidy(hourly(spark, sf))


@query("candle_typing", """
SELECT event_type AS symbol,
       count(*) FILTER (WHERE event_type <> 'error') AS good_rows,
       count(*) FILTER (WHERE event_type = 'error') AS refused_rows,
       coalesce(round(sum(value) FILTER (WHERE event_type <> 'error'), 2), 0.0) AS close_sum
FROM events GROUP BY 1""")
def candle_typing(spark, sf):
    """Raw exchange rows (text arrays) to typed candles; short rows are refused, not lost."""
    v = F.format_string("%.2f", "value")
    values = [F.unix_millis("ts").cast("string"), v, v, v, v]
    raw = table(spark, sf, "events").select(
        F.col("event_type").alias("symbol"),
        F.when(F.col("event_type") == "error", F.array(*values))
        .otherwise(F.array(*values, F.lit("1"))).alias("row"),
    )
    good, refused = cd.rows_to_candles(raw)
    both = good.select("symbol", F.lit(1).alias("g"), F.lit(0).alias("b"), "close").unionByName(
        refused.select("symbol", F.lit(0).alias("g"), F.lit(1).alias("b"),
                       F.lit(None).cast("double").alias("close"))
    )
    return both.groupBy("symbol").agg(
        F.sum("g").alias("good_rows"), F.sum("b").alias("refused_rows"),
        F.coalesce(F.round(F.sum("close"), 2), F.lit(0.0)).alias("close_sum"),
    )


@query("page_consolidation", f"""
WITH rows AS (
  SELECT event_type AS symbol, epoch_us(ts) // {HOUR} * {HOUR} AS t, user_id, event_id, value
  FROM events),
kept AS (
  SELECT *, row_number() OVER (PARTITION BY symbol, t ORDER BY user_id DESC, event_id DESC) AS k
  FROM rows WHERE t >= epoch_us(TIMESTAMP '{OVERLAP}') AND t < epoch_us(TIMESTAMP '{MID}')
    AND t + {HOUR} <= epoch_us(TIMESTAMP '{AS_OF}'))
SELECT symbol, t AS timestamp, value AS "close" FROM kept WHERE k = 1""")
def page_consolidation(spark, sf):
    """Landed pages: half-open range, last page and row win, closed bars only."""
    from chronoweft.sources.adapters import bucket_start

    v = F.col("value")
    pages = table(spark, sf, "events").select(
        F.col("event_type").alias("symbol"), bucket_start(F.col("ts"), "1h").alias("timestamp"),
        v.alias("open"), v.alias("high"), v.alias("low"), v.alias("close"),
        F.lit(1.0).alias("volume"), F.col("user_id").alias("page_seq"),
        F.col("event_id").alias("row_seq"),
    )
    out = cd.consolidate_pages(pages, ["symbol"], "1h", since=ts(OVERLAP), until=ts(MID),
                               as_of=ts(AS_OF))
    return tidy(out.select("symbol", "timestamp", "close"))


def _stored_and_fetched(spark, sf):
    bars = hourly(spark, sf)
    stored = bars.filter(F.col("timestamp") < ts(MID))
    fetched = bars.filter(F.col("timestamp") >= ts(OVERLAP)).withColumn(
        "close", F.col("close") + 1.0
    ).withColumn("high", F.col("high") + 1.0)
    return stored, fetched


@query("incremental_update", f"""
WITH {sql_candles()}
SELECT symbol, t AS timestamp, {r('o')} AS open,
       {r(f"CASE WHEN t >= epoch_us(TIMESTAMP '{OVERLAP}') THEN h + 1 ELSE h END")} AS high,
       {r('l')} AS low,
       {r(f"CASE WHEN t >= epoch_us(TIMESTAMP '{OVERLAP}') THEN c + 1 ELSE c END")} AS "close",
       v AS volume
FROM bars WHERE t + {HOUR} <= epoch_us(TIMESTAMP '2024-01-29 06:30:00')""")
def incremental_update(spark, sf):
    """Stored and newly fetched candles merged; the fetched row wins on a shared bar."""
    stored, fetched = _stored_and_fetched(spark, sf)
    return tidy(cd.merge_update(stored, fetched, ["symbol"], "1h", ts("2024-01-29 06:30:00")))


@query("update_report", f"""
WITH {sql_candles()}
SELECT symbol,
       count(*) FILTER (WHERE t < epoch_us(TIMESTAMP '{MID}')) AS stored_rows,
       count(*) FILTER (WHERE t >= epoch_us(TIMESTAMP '{OVERLAP}')) AS fetched_rows,
       count(*) FILTER (WHERE t >= epoch_us(TIMESTAMP '{OVERLAP}')
                          AND t < epoch_us(TIMESTAMP '{MID}')) AS duplicates_removed,
       count(*) FILTER (WHERE t + {HOUR} <= epoch_us(TIMESTAMP '{AS_OF}')) AS merged_rows,
       max(t) FILTER (WHERE t < epoch_us(TIMESTAMP '{MID}')) + {HOUR} AS next_start
FROM bars GROUP BY 1""")
def update_report(spark, sf):
    """What an update did, and where the next one starts."""
    stored, fetched = _stored_and_fetched(spark, sf)
    report = cd.update_report(stored, fetched, ["symbol"], "1h", ts(AS_OF))
    return tidy(report.join(cd.next_start(stored, ["symbol"], "1h"), "symbol"))


@query("candle_csv_round_trip", f"""
WITH {sql_candles()}
SELECT symbol, t AS timestamp, {OHLC} FROM bars""")
def candle_csv_round_trip(spark, sf):
    """Candles written as canonical CSV and read back under the pinned schema."""
    path = scratch_path(spark, "candles-csv")
    write_candle_csv(hourly(spark, sf), path, keys=["symbol"])
    return tidy(read_candle_csv(spark, path, keys=["symbol"]))


@query("snapshot_identity", f"""
WITH {sql_candles()},
texts AS (
  SELECT symbol, concat_ws('|', t, printf('%.6f', o), printf('%.6f', h), printf('%.6f', l),
                           printf('%.6f', c), printf('%.6f', v)) AS x FROM bars)
SELECT symbol, count(*) AS rows,
       sum(('0x' || substr(md5(x), 1, 15))::BIGINT::HUGEINT)::VARCHAR AS digest
FROM texts GROUP BY 1""")
def snapshot_identity(spark, sf):
    """Order-free content digest of each series."""
    return cd.content_digest(hourly(spark, sf), ["symbol"])


@query("closed_bars", f"""
WITH {sql_candles()}
SELECT symbol, count(*) AS closed_rows, max(t) AS newest
FROM bars WHERE t + {HOUR} <= epoch_us(TIMESTAMP '2024-01-21 10:59:59') GROUP BY 1""")
def closed_bars(spark, sf):
    """Bars complete at a given clock."""
    kept = cd.closed_candles(hourly(spark, sf), "1h", ts("2024-01-21 10:59:59"))
    return tidy(kept.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("closed_rows"), F.max("timestamp").alias("newest")))


@query("timeframe_arithmetic", """
WITH x AS (
  SELECT o_orderpriority, (1 + o_orderkey % 59) AS k,
         CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'm' WHEN '2' THEN 'h' WHEN '3' THEN 'd'
              ELSE 'w' END AS u FROM orders),
y AS (
  SELECT o_orderpriority, CASE u WHEN 'm' THEN k * 60000 WHEN 'h' THEN k * 3600000
         WHEN 'd' THEN k * 86400000 END AS ms FROM x)
SELECT o_orderpriority AS priority, count(*) AS rows, count(ms) AS valid,
       sum(ms)::BIGINT AS total_ms, round(sum(31536000000.0 / ms), 4) AS periods
FROM y GROUP BY 1""")
def timeframe_arithmetic(spark, sf):
    """Mixed timeframe texts to milliseconds and bars per year."""
    unit = F.substring("o_orderpriority", 1, 1)
    text = F.concat(
        (F.lit(1) + F.col("o_orderkey") % 59).cast("string"),
        F.when(unit == "1", "m").when(unit == "2", "h").when(unit == "3", "d").otherwise("w"),
    )
    rows = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("priority"), timeframe_ms_col(text).alias("ms"))
    return rows.groupBy("priority").agg(
        F.count(F.lit(1)).alias("rows"), F.count("ms").alias("valid"),
        F.sum("ms").alias("total_ms"), F.round(F.sum(periods_per_year(F.col("ms"))), 4)
        .alias("periods"))


@query("symbol_slugs", r"""
SELECT regexp_replace(regexp_replace(lower(trim(p_name || '/' || p_brand)), '[^a-z0-9]+', '_', 'g'),
                      '^_+|_+$', '', 'g') AS slug, count(*) AS parts
FROM part GROUP BY 1""")
def symbol_slugs(spark, sf):
    """File-safe names from free-form symbols."""
    name = F.concat(F.col("p_name"), F.lit("/"), F.col("p_brand"))
    return table(spark, sf, "part").groupBy(cd.symbol_slug(name).alias("slug")).agg(
        F.count(F.lit(1)).alias("parts"))


def _sql_net(g: str, f: str, e: str) -> str:
    return f"((1 + {g}) * (1 - {e}) / (1 + {e}) * (1 - {f}) * (1 - {f}) - 1)"


@query("cost_arithmetic", f"""
WITH {sql_candles()},
g AS (SELECT symbol, c / o - 1 AS g FROM bars),
s(scenario, f, e, tau) AS (VALUES
  ('low', 0.001::DOUBLE, 0.00015::DOUBLE, {required_gross_return(0.001, 1.0, 0.5, 5.0)!r}::DOUBLE),
  ('base', 0.001, 0.0003, {required_gross_return(0.001, 2.0, 1.0, 5.0)!r}),
  ('high', 0.001, 0.0007, {required_gross_return(0.001, 5.0, 2.0, 5.0)!r}))
SELECT symbol, scenario, {r('tau', 12)} AS required_gross, {r('avg(' + _sql_net('g', 'f', 'e') + ')')}
       AS mean_net, count(*) FILTER (WHERE g > tau) AS clears
FROM g, s GROUP BY symbol, scenario, tau""")
def cost_arithmetic(spark, sf):
    """Required gross return and net return of each bar's body under every scenario."""
    tau = F.create_map(*[x for n, f, s, h in settings.COST_SCENARIOS for x in (
        F.lit(n), F.lit(required_gross_return(f, s, h, settings.MIN_EDGE_BPS)))])
    rows = hourly(spark, sf).select("symbol", (F.col("close") / F.col("open") - 1.0).alias("g"))
    joined = rows.crossJoin(F.broadcast(scenario_table(spark))).withColumn(
        "tau", tau[F.col("scenario")])
    return joined.groupBy("symbol", "scenario", F.round("tau", 12).alias("required_gross")).agg(
        F.round(F.avg(net_return(F.col("g"), F.col("fee_rate"), F.col("execution_rate"))), 6)
        .alias("mean_net"),
        F.count_if(F.col("g") > F.col("tau")).alias("clears"))


@query("candle_contract", f"""
WITH {sql_candles()},
broken AS (
  SELECT symbol, t, pos, n,
         CASE WHEN event_hour = 3 THEN -o ELSE o END AS o,
         CASE WHEN event_hour = 5 THEN l / 2 - 1000 ELSE h END AS h, l, c, v
  FROM (SELECT *, (t // {HOUR}) % 24 AS event_hour FROM candles)),
x AS (SELECT *, t - lag(t) OVER (PARTITION BY symbol ORDER BY t) AS gap FROM broken)
SELECT symbol, 'price_not_positive' AS "check", t AS timestamp, 'open' AS detail FROM x WHERE o <= 0
UNION ALL SELECT symbol, 'price_not_positive', t, 'high' FROM x WHERE h <= 0
UNION ALL SELECT symbol, 'high_below_low', t, NULL FROM x WHERE h < l
UNION ALL SELECT symbol, 'open_outside_range', t, NULL FROM x WHERE o < l OR o > h
UNION ALL SELECT symbol, 'close_outside_range', t, NULL FROM x WHERE c < l OR c > h
UNION ALL SELECT symbol, 'irregular_interval', t,
  'expected ' || strftime(make_timestamp(t - gap + {HOUR}), '%Y-%m-%dT%H:%M:%SZ') ||
  ' received ' || strftime(make_timestamp(t), '%Y-%m-%dT%H:%M:%SZ') FROM x WHERE gap <> {HOUR}
UNION ALL SELECT symbol, 'final_bar_open', t, NULL FROM x
  WHERE pos = n - 1 AND t + {HOUR} > epoch_us(TIMESTAMP '2024-01-30 23:30:00')""")
def candle_contract(spark, sf):
    """Every broken candle rule as a row, over a table with faults put in by hour of day."""
    hour = F.hour("timestamp")
    rows = hourly(spark, sf).withColumns({
        "open": F.when(hour == 3, -F.col("open")).otherwise(F.col("open")),
        "high": F.when(hour == 5, F.col("low") / 2 - 1000).otherwise(F.col("high")),
    })
    return tidy(ql.candle_violations(rows, ["symbol"], "1h", ts("2024-01-30 23:30:00"),
                                     chunk_rows=CHUNK))


@query("series_gaps", f"""
WITH {sql_candles()},
x AS (SELECT symbol, t, lag(t) OVER (PARTITION BY symbol ORDER BY t) AS p FROM bars)
SELECT symbol, p AS previous, t AS following, (t - p) // {HOUR} - 1 AS missing
FROM x WHERE t - p <> {HOUR}""")
def series_gaps(spark, sf):
    """All holes of the hourly series."""
    return tidy(ql.series_gaps(hourly(spark, sf), ["symbol"], "1h", chunk_rows=CHUNK))


@query("daily_order_gaps", """
WITH d AS (
  SELECT DISTINCT symbol, epoch_us(o_orderdate) // 86400000000 AS d
  FROM (SELECT o_orderdate, unnest(['ALL', o_orderstatus]) AS symbol FROM orders)),
x AS (SELECT symbol, d, lag(d) OVER (PARTITION BY symbol ORDER BY d) AS p FROM d)
SELECT symbol, p * 86400000000 AS previous, d * 86400000000 AS following, d - p - 1 AS missing
FROM x WHERE d - p <> 1""")
def daily_order_gaps(spark, sf):
    """Missing days of the order book, per status and overall."""
    from chronoweft.sources.adapters import candles_from_ticks

    bars = candles_from_ticks(table(spark, sf, "orders"), ts="o_orderdate", price="o_totalprice",
                              timeframe="1d", symbol="o_orderstatus", order="o_orderkey")
    return tidy(ql.series_gaps(bars, ["symbol"], "1d", chunk_rows=CHUNK))


LABELS_SQL = f"""
labeled AS (
  SELECT symbol, pos, n, t, t_entry, t_exit, o_entry, o_exit, o_exit / o_entry - 1 AS g,
         CASE WHEN o_exit / o_entry - 1 > {TAU!r} THEN 1 ELSE 0 END AS label
  FROM (SELECT *, lead(t, 1) OVER w AS t_entry, lead(t, 5) OVER w AS t_exit,
               lead(o, 1) OVER w AS o_entry, lead(o, 5) OVER w AS o_exit
        FROM candles WINDOW w AS (PARTITION BY symbol ORDER BY t))
  WHERE o_exit IS NOT NULL)"""


@query("next_open_labels", f"""
WITH {sql_candles()}, {LABELS_SQL}
SELECT symbol, pos, t AS timestamp, t_entry AS entry_timestamp, t_exit AS exit_timestamp,
       {r('o_entry')} AS entry_open, {r('o_exit')} AS exit_open, {r('g')} AS gross_forward_return,
       label::BIGINT AS label FROM labeled""")
def labels(spark, sf):
    """Executable forward returns and labels."""
    return tidy(next_open_labels(numbered(spark, sf), ["symbol"], chunk_rows=CHUNK).select(
        "symbol", "pos", "timestamp", "entry_timestamp", "exit_timestamp", "entry_open",
        "exit_open", "gross_forward_return", "label"))


def labeled(spark, sf):
    """Labeled candles, short chunks."""
    return next_open_labels(numbered(spark, sf).drop("n"), ["symbol"], chunk_rows=CHUNK)


SPLIT_SQL = """
sized AS (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY t) - 1 AS p,
         count(*) OVER (PARTITION BY symbol) AS m FROM labeled),
split AS (
  SELECT *, m - greatest(1, ceil(m * 0.2))::BIGINT AS hs,
         m - greatest(1, ceil(m * 0.2))::BIGINT - 5 AS nd FROM sized),
parts AS (
  SELECT *, CASE WHEN p >= hs THEN 'holdout' WHEN p >= nd THEN 'boundary_purge'
                 ELSE 'development' END AS part FROM split)"""

FOLDS_SQL = """
folds AS (
  SELECT * FROM (
    SELECT d.*, f.fold,
           nd - greatest(1, floor(nd * 0.1)::BIGINT) * (5 - f.fold + 1) AS vs,
           greatest(1, floor(nd * 0.1)::BIGINT) AS sz
    FROM parts d, (SELECT unnest(range(1, 6)) AS fold) f WHERE part = 'development')
  WHERE p < vs + sz AND vs - 5 > 0),
roles AS (
  SELECT *, CASE WHEN p >= vs THEN 'validation' WHEN p >= vs - 5 THEN 'gap' ELSE 'train' END AS role
  FROM folds)"""


@query("partition_ranges", f"""
WITH {sql_candles()}, {LABELS_SQL}, {SPLIT_SQL}
SELECT symbol, part AS partition, count(*) AS row_count, min(p) AS start_position,
       max(p) AS end_position, min(t) AS start_timestamp, max(t) AS end_timestamp,
       max(t_exit) AS max_exit_timestamp FROM parts GROUP BY 1, 2""")
def partition_ranges(spark, sf):
    """Development, purge and holdout boundaries of every series."""
    split = sp.assign_partitions(labeled(spark, sf), ["symbol"])
    return tidy(sp.partition_ranges(split, ["symbol"]))


@query("walk_forward_folds", f"""
WITH {sql_candles()}, {LABELS_SQL}, {SPLIT_SQL}, {FOLDS_SQL}
SELECT symbol, fold::BIGINT AS fold, role, count(*) AS row_count, min(p) AS start_position,
       max(p) AS end_position, min(t) AS start_timestamp, max(t) AS end_timestamp,
       max(t_exit) AS max_exit_timestamp FROM roles GROUP BY 1, 2, 3""")
def walk_forward_folds(spark, sf):
    """Expanding folds with purge gaps."""
    split = sp.assign_partitions(labeled(spark, sf), ["symbol"])
    return tidy(sp.fold_ranges(sp.assign_folds(split, ["symbol"]), ["symbol"]))


@query("split_leaks", f"""
WITH {sql_candles()}, {LABELS_SQL}, {SPLIT_SQL}, {FOLDS_SQL}
SELECT symbol, fold::BIGINT AS fold, 'label_leak' AS "check" FROM (
  SELECT symbol, fold, max(t_exit) FILTER (WHERE role = 'train') AS e,
         min(t) FILTER (WHERE role = 'validation') AS s FROM roles GROUP BY 1, 2) WHERE e >= s""")
def split_leaks(spark, sf):
    """Leak check of partitions and folds; an empty result is the pass."""
    split = sp.assign_partitions(labeled(spark, sf), ["symbol"])
    folds = sp.assign_folds(split, ["symbol"])
    return tidy(sp.split_violations(split, folds, ["symbol"]))


@query("training_class_census", f"""
WITH {sql_candles()}, {LABELS_SQL}, {SPLIT_SQL}, {FOLDS_SQL}
SELECT symbol, fold::BIGINT AS fold, string_agg(DISTINCT label::VARCHAR, ',' ORDER BY label::VARCHAR)
       AS classes, count(*) AS train_rows, (count(DISTINCT label) = 1)::INT::BIGINT AS one_class
FROM roles WHERE role = 'train' GROUP BY 1, 2""")
def training_class_census(spark, sf):
    """Classes seen by each training fold."""
    split = sp.assign_partitions(labeled(spark, sf), ["symbol"])
    census = sp.training_classes(sp.assign_folds(split, ["symbol"]), ["symbol"])
    return tidy(census.withColumn("classes", F.array_join("classes", ",")))


@query("development_summary", f"""
WITH {sql_candles()}, {LABELS_SQL}, {SPLIT_SQL}
SELECT symbol, part AS partition, count(*) AS rows, min(t) AS first_timestamp,
       max(t) AS last_timestamp, {r('avg(label)')} AS positive_rate FROM parts GROUP BY 1, 2""")
def development_summary(spark, sf):
    """Rows, boundaries and positive rate of each partition."""
    split = sp.assign_partitions(labeled(spark, sf), ["symbol"])
    return tidy(split.groupBy("symbol", "partition").agg(
        F.count(F.lit(1)).alias("rows"), F.min("timestamp").alias("first_timestamp"),
        F.max("timestamp").alias("last_timestamp"),
        F.avg(F.col("label").cast("double")).alias("positive_rate")))


@query("training_matrix_contract", f"""
WITH {sql_candles()}, {LABELS_SQL}
SELECT symbol, count(*) AS rows, 0::BIGINT AS bad_labels,
       count(*) FILTER (WHERE g < 0) AS bad_root, 0::BIGINT AS bad_gross FROM labeled GROUP BY 1""")
def training_matrix_contract(spark, sf):
    """Non-finite features and labels outside {0, 1}, counted per series."""
    rows = labeled(spark, sf).select(
        "symbol", F.sqrt("gross_forward_return").alias("root"),
        F.col("gross_forward_return").alias("gross"), "label")
    return tidy(ql.training_matrix_report(rows, ["root", "gross"], by=["symbol"]))


@query("feature_input_contract", """
WITH x AS (SELECT o_orderstatus AS symbol, epoch_us(o_orderdate) AS t, o_totalprice AS p FROM orders)
SELECT symbol, 'duplicate_timestamp' AS "check", t AS timestamp, count(*)::VARCHAR AS detail
FROM x GROUP BY symbol, t HAVING count(*) > 1""")
def feature_input_contract(spark, sf):
    """Duplicate decision times in an unaggregated table."""
    p = F.col("o_totalprice")
    rows = table(spark, sf, "orders").select(
        F.col("o_orderstatus").alias("symbol"), F.col("o_orderdate").alias("timestamp"),
        p.alias("open"), p.alias("high"), p.alias("low"), p.alias("close"),
        F.lit(1.0).alias("volume"))
    return tidy(ql.feature_input_violations(rows, ["symbol"]))


@query("label_input_contract", f"""
WITH {sql_candles()}
SELECT symbol, 'price_not_positive' AS "check", t AS timestamp, 'open' AS detail
FROM bars WHERE o - 50 <= 0""")
def label_input_contract(spark, sf):
    """Opens that are not positive after a constant is taken off."""
    rows = hourly(spark, sf).withColumn("open", F.col("open") - 50.0)
    return tidy(ql.label_input_violations(rows, ["symbol"]))


@query("split_input_contract", f"""
WITH {sql_candles()}, {LABELS_SQL}
SELECT symbol, 'exit_not_after_decision' AS "check", t AS timestamp, NULL::VARCHAR AS detail
FROM labeled WHERE label = 1""")
def split_input_contract(spark, sf):
    """Exits moved before their decisions are reported."""
    rows = labeled(spark, sf).withColumn(
        "exit_timestamp", F.when(F.col("label") == 1, F.col("timestamp"))
        .otherwise(F.col("exit_timestamp")))
    return tidy(ql.split_input_violations(rows, ["symbol"]))


@query("score_contract", f"""
WITH {sql_candles()},
s AS (SELECT symbol, t, {sql_score()} * 1.1 AS p FROM bars)
SELECT symbol, 'score_outside_unit' AS "check", t AS timestamp, NULL::VARCHAR AS detail
FROM s WHERE p > 1
UNION ALL
SELECT symbol, 'score_without_market_row', t, NULL FROM s WHERE symbol = 'ALL'
""")
def score_contract(spark, sf):
    """Scores out of range, and scores whose market row is missing."""
    bars = hourly(spark, sf)
    scores = bars.select("symbol", "timestamp", (pseudo_score() * 1.1).alias("probability_score"))
    market = bars.filter(F.col("symbol") != "ALL")
    return tidy(ql.score_violations(market, scores, ["symbol"]))


@query("feature_tables_manifest", f"""
WITH {sql_candles()}, {LABELS_SQL}
SELECT symbol, n AS raw_rows, n - 33 AS feature_rows, n - 33 - 5 AS labeled_rows,
       33::BIGINT AS warmup_rows, 5::BIGINT AS tail_rows,
       max(t) FILTER (WHERE pos = 33) AS first_feature, max(t) AS last_feature
FROM candles GROUP BY symbol, n""")
def feature_tables_manifest(spark, sf):
    """The prepare sink: feature and labeled tables written, read back, counted."""
    path = scratch_path(spark, "prepared")
    manifest = prepare_tables(number_rows(hourly(spark, sf), ["symbol"]), path, ["symbol"],
                              chunk_rows=CHUNK)
    load_feature_table(spark, path, ["symbol"])
    load_labeled_table(spark, path, ["symbol"])
    return tidy(manifest.drop("schema_sha256", "minimum_return"))


@query("bundle_reconciliation", f"""
WITH {sql_candles()}
SELECT symbol, 'labels_value_differs' AS "check", (n - 33 - 5)::BIGINT AS rows
FROM candles WHERE symbol = 'ALL' AND pos = 0""")
def bundle_reconciliation(spark, sf):
    """Raw, feature and labeled tables compared; the labels of one series were flipped before."""
    raw = number_rows(hourly(spark, sf), ["symbol"])
    features = materialise(
        technical_features(raw, ["symbol"], positioned=True, chunk_rows=CHUNK), "features")
    again = number_rows(features.drop("pos"), ["symbol"])
    lab = next_open_labels(again, ["symbol"], chunk_rows=CHUNK).withColumn(
        "label", F.when(F.col("symbol") == "ALL", 1 - F.col("label")).otherwise(F.col("label"))
        .cast("tinyint"))
    return tidy(ql.bundle_violations(
        raw, features, lab, ["symbol"], horizon=4, minimum_return=TAU,
        minimum_rows=IndicatorSpec().minimum_rows))
