"""Registered queries over trades, equity, risk metrics and baselines."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoweft import settings
from chronoweft.functions.costs import scenario_table, sensitivity_scenarios
from chronoweft.operators import baselines as bl
from chronoweft.operators import risk
from chronoweft.operators import trades as tr
from chronoweft.operators.features import technical_features
from chronoweft.operators.labels import next_open_labels
from chronoweft.operators.positions import number_rows
from chronoweft.operators.simulations import simulate
from chronoweft.plans.common import (
    CHUNK, MONEY, hourly, numbered, pseudo_score, query, r, sql_candles, sql_score, tidy,
)
from chronoweft.plans.indicators import FEATURES_CTE
from chronoweft.plans.market_data import LABELS_SQL
from chronoweft.session import materialise

H = settings.PREDICTION_HORIZON
PPY = 8760.0
LEVEL = 10_000.0
PRICE = "value + 10000.0"
BASE = [s for s in settings.COST_SCENARIOS if s[0] == "base"]


def market(spark, sf):
    """Numbered hourly bars as a written table, as a market store would hold them."""
    return materialise(numbered(spark, sf, level=LEVEL).drop("n"), "market")


def labeled_scores(bars):
    """Every labeled row with a deterministic score; run ``model``."""
    rows = next_open_labels(bars, ["symbol"], chunk_rows=CHUNK)
    return materialise(rows.select(
        F.lit("model").alias("run_id"), "symbol", "pos", "timestamp",
        pseudo_score().alias("probability_score"), "label"), "scores")


SCORES_SQL = f"""
scores AS (
  SELECT 'model' AS run_id, symbol, pos, t, n, {sql_score()} AS p, label FROM labeled)"""


def selection_sql(scores: str = "scores") -> str:
    """Window, greedy walk (row by row) and role of every mark."""
    return f"""
win AS (
  SELECT run_id, symbol, min(pos) + 1 AS sp, max(pos) FILTER (WHERE pos + {H + 1} < n) + {H + 1} AS ep
  FROM {scores} GROUP BY 1, 2),
path AS (
  SELECT w.run_id, w.symbol, m.pos, m.t, m.o, w.sp, w.ep,
         coalesce(s.p >= 0.5 AND m.pos + {H + 1} <= w.ep, false) AS sig
  FROM win w JOIN candles m ON m.symbol = w.symbol AND m.pos BETWEEN w.sp - 1 AND w.ep
  LEFT JOIN {scores} s ON s.run_id = w.run_id AND s.symbol = m.symbol AND s.pos = m.pos),
walk AS (
  SELECT run_id, symbol, pos, CASE WHEN sig THEN pos ELSE -1000 END AS last
  FROM path WHERE pos = sp - 1
  UNION ALL
  SELECT p.run_id, p.symbol, p.pos,
         CASE WHEN p.sig AND p.pos > k.last + {H} THEN p.pos ELSE k.last END
  FROM walk k JOIN path p ON p.run_id = k.run_id AND p.symbol = k.symbol AND p.pos = k.pos + 1)"""


CURVE_SQL = f"""
role AS (
  SELECT p.*, p.pos - lag(k.last) OVER w AS held, lag(k.last) OVER w AS signal_pos,
         lag(p.o) OVER w AS o1
  FROM path p JOIN walk k USING (run_id, symbol, pos)
  WINDOW w AS (PARTITION BY run_id, symbol ORDER BY p.pos)),
grow AS (
  SELECT r.*, s.scenario, s.f, s.e, CASE WHEN held <= {H + 1} THEN signal_pos END AS sigp,
    CASE WHEN held = 1 THEN (1 - f) / (1 + e) WHEN held = {H + 1} THEN o / o1 * (1 - e) * (1 - f)
         WHEN held BETWEEN 2 AND {H} THEN o / o1 ELSE 1 END AS g
  FROM role r, scen s WHERE pos >= sp),
curve AS (
  SELECT *, max(lv) OVER w AS pk0, greatest(1, max(lv) OVER w) AS pk,
    CASE WHEN pos = sp + 1 THEN lv - 1 WHEN pos > sp THEN g - 1 END AS ret,
    CASE WHEN pos > sp THEN (held BETWEEN 2 AND {H + 1})::INT END AS expo,
    count(*) FILTER (WHERE held = 1) OVER w AS tn
  FROM (SELECT *, product(g) OVER (PARTITION BY run_id, scenario, symbol ORDER BY pos) AS lv FROM grow)
  WINDOW w AS (PARTITION BY run_id, scenario, symbol ORDER BY pos)),
trades AS (
  SELECT x.run_id, x.scenario, x.symbol, x.sigp, x.f, x.e, x.tn AS trade_id, n.t AS t0, x.t AS t1,
    n.o AS p0, x.o AS p1, {settings.INITIAL_CAPITAL} * n.lv / n.g AS eb,
    {settings.INITIAL_CAPITAL} * x.lv AS ea, n.pos AS pos0, x.pos AS pos1
  FROM curve x JOIN curve n ON n.run_id = x.run_id AND n.scenario = x.scenario
    AND n.symbol = x.symbol AND n.sigp = x.sigp AND n.held = 1
  WHERE x.held = {H + 1})"""

SCEN = """scen(scenario, f, e) AS (VALUES ('low', 0.001::DOUBLE, 0.00015::DOUBLE),
  ('base', 0.001, 0.0003), ('high', 0.001, 0.0007))"""
SCEN_BASE = "scen(scenario, f, e) AS (VALUES ('base', 0.001::DOUBLE, 0.0003::DOUBLE))"


def _evaluated(spark, sf, scenarios):
    bars = market(spark, sf)
    scores = labeled_scores(bars)
    curve, ledger = tr.evaluate(bars, scores, scenarios, horizon=H, chunk_rows=CHUNK)
    return scores, curve, ledger


@query("performance_windows", f"""
WITH RECURSIVE {sql_candles(price=PRICE)}, {LABELS_SQL}, {SCORES_SQL}, {selection_sql()}
SELECT run_id, symbol, sp AS start_pos, ep AS end_pos FROM win""")
def performance_windows(spark, sf):
    """Common performance window of each run."""
    m = market(spark, sf)
    lengths = m.groupBy("symbol").agg((F.max("pos") + 1).alias("n"))
    return tidy(tr.performance_windows(labeled_scores(m), lengths, ["run_id"], ["symbol"], H))


@query("non_overlapping_trades", f"""
WITH RECURSIVE {sql_candles(price=PRICE)}, {LABELS_SQL}, {SCORES_SQL}, {selection_sql()}
SELECT run_id, symbol, pos AS signal_pos FROM walk WHERE last = pos""")
def non_overlapping_trades(spark, sf):
    """Signals the greedy rule turns into trades."""
    m = market(spark, sf)
    scores = labeled_scores(m)
    lengths = m.groupBy("symbol").agg((F.max("pos") + 1).alias("n"))
    windows = tr.performance_windows(scores, lengths, ["run_id"], ["symbol"], H)
    return tr.taken_signals(scores, windows, ["run_id"], ["symbol"], H, 0.5)


@query("equity_curve", f"""
WITH RECURSIVE {sql_candles(price=PRICE)}, {LABELS_SQL}, {SCORES_SQL}, {selection_sql()}, {SCEN_BASE}, {CURVE_SQL}
SELECT run_id, scenario, symbol, pos, t AS timestamp, {r('10000 * lv', 2)} AS equity,
       coalesce(held <= {H}, false)::INT::BIGINT AS position_open, {r('expo::DOUBLE')} AS market_exposure,
       {r('ret')} AS period_return, {r('10000 * pk', 2)} AS peak, {r('lv / pk - 1')} AS drawdown
FROM curve""")
def equity_curve(spark, sf):
    """Equity marks, exposure, interval returns, peak and drawdown."""
    _, curve, _ = _evaluated(spark, sf, scenario_table(spark, BASE))
    return tidy(curve.select(
        "run_id", "scenario", "symbol", "pos", "timestamp", "equity", "position_open",
        "market_exposure", "period_return", "peak", "drawdown"))


@query("trade_ledger", f"""
WITH RECURSIVE {sql_candles(price=PRICE)}, {LABELS_SQL}, {SCORES_SQL}, {selection_sql()}, {SCEN}, {CURVE_SQL}
SELECT s.run_id, scenario, s.symbol, trade_id, t0 AS entry_timestamp, t1 AS exit_timestamp,
  {r('p0')} AS entry_market_price, {r('p0 * (1 + e)', 8)} AS entry_fill_price,
  {r('p1 * (1 - e)', 8)} AS exit_fill_price, {r('eb * (1 - f) / (p0 * (1 + e))')} AS position_quantity,
  {r('eb', 2)} AS equity_before_entry, {r('ea', 2)} AS equity_after_exit, {r('eb * f')} AS entry_fee,
  {r('eb * (1 - f) / (p0 * (1 + e)) * p1 * (1 - e) * f')} AS exit_fee,
  {r('eb * (1 - f) / (p0 * (1 + e)) * p0 * e')} AS entry_execution_cost,
  {r('eb * (1 - f) / (p0 * (1 + e)) * p1 * e')} AS exit_execution_cost,
  {r('p1 / p0 - 1')} AS gross_market_return, {r('ea / eb - 1')} AS net_return,
  {r('ea - eb', 2)} AS pnl, (ea > eb)::INT::BIGINT AS winning_trade, {H}::BIGINT AS holding_candles,
  s.t AS signal_timestamp, {r('s.p')} AS probability_score
FROM trades JOIN scores s ON s.run_id = trades.run_id AND s.symbol = trades.symbol AND s.pos = sigp""")
def trade_ledger(spark, sf):
    """Completed trades under three cost scenarios."""
    _, _, ledger = _evaluated(spark, sf, scenario_table(spark))
    return tidy(ledger.select(
        "run_id", "scenario", "symbol", "trade_id", "entry_timestamp", "exit_timestamp",
        "entry_market_price", "entry_fill_price", "exit_fill_price", "position_quantity",
        "equity_before_entry", "equity_after_exit", "entry_fee", "exit_fee",
        "entry_execution_cost", "exit_execution_cost", "gross_market_return", "net_return",
        "pnl", "winning_trade", "holding_candles", "signal_timestamp", "probability_score"))


@query("accounting_check", """
SELECT 'model'::VARCHAR AS run_id, 'base'::VARCHAR AS scenario, 'ALL'::VARCHAR AS symbol,
       0::BIGINT AS trade_id, ''::VARCHAR AS "check" WHERE false""")
def accounting_check(spark, sf):
    """Ledger, marks and final equity reconciled; empty means all identities hold."""
    _, curve, ledger = _evaluated(spark, sf, scenario_table(spark))
    curve, ledger = materialise(curve, "curve"), materialise(ledger, "ledger")
    return tr.accounting_violations(curve, ledger, ["run_id"], ["symbol"])


METRICS_SQL = f"""
streak AS (
  SELECT run_id, scenario, symbol, max(CASE WHEN lv < pk THEN pos - dry ELSE 0 END) AS dur,
         least(0, min(lv / pk - 1)) AS dd FROM (
    SELECT *, coalesce(max(CASE WHEN lv >= pk THEN pos END) OVER (
      PARTITION BY run_id, scenario, symbol ORDER BY pos), sp) AS dry FROM curve) GROUP BY 1, 2, 3),
em AS (
  SELECT run_id, scenario, symbol, count(ret) AS n, avg(ret) AS mu, stddev_samp(ret) AS sd,
    sqrt(avg(least(ret, 0) * least(ret, 0)) FILTER (WHERE ret IS NOT NULL)) AS ds, avg(expo) AS ex, avg(10000 * lv) AS ae,
    arg_max(lv, pos) - 1 AS tr FROM curve GROUP BY 1, 2, 3),
tm AS (
  SELECT run_id, scenario, symbol, count(*) AS nt, avg((ea > eb)::INT) AS wr, avg(ea / eb - 1) AS ar,
    quantile_cont(ea / eb - 1, 0.5) AS md, avg(ea / eb - 1) FILTER (WHERE ea > eb) AS aw,
    avg(ea / eb - 1) FILTER (WHERE ea < eb) AS al, max(ea / eb - 1) FILTER (WHERE ea > eb) AS bw,
    min(ea / eb - 1) FILTER (WHERE ea < eb) AS bl, sum(ea - eb) FILTER (WHERE ea > eb) AS up,
    sum(ea - eb) FILTER (WHERE ea < eb) AS dn,
    sum(eb * (1 - f) / (p0 * (1 + e)) * (p0 + p1)) AS tv,
    sum(eb * f + eb * (1 - f) / (p0 * (1 + e)) * (p1 * (1 - e) * f + (p0 + p1) * e)) AS co,
    avg(pos1 - pos0) AS hd FROM trades GROUP BY 1, 2, 3),
metrics AS (
  SELECT em.run_id, em.scenario, em.symbol, tr AS total_return,
    pow(1 + tr, {PPY} / n) - 1 AS annualized_return, sd * sqrt({PPY}) AS annualized_volatility,
    CASE WHEN sd > 0 THEN mu / sd * sqrt({PPY}) END AS sharpe_ratio,
    CASE WHEN ds > 0 THEN mu / ds * sqrt({PPY}) END AS sortino_ratio,
    dd AS maximum_drawdown, dur::BIGINT AS maximum_drawdown_duration,
    CASE WHEN dd < 0 THEN (pow(1 + tr, {PPY} / n) - 1) / abs(dd) END AS calmar_ratio,
    coalesce(nt, 0) AS num_trades, wr AS win_rate, ar AS average_trade_return,
    md AS median_trade_return, aw AS average_winning_return, al AS average_losing_return,
    bw AS largest_winning_trade, bl AS largest_losing_trade,
    CASE WHEN dn < 0 THEN coalesce(up, 0) / abs(dn) END AS profit_factor, ex AS market_exposure,
    coalesce(tv / ae, 0) AS turnover, hd AS average_holding_period,
    coalesce(co, 0) AS total_estimated_costs, n AS n_intervals
  FROM em JOIN streak USING (run_id, scenario, symbol) LEFT JOIN tm USING (run_id, scenario, symbol))"""

RATIOS = [
    "total_return", "annualized_return", "annualized_volatility", "sharpe_ratio", "sortino_ratio",
    "maximum_drawdown", "calmar_ratio", "win_rate", "average_trade_return",
    "average_winning_return", "average_losing_return", "largest_winning_trade",
    "largest_losing_trade", "profit_factor", "market_exposure", "turnover",
    "average_holding_period", "total_estimated_costs",
]
COUNTS = ["maximum_drawdown_duration", "num_trades", "n_intervals"]


def picked(columns):
    return ", ".join([*(f"{r(c, 2 if c in MONEY else 6)} AS {c}" for c in columns), *COUNTS])


CONTEXT_SQL = """
ctx AS (SELECT run_id, symbol, avg((p >= 0.5)::INT) AS pr, avg(p) AS ap, avg(label) AS lr
        FROM scores GROUP BY 1, 2)"""


@query("strategy_metrics", f"""
WITH RECURSIVE {sql_candles(price=PRICE)}, {LABELS_SQL}, {SCORES_SQL}, {selection_sql()}, {SCEN_BASE}, {CURVE_SQL},
{METRICS_SQL}, {CONTEXT_SQL}
SELECT m.run_id, scenario, m.symbol, {picked([*RATIOS, 'median_trade_return'])},
  {r('pr')} AS positive_prediction_rate, {r('ap')} AS average_buy_probability,
  {r('lr')} AS actual_positive_label_rate, 0::BIGINT AS warning_count
FROM metrics m JOIN ctx ON ctx.run_id = m.run_id AND ctx.symbol = m.symbol""")
def strategy_metrics(spark, sf):
    """The whole metric row of each series."""
    scores, curve, _ = _evaluated(spark, sf, scenario_table(spark, BASE))
    curve = materialise(curve, "curve")
    out = risk.strategy_metrics(curve, ["run_id"], ["symbol"], H, "1h", scores=scores)
    return tidy(out.withColumn("warning_count", F.size("warnings")).drop("warnings"))


@query("cost_sensitivity", f"""
WITH RECURSIVE {sql_candles(price=PRICE)}, {LABELS_SQL}, {SCORES_SQL}, {selection_sql()}, {SCEN}, {CURVE_SQL},
{METRICS_SQL}
SELECT run_id, scenario, symbol, {picked([*RATIOS, 'median_trade_return'])} FROM metrics""")
def cost_sensitivity(spark, sf):
    """One selection, three cost scenarios."""
    bars = market(spark, sf)
    out = bl.cost_sensitivity(bars, labeled_scores(bars), sensitivity_scenarios(spark), "1h",
                              chunk_rows=CHUNK)
    return tidy(out.select("run_id", "scenario", "symbol", *RATIOS, "median_trade_return", *COUNTS))


@query("buy_and_hold", f"""
WITH {sql_candles(price=PRICE)}, {LABELS_SQL}, {SCORES_SQL},
win AS (SELECT symbol, min(pos) + 1 AS sp, max(pos) FILTER (WHERE pos + {H + 1} < n) + {H + 1} AS ep
        FROM scores GROUP BY 1),
x AS (SELECT w.symbol, a.o AS p0, b.o AS p1, a.t AS t0, b.t AS t1, ep - sp AS h
      FROM win w JOIN candles a ON a.symbol = w.symbol AND a.pos = sp
      JOIN candles b ON b.symbol = w.symbol AND b.pos = ep)
SELECT 'buy_and_hold' AS run_id, 'base' AS scenario, symbol, t0 AS entry_timestamp,
  t1 AS exit_timestamp, {r('10000 * p1 / p0 * 0.9997 / 1.0003 * 0.999 * 0.999', 2)} AS equity_after_exit,
  h AS holding_candles, {r('p1 / p0 * 0.9997 / 1.0003 * 0.999 * 0.999 - 1')} AS net_return FROM x""")
def buy_and_hold(spark, sf):
    """The one-trade ledger of holding the whole window."""
    bars = market(spark, sf)
    _, ledger = bl.buy_and_hold(bars, labeled_scores(bars), scenario_table(spark, BASE))
    return tidy(ledger.select("run_id", "scenario", "symbol", "entry_timestamp",
                              "exit_timestamp", "equity_after_exit", "holding_candles",
                              "net_return"))


SUITE_SCORES_SQL = f"""
feat AS (SELECT l.*, e.ema_short, e.ema_long, e.return_24 FROM labeled l
         JOIN features e ON e.symbol = l.symbol AND e.pos = l.pos),
scores AS (
  SELECT 'model' AS run_id, symbol, pos, t, n, {sql_score()} AS p FROM feat
  UNION ALL SELECT 'cash', symbol, pos, t, n, 0.0 FROM feat
  UNION ALL SELECT 'ema_crossover', symbol, pos, t, n, (ema_short > ema_long)::INT::DOUBLE FROM feat
  UNION ALL SELECT 'momentum_24', symbol, pos, t, n, (return_24 > 0)::INT::DOUBLE FROM feat)"""


def suite_decisions(spark, sf):
    """Labeled feature rows with the model score (written once, read by every strategy)."""
    raw = market(spark, sf)
    feats = technical_features(raw, ["symbol"], positioned=True, chunk_rows=CHUNK)
    rows = next_open_labels(feats, ["symbol"], chunk_rows=CHUNK)
    return raw, materialise(rows.withColumn("probability_score", pseudo_score()).select(
        "symbol", "pos", "timestamp", "probability_score", "label", "ema_short", "ema_long",
        "return_24"), "decisions")


HELD_SQL = """
held0 AS (
  SELECT 'buy_and_hold' AS run_id, s.scenario, c.symbol, c.pos, w.sp, w.ep, s.f, s.e, a.o AS p0, c.o AS o,
    c.o / a.o * (1 - f) / (1 + e) * CASE WHEN c.pos = w.ep THEN (1 - e) * (1 - f) ELSE 1 END AS lv
  FROM win w JOIN candles c ON c.symbol = w.symbol AND c.pos BETWEEN w.sp AND w.ep
  JOIN candles a ON a.symbol = w.symbol AND a.pos = w.sp, scen s WHERE w.run_id = 'model'),
held AS (
  SELECT *, greatest(1, max(lv) OVER w) AS pk, CASE WHEN pos > sp THEN 1 END AS expo,
    CASE WHEN pos = sp + 1 THEN lv - 1 WHEN pos > sp THEN lv / lag(lv) OVER w - 1 END AS ret
  FROM held0 WINDOW w AS (PARTITION BY scenario, symbol ORDER BY pos)),
marks AS (
  SELECT run_id, scenario, symbol, pos, sp, lv, pk, ret, expo FROM curve
  UNION ALL SELECT run_id, scenario, symbol, pos, sp, lv, pk, ret, expo FROM held),
closed AS (
  SELECT run_id, scenario, symbol, f, e, eb, ea, p0, p1, pos0, pos1 FROM trades
  UNION ALL SELECT run_id, scenario, symbol, f, e, 10000, 10000 * lv, p0, o, sp, ep FROM held
  WHERE pos = ep)"""
SUITE_METRICS_SQL = METRICS_SQL.replace("FROM curve", "FROM marks").replace("FROM trades", "FROM closed")


@query("strategy_suite", f"""
WITH RECURSIVE {sql_candles(price=PRICE)}, {FEATURES_CTE}, {LABELS_SQL}, {SUITE_SCORES_SQL}, {selection_sql()},
{SCEN_BASE}, {CURVE_SQL}, {HELD_SQL}, {SUITE_METRICS_SQL}
SELECT run_id, scenario, symbol, {picked(RATIOS)} FROM metrics""")
def strategy_suite(spark, sf):
    """Model, cash, crossover, momentum and holding on one window."""
    raw, decisions = suite_decisions(spark, sf)
    out = bl.strategy_suite(raw, decisions, scenario_table(spark, BASE), "1h")
    return tidy(out.select("run_id", "scenario", "symbol", *RATIOS, *COUNTS))


@query("excess_returns", f"""
WITH RECURSIVE {sql_candles(price=PRICE)}, {FEATURES_CTE}, {LABELS_SQL}, {SUITE_SCORES_SQL}, {selection_sql()},
{SCEN_BASE}, {CURVE_SQL}, {METRICS_SQL},
bh AS (
  SELECT w.symbol, b.o / a.o * 0.9997 / 1.0003 * 0.999 * 0.999 - 1 AS h FROM win w
  JOIN candles a ON a.symbol = w.symbol AND a.pos = sp
  JOIN candles b ON b.symbol = w.symbol AND b.pos = ep WHERE run_id = 'model')
SELECT symbol, 'base' AS scenario, {r('total_return - h')} AS excess_return_vs_buy_and_hold,
       {r('total_return')} AS excess_return_vs_cash
FROM metrics JOIN bh USING (symbol) WHERE run_id = 'model'""")
def excess_returns(spark, sf):
    """Model return over holding and over cash."""
    raw, decisions = suite_decisions(spark, sf)
    suite = bl.strategy_suite(raw, decisions, scenario_table(spark, BASE), "1h")
    return tidy(bl.excess_returns(suite, ["symbol"]))


SIMS = settings.RANDOM_BASELINE_SIMULATIONS
# the greedy rule as a fold over each run's signals, for many runs
FOLDED_SELECTION_SQL = f"""
win AS (
  SELECT run_id, symbol, min(pos) + 1 AS sp, max(pos) FILTER (WHERE pos + {H + 1} < n) + {H + 1} AS ep
  FROM scores GROUP BY 1, 2),
sig AS (
  SELECT s.run_id, s.symbol, list(pos ORDER BY pos) AS ps FROM scores s JOIN win USING (run_id, symbol)
  WHERE p >= 0.5 AND pos + {H + 1} <= ep GROUP BY 1, 2),
taken AS (
  SELECT run_id, symbol, unnest(list_reduce(list_transform(ps, lambda x: [x]),
    lambda a, x: CASE WHEN x[1] > a[-1] + {H} THEN a || x ELSE a END)) AS pos FROM sig),
path AS (
  SELECT w.run_id, w.symbol, m.pos, m.t, m.o, w.sp, w.ep
  FROM win w JOIN candles m ON m.symbol = w.symbol AND m.pos BETWEEN w.sp - 1 AND w.ep),
walk AS (
  SELECT p.run_id, p.symbol, p.pos, coalesce(max(t.pos) OVER (
    PARTITION BY p.run_id, p.symbol ORDER BY p.pos), -1000) AS last
  FROM path p LEFT JOIN taken t ON t.run_id = p.run_id AND t.symbol = p.symbol AND t.pos = p.pos)"""
# DuckDB multiplies a window's rows in no fixed order, so equal levels may differ in the last bit
LEVEL_METRICS_SQL = METRICS_SQL.replace("lv < pk ", "lv < pk * (1 - 1e-12) ").replace(
    "lv >= pk ", "lv >= pk * (1 - 1e-12) ")
SIMULATED_SQL = f"""
ms AS (SELECT symbol, pos, t, n, {sql_score()} AS mp FROM labeled),
rate AS (SELECT symbol, avg((mp >= 0.5)::INT) AS q FROM ms GROUP BY 1),
scores AS (
  SELECT (g.i)::BIGINT AS run_id, ms.symbol, pos, t, n,
    CASE WHEN ('0x' || substr(md5((g.i + 42) || '|' || ms.symbol || '|' || pos), 1, 13))::BIGINT
         / 4503599627370496.0 < q THEN 1.0 ELSE 0.0 END AS p
  FROM ms JOIN rate USING (symbol), (SELECT unnest(range({SIMS})) AS i) g
  UNION ALL SELECT -1, symbol, pos, t, n, mp FROM ms),
{FOLDED_SELECTION_SQL}, {SCEN_BASE}, {CURVE_SQL}, {LEVEL_METRICS_SQL}"""


@query("random_exposure", f"""
WITH {sql_candles(price=PRICE)}, {LABELS_SQL}, {SIMULATED_SQL}
SELECT run_id, scenario, symbol, {picked(RATIOS)} FROM metrics WHERE run_id >= 0""")
def random_exposure(spark, sf):
    """Bernoulli score sets at the model's signal rate: 1 000 runs of every series in one job."""
    bars = market(spark, sf)
    out = simulate(bars, labeled_scores(bars), scenario_table(spark, BASE), simulations=SIMS,
                   chunk_rows=CHUNK)
    return tidy(out.select("run_id", "scenario", "symbol", *RATIOS, *COUNTS))


def _summary_sql() -> str:
    cells = ", ".join(
        f"{r(f'quantile_cont({c}, {q})', 4)} AS {c}_{name}"
        for c in ("total_return", "sharpe_ratio", "maximum_drawdown")
        for q, name in ((0.5, "median"), (0.05, "p05"), (0.95, "p95")))
    return f"""
SELECT s.symbol, count(*) AS simulations, {r('any_value(q)')} AS signal_probability,
       {r('avg((s.total_return >= m.tr)::INT)')} AS fraction_return_at_least_model, {cells}
FROM metrics s JOIN rate USING (symbol)
JOIN (SELECT symbol, total_return AS tr FROM metrics WHERE run_id = -1) m USING (symbol)
WHERE run_id >= 0 GROUP BY 1"""


@query("random_exposure_summary", f"""
WITH {sql_candles(price=PRICE)}, {LABELS_SQL}, {SIMULATED_SQL} {_summary_sql()}""")
def random_exposure_summary(spark, sf):
    """Quantiles over 1 000 simulations against the model."""
    m = market(spark, sf)
    scores = labeled_scores(m)
    base = scenario_table(spark, BASE)
    sims = simulate(m, scores, base, chunk_rows=CHUNK)
    curve, _ = tr.evaluate(m, scores, base, chunk_rows=CHUNK)
    model = risk.strategy_metrics(curve, ["run_id"], ["symbol"], H, "1h", median=False)
    out = bl.random_exposure_summary(sims, model)
    whole = [c for c in out.columns if c.split("_")[-1] in ("median", "p05", "p95")]
    return tidy(out.withColumns({c: F.round(c, 4) for c in whole}))


@query("drawdown_table", """
WITH d AS (
  SELECT o_orderstatus AS k, epoch_us(o_orderdate) // 86400000000 AS d, sum(o_totalprice) AS e
  FROM orders GROUP BY 1, 2),
x AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY d) - 1 AS pos,
             greatest(10000, max(e) OVER (PARTITION BY k ORDER BY d)) AS peak FROM d)
SELECT k, pos, round(e, 2) + 0.0 AS equity, round(peak, 2) + 0.0 AS peak,
       round(e / peak - 1, 6) + 0.0 AS drawdown,
       round(CASE WHEN pos = 1 THEN e / 10000 - 1
                  WHEN pos > 1 THEN e / lag(e) OVER (PARTITION BY k ORDER BY pos) - 1 END, 6) + 0.0
       AS period_return FROM x""")
def drawdown_table(spark, sf):
    """Peak, drawdown and interval returns of any mark table (daily order totals)."""
    from chronoweft.plans.common import table

    daily = table(spark, sf, "orders").groupBy(
        F.col("o_orderstatus").alias("k"), F.col("o_orderdate").alias("timestamp")
    ).agg(F.sum("o_totalprice").alias("equity"))
    rows = number_rows(daily, ["k"])
    out = risk.interval_returns(risk.drawdowns(rows, ["k"], chunk_rows=CHUNK), ["k"],
                                chunk_rows=CHUNK)
    return out.select("k", "pos", F.round("equity", 2).alias("equity"),
                      F.round("peak", 2).alias("peak"), F.round("drawdown", 6).alias("drawdown"),
                      F.round("period_return", 6).alias("period_return"))


@query("underwater_summary", """
WITH d AS (
  SELECT o_orderstatus AS k, epoch_us(o_orderdate) // 86400000000 AS d, sum(o_totalprice) AS e
  FROM orders GROUP BY 1, 2),
x AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY d) - 1 AS pos,
             greatest(10000, max(e) OVER (PARTITION BY k ORDER BY d)) AS peak FROM d),
y AS (SELECT *, coalesce(max(CASE WHEN e >= peak THEN pos END) OVER (PARTITION BY k ORDER BY pos), 0)
             AS dry FROM x)
SELECT k, round(least(0, min(e / peak - 1)), 6) + 0.0 AS maximum_drawdown,
       max(CASE WHEN e < peak THEN pos - dry ELSE 0 END)::BIGINT AS maximum_drawdown_duration
FROM y GROUP BY 1""")
def underwater_summary(spark, sf):
    """Deepest drawdown and longest streak below the peak."""
    from chronoweft.plans.common import table

    daily = table(spark, sf, "orders").groupBy(
        F.col("o_orderstatus").alias("k"), F.col("o_orderdate").alias("timestamp")
    ).agg(F.sum("o_totalprice").alias("equity"))
    rows = risk.drawdowns(number_rows(daily, ["k"]), ["k"], chunk_rows=CHUNK)
    return tidy(risk.drawdown_summary(rows, ["k"], F.lit(0).cast("long")))


@query("holdout_evaluation", None)
def holdout_evaluation(spark, sf):
    """The whole holdout report on minute bars of all events.

    One model score set, four baselines, three cost scenarios and 1 000 random simulations over the
    newest fifth of the series; every part is one metric row per run.
    """
    from chronoweft.operators.splits import assign_partitions

    minute = hourly(spark, sf, "1m", level=LEVEL).filter(F.col("symbol") == "ALL")
    raw = materialise(number_rows(minute, ["symbol"]), "bars")
    rows = next_open_labels(
        technical_features(raw, ["symbol"], positioned=True), ["symbol"])
    split = assign_partitions(rows.withColumn("market_pos", F.col("pos")), ["symbol"])
    decisions = materialise(split.filter(F.col("partition") == "holdout").select(
        "symbol", F.col("market_pos").alias("pos"), "timestamp",
        pseudo_score().alias("probability_score"), "label", "ema_short", "ema_long",
        "return_24"), "holdout")
    base = scenario_table(spark, BASE)
    columns = ["run_id", "scenario", "symbol", *RATIOS, *COUNTS]
    suite = bl.strategy_suite(raw, decisions, base, "1m",
                              model_scenarios=sensitivity_scenarios(spark)).select(*columns)
    sims = simulate(raw, decisions, base, timeframe="1m", chunk_rows=1024)
    priced = F.when(F.col("run_id") != "model", F.array(F.lit("strategy"))).when(
        F.col("scenario") == "base", F.array(F.lit("strategy"), F.lit("cost_sensitivity"))
    ).otherwise(F.array(F.lit("cost_sensitivity")))
    return tidy(suite.select(F.explode(priced).alias("part"), *columns).unionByName(
        sims.withColumn("run_id", F.concat(F.lit("random-"), F.col("run_id")))
        .select(F.lit("random").alias("part"), *columns)))
