"""Fixed-horizon long-or-cash evaluation of score sets.

Nothing is stepped through row by row. The selection (which signals trade) does not depend on price
or cost. Given it, every mark knows from a bounded look-back whether the position is being entered,
held, left or flat, so the growth of equity over each interval is a local expression. Only equity,
its peak and the trade number are running values; they are scanned per chunk and carried over by one
small row per chunk. All runs and cost scenarios go through the same plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweft import settings
from chronoweft.functions.costs import round_trip_growth
from chronoweft.operators.positions import CHUNK, OWN, spread_to_chunks
from chronoweft.operators.selection import select_non_overlapping

MARK_CHUNK_ROWS = 16_384


def performance_windows(scores: DataFrame, lengths: DataFrame, run_keys: Sequence[str],
                        keys: Sequence[str], horizon: int) -> DataFrame:
    """Common window of each run: ``[first decision + 1, last executable decision + horizon + 1]``.

    ``lengths`` holds ``(keys…, n)``. Runs without an executable decision have a null ``end_pos``.
    """
    p = F.col("pos")
    executable = F.when(p + horizon + 1 < F.col("n"), p)
    return (
        scores.select(*run_keys, *keys, "pos").join(lengths, list(keys))
        .groupBy(*run_keys, *keys)
        .agg((F.min("pos") + 1).alias("start_pos"),
             (F.max(executable) + horizon + 1).alias("end_pos"))
    )


def taken_signals(scores: DataFrame, windows: DataFrame, run_keys: Sequence[str],
                  keys: Sequence[str], horizon: int, threshold: float, **chunking) -> DataFrame:
    """Signals that become trades: ``(run…, keys…, signal_pos)``."""
    ids = [*run_keys, *keys]
    eligible = (
        scores.filter(F.col("probability_score") >= threshold).select(*ids, "pos")
        .join(windows.select(*ids, "end_pos"), ids)
        .filter(F.col("pos") + horizon + 1 <= F.col("end_pos")).drop("end_pos")
    )
    return select_non_overlapping(eligible, ids, horizon, **chunking).withColumnRenamed(
        "pos", "signal_pos"
    )


def marks(market: DataFrame, windows: DataFrame, taken: DataFrame, run_keys: Sequence[str],
          keys: Sequence[str], horizon: int, *, chunk_rows: int = MARK_CHUNK_ROWS) -> DataFrame:
    """Market rows of every run's window with the role of each row.

    ``held`` counts rows since the signal (1 = entry mark, horizon + 1 = exit mark) and is null when
    flat; held rows also know the open and time of their entry. Market rows and taken signals are
    unioned and shuffled once by run and chunk; there is no range join.
    """
    ids = [*run_keys, *keys]
    span = F.sequence(
        F.floor(F.col("start_pos") / chunk_rows).cast("long"),
        F.floor(F.col("end_pos") / chunk_rows).cast("long"),
    )
    by_chunk = windows.filter("end_pos is not null").withColumn(CHUNK, F.explode(span))
    rows = spread_to_chunks(
        market.select(*keys, "pos", "timestamp", "open"), chunk_rows, before=horizon
    )
    priced = (
        rows.join(by_chunk, [*keys, CHUNK])
        .filter((F.col("pos") >= F.col("start_pos")) & (F.col("pos") <= F.col("end_pos")))
        .select(*ids, CHUNK, OWN, "pos", "start_pos", "end_pos", "timestamp", "open",
                F.lit(0).alias("_kind"), F.lit(None).cast("long").alias("_signal"))
    )
    reach = F.array_compact(F.array(
        F.floor((F.col("signal_pos") + 1) / chunk_rows).cast("long"),
        F.when(
            F.floor((F.col("signal_pos") + horizon + 1) / chunk_rows)
            != F.floor((F.col("signal_pos") + 1) / chunk_rows),
            F.floor((F.col("signal_pos") + horizon + 1) / chunk_rows).cast("long"),
        ),
    ))
    none = F.lit(None)
    opened = taken.withColumn(CHUNK, F.explode(reach)).select(
        *ids, CHUNK, F.lit(False).alias(OWN), F.col("signal_pos").alias("pos"),
        none.cast("long").alias("start_pos"), none.cast("long").alias("end_pos"),
        none.cast("timestamp").alias("timestamp"), none.cast("double").alias("open"),
        F.lit(1).alias("_kind"), F.col("signal_pos").alias("_signal"),
    )
    w = Window.partitionBy(*ids, CHUNK).orderBy("pos", "_kind")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    out = (
        priced.unionByName(opened)
        .withColumn("_last", F.last("_signal", ignorenulls=True).over(before))
        .withColumn("prev_open", F.last("open", ignorenulls=True).over(before))
        .filter(F.col("_kind") == 0)
        .withColumn("_since", F.col("pos") - F.col("_last"))
        .withColumn("held", F.when(F.col("_since") <= horizon + 1, F.col("_since").cast("int")))
    )
    upto = Window.partitionBy(*ids, CHUNK).orderBy("pos", "_kind").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    opening = F.when(F.col("held") == 1, F.struct("open", "timestamp"))
    return (
        out.withColumn("_entry", F.last(opening, ignorenulls=True).over(upto))
        .filter(OWN)
        .withColumns({
            "signal_pos": F.when(F.col("held").isNotNull(), F.col("_last")),
            "entry_open": F.when(F.col("held").isNotNull(), F.col("_entry.open")),
            "entry_timestamp": F.when(F.col("held").isNotNull(), F.col("_entry.timestamp")),
        })
        .drop("_since", "_last", "_signal", "_kind", "_entry", OWN)
    )


def equity_curve(marked: DataFrame, scenarios: DataFrame, run_keys: Sequence[str],
                 keys: Sequence[str], horizon: int, *,
                 capital: float = settings.INITIAL_CAPITAL) -> DataFrame:
    """One mark per open: equity, interval return, exposure, peak, drawdown, trade number.

    ``scenarios`` is a handful of cost rows. Costs at a mark belong to the interval that ends
    there; costs at the first mark are folded into the first interval.
    """
    ids = [*run_keys, "scenario", *keys]
    exit_row = F.col("held") == horizon + 1
    entry_row = F.col("held") == 1
    inside = F.col("held") > 1
    e, f = F.col("execution_rate"), F.col("fee_rate")
    move = F.col("open") / F.col("prev_open")
    growth = (
        F.when(entry_row, (F.lit(1.0) - f) / (F.lit(1.0) + e))
        .when(exit_row, move * (F.lit(1.0) - e) * (F.lit(1.0) - f))
        .when(inside, move).otherwise(F.lit(1.0))
    )
    rows = marked.crossJoin(F.broadcast(scenarios)).withColumn("_g", growth)
    w = Window.partitionBy(*ids, CHUNK).orderBy("pos").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    local = rows.withColumns({
        "_p": F.product("_g").over(w),
        "_k": F.count_if(entry_row).over(w),
    }).withColumn("_m", F.max("_p").over(w))
    summary = local.groupBy(*ids, CHUNK).agg(
        F.max_by("_p", "pos").alias("_sp"), F.max("_p").alias("_sm"), F.max("_k").alias("_sk")
    )
    prior = Window.partitionBy(*ids).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    one = F.lit(1.0)
    carried = summary.withColumns({
        "_cp": F.coalesce(F.product("_sp").over(prior), one),
        "_ck": F.coalesce(F.sum("_sk").over(prior), F.lit(0)),
    })
    carried = carried.withColumn(
        "_cm", F.greatest(one, F.coalesce(F.max(F.col("_cp") * F.col("_sm")).over(prior), one))
    ).select(*ids, CHUNK, "_cp", "_ck", "_cm")
    level = F.col("_cp") * F.col("_p")
    out = local.join(carried, [*ids, CHUNK]).withColumns({
        "_level": level,
        "_peak": F.greatest(F.col("_cm"), F.col("_cp") * F.col("_m")),
    })
    first = F.col("pos") == F.col("start_pos")
    second = F.col("pos") == F.col("start_pos") + 1
    return out.select(
        *ids, CHUNK, "pos", "timestamp", "open", "start_pos", "end_pos", "held", "signal_pos",
        "entry_open", "entry_timestamp", "fee_rate", "execution_rate",
        (F.col("_level") * capital).alias("equity"),
        F.coalesce(F.col("held") <= horizon, F.lit(False)).alias("position_open"),
        F.when(~first, F.coalesce(inside, F.lit(False)).cast("double")).alias("market_exposure"),
        F.when(second, F.col("_level") - 1.0).when(~first, F.col("_g") - 1.0)
        .alias("period_return"),
        (F.col("_peak") * capital).alias("peak"),
        (F.col("_level") / F.col("_peak") - 1.0).alias("drawdown"),
        (F.col("_ck") + F.col("_k")).alias("trade_number"),
    )


def trade_ledger(curve: DataFrame, run_keys: Sequence[str], keys: Sequence[str], horizon: int,
                 decisions: DataFrame | None = None) -> DataFrame:
    """One row per completed trade with fills, fees, costs and returns.

    An exit mark already knows its entry, so the ledger is a filter over the curve.
    ``decisions`` supplies ``(run…, keys…, pos, signal_timestamp, probability_score)``.
    """
    ids = [*run_keys, "scenario", *keys]
    e, f = F.col("execution_rate"), F.col("fee_rate")
    growth = (
        F.col("open") / F.col("entry_open") * round_trip_growth(f, e)
    )
    out = trade_columns(
        curve.filter(F.col("held") == horizon + 1).select(
            *ids, "signal_pos", (F.col("signal_pos") + 1).alias("entry_position"),
            F.col("pos").alias("exit_position"), F.col("trade_number").alias("trade_id"),
            "entry_timestamp", F.col("timestamp").alias("exit_timestamp"),
            F.col("entry_open").alias("entry_market_price"),
            F.col("open").alias("exit_market_price"),
            (F.col("equity") / growth).alias("equity_before_entry"), "fee_rate",
            "execution_rate", F.lit(horizon).cast("long").alias("holding_candles"),
        )
    )
    if decisions is not None:
        lookup = decisions.select(
            *run_keys, *keys, F.col("pos").alias("signal_pos"), "signal_timestamp",
            "probability_score",
        )
        out = out.join(lookup, [*run_keys, *keys, "signal_pos"], "left")
    return out


def trade_columns(t: DataFrame) -> DataFrame:
    """Cash-flow columns of a trade from its prices, opening equity and cost rates."""
    e, f = F.col("execution_rate"), F.col("fee_rate")
    one = F.lit(1.0)
    step1 = t.withColumns({
        "entry_fill_price": F.col("entry_market_price") * (one + e),
        "exit_fill_price": F.col("exit_market_price") * (one - e),
        "entry_fee": F.col("equity_before_entry") * f,
        "position_quantity": F.col("equity_before_entry") * (one - f)
        / (F.col("entry_market_price") * (one + e)),
    })
    q = F.col("position_quantity")
    step2 = step1.withColumns({
        "entry_execution_cost": q * (F.col("entry_fill_price") - F.col("entry_market_price")),
        "exit_execution_cost": q * (F.col("exit_market_price") - F.col("exit_fill_price")),
        "exit_fee": q * F.col("exit_fill_price") * f,
        "equity_after_exit": q * F.col("exit_fill_price") * (one - f),
        "gross_market_return": F.col("exit_market_price") / F.col("entry_market_price") - 1.0,
        "filled_gross_return": F.col("exit_fill_price") / F.col("entry_fill_price") - 1.0,
        "total_fee_rate": one - (one - f) * (one - f),
        "total_execution_cost_rate": one - (one - e) / (one + e),
    })
    return step2.withColumns({
        "net_return": F.col("equity_after_exit") / F.col("equity_before_entry") - 1.0,
        "pnl": F.col("equity_after_exit") - F.col("equity_before_entry"),
        "winning_trade": F.col("equity_after_exit") > F.col("equity_before_entry"),
    })


def evaluate(market: DataFrame, scores: DataFrame, scenarios: DataFrame, *,
             run_keys: Sequence[str] = ("run_id",), keys: Sequence[str] = ("symbol",),
             horizon: int = settings.PREDICTION_HORIZON,
             threshold: float = settings.SIGNAL_THRESHOLD,
             capital: float = settings.INITIAL_CAPITAL,
             lengths: DataFrame | None = None, chunk_rows: int = MARK_CHUNK_ROWS,
             **chunking) -> tuple[DataFrame, DataFrame]:
    """Equity curve and ledger of every run under every cost scenario.

    ``market`` needs ``pos``, ``timestamp``, ``open``; ``scores`` needs ``pos`` and
    ``probability_score``. Runs and scenarios are rows, not loops.
    """
    if lengths is None:
        lengths = market.groupBy(*keys).agg((F.max("pos") + 1).alias("n"))
    windows = performance_windows(scores, lengths, run_keys, keys, horizon)
    taken = taken_signals(scores, windows, run_keys, keys, horizon, threshold, **chunking)
    marked = marks(market, windows, taken, run_keys, keys, horizon, chunk_rows=chunk_rows)
    curve = equity_curve(marked, scenarios, run_keys, keys, horizon, capital=capital)
    decisions = (
        scores.select(*run_keys, *keys, "pos", F.col("timestamp").alias("signal_timestamp"),
                      "probability_score")
        if "timestamp" in scores.columns else None
    )
    return curve, trade_ledger(curve, run_keys, keys, horizon, decisions)


def held_window_curve(market: DataFrame, windows: DataFrame, scenarios: DataFrame,
                      run_keys: Sequence[str], keys: Sequence[str], horizon: int, *,
                      capital: float = settings.INITIAL_CAPITAL,
                      chunk_rows: int = MARK_CHUNK_ROWS) -> tuple[DataFrame, DataFrame]:
    """Buy at the first open of the window, sell at the last: curve and one-row ledger.

    Equity is a closed form of the entry open, so only the peak is a running value.
    """
    ids = [*run_keys, "scenario", *keys]
    span = F.sequence(
        F.floor(F.col("start_pos") / chunk_rows).cast("long"),
        F.floor(F.col("end_pos") / chunk_rows).cast("long"),
    )
    by_chunk = windows.filter("end_pos is not null").withColumn(CHUNK, F.explode(span))
    rows = (
        spread_to_chunks(market.select(*keys, "pos", "timestamp", "open"), chunk_rows)
        .drop(OWN).join(by_chunk, [*keys, CHUNK])
        .filter((F.col("pos") >= F.col("start_pos")) & (F.col("pos") <= F.col("end_pos")))
    )
    first = F.col("pos") == F.col("start_pos")
    last = F.col("pos") == F.col("end_pos")
    ends = rows.filter(first | last).groupBy(*run_keys, *keys).agg(
        F.max(F.when(first, F.col("open"))).alias("entry_market_price"),
        F.max(F.when(last, F.col("open"))).alias("exit_market_price"),
        F.max(F.when(first, F.col("timestamp"))).alias("entry_timestamp"),
        F.max(F.when(last, F.col("timestamp"))).alias("exit_timestamp"),
        F.max("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"),
    )
    e, f = F.col("execution_rate"), F.col("fee_rate")
    one = F.lit(1.0)
    invested = (one - f) / (one + e)
    level = (
        F.when(last, F.col("open") / F.col("entry_market_price") * invested * (one - e) * (one - f))
        .otherwise(F.col("open") / F.col("entry_market_price") * invested)
    )
    marked = (
        rows.join(ends.select(*run_keys, *keys, "entry_market_price", "entry_timestamp"),
                  [*run_keys, *keys])
        .crossJoin(F.broadcast(scenarios)).withColumn("_level", level)
    )
    w = Window.partitionBy(*ids, CHUNK).orderBy("pos")
    local = marked.withColumns({
        "_m": F.max("_level").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
    })
    prior = Window.partitionBy(*ids).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    tops = local.groupBy(*ids, CHUNK).agg(
        F.max("_level").alias("_sm"), F.max_by("_level", "pos").alias("_sl")
    ).select(*ids, CHUNK,
             F.greatest(one, F.coalesce(F.max("_sm").over(prior), one)).alias("_cm"),
             F.last("_sl").over(prior).alias("_cl"))
    out = local.join(tops, [*ids, CHUNK]).withColumns({
        "_peak": F.greatest(F.col("_cm"), F.col("_m")),
        "_before": F.coalesce(F.lag("_level", 1).over(w), F.col("_cl")),
    })
    second = F.col("pos") == F.col("start_pos") + 1
    curve = out.select(
        *ids, CHUNK, "pos", "timestamp", "open", "start_pos", "end_pos",
        F.when(first, 1).when(last, horizon + 1).otherwise(2).alias("held"),
        (F.col("start_pos") - 1).alias("signal_pos"),
        F.col("entry_market_price").alias("entry_open"),
        "entry_timestamp", "fee_rate", "execution_rate",
        (F.col("_level") * capital).alias("equity"),
        (F.col("pos") < F.col("end_pos")).alias("position_open"),
        F.when(~first, 1.0).alias("market_exposure"),
        F.when(second, F.col("_level") - 1.0)
        .when(~first, F.col("_level") / F.col("_before") - 1.0).alias("period_return"),
        (F.col("_peak") * capital).alias("peak"),
        (F.col("_level") / F.col("_peak") - 1.0).alias("drawdown"),
        F.lit(1).cast("long").alias("trade_number"),
    )
    ledger = trade_columns(
        ends.crossJoin(F.broadcast(scenarios)).withColumns({
            "equity_before_entry": F.lit(capital), "trade_id": F.lit(1).cast("long"),
        })
    ).withColumns({
        "signal_pos": F.col("start_pos") - 1, "entry_position": F.col("start_pos"),
        "exit_position": F.col("end_pos"),
        "holding_candles": F.col("end_pos") - F.col("start_pos"),
    }).drop("end_pos", "start_pos")
    return curve, ledger


def accounting_violations(curve: DataFrame, ledger: DataFrame, run_keys: Sequence[str],
                          keys: Sequence[str], *, capital: float = settings.INITIAL_CAPITAL,
                          rtol: float = 1e-10, atol: float = 1e-8) -> DataFrame:
    """Ledger, marks and final equity must tell the same story; every disagreement is a row."""
    from chronoweft.operators.quality import close_to

    ids = [*run_keys, "scenario", *keys]
    c = F.col
    at = curve.select(*ids, "pos", c("equity").alias("_mark"))
    q, f = c("position_quantity"), c("fee_rate")
    entry = at.select(*ids, c("pos").alias("entry_position"), c("_mark").alias("_entry_mark"))
    leave = at.select(*ids, c("pos").alias("exit_position"), c("_mark").alias("_exit_mark"))
    joined = ledger.join(entry, [*ids, "entry_position"], "left").join(
        leave, [*ids, "exit_position"], "left"
    )
    pairs = {
        "entry_fee": (c("entry_fee"), c("equity_before_entry") * f),
        "entry_execution_cost": (
            c("entry_execution_cost"), q * (c("entry_fill_price") - c("entry_market_price"))),
        "exit_fee": (c("exit_fee"), q * c("exit_fill_price") * f),
        "exit_execution_cost": (
            c("exit_execution_cost"), q * (c("exit_market_price") - c("exit_fill_price"))),
        "equity_after_exit": (
            c("equity_after_exit"), q * c("exit_fill_price") - c("exit_fee")),
        "entry_mark": (c("_entry_mark"), q * c("entry_market_price")),
        "exit_mark": (c("_exit_mark"), c("equity_after_exit")),
        "pnl": (c("pnl"), c("equity_after_exit") - c("equity_before_entry")),
        "net_return": (c("net_return"), c("equity_after_exit") / c("equity_before_entry") - 1.0),
    }
    per_trade = joined.select(
        *ids, c("trade_id").cast("long").alias("trade_id"),
        F.explode(F.array_compact(F.array(*[
            F.when(~close_to(a, b, rtol, atol), F.lit(name)) for name, (a, b) in pairs.items()
        ]))).alias("check"),
    )
    # trade chain: the i-th trade starts with what the (i−1)-th left, found by an equi join
    chain = ledger.select(*ids, (c("trade_id") + 1).alias("trade_id"),
                          c("equity_after_exit").alias("_before"))
    chained = ledger.join(chain, [*ids, "trade_id"], "left").filter(
        ~close_to(c("equity_before_entry"),
                  F.when(c("trade_id") == 1, F.lit(capital)).otherwise(c("_before")), rtol, atol)
    ).select(*ids, c("trade_id").cast("long").alias("trade_id"),
             F.lit("trade_chain").alias("check"))
    totals = curve.groupBy(*ids).agg(
        F.max_by("equity", "pos").alias("_final"),
        F.exp(F.sum(F.log1p("period_return"))).alias("_compound"),
    ).join(ledger.groupBy(*ids).agg(
        F.count(F.lit(1)).alias("_trades"), F.max("trade_id").alias("_top"),
        F.exp(F.sum(F.log1p("net_return"))).alias("_trade_compound"), F.sum("pnl").alias("_pnl"),
    ), ids, "left")
    zero = F.lit(0.0)
    whole = totals.select(
        *ids, F.lit(None).cast("long").alias("trade_id"),
        F.explode(F.array_compact(F.array(
            F.when(~close_to(c("_final"), c("_compound") * capital, rtol, atol), "intervals"),
            F.when(~close_to(c("_final"),
                             F.coalesce(c("_trade_compound"), F.lit(1.0)) * capital, rtol, atol),
                   "trades"),
            F.when(~close_to(F.coalesce(c("_pnl"), zero), c("_final") - capital, rtol, atol),
                   "pnl_sum"),
            F.when(c("_trades") != c("_top"), "trade_ids"),
        ))).alias("check"),
    )
    return per_trade.unionByName(chained).unionByName(whole)
