"""Many random score sets over one market, as prefix products over trade cards.

A trade's card - its growth, the levels of its marks, sums of its returns - depends on where it is opened
and on costs, not on the run. So the market is cut into chunks of positions once, every chunk knows the
cards of its positions, and all runs walk a chunk together as columns of arrays. What a run carries into a
chunk is how many candles it is still in the market, its level and its peak. The first two passes of a
chunk are maps of that state which compose; one small row per chunk is folded, nothing is copied per run.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoweft import settings
from chronoweft.operators.positions import CHUNK, OWN, spread_to_chunks
from chronoweft.operators.risk import metric_columns
from chronoweft.operators.trades import performance_windows
from chronoweft.session import materialise

CARD_CHUNK_ROWS = 2048
SUMS = ("s1", "s2", "down", "expo", "esum", "rsum", "wsum", "lsum", "up", "dn", "turn", "cost")
COUNTS = ("trades", "wins", "loss")
WALKED = ("run_id bigint, dd double, level double, best double, worst double, longest bigint, "
          "first_peak bigint, last_peak bigint, "
          + ", ".join(f"{c} double" for c in SUMS) + ", " + ", ".join(f"{c} bigint" for c in COUNTS))


class Cards:
    """Cards of the positions of one chunk; a position opens at the next mark and closes H marks later."""

    def __init__(self, rows: pd.DataFrame, horizon: int, fee: float, execution: float):
        rows = rows.sort_values("pos", ignore_index=True)
        self.start, self.end = int(rows["start_pos"].iloc[0]), int(rows["end_pos"].iloc[0])
        own = rows[OWN] & (rows["pos"] >= self.start - 1) & (rows["pos"] < self.end)
        at = np.flatnonzero(own.to_numpy())
        self.pos = rows["pos"].to_numpy(np.int64)[at]
        opens = rows["open"].to_numpy(np.float64)
        decided = rows["decided"].to_numpy(bool)[at]
        self.can = decided & (self.pos + horizon + 1 <= self.end)
        # marks of a trade: the open after the decision, and the next H
        place = np.minimum(at[:, None] + 1 + np.arange(horizon + 1), len(opens) - 1)
        price = opens[place] if len(at) else np.empty((0, horizon + 1))
        enter, leave = (1 - fee) / (1 + execution), (1 - execution) * (1 - fee)
        level = enter * price / price[:, :1]
        level[:, -1] *= leave
        self.step = np.concatenate([np.full((len(at), 1), enter), price[:, 1:] / price[:, :-1]], axis=1)
        self.step[:, -1] *= leave
        self.growth = level[:, -1]
        self.high = level.max(axis=1, initial=0.0)
        ret = self.step - 1
        first = self.pos == self.start - 1  # costs of the first mark belong to the first interval
        ret[first, 1] = level[first, 1] - 1
        ret[first, 0] = 0.0
        units = (1 - fee) / (price[:, 0] * (1 + execution))
        volume = units * (price[:, 0] + price[:, -1])
        gain = self.growth - 1
        self.sums = {
            "s1": ret.sum(axis=1), "s2": (ret * ret).sum(axis=1),
            "down": (np.minimum(ret, 0) ** 2).sum(axis=1), "expo": np.full(len(at), float(horizon)),
            "rsum": gain, "wsum": np.maximum(gain, 0), "lsum": np.minimum(gain, 0)}
        self.scaled = {
            "esum": level.sum(axis=1), "up": np.maximum(gain, 0), "dn": np.minimum(gain, 0), "turn": volume,
            "cost": fee + units * price[:, -1] * leave / (1 - fee) * fee + volume * execution}
        self.gain = gain


def draws(name: str, pos: np.ndarray, rate: float, seed: int, runs: int) -> np.ndarray:
    """(positions, runs): whether a run signals. A draw is a hash of seed + run, series and position."""
    heads = [hashlib.md5(f"{seed + r}|{name}|".encode()) for r in range(runs)]
    out = np.empty((len(pos), runs), bool)
    for i, p in enumerate(pos.tolist()):
        tail, raw = str(p).encode(), []
        for head in heads:
            h = head.copy()
            h.update(tail)
            raw.append(h.digest()[:8])
        bits = np.frombuffer(b"".join(raw), ">u8").astype(np.uint64) >> np.uint64(12)
        out[i] = bits.astype(np.float64) / 2.0 ** 52 < rate
    return out


def _map(cards: Cards, drawn: np.ndarray, horizon: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What every state carried in (0..H candles still held) becomes: state, growth, highest level."""
    runs = drawn.shape[1]
    state = np.repeat(np.arange(horizon + 1)[:, None], runs, axis=1)
    growth, high = np.ones(state.shape), np.ones(state.shape)
    for i in range(len(cards.pos)):
        take = (state == 0) & drawn[i]
        state = np.maximum(state - 1, 0)
        if take.any():
            high[take] = np.maximum(high[take], growth[take] * cards.high[i])
            growth[take] *= cards.growth[i]
            state[take] = horizon
    return state.astype(np.uint8), growth, high


def _walk(cards: Cards, drawn: np.ndarray, horizon: int, state: np.ndarray, level: np.ndarray,
          peak: np.ndarray) -> dict[str, np.ndarray]:
    """Sums of one chunk for every run, with its state, level and peak known."""
    runs = drawn.shape[1]
    out = {c: np.zeros(runs) for c in SUMS} | {c: np.zeros(runs, np.int64) for c in COUNTS}
    dd, best, worst = np.zeros(runs), np.full(runs, -np.inf), np.full(runs, np.inf)
    first, last = np.full(runs, -1), np.full(runs, -1)
    longest = np.zeros(runs, np.int64)

    def mark(who: np.ndarray, at_peak: np.ndarray, pos: int) -> None:
        up, under = who[at_peak], who[~at_peak]
        first[up] = np.where(first[up] < 0, pos, first[up])
        last[up] = pos
        under = under[last[under] >= 0]
        longest[under] = np.maximum(longest[under], pos - last[under])

    for i, p in enumerate(cards.pos.tolist()):
        free = state == 0
        take = np.flatnonzero(free & drawn[i])
        flat = np.flatnonzero(free & ~drawn[i])
        state = np.maximum(state - 1, 0)
        out["esum"][flat] += level[flat]
        mark(flat, level[flat] >= peak[flat], p + 1)
        if len(take) == 0:
            continue
        now, top = level[take], peak[take]
        value = now
        for j in range(horizon + 1):
            value = value * cards.step[i, j]
            top = np.maximum(top, value)
            dd[take] = np.minimum(dd[take], value / top - 1)
            mark(take, value >= top, p + 1 + j)
        for c, v in cards.sums.items():
            out[c][take] += v[i]
        for c, v in cards.scaled.items():
            out[c][take] += now * v[i]
        gain = cards.gain[i]
        out["trades"][take] += 1
        if gain > 0:
            out["wins"][take] += 1
            best[take] = np.maximum(best[take], gain)
        elif gain < 0:
            out["loss"][take] += 1
            worst[take] = np.minimum(worst[take], gain)
        level[take], peak[take] = value, top
        state[take] = horizon
    return out | {"dd": dd, "level": level, "best": best, "worst": worst, "longest": longest,
                  "first_peak": first, "last_peak": last}


def simulate(market: DataFrame, model_scores: DataFrame, scenario: DataFrame, *,
             keys: Sequence[str] = ("symbol",), horizon: int = settings.PREDICTION_HORIZON,
             timeframe: str = "1h", simulations: int = settings.RANDOM_BASELINE_SIMULATIONS,
             seed: int = settings.RANDOM_SEED, threshold: float = settings.SIGNAL_THRESHOLD,
             capital: float = settings.INITIAL_CAPITAL, chunk_rows: int = CARD_CHUNK_ROWS) -> DataFrame:
    """Metric row of every series and run: Bernoulli signals at the model's signal rate.

    ``market`` (keys…, pos, timestamp, open), ``model_scores`` (keys…, pos, probability_score), one cost
    ``scenario``. A task holds one chunk of one series and all runs; chunks of one long series spread over
    all executors. Positions of the market are contiguous.
    """
    keys = list(keys)
    costs = scenario.collect()
    if len(costs) != 1:
        raise ValueError("simulations run under one cost scenario")
    name, fee, execution = costs[0]["scenario"], costs[0]["fee_rate"], costs[0]["execution_rate"]
    lengths = market.groupBy(*keys).agg((F.max("pos") + 1).alias("n"))
    rate = model_scores.groupBy(*keys).agg(F.avg(
        (F.col("probability_score") >= threshold).cast("double")).alias("signal_probability"))
    windows = materialise(performance_windows(model_scores, lengths, [], keys, horizon).join(
        rate, keys).filter("end_pos is not null"), "windows")
    decided = model_scores.select(*keys, "pos").distinct().withColumn("decided", F.lit(True))
    rows = market.select(*keys, "pos", "open").join(windows, keys).filter(
        (F.col("pos") >= F.col("start_pos") - 1) & (F.col("pos") <= F.col("end_pos"))).join(
        decided, [*keys, "pos"], "left").withColumns({
            "decided": F.coalesce("decided", F.lit(False)),
            "_name": F.concat_ws("|", *[F.col(k).cast("string") for k in keys])})
    # the marks of a trade reach H + 1 rows ahead
    chunks = materialise(spread_to_chunks(rows, chunk_rows, after=horizon + 1), "card-chunks")
    types = ", ".join(f"{k} {t}" for k, t in chunks.select(*keys).dtypes)
    place = f"{types}, {CHUNK} bigint"

    def frame(rows: pd.DataFrame, columns: dict) -> pd.DataFrame:
        out = pd.DataFrame(columns)
        for at, k in enumerate([*keys, CHUNK]):
            out.insert(at, k, [rows[k].iloc[0]] * len(out))
        return out

    def mapped(rows: pd.DataFrame) -> pd.DataFrame:
        cards = Cards(rows, horizon, fee, execution)
        drawn = draws(rows["_name"].iloc[0], cards.pos, rows["signal_probability"].iloc[0], seed,
                      simulations) & cards.can[:, None]
        state, growth, high = _map(cards, drawn, horizon)
        return frame(rows, {"drawn": [np.packbits(drawn).tobytes()], "state": [state.tobytes()],
                            "growth": [growth.tobytes()], "high": [high.tobytes()]})

    def carried(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Fold the maps of a series in the order of its chunks; a row is what a chunk starts from."""
        series, state, level, peak, run = None, None, None, None, np.arange(simulations)
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                if series != [row[k] for k in keys]:
                    series = [row[k] for k in keys]
                    state = np.zeros(simulations, np.uint8)
                    level, peak = np.ones(simulations), np.ones(simulations)
                out.append({c: row[c] for c in (*keys, CHUNK, "drawn")} | {
                    "state": state.tobytes(), "level": level.tobytes(), "peak": peak.tobytes()})
                to = np.frombuffer(row["state"], np.uint8).reshape(-1, simulations)
                growth, high = (np.frombuffer(row[c]).reshape(-1, simulations)
                                for c in ("growth", "high"))
                peak = np.maximum(peak, level * high[state, run])
                level = level * growth[state, run]
                state = to[state, run]
            yield pd.DataFrame(out)

    def walked(rows: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        if len(rows) == 0 or len(start) == 0:
            return pd.DataFrame(columns=[f.split(" ")[0] for f in f"{place}, {WALKED}".split(", ")])
        cards, begin = Cards(rows, horizon, fee, execution), start.iloc[0]
        drawn = np.unpackbits(np.frombuffer(begin["drawn"], np.uint8), count=len(cards.pos) * simulations)
        found = _walk(cards, drawn.reshape(-1, simulations).astype(bool), horizon,
                      np.frombuffer(begin["state"], np.uint8).astype(np.int64),
                      np.frombuffer(begin["level"]).copy(), np.frombuffer(begin["peak"]).copy())
        for c, none in (("first_peak", -1), ("last_peak", -1), ("best", -np.inf), ("worst", np.inf)):
            kind = "Int64" if c.endswith("peak") else "float64"
            found[c] = pd.Series(found[c]).astype(kind).mask(pd.Series(found[c]) == none)
        return frame(rows, {"run_id": np.arange(simulations), **{
            f.split(" ")[0]: found[f.split(" ")[0]] for f in WALKED.split(", ")[1:]}})

    group = [*keys, CHUNK]
    # a chunk is little data and much work: keep as many partitions as there are chunks
    wide = min(2 * chunks.select(*group).distinct().count() + 1, 100_000)
    chunks = chunks.repartition(wide, *group)
    maps = materialise(chunks.groupBy(*group).applyInPandas(
        mapped, f"{place}, drawn binary, state binary, growth binary, high binary"), "card-maps")
    starts = maps.repartition(*keys).sortWithinPartitions(*group).mapInPandas(
        carried, f"{place}, drawn binary, state binary, level binary, peak binary")
    renamed = starts.select(*[F.col(k).alias(f"of_{k}") for k in group], "drawn", "state", "level", "peak"
                            ).repartition(wide, *[f"of_{k}" for k in group])
    done = materialise(chunks.groupBy(*group).cogroup(renamed.groupBy(
        *[f"of_{k}" for k in group])).applyInPandas(walked, f"{place}, {WALKED}"), "walked")
    return _metrics(done, windows, keys, horizon, name, timeframe, capital)


def _metrics(done: DataFrame, windows: DataFrame, keys: list[str], horizon: int, scenario: str,
             timeframe: str, capital: float) -> DataFrame:
    """Metric rows from the sums per chunk and run."""
    ids = ["run_id", *keys]
    c = F.col
    before = Window.partitionBy(*ids).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    rows = done.join(windows, keys).withColumn(
        "_seen", F.coalesce(F.max("last_peak").over(before), c("start_pos")))
    rows = rows.withColumn("_gap", F.greatest(
        "longest", c("first_peak") - 1 - c("_seen"), F.lit(0).cast("long")))
    total = rows.groupBy(*ids).agg(
        F.first("signal_probability").alias("signal_probability"),
        F.first(c("end_pos") - c("start_pos")).alias("n_intervals"),
        *[F.sum(c(a)).alias(b) for a, b in (
            ("s1", "_s1"), ("s2", "_s2"), ("down", "_down"), ("expo", "_expo"), ("rsum", "_rsum"),
            ("wins", "_wins"), ("wsum", "_wsum"), ("loss", "_loss"), ("lsum", "_lsum"))],
        *[(F.sum(a) * capital).alias(b) for a, b in (
            ("esum", "_esum"), ("turn", "_turn"), ("cost", "_cost"))],
        F.when(F.sum("wins") > 0, F.sum("up") * capital).alias("_up"),
        F.when(F.sum("loss") > 0, F.sum("dn") * capital).alias("_dn"),
        (F.max_by("level", CHUNK) * capital).alias("_final"),
        F.min("dd").alias("maximum_drawdown"),
        F.max(F.greatest(c("_gap"), F.lit(0))).alias("_inside"),
        (F.first("end_pos") - F.coalesce(F.max("last_peak"), F.first("start_pos"))).alias("_open"),
        F.sum("trades").alias("num_trades"),
        F.max("best").alias("largest_winning_trade"), F.min("worst").alias("largest_losing_trade"),
    ).withColumns({
        "maximum_drawdown_duration": F.greatest("_inside", "_open").cast("long"),
        "_avg_equity": c("_esum") / (c("n_intervals") + 1),
        "_hold": (c("num_trades") * horizon).cast("double"),
        "scenario": F.lit(scenario),
    })
    out = metric_columns(total, ["run_id", "scenario", *keys], timeframe, capital=capital)
    return out.join(windows.select(*keys, "signal_probability"), keys)
