"""Parameters that define results. The values are fixed by the research contract."""

from __future__ import annotations

from dataclasses import dataclass, field

# --- fixed values -----------------------------------------------------------
PREDICTION_HORIZON = 4
LABEL_LOOKAHEAD_ROWS = PREDICTION_HORIZON + 1
RETURN_PERIODS = (1, 2, 3, 6, 12, 24)
TAKER_FEE_RATE = 0.001
SLIPPAGE_BPS_PER_SIDE = 2.0
HALF_SPREAD_BPS_PER_SIDE = 1.0
MIN_EDGE_BPS = 5.0
FINAL_HOLDOUT_RATIO = 0.20
N_WALK_FORWARD_SPLITS = 5
WALK_FORWARD_TEST_RATIO = 0.10
PURGE_GAP_ROWS = LABEL_LOOKAHEAD_ROWS
RANDOM_SEED = 42
SIGNAL_THRESHOLD = 0.50
INITIAL_CAPITAL = 10_000.0
RANDOM_BASELINE_SIMULATIONS = 1_000
# (scenario, fee rate, slippage bps per side, half spread bps per side)
COST_SCENARIOS = (
    ("low", TAKER_FEE_RATE, 1.0, 0.5),
    ("base", TAKER_FEE_RATE, SLIPPAGE_BPS_PER_SIDE, HALF_SPREAD_BPS_PER_SIDE),
    ("high", TAKER_FEE_RATE, 5.0, 2.0),
)
# ----------------------------------------------------------------------------


@dataclass(frozen=True)
class IndicatorSpec:
    """Window lengths of the technical feature set."""

    ema_short: int = 9
    ema_long: int = 21
    macd_fast: int = 12
    macd_slow: int = 26
    macd_signal: int = 9
    rsi: int = 14
    stoch_rsi: int = 14
    bollinger: int = 20
    bollinger_width: float = 2.0
    atr: int = 14
    volume_mean: int = 20
    returns: tuple[int, ...] = field(default=RETURN_PERIODS)

    def __post_init__(self) -> None:
        if not self.returns or any(
            isinstance(n, bool) or not isinstance(n, int) or n <= 0 for n in self.returns
        ):
            raise ValueError("return periods must be positive integers")
        if len(set(self.returns)) != len(self.returns):
            raise ValueError("return periods must be unique")

    @property
    def minimum_rows(self) -> int:
        """Rows a series needs before one feature row can be complete."""
        return max(
            self.ema_long,
            self.macd_slow + self.macd_signal - 1,
            self.rsi + self.stoch_rsi - 1,
            self.bollinger,
            self.atr,
            self.volume_mean,
            max(self.returns) + 1,
        )

    @property
    def feature_columns(self) -> list[str]:
        """The frozen, ordered feature schema."""
        return [
            "ema_short", "ema_long", "ema_ratio", "close_to_ema_short", "close_to_ema_long",
            "macd", "macd_signal", "macd_diff", "rsi", "stoch_rsi", "bb_width", "bb_pct",
            "atr", "atr_pct", "candle_range_pct", "body_return", "volume_change",
            "volume_ma_ratio", *(f"return_{n}" for n in self.returns),
        ]


# --- fixed values: news snapshots -------------------------------------------
NEWS_PROVIDER = "gdelt_gsg"
NEWS_ASSET = "BTC"
OBSERVATION_PREFIX = "gdelt-gsg"
INTERVAL_SECONDS = 60
PROVIDER_LAG_SECONDS = 1800
MAX_PLAN_INTERVALS = 10_080
MAX_COMPRESSED_BYTES = 64 * 1024 * 1024
MAX_DECOMPRESSED_BYTES = 256 * 1024 * 1024
MAX_JSON_LINES = 1_000_000
DUPLICATE_HORIZON_HOURS = 72
RETRY_BACKOFF_SECONDS = (2.0, 4.0)
MAX_ATTEMPTS = 3
MAX_RETRY_AFTER_SECONDS = 86_400.0
RELEVANCE_FLOOR = 0.20
SENTIMENT_NEUTRAL = 0.20
# order of precedence: the first reason that applies is the primary one
EXCLUSION_REASONS = (
    "hash_mismatch", "malformed_record", "invalid_timestamp",
    "historical_backfill_without_availability", "undocumented_first_seen_semantics",
    "missing_first_seen", "revision_time_unknown", "missing_identity",
    "invalid_url_or_identifier", "missing_title_and_content", "unsupported_language",
    "asset_mismatch", "license_restricted", "provider_gap", "duplicate_unresolved",
)
BLOCKING_REASONS = (
    "hash_mismatch", "malformed_record", "invalid_timestamp", "missing_first_seen",
    "missing_identity", "invalid_url_or_identifier", "missing_title_and_content",
    "unsupported_language",
)
SNAPSHOT_ERRORS = (
    "invalid_gzip", "invalid_json", "invalid_jsonl", "invalid_utf8", "malformed_snapshot",
    "resource_limit_exceeded",
)
SCORE_STATES = (
    "pending", "succeeded", "input_too_long", "transient_exhausted", "invalid_output",
    "permanent_error", "hash_mismatch", "budget_blocked", "license_blocked",
)
INCLUDE_TITLES = r"bitcoin|btc|xbt|satoshi nakamoto"
EXCLUDE_TITLES = r"btc city"
TRACKING_KEYS = r"^(utm_.*|fbclid|gclid|mc_cid|mc_eid)$"
SENSITIVE_KEYS = (
    "api-key", "apikey", "api_key", "authorization", "credential", "key", "password", "secret",
    "signature", "token", "access-token", "access_token", "x-api-key", "x_api_key",
    "client-secret", "client_secret", "sig",
)
# ----------------------------------------------------------------------------
