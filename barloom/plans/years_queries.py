"""Series of years without a restart: chains of operators over chunks, on daily bars of the orders table (1995 to 2001).

The SQL is that of the one-month queries with other bars, whose `year` is one constant: every window then runs over a
whole symbol. Chunks are short, so that each series has several.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import cycles, signals
from barloom.operators import indicators as ind
from barloom.operators.chunks import Step, over_chunks, step
from barloom.operators.ewm import add_smoothed
from barloom.plans import cycle_queries, indicator_queries, window_queries
from barloom.plans.common import BARS, CHECKS, load, query, show
from barloom.plans.window_queries import KEYS
from barloom.sources.bars import bars_from_events

#: Bars in a chunk; a chain that reaches further back has longer ones.
CHUNK = 300

ORDER_BARS = """
ticks AS (SELECT o_orderpriority AS symbol, date_trunc('day', o_orderdate) AS day_, o_orderdate AS tick, o_orderkey,
                 floor(o_totalprice / 10) / 100.0::DOUBLE AS value
          FROM orders WHERE o_totalprice IS NOT NULL AND o_orderdate IS NOT NULL),
bars AS (SELECT symbol, 0::INTEGER AS year, day_::TIMESTAMP AS ts,
                first(value ORDER BY tick, o_orderkey) AS open, max(value) AS high, min(value) AS low,
                last(value ORDER BY tick, o_orderkey) AS close, count(*)::DOUBLE AS volume
         FROM ticks GROUP BY symbol, day_)"""


def order_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of seven years, one series per order priority."""
    orders = load(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("event_type"),
        F.col("o_orderdate").alias("ts"),
        F.col("o_orderkey").alias("event_id"),
        (F.floor(F.col("o_totalprice") / 10) / 100.0).alias("value"),
    )
    return bars_from_events(orders, width=86_400)


def _over_years(name: str, like: str, steps: list[Step], columns: list[str], digits: int = 6, longs: tuple[str, ...] = ()) -> None:
    """Register `steps` over the orders' bars under `name`, checked by the SQL of query `like`."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = over_chunks(order_bars(spark, sf_dir), *steps, chunk_rows=CHUNK)
        df = df.withColumns({c: F.col(c).cast("bigint") for c in longs}) if longs else df
        return show(df, KEYS, columns, digits)

    sql = CHECKS[like].replace(BARS, ORDER_BARS)
    query(name, sql.replace(", 6) + 0.0", f", {digits}) + 0.0"))(run)


_over_years("years_fs03", "fs03_features", [step(signals.add_fs03)], list(signals.FS03_COLUMNS))
_over_years(
    "years_cycle_phase",
    "cycle_phase",
    [step(add_smoothed, ema=cycle_queries._EMAS), step(cycles.add_signal_cycle)],
    ["cycle_phase", "phase_start", "phase_middle", "phase_end", "cycle_age_clip", "bars_since_mid"],
    longs=("cycle_age_clip", "bars_since_mid"),
)
_over_years(
    "years_cycle_touch",
    "cycle_touch",
    [step(add_smoothed, ema=cycle_queries._EMAS), step(cycles.add_signal_cycle), step(cycles.add_cycle_touch)],
    ["first_touch_ma20", "cycle_touch_count", "close_cross_ma20", "strong_body", "strong_body_confirm"],
)
_over_years("years_lags", "lags", [step(ind.add_lags)], window_queries._LAGS)
_over_years("years_rolling", "rolling_stats", [step(ind.add_rolling_stats)], window_queries._STATS, 5)
_over_years("years_bb_family", "bb_family", [step(ind.add_bb_family, periods=indicator_queries._P)], indicator_queries._FAM, 5)
_over_years(
    "years_bb_behavior",
    "bb_behavior",
    [
        step(add_smoothed, atr_periods=(14,)),
        step(ind.add_bb_family, periods=(20,)),
        step(ind.add_bb_behavior, periods=(20,), gap_windows=(20,), rank_window=60, rank_min=20),
    ],
    indicator_queries._BEH,
    5,
)
_over_years("years_supertrend", "supertrend", [step(add_smoothed, atr_periods=(20,)), step(ind.add_supertrend)], ["supertrend_up", "supertrend20x3"])
_over_years("years_adx", "adx", [step(ind.add_adx)], indicator_queries._ADX)
_over_years("years_vwap_session", "vwap_session", [step(ind.add_vwap_session, day_rows=1)], ["vwap_session"])
_over_years(
    "years_ema_features",
    "ema_features",
    [step(add_smoothed, ema=(*indicator_queries._SPANS, 5, 20, 50, 200)), step(ind.add_ema_features, spans=indicator_queries._SPANS, gaps=indicator_queries._GAPS), step(ind.add_ema_stack)],
    [*indicator_queries._EMAF, "ema_stack_bull", "ema_stack_bear"],
    4,
)


def _renamed_ages(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(f"ma5_ma20_{c}") for c in cycle_queries._MA})


@query("years_cycle_ages", CHECKS["cycle_ages"].replace(BARS, ORDER_BARS))
def years_cycle_ages(spark, sf_dir):
    steps = [step(add_smoothed, ema=cycle_queries._EMAS), step(ind.add_norm_scale), step(cycles.add_ma_cycle)]
    df = _renamed_ages(over_chunks(order_bars(spark, sf_dir), *steps, chunk_rows=CHUNK))
    df = df.withColumns({c: F.col(c).cast("bigint") for c in ("cycle_bar", "cycle_bar_clip")})
    return show(df, KEYS, cycle_queries._MA)


@query("years_cycle_generic", CHECKS["cycle_generic"].replace(BARS, ORDER_BARS))
def years_cycle_generic(spark, sf_dir):
    """Price/line and signal cycles that run on over the years, one row per bar and cycle."""

    def reversion(df: DataFrame) -> DataFrame:
        pos = ind.band_position(20)
        return df.withColumn("raw", F.when(pos <= 0.20, 1).when(pos >= 0.80, -1).otherwise(0))

    reversion.looks_back = 0
    steps = [
        step(ind.add_norm_scale),
        step(ind.bands, periods=(20,)),
        step(reversion),
        step(cycles.add_cycle_columns, prefix="mid", reference="bb20_mid", line="bb20_mid"),
        step(cycles.add_cycle_columns, prefix="reversion", reference="bb20_mid", signal="raw"),
    ]
    return cycle_queries.generic_rows(over_chunks(order_bars(spark, sf_dir), *steps, chunk_rows=CHUNK))
