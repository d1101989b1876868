"""Queries over bars: building, resampling, sessions, audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.scalars import candle_shape, session_flags, time_cycles
from barloom.functions.windows import roll_mean, roll_std, series
from barloom.operators import signals, thresholds
from barloom.operators.chunks import halo_chunks, trim, with_bar_idx
from barloom.operators.ewm import Ewm, add_ewm_continuous
from barloom.operators.ordered import exact_quantiles
from barloom.operators.resample import asof_backward, htf_features, resample
from barloom.plans.common import BARS, bars, ewm_sql, full, lag_, load, query, r, rs, show, span
from barloom.session import materialise, shared_folder
from barloom.sources import bars as src

PRICES = ("open", "high", "low", "close", "volume")


@query("ohlc_bars", f"WITH {BARS} SELECT symbol, year, ts, open, high, low, close, volume FROM bars")
def ohlc_bars(spark, sf_dir):
    return bars(spark, sf_dir)


@query(
    "bars_clean",
    """SELECT event_type AS symbol, year(ts)::INTEGER AS year, count(*) AS rows, min(ts) AS first_ts, max(ts) AS last_ts,
       max(value) AS high, min(value) AS low
     FROM events WHERE value IS NOT NULL AND ts IS NOT NULL AND value < 120 GROUP BY ALL""",
)
def bars_clean(spark, sf_dir):
    """Tick rows in the raw bar layout, large ones with an unreadable date: cleaning must drop just those."""
    raw = load(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"),
        F.when(F.col("value") >= 120, "n/a").otherwise(F.col("ts").cast("string")).alias("dates"),
        *[F.col("value").alias(c) for c in ("open", "high", "low", "close")],
        F.lit(1.0).alias("volume"),
    )
    return src.clean_bars(raw).groupBy("symbol", "year").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
    )


@query(
    "bars_csv",
    f"""WITH {BARS} SELECT symbol, year, ts, open, high, low, close, CASE WHEN length(symbol) % 2 = 0 THEN volume END AS volume FROM bars""",
)
def bars_csv(spark, sf_dir):
    """Bars written as CSV files of two layouts and scanned: one has other columns in another order and no volume."""
    b = bars(spark, sf_dir).withColumn("dates", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    path = shared_folder(spark, "bar-files")
    even = F.length("symbol") % 2 == 0
    b.filter(even).select("symbol", "dates", *PRICES).write.option("header", True).csv(f"{path}/full")
    odd = b.filter(~even).select(F.lit("m").alias("note"), "close", "dates", "low", "high", "open", "symbol")
    odd.write.option("header", True).csv(f"{path}/short")
    return src.read_bar_csv(spark, path).select("symbol", "year", "ts", *PRICES)


@query(
    "bars_upsert",
    f"""WITH {BARS},
      old AS (SELECT *, 0 AS prio FROM bars WHERE ts < TIMESTAMP '2024-01-16'),
      new AS (SELECT symbol, year, ts, open + 1 AS open, high + 1 AS high, low + 1 AS low, close + 1 AS close, volume, 1 AS prio
              FROM bars WHERE ts >= TIMESTAMP '2024-01-15')
      SELECT symbol, ts, year, round(open, 2) AS open, round(high, 2) AS high, round(low, 2) AS low, round(close, 2) AS close, volume
      FROM (SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY prio) AS rn FROM (FROM old UNION ALL FROM new)) WHERE rn = 1""",
)
def bars_upsert(spark, sf_dir):
    """Two downloads overlapping by a day, the second with other prices: the first one's rows stay."""
    b = bars(spark, sf_dir)
    old = b.filter("ts < TIMESTAMP_NTZ '2024-01-16'")
    new = b.filter("ts >= TIMESTAMP_NTZ '2024-01-15'")
    new = new.withColumns({c: F.col(c) + 1 for c in ("open", "high", "low", "close")})
    return show(src.upsert_bars(old, new), ("symbol", "ts", "year"), PRICES, 2)


@query("inventory")
def inventory(spark, sf_dir):
    return src.inventory(spark, sf_dir, "*.parquet")


@query(
    "feature_store_meta",
    f"""WITH {BARS} SELECT 'candle' AS feature_set, count(*) AS rows, 12::BIGINT AS n_columns,
      'ret_1,hl_range,body_abs,close_pos_range' AS feature_columns, '2023' AS train_years, '2024' AS valid_years,
      '2025,2026' AS test_years, 'parquet' AS format FROM bars""",
)
def store_meta(spark, sf_dir):
    shape = candle_shape()
    names = ["ret_1", "hl_range", "body_abs", "close_pos_range"]
    df = bars(spark, sf_dir).withColumns({n: shape[n] for n in names})
    return src.feature_store_meta(df, "candle", names, {"train": [2023], "valid": [2024], "test": [2025, 2026]})


def _htf_sql(seconds: int) -> str:
    return f"""
htf AS (SELECT symbol, year, make_timestamp(ceil(epoch(ts) / {seconds})::BIGINT * {seconds * 1_000_000}) AS bend,
          arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close
        FROM bars GROUP BY ALL),
htf_ts AS (SELECT symbol, year, bend AS ts, open, high, low, close FROM htf)"""


@query(
    "htf_ohlc",
    f"WITH {BARS},{_htf_sql(14400)} SELECT symbol, year, ts, open, high, low, close FROM htf_ts",
)
def htf_ohlc(spark, sf_dir):
    return resample(bars(spark, sf_dir), 4 * 3600)


HTF = [
    "h4_ret", "h4_range", "h4_rsi_14",
    *[f"h4_{k}_{n}" for n in (3, 6, 12) for k in ("ret_sum", "volatility")],
    *[f"h4_ema_{k}_{n}" for n in (8, 21, 55) for k in ("dist", "slope")],
]
_HTF_SQL = f"""{BARS},{_htf_sql(14400)},
hm AS (SELECT *, close - {lag_('close')} AS d FROM htf_ts),
hp AS (SELECT *, CASE WHEN d IS NOT NULL THEN greatest(d, 0.0) END AS up, CASE WHEN d IS NOT NULL THEN greatest(-d, 0.0) END AS down, d * 100 AS ret FROM hm),
{ewm_sql('hp', [span(8), span(21), span(55), ('g', 'up', 1 / 14, 14), ('l', 'down', 1 / 14, 14)], 'he')},
h4 AS (SELECT symbol, year, ts, (close - open) * 100 AS h4_ret, (high - low) * 100 AS h4_range,
  100.0 - 100.0 / (1.0 + g / nullif(l, 0)) AS h4_rsi_14,
  {', '.join(f"{full('sum', 'ret', n)} AS h4_ret_sum_{n}, {full('stddev_samp', 'ret', n)} AS h4_volatility_{n}" for n in (3, 6, 12))},
  {', '.join(f"(close - ema_{n}) * 100 AS h4_ema_dist_{n}, (ema_{n} - {lag_(f'ema_{n}')}) * 100 AS h4_ema_slope_{n}" for n in (8, 21, 55))}
  FROM he)"""


@query("htf_features", f"WITH RECURSIVE {_HTF_SQL} SELECT symbol, year, ts, {rs(HTF)} FROM h4")
def htf(spark, sf_dir):
    return show(htf_features(resample(bars(spark, sf_dir), 4 * 3600), "h4"), ("symbol", "year", "ts"), HTF)


_ASOF = ["h4_ret", "h4_rsi_14", "h4_ema_dist_8", "h4_volatility_6"]


@query(
    "htf_asof",
    f"""WITH RECURSIVE {_HTF_SQL} SELECT b.symbol, b.ts, b.close, {rs(_ASOF)}
      FROM bars b ASOF LEFT JOIN h4 ON b.symbol = h4.symbol AND b.year = h4.year AND b.ts >= h4.ts""",
)
def htf_asof(spark, sf_dir):
    # Bars are far fewer than events; both sides read them.
    b = materialise(bars(spark, sf_dir))
    joined = asof_backward(b, htf_features(resample(b, 4 * 3600), "h4"))
    return show(joined, ("symbol", "ts", "close"), _ASOF)


_CYCLE = ["tod_sin", "tod_cos", "dow_sin", "dow_cos", "hour_sin", "hour_cos", "dow7_sin", "dow7_cos"]
_MINUTE, _DOW = "(hour(ts) * 60 + minute(ts))", "(isodow(ts) - 1)"
_ANGLES = {"tod": f"{_MINUTE} / 1440.0", "dow": f"{_DOW} / 5.0", "hour": "hour(ts) / 24.0", "dow7": f"{_DOW} / 7.0"}


@query(
    "time_cycles",
    "SELECT event_id, "
    + ", ".join(f"{r(f'{f}(2 * pi() * {a})', f'{n}_{f}')}" for n, a in _ANGLES.items() for f in ("sin", "cos"))
    + " FROM events",
)
def cycles_of_time(spark, sf_dir):
    return show(load(spark, sf_dir, "events").withColumns(time_cycles()), ("event_id",), _CYCLE)


@query(
    "session_flags",
    """SELECT event_id, (hour(ts) BETWEEN 7 AND 21)::INTEGER AS session_london_ny, (hour(ts) BETWEEN 12 AND 21)::INTEGER AS session_ny,
      (hour(ts) BETWEEN 0 AND 6)::INTEGER AS session_asia FROM events""",
)
def flags_of_session(spark, sf_dir):
    flags = session_flags()
    return load(spark, sf_dir, "events").select("event_id", *[c.alias(n) for n, c in flags.items()])


_MODES = "('all',0,23,12),('active',7,22,12),('london',7,16,12),('ny',13,22,12),('london_ny',7,22,12),('h1_all',0,23,6),('h1_active',7,22,6),('h1_ny',13,22,6)"


@query(
    "session_modes",
    f"""SELECT mode, event_type, count(*) AS rows, round(sum(value), 2) AS total FROM events
      JOIN (VALUES {_MODES}) m(mode, h0, h1, last) ON hour(ts) BETWEEN h0 AND h1 AND month(ts) <= last GROUP BY ALL""",
)
def modes_of_session(spark, sf_dir):
    """Rows and value per session mode: flags on the wide rows, one aggregate."""
    df = load(spark, sf_dir, "events").withColumns(signals.session_mode_flags())
    modes = [c for c in df.columns if c.startswith("session_")]
    wide = df.groupBy("event_type").agg(
        *[x for m in modes for x in (F.sum(F.col(m).cast("bigint")).alias(f"{m}__n"), F.sum(F.when(F.col(m) == 1, F.col("value"))).alias(f"{m}__v"))]
    )
    cells = F.array(*[F.struct(F.lit(m.removeprefix("session_")).alias("mode"), F.col(f"{m}__n").alias("rows"), F.round(f"{m}__v", 2).alias("total")) for m in modes])
    return wide.select("event_type", F.explode(cells).alias("c")).select("c.mode", "event_type", "c.rows", "c.total").filter("rows > 0")


@query(
    "halo_chunks",
    f"""WITH {BARS} SELECT symbol, ts, (row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1)::BIGINT AS bar_idx,
      {r(f"CASE WHEN count(close) OVER h >= 50 THEN avg(close) OVER h END", 'mean_50')}, {r("CASE WHEN count(close) OVER h >= 50 THEN stddev_samp(close) OVER h END", 'std_50')},
      lead(close, 5) OVER (PARTITION BY symbol ORDER BY ts) AS close_in_5
      FROM bars WINDOW h AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)""",
)
def chunked(spark, sf_dir):
    """A rolling mean, std and a look ahead, computed in chunks of 128 bars with halos."""
    df = halo_chunks(with_bar_idx(bars(spark, sf_dir)), back=49, forward=5, chunk_rows=128)
    w = series(("symbol", "chunk"), "bar_idx")
    df = df.withColumns(
        {"mean_50": roll_mean("close", 50, w), "std_50": roll_std("close", 50, w), "close_in_5": F.lead("close", 5).over(w)}
    )
    return show(trim(df), ("symbol", "ts", "bar_idx"), ("mean_50", "std_50", "close_in_5"))


_EMA = [("ema_8", 8), ("ema_55", 55), ("ema_144", 144)]


@query(
    "ema",
    f"WITH RECURSIVE {BARS},{ewm_sql('bars', [span(n) for _, n in _EMA])} SELECT symbol, ts, {rs([n for n, _ in _EMA])} FROM ew",
)
def ema(spark, sf_dir):
    """EMA running on across years: chunks of 128 bars, chained by their end values."""
    df = add_ewm_continuous(bars(spark, sf_dir), [Ewm.span(o, "close", n) for o, n in _EMA], chunk_rows=128)
    return show(df, ("symbol", "ts"), [n for n, _ in _EMA])


_SHAPE = [
    "ret_1", "hl_range", "upper_wick", "lower_wick", "body_abs", "upper_wick_abs", "lower_wick_abs",
    "close_pos_range", "upper_wick_ratio", "lower_wick_ratio", "wick_balance",
]


@query(
    "candle_shape",
    f"""WITH {BARS}, s AS (SELECT *, greatest(open, close) AS top, least(open, close) AS bottom, nullif(high - low, 0) AS rng FROM bars)
      SELECT symbol, ts, {r('(close - open) * 100', 'ret_1')}, {r('(high - low) * 100', 'hl_range')}, {r('(high - top) * 100', 'upper_wick')},
      {r('(bottom - low) * 100', 'lower_wick')}, {r('abs(close - open) * 100', 'body_abs')}, {r('abs(high - top) * 100', 'upper_wick_abs')},
      {r('abs(bottom - low) * 100', 'lower_wick_abs')}, {r('(close - low) / rng', 'close_pos_range')}, {r('(high - top) / rng', 'upper_wick_ratio')},
      {r('(bottom - low) / rng', 'lower_wick_ratio')}, {r('(bottom - low) / rng - (high - top) / rng', 'wick_balance')} FROM s""",
)
def shape(spark, sf_dir):
    return show(bars(spark, sf_dir).withColumns(candle_shape()), ("symbol", "ts"), _SHAPE)


@query(
    "bar_audit",
    f"""WITH {BARS}, g AS (SELECT *, epoch(ts - lag(ts) OVER (PARTITION BY symbol, year ORDER BY ts)) / 60.0 AS gap FROM bars)
      SELECT symbol, year, count(*) AS rows, min(ts) AS start, max(ts) AS "end", coalesce(sum((gap = 0)::INT), 0)::BIGINT AS duplicate_dates,
      0::BIGINT AS missing_base_rows, sum((high < low)::INT)::BIGINT AS high_lt_low, coalesce(sum((gap > 90)::INT), 0)::BIGINT AS gaps,
      {r('max(gap)', 'max_gap_min')} FROM g GROUP BY symbol, year""",
)
def audit(spark, sf_dir):
    out = thresholds.bar_audit(bars(spark, sf_dir), gap_minutes=90.0)
    return show(out, ("symbol", "year", "rows", "start", "end"), ("duplicate_dates", "missing_base_rows", "high_lt_low", "gaps", "max_gap_min"))


@query(
    "describe",
    f"""WITH {BARS} SELECT symbol, count(*) AS count, {r('avg(close)', 'mean')}, {r('stddev_samp(close)', 'std')}, min(close) AS min,
      {r('quantile_cont(close, 0.05)', 'p5')}, {r('quantile_cont(close, 0.25)', 'p25')}, {r('quantile_cont(close, 0.5)', 'p50')},
      {r('quantile_cont(close, 0.75)', 'p75')}, {r('quantile_cont(close, 0.95)', 'p95')}, max(close) AS max FROM bars GROUP BY symbol""",
)
def describe(spark, sf_dir):
    b = bars(spark, sf_dir)
    base = b.groupBy("symbol").agg(
        F.count("close").alias("count"), F.avg("close").alias("mean"), F.stddev_samp("close").alias("std"),
        F.min("close").alias("min"), F.max("close").alias("max"),
    )
    names = ("p5", "p25", "p50", "p75", "p95")
    q = exact_quantiles(b, ["symbol"], "close", (0.05, 0.25, 0.5, 0.75, 0.95), names).drop("n")
    return show(base.join(q, "symbol"), ("symbol", "count"), ("mean", "std", "min", *names, "max"))
