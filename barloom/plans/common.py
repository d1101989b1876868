"""Query registry, table loading, shared inputs, and the SQL text shared by the check queries."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.sources.bars import bars_from_events

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}

DIGITS = 6


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, and the SQL that must give the same rows."""

    def keep(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # Hours, days and epochs are read in UTC.
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            CHECKS[name] = sql
        return fn

    return keep


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def show(df: DataFrame, keys: Sequence[str], columns: Sequence[str], digits: int = DIGITS) -> DataFrame:
    """Key columns, then the named columns with doubles rounded."""
    kinds = dict(df.dtypes)
    out = [F.round(c, digits).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in columns]
    return df.select(*keys, *out)


def r(expr: str, name: str | None = None, digits: int = DIGITS) -> str:
    """SQL text: rounded, without a negative zero."""
    return f"round({expr}, {digits}) + 0.0 AS {name or expr}"


def rs(names: Sequence[str], digits: int = DIGITS) -> str:
    return ", ".join(r(n, n, digits) for n in names)


# --- bars of the events table --------------------------------------------------------------------------

R1 = 60.0
HORIZON = 24


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars, one series per event type."""
    return bars_from_events(load(spark, sf_dir, "events"))


BARS = """
ticks AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS hour, ts AS tick, event_id, value
          FROM events WHERE value IS NOT NULL AND ts IS NOT NULL),
bars AS (SELECT symbol, year(hour)::INTEGER AS year, hour AS ts,
                first(value ORDER BY tick, event_id) AS open, max(value) AS high, min(value) AS low,
                last(value ORDER BY tick, event_id) AS close, count(*)::DOUBLE AS volume
         FROM ticks GROUP BY symbol, hour)"""

W = "PARTITION BY symbol, year ORDER BY ts"


def over(n: int, past_only: bool = False) -> str:
    if past_only:
        return f"OVER ({W} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return f"OVER ({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def full(agg: str, x: str, n: int, min_periods: int | None = None, past_only: bool = False) -> str:
    """SQL text: rolling aggregate, missing below min_periods known values."""
    o = over(n, past_only)
    need = n if min_periods is None else min_periods
    return f"CASE WHEN count({x}) {o} >= {need} THEN {agg}({x}) {o} END"


def lag_(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) OVER ({W})"


SO_FAR = f"OVER ({W} ROWS UNBOUNDED PRECEDING)"


def ewm_sql(source: str, specs: Sequence[tuple[str, str, float, int]], name: str = "ew") -> str:
    """SQL text of CTE `<name>`: the source's rows with one weighted mean per (out, input, alpha, min_periods)."""
    first = ", ".join(f"{i}::DOUBLE AS {o}" for o, i, _, _ in specs)
    step = ", ".join(
        f"CASE WHEN n.{i} IS NULL THEN r.{o} WHEN r.{o} IS NULL THEN n.{i} ELSE {1.0 - a!r} * r.{o} + {a!r} * n.{i} END"
        for o, i, a, _ in specs
    )
    final = ", ".join(
        f"CASE WHEN count({i}) {SO_FAR} >= {max(m, 1)} THEN {name}_rec.{o} END AS {o}" for o, i, _, m in specs
    )
    return f"""
{name}_num AS (SELECT *, row_number() OVER ({W}) AS rn FROM {source}),
{name}_rec AS (
  SELECT symbol, year, rn, {first} FROM {name}_num WHERE rn = 1
  UNION ALL
  SELECT n.symbol, n.year, n.rn, {step}
  FROM {name}_rec r JOIN {name}_num n ON n.symbol = r.symbol AND n.year = r.year AND n.rn = r.rn + 1),
{name} AS (SELECT {name}_num.*, {final} FROM {name}_num JOIN {name}_rec USING (symbol, year, rn))"""


def span(n: int) -> tuple[str, str, float, int]:
    return (f"ema_{n}", "close", 2.0 / (n + 1.0), n)


MOVES = f"""
moves AS (SELECT *, close - {lag_('close')} AS dclose,
  greatest(high - low, abs(high - {lag_('close')}), abs(low - {lag_('close')})) AS tr FROM bars),
parts AS (SELECT *, greatest(dclose, 0.0) AS up, greatest(-dclose, 0.0) AS down FROM
  (SELECT * FROM moves WHERE dclose IS NOT NULL)
  UNION ALL BY NAME SELECT *, NULL::DOUBLE AS up, NULL::DOUBLE AS down FROM moves WHERE dclose IS NULL)"""


def smoothed_sql(ema: Sequence[int] = (), rsi: Sequence[int] = (), atr: Sequence[int] = ()) -> str:
    """CTEs BARS .. `sm`: bars with ema_<n>, rsi_<n>, atr<n>."""
    specs = [span(n) for n in ema]
    for n in rsi:
        specs += [(f"g{n}", "up", 1.0 / n, n), (f"l{n}", "down", 1.0 / n, n)]
    specs += [(f"atr{n}", "tr", 1.0 / n, n) for n in atr]
    rsis = "".join(f", 100.0 - 100.0 / (1.0 + g{n} / nullif(l{n}, 0)) AS rsi_{n}" for n in rsi)
    return f"{BARS},{MOVES},{ewm_sql('parts', specs)},\nsm AS (SELECT *{rsis} FROM ew)"


def bands_sql(source: str, periods: Sequence[int], name: str = "bb") -> str:
    raw = ", ".join(
        f"{full('avg', 'close', p)} AS bb{p}_mid, {full('stddev_samp', 'close', p)} AS bb{p}_std" for p in periods
    )
    lines = ", ".join(
        f"bb{p}_mid + 2 * bb{p}_std AS bb{p}_upper, bb{p}_mid - 2 * bb{p}_std AS bb{p}_lower" for p in periods
    )
    return f"""
{name}_raw AS (SELECT *, {raw} FROM {source}),
{name} AS (SELECT *, {lines} FROM {name}_raw)"""


def bb_pos(p: int) -> str:
    return f"(close - bb{p}_lower) / nullif(bb{p}_upper - bb{p}_lower, 0)"


# --- scored rows of the lineitem table -----------------------------------------------------------------

SPLITS = {"train": (1995, 1996, 1997, 1998), "valid": (1999,), "test": (2000, 2001)}
FEATURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line: two scores made of discount, tax and quantity, a 0/1 label, year, session and signal."""
    qty = F.col("l_quantity").cast("int")
    disc = F.round(F.col("l_discount") * 100).cast("int")
    tax = F.round(F.col("l_tax") * 100).cast("int")
    return load(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        *FEATURES,
        F.col("l_shipdate").alias("ts"),
        F.year("l_shipdate").alias("year"),
        ((3500 + 150 * disc + 100 * tax + 20 * qty) / 10000.0).alias("score"),
        ((3400 + 100 * disc + 150 * tax + 22 * qty) / 10000.0).alias("score_b"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
        (F.col("l_linestatus") == "O").cast("int").alias("session"),
        (F.col("l_linenumber") <= 4).cast("int").alias("buy_signal"),
    )


SCORED = """
scored AS (SELECT *, CASE WHEN year <= 1998 THEN 'train' WHEN year = 1999 THEN 'valid' ELSE 'test' END AS split FROM (
  SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate AS ts,
    year(l_shipdate)::INTEGER AS year,
    (3500 + 150 * round(l_discount * 100)::INTEGER + 100 * round(l_tax * 100)::INTEGER + 20 * l_quantity::INTEGER) / 10000.0::DOUBLE AS score,
    (3400 + 100 * round(l_discount * 100)::INTEGER + 150 * round(l_tax * 100)::INTEGER + 22 * l_quantity::INTEGER) / 10000.0::DOUBLE AS score_b,
    (l_returnflag = 'R')::INTEGER AS label, (l_linestatus = 'O')::INTEGER AS session,
    (l_linenumber <= 4)::INTEGER AS buy_signal
  FROM lineitem))"""

LONG = """
long AS (UNPIVOT (SELECT split, year, label, l_quantity, l_extendedprice, l_discount, l_tax FROM scored)
  ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME feature VALUE value)"""
