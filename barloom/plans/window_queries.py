"""Queries over rolling windows, rolling scalers and row-local transforms. Windows are shortened to the test bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.windows import series
from barloom.operators import indicators as ind
from barloom.operators import scaling, transforms
from barloom.operators.rolling_rank import Rank, add_ranks
from barloom.plans.common import BARS, W, bars, full, lag_, over, query, r, show

KEYS = ("symbol", "ts")

_LAGS = [f"{k}_lag_{n}" for n in ind.LAGS for k in ("close_diff", "body", "range")]


@query(
    "lags",
    f"""WITH {BARS}, d AS (SELECT *, (close - {lag_('close')}) * 100 AS dc, (close - open) * 100 AS bd, (high - low) * 100 AS rg FROM bars)
      SELECT symbol, ts, {', '.join(r(lag_(s, n), f'{k}_lag_{n}') for n in ind.LAGS for k, s in (('close_diff', 'dc'), ('body', 'bd'), ('range', 'rg')))} FROM d""",
)
def lags(spark, sf_dir):
    return show(ind.add_lags(bars(spark, sf_dir)), KEYS, _LAGS)


_STATS = [
    f"{k}_{n}"
    for n in ind.WINDOWS
    for k in ("z_close", "range_mean", "range_std", "body_mean", "body_std", "ret_sum", "ret_mean", "volatility")
]


def _stats_sql() -> str:
    cols = []
    for n in ind.WINDOWS:
        cols.append(r(f"(close - {full('avg', 'close', n)}) / nullif({full('stddev_samp', 'close', n)}, 0)", f"z_close_{n}", 5))
        for k, s in (("range", "rg"), ("body", "bd")):
            cols.append(r(full("avg", s, n), f"{k}_mean_{n}", 5))
            cols.append(r(full("stddev_samp", s, n), f"{k}_std_{n}", 5))
        cols.append(r(full("sum", "dc", n), f"ret_sum_{n}", 5))
        cols.append(r(full("avg", "dc", n), f"ret_mean_{n}", 5))
        cols.append(r(full("stddev_samp", "dc", n), f"volatility_{n}", 5))
    return ", ".join(cols)


@query(
    "rolling_stats",
    f"""WITH {BARS}, d AS (SELECT *, round((close - {lag_('close')}) * 100) AS dc, round(abs(close - open) * 100) AS bd, round((high - low) * 100) AS rg FROM bars)
      SELECT symbol, ts, {_stats_sql()} FROM d""",
)
def rolling_stats(spark, sf_dir):
    return show(ind.add_rolling_stats(bars(spark, sf_dir)), KEYS, _STATS, 5)


_DONCHIAN = [f"donchian{p}_{s}" for p in (20, 55) for s in ("upper", "lower", "mid")]


@query(
    "donchian",
    f"""WITH {BARS}, d AS (SELECT symbol, ts, {', '.join(f"{full('max', 'high', p)} AS donchian{p}_upper, {full('min', 'low', p)} AS donchian{p}_lower" for p in (20, 55))} FROM bars)
      SELECT symbol, ts, {', '.join(f"{r(f'donchian{p}_upper')}, {r(f'donchian{p}_lower')}, {r(f'(donchian{p}_upper + donchian{p}_lower) / 2', f'donchian{p}_mid')}" for p in (20, 55))} FROM d""",
)
def donchian(spark, sf_dir):
    return show(ind.add_donchian(bars(spark, sf_dir)), KEYS, _DONCHIAN)


@query(
    "roll_minmax",
    f"""WITH {BARS}, d AS (SELECT *, {full('min', 'close', 50, 20, True)} AS lo, {full('max', 'close', 50, 20, True)} AS hi FROM bars)
      SELECT symbol, ts, {r('(close - lo) / nullif(hi - lo, 0)', 'close_minmax_50')} FROM d""",
)
def roll_minmax(spark, sf_dir):
    return show(ind.add_roll_minmax(bars(spark, sf_dir), "close", "close_minmax_50", 50, 20), KEYS, ["close_minmax_50"])


def _z_sql(x: str, n: int, m: int) -> str:
    o = over(n, True)
    var = f"coalesce(var_samp({x}) {o}, 0)"
    return f"CASE WHEN {x} IS NOT NULL AND count({x}) {o} >= {m} AND {var} > 1e-12 THEN ({x} - avg({x}) {o}) / sqrt({var}) ELSE 0.0 END"


# Candidate rows: bars closing above their open.
UP = f"""{BARS}, up AS (SELECT *, close - open AS body FROM bars WHERE close > open)"""


def _up(spark, sf_dir):
    return bars(spark, sf_dir).filter("close > open").withColumn("body", F.col("close") - F.col("open"))


@query(
    "roll_zscore",
    f"WITH {UP} SELECT symbol, ts, {r(_z_sql('close', 50, 20), 'close_z')}, {r(_z_sql('body', 50, 20), 'body_z')}, volume AS volume_z FROM up",
)
def roll_zscore(spark, sf_dir):
    """Scaled over the candidate rows only, as the models see them."""
    df = scaling.add_roll_zscore(_up(spark, sf_dir), ["close", "body", "volume"], ["volume"], 50, 20)
    return show(df, KEYS, ["close_z", "body_z", "volume_z"])


def _midrank_sql(x: str, n: int, m: int) -> str:
    return f"""(SELECT CASE WHEN count(p.{x}) >= {m} THEN ((sum((p.{x} < b.{x})::INT) + 0.5 * sum((p.{x} = b.{x})::INT)) / count(p.{x}) - 0.5) * 2 END
      FROM num p WHERE p.symbol = b.symbol AND p.year = b.year AND p.rn BETWEEN b.rn - {n} AND b.rn - 1)"""


NUM = f"num AS (SELECT *, row_number() OVER ({W}) AS rn FROM bars)"


@query(
    "roll_midrank",
    f"WITH {BARS}, {NUM} SELECT symbol, ts, {r(_midrank_sql('close', 50, 20), 'close_rank')}, {r(_midrank_sql('volume', 50, 20), 'volume_rank')} FROM num b",
)
def roll_midrank(spark, sf_dir):
    ranks = [Rank("close_rank", "close", 50, 20), Rank("volume_rank", "volume", 50, 20)]
    return show(add_ranks(bars(spark, sf_dir), ranks), KEYS, ["close_rank", "volume_rank"])


def _pctrank_sql(x: str, n: int, m: int, src: str = "num") -> str:
    return f"""(SELECT CASE WHEN count(p.{x}) >= {m} AND b.{x} IS NOT NULL THEN (sum((p.{x} < b.{x})::INT) + (sum((p.{x} = b.{x})::INT) + 1) / 2.0) / count(p.{x}) END
      FROM {src} p WHERE p.symbol = b.symbol AND p.year = b.year AND p.rn BETWEEN b.rn - {n - 1} AND b.rn)"""


@query(
    "roll_pctrank",
    f"WITH {BARS}, {NUM} SELECT symbol, ts, {r(_pctrank_sql('close', 100, 20), 'close_pct')}, {r(_pctrank_sql('volume', 100, 20), 'volume_pct')} FROM num b",
)
def roll_pctrank(spark, sf_dir):
    ranks = [Rank("close_pct", "close", 100, 20, "pct"), Rank("volume_pct", "volume", 100, 20, "pct")]
    return show(add_ranks(bars(spark, sf_dir), ranks), KEYS, ["close_pct", "volume_pct"])


@query(
    "roll_quantile",
    f"""WITH {BARS}, d AS (SELECT *, abs(close - open) AS body FROM bars),
      q AS (SELECT *, CASE WHEN count(body) {over(60)} >= 20 THEN quantile_cont(body, 0.7) {over(60)} END AS cut FROM d)
      SELECT symbol, ts, {r('cut', 'body_q70')}, coalesce(body > cut + 1e-9, false)::INTEGER AS strong_body FROM q""",
)
def roll_quantile(spark, sf_dir):
    frame = series().rowsBetween(-59, 0)
    df = bars(spark, sf_dir).withColumn("body", F.abs(F.col("close") - F.col("open")))
    cut = F.when(F.count("body").over(frame) >= 20, F.percentile("body", 0.7).over(frame))
    df = df.withColumn("body_q70", cut)
    df = df.withColumn("strong_body", F.coalesce(F.col("body") > F.col("body_q70") + 1e-9, F.lit(False)).cast("int"))
    return show(df, KEYS, ["body_q70", "strong_body"])


def _wma_sql(x: str, n: int = 14) -> str:
    wma = "(" + " + ".join(f"{n - k} * {lag_(x, k + 1)}" for k in range(n)) + f") / {n * (n + 1) / 2}"
    std = full("stddev_samp", x, n, None, True)
    return f"CASE WHEN abs({std}) > 1e-12 THEN ({x} - {wma}) / ({std}) WHEN abs({x} - {wma}) <= 1e-12 THEN 0.0 END"


@query(
    "wma_zscore",
    f"WITH {BARS} SELECT symbol, ts, {r(_wma_sql('close'), 'close__wmaz14p', 5)}, {r(_wma_sql('high'), 'high__wmaz14p', 5)}, (close > open)::INTEGER AS sig_up FROM bars",
)
def wma_zscore(spark, sf_dir):
    df = bars(spark, sf_dir).withColumn("sig_up", (F.col("close") > F.col("open")).cast("int"))
    out, columns = scaling.wma_scaling(df, ["close", "high", "sig_up"])
    return show(out, KEYS, columns, 5)


def _scaled_sql() -> str:
    lo, hi = full("min", "close", 40, 20, True), full("max", "close", 40, 20, True)
    return ", ".join(
        [
            r(_z_sql("close", 40, 20), "close__zscore", 5),
            r(f"coalesce({_wma_sql('close')}, 0)", "close__wma", 5),
            r(f"coalesce((close - {lo}) / nullif({hi} - {lo}, 0), 0)", "close__minmax", 5),
            r(f"coalesce({_midrank_sql('close', 40, 20)}, 0)", "close__rank", 5),
        ]
    )


@query("scaler_compare", f"WITH {BARS}, {NUM} SELECT symbol, ts, {_scaled_sql()} FROM num b")
def scaler_compare(spark, sf_dir):
    df = bars(spark, sf_dir)
    for method, window in (("zscore", 40), ("wma", 14), ("minmax", 40), ("rank", 40)):
        df = scaling.add_scaled(df, ["close"], method, window, 20)
    return show(df, KEYS, [f"close__{m}" for m in scaling.SCALERS], 5)


_AUTO = [f"ft_{k}_{f}" for f in ("close", "volume") for k in ("diff", "percent_change", "rolling_mean", "rolling_std", "rolling_min", "rolling_max")]


def _auto_sql(x: str) -> str:
    p = lag_(x)
    parts = {
        "diff": f"{x} - {p}",
        "percent_change": f"{x} / nullif({p}, 0) - 1",
        "rolling_mean": full("avg", x, 3, 1),
        "rolling_std": full("stddev_samp", x, 3, 1),
        "rolling_min": full("min", x, 3, 1),
        "rolling_max": full("max", x, 3, 1),
    }
    return ", ".join(r(f"coalesce({e}, 0)", f"ft_{k}_{x}") for k, e in parts.items())


@query("auto_features", f"WITH {UP} SELECT symbol, ts, {_auto_sql('close')}, {_auto_sql('volume')} FROM up")
def auto_features(spark, sf_dir):
    return show(transforms.auto_features(_up(spark, sf_dir), ["close", "volume"]), KEYS, _AUTO)


# --- row-local transforms on scaled lineitem columns ---------------------------------------------------

_X = "(l_quantity - 25.5) / 10.0 AS a, (l_discount - 0.05) * 40.0 AS b, (l_tax - 0.04) * 30.0 AS c"
_T = f"x AS (SELECT l_orderkey, l_linenumber, l_partkey, {_X}, (l_linenumber % 2)::DOUBLE AS session_ny, sin(l_linenumber) AS tod_sin FROM lineitem)"
_TKEYS = ("l_orderkey", "l_linenumber", "l_partkey")


def _x(spark, sf_dir):
    from barloom.plans.common import load

    return load(spark, sf_dir, "lineitem").select(
        *_TKEYS,
        ((F.col("l_quantity") - 25.5) / 10.0).alias("a"),
        ((F.col("l_discount") - 0.05) * 40.0).alias("b"),
        ((F.col("l_tax") - 0.04) * 30.0).alias("c"),
        (F.col("l_linenumber") % 2).cast("double").alias("session_ny"),
        F.sin("l_linenumber").alias("tod_sin"),
    )


def _clip(e: str, lo: float, hi: float) -> str:
    return f"least(greatest({e}, {lo}), {hi})"


_UNI = [f"{f}__{k}" for f in "ab" for k in ("abs", "square", "signed_log1p", "tanh", "pos", "neg")]


@query(
    "tf_univariate",
    f"WITH {_T} SELECT l_orderkey, l_linenumber, l_partkey, "
    + ", ".join(
        ", ".join(
            [
                r(f"abs({f})", f"{f}__abs"), r(_clip(f"{f} * {f}", 0, 25), f"{f}__square"),
                r(f"sign({f}) * ln(1 + abs({f}))", f"{f}__signed_log1p"), r(f"tanh({f})", f"{f}__tanh"),
                r(f"greatest({f}, 0)", f"{f}__pos"), r(f"greatest(-({f}), 0)", f"{f}__neg"),
            ]
        )
        for f in "ab"
    )
    + " FROM x",
)
def tf_univariate(spark, sf_dir):
    df = _x(spark, sf_dir)
    for variant in ("abs_square", "signed_log_tanh", "hinge"):
        df = transforms.transform_variant(df, variant, ["a", "b"], 2)
    return show(df, _TKEYS, _UNI)


_PAIRS = [("a", "b"), ("a", "c"), ("b", "c")]


@query(
    "tf_products",
    f"WITH {_T} SELECT l_orderkey, l_linenumber, l_partkey, " + ", ".join(r(_clip(f"{a} * {b}", -25, 25), f"{a}__x__{b}") for a, b in _PAIRS) + " FROM x",
)
def tf_products(spark, sf_dir):
    df = transforms.transform_variant(_x(spark, sf_dir), "products", ["a", "b", "c"], 3)
    return show(df, _TKEYS, [f"{a}__x__{b}" for a, b in _PAIRS])


@query(
    "tf_diff_ratio",
    f"WITH {_T} SELECT l_orderkey, l_linenumber, l_partkey, "
    + ", ".join(f"{r(_clip(f'{a} - {b}', -10, 10), f'{a}__minus__{b}')}, {r(_clip(f'{a} / (abs({b}) + 1.0)', -10, 10), f'{a}__ratio__{b}')}" for a, b in _PAIRS)
    + " FROM x",
)
def tf_diff_ratio(spark, sf_dir):
    df = transforms.transform_variant(_x(spark, sf_dir), "diff_ratio", ["a", "b", "c"], 3)
    return show(df, _TKEYS, [f"{a}__{k}__{b}" for a, b in _PAIRS for k in ("minus", "ratio")])


_ACTS = [f"{f}__x__{a}" for a in ("tod_sin", "session_ny") for f in ("a", "b")]


@query(
    "tf_interactions",
    f"WITH {_T} SELECT l_orderkey, l_linenumber, l_partkey, "
    + ", ".join(r(_clip(f"{f} * {a}", -10, 10), f"{f}__x__{a}") for a in ("tod_sin", "session_ny") for f in ("a", "b"))
    + " FROM x",
)
def tf_interactions(spark, sf_dir):
    df = transforms.transform_variant(_x(spark, sf_dir), "time_signal_interactions", ["a", "b"], 2)
    return show(df, _TKEYS, _ACTS)
