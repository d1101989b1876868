"""Technical indicators. Each function adds columns to a bar frame.

`by` is the series key (default symbol and year) and `ts` orders it. Under
`chunks.over_chunks` the functions run on whole series; `looks_back` says how
many rows their windows reach back. Wilder and simple variants, and variants
with different clamps, are separate functions.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.scalars import POINT, UNIT, clip, flag, safe_div, units
from barloom.functions.windows import (
    KEY,
    ExactSums,
    diff,
    lag,
    roll_max,
    roll_mean,
    roll_min,
    roll_std,
    roll_sum,
    series,
    so_far,
)
from barloom.operators.chunks import ChunkKey, looks_back
from barloom.operators.ewm import true_range
from barloom.operators.rolling_rank import Rank, add_ranks
from barloom.operators.state_scan import scan_runs

LAGS = (1, 2, 3, 5, 8, 13, 21, 34, 55)
WINDOWS = (5, 10, 20, 50, 100, 200)


@looks_back(lambda a: max(a["lags"]) + 1)
def add_lags(df: DataFrame, lags: Sequence[int] = LAGS, by: Sequence[str] = KEY) -> DataFrame:
    w = series(by)
    df = df.withColumn("__ret", diff("close", 1, w) * POINT)
    body = (F.col("close") - F.col("open")) * POINT
    rng = (F.col("high") - F.col("low")) * POINT
    new = {}
    for k in lags:
        new[f"close_diff_lag_{k}"] = lag("__ret", k, w)
        new[f"body_lag_{k}"] = lag(body, k, w)
        new[f"range_lag_{k}"] = lag(rng, k, w)
    return df.withColumns(new).drop("__ret")


@looks_back(lambda a: max(a["windows"]) + 1)
def add_rolling_stats(df: DataFrame, windows: Sequence[int] = WINDOWS, by: Sequence[str] = KEY) -> DataFrame:
    """z of close; mean and std of range, body and close difference; sum of close differences."""
    w = series(by)
    exact = ExactSums(w)
    df = df.withColumns(
        {
            "__c": units("close"),
            "__rng": units(F.col("high") - F.col("low")),
            "__body": units(F.abs(F.col("close") - F.col("open"))),
        }
    ).withColumn("__ret", diff("__c", 1, w))
    point = F.lit(float(UNIT // POINT))
    df = exact.prepare(df, ["__c", "__rng", "__body", "__ret"], windows)
    new = {}
    for n in windows:
        new[f"z_close_{n}"] = safe_div(F.col("__c") - exact.mean("__c", n), exact.std("__c", n))
        for name, src in (("range", "__rng"), ("body", "__body")):
            new[f"{name}_mean_{n}"] = exact.mean(src, n) / point
            new[f"{name}_std_{n}"] = exact.std(src, n) / point
        new[f"ret_sum_{n}"] = exact.sum("__ret", n) / point
        new[f"ret_mean_{n}"] = exact.mean("__ret", n) / point
        new[f"volatility_{n}"] = exact.std("__ret", n) / point
    out = exact.drop(df.withColumns(new))
    return out.drop("__c", "__rng", "__body", "__ret")


@looks_back(lambda a: max(a["periods"]))
def bands(df: DataFrame, periods: Sequence[int], by: Sequence[str] = KEY) -> DataFrame:
    """`bb<p>_mid`, `bb<p>_std`, `bb<p>_upper`, `bb<p>_lower` of close, from exact running sums."""
    w = series(by)
    exact = ExactSums(w)
    df = exact.prepare(df.withColumn("__c", units("close")), ["__c"], periods)
    df = df.withColumns(
        {
            **{f"bb{p}_mid": exact.mean("__c", p) / UNIT for p in periods},
            **{f"bb{p}_std": exact.std("__c", p) / UNIT for p in periods},
        }
    )
    df = exact.drop(df).drop("__c")
    return df.withColumns(
        {
            **{f"bb{p}_upper": F.col(f"bb{p}_mid") + 2 * F.col(f"bb{p}_std") for p in periods},
            **{f"bb{p}_lower": F.col(f"bb{p}_mid") - 2 * F.col(f"bb{p}_std") for p in periods},
        }
    )


def band_position(p: int) -> Column:
    return safe_div(F.col("close") - F.col(f"bb{p}_lower"), F.col(f"bb{p}_upper") - F.col(f"bb{p}_lower"))


@looks_back(lambda a: a["period"])
def add_bollinger(df: DataFrame, period: int = 20, by: Sequence[str] = KEY) -> DataFrame:
    p = f"bb{period}"
    return bands(df, (period,), by).withColumns(
        {
            f"{p}_pos": band_position(period),
            f"{p}_width": (F.col(f"{p}_upper") - F.col(f"{p}_lower")) * POINT,
            f"{p}_lower_dist": (F.col("close") - F.col(f"{p}_lower")) * POINT,
        }
    )


@looks_back(lambda a: max(a["periods"]) + 5)
def add_bb_family(df: DataFrame, periods: Sequence[int] = (20, 100, 200), by: Sequence[str] = KEY) -> DataFrame:
    w = series(by)
    df = bands(df, periods, by)
    c = F.col("close")
    new: dict[str, Column] = {}
    for n in periods:
        p = f"bb{n}"
        mid, up, lo = (F.col(f"{p}_{x}") for x in ("mid", "upper", "lower"))
        width = up - lo
        new[f"{p}_pos"] = band_position(n)
        new[f"{p}_z"] = safe_div(c - mid, F.col(f"{p}_std"))
        new[f"{p}_width"] = width * POINT
        new[f"{p}_mid_dist"] = (c - mid) * POINT
        new[f"{p}_upper_dist"] = (up - c) * POINT
        new[f"{p}_lower_dist"] = (c - lo) * POINT
        for k in (1, 5):
            new[f"{p}_mid_slope_{k}"] = diff(mid, k, w) * POINT
            new[f"{p}_width_slope_{k}"] = diff(width, k, w) * POINT
    df = df.withColumns(new)
    flags: dict[str, Column] = {}
    for n in periods:
        p = f"bb{n}"
        flags[f"{p}_squeeze"] = flag(F.col(f"{p}_width_slope_5") < 0)
        flags[f"{p}_expansion"] = flag(F.col(f"{p}_width_slope_5") > 0)
        flags[f"{p}_lower_reversion_raw"] = flag(F.col(f"{p}_pos") <= 0.20)
        flags[f"{p}_outer_low"] = flag(F.col(f"{p}_pos") < 0.0)
    return df.withColumns(flags)


@looks_back(0)
def add_bb_cross(df: DataFrame, periods: Sequence[int] = (20, 100, 200)) -> DataFrame:
    """Comparisons between three band families; needs `add_bb_family` on the same periods."""
    a, b, c = periods
    pa, pb, pc = (F.col(f"bb{n}_pos") for n in periods)
    wa, wb, wc = (F.col(f"bb{n}_width") for n in periods)
    low_ab, low_ac = (pa <= 0.20) & (pb <= 0.35), (pa <= 0.20) & (pc <= 0.40)
    return df.withColumns(
        {
            f"bb{a}_bb{b}_pos_diff": pa - pb,
            f"bb{a}_bb{c}_pos_diff": pa - pc,
            f"bb{b}_bb{c}_pos_diff": pb - pc,
            f"bb{a}_width_over_bb{b}": safe_div(wa, wb),
            f"bb{a}_width_over_bb{c}": safe_div(wa, wc),
            f"bb{b}_width_over_bb{c}": safe_div(wb, wc),
            f"bb_lower_agree_{a}_{b}": flag(low_ab),
            f"bb_lower_agree_{a}_{c}": flag(low_ac),
            "bb_lower_agree_all": flag(low_ab & low_ac),
            "bb_trend_context_buy": flag(
                F.coalesce(F.col(f"bb{b}_mid_slope_5") > 0, F.lit(False))
                | F.coalesce(F.col(f"bb{c}_mid_slope_5") > 0, F.lit(False))
            ),
        }
    )


@looks_back(lambda a: max(*a["gap_windows"], a["rank_window"]))
def add_bb_behavior(
    df: DataFrame,
    periods: Sequence[int] = (20, 100, 200),
    gap_windows: Sequence[int] = (20, 100, 200),
    rank_window: int = 500,
    rank_min: int = 100,
    by: Sequence[str] = KEY,
) -> DataFrame:
    """Cyclic position, past-only ranks, width and gaps in ATR units. Needs the band family and `atr14`."""
    w = series(by)
    c, atr = F.col("close"), F.col("atr14")
    new: dict[str, Column] = {}
    for n in periods:
        p = f"bb{n}"
        angle = 2.0 * math.pi * clip(f"{p}_pos", -0.5, 1.5)
        new[f"{p}_pos_cycle_sin"] = F.sin(angle)
        new[f"{p}_pos_cycle_cos"] = F.cos(angle)
        new[f"{p}_width_atr"] = safe_div(F.col(f"{p}_width"), atr * POINT)
        new[f"__{p}_mid_gap"] = safe_div(c - F.col(f"{p}_mid"), atr)
        new[f"__{p}_lower_gap"] = safe_div(c - F.col(f"{p}_lower"), atr)
    df = df.withColumns(new)
    rolled = {}
    for n in periods:
        for line in ("mid", "lower"):
            for k in gap_windows:
                src = f"__bb{n}_{line}_gap"
                rolled[f"bb{n}_{line}_gap_atr_rollmean_{k}"] = roll_mean(src, k, w)
                rolled[f"bb{n}_{line}_gap_atr_rollstd_{k}"] = roll_std(src, k, w)
    df = df.withColumns(rolled).drop(*[f"__bb{n}_{x}_gap" for n in periods for x in ("mid", "lower")])
    ranks = [
        Rank(f"bb{n}_{out}_rank_500", f"bb{n}_{src}", rank_window, rank_min)
        for n in periods
        for out, src in (("pos", "pos"), ("z", "z"), ("width_atr", "width_atr"))
    ]
    return add_ranks(df, ranks, by)


@looks_back(lambda a: a["window"])
def add_roll_minmax(
    df: DataFrame, value: str, out: str, window: int, min_periods: int = 100, by: Sequence[str] = KEY
) -> DataFrame:
    """Position of the current value between the smallest and largest of the rows before it."""
    w = series(by)
    lo = roll_min(value, window, w, min_periods, past_only=True)
    hi = roll_max(value, window, w, min_periods, past_only=True)
    return df.withColumn(out, safe_div(F.col(value) - lo, hi - lo))


@looks_back(lambda a: max(a["periods"]) + a["rank_window"])
def add_bb_family_v2(
    df: DataFrame,
    periods: Sequence[int] = (10, 20, 50, 100, 200),
    rank_window: int = 2000,
    rank_min: int = 200,
    by: Sequence[str] = KEY,
) -> DataFrame:
    """Bands in units of `norm_scale`, width rank, breaks, reversion and squeeze directions."""
    df = bands(df, periods, by)
    c, scale = F.col("close"), F.col("norm_scale")
    new = {}
    for n in periods:
        p = f"bb{n}"
        mid, up, lo = (F.col(f"{p}_{x}") for x in ("mid", "upper", "lower"))
        new[f"__{p}_width"] = up - lo
        new[f"{p}_pos"] = band_position(n)
        new[f"{p}_width_r"] = safe_div(up - lo, scale)
        new[f"{p}_z"] = safe_div(c - mid, F.col(f"{p}_std"))
        new[f"{p}_dist_mid_r"] = safe_div(c - mid, scale)
        new[f"{p}_dist_upper_r"] = safe_div(c - up, scale)
        new[f"{p}_dist_lower_r"] = safe_div(c - lo, scale)
        new[f"{p}_break_upper"] = flag(c > up)
        new[f"{p}_break_lower"] = flag(c < lo)
    df = add_ranks(
        df.withColumns(new),
        [Rank(f"bb{n}_width_rank", f"__bb{n}_width", rank_window, rank_min, "pct") for n in periods],
        by,
    ).drop(*[f"__bb{n}_width" for n in periods])
    flags = {}
    for n in periods:
        p = f"bb{n}"
        pos, rank = F.col(f"{p}_pos"), F.col(f"{p}_width_rank")
        flags[f"{p}_squeeze"] = flag(rank <= 0.20)
        flags[f"{p}_reversion_raw"] = F.when(pos <= 0.20, 1).when(pos >= 0.80, -1).otherwise(0)
        flags[f"{p}_squeeze_dir_raw"] = (
            F.when((rank <= 0.35) & (pos >= 0.80), 1).when((rank <= 0.35) & (pos <= 0.20), -1).otherwise(0)
        )
        flags[f"{p}_width_signal"] = F.when(rank >= 0.50, 1).otherwise(-1)
    return df.withColumns(flags)


@looks_back(lambda a: a["period"] + 11)
def add_rsi_simple(df: DataFrame, period: int = 14, by: Sequence[str] = KEY) -> DataFrame:
    """RSI on plain means; the first difference counts as 0. No loss gives 100, no move at all is missing."""
    w = series(by)
    delta = diff("close", 1, w)
    df = df.withColumns(
        {
            "__up": F.when(delta > 0, delta).otherwise(0.0),
            "__down": F.when(delta < 0, -delta).otherwise(0.0),
        }
    )
    gain, loss = roll_mean("__up", period, w), roll_mean("__down", period, w)
    df = df.withColumns({"__gain": gain, "__loss": loss})
    g, ls = F.col("__gain"), F.col("__loss")
    value = F.when(ls > 0, 100.0 - 100.0 / (1.0 + g / F.nullif(ls, F.lit(0.0)))).when((ls == 0) & (g > 0), 100.0)
    df = df.withColumn("rsi_simple", value).drop("__up", "__down", "__gain", "__loss")
    r = F.col("rsi_simple")
    return df.withColumns(
        {"rsi_center": r - 50.0, "rsi_slope3": diff(r, 3, w), "rsi_slope10": diff(r, 10, w)}
    )


@looks_back(lambda a: a["period"] + 1 + a["rank_window"])
def add_atr_simple(
    df: DataFrame, period: int = 14, rank_window: int = 2000, rank_min: int = 200, by: Sequence[str] = KEY
) -> DataFrame:
    w = series(by)
    # Exact sums, so that equal means are equal numbers and tie in the rank.
    exact = ExactSums(w)
    df = exact.prepare(df.withColumn("__tr", units(true_range(w))), ["__tr"], (period,), squares=False)
    df = exact.drop(df.withColumn("atr_simple", exact.mean("__tr", period) / UNIT)).drop("__tr")
    return add_ranks(df, [Rank("atr_rank", "atr_simple", rank_window, rank_min, "pct")], by)


@looks_back(0)
def add_keltner(df: DataFrame, mult: float = 1.5) -> DataFrame:
    """Needs `ema_20` and `atr20`."""
    mid, atr = F.col("ema_20"), F.col("atr20")
    return df.withColumns(
        {"keltner20_mid": mid, "keltner20_upper": mid + mult * atr, "keltner20_lower": mid - mult * atr}
    )


@looks_back(lambda a: max(a["periods"]))
def add_donchian(df: DataFrame, periods: Sequence[int] = (20, 55), by: Sequence[str] = KEY) -> DataFrame:
    w = series(by)
    new = {}
    for p in periods:
        up, lo = roll_max("high", p, w), roll_min("low", p, w)
        new[f"donchian{p}_upper"] = up
        new[f"donchian{p}_lower"] = lo
        new[f"donchian{p}_mid"] = (up + lo) / 2.0
    return df.withColumns(new)


@looks_back(lambda a: a["window"])
def add_vwap_rolling(df: DataFrame, window: int = 100, by: Sequence[str] = KEY) -> DataFrame:
    w = series(by)
    value = roll_sum(F.col("close") * F.col("volume"), window, w)
    return df.withColumn(f"vwap{window}", safe_div(value, roll_sum("volume", window, w)))


@looks_back(lambda a: a["day_rows"])
def add_vwap_session(df: DataFrame, by: Sequence[str] = KEY, day_rows: int = 1440) -> DataFrame:
    """Volume-weighted typical price since the start of the calendar day; zero volume counts as missing.

    `day_rows` is the most bars a day can have, which is how far a chunk reaches back.
    """
    run = so_far(series((*by, "__day")))
    volume = F.nullif(F.col("volume"), F.lit(0.0))
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3.0
    df = df.withColumn("__day", F.to_date("ts"))
    value, weight = F.sum(typical * volume).over(run), F.sum(volume).over(run)
    return df.withColumn("vwap_session", F.when(volume.isNotNull(), safe_div(value, weight))).drop("__day")


@looks_back(52)
def add_ichimoku(df: DataFrame, by: Sequence[str] = KEY) -> DataFrame:
    """Lines at their own bar: nothing is shifted forward."""
    w = series(by)

    def middle(n: int) -> Column:
        return (roll_max("high", n, w) + roll_min("low", n, w)) / 2.0

    df = df.withColumns(
        {"ichimoku_tenkan": middle(9), "ichimoku_kijun": middle(26), "ichimoku_span_b_raw": middle(52)}
    )
    return df.withColumn("ichimoku_span_a_raw", (F.col("ichimoku_tenkan") + F.col("ichimoku_kijun")) / 2.0)


def _psar_line(high, low, step: float, cap: float, clamp_first: bool) -> list[float]:
    line, rising, speed, extreme = [low[0]], True, step, high[0]
    for i in range(1, len(high)):
        stop = line[-1] + speed * (extreme - line[-1])
        guard = (i - 1, i - 2) if i > 1 else ((0,) if clamp_first else ())
        if rising:
            stop = min([stop, *(low[j] for j in guard)])
            crossed, further = low[i] < stop, high[i] > extreme
        else:
            stop = max([stop, *(high[j] for j in guard)])
            crossed, further = high[i] > stop, low[i] < extreme
        if crossed:
            stop, speed = extreme, step
            extreme = low[i] if rising else high[i]
            rising = not rising
        elif further:
            extreme = high[i] if rising else low[i]
            speed = min(speed + step, cap)
        line.append(stop)
    return line


def add_psar(
    df: DataFrame,
    step: float = 0.02,
    cap: float = 0.2,
    clamp_first: bool = False,
    out: str = "psar",
    by: Sequence[str] = KEY,
    order: str = "ts",
) -> DataFrame:
    """Parabolic stop-and-reverse. Each value depends on the branch taken before it, so a (bounded)
    series is walked in order; series run in parallel. `clamp_first` also clamps the second bar."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        pdf[out] = _psar_line(pdf["high"].tolist(), pdf["low"].tolist(), step, cap, clamp_first)
        return pdf

    schema = T.StructType(df.schema.fields + [T.StructField(out, T.DoubleType())])
    return df.groupBy(*by).applyInPandas(run, schema)


@looks_back(1)
def add_supertrend(df: DataFrame, atr: str = "atr20", mult: float = 3.0, by: Sequence[str] = KEY) -> DataFrame:
    """The side is the last breach of the previous bar's bands, so no loop is needed."""
    w = series(by)
    mid = (F.col("high") + F.col("low")) / 2.0
    df = df.withColumns({"__up": mid + mult * F.col(atr), "__lo": mid - mult * F.col(atr)})
    breach = F.when(F.col("close") > lag("__up", 1, w), 1).when(F.col("close") < lag("__lo", 1, w), 0)
    df = df.withColumn("__breach", breach)
    if isinstance(by, ChunkKey):
        df = scan_runs(df, by, marks={"__up_ago": F.col("__breach") == 1, "__down_ago": F.col("__breach") == 0})
        up = F.when(F.col("__down_ago").isNull() | (F.col("__up_ago") < F.col("__down_ago")), 1).otherwise(0)
        df = df.withColumn("supertrend_up", up).drop("__up_ago", "__down_ago")
    else:
        up = F.coalesce(F.last("__breach", ignorenulls=True).over(so_far(w)), F.lit(1))
        df = df.withColumn("supertrend_up", up)
    line = F.when(F.col("supertrend_up") == 1, F.col("__lo")).otherwise(F.col("__up"))
    return df.withColumn("supertrend20x3", line).drop("__up", "__lo", "__breach")


@looks_back(lambda a: a["period"] + 3)
def add_stochastic(df: DataFrame, period: int = 14, by: Sequence[str] = KEY) -> DataFrame:
    w = series(by)
    lo, hi = roll_min("low", period, w), roll_max("high", period, w)
    df = df.withColumn("sto14", 100.0 * safe_div(F.col("close") - lo, hi - lo))
    df = df.withColumn("sto14_d3", roll_mean("sto14", 3, w))
    return df.withColumns(
        {"stoch_spread": F.col("sto14") - F.col("sto14_d3"), "stoch_slope3": diff("sto14", 3, w)}
    )


@looks_back(lambda a: 2 * a["period"] + 11)
def add_adx(df: DataFrame, period: int = 14, by: Sequence[str] = KEY) -> DataFrame:
    w = series(by)
    up, down = diff("high", 1, w), -diff("low", 1, w)
    df = df.withColumns(
        {
            "__tr": true_range(w),
            "__plus": F.when((up > down) & (up > 0), up).otherwise(0.0),
            "__minus": F.when((down > up) & (down > 0), down).otherwise(0.0),
        }
    )
    atr = roll_mean("__tr", period, w)
    df = df.withColumns(
        {
            "plus_di14": 100.0 * safe_div(roll_mean("__plus", period, w), atr),
            "minus_di14": 100.0 * safe_div(roll_mean("__minus", period, w), atr),
        }
    )
    spread = F.col("plus_di14") - F.col("minus_di14")
    df = df.withColumns(
        {
            "di_spread": spread,
            "di_abs": F.abs(spread),
            "__dx": 100.0 * safe_div(F.abs(spread), F.col("plus_di14") + F.col("minus_di14")),
        }
    )
    df = df.withColumn("adx14", roll_mean("__dx", period, w)).drop("__tr", "__plus", "__minus", "__dx")
    return df.withColumns({"adx_slope3": diff("adx14", 3, w), "adx_slope10": diff("adx14", 10, w)})


@looks_back(lambda a: a["window"])
def add_norm_scale(df: DataFrame, window: int = 200, min_periods: int = 50, by: Sequence[str] = KEY) -> DataFrame:
    """Spread of recent body sizes; where that is 0 or missing the mean range."""
    w = series(by)
    df = df.withColumn("__body", F.abs(F.col("close") - F.col("open")))
    spread = roll_max("__body", window, w, min_periods) - roll_min("__body", window, w, min_periods)
    rng = roll_mean(F.col("high") - F.col("low"), window, w, min_periods)
    scale = F.nullif(F.coalesce(F.nullif(spread, F.lit(0.0)), rng), F.lit(0.0))
    return df.withColumn("norm_scale", scale).drop("__body")


RETURN_STEPS = (1, 3, 5, 10, 15, 30, 60, 120)


@looks_back(lambda a: max(*RETURN_STEPS, *a["vol_windows"]) + 1)
def add_norm_returns(df: DataFrame, by: Sequence[str] = KEY, vol_windows: Sequence[int] = (30, 60, 120)) -> DataFrame:
    """Needs `norm_scale`."""
    w = series(by)
    c, scale = F.col("close"), F.col("norm_scale")
    df = df.withColumn("__pct", safe_div(c, lag(c, 1, w)) - 1.0)
    new = {f"ret{n}_r": safe_div(diff(c, n, w), scale) for n in RETURN_STEPS}
    new |= {f"vol{n}": roll_std("__pct", n, w) * 100.0 for n in vol_windows}
    new["range_r"] = safe_div(F.col("high") - F.col("low"), scale)
    new["body_r"] = safe_div(c - F.col("open"), scale)
    new["body_abs_r"] = F.abs(safe_div(c - F.col("open"), scale))
    return df.withColumns(new).drop("__pct")


@looks_back(1)
def add_ema_features(
    df: DataFrame,
    spans: Sequence[int] = (8, 13, 21, 34, 55, 89, 144),
    gaps: Sequence[tuple[int, int]] = ((8, 21), (8, 55), (21, 55), (34, 89), (55, 144)),
    by: Sequence[str] = KEY,
) -> DataFrame:
    """Distance, slope and gaps of the EMAs; needs `ema_<span>`."""
    w = series(by)
    new = {}
    for n in spans:
        new[f"ema_dist_{n}"] = (F.col("close") - F.col(f"ema_{n}")) * POINT
        new[f"ema_slope_{n}"] = diff(f"ema_{n}", 1, w) * POINT
    for a, b in gaps:
        new[f"ema_gap_{a}_{b}"] = (F.col(f"ema_{a}") - F.col(f"ema_{b}")) * POINT
    return df.withColumns(new)


@looks_back(0)
def add_ema_stack(df: DataFrame) -> DataFrame:
    a, b, c, d = (F.col(f"ema_{n}") for n in (5, 20, 50, 200))
    return df.withColumns(
        {
            "ema_stack_bull": flag((a > b) & (b > c) & (c > d)),
            "ema_stack_bear": flag((a < b) & (b < c) & (c < d)),
        }
    )


@looks_back(lambda a: a["window"])
def add_volume_z(df: DataFrame, window: int = 100, by: Sequence[str] = KEY) -> DataFrame:
    w = series(by)
    exact = ExactSums(w)
    df = exact.prepare(df.withColumn("__v", F.col("volume").cast("bigint")), ["__v"], (window,))
    z = safe_div(F.col("volume") - exact.mean("__v", window), exact.std("__v", window))
    return exact.drop(df.withColumn(f"volume_z_{window}", z)).drop("__v")


OVERLAY_LAGS = (1, 3, 5, 8, 13)


OVERLAY_PARTS = ("value", "distance", "pct_distance", "velocity", "acceleration", "std")


@looks_back(lambda a: 50 + a["rank_window"])
def add_overlay(
    df: DataFrame,
    lines: dict[str, int],
    atr: str = "atr14",
    rank_window: int = 500,
    rank_min: int = 100,
    parts: Sequence[str] = OVERLAY_PARTS,
    by: Sequence[str] = KEY,
) -> DataFrame:
    """Normalise price lines: `lines` maps a line column to the window of its rolling std.

    Per line: distance to close in ATR and in percent, with lags; past-only rank of
    the std of that distance; velocity and acceleration in ATR. `parts` limits what is
    built. Ranks come first, while the frame is narrow, as they leave the JVM.
    """
    w = series(by)
    a = F.col(atr)
    df = df.withColumns({f"{n}_ov_value": safe_div(F.col(n) - F.col("close"), a) for n in lines})
    if "std" in parts:
        df = df.withColumns({f"__{n}_std": roll_std(f"{n}_ov_value", min(k, 50), w) for n, k in lines.items()})
        df = add_ranks(df, [Rank(f"{n}_ov_std", f"__{n}_std", rank_window, rank_min) for n in lines], by)
        df = df.drop(*[f"__{n}_std" for n in lines])
    first: dict[str, Column] = {}
    for name in lines:
        p, line = f"{name}_ov", F.col(name)
        if "distance" in parts:
            first[f"{p}_distance"] = F.col(f"{p}_value")
        if "pct_distance" in parts:
            first[f"{p}_pct_distance"] = safe_div(line - F.col("close"), F.col("close"))
        if "velocity" in parts or "acceleration" in parts:
            for k in (1, 3, 5, 8):
                first[f"{p}_velocity{k}"] = safe_div(diff(line, k, w), a)
    df = df.withColumns(first) if first else df
    second: dict[str, Column] = {}
    for name in lines:
        p = f"{name}_ov"
        for part in ("value", "distance", "pct_distance"):
            if part in parts:
                for k in OVERLAY_LAGS:
                    second[f"{p}_{part}_lag{k}"] = lag(f"{p}_{part}", k, w)
        if "velocity" in parts:
            for v in (1, 3, 5, 8):
                for k in (1, 3):
                    second[f"{p}_velocity{v}_lag{k}"] = lag(f"{p}_velocity{v}", k, w)
        if "acceleration" in parts:
            for k in (1, 3, 5):
                second[f"{p}_acceleration{k}"] = diff(f"{p}_velocity{k}", k, w)
    return df.withColumns(second) if second else df


# Overlay lines and the window of their rolling std.
OVERLAY_LINES = {
    **{f"ema_{n}": min(n, 50) for n in (8, 13, 21, 34, 55, 89, 144, 200)},
    **{f"bb{n}_mid": min(n, 50) for n in (20, 50, 100, 200)},
    **{f"bb{n}_{side}": min(n, 50) for n in (20, 100, 200) for side in ("upper", "lower")},
    **{f"keltner20_{side}": 20 for side in ("mid", "upper", "lower")},
    **{f"donchian{n}_{side}": min(n, 50) for n in (20, 55) for side in ("upper", "lower", "mid")},
    "vwap100": 50,
    "vwap_session": 50,
    "ichimoku_tenkan": 9,
    "ichimoku_kijun": 26,
    "ichimoku_span_a_raw": 26,
    "ichimoku_span_b_raw": 50,
    "psar": 50,
    "supertrend20x3": 50,
}
