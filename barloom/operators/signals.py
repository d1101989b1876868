"""Entry signals, named gates, entry modes and order rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.scalars import (
    POINT,
    SESSION_MODES,
    UNIT,
    flag,
    in_session,
    safe_div,
    session_flags,
    time_cycles,
    units,
)
from barloom.functions.windows import KEY, lag, roll_sum, diff, series
from barloom.operators.chunks import looks_back
from barloom.operators.ewm import add_smoothed
from barloom.operators.indicators import band_position, bands
from barloom.operators.wide import plain_doubles, wide_quantiles
from barloom.session import materialise, small_table


@looks_back(0)
def add_buy_signals(df: DataFrame) -> DataFrame:
    """Three event families and their union; momentum counts only in session."""
    c = F.col
    df = df.withColumns(
        {
            "sig_bb_reversion_buy": flag((c("bb20_pos") < 0.18) & (c("rsi_14") < 45)),
            "sig_pullback_trend_buy": flag((c("ema_dist_55") > 0) & (c("ema_dist_8") < 0) & (c("ret_1") > 0)),
            "sig_momentum_buy": flag(
                (c("ret_sum_10") > 0) & (c("z_close_20") > -0.5) & (c("z_close_20") < 1.5)
            ),
        }
    )
    return df.withColumn(
        "buy_signal",
        flag(
            (c("sig_bb_reversion_buy") == 1)
            | (c("sig_pullback_trend_buy") == 1)
            | ((c("sig_momentum_buy") == 1) & (c("session_london_ny") == 1))
        ),
    )


SIGNALS = ("sig_bb_reversion_buy", "sig_pullback_trend_buy", "sig_momentum_buy", "buy_signal")
FS03_LAGS = (5, 8, 13, 21)
FS03_COLUMNS = (
    *[f"close_diff_lag_{k}" for k in FS03_LAGS],
    *[f"body_lag_{k}" for k in FS03_LAGS],
    "tod_sin",
    "tod_cos",
    "dow_sin",
    "dow_cos",
    *SIGNALS,
)


@looks_back(20)
def add_signal_inputs(df: DataFrame, by: Sequence[str] = KEY) -> DataFrame:
    """The few columns the buy signals read, computed alone instead of the full feature frame."""
    w = series(by)
    df = bands(add_smoothed(df, ema=(8, 55), rsi_periods=(14,), by=by), (20,), by)
    df = df.withColumn("__ret", diff("close", 1, w) * POINT)
    flags = session_flags()
    return df.withColumns(
        {
            "ret_1": (F.col("close") - F.col("open")) * POINT,
            "bb20_pos": band_position(20),
            "z_close_20": safe_div(F.col("close") - F.col("bb20_mid"), F.col("bb20_std")),
            "ema_dist_8": (F.col("close") - F.col("ema_8")) * POINT,
            "ema_dist_55": (F.col("close") - F.col("ema_55")) * POINT,
            "ret_sum_10": roll_sum(units("__ret"), 10, w) / F.lit(float(UNIT)),
            "session_london_ny": flags["session_london_ny"],
            "session_ny": flags["session_ny"],
        }
    )


@looks_back(max(FS03_LAGS) + 1)
def add_fs03(df: DataFrame, by: Sequence[str] = KEY) -> DataFrame:
    """The compact 16-column feature set with its signals."""
    w = series(by)
    df = add_buy_signals(add_signal_inputs(df, by))
    cycles = time_cycles()
    new = {n: cycles[n] for n in ("tod_sin", "tod_cos", "dow_sin", "dow_cos")}
    for k in FS03_LAGS:
        new[f"close_diff_lag_{k}"] = lag("__ret", k, w)
        new[f"body_lag_{k}"] = lag("ret_1", k, w)
    return df.withColumns(new).drop("__ret")


# Quantiles kept per gate column.
GATE_QUANTILES = {"q20": 0.20, "q35": 0.35, "q50": 0.50, "q65": 0.65, "q80": 0.80}

# Gate name -> conditions. ("flag", column, value if the column is absent) needs the flag
# to be 1; ("above" / "below", column, quantile) compares with the training quantile and is skipped if
# the column is absent.
GATES = {
    "all_buy_signal": (),
    "london_ny": (("flag", "session_london_ny", True),),
    "ny": (("flag", "session_ny", True),),
    "bb_reversion_signal": (("flag", "sig_bb_reversion_buy", False),),
    "pullback_signal": (("flag", "sig_pullback_trend_buy", False),),
    "h4_momentum_up": (("above", "h4_ret_sum_6", "q65"),),
    "h4_pullback_uptrend": (("above", "h4_ema_dist_55", "q50"), ("below", "h4_ret_sum_3", "q35")),
    "h4_reversion_from_weakness": (("below", "h4_ret_sum_12", "q35"), ("below", "h4_rsi_14", "q50")),
    "h4_low_vol": (("below", "h4_volatility_6", "q35"),),
    "h4_midlow_vol_london": (("flag", "session_london_ny", True), ("below", "h4_volatility_6", "q65")),
    "bb_h4_lowvol": (("flag", "sig_bb_reversion_buy", False), ("below", "h4_volatility_6", "q65")),
    "bb_h4_weak_london": (
        ("flag", "sig_bb_reversion_buy", False),
        ("flag", "session_london_ny", True),
        ("below", "h4_ret_sum_12", "q50"),
    ),
    "pullback_h4_up_london": (
        ("flag", "sig_pullback_trend_buy", False),
        ("flag", "session_london_ny", True),
        ("above", "h4_ema_dist_55", "q50"),
    ),
}
GATE_COLUMNS = ("h4_ret_sum_3", "h4_ret_sum_6", "h4_ret_sum_12", "h4_volatility_6", "h4_rsi_14", "h4_ema_dist_55")


def fit_gate_quantiles(train: DataFrame, columns: Sequence[str] = GATE_COLUMNS) -> DataFrame:
    """(column, q20..q80) of the gate columns' finite values on training rows; columns without any are left out."""
    rows = materialise(plain_doubles(train, columns))
    found = wide_quantiles(rows, columns, tuple(GATE_QUANTILES.values()))
    table = [(c, *values) for c, (n, values) in found.items() if n]
    return small_table(train.sparkSession, table, "column string, " + ", ".join(f"{q} double" for q in GATE_QUANTILES))


def add_gates(df: DataFrame, quantiles: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """One 0/1 column `gate_<name>` per gate. `quantiles` has one row (column, q20..q80) per gate column.

    The quantile table has a handful of rows whatever the data, so it is pivoted
    to one row and joined to every row.
    """
    present = [c for c in GATE_COLUMNS if c in df.columns]
    wide = quantiles.agg(
        *[
            F.max(F.when(F.col("column") == c, F.col(q))).alias(f"__{c}_{q}")
            for c in present
            for q in GATE_QUANTILES
        ]
    )
    out = df.crossJoin(F.broadcast(wide))
    new = {}
    for name in names or GATES:
        cond: Column = F.lit(True)
        for kind, column, arg in GATES[name]:
            if kind == "flag":
                one = F.coalesce(F.col(column), F.lit(0)) == 1 if column in df.columns else F.lit(arg)
                cond = cond & one
            elif column in present:
                cut = F.col(f"__{column}_{arg}")
                hit = F.col(column) > cut if kind == "above" else F.col(column) < cut
                # A quantile that could not be formed leaves the gate open.
                cond = cond & (cut.isNull() | F.coalesce(hit, F.lit(False)))
        new[f"gate_{name}"] = flag(cond)
    return out.withColumns(new).drop(*wide.columns)


ENTRY_MODES = ("signal_any", "ma20_zone", "ma20_confirm", "bb_reversion", "trend_pullback")


def entry_mode(mode: str, min_phase: int = 0) -> Column:
    """Whether a bar qualifies; reads the cycle columns, `price_zone_ma20_r`, `bb20_pos` and `rsi_simple`."""
    c = F.col
    phase = c("cycle_phase") >= min_phase
    zone = F.abs(c("price_zone_ma20_r"))
    near = (
        (c("first_touch_ma20") == 1) | (c("close_cross_ma20") == 1) | F.coalesce(zone <= 0.35, F.lit(False))
    )
    confirm = c("strong_body_confirm") == 1
    up, down = c("signal_dir") == 1, c("signal_dir") == -1
    pos, rsi = c("bb20_pos"), c("rsi_simple")
    rules = {
        "signal_any": F.lit(True),
        "ma20_zone": near,
        "ma20_confirm": near & confirm,
        "bb_reversion": (up & (pos < 0.25) & (rsi < 48)) | (down & (pos > 0.75) & (rsi > 52)),
        "trend_pullback": (zone <= 0.55) & confirm,
    }
    if mode not in rules:
        raise ValueError(f"unknown entry mode: {mode}")
    return F.coalesce(phase & rules[mode], F.lit(False))


BB_ENTRY_MODES = (
    "bb_any",
    "mid_cycle_start",
    "mid_cycle_4_10",
    "mid_cycle_11_30",
    "first_mid_touch",
    "pullback_mid",
    "lower_reversion",
    "upper_reversion",
    "outer_reversion",
    "squeeze_breakout",
    "bb20_bb50_agree",
)


def bb_entry_mode(mode: str, period: int, signal: str, bar: str, slow: int = 200) -> Column:
    """Whether a bar qualifies, read from the band family of `period` and the cycle columns named."""
    c = F.col
    p = f"bb{period}"
    pos, z, rank, age = c(f"{p}_pos"), c(f"{p}_z"), c(f"{p}_width_rank"), c(bar)
    up, down = c(signal) == 1, c(signal) == -1
    slow_pos = c(f"bb{slow}_pos")
    rules = {
        "bb_any": F.lit(True),
        "mid_cycle_start": age <= 3,
        "mid_cycle_4_10": age.between(4, 10),
        "mid_cycle_11_30": age.between(11, 30),
        "first_mid_touch": c(f"{p}_mid_first_touch_ref") == 1,
        "pullback_mid": age.between(3, 30) & (c(f"{p}_mid_touch_ref_count_clip") >= 1) & pos.between(0.35, 0.65),
        "lower_reversion": (pos <= 0.20) & (z <= -0.8),
        "upper_reversion": (pos >= 0.80) & (z >= 0.8),
        "outer_reversion": (up & (pos <= 0.25)) | (down & (pos >= 0.75)),
        "squeeze_breakout": (rank <= 0.35) & ((up & (pos >= 0.70)) | (down & (pos <= 0.30))),
        "bb20_bb50_agree": F.lit(True)
        if period == slow
        else (up & (slow_pos >= 0.50)) | (down & (slow_pos <= 0.50)),
    }
    if mode not in rules:
        raise ValueError(f"unknown entry mode: {mode}")
    return F.coalesce(rules[mode], F.lit(False))


def away_from_ends(skip_first: int = 250, skip_last: int = 2) -> Column:
    """False for the first and last bars of a series; needs `candle` and `n_candles`."""
    return (F.col("candle") >= skip_first) & (F.col("candle") < F.col("n_candles") - skip_last)


def order_from_score(score: str, threshold: float, session: str | None = "session_london_ny", require_signal: bool = True) -> Column:
    """1 where the score is known and high enough, the signal is on and the session open."""
    cond = F.coalesce(F.col(score) >= threshold, F.lit(False)) & ~F.isnan(F.col(score))
    if require_signal:
        cond = cond & (F.col("buy_signal") == 1)
    if session:
        cond = cond & (F.col(session) == 1)
    return flag(cond)


def two_sided_order(
    allowed: Column, signal: str, buy_score: str, sell_score: str, buy_min: float, sell_min: float, side: str = "both"
) -> Column:
    """+1 buy, -1 sell, 0 none."""
    if side not in ("both", "buy_only", "sell_only"):
        raise ValueError(f"unknown side mode: {side}")
    buy = allowed & (F.col(signal) == 1) & (F.col(buy_score) >= buy_min)
    sell = allowed & (F.col(signal) == -1) & (F.col(sell_score) >= sell_min)
    out = F.when(F.lit(side != "sell_only") & buy, 1)
    return out.when(F.lit(side != "buy_only") & sell, -1).otherwise(0)


def add_order_levels(
    df: DataFrame, order: str = "order", r1: float = 6.0, rr: float = 1.0, by: Sequence[str] = KEY
) -> DataFrame:
    """Entry at the next open, stop and target around it, for rows whose order is not 0."""
    w = series(by)
    df = df.withColumn("__entry", F.lead("open").over(w)).filter(
        (F.col(order) != 0) & F.col("__entry").isNotNull()
    )
    e, side = F.col("__entry"), F.col(order)
    return df.withColumns(
        {
            "entry": F.round(e, 5),
            "sl": F.round(e - side * r1, 5),
            "tp": F.round(e + side * r1 * rr, 5),
            "type": F.lit("market"),
            "side": F.when(side == 1, "buy").otherwise("sell"),
        }
    ).drop("__entry")


def session_mode_flags(ts: str = "ts") -> dict[str, Column]:
    return {f"session_{m}": flag(in_session(m, ts)) for m in SESSION_MODES}
