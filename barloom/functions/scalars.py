"""Row-local expressions. Missing is NULL everywhere; NaN and infinities are turned into NULL."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

POINT = 100.0


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(a: Column | str, b: Column | str) -> Column:
    """a / b, missing when b is 0."""
    return col(a) / F.nullif(col(b), F.lit(0.0))


def flag(cond: Column) -> Column:
    """0/1 flag; a comparison with a missing value is 0."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def finite(c: Column | str) -> Column:
    """NaN and +-inf to NULL."""
    c = col(c)
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def to_feature(c: Column | str) -> Column:
    """Coerce to double; anything missing or not finite becomes 0."""
    return F.coalesce(finite(col(c).try_cast("double")), F.lit(0.0))


#: Units in which prices are summed exactly: 1e-8, finer than any quoted price.
UNIT = 100_000_000


def units(c: Column | str) -> Column:
    """Price as an exact integer number of 1e-8; prices up to 9e10 fit."""
    return F.round(col(c) * UNIT).cast("bigint")


def clip(c: Column | str, lo: float, hi: float) -> Column:
    """Clip that keeps missing values missing."""
    c = col(c)
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(lo)), F.lit(hi)))


def sign(c: Column | str) -> Column:
    return F.signum(col(c)).cast("int")


def winrate(wins: Column | str, resolved: Column | str, digits: int = 4) -> Column:
    """Wins in percent of resolved, rounded; 0 when nothing is resolved."""
    w, r = col(wins), col(resolved)
    return F.when(r > 0, F.round(w * 100.0 / r, digits)).otherwise(F.lit(0.0))


def cycle(value: Column, period: float) -> tuple[Column, Column]:
    """(sin, cos) of a position within a period."""
    angle = F.lit(2.0 * math.pi) * value / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def time_cycles(ts: Column | str = "ts") -> dict[str, Column]:
    """Minute of day over 1440, weekday (Monday 0) over 5 and over 7, hour over 24."""
    ts = col(ts)
    minute = F.hour(ts) * 60 + F.minute(ts)
    tod_sin, tod_cos = cycle(minute, 1440)
    dow5_sin, dow5_cos = cycle(F.weekday(ts), 5)
    hour_sin, hour_cos = cycle(F.hour(ts), 24)
    dow7_sin, dow7_cos = cycle(F.weekday(ts), 7)
    return {
        "tod_sin": tod_sin,
        "tod_cos": tod_cos,
        "dow_sin": dow5_sin,
        "dow_cos": dow5_cos,
        "hour_sin": hour_sin,
        "hour_cos": hour_cos,
        "dow7_sin": dow7_sin,
        "dow7_cos": dow7_cos,
    }


def session_flags(ts: Column | str = "ts") -> dict[str, Column]:
    hour = F.hour(col(ts))
    return {
        "session_london_ny": flag(hour.between(7, 21)),
        "session_ny": flag(hour.between(12, 21)),
        "session_asia": flag(hour.between(0, 6)),
    }


# Session mode -> (first hour, last hour, last month).
SESSION_MODES = {
    "all": (0, 23, 12),
    "active": (7, 22, 12),
    "london": (7, 16, 12),
    "ny": (13, 22, 12),
    "london_ny": (7, 22, 12),
    "h1_all": (0, 23, 6),
    "h1_active": (7, 22, 6),
    "h1_ny": (13, 22, 6),
}


def in_session(mode: str, ts: Column | str = "ts") -> Column:
    if mode not in SESSION_MODES:
        raise ValueError(f"unknown session mode: {mode}")
    first, last, month = SESSION_MODES[mode]
    ts = col(ts)
    return F.hour(ts).between(first, last) & (F.month(ts) <= month)


def candle_shape() -> dict[str, Column]:
    """Anatomy of one bar, in points and relative to its own range."""
    o, h, lo, c = (F.col(x) for x in ("open", "high", "low", "close"))
    top, bottom, rng = F.greatest(o, c), F.least(o, c), h - lo
    upper, lower = safe_div(h - top, rng), safe_div(bottom - lo, rng)
    return {
        "ret_1": (c - o) * POINT,
        "hl_range": rng * POINT,
        "upper_wick": (h - top) * POINT,
        "lower_wick": (bottom - lo) * POINT,
        "body_abs": F.abs(c - o) * POINT,
        "upper_wick_abs": F.abs(h - top) * POINT,
        "lower_wick_abs": F.abs(bottom - lo) * POINT,
        "close_pos_range": safe_div(c - lo, rng),
        "upper_wick_ratio": upper,
        "lower_wick_ratio": lower,
        "wick_balance": lower - upper,
    }
