"""Regime cycles: runs of one direction, their age, phase and touches of a reference line.

A run is a running count of direction changes; ages and per-run counts are the
distance to the run's first row, so all of it stays in one window order. Over
whole series (`chunks.over_chunks`) the runs go on across chunks and years:
what a chunk hands on is one row of `state_scan`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.scalars import flag, safe_div, sign
from barloom.functions.windows import KEY, diff, lag, roll_sum, series, so_far
from barloom.operators.chunks import ChunkKey, looks_back
from barloom.operators.state_scan import scan_runs


def direction(fast: str, slow: str) -> Column:
    """Sign of fast - slow; equal or missing counts as up."""
    s = sign(F.coalesce(F.col(fast) - F.col(slow), F.lit(0.0)))
    return F.when(s == 0, 1).otherwise(s)


def _changed(direction_col: str, by: Sequence[str]) -> Column:
    prev = lag(direction_col, 1, series(by))
    return F.when(prev.isNull() | (prev != F.col(direction_col)), 1).otherwise(0)


@looks_back(1)
def add_runs(df: DataFrame, direction_col: str, prefix: str, by: Sequence[str] = KEY) -> DataFrame:
    """`<prefix>_id` from 1, `<prefix>_bar` from 0 and `<prefix>_changed` of each run of equal direction."""
    w = series(by)
    run = so_far(w)
    df = df.withColumn(f"{prefix}_changed", _changed(direction_col, by))
    if isinstance(by, ChunkKey):
        return scan_runs(df, by, F.col(f"{prefix}_changed"), f"{prefix}_id", f"{prefix}_bar")
    df = df.withColumn("__pos", F.row_number().over(w))
    started = F.last(F.when(F.col(f"{prefix}_changed") == 1, F.col("__pos")), ignorenulls=True).over(run)
    return df.withColumns(
        {
            f"{prefix}_id": F.sum(f"{prefix}_changed").over(run),
            f"{prefix}_bar": F.col("__pos") - started,
        }
    ).drop("__pos")


def touches(line: str) -> Column:
    return flag((F.col("low") <= F.col(line)) & (F.col("high") >= F.col(line)))


@looks_back(0)
def add_run_touches(
    df: DataFrame, touch: Column, prefix: str, first: str, count: str, by: Sequence[str] = KEY, limit: int = 10
) -> DataFrame:
    """Touches so far in the current run, and whether this row is the first of them."""
    run = so_far(series(by))
    df = df.withColumn("__touch", touch)
    if isinstance(by, ChunkKey):
        df = scan_runs(df, by, F.col(f"{prefix}_changed"), counts={"__in_run": F.col("__touch")}).withColumn("__all", F.lit(None))
    else:
        df = df.withColumn("__all", F.sum("__touch").over(run))
        before = F.last(
            F.when(F.col(f"{prefix}_changed") == 1, F.col("__all") - F.col("__touch")), ignorenulls=True
        ).over(run)
        df = df.withColumn("__in_run", F.col("__all") - before)
    return df.withColumns(
        {
            first: ((F.col("__touch") == 1) & (F.col("__in_run") == 1)).cast("int"),
            count: F.least(F.col("__in_run"), F.lit(limit)).cast("int"),
        }
    ).drop("__touch", "__all", "__in_run")


#: Ages that phases are told by: no bar older than this needs its exact age.
_OLD = 9


@looks_back(1 + _OLD + 5)
def add_signal_cycle(df: DataFrame, fast: str = "ema_9", slow: str = "ema_21", by: Sequence[str] = KEY) -> DataFrame:
    """Direction, age and phase (0 start, 1 middle, 2 end) of the fast/slow regime, bars since the middle."""
    w = series(by)
    df = df.withColumn("signal_dir", direction(fast, slow))
    df = df.withColumn("__spread", F.abs(F.col(fast) - F.col(slow)))
    df = df.withColumn("__slope", diff("__spread", 3, w))
    df = df.withColumn("__slope3", roll_sum("__slope", 3, w))
    # Phases need ages up to _OLD only, so a short look back gives them; ages beyond are the scan's.
    df = df.withColumns({"__pos": F.row_number().over(w), "cycle_changed": _changed("signal_dir", by)})
    started = F.last(F.when(F.col("cycle_changed") == 1, F.col("__pos")), ignorenulls=True).over(so_far(w))
    df = df.withColumn("__age", F.least(F.col("__pos") - started, F.lit(_OLD)))
    phase = (
        F.when((F.col("__age") > 8) & (F.col("__slope3") < 0), 2)
        .when((F.col("__age") > 3) & (F.col("__slope") >= 0), 1)
        .otherwise(0)
    )
    df = df.withColumn("cycle_phase", phase)
    if isinstance(by, ChunkKey):
        middle = {"__since": F.col("cycle_phase") == 1}
        df = scan_runs(df, by, F.col("cycle_changed"), "cycle_id", "cycle_bar", marks=middle)
    else:
        mid = F.last(F.when(F.col("cycle_phase") == 1, F.col("__pos")), ignorenulls=True).over(so_far(w))
        df = add_runs(df.withColumn("__since", F.col("__pos") - mid), "signal_dir", "cycle", by)
    df = df.withColumns(
        {
            "cycle_age_clip": F.least(F.col("cycle_bar"), F.lit(60)),
            "phase_start": (F.col("cycle_phase") == 0).cast("int"),
            "phase_middle": (F.col("cycle_phase") == 1).cast("int"),
            "phase_end": (F.col("cycle_phase") == 2).cast("int"),
            "bars_since_mid": F.coalesce("__since", F.lit(0)),
        }
    )
    return df.drop("__spread", "__slope", "__slope3", "__pos", "__age", "__since")


@looks_back(lambda a: a["body_window"])
def add_cycle_touch(df: DataFrame, line: str = "ema_20", body_window: int = 200, body_min: int = 50, by: Sequence[str] = KEY) -> DataFrame:
    """First touch of the line per run, close crossing it, and a strong body in the run's direction."""
    w = series(by)
    df = add_run_touches(df, touches(line), "cycle", "first_touch_ma20", "cycle_touch_count", by)
    side = sign(F.coalesce(F.col("close") - F.col(line), F.lit(0.0)))
    df = df.withColumns({"__side": side, "__body": F.abs(F.col("close") - F.col("open"))})
    prev = F.coalesce(lag("__side", 1, w), F.lit(0))
    frame = w.rowsBetween(-body_window + 1, 0)
    cut = F.when(F.count("__body").over(frame) >= body_min, F.percentile("__body", 0.70).over(frame))
    df = df.withColumns(
        {
            "close_cross_ma20": ((prev != 0) & (F.col("__side") != 0) & (prev != F.col("__side"))).cast("int"),
            "strong_body": flag(F.col("__body") > cut),
        }
    )
    confirm = (F.col("strong_body") == 1) & (sign(F.col("close") - F.col("open")) == F.col("signal_dir"))
    return df.withColumn("strong_body_confirm", confirm.cast("int")).drop("__side", "__body")


@looks_back(3)
def add_ma_cycle(df: DataFrame, fast: str = "ema_5", slow: str = "ema_20", by: Sequence[str] = KEY) -> DataFrame:
    """Age, age buckets, spread and touches of the fast/slow regime; needs `norm_scale`."""
    w = series(by)
    p = "ma5_ma20"
    df = add_runs(df.withColumn(f"{p}_signal_dir", direction(fast, slow)), f"{p}_signal_dir", f"{p}_cycle", by)
    bar = F.col(f"{p}_cycle_bar")
    spread = safe_div(F.col(fast) - F.col(slow), F.col("norm_scale"))
    df = df.withColumn(f"{p}_spread_r", spread)
    df = df.withColumns(
        {
            f"{p}_cycle_bar_clip": F.least(bar, F.lit(120)),
            f"{p}_cycle_bar_log": F.log1p(bar.cast("double")),
            f"{p}_cycle_start": (bar == 0).cast("int"),
            f"{p}_cycle_age_0_3": (bar <= 3).cast("int"),
            f"{p}_cycle_age_4_10": bar.between(4, 10).cast("int"),
            f"{p}_cycle_age_11_30": bar.between(11, 30).cast("int"),
            f"{p}_cycle_age_31_plus": (bar >= 31).cast("int"),
            f"{p}_spread_slope_r": diff(f"{p}_spread_r", 3, w),
            f"{p}_price_extension_r": safe_div(F.col("close") - F.col(slow), F.col("norm_scale"))
            * F.col(f"{p}_signal_dir"),
        }
    )
    return add_run_touches(
        df, touches(slow), f"{p}_cycle", f"{p}_first_touch_ma20", f"{p}_touch_ma20_count_clip", by
    )


@looks_back(1)
def add_cycle_columns(
    df: DataFrame,
    prefix: str,
    reference: str,
    line: str | None = None,
    signal: str | None = None,
    norm: str = "norm_scale",
    by: Sequence[str] = KEY,
) -> DataFrame:
    """Fourteen cycle columns for a price/line crossing (`line`) or for a ready-made direction (`signal`).

    A price equal to the line, or a missing line, counts as up; a signal of 0 is a direction of its own.
    """
    if (line is None) == (signal is None):
        raise ValueError("give either line or signal")
    move = direction("close", line) if line else F.col(signal).cast("int")
    df = add_runs(df.withColumn(f"{prefix}_signal_dir", move), f"{prefix}_signal_dir", prefix, by)
    bar = F.col(f"{prefix}_bar")
    extension = safe_div(F.col("close") - F.col(reference), F.col(norm)) * F.col(f"{prefix}_signal_dir")
    df = df.withColumns(
        {
            f"{prefix}_bar_clip": F.least(bar, F.lit(120)),
            f"{prefix}_bar_log": F.log1p(bar.cast("double")),
            f"{prefix}_start": (bar == 0).cast("int"),
            f"{prefix}_age_0_3": (bar <= 3).cast("int"),
            f"{prefix}_age_4_10": bar.between(4, 10).cast("int"),
            f"{prefix}_age_11_30": bar.between(11, 30).cast("int"),
            f"{prefix}_age_31_60": bar.between(31, 60).cast("int"),
            f"{prefix}_age_61_plus": (bar >= 61).cast("int"),
            f"{prefix}_price_extension": extension,
        }
    )
    df = add_run_touches(
        df, touches(reference), prefix, f"{prefix}_first_touch_ref", f"{prefix}_touch_ref_count_clip", by
    )
    return df.drop(f"{prefix}_id")
