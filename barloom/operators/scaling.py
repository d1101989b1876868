"""Fit/transform scalers and past-only rolling scalers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.scalars import finite, safe_div, to_feature
from barloom.functions.windows import KEY, roll_max, roll_min, roll_std, series, trailing
from barloom.operators.rolling_rank import Rank, add_ranks
from barloom.operators.wide import wide_quantiles
from barloom.session import materialise, small_table


def unpivot(df: DataFrame, features: Sequence[str], ids: Sequence[str] = ()) -> DataFrame:
    """Long form (ids, feature, value)."""
    typed = df.select(*ids, *[F.col(f).cast("double").alias(f) for f in features])
    return typed.unpivot(list(ids), list(features), "feature", "value")


# Tail quantiles the robust scaler clips to.
CLIP_LOW, CLIP_HIGH = 0.005, 0.995


def fit_robust(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row per feature: clip bounds, median and interquartile range of the clipped values.

    Quantiles commute with a monotone clip, so median and quartiles are those of the
    raw values clipped, unless they interpolate across a bound; the bounds lie
    outside the quartiles as soon as a feature has five known values.
    """
    rows = materialise(df.select(*[_known(f) for f in features]))
    found = wide_quantiles(rows, features, (CLIP_LOW, 0.25, 0.5, 0.75, CLIP_HIGH))
    stats = [(f, v[0], v[4], v[2], (v[3] - v[1]) or 1.0) for f, (n, v) in found.items() if n]
    return small_table(df.sparkSession, stats, "feature string, lower double, upper double, median double, scale double")


def _known(f: str) -> Column:
    """A feature as a double, NaN missing."""
    x = F.col(f).cast("double")
    return F.when(~F.isnan(x), x).alias(f)


def fit_standard(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Mean and population standard deviation per feature (0 becomes 1), in one aggregate over the wide rows."""
    aggs = []
    for f in features:
        aggs += [F.avg(f).alias(f"{f}__mean"), F.stddev_pop(f).alias(f"{f}__std")]
    row = df.agg(*aggs)
    pairs = [
        F.struct(F.lit(f).alias("feature"), F.col(f"{f}__mean").alias("mean"), F.col(f"{f}__std").alias("std"))
        for f in features
    ]
    out = row.select(F.explode(F.array(*pairs)).alias("s")).select("s.*")
    return out.select("feature", "mean", F.when(F.col("std") == 0, 1.0).otherwise(F.col("std")).alias("scale"))


def _as_row(stats: DataFrame, features: Sequence[str], names: Sequence[str]) -> DataFrame:
    return stats.agg(
        *[F.max(F.when(F.col("feature") == f, F.col(n))).alias(f"__{f}__{n}") for f in features for n in names]
    )


def apply_robust(df: DataFrame, stats: DataFrame, features: Sequence[str], suffix: str = "_scaled") -> DataFrame:
    """Clip, centre, scale; missing and non-finite results are 0. `stats` is one row per feature."""
    wide = _as_row(stats, features, ("lower", "upper", "median", "scale"))
    out = df.crossJoin(F.broadcast(wide))
    new = {}
    for f in features:
        x = F.least(F.greatest(F.col(f), F.col(f"__{f}__lower")), F.col(f"__{f}__upper"))
        x = F.when(F.col(f).isNotNull() & ~F.isnan(F.col(f)), x)
        new[f"{f}{suffix}"] = to_feature((x - F.col(f"__{f}__median")) / F.col(f"__{f}__scale"))
    return out.withColumns(new).drop(*wide.columns)


def apply_standard(df: DataFrame, stats: DataFrame, features: Sequence[str], suffix: str = "_scaled") -> DataFrame:
    wide = _as_row(stats, features, ("mean", "scale"))
    out = df.crossJoin(F.broadcast(wide))
    new = {f"{f}{suffix}": (F.col(f) - F.col(f"__{f}__mean")) / F.col(f"__{f}__scale") for f in features}
    return out.withColumns(new).drop(*wide.columns)


def add_roll_zscore(
    df: DataFrame,
    features: Sequence[str],
    passthrough: Sequence[str] = (),
    window: int = 500,
    min_periods: int = 100,
    eps: float = 1e-12,
    suffix: str = "_z",
    past_only: bool = True,
    by: Sequence[str] = KEY,
    order: str = "ts",
) -> DataFrame:
    """z of the current value against the rows before it; 0 when it or its history is missing or flat.

    Rows are the candidate rows of a series, so apply it after the candidate filter.
    """
    w = series(by, order)
    frame = trailing(w, window, past_only)
    clean = df.withColumns({f"__x_{f}": finite(F.col(f).cast("double")) for f in features})
    new: dict[str, Column] = {}
    for f in features:
        x = F.col(f"__x_{f}")
        if f in passthrough:
            new[f"{f}{suffix}"] = F.coalesce(x, F.lit(0.0))
            continue
        n, mean = F.count(x).over(frame), F.avg(x).over(frame)
        var = F.coalesce(F.var_samp(x).over(frame), F.lit(0.0))
        z = (x - mean) / F.sqrt(var)
        new[f"{f}{suffix}"] = F.when(x.isNotNull() & (n >= min_periods) & (var > eps), z).otherwise(0.0)
    return clean.withColumns(new).drop(*[f"__x_{f}" for f in features])


def add_wma_zscore(
    df: DataFrame,
    features: Sequence[str],
    window: int = 14,
    suffix: str = "__wmaz14p",
    past_only: bool = True,
    by: Sequence[str] = KEY,
    order: str = "ts",
) -> DataFrame:
    """Distance to the linearly weighted mean of the previous rows in units of their std.

    The whole window must be known. A flat window gives 0 at its own level, missing elsewhere.
    """
    w = series(by, order)
    first = 1 if past_only else 0
    clean = df.withColumns({f"__x_{f}": finite(F.col(f).cast("double")) for f in features})
    total = window * (window + 1) / 2
    step1 = {}
    for f in features:
        x = F.col(f"__x_{f}")
        # A missing lag makes the whole sum missing, as wanted.
        wma = sum(((window - k) * (F.lag(x, k + first).over(w) if k + first else x) for k in range(window)), F.lit(0.0))
        step1[f"__wma_{f}"] = wma / total
        step1[f"__std_{f}"] = roll_std(x, window, w, past_only=past_only)
    df = clean.withColumns(step1)
    new = {}
    for f in features:
        x, wma, std = F.col(f"__x_{f}"), F.col(f"__wma_{f}"), F.col(f"__std_{f}")
        z = F.when(F.abs(std) > 1e-12, (x - wma) / std).when(F.abs(x - wma) <= 1e-12, 0.0)
        new[f"{f}{suffix}"] = z
    df = df.withColumns(new)
    return df.drop(*[f"__{k}_{f}" for f in features for k in ("x", "wma", "std")])


UNSCALED_PREFIXES = ("sig_", "tod_", "dow_")
UNSCALED_NAMES = ("buy_signal", "session_london_ny", "session_ny")


def keep_unscaled(df: DataFrame, features: Sequence[str]) -> list[str]:
    """Time, signal and binary-like columns (no values but -1, 0, 1): read once, one row back to the driver."""
    named = [f for f in features if f.startswith(UNSCALED_PREFIXES) or f in UNSCALED_NAMES]
    rest = [f for f in features if f not in named]
    if not rest:
        return named
    other = [
        F.max((F.col(f).isNotNull() & ~F.col(f).isin(-1, 0, 1)).cast("int")).alias(f) for f in rest
    ]
    row = df.agg(*other).first().asDict()
    binary = {f for f in rest if not row[f]}
    return [f for f in features if f in named or f in binary]


def wma_scaling(df: DataFrame, features: Sequence[str], by: Sequence[str] = KEY) -> tuple[DataFrame, list[str]]:
    """WMA z-score of every feature but the unscaled ones; returns the frame and the model columns."""
    kept = keep_unscaled(df, features)
    scaled = [f for f in features if f not in kept]
    out = add_wma_zscore(df, scaled, by=by) if scaled else df
    return out, [f if f in kept else f"{f}__wmaz14p" for f in features]


SCALERS = ("zscore", "wma", "minmax", "rank")


def add_scaled(
    df: DataFrame,
    features: Sequence[str],
    method: str,
    window: int,
    min_periods: int,
    past_only: bool = True,
    passthrough: Sequence[str] = (),
    by: Sequence[str] = KEY,
    order: str = "ts",
) -> DataFrame:
    """One rolling scaler by name; adds `<feature>__<method>`, missing as 0."""
    if method not in SCALERS:
        raise ValueError(f"unknown scaler: {method}")
    suffix = f"__{method}"
    todo = [f for f in features if f not in passthrough]
    if method == "zscore":
        out = add_roll_zscore(df, todo, (), window, min_periods, suffix=suffix, past_only=past_only, by=by, order=order)
    elif method == "wma":
        out = add_wma_zscore(df, todo, window, suffix, past_only, by, order)
    elif method == "rank":
        kind = "past_mid" if past_only else "pct"
        out = add_ranks(df, [Rank(f"{f}{suffix}", f, window, min_periods, kind) for f in todo], by, order)
    else:
        w = series(by, order)
        new = {}
        for f in todo:
            lo = roll_min(f, window, w, min_periods, past_only)
            hi = roll_max(f, window, w, min_periods, past_only)
            new[f"{f}{suffix}"] = safe_div(F.col(f) - lo, hi - lo)
        out = df.withColumns(new)
    cleaned = {f"{f}{suffix}": to_feature(f"{f}{suffix}") for f in todo}
    cleaned |= {f"{f}{suffix}": to_feature(f) for f in passthrough}
    return out.withColumns(cleaned)
