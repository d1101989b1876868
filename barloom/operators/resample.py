"""Higher-timeframe bars, their features, and the backward as-of join onto base bars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.scalars import POINT
from barloom.functions.windows import KEY, diff, roll_std, roll_sum, series
from barloom.operators.ewm import add_smoothed
from barloom.sources.bars import bucket_ceil, epoch_to_ts


def resample(bars: DataFrame, seconds: int, by: Sequence[str] = KEY) -> DataFrame:
    """Right-closed, right-labelled OHLC; buckets without bars do not appear."""
    return (
        bars.groupBy(*by, bucket_ceil(F.col("ts"), seconds).alias("__end"))
        .agg(
            F.min_by("open", "ts").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "ts").alias("close"),
        )
        .withColumn("ts", epoch_to_ts(F.col("__end")))
        .select(*by, "ts", "open", "high", "low", "close")
    )


def htf_features(
    htf: DataFrame,
    prefix: str,
    spans: Sequence[int] = (8, 21, 55),
    rsi_period: int = 14,
    windows: Sequence[int] = (3, 6, 12),
    by: Sequence[str] = KEY,
) -> DataFrame:
    w = series(by)
    df = add_smoothed(htf, ema=spans, rsi_periods=(rsi_period,), by=by)
    df = df.withColumn("__ret", diff("close", 1, w) * POINT)
    new = {
        f"{prefix}_ret": (F.col("close") - F.col("open")) * POINT,
        f"{prefix}_range": (F.col("high") - F.col("low")) * POINT,
        f"{prefix}_rsi_{rsi_period}": F.col(f"rsi_{rsi_period}"),
    }
    for n in windows:
        new[f"{prefix}_ret_sum_{n}"] = roll_sum("__ret", n, w)
        new[f"{prefix}_volatility_{n}"] = roll_std("__ret", n, w)
    for n in spans:
        new[f"{prefix}_ema_dist_{n}"] = (F.col("close") - F.col(f"ema_{n}")) * POINT
        new[f"{prefix}_ema_slope_{n}"] = diff(f"ema_{n}", 1, w) * POINT
    return df.select(*by, "ts", *[c.alias(n) for n, c in new.items()])


def asof_backward(left: DataFrame, right: DataFrame, by: Sequence[str] = KEY, order: str = "ts") -> DataFrame:
    """For each left row the latest right row at or before it; left rows without one get missing values.

    A union and one window instead of a range join: n + m rows shuffled once.
    """
    values = [c for c in right.columns if c not in (*by, order)]
    own = [c for c in left.columns if c not in (*by, order)]
    keys = [*by, order]
    a = left.select(*keys, F.lit(1).alias("__side"), F.struct(*own).alias("__own"))
    b = right.select(*keys, F.lit(0).alias("__side"), F.struct(*values).alias("__right"))
    both = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy(order, "__side").rowsBetween(Window.unboundedPreceding, 0)
    return (
        both.withColumn("__last", F.last("__right", ignorenulls=True).over(w))
        .filter("__side = 1")
        .select(*keys, "__own.*", *[F.col(f"__last.{c}").alias(c) for c in values])
    )
