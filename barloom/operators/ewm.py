"""Exponentially weighted means, plus RSI / ATR / EMA columns built on them.

The recurrence y = (1-a) y + a x has no built-in window function. Within one
group it is evaluated by pandas on Arrow batches; across the chunks of a longer
series it is composed exactly: each chunk reports how it maps the value that
enters it to the value that leaves it, and those few maps are chained.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.scalars import safe_div
from barloom.functions.windows import KEY, diff, lag, series
from barloom.operators.chunks import CHUNK_ROWS, ChunkKey, looks_back, over_chunks, step
from barloom.session import materialise


@dataclass(frozen=True)
class Ewm:
    """Weighted mean of `source`; missing until `min_periods` known values were seen."""

    out: str
    source: str
    alpha: float
    min_periods: int = 0

    @staticmethod
    def span(out: str, source: str, span: int) -> "Ewm":
        return Ewm(out, source, 2.0 / (span + 1.0), span)

    @staticmethod
    def wilder(out: str, source: str, period: int) -> "Ewm":
        return Ewm(out, source, 1.0 / period, period)


def _schema(df: DataFrame, names: Sequence[str]) -> T.StructType:
    return T.StructType(df.schema.fields + [T.StructField(n, T.DoubleType()) for n in names])


@looks_back(0)
def add_ewm(df: DataFrame, specs: Sequence[Ewm], by: Sequence[str] = KEY, order: str = "ts") -> DataFrame:
    """Add one column per spec. State starts afresh in each group, unless the groups are chunks of a series."""
    if isinstance(by, ChunkKey):
        return _over_chunks(df, specs, by)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        for s in specs:
            mean = pdf[s.source].astype("float64").ewm(alpha=s.alpha, adjust=False, min_periods=s.min_periods)
            pdf[s.out] = mean.mean()
        return pdf

    return df.groupBy(*by).applyInPandas(run, _schema(df, [s.out for s in specs]))


def _seeded(values: np.ndarray, seed: float, alpha: float) -> np.ndarray:
    return pd.Series(np.concatenate(([seed], values))).ewm(alpha=alpha, adjust=False).mean().to_numpy()[1:]


def _over_chunks(df: DataFrame, specs: Sequence[Ewm], by: ChunkKey) -> DataFrame:
    """The same over a whole series of any length, chunk by chunk.

    Within a chunk the mean is linear in the value s that enters it:
    y = zero + gain * s, where `zero` is the response to s = 0 and `gain` the
    response to s = 1 with all inputs 0. Both are computed per chunk; the
    entering values follow from the ends of the rows each chunk owns, one row per chunk.
    """
    kept = df.columns
    names = [f"__{kind}_{s.out}" for s in specs for kind in ("zero", "gain", "seen")]
    flagged = df.withColumn("__live", by.live)

    def respond(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bar_idx", kind="stable")
        live = pdf["__live"].to_numpy(bool)
        for s in specs:
            x = pdf[s.source].to_numpy("float64", na_value=np.nan)[live]
            known = ~np.isnan(x)
            made = (_seeded(x, 0.0, s.alpha), _seeded(np.where(known, 0.0, np.nan), 1.0, s.alpha), np.cumsum(known).astype("float64"))
            for kind, values in zip(("zero", "gain", "seen"), made):
                column = np.full(len(live), np.nan)
                column[live] = values
                pdf[f"__{kind}_{s.out}"] = column
        return pdf

    local = materialise(flagged.groupBy(*by).applyInPandas(respond, _schema(flagged, names)), "ewm")
    # A chunk that owns no row hands on nothing of its own, but is handed what came before.
    ends = local.groupBy(*by).agg(
        *[F.max_by(n, F.when(by.owned, F.col("bar_idx"))).alias(n) for n in names],
        *[
            F.min_by(F.col(s.source).cast("double"), F.when(by.live & F.col(s.source).isNotNull(), F.col("bar_idx"))).alias(
                f"__first_{s.out}"
            )
            for s in specs
        ],
    )
    keys = [f for f in ends.schema.fields if f.name in by]
    enter = [T.StructField(f"__{k}_{s.out}", T.DoubleType()) for s in specs for k in ("enter", "before")]
    columns = [f.name for f in keys]

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        out = pdf[columns].copy()
        for s in specs:
            value, seen, enters, befores = np.nan, 0.0, [], []
            for zero, gain, n, first in zip(
                pdf[f"__zero_{s.out}"], pdf[f"__gain_{s.out}"], pdf[f"__seen_{s.out}"], pdf[f"__first_{s.out}"]
            ):
                # The first known value of a series seeds it.
                start = first if np.isnan(value) else value
                enters.append(start)
                befores.append(seen)
                if n > 0 or (n == 0 and not np.isnan(value)):
                    value = zero + gain * start
                seen += 0.0 if np.isnan(n) else n
            out[f"__enter_{s.out}"] = enters
            out[f"__before_{s.out}"] = befores
        return out

    carried = ends.groupBy(*by.series).applyInPandas(chain, T.StructType(keys + enter))
    joined = local.join(carried, list(by))
    values = []
    for s in specs:
        seen = F.col(f"__before_{s.out}") + F.col(f"__seen_{s.out}")
        y = F.col(f"__zero_{s.out}") + F.col(f"__gain_{s.out}") * F.col(f"__enter_{s.out}")
        values.append(F.when(by.live & (seen >= max(s.min_periods, 1)), y).alias(s.out))
    return joined.select(*kept, *values)


def add_ewm_continuous(
    df: DataFrame,
    specs: Sequence[Ewm],
    by: Sequence[str] = ("symbol",),
    order: str = "ts",
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Weighted means over whole series, in chunks."""
    return over_chunks(df, step(add_ewm, specs=specs), by=by, order=order, chunk_rows=chunk_rows)


def true_range(w) -> Column:
    """Largest of high-low and the two distances to the previous close; the first row has only high-low."""
    prev = lag("close", 1, w)
    return F.greatest(
        F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev)
    )


def rsi(gain: Column, loss: Column) -> Column:
    return 100.0 - 100.0 / (1.0 + safe_div(gain, loss))


@looks_back(1)
def add_smoothed(
    df: DataFrame,
    ema: Sequence[int] = (),
    rsi_periods: Sequence[int] = (),
    atr_periods: Sequence[int] = (),
    by: Sequence[str] = KEY,
    order: str = "ts",
) -> DataFrame:
    """EMA of close (`ema_<n>`), Wilder RSI (`rsi_<n>`) and Wilder ATR (`atr<n>`), in one pass over the series."""
    w = series(by, order)
    extra: dict[str, Column] = {}
    if rsi_periods:
        delta = diff("close", 1, w)
        extra["__up"] = F.when(delta.isNotNull(), F.greatest(delta, F.lit(0.0)))
        extra["__down"] = F.when(delta.isNotNull(), F.greatest(-delta, F.lit(0.0)))
    if atr_periods:
        extra["__tr"] = true_range(w)
    specs = [Ewm.span(f"ema_{n}", "close", n) for n in ema]
    for n in rsi_periods:
        specs += [Ewm.wilder(f"__gain{n}", "__up", n), Ewm.wilder(f"__loss{n}", "__down", n)]
    specs += [Ewm.wilder(f"atr{n}", "__tr", n) for n in atr_periods]
    out = add_ewm(df.withColumns(extra) if extra else df, specs, by, order)
    out = out.withColumns({f"rsi_{n}": rsi(F.col(f"__gain{n}"), F.col(f"__loss{n}")) for n in rsi_periods})
    return out.drop("__up", "__down", "__tr", *[f"__{k}{n}" for n in rsi_periods for k in ("gain", "loss")])
