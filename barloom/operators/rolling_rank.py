"""Rank of the current value among the rows before it.

Ranks over a sliding window need the window's order, which no built-in
aggregate keeps up to date; a pandas pass per (bounded) group does, in
O(log window) per row, for any number of columns at once.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from barloom.functions.windows import KEY


@dataclass(frozen=True)
class Rank:
    """`past_mid`: mid-rank among the previous `window` rows, in [-1, 1].
    `pct`: average-tie percent rank within the last `window` rows, current included."""

    out: str
    source: str
    window: int
    min_periods: int
    kind: str = "past_mid"


def _rank(x: pd.Series, spec: Rank) -> pd.Series:
    if spec.kind == "pct":
        return x.rolling(spec.window, min_periods=spec.min_periods).rank(pct=True)
    if spec.kind == "past_mid":
        # With the current row in the window its average rank is less + equal/2 + 1.
        frame = x.rolling(spec.window + 1, min_periods=spec.min_periods + 1)
        known = frame.count() - 1
        return ((frame.rank() - 1) / known - 0.5) * 2
    raise ValueError(f"unknown rank kind: {spec.kind}")


def add_ranks(df: DataFrame, specs: Sequence[Rank], by: Sequence[str] = KEY, order: str = "ts") -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        for s in specs:
            pdf[s.out] = _rank(pdf[s.source].astype("float64"), s)
        return pdf

    schema = T.StructType(df.schema.fields + [T.StructField(s.out, T.DoubleType()) for s in specs])
    return df.groupBy(*by).applyInPandas(run, schema)
