"""Positions within a series, overlapping chunks of bounded length, and chains of operators over them.

The (symbol, year) key restarts rolling state each year. For state that runs
on across years, `halo_chunks` cuts a series of any length into chunks of
`chunk_rows` rows; each chunk also holds the rows just before and after it that
its windows look at, so every chunk is computed alone and only its core rows
are kept.

`over_chunks` does this once around a chain of operators. An operator says with
`looks_back` how many rows its windows reach back; the reaches of a chain add
up to the halo. Operators with state of no finite reach (weighted means, runs
of a direction) are given a `ChunkKey`: it tells from which row of a chunk on
their inputs are whole, and which rows each chunk answers for when the state is
handed from chunk to chunk.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.windows import KEY
from barloom.session import materialise

CHUNK_ROWS = 65_536


def with_candle(df: DataFrame, by: Sequence[str] = KEY, order: str = "ts") -> DataFrame:
    """0-based position within the series and the series length."""
    w = Window.partitionBy(*by)
    return df.withColumns(
        {
            "candle": F.row_number().over(w.orderBy(order)) - 1,
            "n_candles": F.count(F.lit(1)).over(w),
        }
    )


def with_bar_idx(df: DataFrame, by: Sequence[str] = ("symbol",), order: str = "ts", slice_days: int = 28) -> DataFrame:
    """0-based position over a whole series, numbered slice by slice.

    Rows are counted per (series, time slice); the counts, one row per slice,
    give each slice its start; rows are numbered within their slice only.
    """
    seconds = F.unix_seconds(F.col(order).cast("timestamp"))
    sliced = materialise(df.withColumn("__slice", F.floor(seconds / F.lit(86_400 * slice_days))))
    counts = sliced.groupBy(*by, "__slice").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*by).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    inside = Window.partitionBy(*by, "__slice").orderBy(order)
    numbered = sliced.withColumn("__rn", F.row_number().over(inside))
    return (
        numbered.join(starts, [*by, "__slice"])
        .withColumn("bar_idx", F.col("__start") + F.col("__rn") - 1)
        .drop("__slice", "__rn", "__start")
    )


def with_positions(df: DataFrame, by: Sequence[str], order: str = "ts") -> DataFrame:
    """`candle` and `n_candles` as `with_candle` gives them, without one window over a series of any length.

    Series keyed by year are bounded and numbered in one window; others are numbered slice by slice.
    """
    if "year" in by:
        return with_candle(df, by, order)
    numbered = with_bar_idx(df, by, order).withColumnRenamed("bar_idx", "candle")
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_candles"))
    return numbered.join(sizes, list(by))


def halo_chunks(df: DataFrame, back: int, forward: int = 0, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Copy each row into every chunk that looks at it. Needs `bar_idx`; adds `chunk` and `is_core`."""
    first = F.greatest(F.floor((F.col("bar_idx") - forward) / F.lit(chunk_rows)), F.lit(0))
    last = F.floor((F.col("bar_idx") + back) / F.lit(chunk_rows))
    return df.withColumn("chunk", F.explode(F.sequence(first, last))).withColumn(
        "is_core", F.floor(F.col("bar_idx") / F.lit(chunk_rows)) == F.col("chunk")
    )


def trim(df: DataFrame) -> DataFrame:
    return df.filter("is_core").drop("is_core", "chunk")


class ChunkKey(tuple):
    """Window key of overlapping chunks: the series' columns and `chunk`.

    Chunk k holds rows k * rows - back up to (k + 1) * rows - 1 of its series. `used` of the halo's rows have been
    looked back over by the operators before: from `start` on a chunk's values are whole.
    """

    rows: int
    back: int
    used: int

    def __new__(cls, series: Sequence[str], rows: int, back: int, used: int = 0) -> ChunkKey:
        if not 0 <= used <= back <= rows:
            raise ValueError(f"chunks of {rows} rows can't carry a halo of {back} rows, {used} of them used")
        self = super().__new__(cls, (*series, "chunk"))
        self.rows, self.back, self.used = rows, back, used
        return self

    @property
    def series(self) -> tuple[str, ...]:
        return tuple(self[:-1])

    def after(self, rows: int) -> ChunkKey:
        """The key behind an operator that looks `rows` back (less than nothing: ahead of its last windows)."""
        return ChunkKey(self.series, self.rows, self.back, self.used + rows)

    @property
    def live(self) -> Column:
        """Rows on which state is worked out."""
        return F.col("bar_idx") >= F.col("chunk") * self.rows - (self.back - self.used)

    @property
    def owned(self) -> Column:
        """Of those, the rows that no later chunk starts with: every row of the series is owned once."""
        return self.live & (F.col("bar_idx") < (F.col("chunk") + 1) * self.rows - (self.back - self.used))


def looks_back(rows: int | Callable[[dict], int]) -> Callable:
    """Declare how many rows an operator's windows reach back, as a number or a function of its arguments."""

    def mark(op: Callable) -> Callable:
        op.looks_back = rows
        return op

    return mark


def look_back(op: Callable, options: dict) -> int:
    """Rows that `op` called with `options` reaches back."""
    if not hasattr(op, "looks_back"):
        raise ValueError(f"{op.__name__} does not declare how far it looks back")
    if isinstance(op.looks_back, int):
        return op.looks_back
    bound = inspect.signature(op).bind_partial(None, **options)
    bound.apply_defaults()
    return op.looks_back(bound.arguments)


@dataclass(frozen=True)
class Step:
    """An operator of a chain and its options (all but the frame and `by`)."""

    op: Callable[..., DataFrame]
    options: dict = field(default_factory=dict)

    def reach(self) -> int:
        return look_back(self.op, self.options)

    def run(self, df: DataFrame, by: Sequence[str]) -> DataFrame:
        takes_key = "by" in inspect.signature(self.op).parameters
        return self.op(df, **self.options, **({"by": by} if takes_key else {}))


def step(op: Callable[..., DataFrame], **options) -> Step:
    return Step(op, options)


def over_chunks(df: DataFrame, *steps: Step, by: Sequence[str] = ("symbol",), order: str = "ts", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """A chain of operators over whole series of any length, in chunks with one halo around the chain.

    Adds `bar_idx` where it is missing. Results do not depend on `chunk_rows`, which is raised to the chain's reach.
    """
    reaches = [s.reach() for s in steps]
    back = sum(reaches)
    indexed = df if "bar_idx" in df.columns else with_bar_idx(df, by, order)
    key = ChunkKey(by, max(chunk_rows, back, 1), back)
    out = halo_chunks(indexed, back, chunk_rows=key.rows)
    for s, reach in zip(steps, reaches):
        key = key.after(reach)
        out = s.run(out, key)
    return trim(out)
