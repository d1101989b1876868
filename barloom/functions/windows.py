"""Window helpers over one ordered series per key.

The default key is (symbol, year): rolling state starts afresh each year. A
series of bars holds at most one row per time bucket, so such a group is
bounded by year / bucket width however many events were behind it. The
continuous form works on the overlapping chunks of `operators.chunks`, with
key (symbol, chunk); every helper takes the key as an argument.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from barloom.functions.scalars import col

KEY = ("symbol", "year")


def series(by: Sequence[str] = KEY, order: str = "ts") -> WindowSpec:
    return Window.partitionBy(*by).orderBy(order)


def trailing(w: WindowSpec, n: int, past_only: bool = False) -> WindowSpec:
    """Frame of the last n rows, ending at the current row or the one before it."""
    return w.rowsBetween(-n, -1) if past_only else w.rowsBetween(-n + 1, 0)


def so_far(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def lag(c: Column | str, k: int, w: WindowSpec) -> Column:
    return F.lag(col(c), k).over(w)


def diff(c: Column | str, k: int, w: WindowSpec) -> Column:
    return col(c) - lag(c, k, w)


def rolling(agg, c: Column | str, n: int, w: WindowSpec, min_periods: int | None = None, past_only: bool = False) -> Column:
    """agg over the last n rows; missing below min_periods (default n) known values."""
    c, frame = col(c), trailing(w, n, past_only)
    need = n if min_periods is None else min_periods
    return F.when(F.count(c).over(frame) >= need, agg(c).over(frame))


def roll_mean(c, n, w, min_periods=None, past_only=False) -> Column:
    return rolling(F.avg, c, n, w, min_periods, past_only)


def roll_std(c, n, w, min_periods=None, past_only=False) -> Column:
    return rolling(F.stddev_samp, c, n, w, min_periods, past_only)


def roll_sum(c, n, w, min_periods=None, past_only=False) -> Column:
    return rolling(F.sum, c, n, w, min_periods, past_only)


def roll_min(c, n, w, min_periods=None, past_only=False) -> Column:
    return rolling(F.min, c, n, w, min_periods, past_only)


def roll_max(c, n, w, min_periods=None, past_only=False) -> Column:
    return rolling(F.max, c, n, w, min_periods, past_only)


class ExactSums:
    """Rolling mean / sum / std of integer columns from running totals.

    A sliding frame is re-aggregated for every row, n*w work. The difference of
    two running totals is n work whatever the window, and on integers it does
    not drift. `prepare` adds count, sum and sum of squares per column and
    window; the builders below are then plain expressions.
    """

    def __init__(self, w: WindowSpec):
        self.w = w

    def prepare(
        self, df: DataFrame, names: Sequence[str], windows: Sequence[int], squares: bool = True, past_only: bool = False
    ) -> DataFrame:
        run, kinds = so_far(self.w), ("n", "s", "q") if squares else ("n", "s")
        totals = {}
        for name in names:
            # Sums of squares leave 64 bits soon: volumes of 1e10, or prices in fine units over a long series.
            x = F.coalesce(F.col(name), F.lit(0)).cast("decimal(19,0)")
            made = {"n": F.count(F.col(name)), "s": F.sum(x), "q": F.sum((x * x).cast("decimal(38,0)"))}
            totals |= {f"__{k}_{name}": made[k].over(run) for k in kinds}
        df = df.withColumns(totals)
        ends = {}
        for total in totals:
            now = F.coalesce(F.lag(total, 1).over(self.w), F.lit(0)) if past_only else F.col(total)
            for n in windows:
                then = F.coalesce(F.lag(total, n + 1 if past_only else n).over(self.w), F.lit(0))
                ends[f"{total}_{n}"] = now - then
        return df.withColumns(ends).drop(*totals)

    def count(self, name: str, n: int) -> Column:
        return F.col(f"__n_{name}_{n}")

    def sum(self, name: str, n: int, min_periods: int | None = None) -> Column:
        need = n if min_periods is None else min_periods
        return F.when(self.count(name, n) >= need, F.col(f"__s_{name}_{n}").cast("double"))

    def mean(self, name: str, n: int, min_periods: int | None = None) -> Column:
        return self.sum(name, n, min_periods) / self.count(name, n)

    def var(self, name: str, n: int, min_periods: int | None = None) -> Column:
        need = n if min_periods is None else min_periods
        k = self.count(name, n)
        whole = k.cast("decimal(19,0)")
        s, q = (F.col(f"__{kind}_{name}_{n}").cast("decimal(38,0)") for kind in ("s", "q"))
        spread = (whole * q).cast("decimal(38,0)") - (s * s).cast("decimal(38,0)")
        return F.when((k >= need) & (k > 1), spread.cast("double") / (k * (k - 1)).cast("double"))

    def std(self, name: str, n: int, min_periods: int | None = None) -> Column:
        return F.sqrt(self.var(name, n, min_periods))

    @staticmethod
    def drop(df: DataFrame) -> DataFrame:
        return df.drop(*[c for c in df.columns if c.startswith(("__n_", "__s_", "__q_"))])
