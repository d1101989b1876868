"""First-passage labels: which of two price levels is reached first within a horizon.

A join of every bar with its horizon makes n * H rows. Instead, bars are grouped
into blocks of `block` rows. A bar joins its own block (equal join, at most
`block` bars per block) and, if nothing is reached there, the later blocks whose
range reaches a level, up to the first one in which reaching is certain. In a
block of sound bars (low <= open <= high) it is, so each bar meets two blocks,
not H bars; unsound bars only make it meet further ones. All prices are compared
as exact multiples of 1e-8.

Series run on across years unless `by` holds the year: positions are numbered
slice by slice, and windows see chunks of blocks, never a whole series.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.scalars import UNIT, units
from barloom.operators.chunks import halo_chunks, trim, with_positions

BAR = ("candle", "open", "high", "low", "close")
#: Labels look ahead over the turn of the year; add "year" to restart each year.
SERIES = ("symbol",)


def _hit(bar: Column, by_gap: bool) -> Column:
    """Whether a bar decides the label of an entry with levels `__sl` and `__tp`."""
    sl, tp = F.col("__sl"), F.col("__tp")
    if not by_gap:
        return (bar["low"] <= sl) | (bar["high"] >= tp)

    def inside(level: Column) -> Column:
        return (bar["low"] <= level) & (level <= bar["high"])

    return inside(sl) | inside(tp) | (bar["open"] <= sl) | (bar["open"] >= tp)


def _prepared(bars: DataFrame, by: Sequence[str]) -> DataFrame:
    return with_positions(bars, by).withColumns({f"__{c}": units(c) for c in ("open", "high", "low", "close")})


def _levels(df: DataFrame, next_open: Column, r1: float) -> DataFrame:
    """Entry at the next bar's open, missing for the last two bars of the series, and the levels around it."""
    level = int(round(r1 * UNIT))
    entry = F.when(F.col("candle") < F.col("n_candles") - 2, next_open)
    return df.withColumn("__entry", entry).withColumns({"__sl": F.col("__entry") - level, "__tp": F.col("__entry") + level})


def _as_bar() -> Column:
    return F.struct(
        F.col("candle").alias("candle"), *[F.col(f"__{c}").alias(c) for c in ("open", "high", "low", "close")]
    )


def _blocks(base: DataFrame, by: Sequence[str], reach: int) -> DataFrame:
    """Bars per block, and of the `reach` blocks behind it: range, first open, and whether all their bars are sound."""
    sound = (F.col("__low") <= F.col("__open")) & (F.col("__open") <= F.col("__high"))
    blocks = base.groupBy(*by, "__block").agg(
        F.sort_array(F.collect_list(_as_bar())).alias("__bars"),
        F.min(F.least("__low", "__open")).alias("lo"),
        F.max(F.greatest("__high", "__open")).alias("hi"),
        F.min(sound).alias("sound"),
    )
    chunked = halo_chunks(blocks.withColumn("bar_idx", F.col("__block")), 0, reach)
    ahead = Window.partitionBy(*by, "chunk").orderBy("__block").rowsBetween(1, reach)
    told = F.struct(F.col("__block").alias("b"), "lo", "hi", "sound", F.get("__bars", F.lit(0))["open"].alias("open"))
    return trim(chunked.withColumn("__ahead", F.collect_list(told).over(ahead))).drop("bar_idx", "lo", "hi", "sound")


def first_touch(
    bars: DataFrame,
    r1: float,
    bars_ahead: int,
    by: Sequence[str] = SERIES,
    by_gap: bool = True,
    block: int | None = None,
) -> DataFrame:
    """Adds `candle`, `n_candles`, entry levels and `__at`, the deciding bar (missing if none) among the
    next `bars_ahead` bars.

    `by_gap` also lets an open beyond a level decide, and needs a level to lie inside
    the bar to count as reached.
    """
    block = block or max(8, int(math.sqrt(bars_ahead)))
    base = _prepared(bars, by).withColumn("__block", F.floor(F.col("candle") / F.lit(block)))
    blocks = _blocks(base, by, bars_ahead // block + 1)
    last = F.col("candle") + bars_ahead

    def first_in(inside: Column) -> Column:
        return F.get(F.filter(inside, lambda b: (b["candle"] > F.col("candle")) & (b["candle"] <= last) & _hit(b, by_gap)), 0)

    own = base.join(blocks, [*by, "__block"])
    inner = F.get("__bars", (F.col("candle") - F.col("__block") * block + 1).cast("int"))["open"]
    own = _levels(own, F.coalesce(inner, F.get("__ahead", F.lit(0))["open"]), r1)
    own = own.withColumn("__here", F.when(F.col("__entry").isNotNull(), first_in(F.col("__bars"))))
    reached = F.filter("__ahead", lambda s: (s["lo"] <= F.col("__sl")) | (s["hi"] >= F.col("__tp")))
    own = own.withColumn("__reached", F.when(F.col("__here").isNull() & F.col("__entry").isNotNull(), reached)).drop("__bars", "__ahead")
    # Behind the first sound block that reaches a level there is nothing to look for.
    certain = F.array_position(F.transform("__reached", lambda s: s["sound"]), F.lit(True)).cast("int")
    asked = F.when(certain > 0, F.slice("__reached", 1, certain)).otherwise(F.col("__reached"))
    asked = F.transform(asked, lambda s: s["b"])
    keys = [*by, "candle"]
    later = own.select(*keys, "__sl", "__tp", F.explode(asked).alias("__block")).join(blocks.drop("__ahead"), [*by, "__block"])
    later = later.select(*keys, first_in(F.col("__bars")).alias("__hit")).groupBy(*keys).agg(F.min("__hit").alias("__later"))
    joined = own.drop("__reached", "__block").join(later, keys, "left")
    return joined.withColumn("__at", F.coalesce("__here", "__later")).drop("__here", "__later")


def buy_labels(bars: DataFrame, r1: float = 6.0, horizon: int = 1440, by: Sequence[str] = SERIES, block: int | None = None) -> DataFrame:
    """Buy at the next open, levels r1 either side. `label` 1 / 0 / missing, `label_res` Win / Lose / No res.

    Scans the entry bar and `horizon` bars after it. A bar reaching both levels wins only if it closes
    below its open; otherwise a reached level decides; otherwise an open beyond a level does.
    """
    df = first_touch(bars, r1, horizon + 1, by, True, block)
    at, sl, tp = F.col("__at"), F.col("__sl"), F.col("__tp")
    hit_sl = (at["low"] <= sl) & (sl <= at["high"])
    hit_tp = (at["low"] <= tp) & (tp <= at["high"])
    label = (
        F.when(at.isNull(), None)
        .when(hit_tp & hit_sl, F.when(at["close"] < at["open"], 1).otherwise(0))
        .when(hit_tp, 1)
        .when(hit_sl, 0)
        .when(at["open"] <= sl, 0)
        .otherwise(1)
    )
    return df.withColumns(
        {
            "label": label.cast("int"),
            "entry_index": F.when(F.col("__entry").isNotNull(), F.col("candle") + 1).otherwise(-1),
            "entry_price": F.col("__entry") / float(UNIT),
        }
    ).withColumn(
        "label_res", F.when(F.col("label").isNull(), "No res").when(F.col("label") == 1, "Win").otherwise("Lose")
    ).drop(*[c for c in df.columns if c.startswith("__")])


def two_sided_labels(
    bars: DataFrame,
    r1: float = 6.0,
    horizon: int = 1440,
    skip_first: int = 250,
    by: Sequence[str] = SERIES,
    block: int | None = None,
) -> DataFrame:
    """`buy_label` +1 / -1 / 0 and its mirror `sell_label`. Scans `horizon` bars from the entry bar on.

    A level counts as reached when passed. A bar reaching both is a buy win if it closes at or above its open.
    """
    df = first_touch(bars, r1, horizon, by, False, block)
    at = F.col("__at")
    up, down = at["high"] >= F.col("__tp"), at["low"] <= F.col("__sl")
    label = (
        F.when(at.isNull() | (F.col("candle") < skip_first), 0)
        .when(up & down, F.when(at["close"] >= at["open"], 1).otherwise(-1))
        .when(up, 1)
        .otherwise(-1)
    )
    return df.withColumn("buy_label", label).withColumn("sell_label", -F.col("buy_label")).drop(
        *[c for c in df.columns if c.startswith("__")]
    )


def short_horizon_labels(bars: DataFrame, r1: float = 6.0, expired: int = 5, skip_first: int = 250, by: Sequence[str] = SERIES) -> DataFrame:
    """The two-sided label over expired + 2 bars: a few `lead`s instead of a join."""
    horizon = expired + 2
    numbered = _prepared(bars, by).withColumn("bar_idx", F.col("candle"))
    chunked = halo_chunks(numbered, 0, horizon)
    w = Window.partitionBy(*by, "chunk").orderBy("candle")
    base = _levels(chunked, F.lead("__open").over(w), r1)
    out = F.lit(None).cast("int")
    # Built from the far end so that the nearest bar is asked first.
    for k in range(horizon, 0, -1):
        hi, lo, op, cl = (F.lead(f"__{c}", k).over(w) for c in ("high", "low", "open", "close"))
        up, down = hi >= F.col("__tp"), lo <= F.col("__sl")
        out = (
            F.when(up & down, F.when(cl >= op, 1).otherwise(-1)).when(up, 1).when(down, -1).otherwise(out)
        )
    label = F.when((F.col("candle") < skip_first) | F.col("__entry").isNull(), 0).otherwise(F.coalesce(out, F.lit(0)))
    df = trim(base.withColumn("buy_label", label.cast("int")).withColumn("sell_label", -F.col("buy_label"))).drop("bar_idx")
    return df.drop(*[c for c in df.columns if c.startswith("__")])


def candidates(df: DataFrame, features: Sequence[str], years: Sequence[int] | None = None) -> DataFrame:
    """Rows with a signal, a known label and every feature known."""
    out = df.filter((F.col("buy_signal") == 1) & F.col("label").isNotNull()).dropna(subset=list(features))
    return out if years is None else out.filter(F.col("year").isin(list(years)))


# Training weight by age of the year, oldest first.
YEAR_WEIGHTS = (0.50, 0.75, 1.00, 1.25, 1.50)


def side_rows(
    df: DataFrame,
    label: str,
    signal: str,
    side: int,
    features: Sequence[str],
    years: Sequence[int],
    weights: Sequence[float] = YEAR_WEIGHTS,
) -> DataFrame:
    """Resolved rows of one side with every feature known, y = won, and the year's weight.

    Cap rows per year with `sampling.sample_n` (`by=("year",)`) on the result.
    """
    weight = F.lit(None).cast("double")
    for year, value in zip(years, weights):
        weight = F.when(F.col("year") == year, F.lit(value)).otherwise(weight)
    return (
        df.filter(F.col("year").isin(list(years)) & (F.col(label) != 0) & (F.col(signal) == side))
        .dropna(subset=list(features))
        .withColumns({"y": (F.col(label) == 1).cast("int"), "weight": weight})
    )
