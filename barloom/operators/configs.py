"""Configuration sweeps: grids, per-year evaluation, summaries and constrained top-k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions.scalars import SESSION_MODES, winrate
from barloom.session import materialise

KEYS = ("group", "buy_threshold", "sell_threshold", "entry_mode", "min_phase", "side_mode", "session_mode")


def config_grid(
    spark: SparkSession,
    groups: Sequence[str],
    buy: Sequence[float],
    sell: Sequence[float],
    entry_modes: Sequence[str],
    phases: Sequence[int] = (0, 1),
    sides: Sequence[str] = ("both", "buy_only", "sell_only"),
    sessions: Sequence[str] = tuple(SESSION_MODES),
) -> DataFrame:
    """Every combination of the settings; its size is set by the lists given, not by data."""
    dims = [
        ("group", "string", groups),
        ("buy_threshold", "double", buy),
        ("sell_threshold", "double", sell),
        ("entry_mode", "string", entry_modes),
        ("min_phase", "int", phases),
        ("side_mode", "string", sides),
        ("session_mode", "string", sessions),
    ]
    # One row exploded setting by setting: no joins, and a handful of tasks whatever the grid.
    out = spark.range(0, 1, 1, 1)
    for name, kind, values in dims:
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v).cast(kind) for v in values])))
    return out.drop("id")


def fold_rows(
    rows: DataFrame,
    groups: dict[str, tuple[str, str]],
    modes: dict[str, Column],
    buy: Sequence[float],
    sell: Sequence[float],
) -> DataFrame:
    """Candidate rows to counts per (group, year, month, hour, phase, side, mode flags, score step).

    `rows` has year, month, hour, phase, side (+1 / -1), won (1 / -1 / 0 unresolved) and the score columns
    named in `groups` as (buy score, sell score). All keys have small fixed ranges, so after this one
    aggregate nothing grows with the number of rows.
    """
    def step(score: Column, grid: Sequence[float]) -> Column:
        return sum(((score >= t).cast("int") for t in sorted(grid)), F.lit(0))

    per_group = F.array(
        *[
            F.struct(
                F.lit(g).alias("group"),
                F.when(F.col("side") == 1, step(F.col(b), buy)).otherwise(step(F.col(s), sell)).alias("step"),
            )
            for g, (b, s) in groups.items()
        ]
    )
    flags = [F.coalesce(c, F.lit(False)).cast("int").alias(f"mode_{m}") for m, c in modes.items()]
    long = rows.select("year", "month", "hour", "phase", "side", "won", *flags, F.explode(per_group).alias("g"))
    keys = ["year", "month", "hour", "phase", "side", *[f"mode_{m}" for m in modes]]
    return long.groupBy(F.col("g.group").alias("group"), F.col("g.step").alias("step"), *keys).agg(
        F.count(F.lit(1)).alias("raw"),
        F.sum((F.col("won") == 1).cast("bigint")).alias("wins"),
        F.sum((F.col("won") == -1).cast("bigint")).alias("losses"),
    )


def _by_side(folded: DataFrame, side: int, grid: Sequence[float], modes: Sequence[str], phases: Sequence[int], sessions: Sequence[str]) -> DataFrame:
    """Counts of one side per (group, threshold, entry mode, min phase, session mode, year)."""
    thresholds = F.array(*[F.struct(F.lit(i + 1).alias("i"), F.lit(float(t)).alias("t")) for i, t in enumerate(sorted(grid))])
    mode_rows = F.array(*[F.struct(F.lit(m).alias("m"), F.col(f"mode_{m}").alias("on")) for m in modes])
    windows = F.array(
        *[
            F.struct(F.lit(s).alias("s"), *[F.lit(v).alias(k) for k, v in zip(("h0", "h1", "last"), SESSION_MODES[s])])
            for s in sessions
        ]
    )
    spread = (
        folded.filter(F.col("side") == side)
        .withColumn("e", F.explode(mode_rows)).filter("e.on = 1")
        .withColumn("p", F.explode(F.array(*[F.lit(p) for p in phases]))).filter("phase >= p")
        .withColumn("w", F.explode(windows)).filter("hour BETWEEN w.h0 AND w.h1 AND month <= w.last")
    )
    # Fold again before the threshold steps are spread.
    spread = spread.groupBy("group", "year", "step", F.col("e.m").alias("entry_mode"), F.col("p").alias("min_phase"), F.col("w.s").alias("session_mode")).agg(
        *[F.sum(c).alias(c) for c in ("raw", "wins", "losses")]
    )
    return (
        spread.withColumn("t", F.explode(thresholds)).filter("step >= t.i")
        .groupBy("group", F.col("t.t").alias("threshold"), "entry_mode", "min_phase", "session_mode", "year")
        .agg(*[F.sum(c).alias(c) for c in ("raw", "wins", "losses")])
    )


def evaluate_configs(
    folded: DataFrame, grid: DataFrame, years: Sequence[int], buy: Sequence[float], sell: Sequence[float],
    modes: Sequence[str], phases: Sequence[int], sessions: Sequence[str],
) -> DataFrame:
    """Per (config, year): raw, resolved, wins, losses, winrate. Every config has every year.

    A config is a buy part plus a sell part, each looked up once, so the thresholds of the two sides are
    never multiplied against rows.
    """
    # Read once per side; without this the rows themselves would be scanned twice.
    folded = materialise(folded)
    scaffold = grid.withColumn("year", F.explode(F.array(*[F.lit(y) for y in years])))
    shared = ["group", "entry_mode", "min_phase", "session_mode", "year"]
    parts = []
    for side, name, steps in ((1, "buy", buy), (-1, "sell", sell)):
        part = _by_side(folded, side, steps, modes, phases, sessions)
        parts.append(
            part.select(
                *shared,
                F.col("threshold").alias(f"{name}_threshold"),
                *[F.col(c).alias(f"__{name}_{c}") for c in ("raw", "wins", "losses")],
            )
        )
    out = scaffold.join(parts[0], [*shared, "buy_threshold"], "left").join(parts[1], [*shared, "sell_threshold"], "left")

    def total(c: str) -> Column:
        b = F.when(F.col("side_mode") != "sell_only", F.coalesce(f"__buy_{c}", F.lit(0))).otherwise(0)
        s = F.when(F.col("side_mode") != "buy_only", F.coalesce(f"__sell_{c}", F.lit(0))).otherwise(0)
        return (b + s).cast("bigint")

    out = out.select(*KEYS, "year", *[total(c).alias(c) for c in ("raw", "wins", "losses")])
    return out.withColumn("resolved", F.col("wins") + F.col("losses")).withColumn("winrate", winrate("wins", "resolved", 2))


def config_summary(per_year: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Worst year, weighted rate and volumes per config."""
    out = per_year.groupBy(*keys).agg(
        F.min("winrate").alias("min_winrate"),
        F.min("resolved").alias("min_resolved"),
        F.sum("resolved").alias("total_resolved"),
        F.sum("wins").alias("total_wins"),
        F.sum("losses").alias("total_losses"),
    )
    return out.withColumn("weighted_winrate", winrate("total_wins", "total_resolved", 2))


def pending(grid: DataFrame, done: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Configs of the grid that are not done."""
    return grid.join(done.select(*keys).distinct(), list(keys), "left_anti")


ORDER = ("min_winrate", "weighted_winrate", "min_resolved", "total_resolved")


def _order(keys: Sequence[str], by: Sequence[str] = ORDER) -> list[Column]:
    return [*[F.desc(c) for c in by], *[F.asc(k) for k in keys]]


def best_configs(
    summary: DataFrame, tiers: Sequence[Column], limit: int = 10, keys: Sequence[str] = KEYS
) -> DataFrame:
    """The best `limit` rows of the first tier that has any; rows of no tier are the last resort.

    The tier present is one aggregate; the top rows are taken by `orderBy().limit()`, which keeps
    `limit` rows per task.
    """
    tier: Column = F.lit(len(tiers))
    for i in range(len(tiers) - 1, -1, -1):
        tier = F.when(F.coalesce(tiers[i], F.lit(False)), i).otherwise(tier)
    marked = summary.withColumn("__tier", tier)
    first = marked.agg(F.min("__tier").alias("__first"))
    return (
        marked.crossJoin(F.broadcast(first))
        .filter("__tier = __first")
        .drop("__tier", "__first")
        .orderBy(*_order(keys))
        .limit(limit)
    )


def train_tiers(low: int = 3000, rate: float = 55.0) -> list[Column]:
    """Enough volume and rate in the worst year."""
    return [(F.col("min_resolved") >= low) & (F.col("min_winrate") >= rate)]


def proxy_tiers(low: int = 3000, mid: int = 10000, high: int = 30000, rate: float = 55.0, lower_rate: float = 54.0) -> list[Column]:
    """First-half sessions with volume and rate; then any session with more volume; then most volume, lower rate."""
    n, wr = F.col("min_resolved"), F.col("min_winrate")
    return [
        F.col("session_mode").startswith("h1_") & (n >= low) & (wr >= rate),
        (n >= mid) & (wr >= rate),
        (n >= high) & (wr >= lower_rate),
    ]


def band_eligible(summary: DataFrame, low: int = 3000, floor: int = 15000, ceiling: int = 60000, rate: float = 55.0) -> DataFrame:
    """Volume and rate in the worst year, more volume if any has it, not above a ceiling if any is below."""
    n, wr = F.col("min_resolved"), F.col("min_winrate")
    good = (n >= low) & (wr >= rate)
    tier = F.when(good & (n >= floor), 0).when(good, 1).when(n >= low, 2).otherwise(3)
    marked = summary.withColumn("__tier", tier)
    first = marked.agg(F.min("__tier").alias("__first"))
    kept = marked.crossJoin(F.broadcast(first)).filter("__tier = __first")
    practical = kept.agg(F.max((n <= ceiling).cast("int")).alias("__any"))
    return kept.crossJoin(F.broadcast(practical)).filter((F.col("__any") == 0) | (n <= ceiling)).drop(
        "__tier", "__first", "__any"
    )


def diversified_topk(
    rows: DataFrame, family: Sequence[str], limit: int, order: Sequence[str] = ORDER[:3], keys: Sequence[str] = KEYS
) -> DataFrame:
    """Best first, but until half the places are filled only the best row of each family; `place` from 1.

    A row is taken if it leads its family or if enough family leaders came before it. The running
    count is only needed for rows near the top: at most limit // 2 leaders and the rows after them.
    """
    half = limit // 2
    by_rank = _order(keys, order)
    leads = F.row_number().over(Window.partitionBy(*family).orderBy(*by_rank)) == 1
    marked = rows.withColumn("__lead", leads.cast("int"))
    leaders = marked.filter("__lead = 1").orderBy(*by_rank).limit(limit)
    # The half-th leader is the point after which any row may be taken; at most `limit` rows follow it.
    spot = Window.orderBy(*by_rank)
    pivot = leaders.withColumn("__r", F.row_number().over(spot)).filter(F.col("__r") == max(half, 1))
    names = [*order, *keys]
    pivot = pivot.select(*[F.col(c).alias(f"__p_{c}") for c in names])
    after: Column = F.lit(False)
    for c in reversed(names):
        better = F.col(c) < F.col(f"__p_{c}") if c in order else F.col(c) > F.col(f"__p_{c}")
        after = better | ((F.col(c) == F.col(f"__p_{c}")) & after)
    later = marked.crossJoin(F.broadcast(pivot)).filter(after | F.lit(half == 0)).drop(*pivot.columns)
    later = later.filter("__lead = 0").orderBy(*by_rank).limit(limit)
    picked = leaders.unionByName(later)
    return (
        picked.withColumn("place", F.row_number().over(spot)).filter(F.col("place") <= limit).drop("__lead")
    )
