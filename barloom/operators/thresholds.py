"""Threshold tables, yearly and monthly win tables, threshold choice, objectives and audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.scalars import winrate

# Narrow and wide threshold grids.
GRID = tuple(round(0.50 + 0.01 * i, 2) for i in range(11))


def threshold_table(
    df: DataFrame,
    thresholds: Sequence[float] = GRID,
    by: Sequence[str] = ("year",),
    score: str = "score",
    label: str = "label",
    allowed: Column | None = None,
) -> DataFrame:
    """resolved, wins, losses and winrate for every (threshold, group), also those with no rows.

    A row is folded to the highest grid step its score reaches, so rows are read once and never
    multiplied by the grid; the steps are then added up from the top.
    """
    grid = sorted(thresholds)
    step = sum(((F.col(score) >= t).cast("int") for t in grid), F.lit(0))
    use = F.lit(True) if allowed is None else F.coalesce(allowed, F.lit(False))
    ok = use & F.col(label).isNotNull() & F.col(score).isNotNull() & ~F.isnan(score)
    folded = df.groupBy(*by, F.when(ok, step).otherwise(0).alias("__step")).agg(
        F.sum((ok & (F.col(label) == 1)).cast("bigint")).alias("__w"),
        F.sum((ok & (F.col(label) == 0)).cast("bigint")).alias("__l"),
    )
    # At most len(grid) + 1 rows per group here; spread each over the steps it reaches, at least one row
    # per (threshold, group) comes from the zero rows.
    levels = F.array(*[F.struct(F.lit(i + 1).alias("i"), F.lit(float(t)).alias("threshold")) for i, t in enumerate(grid)])
    spread = folded.withColumn("__lv", F.explode(levels))
    hit = F.col("__step") >= F.col("__lv.i")
    out = spread.groupBy(F.col("__lv.threshold").alias("threshold"), *by).agg(
        F.sum(F.when(hit, F.col("__w")).otherwise(0)).alias("wins"),
        F.sum(F.when(hit, F.col("__l")).otherwise(0)).alias("losses"),
    )
    return out.withColumn("resolved", F.col("wins") + F.col("losses")).withColumn(
        "winrate", winrate("wins", "resolved")
    )


def threshold_totals(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per threshold over all years; winrate in percent, missing without rows."""
    out = curve.groupBy(*by, "threshold").agg(
        F.sum("resolved").alias("resolved"),
        F.sum("wins").alias("wins"),
        F.sum("losses").alias("losses"),
        F.min("resolved").alias("min_year_deals"),
    )
    return out.withColumn("winrate", F.col("wins") * 100.0 / F.nullif("resolved", F.lit(0)))


def yearly_total(yearly: DataFrame, sums: Sequence[str], maxima: Sequence[str] = ()) -> DataFrame:
    """Yearly rows plus a TOTAL row; winrate recomputed from the totals."""
    aggs = [F.sum(c).alias(c) for c in sums] + [F.max(c).alias(c) for c in maxima]
    out = yearly.rollup("year").agg(*aggs, F.grouping("year").alias("__total"))
    name = F.when(F.col("__total") == 1, "TOTAL").otherwise(F.col("year").cast("string"))
    out = out.withColumn("year", name).drop("__total")
    return out.withColumn("winrate", winrate("wins", "resolved"))


def win_table(df: DataFrame, by: Sequence[str], threshold: float, score: str = "score", label: str = "label") -> DataFrame:
    """resolved, wins and winrate (percent, unrounded) per group at one threshold; groups without hits stay."""
    hit = F.coalesce(F.col(score) >= threshold, F.lit(False))
    out = df.groupBy(*by).agg(
        F.sum(hit.cast("bigint")).alias("resolved"),
        F.sum(F.when(hit, F.col(label).cast("bigint")).otherwise(0)).alias("wins"),
    )
    rate = F.when(F.col("resolved") > 0, F.col("wins") * 100.0 / F.col("resolved")).otherwise(0.0)
    return out.withColumns({"threshold": F.lit(float(threshold)), "winrate": rate})


def gate_scan(df: DataFrame, gates: Sequence[str], by: str = "split", label: str = "label") -> DataFrame:
    """rows, wins, losses, winrate and coverage of each 0/1 gate column per split; one aggregate over wide rows."""
    aggs = [F.count(F.lit(1)).alias("__all")]
    for g in gates:
        on = F.col(g) == 1
        aggs += [
            F.sum(on.cast("bigint")).alias(f"{g}__rows"),
            F.sum((on & (F.col(label) == 1)).cast("bigint")).alias(f"{g}__wins"),
            F.sum((on & (F.col(label) == 0)).cast("bigint")).alias(f"{g}__losses"),
        ]
    wide = df.groupBy(by).agg(*aggs)
    structs = [
        F.struct(
            F.lit(g.removeprefix("gate_")).alias("gate"),
            *[F.col(f"{g}__{k}").alias(k) for k in ("rows", "wins", "losses")],
        )
        for g in gates
    ]
    out = wide.select(by, "__all", F.explode(F.array(*structs)).alias("s")).select(by, "__all", "s.*")
    out = out.withColumn("resolved", F.col("wins") + F.col("losses"))
    return out.withColumns(
        {"winrate": winrate("wins", "resolved"), "coverage": winrate("rows", "__all")}
    ).drop("__all")


def gate_pivot(scan: DataFrame, splits: Sequence[str], by: str = "split") -> DataFrame:
    """One row per gate: winrate and resolved of every split side by side."""
    def wide(value: str, suffix: str) -> DataFrame:
        p = scan.groupBy("gate").pivot(by, list(splits)).agg(F.first(value))
        return p.select("gate", *[F.col(s).alias(f"{s}{suffix}") for s in splits])

    return wide("winrate", "_wr").join(wide("resolved", "_resolved"), "gate")


def compare_curves(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("threshold", "year"), values: Sequence[str] = ("resolved", "winrate")) -> DataFrame:
    """Full outer join of two curves and their differences (second - first)."""
    left = a.select(*keys, *[F.col(v).alias(f"{v}_a") for v in values])
    right = b.select(*keys, *[F.col(v).alias(f"{v}_b") for v in values])
    out = left.join(right, list(keys), "full_outer")
    return out.withColumns({f"{v}_diff": F.col(f"{v}_b") - F.col(f"{v}_a") for v in values})


# --- choosing a threshold: the table has one row per grid step ---------------------------------------

# Rule -> (lowest resolved, highest resolved, target resolved, weight of the distance).
CHOICES = {
    "a": (2200, None, None, 0.0),
    "b": (3000, 6500, 4200, 1.0),
    "c": (2200, None, 3000, 3.0),
    "e": (2200, None, 3500, 1.0),
}


def _best(table: DataFrame, tier: Column, order: Sequence[Column], by: Sequence[str] = ()) -> DataFrame:
    """Keep the rows of the best tier present, then the first in order."""
    part = Window.partitionBy(*by)
    ranked = table.withColumn("__tier", tier).withColumn("__rn", F.row_number().over(part.orderBy("__tier", *order)))
    return ranked.filter("__rn = 1").drop("__tier", "__rn")


def pick_threshold(
    totals: DataFrame,
    rule: str,
    by: Sequence[str] = (),
    lowest: int | None = None,
    highest: int | None = None,
    target: int | None = None,
) -> DataFrame:
    """Best threshold by win rate, less the relative distance of `resolved` to a target.

    Rows outside the bounds count only if no row is inside. Bounds default to the rule's.
    """
    lo, hi, goal, weight = CHOICES[rule]
    lo = lo if lowest is None else lowest
    hi = hi if highest is None else highest
    goal = goal if target is None else target
    r, rate = F.col("resolved"), F.col("winrate")
    inside = r >= lo if hi is None else r.between(lo, hi)
    score = rate if goal is None else rate - F.lit(weight) * F.abs(r - goal) / F.lit(float(goal))
    order = [F.desc_nulls_last("score")]
    if goal is not None:
        order.append(F.desc_nulls_last("winrate"))
    order += [F.desc("resolved"), F.asc("threshold")]
    return _best(totals.withColumn("score", score), F.when(inside, 0).otherwise(1), order, by)


def pick_threshold_guarded(totals: DataFrame, lowest: int, target: int, highest: int, by: Sequence[str] = ()) -> DataFrame:
    """Within [lowest, highest] by win rate less distance to target; else above lowest by the same;
    else the step with most resolved rows."""
    r = F.col("resolved")
    tier = F.when(r.between(lowest, highest), 0).when(r >= lowest, 1).otherwise(2)
    score = F.col("winrate") - F.abs(r - target) / F.lit(float(target))
    scored = totals.withColumn("score", F.when(r >= lowest, score))
    order = [
        F.desc_nulls_last("score"),
        F.desc_nulls_last(F.when(r >= lowest, F.col("winrate"))),
        F.desc("resolved"),
        F.desc_nulls_last("winrate"),
        F.asc("threshold"),
    ]
    return _best(scored, tier, order, by)


def totals_at(curve: DataFrame, threshold: float, by: Sequence[str] = ()) -> DataFrame:
    out = curve.filter(F.abs(F.col("threshold") - threshold) < 1e-9).groupBy(*by).agg(
        F.sum("resolved").alias("resolved"),
        F.sum("wins").alias("wins"),
        F.sum("losses").alias("losses"),
        F.min("resolved").alias("min_year_deals"),
    )
    return out.withColumn("winrate", winrate("wins", "resolved"))


def run_objectives(
    curve: DataFrame,
    auc: DataFrame,
    chosen: DataFrame,
    by: Sequence[str],
    last_years: tuple[int, int, int],
    lowest: int = 3000,
    target: int = 4200,
    highest: int = 6500,
) -> DataFrame:
    """Six run scores from the chosen threshold's totals, its yearly rows and the AUC.

    `chosen` has (by, threshold), `auc` has (by, auc). `last_years` are the three years whose volume
    the `volume` score asks for.
    """
    rows = curve.join(chosen.select(*by, F.col("threshold").alias("__t")), list(by)).filter(
        F.abs(F.col("threshold") - F.col("__t")) < 1e-9
    )
    y1, y2, y3 = last_years

    def of_year(y: int) -> Column:
        return F.coalesce(F.max(F.when(F.col("year") == y, F.col("resolved"))), F.lit(0))

    t = rows.groupBy(*by).agg(
        F.sum("resolved").alias("resolved"),
        F.sum("wins").alias("wins"),
        F.min("resolved").alias("min_year_deals"),
        F.stddev_samp("winrate").alias("wr_std"),
        F.min("winrate").alias("min_wr"),
        F.min(F.when(F.col("winrate") != 0, F.col("winrate"))).alias("min_known_wr"),
        (F.greatest(F.lit(0), 3000 - of_year(y1)) + F.greatest(F.lit(0), 3000 - of_year(y2))).alias("short_12"),
        F.greatest(F.lit(0), 1200 - of_year(y3)).alias("short_3"),
    )
    t = t.withColumn("wr", winrate("wins", "resolved")).join(auc.select(*by, "auc"), list(by))
    r, wr, a = F.col("resolved").cast("double"), F.col("wr"), F.col("auc")
    m = F.col("min_year_deals")

    def above(x: Column) -> Column:
        return F.greatest(F.lit(0.0), x)

    near = above(1.0 - F.abs(r - 8500) / 8500.0)
    volume = (
        wr + 4.0 * near + 2.0 * a - 0.65 * F.coalesce("wr_std", F.lit(0.0))
        - 1.25 * above(54.0 - F.col("min_wr")) - (0.0015 * F.col("short_12") + 0.0005 * F.col("short_3"))
    )
    known = F.coalesce("min_known_wr", F.lit(0.0))
    stable = (
        wr + (a - 0.5) * 100.0 - above(7000 - r) / 220.0 - above(r - 12000) / 500.0
        - above((1000 - m).cast("double")) / 55.0 - above(55.0 - known) * 1.15
    )
    edge = (
        wr + 2.0 * F.least(F.lit(1.0), r / 7000.0) + 2.0 * a - 0.45 * F.coalesce("wr_std", F.lit(10.0))
        - above((1000 - m).cast("double")) / 300.0
    )
    too_many = above(r - highest) / float(highest)
    full = F.least(F.lit(1.0), r / float(target))
    sparse = F.lit(-100.0) + r / F.lit(float(max(1, lowest)))
    guarded = F.when(r < lowest, sparse).otherwise(
        wr + 2.0 * a + 2.0 * full - above(lowest - r) / 600.0 - too_many
    )
    valid = F.when(r < lowest, sparse).otherwise(wr + 2.0 * a + 2.0 * full - too_many)
    balanced = wr + 6.0 * near + 3.0 * F.least(F.lit(1.0), m / 2500.0) + 2.0 * a
    return t.select(
        *by,
        "resolved",
        "wr",
        balanced.alias("objective_balanced"),
        volume.alias("objective_volume"),
        stable.alias("objective_stable"),
        edge.alias("objective_edge"),
        guarded.alias("objective_guarded"),
        valid.alias("objective_valid"),
    )


# --- audits --------------------------------------------------------------------------------------------


def bar_audit(bars: DataFrame, by: Sequence[str] = ("symbol", "year"), gap_minutes: float = 1.5) -> DataFrame:
    """rows, first and last bar, repeated times, incomplete rows, high below low, gaps and the largest gap (minutes)."""
    w = Window.partitionBy(*by).orderBy("ts")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = (at - F.lag(at).over(w)) / 60_000_000.0
    df = bars.withColumn("__gap", gap)
    missing = F.col("open").isNull() | F.col("high").isNull() | F.col("low").isNull() | F.col("close").isNull()
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("ts").alias("start"),
        F.max("ts").alias("end"),
        F.sum(F.coalesce((F.col("__gap") == 0).cast("bigint"), F.lit(0))).alias("duplicate_dates"),
        F.sum(missing.cast("bigint")).alias("missing_base_rows"),
        F.sum(F.coalesce((F.col("high") < F.col("low")).cast("bigint"), F.lit(0))).alias("high_lt_low"),
        F.sum(F.coalesce((F.col("__gap") > gap_minutes).cast("bigint"), F.lit(0))).alias("gaps"),
        F.max("__gap").alias("max_gap_min"),
    )


def label_audit(df: DataFrame, by: Sequence[str] = ("year",)) -> DataFrame:
    """rows, signals, resolved labels, wins, losses and win rate per group."""
    out = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.col("buy_signal").cast("bigint")).alias("buy_candidates"),
        F.count("label").alias("resolved"),
        F.count(F.when(F.col("label") == 1, 1)).alias("wins"),
        F.count(F.when(F.col("label") == 0, 1)).alias("losses"),
    )
    rate = F.round(F.col("wins") * 100.0 / F.nullif("resolved", F.lit(0)), 4)
    return out.withColumn("resolved_wr_pct", rate)


FORBIDDEN = ("label", "label_res", "entry_index", "entry_price")
SUSPECT_PARTS = ("future", "next", "target", "label", "entry")


def leakage_checks(df: DataFrame, features: Sequence[str], order: str = "ts", split: str = "split") -> DataFrame:
    """Named checks: no forbidden or suspicious feature names, and splits that follow one another in time."""
    forbidden = not set(features) & set(FORBIDDEN)
    suspects = not [f for f in features if any(p in f.lower() for p in SUSPECT_PARTS)]

    def edge(agg, name: str) -> Column:
        return agg(F.when(F.col(split) == name, F.col(order)))

    row = df.agg(
        (edge(F.max, "train") < edge(F.min, "valid")).alias("a"),
        (edge(F.max, "valid") < edge(F.min, "test")).alias("b"),
    )
    checks = F.array(
        F.struct(F.lit("no_forbidden_columns_in_features").alias("check"), F.lit(forbidden).cast("int").alias("ok")),
        F.struct(F.lit("no_future_name_suspects").alias("check"), F.lit(suspects).cast("int").alias("ok")),
        F.struct(F.lit("train_before_valid").alias("check"), F.col("a").cast("int").alias("ok")),
        F.struct(F.lit("valid_before_test").alias("check"), F.col("b").cast("int").alias("ok")),
    )
    return row.select(F.explode(checks).alias("c")).select("c.*")
