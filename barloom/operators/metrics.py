"""Probability quality: everything is read from counts per distinct score.

Rows are folded to (group, score, rows, positives) first; ranking metrics then
use running totals over that table, so no step sorts all rows in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators.ordered import exact_quantiles, quantiles_of_runs, running_totals, value_runs

EPS = 2.220446049250313e-16


def _curve(df: DataFrame, by: Sequence[str], label: str, score: str, descending: bool) -> DataFrame:
    known = df.filter(F.col(label).isNotNull() & F.col(score).isNotNull() & ~F.isnan(score))
    return running_totals(
        known,
        by,
        [score],
        {"n": F.count(F.lit(1)), "pos": F.sum(F.col(label).cast("bigint"))},
        descending,
    )


def prob_metrics(df: DataFrame, by: Sequence[str], label: str = "label", score: str = "score") -> DataFrame:
    """samples, positive_rate, accuracy at 0.5; auc, brier and logloss only if both classes occur."""
    s, n, pos = F.col(score), F.col("n"), F.col("pos")
    neg = (n - pos).cast("double")
    neg_below = (F.col("cum_n") - F.col("cum_pos")).cast("double") - neg
    p = F.least(F.greatest(s, F.lit(EPS)), F.lit(1.0 - EPS))
    agg = _curve(df, by, label, score, False).groupBy(*by).agg(
        F.sum("n").alias("samples"),
        F.sum("pos").alias("__pos"),
        F.sum(F.when(s >= 0.5, pos).otherwise(n - pos)).alias("__right"),
        F.sum(F.when(s >= 0.5, n).otherwise(0)).alias("__pred"),
        F.sum(pos * (neg_below + neg / 2.0)).alias("__rank"),
        F.sum(pos * (1.0 - s) * (1.0 - s) + neg * s * s).alias("__sq"),
        F.sum(pos * F.log(p) + neg * F.log(1.0 - p)).alias("__ll"),
    )
    total, ones = F.col("samples"), F.col("__pos")
    both = (ones > 0) & (ones < total)
    return agg.select(
        *by,
        "samples",
        (ones / total).alias("positive_rate"),
        (F.col("__pred") / total).alias("pred_positive_rate"),
        (F.col("__right") / total).alias("accuracy"),
        F.when(both, F.col("__rank") / (ones.cast("double") * (total - ones))).alias("auc"),
        F.when(both, F.col("__sq") / total).alias("brier"),
        F.when(both, -F.col("__ll") / total).alias("logloss"),
    )


def avg_precision(df: DataFrame, by: Sequence[str], label: str = "label", score: str = "score") -> DataFrame:
    c = _curve(df, by, label, score, True)
    step = F.col("pos") / F.col("all_pos") * F.col("cum_pos") / F.col("cum_n")
    return c.filter("all_pos > 0").groupBy(*by).agg(F.sum(step).alias("avg_precision"))


def roc_points(df: DataFrame, by: Sequence[str], label: str = "label", score: str = "score") -> DataFrame:
    """(fpr, tpr) at every distinct score, plus the origin (threshold missing)."""
    c = _curve(df, by, label, score, True).filter("all_pos > 0 AND all_pos < all_n")
    tp, fp = F.col("cum_pos"), F.col("cum_n") - F.col("cum_pos")
    points = c.select(
        *by,
        F.col(score).alias("threshold"),
        (fp / (F.col("all_n") - F.col("all_pos"))).alias("fpr"),
        (tp / F.col("all_pos")).alias("tpr"),
    )
    origin = c.select(*by).distinct().select(
        *by, F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return points.unionByName(origin)


def pr_points(df: DataFrame, by: Sequence[str], label: str = "label", score: str = "score") -> DataFrame:
    """(recall, precision) at every distinct score, plus the closing point (0, 1) (threshold missing)."""
    c = _curve(df, by, label, score, True).filter("all_pos > 0")
    points = c.select(
        *by,
        F.col(score).alias("threshold"),
        (F.col("cum_pos") / F.col("all_pos")).alias("recall"),
        (F.col("cum_pos") / F.col("cum_n")).alias("precision"),
    )
    end = c.select(*by).distinct().select(
        *by, F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("recall"), F.lit(1.0).alias("precision")
    )
    return points.unionByName(end)


def prob_distribution(df: DataFrame, by: Sequence[str], score: str = "score") -> DataFrame:
    known = df.filter(F.col(score).isNotNull() & ~F.isnan(score))
    q = exact_quantiles(known, by, score, (0.50, 0.90, 0.95, 0.99), ("prob_p50", "prob_p90", "prob_p95", "prob_p99"))
    m = known.groupBy(*by).agg(F.avg(score).alias("prob_mean"), F.stddev_pop(score).alias("prob_std"))
    return m.join(q.drop("n"), list(by)) if by else m.crossJoin(q.drop("n"))


def edges_of_runs(runs: DataFrame, by: Sequence[str], value: str, bins: int = 10) -> DataFrame:
    """Distinct quantile edges per group as an array of at most bins + 1 numbers, read off `value_runs`."""
    names = [f"__e{i}" for i in range(bins + 1)]
    q = quantiles_of_runs(runs, by, value, [i / bins for i in range(bins + 1)], names)
    return q.select(*by, F.col("n").alias("edge_rows"), F.array_sort(F.array_distinct(F.array(*names))).alias("edges"))


def right_closed_bin(value: Column, edges: Column) -> Column:
    """1-based bin (edge, next edge]; the lowest value belongs to the first bin."""
    below = F.size(F.filter(edges, lambda e: e < value))
    return F.greatest(below, F.lit(1))


def left_closed_bin(value: Column, edges: Column) -> Column:
    """1-based bin [edge, next edge), the last bin closed; missing outside the edges."""
    reached = F.size(F.filter(edges, lambda e: e <= value))
    last = F.element_at(edges, -1)
    return F.when((value >= F.element_at(edges, 1)) & (value <= last), F.when(value == last, F.size(edges) - 1).otherwise(reached))


def calibration(df: DataFrame, by: Sequence[str], label: str = "label", score: str = "score", bins: int = 10) -> DataFrame:
    """Mean score and observed rate per quantile bin of the score; empty bins do not appear."""
    runs = value_runs(df, by, score, pos=F.sum(F.col(label).cast("bigint")))
    edges = edges_of_runs(runs, by, score, bins)
    # One row of `bins` edges per group; scores of a hot group are not gathered by its key.
    joined = runs.join(F.broadcast(edges), list(by)) if by else runs.crossJoin(F.broadcast(edges))
    binned = joined.withColumn("bin", right_closed_bin(F.col(score), F.col("edges")))
    return binned.groupBy(*by, "bin").agg(
        F.sum("n").alias("rows"),
        (F.sum(F.col(score) * F.col("n")) / F.sum("n")).alias("mean_score"),
        (F.sum("pos") / F.sum("n")).alias("observed_rate"),
    )


def confusion(df: DataFrame, threshold: float, by: Sequence[str] = (), label: str = "label", score: str = "score") -> DataFrame:
    """Counts for all four (label, pred) pairs, 0 where none."""
    counts = df.groupBy(*by).agg(
        *[
            F.sum(((F.col(label) == y) & ((F.col(score) >= threshold) == bool(p))).cast("bigint")).alias(f"__{y}{p}")
            for y in (0, 1)
            for p in (0, 1)
        ]
    )
    cells = F.array(
        *[
            F.struct(F.lit(y).alias("label"), F.lit(p).alias("pred"), F.col(f"__{y}{p}").alias("rows"))
            for y in (0, 1)
            for p in (0, 1)
        ]
    )
    return counts.select(*by, F.explode(cells).alias("c")).select(*by, "c.*")


def score_hist(df: DataFrame, bins: int = 40, by: Sequence[str] = ("label",), score: str = "score") -> DataFrame:
    """Equal-width histogram over the common range of the score; the last bin is closed."""
    folded = df.filter(F.col(score).isNotNull()).groupBy(*by, score).agg(F.count(F.lit(1)).alias("__n"))
    rng = df.agg(F.min(score).alias("__lo"), F.max(score).alias("__hi"))
    at = F.width_bucket(F.col(score), F.col("__lo"), F.col("__hi"), F.lit(bins))
    return (
        folded.crossJoin(F.broadcast(rng))
        .withColumn("bin", F.when(F.col("__lo") == F.col("__hi"), 1).otherwise(F.least(at, F.lit(bins))).cast("int"))
        .groupBy(*by, "bin")
        .agg(F.sum("__n").alias("rows"))
    )
