"""Queries for models and model-based selection, on the scored lines. Models are kept small; rows are not."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import metrics, models
from barloom.plans.common import FEATURES, SCORED, query
from barloom.plans.metric_queries import split_rows

FS = [*FEATURES, "late", "session"]
SMALL = {"trees": 10, "depth": 4, "min_leaf": 50, "subsample": 0.8}


def rows(spark, sf_dir):
    """Lines with a label trees can learn something about: large discounts late in the year return more often."""
    df = split_rows(spark, sf_dir)
    late = F.month("ts").cast("double")
    mark = F.pmod(F.xxhash64("l_orderkey", "l_linenumber", "l_extendedprice"), F.lit(100))
    cut = F.lit(30) + F.col("l_discount") * 300 + F.when(late >= 7, 15).otherwise(0)
    return df.withColumns({"late": late, "label": (mark < cut).cast("int"), "session": F.col("session").cast("double")})


def parts(spark, sf_dir):
    df = rows(spark, sf_dir)
    return df.filter("split = 'train'"), df.filter("split = 'valid'"), df.filter("split = 'test'")


@query("rf_scores")
def rf_scores(spark, sf_dir):
    """Weighted forest; its quality per split."""
    df = rows(spark, sf_dir)
    model = models.fit_forest(models.balanced(df.filter("split = 'train'")), FS, weight="weight", **SMALL)
    return metrics.prob_metrics(models.score(df, model, FS, "p"), ["split"], "label", "p")


@query("gbt_scores")
def gbt_scores(spark, sf_dir):
    """Boosted trees stopping on the validation year; quality per split."""
    df = rows(spark, sf_dir)
    fit = df.filter("split <> 'test'").withColumn("is_valid", F.col("split") == "valid")
    model = models.fit_boosting(fit, FS, "is_valid", iterations=8, depth=3, step=0.2)
    return metrics.prob_metrics(models.score(df, model, FS, "p"), ["split"], "label", "p")


@query("score_frame")
def score_frame(spark, sf_dir):
    """Every line keeps a row; those missing a feature get no score."""
    return score_frame_rows(spark, sf_dir).select("l_orderkey", "l_linenumber", "ts", "p")


def score_frame_rows(spark, sf_dir):
    df = rows(spark, sf_dir)
    model = models.fit_forest(df.filter("split = 'train'"), FS, **SMALL)
    holed = df.withColumn("l_tax", F.when(F.col("l_linenumber") != 7, F.col("l_tax")))
    return models.score(holed, model, FS, "p")


@query(
    "score_missing",
    f"""WITH {SCORED} SELECT split, count(*) AS rows, count(*) FILTER (l_linenumber <> 7) AS scored, 0::BIGINT AS outside
      FROM scored GROUP BY split""",
)
def score_missing(spark, sf_dir):
    """Per split: rows that come back, those with a score, scores that are no probability."""
    scored = score_frame_rows(spark, sf_dir)
    p = F.col("p")
    return scored.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"), F.count(p).alias("scored"), F.count(F.when((p < 0) | (p > 1), 1)).alias("outside")
    )


@query("param_search")
def param_search(spark, sf_dir):
    train, _, _ = parts(spark, sf_dir)
    grid = {"depth": [2, 4], "min_leaf": [50]}
    return models.param_search(train, FS, grid, ["ts", "l_orderkey"], folds=2, trees=5, subsample=0.8)


@query("l1_select")
def l1_select(spark, sf_dir):
    train, valid, _ = parts(spark, sf_dir)
    return models.l1_select(train, valid, FS, [0.001, 0.05], protected=["l_tax"], max_features=5)


@query("rf_select")
def rf_select(spark, sf_dir):
    train, _, _ = parts(spark, sf_dir)
    _, table = models.forest_select(train, FS, 3, protected=["l_tax"], **SMALL)
    return table


@query("rfe_select")
def rfe_select(spark, sf_dir):
    train, _, _ = parts(spark, sf_dir)
    return models.rfe_select(train, FS, ["ts", "l_orderkey"], folds=2, step=2, min_features=2, trees=5, depth=3, min_leaf=50)


@query("block_selection")
def block_selection(spark, sf_dir):
    train, valid, _ = parts(spark, sf_dir)
    order = models.feature_order(FS, ("discount",))
    return models.block_selection(train, valid, order, 3, 2, **SMALL)


@query("perm_importance")
def perm_importance(spark, sf_dir):
    train, _, test = parts(spark, sf_dir)
    model = models.fit_forest(train, FS, **SMALL)
    return models.permutation_importance(test, model, FS, repeats=1)


@query("partial_dependence")
def partial_dependence(spark, sf_dir):
    train, valid, _ = parts(spark, sf_dir)
    model = models.fit_forest(train, FS, **SMALL)
    return models.partial_dependence(valid, model, FS, "l_discount")
