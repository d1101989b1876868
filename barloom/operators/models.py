"""Tree and linear classifiers on Spark ML, scoring, searches and model-based explanation.

Frames hold numeric feature columns, a 0/1 label and optionally a weight. Loops
here run over models, folds or features - never over rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import product
from operator import or_

from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.scalars import to_feature
from barloom.operators.metrics import prob_metrics
from barloom.operators.sampling import class_weights, in_order, sample_n, strat_fold_ids, ts_fold_bounds
from barloom.operators.shuffling import number_rows, row_cuts, shuffled_position
from barloom.session import materialise, small_table

VECTOR = "__features"


def assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Feature vector; missing and non-finite values as 0."""
    clean = df.withColumns({f"__f_{f}": to_feature(f) for f in features})
    vec = VectorAssembler(inputCols=[f"__f_{f}" for f in features], outputCol=VECTOR).transform(clean)
    return vec.drop(*[f"__f_{f}" for f in features])


def staged_vectors(df: DataFrame, features: Sequence[str], *columns: str) -> DataFrame:
    """Features, other columns and the feature vector, written once.

    A fit passes over its rows several times. Where many fits see the same rows, none of them assembles vectors again.
    """
    return materialise(assemble(df, features).select(*dict.fromkeys([*features, *columns]), VECTOR), "vectors")


def narrowed(rows: DataFrame, features: Sequence[str], kept: Sequence[str]) -> DataFrame:
    """The rows with vectors of the `kept` ones among their features, in that order."""
    if list(kept) == list(features):
        return rows
    cut = VectorSlicer(inputCol=VECTOR, outputCol="__kept", indices=[features.index(f) for f in kept]).transform(rows)
    return cut.drop(VECTOR).withColumnRenamed("__kept", VECTOR)


def balanced(df: DataFrame, label: str = "label", out: str = "weight") -> DataFrame:
    """Weight n / (classes * n_class) per row; the weight table has one row per class."""
    weights = class_weights(df, label).select(label, F.col("weight").alias(out))
    return df.join(F.broadcast(weights), label)


def fit_forest(train: DataFrame, features: Sequence[str], label: str = "label", **params) -> Model:
    return fit_forest_vectors(assemble(train, features), label, **params)


def fit_forest_vectors(
    train: DataFrame,
    label: str = "label",
    weight: str | None = None,
    trees: int = 300,
    depth: int = 10,
    min_leaf: int = 500,
    subsample: float = 0.8,
    subset: str = "sqrt",
    seed: int = 271828,
) -> Model:
    est = RandomForestClassifier(
        featuresCol=VECTOR,
        labelCol=label,
        numTrees=trees,
        maxDepth=depth,
        minInstancesPerNode=min_leaf,
        subsamplingRate=subsample,
        featureSubsetStrategy=subset,
        seed=seed,
    )
    if weight:
        est = est.setWeightCol(weight)
    return est.fit(train)


def fit_boosting(
    rows: DataFrame,
    features: Sequence[str],
    is_valid: str,
    label: str = "label",
    iterations: int = 100,
    depth: int = 4,
    step: float = 0.05,
    subsample: float = 0.8,
    min_leaf: int = 100,
    seed: int = 7,
) -> Model:
    """Boosted trees; rows where `is_valid` holds only decide when to stop (on loss)."""
    est = GBTClassifier(
        featuresCol=VECTOR,
        labelCol=label,
        maxIter=iterations,
        maxDepth=depth,
        stepSize=step,
        subsamplingRate=subsample,
        minInstancesPerNode=min_leaf,
        validationIndicatorCol=is_valid,
        seed=seed,
    )
    return est.fit(assemble(rows, features))


def score(df: DataFrame, model: Model, features: Sequence[str], out: str = "score") -> DataFrame:
    """Probability of class 1; missing where any feature is missing. No row is dropped."""
    scored = score_vectors(assemble(df, features), model, features, out)
    return scored.select(*[c for c in df.columns if c != out], out)


def score_vectors(rows: DataFrame, model: Model, features: Sequence[str], out: str = "score") -> DataFrame:
    """As `score`, of rows that hold their feature vectors."""
    known = F.lit(True)
    for f in features:
        known = known & F.col(f).isNotNull()
    p = vector_to_array(F.col("probability"))[1]
    # The probability straight from the features: no raw votes and no predicted class beside it.
    scored = model.copy({model.rawPredictionCol: "", model.predictionCol: ""}).transform(rows)
    # Exploded: a filter on a plain column would be pushed below it, and every condition would walk the trees again.
    return scored.select(*[c for c in rows.columns if c != out], F.explode(F.array(F.when(known, p))).alias(out))


def auc(df: DataFrame, label: str = "label", score_col: str = "score") -> float:
    """AUC of the scored rows; 0.5 where it has no value (no rows, or one class only)."""
    value = prob_metrics(df, (), label, score_col).first()["auc"]
    return 0.5 if value is None else value


def importances(model: Model, features: Sequence[str], spark) -> DataFrame:
    rows = [(f, float(v)) for f, v in zip(features, model.featureImportances.toArray())]
    return small_table(spark, rows, "feature string, importance double")


def forest_select(
    train: DataFrame, features: Sequence[str], top_n: int, protected: Sequence[str] = (), **params
) -> tuple[list[str], DataFrame]:
    model = fit_forest(train, features, **params)
    table = importances(model, features, train.sparkSession)
    ranked = [r.feature for r in table.orderBy(F.desc("importance"), "feature").collect()]
    picked = list(dict.fromkeys([*[f for f in features if f in set(protected)], *ranked[:top_n]]))
    return picked, table.withColumn("selected", F.col("feature").isin(picked).cast("int"))


def l1_fit(train: DataFrame, features: Sequence[str], c: float, label: str = "label", balance: bool = True) -> DataFrame:
    """L1 logistic coefficients at inverse strength `c`."""
    rows = balanced(train, label, "__w") if balance else train.withColumn("__w", F.lit(1.0))
    total = rows.agg(F.sum("__w")).first()[0]
    est = LogisticRegression(
        featuresCol=VECTOR,
        labelCol=label,
        weightCol="__w",
        elasticNetParam=1.0,
        regParam=1.0 / (c * total),
        standardization=False,
        maxIter=200,
        tol=1e-6,
    )
    coef = est.fit(assemble(rows, features)).coefficients.toArray()
    data = [(f, float(v), abs(float(v))) for f, v in zip(features, coef)]
    return small_table(train.sparkSession, data, "feature string, l1_coef double, abs_l1_coef double")


def l1_select(
    train: DataFrame,
    valid: DataFrame,
    features: Sequence[str],
    grid: Sequence[float],
    protected: Sequence[str] = (),
    min_features: int = 1,
    max_features: int | None = None,
    label: str = "label",
) -> DataFrame:
    """Per grid value: features kept and validation AUC; `chosen` marks the best AUC among allowed sizes."""
    spark, rows = train.sparkSession, []
    for c in grid:
        table = l1_fit(train, features, c, label).collect()
        weights = {r.feature: r.l1_coef for r in table}
        kept = [f for f in features if abs(weights[f]) > 1e-9 or f in set(protected)]
        linear = sum((to_feature(f) * F.lit(weights[f]) for f in features), F.lit(0.0))
        rows.append((float(c), len(kept), ",".join(kept), auc(valid.withColumn("score", linear), label)))
    allowed = [r for r in rows if min_features <= r[1] and (max_features is None or r[1] <= max_features)] or rows
    best = max(allowed, key=lambda r: (r[3], -r[1]))
    out = [(*r, int(r is best)) for r in rows]
    return small_table(spark, out, "c double, n_features int, features string, valid_auc double, chosen int")


def rfe_select(
    df: DataFrame,
    features: Sequence[str],
    order: Sequence[str],
    folds: int = 3,
    step: int = 1,
    min_features: int = 1,
    label: str = "label",
    **params,
) -> DataFrame:
    """Drop the weakest features step by step; AUC over expanding time folds decides how many stay.

    `rank` 1 marks the features of the best step, larger ranks were dropped earlier.
    """
    keep = list(dict.fromkeys([*features, label, *order]))
    rows = staged_vectors(in_order(df.select(*keep), order), features, label, "__id")
    id_at, n = row_cuts(rows)
    bounds, at = [(id_at(end), id_at(test_end)) for end, test_end in ts_fold_bounds(n, folds)], F.col("__id")
    history, left = [], list(features)
    while True:
        scores, weights = [], {f: 0.0 for f in left}
        for end, test_end in bounds:
            train, test = rows.filter(at < end), rows.filter((at >= end) & (at < test_end))
            model = fit_forest_vectors(narrowed(train, features, left), label, **params)
            scores.append(auc(score_vectors(narrowed(test, features, left), model, left), label))
            for f, v in zip(left, model.featureImportances.toArray()):
                weights[f] += float(v)
        history.append((list(left), sum(scores) / folds))
        if len(left) <= min_features:
            break
        drop = sorted(left, key=lambda f: (weights[f], f))[: min(step, len(left) - min_features)]
        left = [f for f in left if f not in drop]
    best = max(range(len(history)), key=lambda i: (history[i][1], i))
    chosen = set(history[best][0])
    rows = []
    for f in features:
        last = max(i for i, (names, _) in enumerate(history) if f in names)
        rows.append((f, 1 if f in chosen else best - last + 1, int(f in chosen), history[last][1]))
    return small_table(df.sparkSession, rows, "feature string, rank int, selected int, cv_auc double")


# Name parts that put a feature first, then by kind.
def feature_order(columns: Sequence[str], core: Sequence[str]) -> list[str]:
    kinds = (
        lambda c: any(t in c for t in core),
        lambda c: "_lag" in c,
        lambda c: "cycle" in c or "rank" in c,
        lambda c: any(t in c for t in ("width", "rollmean", "rollstd")),
        lambda c: True,
    )
    return sorted(columns, key=lambda c: next(i for i, kind in enumerate(kinds) if kind(c)))


def block_selection(
    train: DataFrame, valid: DataFrame, features: Sequence[str], size: int, carry: int, label: str = "label", **params
) -> DataFrame:
    """Fit block after block of features together with the best `carry` so far."""
    spark, best, rows = train.sparkSession, [], []
    for at in range(0, len(features), size):
        block = list(dict.fromkeys([*best, *features[at : at + size]]))
        model = fit_forest(train, block, label, **params)
        value = dict(zip(block, model.featureImportances.toArray()))
        best = sorted(block, key=lambda f: (-value[f], f))[:carry]
        rows.append((at // size, len(block), ",".join(best), auc(score(valid, model, block), label)))
    return small_table(spark, rows, "block int, n_features int, carried string, valid_auc double")


def param_search(
    df: DataFrame,
    features: Sequence[str],
    grid: dict[str, Sequence],
    order: Sequence[str],
    folds: int = 3,
    label: str = "label",
    **fixed,
) -> DataFrame:
    """Mean AUC over contiguous stratified folds for every combination of forest settings."""
    keep = list(dict.fromkeys([*features, label, *order]))
    split = staged_vectors(in_order(df.select(*keep), [label, *order]), features, label, *order, "__id")
    parts, at, rows = strat_fold_ids(split, folds, label, order), F.col("__id"), []

    def of(*chosen: int) -> DataFrame:
        held = [(at >= lo) & (at < hi) for k in chosen for lo, hi in parts[k]]
        return split.filter(reduce(or_, held, F.lit(False)))

    for combo in product(*grid.values()):
        params = dict(zip(grid, combo))
        scores = []
        for k in range(folds):
            model = fit_forest_vectors(of(*[f for f in range(folds) if f != k]), label, **params, **fixed)
            scores.append(auc(score_vectors(of(k), model, features), label))
        rows.append((str(params), sum(scores) / folds, min(scores)))
    return small_table(df.sparkSession, rows, "params string, mean_auc double, min_auc double")


def permutation_importance(
    df: DataFrame, model: Model, features: Sequence[str], rows: int | None = None, repeats: int = 2, label: str = "label", seed: int = 0
) -> DataFrame:
    """AUC lost when one column is shuffled. All rows take part unless `rows` asks for a sample.

    A shuffle gives every row the values of the row whose position it is mapped to: an equal join, without a sort.
    """
    spark = df.sparkSession
    sample = df.select(*features, label)
    if rows is not None:
        sample = sample_n(sample, rows, seed=seed)
    sample, n = number_rows(materialise(sample.withColumn("__id", F.monotonically_increasing_id()), "sample"))
    base = auc(score(sample, model, features), label)
    totals = {f: 0.0 for f in features}
    donors = sample.select(F.col("__at").alias("__from"), *[F.col(f).alias(f"__d_{f}") for f in features])
    for k in range(repeats):
        paired = sample.withColumn("__from", shuffled_position(F.col("__at"), n, f"{seed}-{k}")).join(donors, "__from")
        paired = materialise(paired, "shuffled")
        for f in features:
            shuffled = paired.withColumn(f, F.col(f"__d_{f}"))
            totals[f] += base - auc(score(shuffled, model, features), label)
    out = [(f, totals[f] / repeats, base) for f in features]
    return small_table(spark, out, "feature string, auc_drop double, base_auc double")


def partial_dependence(
    df: DataFrame, model: Model, features: Sequence[str], feature: str, rows: int | None = None, points: int = 30, seed: int = 0
) -> DataFrame:
    """Mean score with one feature set to each of `points` values between its extremes.

    All rows take part unless `rows` asks for a sample.
    """
    sample = df.select(*features) if rows is None else sample_n(df.select(*features), rows, seed=seed)
    ends = df.agg(F.min(feature).cast("double").alias("lo"), F.max(feature).cast("double").alias("hi"))
    grid = ends.select(
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.lit(points - 1)),
                lambda i: F.col("lo") + (F.col("hi") - F.col("lo")) * i / F.lit(float(points - 1)),
            )
        ).alias("__v")
    )
    crossed = sample.crossJoin(F.broadcast(grid)).withColumn(feature, F.col("__v"))
    return score(crossed, model, features).groupBy(F.col("__v").alias(feature)).agg(F.avg("score").alias("mean_score"))
