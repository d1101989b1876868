"""Feature statistics, selection and drift.

Statistics of many columns come from one wide aggregate, from the histograms and
Gram matrices of `operators.wide`, or, where distinct values are counted, from
value counts (feature, value, rows), which fold repeated values before any shuffle.
Only tables with one row per feature or per feature pair reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.scalars import finite, to_feature
from barloom.operators.scaling import unpivot
from barloom.operators.wide import few_values, left_closed, pair_correlations, plain_doubles, right_closed, wide_bins, wide_quantiles
from barloom.session import materialise, small_table


def value_counts(df: DataFrame, features: Sequence[str], label: str | None = None, ids: Sequence[str] = ()) -> DataFrame:
    """(ids, feature, value, rows[, positives]); missing values keep a row with value NULL."""
    keep = [*ids, label] if label else list(ids)
    long = unpivot(df, features, keep).withColumn("value", finite("value"))
    aggs = [F.count(F.lit(1)).alias("rows")]
    if label:
        aggs.append(F.sum(F.col(label).cast("bigint")).alias("positives"))
    return long.groupBy(*ids, "feature", "value").agg(*aggs)


def _explode_row(row: DataFrame, features: Sequence[str], fields: dict[str, str], ids: Sequence[str] = ()) -> DataFrame:
    """One wide row (columns `<feature>__<field>`) to one row per feature."""
    structs = [
        F.struct(F.lit(f).alias("feature"), *[F.col(f"{f}__{k}").alias(n) for k, n in fields.items()]) for f in features
    ]
    return row.select(*ids, F.explode(F.array(*structs)).alias("s")).select(*ids, "s.*")


def constant_filter(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Distinct values and std after missing -> 0; `status` is `keep` or `constant`."""
    counts = value_counts(df, features).withColumn("value", F.coalesce("value", F.lit(0.0)))
    folded = counts.groupBy("feature", "value").agg(F.sum("rows").alias("rows"))
    nunique = folded.groupBy("feature").agg(F.count(F.lit(1)).alias("nunique"))
    std = _explode_row(
        df.agg(*[F.stddev_samp(to_feature(f)).alias(f"{f}__std") for f in features]), features, {"std": "std"}
    )
    keep = (F.col("nunique") > 1) & (F.coalesce(F.col("std"), F.lit(0.0)) > 1e-12)
    return nunique.join(std, "feature").withColumn("status", F.when(keep, "keep").otherwise("constant"))


def _corr(x: Column, y: Column) -> Column:
    """Pearson correlation; 0 where either side does not vary."""
    sx, sy = F.stddev_pop(x), F.stddev_pop(y)
    value = F.covar_pop(x, y) / F.nullif(sx * sy, F.lit(0.0))
    return F.when((sx <= 1e-12) | (sy <= 1e-12), 0.0).otherwise(F.coalesce(value, F.lit(0.0)))


def label_corr(df: DataFrame, features: Sequence[str], label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """Correlation of each feature (missing as 0) with the label; flat columns give 0. One aggregate, no unpivot."""
    y = F.col(label).cast("double")
    aggs = []
    for f in features:
        aggs.append(_corr(to_feature(f), y).alias(f"{f}__corr"))
    row = df.groupBy(*by).agg(*aggs)
    out = _explode_row(row, features, {"corr": "label_corr"}, by)
    return out.withColumn("abs_label_corr", F.abs("label_corr"))


def corr_matrix(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature_a, feature_b, corr) for all pairs a < b in list order; missing or flat as 0."""
    clean = df.select(*[to_feature(f).alias(f) for f in features])
    return pair_correlations(clean, features, least=1).drop("pairs")


def pairs_and_labels(
    df: DataFrame, features: Sequence[str], threshold: float, label: str, least: int
) -> tuple[dict[tuple[str, str], float], dict[str, float]]:
    """|corr| of the pairs at or above the threshold, either way round, and of every feature with the label; one scan.

    Each over the rows where both are known. Besides the close pairs, one number per feature reaches the driver.
    """
    named = df.select(*features, F.col(label).cast("double").alias("__label"))
    pairs = pair_correlations(named, [*features, "__label"], least)
    found = pairs.filter((F.abs("corr") >= threshold) | (F.col("feature_b") == "__label")).collect()
    near = {r["feature_a"]: abs(r["corr"]) for r in found if r["feature_b"] == "__label"}
    close = {(r["feature_a"], r["feature_b"]): abs(r["corr"]) for r in found if r["feature_b"] != "__label"}
    return close | {(b, a): v for (a, b), v in close.items()}, {f: near.get(f, 0.0) for f in features}


def corr_prune(
    df: DataFrame, features: Sequence[str], threshold: float, protected: Sequence[str] = (), label: str = "label"
) -> tuple[list[str], DataFrame]:
    """Drop one of each pair correlated at or above the threshold.

    Features are visited protected first, then by |corr| with the label. A protected
    feature survives an unprotected one; otherwise the one closer to the label does.
    Returns the kept features and a table of (kept, dropped, abs_corr).
    """
    clean = df.select(*[to_feature(f).alias(f) for f in features], label)
    close, near = pairs_and_labels(clean, features, threshold, label, least=1)
    safe = set(protected)
    # A feature outranks another if it is protected and the other is not, else if it is closer to the label.
    rank = {f: place for place, f in enumerate(sorted(features, key=lambda f: (f not in safe, -near[f], f)))}
    rivals: dict[str, list[str]] = {f: [] for f in features}
    for a, b in close:
        if rank[a] < rank[b]:
            rivals[a].append(b)
    dropped_by: dict[str, str] = {}
    for f in sorted(features, key=rank.__getitem__):
        if f not in dropped_by:
            dropped_by |= {r: f for r in rivals[f] if r not in dropped_by}
    rows = [(keeper, f, close[keeper, f], near[keeper], near[f]) for f, keeper in dropped_by.items()]
    rows.sort(key=lambda row: (rank[row[0]], rank[row[1]]))
    schema = (
        "kept_feature string, dropped_feature string, abs_corr double, "
        "kept_abs_label_corr double, dropped_abs_label_corr double"
    )
    return [f for f in features if f not in dropped_by], small_table(df.sparkSession, rows, schema)


def corr_forward(
    df: DataFrame,
    features: Sequence[str],
    top_n: int,
    max_pair_corr: float,
    force_tokens: Sequence[str] = (),
    label: str = "label",
    least: int = 50,
) -> list[str]:
    """Take features by |corr| with the label, skipping those too close to one already taken; forced ones always enter.

    Correlations are over the rows where both sides are known, and 0 where fewer than `least` are.
    """
    close, near = pairs_and_labels(df, features, max_pair_corr, label, least)
    forced = [f for f in features if any(t in f for t in force_tokens)]
    ranked = sorted(features, key=lambda f: (-near[f], f))[:top_n]
    pool = list(dict.fromkeys([*forced, *ranked]))
    taken: list[str] = []
    for f in pool:
        if f in forced or not any((f, t) in close for t in taken):
            taken.append(f)
    return taken


def label_bins(df: DataFrame, features: Sequence[str], label: str = "label", bins: int = 10, count_values: int = 64) -> DataFrame:
    """(feature, bin, rows, positives, mean, values): each feature cut at its quantiles, repeated edges merged.

    `values` is the feature's number of distinct values, counted up to `count_values`. Rows stay wide: quantiles, counts
    and values are three kinds of small tables.
    """
    known = materialise(
        plain_doubles(df.filter(F.col(label).isNotNull()), features, F.lit(0).alias("__group"), F.col(label).cast("bigint").alias("__label"))
    )
    found = wide_quantiles(known, features, [i / bins for i in range(bins + 1)])
    edges = {f: sorted(set(values)) for f, (_, values) in found.items()}
    values = few_values(known, features, count_values)
    cells = wide_bins(known, features, edges, "__group", "__label", right_closed)
    named = small_table(df.sparkSession, [(f, n) for f, n in values.items()], "feature string, values bigint")
    return cells.join(named, "feature").select(
        "feature", "bin", "rows", F.col("weight").alias("positives"), (F.col("weight") / F.col("rows")).alias("mean"), "values"
    )


def mi_of_bins(cells: DataFrame) -> DataFrame:
    """Mutual information (nats) of label and bin. At most `bins` rows per feature come in."""
    all_rows = Window.partitionBy("feature")
    cells = cells.withColumns({"__n": F.sum("rows").over(all_rows), "__p": F.sum("positives").over(all_rows)})

    def term(joint: Column, marginal: Column) -> Column:
        share = joint * F.col("__n") / (F.col("rows") * marginal.cast("double"))
        return F.when(joint > 0, joint / F.col("__n") * F.log(share)).otherwise(0.0)

    ones, zeros = F.col("positives"), F.col("rows") - F.col("positives")
    mi = term(ones, F.col("__p")) + term(zeros, F.col("__n") - F.col("__p"))
    return cells.groupBy("feature").agg(F.sum(mi).alias("mutual_info"))


def lift_of_bins(cells: DataFrame, min_unique: int = 5) -> DataFrame:
    """Rows and label mean per bin, bins numbered from 1; features with few distinct values are left out."""
    per = Window.partitionBy("feature")
    number = F.row_number().over(per.orderBy("bin"))
    return (
        cells.withColumn("decile", number)
        .filter(F.col("values") >= min_unique)
        .select("feature", "decile", F.col("rows").alias("count"), "mean")
    )


def binned_mi(df: DataFrame, features: Sequence[str], label: str = "label", bins: int = 10) -> DataFrame:
    return mi_of_bins(label_bins(df, features, label, bins))


def decile_lift(df: DataFrame, features: Sequence[str], label: str = "label", bins: int = 10, min_unique: int = 5) -> DataFrame:
    return lift_of_bins(label_bins(df, features, label, bins), min_unique)


def average_rank(c: str, descending: bool = True, pct: bool = False, by: Sequence[str] = ()) -> Column:
    """Rank with ties averaged. For tables of one row per feature."""
    over = Window.partitionBy(*by)
    rank = F.rank().over(over.orderBy(F.desc(c) if descending else F.asc(c)))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, c))
    value = rank + (ties - 1) / 2.0
    return value / F.count(F.lit(1)).over(over) if pct else value


def preselect_rank(scores: DataFrame, metrics: Sequence[str], protected: Sequence[str] = ()) -> DataFrame:
    """Mean of the metrics' descending ranks; `position` puts protected features first."""
    out = scores.withColumns({f"{m}_rank": average_rank(m) for m in metrics})
    mean = sum((F.col(f"{m}_rank") for m in metrics), F.lit(0.0)) / len(metrics)
    out = out.withColumns(
        {"combined_rank": mean, "protected": F.col("feature").isin(list(protected)).cast("int")}
    )
    order = Window.orderBy(F.desc("protected"), "combined_rank", "feature")
    return out.withColumn("position", F.row_number().over(order))


# Points a rank starts from, by ranking.
SELECTION_POINTS = {"featurewiz_rank": 300, "l1_rank": 200, "rf_rank": 200, "label_corr_rank": 100}
PROTECTED_POINTS = 1000


def selection_score(ranks: dict[str, DataFrame], protected: Sequence[str] = ()) -> DataFrame:
    """Join rank tables (feature, <name>) on feature, whoever has it, and add up max(0, points - rank)."""
    out: DataFrame | None = None
    for table in ranks.values():
        out = table if out is None else out.join(table, "feature", "full_outer")
    score = F.when(F.col("feature").isin(list(protected)), float(PROTECTED_POINTS)).otherwise(0.0)
    for name in ranks:
        rank = F.coalesce(F.col(name), F.lit(9999))
        score = score + F.greatest(F.lit(0), F.lit(SELECTION_POINTS[name]) - rank)
    return out.withColumns(
        {"selection_score": score, "protected": F.col("feature").isin(list(protected)).cast("int")}
    )


def signal_rank(corr: DataFrame, mi: DataFrame) -> DataFrame:
    """Sum of the percent ranks of |corr with label| and mutual information."""
    both = corr.select("feature", "abs_label_corr").join(mi, "feature", "left").fillna(0.0, ["mutual_info"])
    return both.withColumn(
        "rank_score",
        average_rank("abs_label_corr", descending=False, pct=True) + average_rank("mutual_info", descending=False, pct=True),
    )


# Fixed value: names that do not vote.
EXCLUDED_VOTE = r"^bb|^bband|_bb|boll"


def importance_votes(importance: DataFrame, available: DataFrame, run: str = "run") -> DataFrame:
    """Per run the most important available, not excluded feature votes; votes and best importance per feature."""
    usable = importance.filter(
        F.col("feature").isNotNull() & ~F.lower("feature").rlike(EXCLUDED_VOTE)
    ).join(available.select("feature"), "feature", "left_semi")
    # max_by combines map-side; ties go to the smaller name.
    top = usable.groupBy(run).agg(F.min(F.struct((-F.col("importance")).alias("neg"), "feature")).alias("t"))
    return top.groupBy(F.col("t.feature").alias("feature")).agg(
        F.count(F.lit(1)).alias("votes"), F.max(-F.col("t.neg")).alias("max_importance")
    )


def psi(df: DataFrame, features: Sequence[str], expected: Column, period: str, bins: int = 10) -> DataFrame:
    """Population stability of each feature per period against the rows where `expected` holds.

    `period` is a whole number. Missing if either side has fewer than 5 * bins known values, 0 if there are fewer than
    3 distinct cuts. Rows stay wide; the cuts are read off histograms, the bins counted in one pass.
    """
    wide = materialise(
        plain_doubles(df, features, F.col(period).cast("bigint").alias("__period"), F.coalesce(expected.cast("int"), F.lit(0)).alias("__exp"))
    )
    found = wide_quantiles(wide.filter("__exp = 1"), features, [i / bins for i in range(bins + 1)])
    edges = {f: sorted(set(values)) for f, (_, values) in found.items()}
    counted = wide_bins(wide, features, edges, "__period", "__exp", left_closed)
    facts = [(f, len(edges[f]), found[f][0]) for f in features]
    named = small_table(df.sparkSession, facts, "feature string, cuts int, exp_rows bigint")
    kind = df.schema[period].dataType
    cells = counted.join(named, "feature").select(
        "feature", F.col("group").cast(kind).alias(period), F.when(F.col("bin") < F.col("cuts"), F.col("bin")).alias("bin"),
        F.col("rows").alias("a"), F.col("weight").alias("e"), "cuts", "exp_rows",
    )
    # From here on: features x periods x (bins + 1) rows.
    per_bin = cells.groupBy("feature", "bin").agg(F.sum("e").alias("e"), F.max("cuts").alias("cuts"), F.max("exp_rows").alias("exp_rows"))
    seen = cells.groupBy("feature", period).agg(
        F.sum("a").alias("act_rows"), F.sum(F.when(F.col("bin").isNotNull(), F.col("a")).otherwise(0)).alias("act_in")
    )
    scaffold = per_bin.filter(F.col("bin").isNotNull()).join(seen, "feature")
    actual = cells.filter(F.col("bin").isNotNull()).select("feature", period, "bin", "a")
    full = scaffold.join(actual, ["feature", period, "bin"], "left")
    e = F.greatest(F.col("e") / F.greatest(F.col("exp_rows"), F.lit(1)), F.lit(1e-6))
    a = F.greatest(F.coalesce(F.col("a"), F.lit(0)) / F.greatest(F.col("act_in"), F.lit(1)), F.lit(1e-6))
    out = full.groupBy("feature", period).agg(
        F.sum((a - e) * F.log(a / e)).alias("__psi"),
        F.max("cuts").alias("__cuts"),
        F.max("exp_rows").alias("__exp_rows"),
        F.max("act_rows").alias("__act_rows"),
    )
    few = (F.col("__exp_rows") < 5 * bins) | (F.col("__act_rows") < 5 * bins)
    return out.select(
        "feature", period, F.when(few, None).when(F.col("__cuts") < 3, 0.0).otherwise(F.col("__psi")).alias("psi")
    )


def feature_quality(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """dtype, share of missing values and number of distinct known values per feature."""
    types = dict(df.dtypes)
    counts = value_counts(df, features)
    out = counts.groupBy("feature").agg(
        (F.sum(F.when(F.col("value").isNull(), F.col("rows")).otherwise(0)) / F.sum("rows")).alias("missing_rate"),
        F.count("value").alias("n_unique"),
    )
    dtype = F.create_map(*[x for f in features for x in (F.lit(f), F.lit(types[f]))])
    return out.withColumn("dtype", dtype[F.col("feature")])


def family_mass(importance: DataFrame, catalog: DataFrame) -> DataFrame:
    """Importance per feature family and its share of the total."""
    per = importance.join(catalog, "feature").groupBy("family").agg(
        F.sum("importance").alias("mass"), F.count_distinct("feature").alias("n_features")
    )
    total = per.agg(F.sum("mass").alias("__all"))
    return per.crossJoin(F.broadcast(total)).select(
        "family", "n_features", "mass", (F.col("mass") / F.nullif("__all", F.lit(0.0))).alias("share")
    )


def feature_usage(models: DataFrame, features: str = "features") -> DataFrame:
    """How many models use each feature."""
    return models.select("model", F.explode(features).alias("feature")).groupBy("feature").agg(
        F.count_distinct("model").alias("models")
    )
