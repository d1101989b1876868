"""Models and model-based selection on data whose answer is known, shuffles and folds against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import models, sampling, shuffling

SMALL = {"trees": 8, "depth": 3, "min_leaf": 5, "subsample": 1.0}
FEATURES = ["noise0", "strong", "noise1", "weak", "noise2"]


@pytest.fixture(scope="module")
def parts(spark):
    """The label follows `strong`, a little `weak`, and nothing else."""
    rng = np.random.default_rng(0)
    n = 900
    x = {f: rng.normal(0, 1, n) for f in FEATURES}
    y = (3 * x["strong"] + 0.7 * x["weak"] + rng.normal(0, 0.3, n) > 0).astype(int)
    rows = [(i, int(y[i]), "train" if i < 600 else "valid", *(float(x[f][i]) for f in FEATURES)) for i in range(n)]
    df = spark.createDataFrame(rows, "i long, label int, part string, " + ", ".join(f"{f} double" for f in FEATURES)).repartition(3).cache()
    return df.filter("part = 'train'"), df.filter("part = 'valid'")


def test_forest_and_boosting_rank_the_rows(parts):
    train, valid = parts
    forest = models.fit_forest(train, FEATURES, **SMALL)
    assert models.auc(models.score(valid, forest, FEATURES)) > 0.93
    both = train.withColumn("v", F.lit(False)).unionByName(valid.withColumn("v", F.lit(True)))
    boosted = models.fit_boosting(both, FEATURES, "v", iterations=5, depth=2, step=0.3)
    assert models.auc(models.score(valid, boosted, FEATURES)) > 0.93


def test_scores_are_missing_where_a_feature_is(parts):
    train, valid = parts
    forest = models.fit_forest(train, FEATURES, **SMALL)
    holed = valid.withColumn("weak", F.when(F.col("i") % 3 != 0, F.col("weak")))
    got = models.score(holed, forest, FEATURES).select("i", "score").collect()
    assert len(got) == valid.count()
    assert all((r.score is None) == (r.i % 3 == 0) for r in got)


def test_selectors_find_the_strong_feature(parts):
    train, valid = parts
    picked, table = models.forest_select(train, FEATURES, 2, protected=["noise2"], **SMALL)
    assert picked[0] == "noise2" and set(picked) == {"noise2", "strong", "weak"}
    assert table.filter("selected = 1").count() == 3
    rows = models.l1_select(train, valid, FEATURES, [0.03, 5.0], protected=["noise1"]).collect()
    tight, loose = rows[0], rows[1]
    assert tight.n_features < loose.n_features or tight.features == loose.features
    assert "strong" in tight.features.split(",") and "noise1" in tight.features.split(",")
    assert sum(r.chosen for r in rows) == 1 and max(r.valid_auc for r in rows) > 0.95


def test_elimination_keeps_the_strong_feature(parts):
    train, _ = parts
    got = {r.feature: r for r in models.rfe_select(train, FEATURES, ["i"], folds=2, step=2, min_features=1, **SMALL).collect()}
    assert got["strong"].rank == 1 and got["strong"].selected == 1
    assert sum(r.selected for r in got.values()) in (1, 3, 5)
    assert all((r.rank == 1) == (r.selected == 1) for r in got.values())


def test_blocks_carry_the_best(parts):
    train, valid = parts
    got = models.block_selection(train, valid, FEATURES, 2, 1, **SMALL).orderBy("block").collect()
    assert [r.n_features for r in got] == [2, 3, 2]
    assert [r.carried for r in got] == ["strong"] * 3
    assert got[-1].valid_auc > 0.9


def test_search_prefers_trees_that_can_split(parts):
    train, _ = parts
    got = {r.params: r for r in models.param_search(train, FEATURES, {"min_leaf": [5, 590]}, ["i"], folds=2, trees=4, depth=3, subsample=1.0).collect()}
    assert got["{'min_leaf': 5}"].mean_auc > 0.9 and got["{'min_leaf': 590}"].mean_auc == 0.5
    assert all(r.min_auc <= r.mean_auc for r in got.values())


def test_importance_by_shuffling(parts):
    train, valid = parts
    forest = models.fit_forest(train, FEATURES, **SMALL)
    got = {r.feature: r.auc_drop for r in models.permutation_importance(valid, forest, FEATURES, repeats=2).collect()}
    assert got["strong"] > 0.25 and all(abs(got[f]) < 0.05 for f in FEATURES if f.startswith("noise"))
    # A shuffled column has no link with the label: the AUC falls to about one half.
    alone = models.fit_forest(train, ["strong"], **SMALL)
    one = models.permutation_importance(valid, alone, ["strong"], repeats=3).first()
    assert one.base_auc - one.auc_drop == pytest.approx(0.5, abs=0.1)


def test_dependence_follows_the_feature(parts):
    train, _ = parts
    forest = models.fit_forest(train, FEATURES, **SMALL)
    curve = [r.mean_score for r in models.partial_dependence(train, forest, FEATURES, "strong", points=7).orderBy("strong").collect()]
    assert len(curve) == 7 and curve[0] < 0.3 < 0.7 < curve[-1]
    assert all(b >= a - 1e-9 for a, b in zip(curve, curve[1:]))


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 7, 12, 16, 17, 50, 101, 1000])
def test_shuffles_are_bijections(spark, n):
    df = spark.range(n).select("id", *[shuffling.shuffled_position(F.col("id"), n, s).alias(s) for s in ("a", "b")])
    rows = df.collect()
    for s in ("a", "b"):
        assert sorted(r[s] for r in rows) == list(range(n))
    if n > 50:
        assert [r.a for r in rows] != [r.b for r in rows]
        moved = np.array([r.a for r in sorted(rows, key=lambda r: r.id)])
        assert abs(np.corrcoef(np.arange(n), moved)[0, 1]) < 0.35


def test_rows_are_numbered_without_gaps(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(1000, numPartitions=7).filter("id % 3 <> 0 and (id < 300 or id > 500)").withColumn("__id", F.monotonically_increasing_id()).write.parquet(path)
    placed, n = shuffling.number_rows(spark.read.parquet(path))
    assert sorted(r["__at"] for r in placed.collect()) == list(range(n)) and n > 500
    empty, none = shuffling.number_rows(spark.read.parquet(path).filter("id < 0"))
    assert none == 0 and empty.collect() == []


@pytest.mark.parametrize("n, k", [(10, 3), (11, 2), (100, 5), (3, 2)])
def test_folds_by_position_equal_folds_by_row(spark, n, k):
    """Interval filters give the rows that `ts_folds` writes out."""
    df = spark.createDataFrame([(i // 2, i % 3) for i in range(n)], "t long, v int").repartition(3)
    placed = sampling.numbered(df, ["t"])
    rows = sorted((r.position, r.t, r.v) for r in placed.collect())
    assert [p for p, _, _ in rows] == list(range(n)) and [(t, v) for _, t, v in rows] == sorted((t, v) for _, t, v in rows)
    want = {}
    for r in sampling.ts_folds(df, k, ["t"]).collect():
        want.setdefault((r.fold, r.role), []).extend([(r.t, r.v)] * r.copies)
    for fold, (end, test_end) in enumerate(sampling.ts_fold_bounds(n, k)):
        assert sorted(want.get((fold, "train"), [])) == [(t, v) for p, t, v in rows if p < end]
        assert sorted(want.get((fold, "test"), [])) == [(t, v) for p, t, v in rows if end <= p < test_end]


def _counted(monkeypatch):
    """How often features are assembled into vectors."""
    calls, assemble = [], models.assemble
    monkeypatch.setattr(models, "assemble", lambda df, features: calls.append(features) or assemble(df, features))
    return calls


def test_elimination_assembles_vectors_once(parts, monkeypatch):
    calls = _counted(monkeypatch)
    models.rfe_select(parts[0], FEATURES, ["i"], folds=2, step=2, min_features=1, **SMALL).collect()
    assert calls == [FEATURES]


def test_search_assembles_vectors_once(parts, monkeypatch):
    calls = _counted(monkeypatch)
    models.param_search(parts[0], FEATURES, {"depth": [1, 2]}, ["i"], folds=2, trees=2, min_leaf=5).collect()
    assert calls == [FEATURES]


def test_narrowed_vectors_are_assembled_ones(parts):
    train, _ = parts
    holed = train.withColumn("weak", F.when(F.col("i") % 3 != 0, F.col("weak")))
    kept = ["weak", "noise0"]
    staged = models.staged_vectors(holed, FEATURES, "i")
    got = {r.i: list(r[models.VECTOR].toArray()) for r in models.narrowed(staged, FEATURES, kept).collect()}
    assert got == {r.i: list(r[models.VECTOR].toArray()) for r in models.assemble(holed, kept).collect()}


def test_filters_on_a_score_do_not_walk_the_trees_again(parts):
    train, valid = parts
    forest = models.fit_forest(train, FEATURES, **SMALL)
    asked = models.score(valid, forest, FEATURES).filter("score IS NOT NULL AND NOT isnan(score) AND score >= 0.2").select("score")
    plan = asked._jdf.queryExecution().optimizedPlan().toString()
    # One UDF makes the vector, one the probability, one the array.
    assert plan.count("UDF(") == 3


@pytest.mark.parametrize("n, k", [(1, 2), (10, 3), (101, 4)])
def test_intervals_of_ids_are_folds_of_classes(spark, n, k):
    """Rows without a label take part in the line-up of the classes and are in no fold; copies may lie in two folds."""
    rows = [(i // 3, None if i % 7 == 3 else i * i % 3, -0.0 if i % 2 else 0.0) for i in range(n)]
    df = spark.createDataFrame([*rows, *rows[:4]], "t long, y int, v double").repartition(3)
    staged = sampling.materialise(sampling.in_order(df, ["y", "t"]))
    want = {}
    for r in sampling.strat_folds(df, k, "y", ["t"]).collect():
        want.setdefault(r.fold, []).extend([(r.t, r.y, r.v)] * r.copies)
    folds = sampling.strat_fold_ids(staged, k, "y", ["t"])
    placed = sorted(staged.collect(), key=lambda r: r["__id"])
    for fold in range(k):
        assert sorted((r.t, r.y, r.v) for r in placed if any(lo <= r["__id"] < hi for lo, hi in folds[fold])) == sorted(want.get(fold, []))


def test_common_rows_are_ordered_in_many_tasks(spark):
    """One row held by nearly all: its copies are told apart, so the range shuffle spreads them, with one shuffle in all."""
    df = spark.range(20_000, numPartitions=4).select(F.when(F.col("id") < 20, F.col("id")).otherwise(7).alias("t"))
    ordered = sampling.in_order(df, ["t"])
    assert ordered._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    with_parts = ordered.select("t", "__id").collect()
    assert [r.t for r in sorted(with_parts, key=lambda r: r["__id"])] == sorted(r.t for r in df.collect())
    id_at, total = shuffling.row_cuts(sampling.materialise(ordered))
    assert total == 20_000 and id_at(total) > id_at(total - 1) > id_at(0) == 0


def test_cuts_of_no_rows(spark):
    id_at, total = shuffling.row_cuts(sampling.materialise(sampling.in_order(spark.range(0).select(F.col("id").alias("t")), ["t"])))
    assert (id_at(0), total) == (0, 0)
