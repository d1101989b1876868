"""Samples, folds, ordered scans, metrics, selection and choice operators against brute force."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import configs, metrics, ordered, sampling, scaling, selection, thresholds


@pytest.fixture(scope="module")
def table(spark):
    """One value holds a third of the rows; whole rows repeat."""
    rng = random.Random(5)
    rows = []
    for i in range(900):
        x = 1.5 if i % 3 == 0 else round(rng.gauss(0, 1), 2)
        rows.append((rng.choice("ab"), x, int(rng.random() < 0.4), 2000 + i % 3))
    rows += rows[:100]
    return spark.createDataFrame(rows, "g string, x double, label int, year int"), pd.DataFrame(rows, columns=["g", "x", "label", "year"])


def test_quantiles_equal_numpy(table):
    df, pdf = table
    qs = (0.0, 0.1, 0.333, 0.5, 0.9, 1.0)
    got = {r.g: r for r in ordered.exact_quantiles(df, ["g"], "x", qs, [f"c{i}" for i in range(6)]).collect()}
    for g, part in pdf.groupby("g"):
        want = np.quantile(part.x, qs)
        np.testing.assert_allclose([got[g][f"c{i}"] for i in range(6)], want, rtol=1e-12, atol=1e-12)


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals(table, descending):
    df, pdf = table
    got = ordered.running_totals(df, ["g"], ["x"], {"n": F.count(F.lit(1)), "p": F.sum("label")}, descending).toPandas()
    want = pdf.groupby(["g", "x"]).label.agg(n="size", p="sum").reset_index().sort_values(["g", "x"], ascending=[True, not descending])
    want["cum_n"], want["cum_p"] = want.groupby("g").n.cumsum(), want.groupby("g").p.cumsum()
    got = got.sort_values(["g", "x"], ascending=[True, not descending])
    assert got[["g", "x", "n", "p", "cum_n", "cum_p"]].values.tolist() == want[["g", "x", "n", "p", "cum_n", "cum_p"]].values.tolist()


@pytest.mark.parametrize("digits", [1, 4])
def test_sample_is_exact_and_deterministic(table, digits, monkeypatch):
    df, pdf = table
    monkeypatch.setattr(sampling, "HASH_DIGITS", digits)
    a = sampling.sample_n(df, 123, by=("year",), seed=1).toPandas()
    b = sampling.sample_n(df.repartition(7), 123, by=("year",), seed=1).toPandas()
    assert a.groupby("year").size().tolist() == [123] * 3
    key = list(pdf.columns)
    assert sorted(a[key].values.tolist()) == sorted(b[key].values.tolist())
    have, taken = pdf.value_counts(key), a.value_counts(key)
    assert (taken <= have.reindex(taken.index)).all()
    assert sampling.sample_n(df, 5000).count() == len(pdf)


def test_balanced_sample(table):
    df, pdf = table
    out = sampling.balanced_sample(df, 201, seed=2).toPandas()
    assert out.label.value_counts().to_dict() == {1: 100, 0: 101}
    few = pdf[pdf.label == 1].shape[0] // 4
    rare = df.filter((F.col("label") == 0) | (F.col("year") == 2001) & (F.col("g") == "a"))
    ones = rare.filter("label = 1").count()
    out = sampling.balanced_sample(rare, 600).toPandas()
    assert few > 0 and out.label.value_counts().to_dict() == {1: min(ones, 300), 0: 600 - min(ones, 300)}
    assert sampling.balanced_sample(df, 10_000).count() == len(pdf)


def test_group_with_missing_key_is_sampled(spark):
    df = spark.createDataFrame([(None, i) for i in range(30)] + [("k", i) for i in range(30)], "g string, i int")
    got = {r.g: r["count"] for r in sampling.sample_n(df, 7, by=("g",)).groupBy("g").count().collect()}
    assert got == {None: 7, "k": 7}


@pytest.mark.parametrize("n,k", [(10, 4), (97, 10), (5, 9)])
def test_ordered_thin(spark, n, k):
    got = sorted(r.i for r in sampling.ordered_thin(spark.range(n).select(F.col("id").alias("i")), k, ["i"]).collect())
    want = sorted((i * (n - 1)) // (k - 1) for i in range(k)) if n > k else list(range(n))
    assert got == want


def test_time_folds(spark):
    df = spark.range(23).select(F.col("id").alias("i"))
    rows = sampling.ts_folds(df, 4, ["i"]).collect()
    size = 23 // 5
    for f in range(4):
        start = 23 - (4 - f) * size
        assert sorted(r.i for r in rows if r.fold == f and r.role == "train") == list(range(start))
        assert sorted(r.i for r in rows if r.fold == f and r.role == "test") == list(range(start, start + size))


def test_stratified_folds(spark):
    labels = [1, 0, 0, 1, 0, 1, 1, 0, 0, 0, 1, 0, 1]
    df = spark.createDataFrame(list(enumerate(labels)), "i int, y int")
    got = {r.i: r.fold for r in sampling.strat_folds(df, 3, "y", ["i"]).collect()}
    # Classes in order of appearance, their rows lined up and dealt in turn.
    order = sorted(range(len(labels)), key=lambda i: (labels[i] != labels[0], i))
    want = {}
    for cls in (labels[0], 1 - labels[0]):
        spots = [p for p, i in enumerate(order) if labels[i] == cls]
        sizes = [sum(p % 3 == f for p in spots) for f in range(3)]
        members = [i for i in range(len(labels)) if labels[i] == cls]
        for i, f in zip(members, [f for f, s in enumerate(sizes) for _ in range(s)]):
            want[i] = f
    assert got == want


def test_metrics_equal_pairs(spark):
    rng = random.Random(1)
    data = [(round(rng.random(), 1), int(rng.random() < 0.3)) for _ in range(200)]
    df = spark.createDataFrame(data, "score double, label int")
    pos, neg = [s for s, y in data if y], [s for s, y in data if not y]
    auc = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    m = metrics.prob_metrics(df, []).first()
    assert math.isclose(m.auc, auc) and m.samples == 200
    assert math.isclose(m.brier, sum((y - s) ** 2 for s, y in data) / 200)
    back = metrics.prob_metrics(df.withColumn("score", 1 - F.col("score")), []).first()
    assert math.isclose(m.auc + back.auc, 1.0)
    one = metrics.prob_metrics(df.filter("label = 1"), []).first()
    assert one.auc is None and one.brier is None and one.accuracy is not None


def test_psi_small_and_flat(spark):
    rows = [(1, float(i % 20), 3.0) for i in range(100)] + [(2, float(i), 3.0) for i in range(40)] + [(3, float(i % 10), 3.0) for i in range(60)]
    df = spark.createDataFrame(rows, "p int, x double, flat double")
    got = {(r.feature, r.p): r.psi for r in selection.psi(df, ["x", "flat"], F.col("p") == 1, "p").collect()}
    assert got[("x", 1)] == 0 and got[("x", 2)] is None and got[("flat", 1)] == 0

    base, act = np.array([i % 20 for i in range(100)], float), np.array([i % 10 for i in range(60)], float)
    cuts = np.unique(np.quantile(base, np.linspace(0, 1, 11)))
    e = np.clip(np.histogram(base, cuts)[0] / 100, 1e-6, None)
    a = np.clip(np.histogram(act, cuts)[0] / 60, 1e-6, None)
    assert math.isclose(got[("x", 3)], float(((a - e) * np.log(a / e)).sum()))


def test_lift_merges_repeated_edges(table):
    df, pdf = table
    got = selection.decile_lift(df.select("x", "label"), ["x"]).orderBy("decile").toPandas()
    want = pdf.groupby(pd.qcut(pdf.x, 10, duplicates="drop"), observed=True).label.agg(["count", "mean"])
    assert got["count"].tolist() == want["count"].tolist()
    np.testing.assert_allclose(got["mean"], want["mean"])


def test_robust_scaler(table):
    df, pdf = table
    stats = scaling.fit_robust(df, ["x"])
    got = scaling.apply_robust(df, stats, ["x"]).agg(F.min("x_scaled"), F.max("x_scaled"), F.sum("x_scaled")).first()
    x = np.clip(pdf.x, *np.quantile(pdf.x, (0.005, 0.995)))
    z = (x - np.median(x)) / ((np.quantile(x, 0.75) - np.quantile(x, 0.25)) or 1.0)
    np.testing.assert_allclose(list(got), [z.min(), z.max(), z.sum()], rtol=1e-9)


def test_corr_prune_keeps_protected_and_closest(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 500)
    a = y + rng.normal(0, 1, 500)
    data = [(float(v), float(v + e), float(n), int(t)) for v, e, n, t in zip(a, rng.normal(0, 0.01, 500), rng.normal(0, 1, 500), y)]
    df = spark.createDataFrame(data, "a double, b double, n double, label int")
    kept, dropped = selection.corr_prune(df, ["a", "b", "n"], 0.9)
    assert "n" in kept and len(kept) == 2 and dropped.count() == 1
    kept, _ = selection.corr_prune(df, ["a", "b", "n"], 0.9, protected=["b"])
    assert kept == ["b", "n"]


def test_threshold_table_is_monotone_and_complete(table):
    df, pdf = table
    out = thresholds.threshold_table(df, (0.0, 0.5, 9.0), score="x").toPandas()
    assert len(out) == 9 and (out.wins + out.losses == out.resolved).all()
    for _, part in out.sort_values("threshold").groupby("year"):
        assert part.resolved.is_monotonic_decreasing and part.resolved.iloc[-1] == 0 and part.winrate.iloc[-1] == 0
    assert out[out.threshold == 0.5].resolved.sum() == (pdf.x >= 0.5).sum()


def test_diversified_topk_equals_loop(spark):
    rng = random.Random(3)
    for limit in (1, 4, 7, 40):
        rows = [(rng.choice("abc"), rng.choice("xy"), i, float(rng.randint(0, 9)), float(rng.randint(0, 3)), rng.randint(1, 50)) for i in range(25)]
        df = spark.createDataFrame(rows, "f1 string, f2 string, id int, min_winrate double, weighted_winrate double, min_resolved int")
        got = [r.id for r in configs.diversified_topk(df, ("f1", "f2"), limit, keys=("id",)).orderBy("place").collect()]
        want, used = [], set()
        for r in sorted(rows, key=lambda r: (-r[3], -r[4], -r[5], r[2])):
            if (r[0], r[1]) in used and len(want) < limit // 2:
                continue
            want.append(r[2])
            used.add((r[0], r[1]))
            if len(want) >= limit:
                break
        assert got == want


def test_guarded_choice_falls_back(spark):
    def pick(rows):
        df = spark.createDataFrame(rows, "threshold double, resolved int, wins int, winrate double")
        return thresholds.pick_threshold_guarded(df, 100, 200, 300).first().threshold

    assert pick([(0.5, 150, 80, 53.0), (0.6, 250, 130, 52.0), (0.7, 900, 600, 66.0)]) == 0.5
    assert pick([(0.5, 400, 80, 60.0), (0.6, 500, 130, 59.0)]) == 0.5
    assert pick([(0.5, 40, 30, 75.0), (0.6, 60, 20, 33.0)]) == 0.6
