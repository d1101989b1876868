"""Quantiles, bins and pair correlations on wide rows against numpy and plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import selection, signals, wide

QS = [0.0, 0.005, 0.1, 0.25, 0.5, 0.77, 0.995, 1.0]


@pytest.fixture(scope="module")
def columns():
    rng = np.random.default_rng(7)
    n = 3000
    out = {
        "normal": rng.normal(0, 1, n),
        "hot": np.where(rng.random(n) < 0.4, 2.5, rng.normal(2.5, 1e-9, n)),
        "whole": rng.integers(-3, 4, n).astype(float),
        "wide": np.exp(rng.normal(0, 60, n)) * rng.choice([-1, 1], n),
        "flat": np.full(n, -7.25),
        "zeros": rng.choice([0.0, -0.0, 1e-308, -5e-324], n),
        "mostly_missing": np.where(rng.random(n) < 0.99, np.nan, rng.normal(0, 1, n)),
        "missing": np.full(n, np.nan),
        "infinite": np.where(rng.random(n) < 0.1, np.inf, rng.normal(0, 1, n)),
    }
    out["label"] = (rng.random(n) < 0.3).astype(float)
    return out


@pytest.fixture(scope="module")
def frame(spark, columns):
    names = list(columns)
    rows = [tuple(None if math.isnan(v) else float(v) for v in r) for r in zip(*columns.values())]
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names)).repartition(7).cache()


FEATURES = ["normal", "hot", "whole", "wide", "flat", "zeros", "mostly_missing", "missing", "infinite"]


@pytest.mark.parametrize("few, first, step", [(4096, 16, 8), (1, 16, 8), (1, 3, 5), (40, 12, 16)])
def test_quantiles_equal_numpy(frame, columns, monkeypatch, few, first, step):
    for name, value in {"FEW": few, "FIRST_BITS": first, "NEXT_BITS": step, "TOGETHER": 4}.items():
        monkeypatch.setattr(wide, name, value)
    found = wide.wide_quantiles(wide.plain_doubles(frame, FEATURES), FEATURES, QS)
    for f in FEATURES:
        x = columns[f][np.isfinite(columns[f])]
        n, values = found[f]
        assert n == len(x)
        if n:
            s = np.sort(x)
            at = [q * (n - 1) for q in QS]
            want = [s[math.floor(a)] + (s[math.ceil(a)] - s[math.floor(a)]) * (a - math.floor(a)) for a in at]
            assert values == [w + 0.0 for w in want]
        else:
            assert values == []


def test_order_bits_keep_the_order():
    x = np.array([-np.inf, -1e300, -1.0, -5e-324, -0.0, 0.0, 5e-324, 1.0, 1e300, np.inf])
    bits = wide.order_bits(x)
    assert (np.diff(bits.astype(object)) >= 0).all() and bits[4] == bits[5] and len(set(bits.tolist())) == 9
    assert [wide.from_order_bits(int(b)) for b in bits] == x.tolist()


def test_no_rows(spark):
    empty = spark.createDataFrame([], "a double, b double")
    assert wide.wide_quantiles(empty, ["a", "b"], QS) == {"a": (0, []), "b": (0, [])}
    assert wide.pair_correlations(empty, ["a", "b"]).collect() == []
    assert wide.few_values(empty, ["a"], 5) == {"a": 0}
    assert selection.label_bins(empty.withColumn("label", F.lit(1)), ["a"]).collect() == []


@pytest.mark.parametrize("place", [wide.right_closed, wide.left_closed])
def test_bins(spark, place):
    rng = np.random.default_rng(1)
    rows = [(None if rng.random() < 0.1 else float(rng.integers(0, 12)), None if g == 3 else int(g), int(w)) for g, w in zip(rng.integers(0, 4, 500), rng.integers(0, 2, 500))]
    df = spark.createDataFrame(rows, "x double, g long, w long").repartition(5)
    edges = [1.0, 4.0, 5.0, 9.0]
    want = {}
    for x, g, w in rows:
        if x is None:
            continue
        if place is wide.right_closed:
            b = max(sum(e < x for e in edges), 1)
        else:
            b = 4 if x < 1 or x > 9 else 3 if x == 9 else sum(e <= x for e in edges)
        cell = want.setdefault((g, b), [0, 0])
        cell[0] += 1
        cell[1] += w
    got = {(r.group, r.bin): [r.rows, r.weight] for r in wide.wide_bins(df, ["x"], {"x": edges}, "g", "w", place).collect()}
    assert got == want


def test_few_values_stop_at_the_bound(frame, columns):
    assert wide.few_values(wide.plain_doubles(frame, FEATURES), FEATURES, 6) == {
        f: min(6, len(set((columns[f][np.isfinite(columns[f])] + 0.0).tolist()))) for f in FEATURES
    }


@pytest.mark.parametrize("block", [2, 3, 128])
def test_pair_correlations(frame, columns, monkeypatch, block):
    monkeypatch.setattr(wide, "BLOCK", block)
    names = [f for f in FEATURES if f != "wide"]
    got = {(r.feature_a, r.feature_b): (r.pairs, r.corr) for r in wide.pair_correlations(frame, names).collect()}
    want = {}
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            ok = np.isfinite(columns[a]) & np.isfinite(columns[b])
            x, y = columns[a][ok], columns[b][ok]
            flat = ok.sum() < 50 or x.std() <= 1e-12 or y.std() <= 1e-12
            want[a, b] = (int(ok.sum()), 0.0 if flat else float(np.corrcoef(x, y)[0, 1]))
    assert got.keys() == want.keys()
    for pair, (n, c) in want.items():
        assert got[pair][0] == n and got[pair][1] == pytest.approx(c, abs=1e-6), pair


def plain_forward(columns, features, label, top_n, most, force, least=50):
    def corr(x, y):
        ok = np.isfinite(x) & np.isfinite(y)
        if ok.sum() < least or np.std(x[ok]) <= 1e-12 or np.std(y[ok]) <= 1e-12:
            return 0.0
        return abs(float(np.corrcoef(x[ok], y[ok])[0, 1]))

    near = {f: corr(columns[f], columns[label]) for f in features}
    forced = [f for f in features if any(t in f for t in force)]
    pool = list(dict.fromkeys([*forced, *sorted(features, key=lambda f: (-near[f], f))[:top_n]]))
    taken = []
    for f in pool:
        if f in forced or max((corr(columns[f], columns[t]) for t in taken), default=0.0) < most:
            taken.append(f)
    return taken


def test_forward_selection_on_finite_pairs(spark):
    """Missing values decide: with 0 in their place other features would be taken."""
    rng = np.random.default_rng(5)
    n = 800
    y = (rng.random(n) < 0.5).astype(float)
    cols = {"label": y}
    for i in range(8):
        x = y * (i + 1) * 0.2 + rng.normal(3, 1, n)
        cols[f"f{i}"] = np.where(rng.random(n) < 0.3, np.nan, x)
        cols[f"twin{i}"] = np.where(rng.random(n) < 0.3, np.nan, x + rng.normal(0, 0.05, n))
    cols["seldom"] = np.where(np.arange(n) < 40, y, np.nan)
    features = [c for c in cols if c != "label"]
    rows = [tuple(None if math.isnan(v) else float(v) for v in r) for r in zip(*cols.values())]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols)).repartition(3)
    for top_n, force in ((6, ()), (17, ("twin0", "seldom"))):
        want = plain_forward(cols, features, "label", top_n, 0.9, force)
        assert selection.corr_forward(df, features, top_n, 0.9, force) == want
    zeros = {c: np.nan_to_num(v) for c, v in cols.items()}
    assert plain_forward(zeros, features, "label", 17, 0.9, ()) != plain_forward(cols, features, "label", 17, 0.9, ())


def test_gate_quantiles_skip_columns_without_values(spark):
    df = spark.createDataFrame([(float(i), None) for i in range(11)], "a double, b double")
    got = signals.fit_gate_quantiles(df, ["a", "b"]).collect()
    assert [tuple(r) for r in got] == [("a", 2.0, 3.5, 5.0, 6.5, 8.0)]


def test_plans_do_not_unpivot(spark, frame):
    for df in (
        selection.label_bins(frame, ["normal", "whole"]),
        selection.psi(frame.withColumn("p", F.lit(1)), ["normal"], F.col("label") == 1, "p"),
    ):
        plan = df._jdf.queryExecution().toString()
        assert "Expand" not in plan and "Unpivot" not in plan
