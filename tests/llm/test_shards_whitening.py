"""Balanced shards and whitening against plain computations."""

import zlib
from fractions import Fraction

import numpy as np
import pytest

from barloom.llm import balanced_shards as shards
from barloom.llm import embedding_whitening as white


def check_shards(rows, found, n):
    """Rows of `found` in order of shard and slot follow doc_id, and every row's middle byte lies in its shard's stretch."""
    found = sorted(found, key=lambda r: (r.shard, r.slot))
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.size, r.text_crc32) for r in found) == sorted(
        (i is not None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows
    )
    ids = [-1 if r.doc_id is None else r.doc_id for r in found]
    assert ids == sorted(ids)
    total, before, slots = sum(r.size for r in found), 0, {}
    for r in found:
        assert r.shard == (2 * before + r.size) * n // (2 * total)
        assert r.slot == slots.get(r.shard, 0)
        assert r.law == "bytes" and r.grown_shard is None
        slots[r.shard] = r.slot + 1
        before += r.size
    assert all(0 <= r.shard < n for r in found)


@pytest.mark.parametrize("n", [1, 3, 8])
def test_shards(spark, make_docs, odd_rows, n):
    check_shards(odd_rows, shards.assign(make_docs(odd_rows), n).collect(), n)


def test_one_doc_id_holds_most_rows(spark, make_docs):
    rows = [(7, "the very same row")] * 400 + [(i, "x" * i) for i in range(40)] + [(None, None)] * 30
    check_shards(rows, shards.assign(make_docs(rows)).collect(), 8)


def test_one_row_and_none(spark, make_docs):
    docs = make_docs([(4, None)])
    check_shards([(4, None)], shards.assign(docs).collect(), 8)
    assert shards.assign(docs.filter("doc_id > 9")).collect() == []


def test_written_shards_hold_the_assigned_rows(spark, make_docs, odd_rows, tmp_path):
    docs = make_docs(odd_rows).withColumnRenamed("component", "shard")
    shards.write_shards(docs, str(tmp_path / "out"), 5)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert set(back.columns) == set(docs.columns)
    written = sorted((r.shard, r.doc_id or -1, r.text or "") for r in back.collect())
    sizes = {}
    for shard, _, text in written:
        sizes[shard] = sizes.get(shard, 0) + len(text.encode()) + 1
    told = shards.assign(docs, 5).groupBy("shard").sum("size").collect()
    assert sizes == {r[0]: r[1] for r in told}
    assert sorted((i or -1, t or "") for i, t in odd_rows) == sorted((i, t) for _, i, t in written)


# --- whitening -----------------------------------------------------------------------------------------


def vectors(spark, rows):
    return spark.createDataFrame(
        [(i, v, 1, 2.0, [3]) for i, v in rows], "vec_id long, embedding array<float>, n int, whitened double, x array<long>"
    ).repartition(3)


def plain(rows, dims, k=4):
    kept = [(i, [int(np.floor(256 * float(np.float32(c)))) for c in v]) for i, v in rows]
    fit = [list(x) for x in sorted({tuple(x) for _, x in kept})]
    n, sums = len(fit), [sum(x[d] for x in fit) for d in range(dims)]
    d = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(x, sums)] for x in fit])
    values, parts = np.linalg.eigh(d.T @ d / n)
    values, parts = values[::-1][:k], parts[:, ::-1][:, :k]
    dev = {i: sum((n * c - s) ** 2 for c, s in zip(x, sums)) for i, x in kept}
    own = {i: np.array([float(Fraction(n * c - s, n)) for c, s in zip(x, sums)]) @ parts / np.sqrt(values) for i, x in kept}
    return n, dev, own, values / np.trace(d.T @ d / n)


def test_whitening(spark):
    rng = np.random.default_rng(2)
    spread = np.array([3.0, 2.0, 1.5, 1.2, 0.4, 0.3, 0.2])
    rows = [(i, (rng.normal(0, 1, 7) * spread).astype(np.float32).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(150)]
    bad = [(1, None), (2, [1.0, None, *[0.0] * 5]), (3, [float("nan")] * 7), (4, [float("inf"), *[0.0] * 6]), (5, [1.0, 2.0]), (6, []), (7, [3e38, *[0.0] * 6])]
    found = white.whitened(vectors(spark, rows + [(9000 + i, v) for i, v in bad])).collect()
    n, dev, own, share = plain(rows, 7)
    assert n == 300 and len(found) == 4 * len(rows)
    sign = {}
    for r in found:
        want = own[r.vec_id][r.component - 1]
        sign.setdefault(r.component, np.sign(r.whitened * want))
        assert r.whitened * sign[r.component] == pytest.approx(want, abs=1e-9)
        assert (r.n, r.deviation) == (300, dev[r.vec_id])
        assert r.explained == pytest.approx(share[r.component - 1], rel=1e-9)
        assert r.identity_error < 1e-9


def test_fewer_components_than_asked_for(spark):
    rows = [(1, [1.0, 2.0, 4.0]), (2, [2.0, 4.0, 8.0]), (3, [1.0, 2.0, 4.0]), (None, [4.0, 8.0, 16.0])]
    found = white.whitened(vectors(spark, rows)).collect()
    assert len(found) == 12
    for r in found:
        assert (r.whitened is None) == (r.component > 1) and r.identity_error < 1e-9
        assert r.explained == pytest.approx(1.0 if r.component == 1 else 0.0)
    same = white.whitened(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert [(r.whitened, r.deviation, r.identity_error) for r in same] == [(None, 0, None)] * 4


def test_no_vectors(spark):
    assert white.whitened(vectors(spark, [(1, None), (2, [])])).collect() == []
    assert white.whitened(vectors(spark, [(1, [1.0])]).filter("vec_id > 3")).collect() == []


def test_large_entries_stay_exact(spark):
    rows = [(1, [2.0**45, 1.0]), (2, [-(2.0**45), 2.0]), (3, [0.0, 7.0]), (4, [2.0**20, 7.0])]
    found = {r.vec_id: r.deviation for r in white.whitened(vectors(spark, rows)).collect()}
    _, dev, _, _ = plain(rows, 2, 1)
    assert found == {i: (d if d < 2**63 else None) for i, d in dev.items()}


@pytest.mark.parametrize("rank", [1, 4, 9, 12])
def test_spectrum(rank):
    rng = np.random.default_rng(rank)
    half = rng.normal(0, 1, (12, rank)) * np.logspace(0, -5, rank)
    v = half @ half.T
    factor, pivots = white.pivoted_cholesky(v)
    assert factor.shape == (12, rank) and np.allclose(factor @ factor.T, v[np.ix_(pivots, pivots)], atol=1e-14)
    values, parts = white.spectrum(v)
    assert np.allclose(values[:3], np.linalg.eigvalsh(v)[::-1][: min(3, rank)], rtol=1e-9)
    assert np.allclose(parts.T @ parts, np.eye(rank), atol=1e-12)
    assert np.allclose(parts * values @ parts.T, v, atol=1e-13)
