"""The pipeline against its parts in brute force, and the registered queries."""

import hashlib

import pytest

import __spark_entry__ as entry
import compare
import corpus_pipeline
from barloom.llm import prefix_bpe
from barloom.llm.common import stage
from tests_llm_brute import jaccard_brute

SF = "/root/testdata/sf0.001"


def collect(df):
    return [r.asDict() for r in df.collect()]


def test_stages_follow_each_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    left = docs
    seen = []
    for name, work in corpus_pipeline.STAGES[:-1]:
        left = work(spark, left, SF)
        assert left.columns == docs.columns
        left = spark.createDataFrame(left.collect(), docs.schema)
        seen.append({r["doc_id"] for r in left.select("doc_id").collect()})
    good, exact, near, clean = seen
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    wrong = [i for i in rows if i in label and (i in good) != (label[i] == 1)]
    assert len(wrong) <= 0.03 * len(label)
    best = {}
    for i in good:
        key = hashlib.sha256((rows[i] or "").encode()).digest()
        best[key] = max(best.get(key, i), i)
    assert exact == set(best.values())
    assert near == {i for i, _, c in jaccard_brute([(i, rows[i]) for i in exact], 5, 80) if i == c}
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaked = {i for i in near if any(item and item in (rows[i] or "") for item in items)}
    assert not leaked & clean and near - clean == leaked
    got = {r["doc_id"]: r["ids"] for r in collect(corpus_pipeline.run(spark, SF))}
    assert set(got) == clean
    names = {n: b for b, n in prefix_bpe.ranks_of(None).items()}
    assert all(b"".join(names[t] for t in ids) == (rows[i] or "").encode() for i, ids in got.items())


def test_stages_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, work in corpus_pipeline.STAGES:
        assert work(spark, docs, SF).count() == 0


def test_odd_rows_go_through_the_chain(spark, make_docs, odd_rows):
    """Null and empty texts, repeated rows, a null id, clashing columns: every stage on what the one before kept."""
    docs = make_docs(odd_rows)
    kept = corpus_pipeline.quality(spark, docs, SF)
    assert set(collect_ids(kept)) <= set(collect_ids(docs)) and kept.columns == docs.columns
    left, rows = docs, list(odd_rows)
    best = {}
    for i, t in rows:
        digest = hashlib.sha256((t or "").encode()).digest()
        best[digest] = max((x for x in (i, best.get(digest)) if x is not None), default=None)
    rows = [(i, t) for i, t in dict.fromkeys(rows) if best[hashlib.sha256((t or "").encode()).digest()] == i]
    left = stage(corpus_pipeline.exact(spark, left, SF), "odd-exact")
    assert sorted(collect_ids(left), key=str) == sorted((i for i, _ in rows), key=str)
    near = {i for i, _, c in jaccard_brute(rows, 5, 80) if i == c}
    rows = [(i, t) for i, t in rows if i in near]
    left = stage(corpus_pipeline.near(spark, left, SF), "odd-near")
    assert sorted(collect_ids(left), key=str) == sorted((i for i, _ in rows), key=str)
    left = stage(corpus_pipeline.decontaminate(spark, left, SF), "odd-clean")
    assert left.columns == docs.columns
    assert sorted(collect_ids(left), key=str) == sorted((i for i, _ in rows), key=str)
    names = {n: b for b, n in prefix_bpe.ranks_of(None).items()}
    got = sorted((str(r["doc_id"]), b"".join(names[t] for t in r["ids"])) for r in collect(corpus_pipeline.tokens(spark, left, SF)))
    assert got == sorted((str(i), (t or "").encode()) for i, t in rows)


def collect_ids(df):
    return [r["doc_id"] for r in df.select("doc_id").collect()]


@pytest.mark.parametrize("name", ["op4_chat_examples", "op6_exact_dedup", "op9_warc"])
def test_query_equals_sql(spark, name):
    ok, note = compare.compare(name, spark, compare.connect(SF), SF)
    assert ok, note


def test_every_operator_has_a_query():
    names = {n.split("_")[0] for n in entry.queries() if n.startswith("op")}
    assert names == {f"op{n}" for n in range(1, 14)} and "pipeline" in entry.queries()
