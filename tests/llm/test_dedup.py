"""Exact and near duplicates and repeated passages, against brute force."""

import hashlib

import numpy as np
import pytest

from barloom.llm import anchors, debruijn_dedup, exact_dedup, parity_join, suffix_dedup
from tests_llm_brute import NULL, jaccard_brute, key, words

def collect(df):
    return [r.asDict() for r in df.collect()]


# --- exact ----------------------------------------------------------------------------------------------


def exact_brute(rows, history=()):
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    own, past = {(i, sha(t)) for i, t in rows}, {(i, sha(t)) for i, t in history}
    out = set()
    for i, s in own:
        old = [key(j) for j, u in past if u == s]
        new = [key(j) for j, u in own if u == s]
        keep = max(old or new)
        out.add((i, None if keep == NULL else keep, len(old) + len(new), not old and key(i) == keep, s))
    return out


def as_set(df):
    return {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in collect(df)}


def test_exact(make_docs, odd_rows):
    assert as_set(exact_dedup.exact_dedup(make_docs(odd_rows))) == exact_brute(odd_rows)


def test_exact_against_history(make_docs, odd_rows):
    history, new = odd_rows[::2], odd_rows[1::2]
    assert as_set(exact_dedup.exact_dedup(make_docs(new), make_docs(history))) == exact_brute(new, history)


def test_exact_empty(make_docs):
    assert collect(exact_dedup.exact_dedup(make_docs([]))) == []
    assert collect(exact_dedup.keep_one(make_docs([]))) == []


def test_exact_stage_keeps_one_row(make_docs, odd_rows):
    kept = collect(exact_dedup.keep_one(make_docs(odd_rows)))
    want = {(r[0], r[4]) for r in exact_brute(odd_rows) if r[3]}
    assert len(kept) == len(want)
    assert {(r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in kept} == want
    assert set(kept[0]) >= {"doc_id", "text", "lang", "source", "n_chars", "digest"}


@pytest.mark.parametrize("n", [1, 2, 3, 7, 500, 4000])
def test_index_is_minimal_and_perfect(n):
    digests = np.frombuffer(b"".join(hashlib.sha256(str(i).encode()).digest() for i in range(n)), np.uint8).reshape(-1, 32)
    displacement, slots = exact_dedup.build_index(digests)
    assert sorted(slots) == list(range(n))
    assert len(displacement) == n // exact_dedup.BUCKET + 1


# --- n-gram Jaccard -------------------------------------------------------------------------------------


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80), (1, 60), (2, 100)])
def test_similarity(make_docs, odd_rows, width, percent):
    rows = odd_rows
    got = collect(parity_join.similarity_components(make_docs(rows), width, percent))
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got} == jaccard_brute(rows, width, percent)
    assert len(got) == len(rows)


def test_similarity_of_chains(make_docs):
    """Neighbours are similar, ends are not; no hub is linked with all."""
    base = [f"w{i}" for i in range(200)]
    rows = [(100 - k, " ".join([*base[4 * k :], *[f"v{i}" for i in range(4 * k)]])) for k in range(40)]
    got = collect(parity_join.similarity_components(make_docs(rows), 1, 90))
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got} == jaccard_brute(rows, 1, 90)
    assert len({r["component_id"] for r in got}) == 1


def test_similarity_empty(make_docs):
    assert collect(parity_join.similarity_components(make_docs([]))) == []
    assert collect(parity_join.keep_representatives(make_docs([]))) == []


def test_similarity_stage(make_docs, odd_rows):
    rows = odd_rows
    kept = {r["doc_id"] for r in collect(parity_join.keep_representatives(make_docs(rows)))}
    assert kept == {i for i, _, c in jaccard_brute(rows, 5, 80) if i == c}


@pytest.mark.parametrize("percent", [60, 80, 90, 100])
def test_every_similar_pair_shares_a_band(percent):
    """Random pairs at and above the bound, of all sizes: each shares a key."""
    rng = np.random.default_rng(percent)
    for size in (1, 2, 3, 5, 9, 10, 11, 19, 20, 40, 150, 700):
        for _ in range(12):
            pool = np.unique(rng.integers(0, 1 << 63, 3 * size + 20, dtype=np.uint64))
            a = set(pool[:size].tolist())
            b = set(a)
            while True:
                other = set(b)
                if rng.random() < 0.5 and other:
                    other.discard(int(rng.choice(list(other))))
                else:
                    other.add(int(rng.choice(pool)))
                if not other or 100 * len(a & other) < percent * len(a | other):
                    break
                b = other
                if len(b) >= 2 * size + 10:
                    break
            sets = [np.array(sorted(s), np.uint64) for s in (a, b)]
            keys, owner = parity_join.band_keys(sets, percent)
            assert set(keys[owner == 0].tolist()) & set(keys[owner == 1].tolist())


def test_bands_of_a_set_of_millions():
    """More bands than 20 bits count; the same bands come out beside no other set."""
    rng = np.random.default_rng(0)
    big = np.unique(rng.integers(0, 1 << 63, 5_000_000, dtype=np.uint64))
    small = big[: 1000]
    keys, owner = parity_join.band_keys([big], 80)
    assert len(keys) > 1 << 20 and not owner.any()
    near = np.sort(np.concatenate((big[: len(big) * 9 // 10], np.unique(rng.integers(0, 1 << 63, 10_000, dtype=np.uint64)))))
    assert len(np.intersect1d(keys, parity_join.band_keys([near], 80)[0])) > 0
    alone = parity_join.band_keys([small], 80)[0]
    both, of = parity_join.band_keys([small, big[:40]], 80)
    assert sorted(both[of == 0].tolist()) == sorted(alone.tolist())


# --- repeated passages ----------------------------------------------------------------------------------


def passages_brute(rows, split, join, window):
    """Per row: units, units gone, runs, what is kept."""
    first = {}
    for i, t in rows:
        units = split(t)
        for k in range(len(units) - window + 1):
            at = tuple(units[k : k + window])
            first[at] = min(first.get(at, key(i)), key(i))
    gone_by_id = {}
    for i, t in rows:
        units = split(t)
        gone = np.zeros(len(units), bool)
        for k in range(len(units) - window + 1):
            if first[tuple(units[k : k + window])] < key(i):
                gone[k : k + window] = True
        gone_by_id.setdefault(i, []).append((units, gone))
    out = []
    for i, group in gone_by_id.items():
        for units, gone in group:
            runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
            out.append((key(i), len(units), int(gone.sum()), runs, join([u for u, g in zip(units, gone) if not g])))
    return sorted(out)


@pytest.mark.parametrize("window", [50, 20])
def test_word_passages(make_docs, odd_rows, window):
    got = collect(debruijn_dedup.remove_repeats(make_docs(odd_rows), window=window))
    want = passages_brute(odd_rows, words, b" ".join, window)
    assert sorted((key(r["doc_id"]), r["n_words"], r["n_removed"], r["kept"].encode()) for r in got) == [(a, b, c, e) for a, b, c, _, e in want]
    assert any(c for _, _, c, _, _ in want)


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 2, 0])
def test_byte_passages(make_docs, odd_rows, monkeypatch, hot):
    """Sorted suffixes, and the windows of leads that count as hot."""
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rows = odd_rows
    got = collect(suffix_dedup.remove_repeats(make_docs(rows)))
    want = passages_brute(rows, lambda t: list((t or "").encode()), bytes, 50)
    assert sorted((key(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got) == want


@pytest.mark.parametrize("window", [50, 8])
def test_word_spans_start_at_their_source_too(make_docs, odd_rows, window):
    """Every removed k-mer stands at the coordinates given for it, in a smaller document."""
    own = anchors.own_columns(make_docs(odd_rows), "doc_id", "text")
    texts = {(r["id"], r["part"]): words(r["text"]) for r in collect(own)}
    later, documents = anchors.copies(own)
    first = own.join(later, ["id", "part"], "left_anti")
    spans = collect(debruijn_dedup.repeated_spans(first, documents, window))
    assert spans
    for r in spans:
        here, there = texts[r["doc"], r["part"]], texts[r["source_doc"], r["source_part"]]
        size = r["n"] - 1 + window
        assert r["source_doc"] < r["doc"]
        assert here[r["start"] : r["start"] + size] == there[r["source_start"] : r["source_start"] + size]


def test_passages_empty(make_docs):
    assert collect(debruijn_dedup.remove_repeats(make_docs([]))) == []
    assert collect(suffix_dedup.remove_repeats(make_docs([]))) == []
    rows = [(1, None), (2, ""), (3, None)]
    assert [r["n_removed"] for r in collect(suffix_dedup.remove_repeats(make_docs(rows)))] == [0, 0, 0]


def test_one_passage_in_most_documents(make_docs):
    """A hot passage: all but its first document lose it."""
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"own{i} {passage} end{i}" if i % 3 else f"other words {i}") for i in range(1, 60)]
    for op, split, join in ((debruijn_dedup, words, b" ".join), (suffix_dedup, lambda t: list(t.encode()), bytes)):
        got = collect(op.remove_repeats(make_docs(rows)))
        want = passages_brute(rows, split, join, 50)
        assert sorted((r["doc_id"], r["n_removed"]) for r in got) == [(a, c) for a, _, c, _, _ in want]


def test_one_id_with_several_texts(make_docs):
    """Rows sharing an id keep their own texts, cuts and links."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(90)) for x in "abcd")
    near = b + " more"
    rows = [(1, a), (2, a), (2, b), (3, near), (4, f"{c} {b}"), (4, d), (5, f"x {d}"), (6, "  "), (6, c), (7, c), (0, d)]
    for op, split, join, n in ((debruijn_dedup, words, b" ".join, "words"), (suffix_dedup, lambda t: list(t.encode()), bytes, "bytes")):
        got = collect(op.remove_repeats(make_docs(rows)))
        want = passages_brute(rows, split, join, 50)
        kept = [r["kept"] if isinstance(r["kept"], (bytes, bytearray)) else r["kept"].encode() for r in got]
        assert sorted((r["doc_id"], r[f"n_{n}"], r["n_removed"], bytes(k)) for r, k in zip(got, kept)) == [(x, y, z, k) for x, y, z, _, k in want]
    got = collect(parity_join.similarity_components(make_docs(rows), 3, 80))
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got} == jaccard_brute(rows, 3, 80)
    assert len(got) == len(rows)


def test_multikey_sort():
    rng = np.random.default_rng(0)
    columns = [rng.integers(0, 3, 500).astype(np.uint64) for _ in range(6)]
    order, same = suffix_dedup.multikey_sort(columns)
    rows = list(zip(*[c.tolist() for c in columns]))
    ranked = [rows[i] for i in order]
    assert ranked == sorted(rows)
    assert same.tolist() == [False, *[a == b for a, b in zip(ranked, ranked[1:])]]
