"""Alignment of two tokenizers against a plain computation from the libraries."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from barloom.llm import token_alignment as ta
from tests_llm_brute import key

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain_groups(texts):
    """Groups [(A ids, B ids)] of every text, by walking both token lists byte by byte."""
    a_side, b_side = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_side.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown}
    byte |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}

    def piece(i):
        p = b_side.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b_side.is_byte(i) else p.replace("▁", " ").encode()

    out = []
    for text in texts:
        groups = []
        if text:
            a = [(i, bytes(byte[c] for c in a_side.id_to_token(i))) for i in a_side.encode(" " + text, add_special_tokens=False).ids]
            b = [(i, piece(i)) for i in b_side.encode(text)]
            whole = (" " + text).encode()
            if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b):
                left, right, at_a, at_b, j = [], [], 0, 0, 0
                for i, x in a:
                    left.append(i)
                    at_a += len(x)
                    while at_b < at_a:
                        right.append(b[j][0])
                        at_b += len(b[j][1])
                        j += 1
                    if at_a == at_b:
                        groups.append((left, right))
                        left, right = [], []
        out.append(groups)
    return out


def plain(rows):
    found = plain_groups([t for _, t in rows])
    counts, links = Counter(), []
    for groups in found:
        mine = [(x, y) for left, right in groups for x in left for y in right]
        links.append(mine)
        counts.update(set(mine))
    top = defaultdict(int)
    for (x, _), n in counts.items():
        top[x] = max(top[x], n)
    out = []
    for (i, _), groups, mine in zip(rows, found, links):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append(
            (
                key(i), sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(mine),
                sum(counts[p] == top[p[0]] for p in mine), sum(counts[p] for p in mine),
                hashlib.sha256(text.encode()).hexdigest() if groups else "",
            )
        )
    return sorted(out)


def ours(df):
    return sorted((key(r[0]), *r[1:]) for r in df.collect())


ODD = [
    "a\tb\td   c", "  two blanks in front", "behind  ", "\n\n \n x", "<|endoftext|> and <s> <unk> <0x41>", "a▁b", "▁", "naïve 日本語 テキスト 😀 ок",
    "日本語のテキストには空白がありません。" * 30, " no break wide", "\x1c odd \x85 blanks", "x" * 900, "12 345 6789", "I'll don't we're", " ", "\n",
]


@pytest.fixture
def small(monkeypatch):
    """Runs, blobs, slices and merges of a few rows each."""
    for name, value in {"RUN_RECORDS": 400, "SEGMENT": 16, "FAN": 3, "SLICE": 200, "WIDE": 3, "MEMO_PARTS": 50, "RUN_DOCS": 9}.items():
        monkeypatch.setattr(ta, name, value)


def test_rows_of_every_kind(spark, make_docs, odd_rows):
    rows = [*odd_rows, *[(5000 + i, t) for i, t in enumerate(ODD)]]
    assert ours(ta.align(make_docs(rows), A, B)) == plain(rows)


def test_parts_slices_and_runs_change_nothing(small):
    """The code of the tasks, run here with tiny bounds: parts, slices, runs, merging over several levels."""
    rng = random.Random(3)
    texts = [*ODD, *[" ".join(rng.choice(("ab", "cd\nef", "gh,", "naïve", "ij  k")) for _ in range(rng.randint(1, 90))) for _ in range(40)]]
    sides = ta._sides(A, B)
    assert sides.cuts
    memo = ta.Memo(sides)
    _, numbers, written, (doc, pair, times) = ta.measure(memo, [ta.parts_of(t) for t in texts])
    whole = plain_groups(texts)
    for i, groups in enumerate(whole):
        links = Counter((x << 28) | y for left, right in groups for x in left for y in right)
        mine = doc == i
        assert dict(zip(pair[mine].tolist(), times[mine].tolist())) == links
        assert written[i].decode() == ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        if groups:
            assert numbers[i].tolist() == [sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), sum(links.values())]
        pieces = list(ta.slices_of(texts[i], 40))
        assert " ".join(pieces) == texts[i]
        assert [p for s in pieces for p in ta.parts_of(s)] == ta.parts_of(texts[i])


def test_many_runs_and_levels(spark, make_docs):
    """Bounds are read in the workers, so they are set there: by arguments frozen into the functions."""
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(("ab", "cd", "gh,", "naïve", "ij")) for _ in range(rng.randint(0, 30)))) for i in range(60)]
    docs = make_docs(rows).repartition(7)
    spilled = ta.stage(ta.spill_runs(docs, A, B), "test-runs")
    assert spilled.filter("radix IS NOT NULL").select("run").distinct().count() == 7
    old, ta.FAN = ta.FAN, 2
    try:
        counts, many = ta.pair_counts(spilled)
        assert ours(ta.gather(spilled, ta.stream_back(spilled, counts, many))) == plain(rows)
    finally:
        ta.FAN = old


def test_a_run_is_spilled_in_order(small):
    rng = np.random.default_rng(1)
    run = ta._Run(3)
    held = []
    for _ in range(4):
        doc = np.sort(rng.integers(0, 5, 300))
        pair = (rng.integers(0, 40, 300).astype(np.uint64) << np.uint64(28)) | rng.integers(0, 3, 300).astype(np.uint64)
        place = np.unique(np.stack((doc.astype(np.uint64), pair), 1), axis=0)
        doc, pair = place[:, 0].astype(np.int64), place[:, 1]
        held += list(zip((doc + run.docs).tolist(), pair.tolist()))
        run.add([0] * 5, np.zeros((5, 4), np.int64), [""] * 5, (doc, pair, np.ones(len(doc), np.int64)))
    assert run.full()
    seen = []
    for batch in run.spill():
        row = batch.to_pylist()[0]
        steps, documents = ta.unpack(row["pairs"])
        doc, times = ta.unpack(row["docs"])
        keys = np.cumsum(steps, dtype=np.uint64)
        assert keys[0] == row["first"] and (np.diff(keys.astype(np.int64)) > 0).all() and len(keys) <= 16
        assert set(ta.radix_of(keys).tolist()) == {row["radix"]}
        seen += list(zip(doc.tolist(), np.repeat(keys, documents.astype(int)).tolist()))
    assert sorted(seen) == sorted(held) and run.number == (3 << 32) + 1


def test_wide_groups_by_distinct_ids(small):
    a, b = np.array([1, 2, 1, 1, 5]), np.array([7, 7, 8, 9])
    key, owner, times = ta._links(a, b, np.array([0, 4, 5]), np.array([0, 3, 4]), np.array([0, 6]))
    found = Counter()
    for k, o, n in zip(key.tolist(), owner.tolist(), times.tolist()):
        found[o, k >> 28, k & ((1 << 28) - 1)] += n
    assert found == {(0, 1, 7): 6, (0, 1, 8): 3, (0, 2, 7): 2, (0, 2, 8): 1, (6, 5, 9): 1}


def test_empty_table(spark, make_docs):
    docs = make_docs([(1, "x")]).filter("doc_id > 5")
    assert ta.align(docs, A, B).collect() == []


def test_one_long_text(spark, make_docs, texts_seed=11):
    rng = random.Random(texts_seed)
    words = ["".join(rng.choice("abcdeé,") for _ in range(rng.randint(1, 7))) for _ in range(500)]
    rows = [(1, " ".join(rng.choice(words) for _ in range(200_000))), (2, " ".join(words)), (3, None)]
    assert len(rows[0][1]) > ta.SLICE
    assert ours(ta.align(make_docs(rows), A, B)) == plain(rows)
