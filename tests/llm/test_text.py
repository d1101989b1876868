"""Chats, archives, tokens, quality and decontamination."""

import hashlib
import io
import random
import re
import zlib

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

import public_tokenizers
from barloom.llm import chat_examples, huffman_ids, line_crf, prefix_bpe, template_decontam, warc


def collect(df):
    return [r.asDict() for r in df.collect()]


# --- chats ----------------------------------------------------------------------------------------------

CHATS = [
    (1, 0, "system", "be brief & <|end|> kind"),
    (1, 1, "user", "<|assistant|>no<|end|> &lt; &amp;bar;"),
    (1, 2, "assistant", "yes |> é\n"),
    (1, 3, "user", None),
    (1, 4, "assistant", None),
    (2, 5, "user", "only a question"),
    (3, 0, "assistant", "a"),
    (3, 0, "assistant", "a"),
    (None, 1, "user", "no id"),
    (None, 2, "assistant", "still"),
    (4, None, None, "no role"),
    (5, -1, "assistant", "z" * 50_000),
]


def chat_frame(spark, rows):
    schema = "conv_id long, turn long, role string, text string, block long, segment string, start long, seq string"
    return spark.createDataFrame([(*r, 1, "x", 2, "y") for r in rows], schema).repartition(3)


def chat_brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    out = {}
    for conv, turns in by.items():
        turns = sorted(turns, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        out[conv] = (len(turns), sha(said), len(loss), sha(loss))
    return out


def test_chats_are_read_back(spark):
    got = collect(chat_examples.read_back(chat_examples.format_turns(chat_frame(spark, CHATS))))
    assert {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in got} == chat_brute(CHATS)


def test_every_assistant_turn_is_an_example(spark):
    turns = chat_examples.format_turns(chat_frame(spark, CHATS))
    wanted = chat_examples.examples(turns)
    got = collect(chat_examples.example_text(wanted, turns))
    assert len(got) == sum(r[2] == "assistant" for r in CHATS)
    one = sorted((r for r in got if r["conv_id"] == 1), key=lambda r: r["target"])
    assert [r["target"] for r in one] == [3, 5]
    assert one[1]["text"].startswith(one[0]["text"])
    first = one[0]["text"]
    assert first[one[0]["loss_start"] : one[0]["loss_end"]] == "yes &bar;> é\n"
    assert first.count("<|end|>") == 3 and first.endswith("<|end|>")


def test_long_conversations_cross_blocks(spark, monkeypatch):
    monkeypatch.setattr(chat_examples, "BLOCK", 4)
    rows = [(9, k, "assistant" if k % 2 else "user", f"t{k}" * (k % 5)) for k in range(50)]
    got = collect(chat_examples.read_back(chat_examples.format_turns(chat_frame(spark, rows))))
    assert (got[0]["n_turns"], got[0]["turns_sha256"], got[0]["loss_chars"], got[0]["loss_sha256"]) == chat_brute(rows)[9]
    turns = sorted(collect(chat_examples.format_turns(chat_frame(spark, rows))), key=lambda r: r["seq"])
    assert [r["start"] for r in turns] == list(np.cumsum([0, *[len(r["segment"]) for r in turns]])[:-1])


def test_no_chats(spark):
    assert collect(chat_examples.read_back(chat_examples.format_turns(chat_frame(spark, [])))) == []


# --- archives -------------------------------------------------------------------------------------------


def test_archives(spark):
    long = "<p>" + "ü" * 90
    pages = [
        (5, "http://a/\r\nX: y", long),
        (3, None, long),
        (3, "http://twice", long),
        (8, "http://b", "short"),
        (9, "http://b", "short"),
        (10, "u", None),
        (11, "u", "WARC/1.1\r\nWARC-Type: revisit\r\n\r\n" * 9),
        (None, "u", "no id\r\n\r\n" * 40),
        (12, "u", "y" * 3_000_000),
        (13, "u", "\r\n\r\n"),
        (20, "u", long),
        (20, "u", "only here " * 40),
        (20, "u", "tiny"),
        (21, "u", "only here " * 40),
        (21, "u", long),
        (21, "u", long),
    ]
    frame = spark.createDataFrame([(*p, "d", 1) for p in pages], "page_id long, url string, html string, digest string, first long")
    got = collect(warc.round_trip(frame.repartition(3)))
    want = []
    for i, _, html in pages:
        data = (html or "").encode()
        same = [j for j, _, h in pages if (h or "") == (html or "") and j is not None]
        later = i is not None and len(data) >= 100 and i > min(same)
        want.append((str(i), len(data), hashlib.sha256(data).hexdigest(), "revisit" if later else "response", min(same) if later else None))
    names = ("payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted((str(r["page_id"]), *(r[n] for n in names)) for r in got) == sorted(want, key=lambda r: r[:4])


def test_no_pages(spark):
    frame = spark.createDataFrame([], "page_id long, url string, html string")
    assert collect(warc.round_trip(frame)) == []


def test_filters_reach_the_reader_and_skip_payloads():
    from pyspark.sql.datasource import EqualTo, GreaterThan

    reader = warc.WarcReader([("b", 40), ("a", 50), ("c", 30)], True, 70)
    left = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), GreaterThan(("payload_bytes",), 3)]))
    assert len(left) == 1 and reader.tests == [("record_type", frozenset(["revisit"]))]
    assert [p.paths for p in reader.partitions()] == [["a"], ["b", "c"]]

    class Raw(io.BytesIO):
        got = 0

        def read(self, n=-1):
            out = super().read(n)
            self.got += len(out)
            return out

    record = b"WARC/1.1\r\nWARC-Type: %s\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n"
    data = b"".join(record % (kind, len(body), body) for kind, body in ((b"response", b"x" * 5_000_000), (b"revisit", b""), (b"response", b"y")))
    raw = Raw(data)
    found = list(warc.read_records(warc._Buffered(raw), reader.tests))
    assert [h["warc-type"] for h, _ in found] == ["revisit"]
    assert raw.got < 2 * warc._Buffered.BLOCK + 100


# --- byte-level BPE -------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def encoder():
    return prefix_bpe.Encoder(prefix_bpe.ranks_of(None), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference_encoding(encoder):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=encoder.vocabulary.ranks, special_tokens={})


def noise(seed, n):
    rng = random.Random(seed)
    bits = [" ", "  ", "\n", "a", "the", "ing", "é", "ß", "1", "!", "\t", "中", "'s", "x́", "²", "\x1c", "😀", "<|endoftext|>", "\x85", "\xa0", "rr", "oo"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def test_encoding_equals_the_library(encoder, reference_encoding):
    for text in [*noise(1, 4000), "a" * 3000, "ab" * 2000, " " * 500, "Straßenbahnhaltestelle" * 30]:
        ids = np.frombuffer(encoder.encode_parts(text), "<i4").tolist()
        assert ids == reference_encoding.encode_ordinary(text)
        assert encoder.decode(ids) == text.encode()


def test_prefix_tables_grow_and_change(encoder):
    rng = random.Random(3)
    for text in noise(2, 300):
        data = (text * 8).encode()
        table = prefix_bpe.PrefixTable(encoder.vocabulary, data)
        a = rng.randint(0, len(data))
        b = rng.randint(a, len(data))
        computed = table.replace(a, b, b"the in")
        assert table.last == prefix_bpe.PrefixTable(encoder.vocabulary, data[:a] + b"the in" + data[b:]).last
        assert computed <= len(table.last)
        grown = prefix_bpe.PrefixTable(encoder.vocabulary, data[:a])
        grown.append(data[a:])
        assert grown.last == prefix_bpe.PrefixTable(encoder.vocabulary, data).last
    far = prefix_bpe.PrefixTable(encoder.vocabulary, b"some words and more " * 400)
    assert far.replace(10, 12, b"x") < 400


def test_tokens_of_a_table(make_docs, odd_rows, reference_encoding):
    docs, ranks = make_docs(odd_rows), prefix_bpe.ranks_of(None)
    got = collect(prefix_bpe.decode(prefix_bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks))
    want = sorted((str(i), reference_encoding.encode_ordinary(t or ""), (t or "").encode()) for i, t in odd_rows)
    assert sorted((str(r["doc_id"]), r["ids"], bytes(r["decoded"])) for r in got) == want
    digests = collect(prefix_bpe.encode_digests(docs, ranks, public_tokenizers.PATTERN))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in digests) == sorted(
        (i, len(ids), sha(",".join(map(str, ids)).encode()), sha(raw)) for i, ids, raw in want
    )
    assert collect(prefix_bpe.encode(make_docs([]), ranks, public_tokenizers.PATTERN)) == []


# --- token ids as files ---------------------------------------------------------------------------------


def optimal_cost(counts):
    import heapq

    heap = [int(c) for c in counts if c]
    if len(heap) == 1:
        return heap[0]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        cost += both
        heapq.heappush(heap, both)
    return cost


@pytest.mark.parametrize("n", [0, 1, 2, 3, 17, 900, 5000])
def test_codes(n):
    rng = np.random.default_rng(n)
    counts = np.zeros(n + 4, np.int64)
    counts[2 : n + 2] = rng.integers(1, 1000, n)
    lengths = huffman_ids.code_lengths(counts)
    assert (lengths > 0).sum() == n and lengths.max(initial=0) <= huffman_ids.LIMIT
    if n > 1:
        assert (2.0 ** -lengths[lengths > 0].astype(float)).sum() == 1.0
        assert (huffman_ids.code_lengths(counts, 40) * counts).sum() == optimal_cost(counts)
    code = huffman_ids.Code(lengths)
    for size in (0, 1, 63, 64, 65, 5000) if n else (0,):
        ids = rng.integers(2, n + 2, size) if n else np.zeros(0, np.int64)
        payload, marks = code.pack(ids)
        assert code.unpack(payload, marks, size).tolist() == ids.tolist()


def test_codes_are_limited():
    counts = np.array([2**k for k in range(40)], np.int64)
    lengths = huffman_ids.code_lengths(counts, 8)
    assert lengths.max() <= 8 and (2.0 ** -lengths.astype(float)).sum() == 1.0
    with pytest.raises(ValueError):
        huffman_ids.code_lengths(np.ones(300, np.int64), 8)


def test_blocks_hold_long_and_many_documents():
    rng = np.random.default_rng(0)
    docs = [(None, np.zeros(0, np.int32)), (3, rng.integers(0, 50, 200_000).astype(np.int32)), (3, np.array([1], np.int32)), (-5, rng.integers(0, 50, 65_535).astype(np.int32))]
    docs += [(i, np.zeros(0, np.int32)) for i in range(70_000)]
    code = huffman_ids.Code(huffman_ids.code_lengths(np.bincount(np.concatenate([d for _, d in docs]), minlength=50)))
    stream = io.BytesIO(huffman_ids.MAGIC + b"".join(huffman_ids.pack_blocks(code, iter(docs))))
    back = list(huffman_ids.unpack_blocks(code, stream))
    assert [(i, x.tolist()) for i, x in back] == [(i, x.tolist()) for i, x in docs]


def test_ids_round_trip(spark, make_docs, odd_rows):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    special = ["<|endoftext|>", "a <|endoftext|> b", "x<|endoftext|>\ny  z", "one <|endoftext|>two three"]
    blanks = ["a\tb\td   c", "a b\u00a0c  d", "\x1ca b\x85  c"]
    rows = [*odd_rows, *((9000 + i, t) for i, t in enumerate(special + blanks)), *((5000 + i, t) for i, t in enumerate(noise(4, 300)))]
    got = collect(huffman_ids.round_trip(make_docs(rows), path))
    ids = [(i, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in rows]
    at, want = 0, []
    for i, x in sorted(ids, key=lambda r: (r[0] is not None, r[0] or 0)):
        want.append((str(i), at, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        at += len(x)
    assert sorted((str(r["doc_id"]), r["start"], r["n_tokens"], r["ids_crc32"]) for r in got) == sorted(want)
    assert collect(huffman_ids.round_trip(make_docs([]), path)) == []


# --- quality --------------------------------------------------------------------------------------------


def test_marginals_equal_enumeration():
    from itertools import product

    rng = np.random.default_rng(1)
    sizes = [1, 3, 5, 2, 5]
    first = np.concatenate(([0], np.cumsum(sizes)))
    score, step = rng.normal(0, 2, first[-1]), rng.normal(0, 1, (2, 2))
    _, _, good = line_crf.marginals(score, first, step)
    for a, b in zip(first[:-1], first[1:]):
        weight, total = np.zeros(b - a), 0.0
        for states in product((0, 1), repeat=b - a):
            w = np.exp(sum(score[a + k] for k, s in enumerate(states) if s) + sum(step[x, y] for x, y in zip(states, states[1:])))
            total += w
            weight += w * np.array(states)
        assert np.allclose(good[a:b], weight / total)


def test_fit_follows_the_gradient():
    """On separable documents the fit separates; scores are within 0 and 1."""
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 9, 200)
    first = np.concatenate(([0], np.cumsum(sizes)))
    label = (np.arange(200) % 2).astype(int)
    features = rng.normal(0, 1, (first[-1], 4))
    features[:, 0] += np.repeat(label * 2 - 1, sizes) * 1.5
    model = line_crf.fit(features, first, label)
    quality = model.documents(features, np.full(first[-1], 10), first)
    assert ((quality > 0.5) == label).mean() > 0.97 and quality.min() >= 0 and quality.max() <= 1


def test_scores_do_not_depend_on_neighbours_in_a_batch():
    from barloom.llm.common import flat
    import pyarrow as pa

    texts = ["One line.\nTwo line.\n\n", "", None, "A | B | C\nA | B | C", "xx xx xx xx", "\n", "é" * 70 + "\nSHOUT!! SHOUT!!"]
    whole = line_crf.line_features(*flat(pa.array(texts)))
    at = 0
    for k, text in enumerate(texts):
        alone = line_crf.line_features(*flat(pa.array([text], pa.string())))
        n = len(alone[1])
        assert np.allclose(whole[0][at : at + n], alone[0]) and whole[1][at : at + n].tolist() == alone[1].tolist()
        assert n == (text or "").count("\n") + 1
        at += n


def test_quality_of_held_out_documents(spark):
    from barloom.llm import queries

    sf = "/root/testdata/sf0.01"
    got = collect(queries()["op10_line_crf"](spark, sf))
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    seen = [r["predicted"] == label[r["doc_id"]] for r in got if r["held_out"] and r["doc_id"] in label]
    assert len(seen) > 50 and np.mean(seen) >= 0.97


def test_quality_without_labels(spark, make_docs, odd_rows):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = make_docs(odd_rows)
    assert {r["score"] for r in collect(line_crf.score(docs, line_crf.train(docs, none)))} == {1.0}
    assert line_crf.keep_good(docs, none).count() == len(odd_rows)
    assert collect(line_crf.keep_good(make_docs([]), none)) == []


# --- decontamination ------------------------------------------------------------------------------------

ITEM = "Anna has 5 apples and gives 2 apples to Bob before she walks 3 km to the market where Anna sells 7 pears"
FILL = " ".join(f"filler{chr(97 + k % 26)} words of no matter" for k in range(30))


def leaked(spark, make_docs, texts, items):
    docs = make_docs(list(enumerate(texts)))
    bench = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, hash string, total int")
    got = {(r["doc_id"], r["item_id"]) for r in collect(template_decontam.leaks(docs, bench))}
    kept = {r["doc_id"] for r in collect(template_decontam.keep_clean(docs, bench))}
    assert kept == set(range(len(texts))) - {d for d, _ in got}
    report = {r["doc_id"]: (r["contaminated"], r["items"]) for r in collect(template_decontam.report(docs, bench))}
    assert {d for d, (bad, _) in report.items() if bad} == {d for d, _ in got} and len(report) == len(texts)
    return got


def test_leaks(spark, make_docs):
    changed = ITEM.replace("Anna", "Clara").replace("Bob", "Dirk").replace("5", "1,250").replace("2", "40").replace("km", "miles")
    mixed = ITEM.replace("Anna has", "Eve has").replace("to Bob", "to Tim")
    mixed = mixed.replace("where Anna", "where Olga")
    texts = [
        FILL + " " + ITEM + " " + FILL,
        FILL + "\n" + changed + ".\n" + FILL,
        FILL + " " + mixed.replace("5 apples", "6 apples") + " and Anna " + FILL,
        FILL,
        None,
        "",
        ITEM[:40],
        ITEM.replace(" ", "  "),
        FILL + " " + FILL,
    ]
    items = [(7, ITEM), (9, ITEM), (11, "too short to tell"), (12, None), (13, "")]
    got = leaked(spark, make_docs, texts, items)
    assert got == {(0, 7), (1, 7), (7, 7)} | ({(2, 7)} & got)
    assert (1, 7) in got


def test_slots_must_be_consistent(spark, make_docs):
    item = "the train from Rome to Bern leaves Rome at 9 and then goes back from Bern to Rome where people from Rome wait for Bern"
    names = iter(["Ulm", "Linz", "Graz", "Wien", "Kiel", "Bonn", "Köln", "Trier"])
    other = " ".join(next(names) if w in ("Rome", "Bern") else w for w in item.split())
    same = item.replace("Rome", "Oslo").replace("Bern", "Turku")
    assert leaked(spark, make_docs, [other, same], [(1, item)]) == {(1, 1)}


def test_repeated_lines_count_once(spark, make_docs):
    """One window shared with an item, repeated as often as the item has windows, is no leak."""
    item = "we count how many red boxes stand in this room when every second one of them is carried out again before noon"
    line = "we count how many red boxes stand in"
    texts = [" ; ".join(f"{line} k{i}" for i in range(60)), item]
    assert leaked(spark, make_docs, texts, [(1, item)]) == {(1, 1)}


def test_every_alignment_is_tested(spark, make_docs):
    """An inconsistent text of the same form, also under the same id, does not hide the item itself."""
    item = "the train from Rome to Bern leaves Rome at 9 and then goes back from Bern to Rome where people from Rome wait for Bern"
    names = iter(["Ulm", "Linz", "Graz", "Wien", "Kiel", "Bonn", "Köln", "Trier"])
    other = " ".join(next(names) if w in ("Rome", "Bern") else w for w in item.split())
    split = item.replace("and then", "and only then")
    assert leaked(spark, make_docs, [f"{other} {FILL} {item}", f"{other} {split}", other], [(1, item)]) == {(0, 1), (1, 1)}
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    for texts in ([other, item], [item, other]):
        got = collect(template_decontam.leaks(make_docs([(5, t) for t in texts]), bench))
        assert [(r["doc_id"], r["item_id"], r["coverage"]) for r in got] == [(5, 1, 1.0)]


def test_letter_case_does_not_matter(spark, make_docs):
    """Copies in capitals, in small letters, and of items in capitals; their numbers may change consistently."""
    german = "Die Straße nach Bern ist gesperrt weil Anna und Bob dort seit 3 Tagen Äpfel und Birnen an alle Leute verkaufen"
    texts = [
        f"{FILL} {ITEM.upper()} {FILL}",
        f"{FILL} {ITEM.lower()} {FILL}",
        ITEM.upper().replace("5", "11"),
        german.upper(),
        german.lower(),
        FILL.upper(),
    ]
    got = leaked(spark, make_docs, texts, [(1, ITEM), (2, german), (3, ITEM.upper() + " ONCE AGAIN")])
    assert got == {(0, 1), (1, 1), (2, 1), (3, 2), (4, 2), (0, 3), (1, 3), (2, 3)}


def test_no_benchmark_and_no_documents(spark, make_docs):
    assert leaked(spark, make_docs, [ITEM], []) == set()
    assert leaked(spark, make_docs, [], [(1, ITEM)]) == set()


def test_windows_equal_brute_force(spark, make_docs, odd_rows):
    """Every document that holds an item whole is found, and no other."""
    rows = [(i, t) for i, t in odd_rows if i is not None]
    text = dict(rows)
    items = [(k, " ".join((text[i] or "").split(" ")[3:40])) for k, i in enumerate(list(text)[:40:5])]
    items = [(k, item) for k, item in items if item not in [other for j, other in items if j < k]]  # equal items are one
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in collect(template_decontam.leaks(make_docs(rows), bench))}
    want = {(i, k) for k, item in items for i, t in rows if len(item.split()) >= 20 and item in (t or "")}
    assert want <= got
    assert all(len(set(dict(items)[k].split()) & set((text[i] or "").split())) > 4 for i, k in got)


SHORT_ITEMS = [
    (1, "What is the capital of France?"),
    (2, "Compute 12 * 7 + 5 and then 3 * 9 - 4"),
    (3, "List the primes 2 3 5 7 11 13 17 19 23 29"),
    (4, "too short to tell it"),
    (5, "three words only"),
    (6, "who wrote this old book"),
    (7, ITEM),
]


def plain_leaks(docs, items):
    """(doc, item) of items standing in documents word by word, whatever their letter case."""

    def words(text):
        joined = re.sub(r"(?<=[0-9])[.,:](?=[0-9])", "", text or "")
        return [w.upper().lower() for w in re.split(r"[\W_]+", joined) if w]

    found = set()
    for i, t in enumerate(docs):
        held = words(t)
        for k, item in items:
            sought = words(item)
            if len(sought) >= template_decontam.SHORTEST and any(held[j : j + len(sought)] == sought for j in range(len(held))):
                found.add((i, k))
    return found


def test_short_and_numeric_items(spark, make_docs):
    texts = [f"{FILL} {t} {FILL}" for _, t in SHORT_ITEMS] + [t.upper() for _, t in SHORT_ITEMS] + [f"x {t}" for _, t in SHORT_ITEMS]
    texts += [
        FILL, None, "the capital of France", "Compute 12 * 7 + 6 and then 3 * 9 - 4", "List the primes 2 3 5 7", "who wrote this new book",
        "too short to tell", " ".join(t for _, t in SHORT_ITEMS) * 3,
    ]
    got = leaked(spark, make_docs, texts, SHORT_ITEMS)
    assert got == plain_leaks(texts, SHORT_ITEMS)


def test_short_items_with_changed_slots(spark, make_docs):
    """Five ordinary words carry a typed window, whatever the length; fewer do not."""
    items = [(1, "how far is it from 3 km"), (2, "take 3 of 5 and 7 and 9 of 11")]
    texts = ["how far is it from 8 miles", "take 4 of 6 and 8 and 10 of 12", "take 3 of 5 and 7 and 9 of 11"]
    assert leaked(spark, make_docs, texts, items) == {(0, 1), (2, 2)}


@pytest.mark.parametrize("width", range(4, 9))
def test_hashes_of_every_width(spark, width):
    rows = [(["a", "b", "c", "d", "e", "f", "g", "h", "i", "a"][:n],) for n in range(11)]
    frame = spark.createDataFrame(rows, "t array<string>")
    made = frame.select("t", template_decontam.window_hashes(F.col("t"), width).alias("h")).collect()
    by_window = {}
    for r in made:
        windows = [tuple(r["t"][i : i + width]) for i in range(len(r["t"]) - width + 1)]
        assert len(r["h"]) == len(windows)
        for w, h in zip(windows, r["h"]):
            assert by_window.setdefault(w, h) == h
    assert len(set(by_window.values())) == len(by_window)


def test_other_vocabularies(encoder):
    """The parts shortcut gives what whole texts give, with tokens of two blanks and with other patterns."""
    ranks = {bytes([b]): b for b in range(256)} | {b"  ": 256, b" c": 257, b"\t ": 258}
    texts = ["a\tb\td   c", "a b  c", "a b c  c", "one two\nthree", "\x1ca b\x85  c"]
    for pattern in (public_tokenizers.PATTERN, r"\S+\s*|\s+", r".{1,3}"):
        own = prefix_bpe.Encoder(ranks, pattern)
        library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for text in texts:
            want = library.encode_ordinary(text)
            assert own.encode(text) == want
            assert np.frombuffer(own.encode_parts(text), "<i4").tolist() == want
