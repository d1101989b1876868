"""Alignment of two tokenizers over the same bytes: groups, links, and how often the corpus links each pair of ids.

Byte offsets where a token of A and a token of B both end cut a text into groups; every A token of a group is linked with
every B token of it. The count of an id pair is the number of documents that link it.

Counting is external, by spilled runs:

1. A task tokenises its documents and collects records (pair, document, times). Full, it sorts them by the A id's radix
   partition, then A id, then B id, and spills a run: zstd blobs of pairs with their number of documents, and, apart,
   of the documents. Runs go to the shared folder through Spark's writer, so a lost executor costs its tasks only.
2. The runs of a radix partition are merged by a k-way heap, FAN runs at a time until one is left. Equal pairs meet and
   their numbers of documents are added. The order is side-major, so the last pair of an A id closes its maximum.
3. Counts and maxima stream back to the runs, partition by partition, and leave sums per document of a run; a run's
   sums and its documents meet in one task.

A pair held by every document is one entry per run: neither a very common pair nor a group of copies meets in a task.
Links inside a document are counted by distinct ids and words, not written out one by one.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import RUN_BYTES, load, mix, query, single_blanks, stage, text_column

#: Radix partitions of the A ids; runs merged at a time; pairs in a blob.
RADIX, FAN, SEGMENT = 64, 64, 1 << 14
#: Records and documents of a run, at most about (a document is never cut).
RUN_RECORDS, RUN_DOCS = 2_000_000, 100_000
#: Characters of a slice of a long text; parts and bytes of the memo before it starts anew.
SLICE, MEMO_PARTS, MEMO_BYTES = 1 << 19, 200_000, 1 << 25
#: New parts spelled as one text.
TOGETHER = 4096
#: Links of a group that are counted by distinct ids from here on.
WIDE = 1 << 16
_BITS = np.uint64(28)
_NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


def pack(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers as one zstd blob, each in byte planes."""
    body = [len(c).to_bytes(8, "little") + c.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(body))


def unpack(blob: bytes) -> list[np.ndarray]:
    data, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    while at < len(data):
        n = int.from_bytes(data[at : at + 8], "little")
        planes = np.frombuffer(data, np.uint8, 8 * n, at + 8).reshape(8, n)
        out.append(np.ascontiguousarray(planes.T).view("<u8").ravel())
        at += 8 + 8 * n
    return out


# --- tokens of the two sides ---------------------------------------------------------------------------


def _byte_level() -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves and the others, in order, from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Sides:
    """Both tokenizers, and the bytes of each of their tokens."""

    def __init__(self, a_path: str, b_path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        written = _byte_level()
        size = max(self.a.get_vocab().values()) + 1
        tokens = [self.a.id_to_token(i) or "" for i in range(size)]
        self.a_bytes = [bytes(map(written.__getitem__, t)) if all(c in written for c in t) else t.encode() for t in tokens]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]
        self.names = [f"{i}{tail}" for i in range(size) for tail in ",|"] + [f"{i}{tail}" for i in range(len(pieces)) for tail in ",;\n"]
        self.a_sizes = np.array(list(map(len, self.a_bytes)), np.int64)
        self.b_sizes = np.array(list(map(len, self.b_bytes)), np.int64)
        # Where no piece of B goes on across a space, texts may be cut in front of single spaces: A's pattern cuts there too.
        self.cuts = not any(re.search("[^▁]▁", p) for p in pieces)


@cache
def _sides(a_path: str, b_path: str) -> Sides:
    return Sides(a_path, b_path)


_CUT = re.compile(r"(?<=\S) (?=\S)")


def parts_of(text: str) -> list[str]:
    """The text cut at every space that stands between two characters that are not white space."""
    return text.split(" ") if single_blanks(text) else _CUT.split(text)


def slices_of(text: str, size: int = SLICE) -> Iterator[str]:
    """Pieces of about `size` characters, cut at such spaces only."""
    start = 0
    while len(text) - start > size:
        found = _CUT.search(text, start + size)
        if found is None:
            break
        yield text[start : found.start()]
        start = found.end()
    yield text[start:]


class Memo:
    """Groups and links of the parts seen. Both end at a part's end, so a text's are those of its parts in turn."""

    def __init__(self, sides: Sides) -> None:
        self.sides = sides
        self.at: dict[str, int] = {}
        self.pair_at: dict[int, int] = {}
        self.texts: list[bytes] = []
        self.bytes = 0
        self.fits = np.zeros(0, bool)
        self.numbers = np.zeros((0, 4), np.int64)
        self.starts = np.zeros(1, np.int64)
        self.pairs = np.zeros(0, np.int64)
        self.times = np.zeros(0, np.int64)
        self.keys = np.zeros(0, np.uint64)

    def full(self) -> bool:
        return len(self.at) > MEMO_PARTS or self.bytes > MEMO_BYTES

    def find(self, parts: list[str]) -> np.ndarray:
        """Numbers of the parts, new ones taken up first."""
        found = list(map(self.at.get, parts))
        if None in found:
            new = list(dict.fromkeys(p for p, i in zip(parts, found) if i is None))
            self._add(new)
            found = list(map(self.at.__getitem__, parts))
        return np.array(found, np.int64)

    def _add(self, parts: list[str]) -> None:
        """Take up new parts. Those without blanks at their ends are spelled together, as one text of them."""
        plain, odd = [], []
        for p in parts:
            (odd if p[0].isspace() or p[-1].isspace() else plain).append(p)
        if not self.sides.cuts:
            plain, odd = [], parts
        for first in range(0, len(plain), TOGETHER):
            some = plain[first : first + TOGETHER]
            if not self._spelled(some, self._ids(" ".join(some))):
                odd += some
        for p in odd:
            if not self._spelled([p], self._ids(p)):
                self._take([p], False, np.zeros((1, 4), np.int64), [b""], np.zeros(1, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))

    def _ids(self, text: str) -> tuple[list[int], list[int]]:
        s = self.sides
        return s.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids, s.b.encode(text, num_threads=1)

    def _spelled(self, parts: list[str], ids: tuple[list[int], list[int]]) -> bool:
        """Take up parts that both sides spell byte for byte; else tell that they don't."""
        s = self.sides
        wanted = " " + " ".join(parts)
        whole = wanted.encode()
        if not all(b"".join(map(table.__getitem__, side)) == whole for table, side in zip((s.a_bytes, s.b_bytes), ids)):
            return False
        a, b = (np.array(side, np.int64) for side in ids)
        a_ends, b_ends = np.cumsum(s.a_sizes[a]), np.cumsum(s.b_sizes[b])
        ends = a_ends[np.isin(a_ends, b_ends, assume_unique=True)]
        ascii_only = len(whole) == len(wanted)
        part_ends = np.cumsum([len(p) + 1 if ascii_only else len(p.encode()) + 1 for p in parts])
        owner = np.searchsorted(part_ends, ends)
        a_of, b_of = np.searchsorted(ends, a_ends), np.searchsorted(ends, b_ends)
        groups = len(ends)
        n_a, n_b = np.bincount(a_of, minlength=groups), np.bincount(b_of, minlength=groups)
        a_at, b_at = np.concatenate(([0], np.cumsum(n_a))), np.concatenate(([0], np.cumsum(n_b)))
        first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        numbers = np.add.reduceat(np.stack((n_a, n_b, np.ones(groups, np.int64), n_a * n_b), axis=1), first)
        key, link_owner, times = _links(a, b, a_at, b_at, owner)
        order = np.lexsort((key, link_owner))
        key, link_owner, times = _fold(times[order], key[order], link_owner[order])
        # Every id with what follows it: "," inside a side of a group, "|" between sides, ";" and a line feed behind.
        line = np.empty(len(a) + len(b), np.int64)
        start = a_at[:-1] + b_at[:-1]
        a_last = np.isin(np.arange(len(a)), a_at[1:] - 1)
        closes = np.ones(groups, np.int64)
        closes[np.concatenate((first[1:], [groups])) - 1] = 2
        b_tail = np.where(np.isin(np.arange(len(b)), b_at[1:] - 1), closes[b_of], 0)
        line[start[a_of] + np.arange(len(a)) - a_at[a_of]] = a * 2 + a_last
        line[start[b_of] + n_a[b_of] + np.arange(len(b)) - b_at[b_of]] = 2 * len(s.a_bytes) + b * 3 + b_tail
        texts = "".join(map(s.names.__getitem__, line.tolist()))[:-1].encode().split(b"\n")
        self._take(parts, True, numbers, texts, np.bincount(link_owner, minlength=len(parts)), key, times)
        return True

    def _take(self, parts: list[str], fits: bool, numbers: np.ndarray, texts: list[bytes], links: np.ndarray, key: np.ndarray, times: np.ndarray) -> None:
        distinct, which = np.unique(key, return_inverse=True)
        known = [self.pair_at.setdefault(k, len(self.pair_at)) for k in distinct.tolist()]
        keys = np.zeros(len(self.pair_at), np.uint64)
        keys[: len(self.keys)] = self.keys
        keys[known] = distinct
        self.keys = keys
        at = len(self.at)
        self.at.update(zip(parts, range(at, at + len(parts))))
        self.texts += texts
        self.bytes += sum(map(len, texts)) + sum(map(len, parts)) + 16 * len(key)
        self.fits = np.concatenate((self.fits, np.full(len(parts), fits)))
        self.numbers = np.concatenate((self.numbers, numbers))
        self.starts = np.concatenate((self.starts, self.starts[-1] + np.cumsum(links)))
        self.pairs = np.concatenate((self.pairs, np.array(known, np.int64)[which]))
        self.times = np.concatenate((self.times, times))


def _fold(times: np.ndarray, *sorted_keys: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of equal keys as one row each, `times` added up (and given last)."""
    if not len(times):
        return *sorted_keys, times
    new = np.zeros(len(times), bool)
    new[0] = True
    for k in sorted_keys:
        new[1:] |= k[1:] != k[:-1]
    first = np.flatnonzero(new)
    return *[k[first] for k in sorted_keys], np.add.reduceat(times, first)


def _links(a: np.ndarray, b: np.ndarray, a_at: np.ndarray, b_at: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key, owner and times of the id pairs of all groups; equal pairs of a group may come several times."""
    n_a, n_b = np.diff(a_at), np.diff(b_at)
    links = n_a * n_b
    narrow = np.flatnonzero(links < WIDE)
    group = np.repeat(narrow, links[narrow])
    before = np.cumsum(links[narrow]) - links[narrow]
    nth = np.arange(len(group)) - np.repeat(before, links[narrow])
    left, right = a[a_at[group] + nth // n_b[group]], b[b_at[group] + nth % n_b[group]]
    keys, owners, times = [_key(left, right)], [owner[group]], [np.ones(len(group), np.int64)]
    for g in np.flatnonzero(links >= WIDE).tolist():
        left, left_n = np.unique(a[a_at[g] : a_at[g + 1]], return_counts=True)
        right, right_n = np.unique(b[b_at[g] : b_at[g + 1]], return_counts=True)
        keys.append(_key(np.repeat(left, len(right)), np.tile(right, len(left))))
        owners.append(np.full(len(keys[-1]), owner[g]))
        times.append(np.outer(left_n, right_n).ravel())
    return np.concatenate(keys), np.concatenate(owners), np.concatenate(times)


def _key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a.astype(np.uint64) << _BITS) | b.astype(np.uint64)


def measure(memo: Memo, parts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, list[bytes], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of every text, given as parts: whether both sides spell it, its numbers, its groups as text; and (doc, key, times)."""
    sizes = np.array(list(map(len, parts)), np.int64)
    words = memo.find([p for text in parts for p in text])
    doc = np.repeat(np.arange(len(parts)), sizes)
    wrong = np.bincount(doc, weights=~memo.fits[words], minlength=len(parts)) > 0
    ends = np.cumsum(sizes)
    places = words.tolist()
    texts = [b"" if bad else b";".join(map(memo.texts.__getitem__, places[e - n : e])) for bad, e, n in zip(wrong.tolist(), ends.tolist(), sizes.tolist())]
    good = ~wrong[doc]
    # Words of a document are folded before their links are laid out.
    word_keys = np.sort(doc[good] * len(memo.at) + words[good])
    word_keys, often = _fold(np.ones(len(word_keys), np.int64), word_keys)
    doc, words = word_keys // max(len(memo.at), 1), word_keys % max(len(memo.at), 1)
    numbers = np.zeros((len(parts), 4), np.int64)
    if len(words):
        first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
        numbers[doc[first]] = np.add.reduceat(memo.numbers[words] * often[:, None], first)
    n = memo.starts[words + 1] - memo.starts[words]
    at = np.repeat(memo.starts[words] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    pair_keys = np.repeat(doc, n) * len(memo.keys) + memo.pairs[at]
    times = memo.times[at] * np.repeat(often, n)
    order = np.argsort(pair_keys, kind="stable")
    pair_keys, times = _fold(times[order], pair_keys[order])
    size = max(len(memo.keys), 1)
    return ~wrong, numbers, texts, (pair_keys // size, memo.keys[pair_keys % size], times)


# --- runs ----------------------------------------------------------------------------------------------

SPILL = (
    "run bigint, at int, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
    "radix int, first bigint, pairs binary, docs binary"
)
_SPILL_TYPES = [pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]


def _rows(n: int, **columns) -> pa.RecordBatch:
    names = [c.split()[0] for c in SPILL.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in zip(names, _SPILL_TYPES)], names=names)


class _Run:
    """Records of the run being filled."""

    def __init__(self, task: int) -> None:
        self.number, self.docs, self.held = task << 32, 0, 0
        self.records: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, ids: list, numbers: np.ndarray, digests: list[str], records: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
        doc, key, times = records
        self.records.append((doc + self.docs, key, times))
        self.held += len(key)
        n, first = len(ids), self.docs
        self.docs += n
        columns = {name: numbers[:, i] for i, name in enumerate(_NUMBERS)}
        return _rows(n, run=np.full(n, self.number), at=np.arange(first, first + n, dtype=np.int32), doc_id=ids, groups_sha256=digests, **columns)

    def full(self) -> bool:
        return self.held >= RUN_RECORDS or self.docs >= RUN_DOCS

    def spill(self) -> Iterator[pa.RecordBatch]:
        """Blobs in order of radix, A id and B id; documents ascend within a pair, as they came."""
        doc, key, times = (np.concatenate(c) for c in zip(*self.records))
        place = (radix_of(key) << np.uint64(56)) | key
        order = np.argsort(place, kind="stable")
        place, doc, times = place[order], doc[order], times[order]
        pair, documents = _fold(np.ones(len(place), np.int64), place)
        ends = np.cumsum(documents)
        radix = (pair >> np.uint64(56)).astype(np.int64)
        edges = np.flatnonzero(np.concatenate(([True], radix[1:] != radix[:-1], [True]))) if len(pair) else np.zeros(1, np.int64)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            for first in range(a, b, SEGMENT):
                last = min(first + SEGMENT, b)
                keys = pair[first:last] & np.uint64((1 << 56) - 1)
                d0, d1 = ends[first] - documents[first], ends[last - 1]
                yield _rows(
                    1, run=[self.number], radix=[int(radix[first])], first=[int(keys[0])],
                    pairs=[pack(np.diff(keys, prepend=np.uint64(0)), documents[first:last])],
                    docs=[pack(doc[d0:d1], times[d0:d1])],
                )
        self.number, self.docs, self.held, self.records = self.number + 1, 0, 0, []


def radix_of(key: np.ndarray) -> np.ndarray:
    return mix(key >> _BITS) % np.uint64(RADIX)


def spill_runs(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of documents (numbered within their run) and rows of runs, for `stage`."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = _sides(a_path, b_path)
        run, memo = _Run(TaskContext.get().partitionId()), Memo(sides)
        cut = parts_of if sides.cuts else lambda text: [text]

        def short(ids: list, texts: list[str]) -> pa.RecordBatch:
            _, numbers, written, records = measure(memo, [cut(t) if t else [] for t in texts])
            return run.add(ids, numbers, [hashlib.sha256(w).hexdigest() if w else "" for w in written], records)

        def long(one, text: str) -> pa.RecordBatch:
            nonlocal memo
            digest, total, fits, records = hashlib.sha256(), np.zeros((1, 4), np.int64), True, []
            for i, piece in enumerate(slices_of(text) if sides.cuts else [text]):
                if memo.full():
                    memo = Memo(sides)
                good, numbers, written, found = measure(memo, [cut(piece)])
                fits = fits and bool(good[0])
                digest.update((b";" if i else b"") + written[0])
                total += numbers
                records.append(found[1:])
            key, times = (np.concatenate(c) for c in zip(*records))
            order = np.argsort(key, kind="stable")
            key, times = _fold(times[order], key[order])
            if not fits:
                key, times, total = key[:0], times[:0], total * 0
            return run.add([one], total, [digest.hexdigest() if fits else ""], (np.zeros(len(key), np.int64), key, times))

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            held_ids, held, size = [], [], 0
            for one, text in zip(ids, texts):
                if len(text) > SLICE:
                    yield long(one, text)
                else:
                    held_ids.append(one)
                    held.append(text)
                    size += len(text)
                if size >= RUN_BYTES:
                    if memo.full():
                        memo = Memo(sides)
                    yield short(held_ids, held)
                    held_ids, held, size = [], [], 0
                if run.full():
                    if held:
                        yield short(held_ids, held)
                        held_ids, held, size = [], [], 0
                    yield from run.spill()
            if held:
                yield short(held_ids, held)
        if run.docs:
            yield from run.spill()

    return text_column(docs, id_col, text_col).mapInArrow(work, SPILL)


# --- merging -------------------------------------------------------------------------------------------

COUNTS = "radix int, run bigint, first bigint, pairs binary"


def _cursor(blobs: list[bytes]) -> Iterator[tuple[int, int]]:
    """Pairs and numbers of documents of one run, in order; one blob is open at a time."""
    for blob in blobs:
        steps, documents = unpack(blob)
        yield from zip(np.cumsum(steps, dtype=np.uint64).tolist(), documents.tolist())


def merged(runs: Iterable[list[bytes]]) -> Iterator[tuple[int, int]]:
    """Every pair of the runs once, in order, with its documents added up."""
    for key, same in groupby(heapq.merge(*map(_cursor, runs)), key=itemgetter(0)):
        yield key, sum(n for _, n in same)


def _blobs(pairs: Iterator[tuple[int, int]], best: bool) -> Iterator[tuple[int, bytes]]:
    """First key and blob of stretches of pairs; with `best`, whole A ids, and each pair's flag of the A id's maximum."""
    keys, counts, flags = [], [], []
    for _, of_a in groupby(pairs, key=lambda p: p[0] >> int(_BITS)):
        mine = list(of_a)
        keys += [k for k, _ in mine]
        counts += [n for _, n in mine]
        if best:
            top = max(n for _, n in mine)
            flags += [int(n == top) for _, n in mine]
        if len(keys) >= SEGMENT:
            yield keys[0], _packed(keys, counts, flags)
            keys, counts, flags = [], [], []
    if keys:
        yield keys[0], _packed(keys, counts, flags)


def _packed(keys: list[int], counts: list[int], flags: list[int]) -> bytes:
    columns = [np.diff(np.array(keys, np.uint64), prepend=np.uint64(0)), np.array(counts, np.uint64)]
    return pack(*columns, *([np.array(flags, np.uint64)] if flags else []))


def _row_stream(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def merge_runs(runs: DataFrame, groups: int, best: bool) -> DataFrame:
    """COUNTS of `groups` runs per radix partition, each merged from about FAN of the given ones."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (radix, group), rows in groupby(_row_stream(batches), key=itemgetter("radix", "grp")):
            blobs = [[r["pairs"] for r in run] for _, run in groupby(rows, key=itemgetter("run"))]
            for first, blob in _blobs(merged(blobs), best):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([radix], pa.int32()), pa.array([group]), pa.array([first]), pa.array([blob])], names=["radix", "run", "first", "pairs"]
                )

    dealt = runs.select("radix", _group(groups), "run", "first", "pairs").repartition("radix", "grp")
    return dealt.sortWithinPartitions("radix", "grp", "run", "first").mapInArrow(work, COUNTS)


def _group(groups: int):
    return F.pmod(F.xxhash64("run"), F.lit(groups)).cast("bigint").alias("grp")


def pair_counts(spilled: DataFrame) -> tuple[DataFrame, int]:
    """Counts of all pairs with flags of the A ids' maxima, one merged run per radix partition; and the number of runs."""
    runs = spilled.filter("radix IS NOT NULL").select("radix", "run", "first", "pairs")
    many = runs.agg(F.count_distinct("run")).first()[0]
    left = many
    while left > FAN:
        left = -(-left // FAN)
        runs = stage(merge_runs(runs, left, False), "merged-runs")
    return stage(merge_runs(runs, 1, True), "pair-counts"), many


SUMS = "run bigint, sums binary"


def stream_back(spilled: DataFrame, counts: DataFrame, many: int) -> DataFrame:
    """Per blob of a run: documents (numbers within the run), links with the A id's highest count, and counts added up."""
    groups = max(1, -(-many // FAN))
    runs = spilled.filter("radix IS NOT NULL").select("radix", _group(groups), F.lit(1).alias("side"), "run", "first", "pairs", "docs")
    known = counts.select(
        "radix", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(groups - 1).cast("bigint"))).alias("grp"),
        F.lit(0).alias("side"), "run", "first", "pairs", F.lit(None).cast("binary").alias("docs"),
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groupby(_row_stream(batches), key=itemgetter("radix", "grp")):
            # The counts of the radix partition come first, in order.
            table: list[list[np.ndarray]] = []
            keys = count = best = np.zeros(0, np.uint64)
            for r in rows:
                steps, *more = unpack(r["pairs"])
                own = np.cumsum(steps, dtype=np.uint64)
                if r["side"] == 0:
                    table.append([own, *more])
                    continue
                if table:
                    keys, count, best = (np.concatenate(c) for c in zip(*table))
                    table = []
                doc, times = unpack(r["docs"])
                at = np.repeat(np.searchsorted(keys, own), more[0].astype(np.int64))
                order = np.argsort(doc, kind="stable")
                doc, times, at = doc[order], times[order], at[order]
                first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
                sums = pack(doc[first], np.add.reduceat(times * best[at], first), np.add.reduceat(times * count[at], first))
                yield pa.RecordBatch.from_arrays([pa.array([r["run"]]), pa.array([sums])], names=["run", "sums"])

    dealt = known.unionByName(runs).repartition("radix", "grp")
    return dealt.sortWithinPartitions("radix", "grp", "side", "first").mapInArrow(work, SUMS)


OUT = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def gather(spilled: DataFrame, sums: DataFrame) -> DataFrame:
    """Documents of every run with what its blobs added up to."""
    own = ["at", "doc_id", *_NUMBERS, "groups_sha256"]
    docs = spilled.filter("radix IS NULL").select("run", F.lit(1).alias("side"), *own, F.lit(None).cast("binary").alias("sums"))
    parts = sums.select("run", F.lit(0).alias("side"), *[F.lit(None).cast(docs.schema[c].dataType).alias(c) for c in own], "sums")
    names = [c.split()[0] for c in OUT.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, held = None, np.zeros((0, 2), np.uint64)
        for batch in batches:
            runs, blobs = batch.column("run").to_numpy(), batch.column("sums")
            edges = np.flatnonzero(np.concatenate(([True], runs[1:] != runs[:-1], [True]))).tolist()
            for a, b in zip(edges[:-1], edges[1:]):
                if runs[a] != run:
                    run, held = runs[a], np.zeros((0, 2), np.uint64)
                given = b - a - blobs.slice(a, b - a).null_count
                for blob in blobs.slice(a, given).to_pylist():
                    doc, best, count = unpack(blob)
                    if doc[-1] >= len(held):
                        held = np.concatenate((held, np.zeros((int(doc[-1]) + 1 - len(held), 2), np.uint64)))
                    held[doc.astype(np.int64)] += np.stack((best, count), axis=1)
                rows = batch.slice(a + given, b - a - given)
                if rows.num_rows:
                    at = rows.column("at").to_numpy()
                    seen = at < len(held)
                    mine = np.zeros((len(at), 2), np.int64)
                    mine[seen] = held[at[seen]].astype(np.int64)
                    values = {"n_best": pa.array(mine[:, 0]), "count_sum": pa.array(mine[:, 1])}
                    yield pa.RecordBatch.from_arrays([values[c] if c in values else rows.column(c) for c in names], names=names)

    return docs.unionByName(parts).repartition("run").sortWithinPartitions("run", "side", "at").mapInArrow(work, OUT)


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A is a byte-level tokenizer file of the tokenizers library and reads a space and the text; B is a sentencepiece
    model, which adds that space. Strings of special tokens are plain text.

    * Null and empty texts, and texts that the tokens of either side do not spell byte for byte, have no tokens: zeros
      and an empty string; they are in no count.
    * Every row is a document of its own, also rows that repeat a doc_id or are repeated whole. A null doc_id stays null.
    * Ties for an A id's highest count are all highest. Other columns are not read. Empty in, empty out.
    """
    spilled = stage(spill_runs(docs, a_path, b_path, id_col, text_col), "alignment-runs")
    counts, many = pair_counts(spilled)
    return gather(spilled, stream_back(spilled, counts, many))


@query("op11_token_alignment")
def _op11(spark, sf_dir):
    import public_tokenizers

    path = public_tokenizers.path
    return align(load(spark, sf_dir, "documents"), path("byte_bpe_50k.json"), path("piece_bpe_32k.model"))
