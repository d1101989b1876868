"""Removal of byte strings that an earlier document has too, by a sparse suffix array.

Suffixes start where a window of WINDOW bytes owns a place (see anchors): every window belongs to one such suffix, and
only suffixes whose surroundings may occur twice are sorted. A row holds the bytes that its windows cover.

Rows are range-partitioned by the leading bytes of their suffix and the key of the bytes around it, with splitters that
Spark samples. A partition is read in that order; a group of equal leads and keys that is cut by a batch's end is carried
over and compared with what follows, and no such group lies in two partitions. Inside, the windows are sorted by a
multikey quicksort over 8-byte words that only goes on with what is still equal; neighbours that agree in all WINDOW
bytes are the same string, and all but those of the smallest document are removed.

Equal rows are folded in every task before they are sent. The first and last suffix of a passage reach into each
document's own text and are not equal, so a passage of very many documents still has very many rows of one key: keys
of more than HOT rows are counted first and go another way. Their windows are folded by a partial aggregate to the
smallest document of each, and joined back with it; no partition gathers them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm import anchors
from barloom.llm.common import Rolling, chunked, load, mix, query, stage

#: Bytes in a window; bytes in the grams whose hashes choose the suffixes.
WINDOW, GRAM = 50, 12
#: Rows folded at a time before they are sent, and sorted at a time.
FOLD, SORT = 100_000, 60_000
#: Rows of one lead and key that are still sorted in one place.
HOT = 20_000
_BYTES, _SECOND = Rolling(81), Rolling(82)

ROWS = "lead bigint, key bigint, body binary, doc bigint, part bigint, start int, n int, settled boolean"


def _pieces(raw: np.ndarray, prefix: np.ndarray, offsets: np.ndarray, window: int) -> anchors.Pieces:
    return anchors.cut(raw, prefix, offsets, GRAM, window, _BYTES)


def _prefix(raw: np.ndarray) -> np.ndarray:
    return _BYTES.prefix(_BYTES.bytes[raw])


def _words_ahead(raw: np.ndarray) -> np.ndarray:
    """The 8 bytes from every place on, as a number that sorts like the bytes; zeros behind the end."""
    padded = np.concatenate((raw, np.zeros(8, np.uint8))).astype(np.uint64)
    out = np.zeros(len(raw) + 1, np.uint64)
    for i in range(8):
        out |= padded[i : i + len(raw) + 1] << np.uint64(56 - 8 * i)
    return out


class _Folder:
    """Rows of a task: of equal ones the smallest document goes on, the others are settled."""

    def __init__(self) -> None:
        self.columns: list[list[np.ndarray]] = [[] for _ in range(7)]
        self.bodies: list[bytes] = []

    def add(self, body: list[bytes], *columns: np.ndarray) -> None:
        self.bodies += body
        for held, new in zip(self.columns, columns):
            held.append(new)

    def flush(self) -> pa.RecordBatch:
        lead, key, whole, doc, part, start, n = (np.concatenate(c) for c in self.columns)
        order = np.lexsort((doc, whole, key))
        same = np.zeros(len(order), bool)
        same[1:] = (key[order][1:] == key[order][:-1]) & (whole[order][1:] == whole[order][:-1])
        first = np.flatnonzero(~same)
        group = np.cumsum(~same) - 1
        settled = np.zeros(len(order), bool)
        settled[order] = same & (doc[order] > doc[order][first][group])
        bodies = [None if s else b for s, b in zip(settled.tolist(), self.bodies)]
        self.__init__()
        return pa.RecordBatch.from_arrays(
            [
                pa.array(lead.view(np.int64)),
                pa.array(key.view(np.int64)),
                pa.array(bodies, pa.binary()),
                pa.array(doc),
                pa.array(part),
                pa.array(start.astype(np.int32)),
                pa.array(n.astype(np.int32)),
                pa.array(settled),
            ],
            names=[c.split()[0] for c in ROWS.split(", ")],
        )


def suffixes(docs: DataFrame, documents: int, window: int = WINDOW) -> DataFrame:
    """Rows of suffixes that may occur in two documents; `settled` ones are equal to one of a smaller document."""
    wanted = docs.sparkSession.sparkContext.broadcast(
        anchors.key_filter(docs, documents, lambda raw, offsets: _pieces(raw, _prefix(raw), offsets, window), "byte-keys")
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = _Folder()
        for batch, raw, offsets in chunked(batches):
            prefix = _prefix(raw)
            found = _pieces(raw, prefix, offsets, window)
            keep = wanted.value.may_repeat(found.key)
            if not keep.any():
                continue
            start, n, doc, owner = found.start[keep], found.n[keep], found.doc[keep], found.owner[keep]
            end = start + n - 1 + window
            data = raw.tobytes()
            whole = mix(_BYTES.of(prefix, start, end) + ((owner - start) * 1024 + n).astype(np.uint64))
            ids, texts = np.asarray(batch.column("id")), np.asarray(batch.column("part"))
            body = [data[a:b] for a, b in zip(start.tolist(), end.tolist())]
            folder.add(body, _words_ahead(raw)[owner], found.key[keep], whole, ids[doc], texts[doc], start - offsets[doc], n)
            if len(folder.bodies) >= FOLD:
                yield folder.flush()
        if folder.bodies:
            yield folder.flush()

    return docs.mapInArrow(work, ROWS)


def multikey_sort(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows by several columns, and whether each row in that order equals the one before it.

    After the first column only rows that still have an equal neighbour are sorted on, column by column.
    """
    order = np.argsort(words[0], kind="stable")
    same = np.zeros(len(order), bool)
    same[1:] = words[0][order][1:] == words[0][order][:-1]
    for column in words[1:]:
        tied = same.copy()
        tied[:-1] |= same[1:]
        at = np.flatnonzero(tied)
        if len(at) == 0:
            break
        group = np.cumsum(~same[at])
        rows = order[at]
        inner = np.lexsort((column[rows], group))
        order[at] = rows[inner]
        value = column[order[at]]
        still = np.zeros(len(at), bool)
        still[1:] = (group[1:] == group[:-1]) & (value[1:] == value[:-1])
        same[at] = still
    return order, same


def repeated_windows(key: np.ndarray, bodies: list[bytes], doc: np.ndarray, n: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Of rows: which row and which of its windows also start in a smaller document."""
    raw = np.frombuffer(b"".join(bodies), np.uint8)
    first = np.cumsum([0, *map(len, bodies)])[:-1]
    row = np.repeat(np.arange(len(n)), n)
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = first[row] + within
    ahead = _words_ahead(raw)
    columns = [key[row]]
    for i in range(0, window, 8):
        word = ahead[np.minimum(at + i, len(raw))]
        if window - i < 8:
            word = word >> np.uint64(64 - 8 * (window - i))
        columns.append(word)
    order, same = multikey_sort(columns)
    begins = np.flatnonzero(~same)
    ids = doc[row][order]
    least = np.minimum.reduceat(ids, begins)[np.cumsum(~same) - 1] if len(ids) else ids
    hit = order[least < ids]
    return row[hit], within[hit]


SPANS = "doc bigint, part bigint, start int, n int"


def _sorter(window: int):
    def runs(table: pa.Table) -> pa.RecordBatch:
        key = np.asarray(table["key"]).view(np.uint64)
        doc, start, n = (np.asarray(table[c]).astype(np.int64) for c in ("doc", "start", "n"))
        # Keys of one document only have nothing to be compared with.
        order = np.lexsort((doc, key))
        edge = np.ones(len(key), bool)
        edge[1:] = key[order][1:] != key[order][:-1]
        begins = np.flatnonzero(edge)
        low, high = np.minimum.reduceat(doc[order], begins), np.maximum.reduceat(doc[order], begins)
        shared = np.zeros(len(key), bool)
        shared[order] = (low < high)[np.cumsum(edge) - 1]
        rows = np.flatnonzero(shared)
        if len(rows) == 0:
            empty = pa.array([], pa.int32())
            none = pa.array([], pa.int64())
            return pa.RecordBatch.from_arrays([none, none, empty, empty], names=["doc", "part", "start", "n"])
        bodies = table["body"].take(pa.array(rows)).to_pylist()
        hit, within = repeated_windows(key[rows], bodies, doc[rows], n[rows], window)
        hit = rows[hit]
        # Neighbouring windows of one row become one run.
        order = np.lexsort((within, hit))
        hit, within = hit[order], within[order]
        new = np.ones(len(hit), bool)
        new[1:] = (hit[1:] != hit[:-1]) | (within[1:] != within[:-1] + 1)
        first = np.flatnonzero(new)
        length = np.diff(np.concatenate((first, [len(hit)])))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(doc[hit[first]]),
                pa.array(np.asarray(table["part"])[hit[first]]),
                pa.array((start[hit[first]] + within[first]).astype(np.int32)),
                pa.array(length.astype(np.int32)),
            ],
            names=["doc", "part", "start", "n"],
        )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            held.append(batch)
            size += batch.num_rows
            if size < SORT:
                continue
            table = pa.Table.from_batches(held)
            lead, key = np.asarray(table["lead"]), np.asarray(table["key"])
            # The last group may go on in the next batch.
            others = np.flatnonzero((lead != lead[-1]) | (key != key[-1]))
            edge = int(others[-1]) + 1 if len(others) else 0
            if edge == 0:
                continue
            yield runs(table.slice(0, edge))
            rest = table.slice(edge)
            held, size = rest.to_batches(), rest.num_rows
        if held:
            yield runs(pa.Table.from_batches(held))

    return work


WINDOWS = "key bigint, window1 bigint, window2 bigint, doc bigint, part bigint, start int"


def _each_window(window: int):
    """Two hashes, which with the key stand for the bytes, and the place of every window of the rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            bodies, n = batch.column("body").to_pylist(), np.asarray(batch.column("n")).astype(np.int64)
            raw = np.frombuffer(b"".join(bodies), np.uint8)
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at = np.repeat(np.cumsum([0, *map(len, bodies)])[:-1], n) + within
            hashes = [mix(r.of(r.prefix(r.bytes[raw]), at, at + window)).view(np.int64) for r in (_BYTES, _SECOND)]
            repeated = [pa.array(np.repeat(np.asarray(batch.column(c)), n)) for c in ("key", "doc", "part")]
            start = np.repeat(np.asarray(batch.column("start")), n) + within
            yield pa.RecordBatch.from_arrays(
                [repeated[0], *map(pa.array, hashes), *repeated[1:], pa.array(start.astype(np.int32))], names=[c.split()[0] for c in WINDOWS.split(", ")]
            )

    return work


def hot_spans(rows: DataFrame, window: int) -> DataFrame:
    """The same runs, one window each, from rows of hot keys: no window is gathered in one task."""
    windows, name = stage(rows.select("key", "body", "doc", "part", "start", "n").mapInArrow(_each_window(window), WINDOWS), "windows"), ["key", "window1", "window2"]
    first = windows.groupBy(*name).agg(F.min("doc").alias("first"), F.max("doc").alias("last")).filter("first < last").drop("last")
    return windows.join(stage(first, "first-windows"), name).filter("first < doc").select("doc", "part", "start", F.lit(1).alias("n"))


def repeated_spans(docs: DataFrame, documents: int, window: int = WINDOW) -> DataFrame:
    """Runs (doc, part, start, n) of windows that also start in a smaller document; docs: (id, text, part) without copies."""
    rows = stage(suffixes(docs, documents, window), "suffixes")
    settled = rows.filter("settled").select("doc", "part", "start", "n")
    open_rows = rows.filter("not settled").select("lead", "key", "body", "doc", "part", "start", "n")
    group = ["lead", "key"]
    hot = stage(open_rows.groupBy(*group).agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > HOT).select(*group), "hot-keys")
    if hot.isEmpty():
        cold, gone = open_rows, settled
    else:
        cold = open_rows.join(hot, group, "left_anti").select(open_rows.columns)
        gone = settled.unionByName(hot_spans(open_rows.join(hot, group, "left_semi"), window))
    sorted_rows = cold.repartitionByRange(*group).sortWithinPartitions(*group)
    return gone.unionByName(sorted_rows.mapInArrow(_sorter(window), SPANS))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (binary) of every document.

    A byte goes if it lies in a window whose bytes also start in a document with a smaller id, judged on the input.

    * Null and empty texts have no bytes; texts shorter than `window` bytes lose none. Cuts may fall inside a character.
    * Rows sharing an id are one document here: they take nothing from each other, and each row loses what its own
      text shares with a smaller id. A null id is smaller than any other and is returned as null.
    * Other columns are not read. An empty table gives an empty result.
    """
    own = anchors.own_columns(docs, id_col, text_col)
    later, documents = anchors.copies(own)
    first = own.join(later, ["id", "part"], "left_anti")
    cuts = repeated_spans(first, documents, window)
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"
    return anchors.with_cuts(own, later, cuts).mapInArrow(_cutter(window), schema)


def _cutter(window: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            cuts = anchors.cut_arrays(batch.column("cuts"))
            rows = []
            for doc, text, whole, (start, n) in zip(
                batch.column("id").to_pylist(), batch.column("text"), batch.column("whole").to_pylist(), cuts
            ):
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                kept, spans = data, 0
                if whole:
                    if len(data) >= window:
                        kept, spans = b"", 1
                elif len(start):
                    gone = anchors.covered(len(data), np.minimum(start, len(data)), np.minimum(n, len(data) - window + 1 - start), window)
                    kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                rows.append((None if doc == anchors.NO_ID else doc, len(data), len(data) - len(kept), spans, kept))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
                )

    return work


@query("op8_suffix_dedup")
def _op8(spark, sf_dir):
    cut = remove_repeats(load(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
