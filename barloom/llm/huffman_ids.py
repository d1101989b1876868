"""Token ids as binary files: canonical, length-limited Huffman codes from global counts.

A first pass encodes every document once and stages its ids; counts per id are summed over all documents. A vocabulary
bounds the number of counts, so the code is made on the driver. A second pass deals documents out in order of id and
writes one file per partition through a Python data source: blocks of BLOCK ids, each with the bit offset of every
STEP-th id. Blocks decode independently, and inside a block the stretches between checkpoints decode side by side by
table lookups of LIMIT bits.

File format (numbers little-endian): magic `BLID1\\n`, then blocks. A block is `u32 documents, u32 ids, u32 payload
bytes, u32 checkpoints`, then per document `i64 id, u32 ids in this block, u8 1 if the document goes on`, the
checkpoints (u32 bit offsets), and the payload, most significant bit first. A document longer than a block goes on in
the next. `manifest.json` lists the files in order with their numbers of documents and ids; `code.bin` holds the code
length of every id.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)

from barloom.llm.common import load, query, shared_folder, single_blanks, stage, text_column

#: Ids in a block, ids between checkpoints, longest code in bits (for up to 262 144 distinct ids; more are an error).
BLOCK, STEP, LIMIT = 1 << 16, 64, 18
MAGIC = b"BLID1\n"


# --- the code -------------------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most `limit` bits (package-merge); 0 for ids that do not occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) == 0:
        return lengths
    if len(used) == 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} symbols have no codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.int64)
    n = len(order)
    # At every level the list is the symbols merged with pairs of the list before; `taken` of the first 2n - 2 items
    # of the last list are counted back down the levels.
    levels, packages = [], np.zeros(0, np.int64)
    for _ in range(limit):
        both = np.concatenate((weights, packages))
        rank = np.argsort(both, kind="stable")
        levels.append(rank < n)
        merged = both[rank]
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
    size, depth = 2 * n - 2, np.zeros(n + 1, np.int64)
    for is_symbol in reversed(levels):
        symbols = int(is_symbol[:size].sum())
        depth[0] += 1
        depth[symbols] -= 1
        size = 2 * (size - symbols)
    lengths[order] = np.cumsum(depth)[:n]
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then id."""
    codes = np.zeros(len(lengths), np.uint32)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    code, before = 0, 0
    for size in range(1, int(lengths.max(initial=0)) + 1):
        code <<= size - before
        before = size
        same = order[lengths[order] == size]
        codes[same] = code + np.arange(len(same), dtype=np.uint32)
        code += len(same)
    return codes


@dataclass
class Code:
    lengths: np.ndarray

    def __post_init__(self) -> None:
        self.codes = canonical_codes(self.lengths)
        self._table: tuple[np.ndarray, np.ndarray] | None = None

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """For every value of the next LIMIT bits: the id and the length of its code."""
        if self._table is None:
            order = np.lexsort((np.arange(len(self.lengths)), self.lengths))
            order = order[self.lengths[order] > 0]
            spread = 1 << (LIMIT - self.lengths[order].astype(np.int64))
            ids = np.zeros(1 << LIMIT, np.int32)
            size = np.zeros(1 << LIMIT, np.int64)
            filled = int(spread.sum())
            ids[:filled] = np.repeat(order, spread)
            size[:filled] = np.repeat(self.lengths[order], spread)
            self._table = ids, size
        return self._table

    def pack(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The codes of some ids as bytes, and the bit offset of every STEP-th id."""
        size = self.lengths[ids].astype(np.int64)
        if len(ids) and size.min() == 0:
            raise ValueError("an id has no code")
        ends = np.cumsum(size)
        starts = ends - size
        total = int(ends[-1]) if len(ends) else 0
        words = total // 32 + 2
        # A code of at most 32 bits lies in two 32-bit words; codes don't overlap, so sums put them together. Sums of
        # doubles below 2**53 are exact.
        room = 64 - (starts & 31) - size
        placed = self.codes[ids].astype(np.uint64) << room.astype(np.uint64)
        at = starts >> 5
        high = np.bincount(at, (placed >> np.uint64(32)).astype(np.float64), words)
        low = np.bincount(at + 1, (placed & np.uint64(0xFFFFFFFF)).astype(np.float64), words)
        packed = (high + low).astype(np.uint64).astype(">u4").tobytes()[: (total + 7) // 8]
        return packed, starts[::STEP].astype(np.uint32)

    def unpack(self, payload: bytes, checkpoints: np.ndarray, n: int) -> np.ndarray:
        """The ids of a block; stretches between checkpoints are decoded side by side."""
        if n == 0:
            return np.zeros(0, np.int32)
        ids, size = self.table()
        raw = np.frombuffer(payload + b"\0" * 8, np.uint8).astype(np.uint32)
        # The 32 bits from every byte on.
        ahead = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
        at = checkpoints.astype(np.int64)
        out = np.zeros((STEP, len(at)), np.int32)
        last = n - (len(at) - 1) * STEP
        mask = np.uint32((1 << LIMIT) - 1)
        for k in range(STEP):
            if k == last:
                at = at[:-1]
                if len(at) == 0:
                    break
            value = (ahead[at >> 3] >> (32 - LIMIT - (at & 7)).astype(np.uint32)) & mask
            out[k, : len(at)] = ids[value]
            at = at + size[value]
        return out.T.reshape(-1)[:n]


def pack_blocks(code: Code, docs: Iterator[tuple[int | None, np.ndarray]]) -> Iterator[bytes]:
    """Blocks of the file format from documents in order."""
    entries: list[bytes] = []
    held: list[np.ndarray] = []
    size = 0

    def flush() -> bytes:
        ids = np.concatenate(held) if held else np.zeros(0, np.int32)
        payload, checkpoints = code.pack(ids)
        return b"".join(
            (struct.pack("<4I", len(entries), len(ids), len(payload), len(checkpoints)), *entries, checkpoints.astype("<u4").tobytes(), payload)
        )

    for doc, ids in docs:
        at = 0
        while True:
            part = ids[at : at + BLOCK - size]
            at += len(part)
            entries.append(struct.pack("<qIB", NO_ID if doc is None else doc, len(part), at < len(ids)))
            held.append(part)
            size += len(part)
            if size == BLOCK or len(entries) == BLOCK:
                yield flush()
                entries, held, size = [], [], 0
            if at == len(ids):
                break
    if entries:
        yield flush()


#: How a null id is written.
NO_ID = -(2**63)


def unpack_blocks(code: Code, stream) -> Iterator[tuple[int | None, np.ndarray]]:
    """Documents of a file, in order."""
    if stream.read(len(MAGIC)) != MAGIC:
        raise ValueError("not a file of token ids")
    begun: list[np.ndarray] = []
    while head := stream.read(16):
        documents, n, size, marks = struct.unpack("<4I", head)
        entries = np.frombuffer(stream.read(13 * documents), np.dtype([("id", "<i8"), ("n", "<u4"), ("more", "u1")]))
        checkpoints = np.frombuffer(stream.read(4 * marks), "<u4")
        ids = code.unpack(stream.read(size), checkpoints, n)
        at = 0
        for doc, length, more in entries.tolist():
            begun.append(ids[at : at + length])
            at += length
            if not more:
                yield (None if doc == NO_ID else doc), (begun[0] if len(begun) == 1 else np.concatenate(begun))
                begun = []


# --- files through a Python data source -----------------------------------------------------------------


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


@dataclass
class Written(WriterCommitMessage):
    partition: int
    name: str
    documents: int
    ids: int


class IdWriter(DataSourceArrowWriter):
    """A file per task attempt; the manifest, written at commit, names the attempts that count."""

    def __init__(self, path: str, width: int) -> None:
        self.path, self.width = path, width

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        import uuid

        from pyspark import TaskContext

        store, at = _store(self.path)
        with store.open_input_stream(f"{at}/code.bin") as file:
            code = Code(np.frombuffer(file.read(), np.uint8))
        partition, documents, total = TaskContext.get().partitionId(), 0, 0

        def rows() -> Iterator[tuple[int | None, np.ndarray]]:
            nonlocal documents, total
            for batch in batches:
                for doc, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                    ids = np.frombuffer(packed.as_buffer(), f"<u{self.width}").astype(np.int32)
                    documents, total = documents + 1, total + len(ids)
                    yield doc, ids

        name = f"ids-{partition:06d}-{uuid.uuid4().hex}.bin"
        with store.open_output_stream(f"{at}/{name}") as file:
            file.write(MAGIC)
            for block in pack_blocks(code, rows()):
                file.write(block)
        return Written(partition, name, documents, total)

    def commit(self, messages: list[Written | None]) -> None:
        store, at = _store(self.path)
        done = sorted((m for m in messages if m is not None and m.documents), key=lambda m: m.partition)
        listed = [{"file": m.name, "documents": m.documents, "ids": m.ids} for m in done]
        with store.open_output_stream(f"{at}/manifest.json") as file:
            file.write(json.dumps(listed).encode())

    def abort(self, messages: list[Written | None]) -> None:
        """Files of a failed job are in no manifest."""


class IdFile(InputPartition):
    def __init__(self, name: str, before: int) -> None:
        super().__init__(name)
        self.name, self.before = name, before


class IdReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[IdFile]:
        store, at = _store(self.path)
        with store.open_input_stream(f"{at}/manifest.json") as file:
            listed = json.loads(file.read())
        out, before = [], 0
        for entry in listed:
            out.append(IdFile(entry["file"], before))
            before += entry["ids"]
        return out or [IdFile("", 0)]

    def read(self, partition: IdFile) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        store, at = _store(self.path)
        with store.open_input_stream(f"{at}/code.bin") as file:
            code = Code(np.frombuffer(file.read(), np.uint8))
        names, kinds = ["doc_id", "start", "ids"], [pa.int64(), pa.int64(), pa.binary()]
        schema, rows, held, start = pa.schema(list(zip(names, kinds))), [], 0, partition.before
        with store.open_input_stream(f"{at}/{partition.name}", buffer_size=1 << 20) as stream:
            for doc, ids in unpack_blocks(code, stream):
                rows.append((doc, start, ids.astype("<u4").tobytes()))
                start, held = start + len(ids), held + len(ids) + 16
                if held > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], schema=schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], schema=schema)


class IdSource(DataSource):
    """Format `huffman_ids`; the path is the option `path`."""

    @classmethod
    def name(cls) -> str:
        return "huffman_ids"

    def schema(self) -> str:
        return "doc_id bigint, start bigint, ids binary"

    def reader(self, schema) -> IdReader:
        return IdReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> IdWriter:
        return IdWriter(self.options["path"], int(self.options.get("width", 4)))


def count_ids(staged: DataFrame, width: int) -> np.ndarray:
    """How often each id occurs in all documents; every task sends one row per id it met."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for packed in batch.column(0):
                ids = np.frombuffer(packed.as_buffer(), f"<u{width}")
                if len(ids):
                    counts = np.bincount(ids)
                    if len(counts) > len(total):
                        total = np.concatenate((total, np.zeros(len(counts) - len(total), np.int64)))
                    total[: len(counts)] += counts
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["token", "n"])

    rows = staged.select("ids").mapInArrow(work, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((r["token"] for r in rows), default=-1) + 1, np.int64)
    for r in rows:
        counts[r["token"]] = r["n"]
    return counts


def write_ids(docs: DataFrame, path: str, width: int = 4) -> None:
    """Write (doc_id, ids as little-endian numbers of `width` bytes) in ascending order of doc_id under `path`."""
    spark = docs.sparkSession
    staged = stage(docs.select(F.col("doc_id").cast("bigint"), "ids"), "ids")
    store, at = _store(path)
    store.create_dir(at, recursive=True)
    with store.open_output_stream(f"{at}/code.bin") as file:
        file.write(code_lengths(count_ids(staged, width)).tobytes())
    spark.dataSource.register(IdSource)
    # Equal ids stay in one order whatever the partitions: repeated rows are told apart by their ids' bytes.
    keys = ["doc_id", F.xxhash64("ids")]
    ordered = staged.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ordered.write.format("huffman_ids").option("path", path).option("width", width).mode("append").save()


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids (little-endian u32), from the files."""
    spark.dataSource.register(IdSource)
    return spark.read.format("huffman_ids").option("path", path).load()


# --- tokens ---------------------------------------------------------------------------------------------

_TOKENIZERS: dict[str, tuple] = {}
#: Entries of the memo of parts seen; when it is full, new parts are encoded each time they come.
MEMO = 1_000_000
#: New parts encoded in one string.
TOGETHER = 256


#: The split of which the shortcut of `_encode` is known to hold: fixed values of the file format.
_PLAIN_SPLIT = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}


def _cuts_at_spaces(tokenizer) -> bool:
    """Whether texts may be cut in front of single spaces: byte-level splitting, no normalizer, no added token with a blank."""
    parts = json.loads(tokenizer.to_str())
    split = parts["pre_tokenizer"] or {}
    plain = parts["normalizer"] is None and all(split.get(k) == v for k, v in _PLAIN_SPLIT.items())
    added = parts["added_tokens"]
    return plain and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or len(t["content"].split()) != 1 for t in added)


def _tokenizer(path: str) -> tuple:
    """The tokenizer, which of its tokens begin with a space, and the memo of parts (None where texts can't be cut).

    Kept by the worker process. The tokenizer is called as its file has it: strings of special tokens are those tokens.
    """
    if path not in _TOKENIZERS:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        size = max(tokenizer.get_vocab().values()) + 1
        spaced = np.array([(tokenizer.id_to_token(i) or "").startswith("Ġ") for i in range(size)])
        _TOKENIZERS[path] = (tokenizer, spaced, {} if _cuts_at_spaces(tokenizer) else None)
    return _TOKENIZERS[path]


def _encode(tokenizer, spaced: np.ndarray, memo: dict[str, bytes] | None, texts: list[str], kind: str) -> list[bytes]:
    """Ids of texts, as bytes of numpy type `kind`.

    Texts with only single spaces and line feeds are cut in front of each space, where the split pattern of such a
    tokenizer always cuts, and each part is encoded once. New parts are encoded many at a time, one space before each: a part
    begins wherever a token begins with a space.
    """

    def many(joined: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, kind) for e in tokenizer.encode_batch_fast(joined, add_special_tokens=False)]

    plans: list[tuple[list[str], list[bytes | None]] | None] = []
    new: dict[str, None] = {}
    whole: list[str] = []
    for text in texts:
        if memo is not None and text and single_blanks(text):
            first, *parts = text.split(" ")
            found = list(map(memo.get, parts))
            new.update((p, None) for p, ids in zip(parts, found) if ids is None)
            plans.append((parts, found))
            whole.append(first)
        else:
            plans.append(None)
            whole.append(text)
    fronts = [ids.tobytes() for ids in many(whole)]
    names = list(new)
    groups = [names[i : i + TOGETHER] for i in range(0, len(names), TOGETHER)]
    fresh: dict[str, bytes] = {}
    for group, ids in zip(groups, many([" " + " ".join(g) for g in groups])):
        starts = np.flatnonzero(spaced[ids])
        if len(starts) != len(group):
            fresh.update(zip(group, (x.tobytes() for x in many([" " + p for p in group]))))
            continue
        packed, size = ids.tobytes(), ids.itemsize
        bounds = [*(starts * size).tolist(), len(packed)]
        fresh.update((p, packed[a:b]) for p, a, b in zip(group, bounds, bounds[1:]))
    if memo is not None and len(memo) + len(fresh) <= MEMO:
        memo.update(fresh)
    return [
        front if plan is None else front + b"".join([ids or fresh[p] for p, ids in zip(*plan)]) for front, plan in zip(fronts, plans)
    ]


def id_width(tokenizer_path: str, end_id: int) -> int:
    """Bytes that hold any id."""
    tokenizer, spaced, _ = _tokenizer(tokenizer_path)
    return 2 if max(len(spaced) - 1, end_id) < 1 << 16 else 4


def tokenise(docs: DataFrame, tokenizer_path: str, end_id: int, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (little-endian, `width` bytes each) of every whole text, `end_id` last; null text is empty."""
    kind = f"<u{width}"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer, spaced, memo = _tokenizer(tokenizer_path)
        end = np.array([end_id], kind).tobytes()
        for batch in batches:
            packed = [ids + end for ids in _encode(tokenizer, spaced, memo, batch.column(1).to_pylist(), kind)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["doc_id", "ids"])

    return text_column(docs, id_col, text_col).mapInArrow(work, "doc_id bigint, ids binary")


def describe(read: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids' bytes."""
    return read.select("doc_id", "start", F.floor(F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Encode, write files, read them back: doc_id, start, n_tokens, ids_crc32.

    * Null and empty texts have the end id alone. A null doc_id comes first and is read back as null.
    * Rows repeating a doc_id stay as many documents, in order of a hash of their ids.
    * Other columns are not read. Without documents there is a manifest without files, and no row.
    """
    path = shared_folder(docs.sparkSession, "token-ids")
    width = id_width(tokenizer_path, end_id)
    write_ids(tokenise(docs, tokenizer_path, end_id, width), path, width)
    return describe(read_ids(docs.sparkSession, path))


@query("op5_huffman_ids")
def _op5(spark, sf_dir):
    import public_tokenizers

    return round_trip(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
