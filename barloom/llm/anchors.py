"""Content-cut pieces of texts, and which of them may occur in more than one text.

The strings looked for are windows of a fixed number of tokens (words or bytes). Every window owns the place of the
smallest hash among its k-grams, leftmost first. Equal windows own the same place, so windows are grouped by it: a
maximal run of windows with one owner is a piece, cut in two where the owner lies in the front or the back half of the
window. All windows of a piece share a stretch of tokens around the owner; its hash is the piece's key. Equal windows
have equal keys, and only pieces whose key occurs in two texts need to be compared.

Keys are counted in buckets of sorted 32-bit numbers, at most two of a kind from each task. The keys that occur twice
become a bitmap of BITS_MOST bits at most, whatever the size of the corpus; it is broadcast, and lets through all
repeated keys and few others. When it is full it lets more through: more work, the same results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import Rolling, chunked, mix, stage

#: Largest bitmap in bits (64 MiB), bits per repeated key up to there, keys held before they are sent on.
BITS_MOST, BITS_EACH, HELD = 1 << 29, 16, 2_000_000


@dataclass
class Pieces:
    """Runs of windows: document, first window, number of windows, owner and key."""

    doc: np.ndarray
    start: np.ndarray
    n: np.ndarray
    owner: np.ndarray
    key: np.ndarray


def cut(values: np.ndarray, prefix: np.ndarray, offsets: np.ndarray, k: int, window: int, rolling: Rolling) -> Pieces:
    """Pieces of all documents. values: a number per token; prefix: rolling.prefix(values); offsets: documents' tokens."""
    n = len(values)
    none = np.zeros(0, np.int64)
    if n < window:
        return Pieces(none, none, none, none, np.zeros(0, np.uint64))
    grams = mix(rolling.of(prefix, slice(0, n - k + 1), slice(k, n + 1)))
    mask = np.uint64((1 << max(20, n.bit_length())) - 1)
    least = (grams & ~mask) | np.arange(len(grams), dtype=np.uint64)
    wide, width = window - k + 1, 1
    while width * 2 <= wide:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < wide:
        least = np.minimum(least[: len(least) - (wide - width)], least[wide - width :])
    owner = (least & mask).astype(np.int64)
    last = np.repeat(offsets[1:] - window, np.diff(offsets))[: len(owner)]
    at = np.flatnonzero(np.arange(len(owner)) <= last)
    own = owner[at]
    back = own - at > (window - k) // 2
    new = np.ones(len(at), bool)
    new[1:] = (own[1:] != own[:-1]) | (back[1:] != back[:-1])
    first = np.flatnonzero(new)
    start, p, late = at[first], own[first], back[first]
    half = (window - k) // 2
    low = np.where(late, p - half - 1, p)
    high = np.where(late, p + k, p - half + window)
    key = mix(rolling.of(prefix, low, high) + late.astype(np.uint64))
    doc = np.searchsorted(offsets, start, "right") - 1
    return Pieces(doc, start, np.diff(np.concatenate((first, [len(at)]))), p, key)


@dataclass
class KeyFilter:
    """A bitmap per bucket of keys; bucket: the leading `shift` bits."""

    shift: int
    sizes: np.ndarray
    starts: np.ndarray
    bits: np.ndarray

    def may_repeat(self, keys: np.ndarray) -> np.ndarray:
        bucket, low = split_key(keys, self.shift)
        size = self.sizes[bucket]
        at = _place(low, size) + self.starts[bucket]
        return (size > 0) & ((self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)


def split_key(keys: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
    bucket = (keys >> np.uint64(64 - shift)).astype(np.int64)
    low = ((keys >> np.uint64(32 - shift)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return bucket, low


def _place(low: np.ndarray, size: np.ndarray) -> np.ndarray:
    spread = (low.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(24)
    return (spread.astype(np.int64)) & np.maximum(size - 1, 0)


def _send(keys: list[np.ndarray], shift: int) -> pa.RecordBatch:
    held = np.sort(np.concatenate(keys))
    # Two of a kind tell that a key repeats; more are not sent.
    few = np.ones(len(held), bool)
    few[2:] = held[2:] != held[:-2]
    bucket, low = split_key(held[few], shift)
    names, first = np.unique(bucket, return_index=True)
    parts = np.split(low.astype("<u4"), first[1:])
    return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["bucket", "keys"])


def key_filter(docs: DataFrame, documents: int, keys_of, name: str) -> KeyFilter:
    """The bitmap of keys that occur in two documents of (id, text).

    documents: their number, from which the number of buckets follows; keys_of(raw, offsets): the Pieces of a run.
    """
    shift = max(6, int(documents // 2000).bit_length())
    most = BITS_MOST >> shift

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for _, raw, offsets in chunked(batches):
            pieces = keys_of(raw, offsets)
            bounds = np.searchsorted(pieces.doc, np.arange(len(offsets)))
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                if b > a:
                    held.append(np.unique(pieces.key[a:b]))
                    size += b - a
            if size > HELD:
                yield _send(held, shift)
                held, size = [], 0
        if held:
            yield _send(held, shift)

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        low = np.sort(np.frombuffer(b"".join(group["keys"]), "<u4"))
        low = np.unique(low[1:][low[1:] == low[:-1]])
        if len(low) == 0:
            return pd.DataFrame({"bucket": [], "bits": []})
        size = min(most, 1 << max(10, int(len(low) * BITS_EACH - 1).bit_length()))
        bits = np.zeros(size, np.uint8)
        bits[_place(low, np.full(len(low), size))] = 1
        return pd.DataFrame({"bucket": [int(group["bucket"].iloc[0])], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    counted = docs.mapInArrow(work, "bucket bigint, keys binary").groupBy("bucket").applyInPandas(merge, "bucket bigint, bits binary")
    sizes, starts, parts, at = np.zeros(1 << shift, np.int64), np.zeros(1 << shift, np.int64), [], 0
    for row in stage(counted, name).toLocalIterator():
        sizes[row["bucket"]], starts[row["bucket"]] = len(row["bits"]) * 8, at
        parts.append(bytes(row["bits"]))
        at += len(row["bits"]) * 8
    return KeyFilter(shift, sizes, starts, np.frombuffer(b"".join(parts) or b"\0", np.uint8))


def copies(docs: DataFrame) -> tuple[DataFrame, int]:
    """(id, part) of the rows whose whole text a smaller id has too, and the number of all rows.

    Whole copies are told apart by digest before anything else, so that no group of copies is compared in parts.
    """
    rows = stage(docs.select("id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest")), "digests")
    firsts = rows.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    # Written first: rows of a hot digest are then split by the planner, which an aggregate under the join prevents.
    later = rows.join(stage(firsts, "first-copies"), "digest").filter("id > first").select("id", "part").distinct()
    return stage(later, "copies"), rows.count()


#: A null id, which is smaller than any other here.
NO_ID = -(2**63)


def own_columns(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, part): `part` is a hash of the text that tells rows sharing an id apart."""
    own = docs.select(
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    return own.withColumn("part", F.xxhash64("text"))


def covered(n: int, starts: np.ndarray, counts: np.ndarray, window: int) -> np.ndarray:
    """Which of n tokens lie in a window of the runs (first window, number of windows)."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + counts + window - 1, -1)
    return np.cumsum(step[:n]) > 0


def with_cuts(docs: DataFrame, later: DataFrame, cuts: DataFrame) -> DataFrame:
    """Documents (id, text, part) with `whole` (a copy of an earlier text) and `cuts`, an array of (start, n) runs of windows."""
    per_doc = cuts.groupBy("doc", "part").agg(F.collect_list(F.struct("start", "n")).alias("cuts"))
    told = stage(
        per_doc.select(F.col("doc").alias("id"), "part", "cuts", F.lit(False).alias("whole")).unionByName(
            later.select("id", "part", F.lit(None).cast("array<struct<start:int,n:int>>").alias("cuts"), F.lit(True).alias("whole"))
        ),
        "cuts",
    )
    return docs.join(told, ["id", "part"], "left")


def cut_arrays(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """The runs of every row as two arrays."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values, offsets = column.flatten(), np.concatenate(([0], np.cumsum(np.array([len(x) if x.is_valid else 0 for x in column], np.int64))))
    start = values.field("start").to_numpy(zero_copy_only=False).astype(np.int64)
    n = values.field("n").to_numpy(zero_copy_only=False).astype(np.int64)
    return [(start[a:b], n[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
