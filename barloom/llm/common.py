"""Query registry, table loading, staged tables in the shared folder, and whole texts as flat numpy arrays."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def prepare(spark: SparkSession) -> None:
    """Session settings the operators rely on: UTC, and Arrow batches of few rows since texts can be long."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(1 << 24))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, and the SQL that must give the same rows."""

    def keep(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            CHECKS[name] = sql
        return fn

    return keep


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (`spark.checkpoint.dir`).

    Where that is unset, a temporary folder serves in local mode only; on a cluster it is an error, since
    executors would write to disks of their own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="barloom-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table once to the shared folder and read it back: lineage is cut, and the planner sees its size."""
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def rows_of(table: DataFrame) -> int:
    """Row count of a staged table, from Parquet footers."""
    return table.count()


# --- texts as flat arrays ------------------------------------------------------------------------------

#: Texts are worked on in runs of about this many bytes, so that numpy's arrays stay in cache; a longer text is a run.
RUN_BYTES = 1 << 19


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def runs(offsets: np.ndarray, most: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows holding about `most` bytes each."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(n, max(last, first + 1))
        yield first, last
        first = last


_CLASS_SPACE = np.zeros(256, bool)
_CLASS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words `[^\\x20\\x09-\\x0D]+` of every row, and the offsets of the rows' words."""
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    ink = ~_CLASS_SPACE[raw]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    start = np.flatnonzero(ink & (first[:n] | ~np.concatenate(([False], ink[:-1]))))
    end = np.flatnonzero(ink & (first[1:] | ~np.concatenate((ink[1:], [False])))) + 1
    return start, end, np.searchsorted(start, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Rolling:
    """Polynomial hashes modulo 2**64 of any slice of a number sequence, from one prefix sum."""

    def __init__(self, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.base = (int(rng.integers(1 << 62)) * 8 + 5) % (1 << 64)
        self.back = pow(self.base, -1, 1 << 64)
        self.bytes = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self._up = np.ones(1, np.uint64)
        self._down = np.ones(1, np.uint64)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._up) < n:
            grown = max(n, 1 << 20)
            ones = np.full(grown, 1, np.uint64)
            for name, factor in (("_up", self.base), ("_down", self.back)):
                steps = ones * np.uint64(factor)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self._up[:n], self._down[:n]

    def prefix(self, values: np.ndarray) -> np.ndarray:
        """values: uint64; the prefix sums that `of` takes."""
        up, _ = self.powers(len(values) + 1)
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], dtype=np.uint64, out=out[1:])
        return out

    def of(self, prefix: np.ndarray, start: np.ndarray | slice, end: np.ndarray | slice, at: np.ndarray | slice | None = None) -> np.ndarray:
        """Hash of every slice [start, end)."""
        _, down = self.powers(len(prefix))
        return (prefix[end] - prefix[start]) * down[start if at is None else at]


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, rolling: Rolling, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of every word, of its bytes and length."""
    table = rolling.bytes[_LOWER] if lower else rolling.bytes
    prefix = rolling.prefix(table[raw])
    return mix(rolling.of(prefix, start, end) + (end - start).astype(np.uint64))


#: White space other than spaces and line feeds, of ASCII and beyond: a search for one character is a scan of memory.
_ASCII_BLANKS = [chr(c) for c in range(128) if chr(c).isspace() and chr(c) not in " \n"]
_WIDE_BLANKS = [chr(c) for c in range(128, 0x10000) if chr(c).isspace()]


def single_blanks(text: str) -> bool:
    """Whether the white space of a text is single spaces and line feeds between other characters, and nothing else."""
    if len(text.split()) != text.count(" ") + text.count("\n") + 1 or any(map(text.__contains__, _ASCII_BLANKS)):
        return False
    return text.isascii() or not any(map(text.__contains__, _WIDE_BLANKS))


def text_column(df: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """Only the columns an operator reads, under its own names: `id`, `text` (null text: empty)."""
    return df.select(
        F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *more
    )


def chunked(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = RUN_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of record batches with about `most` bytes of text, each with its bytes and offsets."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        raw, offsets = flat(batch.column(column))
        for a, b in runs(offsets, most):
            yield batch.slice(a, b - a), raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
