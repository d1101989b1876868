"""Web archives (WARC 1.1) written by Spark and read through a Python data source.

Writing uses Spark's text writer: a row is a record, the line separator is the blank lines that end it, and Spark's own
commit protocol makes lost and repeated tasks harmless. Reading is a data source: files are grouped into partitions,
`record_type = ...` and equality filters on header columns are pushed to the reader, which parses a record's headers
first and steps over the payload of records that are not wanted without reading or decoding it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from barloom.llm.common import load, query, shared_folder, stage

#: Fixed values of the format.
VERSION, EOL, RECORD_END = "WARC/1.1", "\r\n", "\r\n\r\n"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Columns and the headers they are read from.
HEADERS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "target_uri": "WARC-Target-URI",
    "payload_digest": "WARC-Payload-Digest",
    "payload_bytes": "X-Payload-Length",
    "refers_to": "WARC-Refers-To",
}
SCHEMA = "record_type string, record_id string, target_uri string, payload_digest string, payload_bytes bigint, refers_to string, payload binary"
#: Equal payloads of at least this many bytes are written once.
LEAST_REVISIT = 100


# --- writing --------------------------------------------------------------------------------------------


def _urn(id_column: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), id_column.cast("string"), F.lit(">"))


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """What is written for every page: id, url, payload, digest, bytes, first (the id of the response it revisits).

    Of equal payloads of at least LEAST_REVISIT bytes the smallest id is the response. Digests are folded to one row
    each before they are joined back, and payloads of revisits are dropped before writing.
    """
    text = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(
        F.col(id_col).cast("bigint").alias("id"),
        F.coalesce(F.col(url_col), F.lit("")).alias("url"),
        text.alias("payload"),
        F.sha2(text.cast("binary"), 256).alias("digest"),
        F.octet_length(text).cast("bigint").alias("bytes"),
    )
    long = rows.filter(F.col("bytes") >= LEAST_REVISIT)
    repeated = long.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    later = long.select("id", "digest").join(stage(repeated, "repeated"), "digest").filter("id > first").select("id", "digest", "first")
    # Only pages that revisit another are in this table; its size on disk tells the planner how to join. A page is
    # known by id and digest, since rows of one id may hold different payloads.
    later = stage(later.distinct(), "revisits")
    return rows.join(later, ["id", "digest"], "left")


def write_archives(records: DataFrame, path: str, id_to_urn=_urn) -> None:
    """Write planned records as WARC files under `path`. URLs lose line breaks, which a header can't hold."""
    revisit = F.col("first").isNotNull()
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload"))

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit(EOL))

    head = F.concat(
        F.lit(VERSION + EOL),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", id_to_urn(F.coalesce(F.col("id").cast("string"), F.lit("")))),
        line("WARC-Target-URI", F.translate("url", "\r\n", "")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        line("X-Payload-Length", F.col("bytes").cast("string")),
        F.when(revisit, F.concat(line("WARC-Refers-To", id_to_urn(F.col("first"))), line("WARC-Profile", F.lit(SAME_PAYLOAD)))).otherwise(""),
        line("Content-Length", F.octet_length(body).cast("string")),
        F.lit(EOL),
    )
    records.select(F.concat(head, body).alias("value")).write.option("lineSep", RECORD_END).text(path)


# --- reading --------------------------------------------------------------------------------------------


class FileGroup(InputPartition):
    """Archive files that one task reads."""

    def __init__(self, paths: list[str]) -> None:
        super().__init__(paths)
        self.paths = paths


def _accepts(tests: list[tuple[str, frozenset]], head: dict[str, str]) -> bool:
    return all(head.get(HEADERS[column].lower()) in wanted for column, wanted in tests)


def read_records(stream, tests: list[tuple[str, frozenset]], payload: bool = True) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Headers (lower-case names) and payload of the records that pass `tests`; other payloads are stepped over."""
    while True:
        first = stream.readline()
        if not first:
            return
        if first in (b"\r\n", b"\n"):
            continue
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no WARC record starts at byte {stream.tell() - len(first)}")
        head: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head[name.strip().lower()] = value.strip()
        length = int(head.get("content-length") or 0)
        if _accepts(tests, head):
            if payload:
                yield head, stream.read(length)
                continue
            yield head, None
        stream.seek(length, 1)


class WarcReader(DataSourceReader):
    def __init__(self, files: list[tuple[str, int]], payload: bool, group_bytes: int) -> None:
        self.files, self.payload, self.group_bytes = files, payload, group_bytes
        self.tests: list[tuple[str, frozenset]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes equality and IN over header columns; leaves every other filter to Spark."""
        for f in filters:
            column = ".".join(getattr(f, "attribute", ()))
            if isinstance(f, EqualTo) and column in HEADERS and isinstance(f.value, str) and column != "payload_digest":
                self.tests.append((column, frozenset([f.value])))
            elif isinstance(f, In) and column in HEADERS and all(isinstance(v, str) for v in f.value) and column != "payload_digest":
                self.tests.append((column, frozenset(f.value)))
            else:
                yield f

    def partitions(self) -> list[FileGroup]:
        groups, held, size = [], [], 0
        for path, length in sorted(self.files):
            if held and size + length > self.group_bytes:
                groups.append(FileGroup(held))
                held, size = [], 0
            held.append(path)
            size += length
        return [*groups, FileGroup(held)]

    def read(self, partition: FileGroup) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        names = [*HEADERS, "payload"]
        kinds = [pa.int64() if n == "payload_bytes" else pa.binary() if n == "payload" else pa.string() for n in names]
        schema = pa.schema(list(zip(names, kinds)))

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], schema=schema)

        rows: list[tuple] = []
        size = 0
        for path in partition.paths:
            store, at = fs.FileSystem.from_uri(path)
            with store.open_input_file(at) as raw:
                for head, payload in read_records(_Buffered(raw), self.tests, self.payload):
                    digest = head.get("warc-payload-digest")
                    length = head.get("x-payload-length")
                    rows.append(
                        (
                            head.get("warc-type"),
                            head.get("warc-record-id"),
                            head.get("warc-target-uri"),
                            digest.partition(":")[2] if digest else None,
                            int(length) if length else None,
                            head.get("warc-refers-to"),
                            payload,
                        )
                    )
                    size += len(payload or b"") + 256
                    if size > 1 << 22:
                        yield batch(rows)
                        rows, size = [], 0
        if rows:
            yield batch(rows)


class _Buffered:
    """readline, read and forward seek over a random-access file, a block at a time; long skips are never read."""

    BLOCK = 1 << 18

    def __init__(self, raw: pa.NativeFile) -> None:
        self.raw, self.block, self.at, self.start = raw, b"", 0, 0

    def tell(self) -> int:
        return self.start + self.at

    def _more(self) -> bool:
        self.start += len(self.block)
        self.block, self.at = self.raw.read(self.BLOCK), 0
        return bool(self.block)

    def readline(self) -> bytes:
        parts = []
        while True:
            end = self.block.find(b"\n", self.at)
            if end >= 0:
                parts.append(self.block[self.at : end + 1])
                self.at = end + 1
                return b"".join(parts)
            parts.append(self.block[self.at :])
            self.at = len(self.block)
            if not self._more():
                return b"".join(parts)

    def read(self, n: int) -> bytes:
        parts = []
        while n > 0:
            got = self.block[self.at : self.at + n]
            self.at += len(got)
            n -= len(got)
            parts.append(got)
            if n and not self._more():
                break
        return b"".join(parts)

    def seek(self, n: int, _whence: int = 1) -> None:
        left = len(self.block) - self.at
        if n <= left:
            self.at += n
            return
        at = self.tell() + n
        self.raw.seek(at)
        self.block, self.at, self.start = b"", 0, at


class WarcSource(DataSource):
    """`spark.read.format("warc")`: options `files` (one `length uri` per line), `payload` (true, false), `group_bytes`."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        files = [(uri, int(n)) for n, uri in (x.split(" ", 1) for x in self.options.get("files", "").splitlines() if x)]
        return WarcReader(files, self.options.get("payload", "true") == "true", int(self.options.get("group_bytes", 1 << 26)))


def list_files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Data files under a folder in any file system that Spark knows: (uri, bytes)."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [(s.getPath(), s.getLen()) for s in store.listStatus(where) if s.isFile()]
    return [(p.toString(), n) for p, n in found if not p.getName().startswith(("_", ".")) and n]


def read_archives(spark: SparkSession, path: str, payload: bool = True, group_bytes: int = 1 << 26) -> DataFrame:
    """All records of the archives in a folder; an archive is read by one task, small ones together."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    files = "\n".join(f"{n} {uri if '://' in uri else 'file://' + uri.removeprefix('file:')}" for uri, n in list_files(spark, path))
    return spark.read.format("warc").option("files", files).option("payload", str(payload).lower()).option("group_bytes", group_bytes).load()


def _page_id(urn: str) -> Column:
    return F.regexp_extract(urn, r"<urn:page:(-?\d*)>", 1).try_cast("bigint")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the archives, read them back, and tell per record: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Bytes and digest of a response are those of the payload that was read; those of a revisit are in its headers, and
    its payload is never read.

    * Null html is an empty payload. A null page_id is written without number and read as null; it never wins.
    * Rows repeating a page_id are one record each; equal ones of the smallest id are all responses.
    * Other columns are not read. Without pages there is no archive and no row.
    """
    spark = pages.sparkSession
    path = shared_folder(spark, "archives")
    write_archives(plan_records(pages), path)
    full = read_archives(spark, path).filter("record_type = 'response'")
    bare = read_archives(spark, path, payload=False).filter("record_type = 'revisit'")
    responses = full.select(
        _page_id("record_id").alias("page_id"),
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_digest"),
        "record_type",
        F.lit(None).cast("bigint").alias("refers_to"),
    )
    revisits = bare.select(
        _page_id("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", _page_id("refers_to").alias("refers_to")
    )
    return responses.unionByName(revisits)


@query(
    "op9_warc",
    f"""
    WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
         d AS (SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest FROM p),
         m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN payload_bytes >= {LEAST_REVISIT} AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN payload_bytes >= {LEAST_REVISIT} AND page_id > first THEN first END AS refers_to
    FROM m
    """,
)
def _op9(spark, sf_dir):
    return round_trip(load(spark, sf_dir, "pages"))
