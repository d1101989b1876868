"""Shards of near equal bytes: runs of rows in one global order, cut at equal targets of the running size.

Only DataFrame functions are used. The order is doc_id (null first), then a hash of the text, then the row's number in
the scan, so that a doc_id or a text held by a third of all rows is still dealt over many partitions.

1. One scan writes the narrow keys of every row (size, crc32, order) to the shared folder; texts are not moved.
2. The keys are range-partitioned. Each partition's totals, one row per partition, become prefix sums: rows and bytes
   before it. Inside a partition a running sum gives every row its place in the corpus.
3. A row belongs to the shard in whose stretch of `total / shards` bytes its middle byte lies. So every shard is one run
   of the order, and differs from the target by at most one half of the row at each of its two cuts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import load, query, rows_of, stage

SHARDS = 8
#: Rows of keys in a range partition, at most about.
PART_ROWS = 1 << 21
#: Names the keys have beside the columns of the documents.
ID, TIE, ROW, SIZE, CRC = "__shard_id", "__shard_tie", "__shard_row", "__shard_size", "__shard_crc"


def _keys(id_col: str, text_col: str) -> dict[str, Column]:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return {
        ID: F.col(id_col).cast("bigint"),
        TIE: F.xxhash64(text),
        ROW: F.monotonically_increasing_id(),
        SIZE: F.octet_length(text).cast("bigint") + 1,
        CRC: F.crc32(text.cast("binary")),
    }


def _place(keys: DataFrame, shards: int) -> DataFrame:
    """Of a staged table of keys: ID, TIE, ROW, SIZE, CRC, shard and slot."""
    spark = keys.sparkSession
    order = [F.asc_nulls_first(ID), F.asc(TIE), F.asc(ROW)]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows_of(keys) // PART_ROWS))
    # Written once: totals and rows must see the same partition numbers.
    placed = stage(keys.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "shard-parts")
    # One row per range partition goes through this single window.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("part").agg(F.count(F.lit(1)).alias("rows"), F.sum(SIZE).alias("bytes"))
    shifts = totals.select(
        "part",
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.sum("bytes").over(Window.partitionBy()).alias("all_bytes"),
    )
    inside = Window.partitionBy("part").orderBy(*order)
    local = placed.withColumns(
        {"nth": F.row_number().over(inside), "up_to": F.sum(SIZE).over(inside.rowsBetween(Window.unboundedPreceding, 0))}
    )
    # Twice the middle of the row against twice the target, in whole numbers.
    middle = F.expr(f"2 * (bytes_before + up_to) - {SIZE}")
    cut = stage(
        local.join(shifts, "part").withColumn("middle", middle).select(
            ID, TIE, ROW, SIZE, CRC, F.expr(f"cast((middle * {shards}) div (2 * all_bytes) as int)").alias("shard"),
            (F.col("rows_before") + F.col("nth") - 1).alias("place"),
        ),
        "shard-rows",
    )
    # One row per shard.
    firsts = cut.groupBy("shard").agg(F.min("place").alias("first"))
    return cut.join(F.broadcast(firsts), "shard").withColumn("slot", F.col("place") - F.col("first")).drop("place", "first")


def assign(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    `size` is the text's UTF-8 bytes plus 1, `slot` the place in the shard, from 0 without gaps. The law is `bytes`;
    `grown_shard` is null, since adding a shard moves the cuts.

    * A null or empty text has size 1 and crc32 0. A null doc_id comes first.
    * Rows of one doc_id, and rows repeated whole, are separate rows; which of equal rows has which slot is open.
    * A row larger than a shard's target has a shard for itself or nearly so; shards it leaves without rows stay empty.
    * Other columns are not read. No rows give no rows.
    """
    rows = _place(stage(docs.select(*[c.alias(n) for n, c in _keys(id_col, text_col).items()]), "shard-keys"), shards)
    return rows.select(
        F.col(ID).alias("doc_id"),
        F.col(SIZE).alias("size"),
        F.col(CRC).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the documents, all columns, as Parquet in folders `shard=0` .. under `path`.

    Shards are runs of the order, so the first keys of the shards, one row each, tell every row its shard: the texts
    are copied to the shared folder once (so that row numbers stand) and are not shuffled. A column named `shard` is
    replaced.
    """
    held = stage(docs.drop("shard").withColumns(_keys(id_col, text_col)), "shard-texts")
    cuts = _place(held.select(ID, TIE, ROW, SIZE, CRC), shards).filter("slot = 0").select("shard", ID, TIE, ROW).collect()
    key = F.struct(F.col(ID).isNotNull(), F.coalesce(F.col(ID), F.lit(0).cast("bigint")), F.col(TIE), F.col(ROW))
    shard = F.lit(0)
    for cut in sorted(cuts, key=lambda c: c["shard"]):
        first = [F.lit(v).cast("bigint") for v in (cut[ID] or 0, cut[TIE], cut[ROW])]
        shard = F.when(key >= F.struct(F.lit(cut[ID] is not None), *first), F.lit(cut["shard"])).otherwise(shard)
    held.withColumn("shard", shard).drop(ID, TIE, ROW, SIZE, CRC).write.partitionBy("shard").parquet(path)


@query("op13_balanced_shards")
def _op13(spark, sf_dir):
    return assign(load(spark, sf_dir, "documents"))
