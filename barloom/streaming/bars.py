"""Streaming forms of the bar builder and of the bar upsert.

The bar builder is the batch aggregate under a watermark: in append mode a bar is
emitted once, when no later event can still change it; events behind the
watermark are dropped and counted. The upsert runs the batch upsert per
micro-batch against the table written so far, and records every batch it has
written, so that a replayed batch is told from a new one.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from barloom.session import materialise
from barloom.sources.bars import one_per_key

WIDTH = "1 hour"


def stream_bars(
    events: DataFrame,
    width: str = WIDTH,
    lateness: str = "10 minutes",
    symbol: str = "event_type",
    value: str = "value",
    tie: str = "event_id",
) -> DataFrame:
    """OHLCV bars of an event stream; append mode emits a bar once the watermark passes its end."""
    at = F.struct("ts", tie)
    return (
        events.withColumn("ts", F.col("ts").cast("timestamp"))
        .filter(F.col(value).isNotNull())
        .withWatermark("ts", lateness)
        .groupBy(F.col(symbol).alias("symbol"), F.window("ts", width).alias("w"))
        .agg(
            F.min_by(value, at).alias("open"),
            F.max(value).alias("high"),
            F.min(value).alias("low"),
            F.max_by(value, at).alias("close"),
            F.count(F.lit(1)).cast("double").alias("volume"),
        )
        .select(
            "symbol",
            F.year("w.start").alias("year"),
            F.col("w.start").cast("timestamp_ntz").alias("ts"),
            "open",
            "high",
            "low",
            "close",
            "volume",
        )
    )


def late_rows(query: StreamingQuery) -> int:
    """Events the query has dropped for being behind the watermark, over the progress it still holds."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def commits_of(path: str) -> str:
    """Where `stream_upsert` records the batches written to the table at `path`."""
    return path.rstrip("/") + "_batches"


def _read_if_there(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


COMMIT = "batch bigint, new_rows bigint"


def upsert_batch(batch: DataFrame, batch_id: int, path: str) -> int:
    """Append the batch's rows whose key the table lacks; returns how many.

    A batch that is recorded already is left alone. One that failed after writing, before its record, finds its own
    keys in the table and adds nothing.
    """
    spark = batch.sparkSession
    done = _read_if_there(spark, commits_of(path), COMMIT)
    if done is not None and not done.filter(F.col("batch") == batch_id).isEmpty():
        return 0
    fresh = one_per_key(batch, ["symbol", "ts"])
    old = _read_if_there(spark, path, batch.schema)
    if old is not None:
        # One row per year of the batch; only those years of the table are read.
        known = old.join(F.broadcast(batch.select("year").distinct()), "year", "left_semi").select("symbol", "ts")
        fresh = fresh.join(known, ["symbol", "ts"], "left_anti")
    fresh = materialise(fresh, "fresh-bars")
    new_rows = fresh.count()
    fresh.write.mode("append").partitionBy("year").parquet(path)
    spark.range(1).select(F.lit(batch_id).cast("bigint").alias("batch"), F.lit(new_rows).cast("bigint").alias("new_rows")).write.mode("append").parquet(commits_of(path))
    return new_rows


def stream_upsert(bars: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append new bars to the Parquet table at `path`; keys already there keep their first row."""

    def write(batch: DataFrame, batch_id: int) -> None:
        upsert_batch(batch, batch_id, path)

    writer = bars.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if once else writer).start()
