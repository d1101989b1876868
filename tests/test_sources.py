"""CSV and Parquet sources and sinks, upsert, and the streaming forms."""

import pytest
from pyspark.sql import functions as F

from barloom.operators import thresholds
from barloom.sources import bars as src
from barloom.streaming.bars import stream_bars, stream_upsert

EVENTS = "/root/testdata/sf0.001/events.parquet"


def keys(df):
    return sorted(tuple(r) for r in df.collect())


def test_csv_scan_drops_unreadable_rows(spark, tmp_path):
    (tmp_path / "a").mkdir()
    head = "symbol,dates,open,high,low,close,volume\n"
    (tmp_path / "x_2023.csv").write_text(head + "s,2023-01-02 00:00:00,1,2,0.5,1.5,3\ns,not a date,1,2,0.5,1.5,3\n")
    (tmp_path / "a" / "x_2024.csv").write_text(head + "s,2024-01-02 00:00:00,1,2,0.5,,3\ns,2024-01-02 00:01:00,1,2,0.5,1.5,\n")
    out = src.read_bar_csv(spark, str(tmp_path))
    assert {(r.year, r.volume) for r in out.collect()} == {(2023, 3.0), (2024, None)}
    assert src.read_bar_csv(spark, str(tmp_path), [2023]).count() == 1


def test_partitioned_table_prunes_years(spark, tmp_path):
    df = spark.range(100).select((F.lit(2020) + F.col("id") % 4).cast("int").alias("year"), F.col("id").alias("v"), F.lit("x").alias("w"))
    path = str(tmp_path / "t")
    src.write_partitioned(df, path)
    part = src.read_years(spark, path, [2021, 2023], ["v"])
    assert part.count() == 50
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [year" in plan and "w:string" not in plan


def test_feature_store_is_kept_unless_told(spark, tmp_path):
    path = str(tmp_path / "s")
    src.save_feature_store(spark.range(3), path)
    src.save_feature_store(spark.range(9), path)
    assert spark.read.parquet(path).count() == 3
    src.save_feature_store(spark.range(9), path, overwrite=True)
    assert spark.read.parquet(path).count() == 9


def test_upsert_keeps_the_old_row(spark):
    old = spark.createDataFrame([("s", 1, 10.0), ("s", 2, 20.0)], "symbol string, ts int, close double")
    new = spark.createDataFrame([("s", 2, 0.0), ("s", 3, 30.0)], "symbol string, ts int, close double")
    assert keys(src.upsert_bars(old, new)) == [("s", 1, 10.0), ("s", 2, 20.0), ("s", 3, 30.0)]


@pytest.fixture(scope="module")
def event_stream(spark, tmp_path_factory):
    """The events in two files, in time order."""
    folder = tmp_path_factory.mktemp("events")
    df = spark.read.parquet(EVENTS)
    for part, cond in (("1", "day(ts) <= 15"), ("2", "day(ts) > 15")):
        df.filter(cond).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_streamed_bars_equal_batch_bars(spark, event_stream, tmp_path):
    q = stream_bars(event_stream).writeStream.format("memory").queryName("bars_mem").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    batch = src.bars_from_events(spark.read.parquet(EVENTS))
    assert keys(spark.table("bars_mem")) == keys(batch)


def test_streamed_upsert_is_idempotent(spark, event_stream, tmp_path):
    path = str(tmp_path / "bars")
    raw = event_stream.select(
        F.col("event_type").alias("symbol"), F.year("ts").alias("year"), "ts", F.col("value").alias("close")
    )
    for run in ("a", "b"):
        q = stream_upsert(raw, path, str(tmp_path / run))
        q.awaitTermination()
        assert q.exception() is None
    want = spark.read.parquet(EVENTS).select("event_type", "ts").distinct().count()
    assert spark.read.parquet(path).count() == want


def test_bar_audit_counts(make_bars, spark):
    df = make_bars([(1, 2, 0.5, 1), (1, 0.2, 0.5, 1), (1, 2, 0.5, 1)])
    again = df.filter("high < low")
    hole = df.filter("high > low").withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 HOUR")).withColumn("open", F.lit(None).cast("double"))
    r = thresholds.bar_audit(df.unionByName(again).unionByName(hole)).first()
    assert (r.rows, r.duplicate_dates, r.missing_base_rows, r.high_lt_low, r.gaps, r.max_gap_min) == (6, 1, 2, 2, 2, 58.0)
