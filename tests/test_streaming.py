"""Streamed bars under a watermark in append mode, and the recorded upsert."""

import datetime as dt
import os

from pyspark.sql import functions as F

from barloom.sources.bars import bars_from_events
from barloom.streaming.bars import commits_of, late_rows, stream_bars, stream_upsert, upsert_batch

START = dt.datetime(2024, 12, 31, 20, 0)
SCHEMA = "event_type string, ts timestamp, event_id long, value double"


def event(i, minutes, symbol="a"):
    return (symbol, START + dt.timedelta(minutes=minutes), i, 100.0 + i % 7)


#: Batches of events: within one they are out of order, across them they go on; the last holds late ones.
BATCHES = [
    [event(1, 50), event(2, 5), event(3, 65), event(4, 20, "b"), event(5, 61)],
    [event(6, 130), event(7, 62), event(8, 118), event(9, 125, "b")],
    [event(10, 190), event(13, 181), event(14, 126)],
    [event(15, 400), event(11, 3), event(12, 55, "b"), event(16, 400, "b")],
]
LATE = {11, 12}


def files(spark, tmp_path, batches):
    """One file a batch, read in order of time of writing."""
    folder = tmp_path / "events"
    for i, rows in enumerate(batches):
        place = folder / f"part={i}"
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("overwrite").parquet(str(place))
        for written in place.iterdir():
            os.utime(written, (1_700_000_000 + 60 * i,) * 2)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder / "part=*"))


def as_rows(df):
    return sorted((r.symbol, r.ts, r.open, r.high, r.low, r.close, r.volume) for r in df.collect())


def test_append_mode_emits_every_bar_once(spark, tmp_path):
    emitted = []
    stream = stream_bars(files(spark, tmp_path, BATCHES), lateness="10 minutes")
    query = (
        stream.writeStream.outputMode("append")
        .option("checkpointLocation", str(tmp_path / "check"))
        .trigger(availableNow=True)
        .foreachBatch(lambda batch, _: emitted.extend(batch.collect()))
        .start()
    )
    query.awaitTermination(240)
    seen = [(r.symbol, r.ts) for r in emitted]
    assert len(seen) == len(set(seen)) > 3
    in_time = [e for rows in BATCHES for e in rows if e[2] not in LATE]
    want = as_rows(bars_from_events(spark.createDataFrame(in_time, SCHEMA).withColumn("ts", F.col("ts").cast("timestamp_ntz"))))
    got = sorted((r.symbol, r.ts, r.open, r.high, r.low, r.close, r.volume) for r in emitted)
    # The last hour stays open: nothing later has closed it.
    assert got == [w for w in want if w[1] < START + dt.timedelta(hours=6)]
    assert late_rows(query) == len(LATE)


def test_stream_into_the_table(spark, tmp_path):
    table = str(tmp_path / "bars")
    for _ in range(2):
        stream_upsert(stream_bars(files(spark, tmp_path, BATCHES), lateness="10 minutes"), table, str(tmp_path / "check")).awaitTermination(240)
    back = spark.read.parquet(table)
    assert back.count() == back.select("symbol", "ts").distinct().count() > 3
    assert {r.year for r in back.select("year").distinct().collect()} >= {2024}
    told = spark.read.parquet(commits_of(table))
    assert told.agg(F.sum("new_rows")).first()[0] == back.count()
    assert told.count() == told.select("batch").distinct().count()


def test_a_replayed_batch_adds_nothing(spark, tmp_path):
    table = str(tmp_path / "bars")
    base = bars_from_events(spark.createDataFrame(BATCHES[0] + BATCHES[1], SCHEMA).withColumn("ts", F.col("ts").cast("timestamp_ntz")))
    first = base.filter("symbol = 'a'")
    assert upsert_batch(first, 0, table) == first.count()
    assert upsert_batch(base, 0, table) == 0
    assert upsert_batch(base, 1, table) == base.count() - first.count()
    # A batch that failed before its record was written: its keys are there, its rows are not doubled.
    other = base.withColumn("close", F.col("close") + 1)
    assert upsert_batch(other, 2, table) == 0
    assert as_rows(spark.read.parquet(table)) == as_rows(base)
