"""The change feed's own position, and counters that fill while a run writes."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from tarsift.operators import queue_building as qb
from tarsift.sources.feed import FEED_SCHEMA, FeedReader, late_changes, stream_feed
from tarsift.streaming import worker


def land(spark, path, seqs, deleted=False, files=1):
    rows = [(s, f"n{s}", deleted) for s in seqs]
    spark.createDataFrame(rows, FEED_SCHEMA).repartition(files).write.mode("append").parquet(path)


def follow(spark, work, **options):
    stream = stream_feed(spark, work + "/feed", **options)
    writer = stream.writeStream.format("parquet").option("path", work + "/out").option("checkpointLocation", work + "/state")
    worker.run_available(writer)
    return sorted(r["seq"] for r in spark.read.schema(FEED_SCHEMA).parquet(work + "/out").collect())


def test_a_restart_goes_on_behind_the_last_seq(spark, work):
    land(spark, work + "/feed", range(1, 60), files=3)
    assert follow(spark, work, range_width=7) == list(range(1, 60))
    # Nothing new: nothing read.
    assert follow(spark, work, range_width=7) == list(range(1, 60))
    land(spark, work + "/feed", [61, 70, 1000])
    assert follow(spark, work, range_width=7) == [*range(1, 60), 61, 70, 1000]
    # A change that lands behind the position is not read, and is not lost unnoticed either.
    land(spark, work + "/feed", [60, 500, 1001])
    assert follow(spark, work, range_width=7) == [*range(1, 60), 61, 70, 1000, 1001]
    missed = late_changes(spark, work + "/feed", spark.read.parquet(work + "/out"))
    assert sorted(r["seq"] for r in missed.collect()) == [60, 500]


def test_since_leaves_out_what_came_before(spark, work):
    land(spark, work + "/feed", range(1, 20))
    assert follow(spark, work, since=15) == [16, 17, 18, 19]


def test_an_empty_feed(spark, work):
    spark.createDataFrame([], FEED_SCHEMA).write.parquet(work + "/feed")
    stream = stream_feed(spark, work + "/feed")
    writer = stream.writeStream.format("parquet").option("path", work + "/out").option("checkpointLocation", work + "/state")
    worker.run_available(writer)
    assert spark.read.schema(FEED_SCHEMA).parquet(work + "/out").count() == 0


@pytest.mark.parametrize("width", [1, 10, 10**9])
def test_ranges_meet_each_seq_once(width):
    reader = FeedReader("nowhere", -1, width)
    parts = reader.partitions({"seq": 5}, {"seq": 123_456})
    assert len(parts) <= 1000 and parts[0].after == 5 and parts[-1].upto == 123_456
    assert all(a.upto == b.after for a, b in zip(parts, parts[1:]))
    assert reader.partitions({"seq": 7}, {"seq": 7}) == []


def test_counters_of_a_batch_run(spark, work):
    rows = spark.range(100).withColumn("name", F.concat(F.lit("p"), "id"))
    counted, counters = qb.observed(rows, F.col("id") % 4 == 0)
    counted.write.parquet(work + "/queue")
    assert counters.get == {"last_processed": 100, "last_new": 25}
    assert spark.read.parquet(work + "/queue").count() == 100


def test_counters_of_a_stream(spark, work):
    spark.range(90).repartition(3).write.parquet(work + "/in")
    listener = qb.StreamCounters()
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema("id bigint").option("maxFilesPerTrigger", 1).parquet(work + "/in")
        counted = qb.StreamCounters.counted(stream, F.col("id") < 30)
        writer = counted.writeStream.format("parquet").option("path", work + "/out")
        worker.run_available(writer.option("checkpointLocation", work + "/state"))
        for _ in range(100):
            if listener.totals()["last_processed"] == 90:
                break
            time.sleep(0.1)
        assert listener.totals() == {"last_processed": 90, "last_new": 30}
        assert len({batch for _, batch in listener.batches}) == 3
    finally:
        spark.streams.removeListener(listener)
