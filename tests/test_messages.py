"""Messages once each, by state that ends; the daily report without state."""

from __future__ import annotations

import time
from pathlib import Path
from datetime import datetime, timedelta, timezone

from tarsift.plans.store import Store
from tarsift.sources import queue as qs
from tarsift.streaming import worker
from tarsift.streaming.messages import told_apart
from tests.archive_fixtures import ARCHIVES


def land(spark, work, rows):
    frame = spark.createDataFrame(rows, "name string, version string, queued_at string")
    frame.coalesce(1).write.mode("append").json(work + "/in")


def follow(spark, work, keep):
    stream = told_apart(qs.stream_queue(spark, work + "/in"), keep)
    writer = stream.writeStream.format("parquet").option("path", work + "/out").option("checkpointLocation", work + "/state")
    # State with a time to live has a next batch for ever, so a run takes one.
    writer.trigger(once=True).start().awaitTermination(100)
    rows = spark.read.parquet(work + "/out").select("name", "version", "kind").collect()
    return sorted(map(tuple, rows), key=str)


def test_messages_are_told_apart(spark, work):
    now = datetime.now(timezone.utc).isoformat()
    keep = timedelta(hours=1)
    old = (datetime.now(timezone.utc) - timedelta(hours=3)).isoformat()
    land(spark, work, [("a", "1", now), ("a", "1", now), ("b", "1", None), ("c", "1", old), ("a", "2", now)])
    first = [("a", "1", "fresh"), ("a", "1", "repeat"), ("a", "2", "fresh"), ("b", "1", "fresh"), ("c", "1", "late")]
    assert follow(spark, work, keep) == first
    # A restart knows what was seen; nothing is dropped.
    land(spark, work, [("a", "1", now), ("c", "1", now), ("d", "1", now)])
    more = [("a", "1", "repeat"), ("c", "1", "repeat"), ("d", "1", "fresh")]
    assert follow(spark, work, keep) == sorted(first + more, key=str)


def test_an_entry_ends(spark, work):
    keep = timedelta(seconds=2)
    land(spark, work, [("a", "1", None)])
    assert follow(spark, work, keep) == [("a", "1", "fresh")]
    time.sleep(4)
    land(spark, work, [("a", "1", None)])
    assert follow(spark, work, keep) == [("a", "1", "fresh"), ("a", "1", "fresh")]


def test_the_worker_leaves_repeats_out(spark, work):
    folder = Path(work, "archives")
    folder.mkdir()
    for name in ("plain@1.0.0.tgz", "@s__p@2.0.0.tgz"):
        (folder / name).write_bytes(ARCHIVES[name])
    store = Store(spark, work + "/store")
    open_archives = worker.downloaded(spark, str(folder))
    land(spark, work, [("plain", "1.0.0", None), ("plain", "1.0.0", None), ("@s/p", "2.0.0", None)])
    for _ in range(2):
        messages = qs.stream_queue(spark, work + "/in")
        writer = worker.analyse_worker(
            messages, store, open_archives, work + "/state", folder=work + "/shared", keep=timedelta(hours=1)
        )
        writer.trigger(once=True).start().awaitTermination(200)
        land(spark, work, [("plain", "1.0.0", None)])
    runs = sorted(r["name"] for r in store.history("scan_runs").collect())
    assert runs == ["@s/p", "plain"]
    assert store.current("findings").count() > 0
    # The second batch held a repeat alone and wrote nothing.
    assert not Path(work, "store", "scans", "commit=1").exists()


def test_daily_report_takes_late_rows_and_replays(spark, work):
    schema = "name string, analyzed_at timestamp, findings bigint"

    def land(rows):
        rows = [(n, datetime.fromisoformat(at), f) for n, at, f in rows]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(work + "/days")

    def follow():
        stream = spark.readStream.schema(schema).parquet(work + "/days")
        worker.run_available(worker.write_daily(stream, work + "/sums", work + "/state"))

    def totals(**days):
        return sorted((str(r["date"]), r["versions"], r["packages"], r["findings"]) for r in worker.daily_totals(spark, work + "/sums", **days).collect())

    utc = "+00:00"
    land([("a", "2025-01-01T10:00:00" + utc, 2), ("a", "2025-01-01T11:00:00" + utc, None), ("b", "2025-01-02T01:00:00" + utc, 1)])
    follow()
    assert totals() == [("2025-01-01", 2, 1, 2), ("2025-01-02", 1, 1, 1)]
    # A year late: the day is reopened; a package counts once a day however many batches it is in.
    land([("a", "2025-01-01T09:00:00" + utc, 5), ("c", "2025-01-01T09:00:00" + utc, 0), ("b", "2026-02-02T00:00:00" + utc, 1)])
    follow()
    want = [("2025-01-01", 4, 2, 7), ("2025-01-02", 1, 1, 1), ("2026-02-02", 1, 1, 1)]
    assert totals() == want
    assert totals(first="2025-01-02", last="2025-12-31") == want[1:2]
    # A batch that comes again replaces its step: forget that the second one was committed.
    (commit,) = [p for p in Path(work, "state", "commits").iterdir() if p.name == "1"]
    commit.unlink()
    crc = commit.with_name(".1.crc")
    if crc.exists():
        crc.unlink()
    follow()
    assert totals() == want
