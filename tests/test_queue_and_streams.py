from __future__ import annotations

import hashlib
import json
from pathlib import Path

from archive_fixtures import ARCHIVES, write_archives
from pyspark.sql import functions as F

from tarsift.functions.timestamps import parse_timestamp
from tarsift.operators import queue_building as qb
from tarsift.plans import merge
from tarsift.plans import reports as rp
from tarsift.plans.store import SCHEMAS, Store
from tarsift.sources import archives as ar
from tarsift.sources import findings_io
from tarsift.sources import queue as qs
from tarsift.streaming import worker


def test_queue_file_round_trip(spark, work):
    path = Path(work) / "queue.ndjson"
    record = {"name": "a", "version": "1", "tarball": "t", "shasum": None, "published_at": "2025-01-01T00:00:00Z"}
    path.write_text(json.dumps(record) + "\n\n   \n" + json.dumps({**record, "name": "b"}) + "\n")
    rows = qs.read_queue(spark, str(path)).collect()
    assert [r["name"] for r in rows] == ["a", "b"] and rows[0]["shasum"] is None


def test_checksums(spark, work):
    folder = write_archives(work)
    good = hashlib.sha1(ARCHIVES["plain@1.0.0.tgz"]).hexdigest()
    rows = [("plain", "1.0.0", good.upper()), ("big", "1.0.0", "00"), ("links", "1.0.0", None), ("gone", "1", "00")]
    queue = spark.createDataFrame(rows, "name string, version string, shasum string")
    verified = ar.verify_checksums(ar.archive_files(spark, folder), queue)
    assert {r["name"]: r["checksum_ok"] for r in verified.collect()} == {"plain": True, "big": False, "links": True}
    assert [r["name"] for r in ar.checksum_mismatches(verified).collect()] == ["big"]


def documents(spark, docs: dict):
    rows = [(n, d if isinstance(d, str) else json.dumps(d)) for n, d in docs.items()]
    return qs.parse_documents(spark.createDataFrame(rows, "name string, doc string"))


def registry_doc(latest="1.0.0", tarball="t", **time):
    return {"dist-tags": {"latest": latest}, "versions": {"1.0.0": {"dist": {"tarball": tarball}}}, "time": time}


def test_latest_versions(spark):
    docs = {
        "ok": registry_doc(modified="2025-01-02T00:00:00Z"), "notag": {"versions": {}},
        "gone": registry_doc("2.0.0"), "noarchive": registry_doc(tarball=""), "bad": "not json",
    }
    rows = qb.latest_versions(documents(spark, docs)).collect()
    assert [(r["name"], r["version"], r["meta_head"]) for r in rows] == [("ok", "1.0.0", "2025-01-02T00:00:00Z")]


def test_recency_keeps_unknown_ages(spark):
    docs = {
        "new": registry_doc(a="2025-01-19T00:00:00Z", b="garbage"), "old": registry_doc(a="2020-01-01T00:00:00Z"),
        "unknown": registry_doc(), "garbage": registry_doc(a="x"),
    }
    kept = qb.touched_since(documents(spark, docs), F.lit("2025-01-20").cast("timestamp"), 5)
    assert sorted(r["name"] for r in kept.collect()) == ["garbage", "new", "unknown"]


def test_paging_and_state(spark):
    listing = spark.createDataFrame([(f"p{i}",) for i in range(1, 8)], "name string")
    names = lambda df: [r["name"] for r in df.collect()]
    assert names(qb.next_page(listing, None, 2, 2)) == ["p1", "p2", "p3", "p4"]
    assert sorted(names(qb.next_page(listing, "p5", 2, 0))) == ["p6", "p7"]
    state = spark.createDataFrame([("9", None)], "last_seq string, last_startkey string")
    now = F.lit("2025-01-01").cast("timestamp")
    page = qb.next_page(listing, qb.resume_cursor(state), 2, 2)
    state = qb.next_state(state, page, 2, 2, now, page.limit(3))
    row = state.first()
    assert (row["last_seq"], row["last_startkey"], row["last_processed"]) == ("9", "p4", 3)
    page = qb.next_page(listing, qb.resume_cursor(state), 2, 2)
    assert names(page) == ["p5", "p6", "p7"]
    assert qb.next_state(state, page, 2, 2, now, page).first()["last_startkey"] is None
    assert qb.resume_cursor(state, "0") == "p4" and qb.resume_cursor(state, "2024-01-01") is None


def test_seeds_ignore_what_is_analysed(spark):
    docs = documents(spark, {"a": registry_doc(), "b": registry_doc()})
    done = spark.createDataFrame([("a", "1.0.0", "analyzed")], "name string, version string, status string")
    listing = docs.select("name")
    of = lambda df: sorted((r["name"], r["origin"]) for r in df.collect())
    assert of(qb.build_queue(docs, done, listing=listing)) == [("b", "listing")]
    assert of(qb.build_queue(docs, done, seeds=listing.filter("name = 'a'"), listing=listing)) == [("a", "seeds")]
    assert of(qb.build_queue(docs, None, changes=listing.filter("name = 'b'"), listing=listing)) == [
        ("a", "listing"), ("b", "changes"),
    ]


def test_timestamps(spark):
    cases = {
        "2025-11-23T19:24:49.123Z": "2025-11-23 19:24:49.123", "1700000000": "2023-11-14 22:13:20.000",
        "1700000000.5": "2023-11-14 22:13:20.500", "garbage": None, "": None,
        "2025-11-23T19:24:49+02:00": "2025-11-23 17:24:49.000",
    }
    shown = F.date_format(parse_timestamp(F.col("t")), "yyyy-MM-dd HH:mm:ss.SSS")
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", shown).collect()
    assert {r[0]: r[1] for r in rows} == cases


def test_nul_stripping_leaves_escaped_text(spark):
    dirty = json.dumps({"a": "x\x00\x00y", "b": "\\u0000 as text", "c": "\\\x00"})
    df = spark.createDataFrame([("r\x00", dirty)], "rule string, details string")
    row = merge.sanitized(df).first()
    assert row["rule"] == "r"
    assert json.loads(row["details"]) == {"a": "xy", "b": "\\u0000 as text", "c": "\\"}


def test_documents_round_trip_in_parts(spark, work):
    rows = [("@s/p", "1", "r", "high", f"f{i}", json.dumps({"full_urls": [f"u{i}"]})) for i in range(50)]
    found = spark.createDataFrame(rows, SCHEMAS["findings"])
    docs = findings_io.finding_documents(found, size=7)
    assert docs.count() > 1 and {r["tgz"] for r in docs.collect()} == {"@s__p@1.tgz"}
    findings_io.write_documents(docs, work + "/docs")
    back = findings_io.findings_of_documents(findings_io.read_documents(spark, work + "/docs"))
    assert sorted(tuple(r) for r in back.select(*found.columns).collect()) == sorted(rows)


def test_upserts_keep_what_is_known(spark):
    at = F.lit("2025-01-01").cast("timestamp")
    packages = spark.createDataFrame(
        [("a", "npm", "old", "text", 5, None, None)], SCHEMAS["packages"]
    )
    scanned = spark.createDataFrame(
        [("a", "1", "  ", None), ("b", "1", "new", "d")], "name string, version string, author string, description string"
    )
    rows = {r["name"]: r for r in merge.upsert_packages(packages, scanned, at).collect()}
    assert (rows["a"]["author"], rows["a"]["description"], rows["a"]["dependents"]) == ("old", "text", 5)
    assert (rows["b"]["author"], rows["b"]["ecosystem"]) == ("new", "npm")
    assert rows["a"]["last_seen"] == rows["b"]["last_seen"] is not None


def test_queue_merge_keeps_status(spark, work):
    store = Store(spark, work + "/store")
    columns = "name string, version string, tarball string, integrity string, shasum string, published_at string"
    record = lambda n, url: spark.createDataFrame([(n, "1", url, None, None, None)], columns)
    store.merge_queue(1, record("a", "u1"))
    store.merge_queue(2, record("b", "u2"))
    store.merge_queue(3, record("a", "u4"))
    store.merge_queue(3, record("a", "u3"))
    rows = {r["name"]: (r["tarball_url"], r["status"]) for r in store.current("versions").collect()}
    assert rows == {"a": ("u3", "queued"), "b": ("u2", "queued")}


def test_latest_runs(spark):
    rows = [("a", "1", "2025-01-01", 1), ("a", "1", "2025-01-03", 3), ("a", "1", "2025-01-02", 2), ("b", "1", "2025-01-01", 9)]
    runs = spark.createDataFrame(rows, "name string, version string, completed_at string, score int")
    assert sorted(r["score"] for r in rp.latest_runs(runs).collect()) == [3, 9]


def test_worker_equals_the_batch_scan(spark, work):
    from tarsift.plans.scan import scan_archives

    folder = write_archives(work)
    for path in Path(folder, "nested").iterdir():
        Path(folder, path.name).write_bytes(path.read_bytes())
    landed = Path(work, "queue")
    landed.mkdir()
    names = [("plain", "1.0.0"), ("@s/p", "2.0.0"), ("dropper", "3.1.0"), ("escape", "1.0.0"), ("gone", "1")]
    lines = [json.dumps({"name": n, "version": v, "queued_at": "2025-01-01T00:00:00Z"}) for n, v in names * 2]
    (landed / "1.json").write_text("\n".join(lines) + "\n\n")
    store = Store(spark, work + "/store")

    def run():
        writer = worker.analyse_worker(
            qs.stream_queue(spark, str(landed)), store, worker.downloaded(spark, folder),
            work + "/state", folder=work + "/shared",
        )
        worker.run_available(writer)

    run()
    batch = scan_archives(ar.read_archives(spark, folder), folder=work + "/shared2")
    wanted = ("plain", "@s/p", "dropper")
    of = lambda df: sorted((r["name"], r["rule"], r["details"]) for r in df.filter(F.col("name").isin(*wanted)).collect())
    assert of(store.current("findings")) == of(batch.findings)
    assert {r["name"] for r in store.current("versions").collect()} == set(wanted)
    # A second delivery of analysed versions changes nothing; the missing one may come.
    (landed / "2.json").write_text(json.dumps({"name": "plain", "version": "1.0.0"}) + "\n")
    run()
    assert {r["name"] for r in store.current("versions").collect()} == set(wanted)
    assert store.history("scan_runs").count() == 3
