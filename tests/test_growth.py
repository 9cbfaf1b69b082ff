"""How often rows move, how much they take on disk, and what a task's Python holds."""

from __future__ import annotations

import glob
import gzip
import json
import tarfile

import pandas as pd
from archive_fixtures import tgz, write_archives
from pyspark.sql import functions as F
from test_plans import FOLDER, plan_of

from tarsift.catalog import QUERIES
from tarsift.operators import manifests as mf
from tarsift.operators import signatures
from tarsift.plans.scan import ScanResult, scan_archives
from tarsift.plans.store import SCHEMAS, Store
from tarsift.session import BATCH_BYTES
from tarsift.sources import archives as ar
from tarsift.sources import findings_io, unpack
from tarsift.streaming import worker

FINDING = ("n", "1", "r", "high", "f.js")


def test_findings_move_once_into_documents(spark, work):
    rows = [(*FINDING, json.dumps({"i": i // 4})) for i in range(40)]
    spark.createDataFrame(rows, SCHEMAS["findings"]).write.parquet(work + "/findings")
    docs = findings_io.finding_documents(spark.read.parquet(work + "/findings"), size=3)
    assert plan_of(docs).count("Exchange hashpartitioning") == 1
    # Equal findings are cut apart too; every document but the last is full.
    found = {r["part"]: r["findings"] for r in docs.collect()}
    assert [len(found[k]) for k in sorted(found)] == [3] * 13 + [1]
    assert sorted(f["details"] for fs in found.values() for f in fs) == sorted(r[-1] for r in rows)


def test_documents_are_written_compressed(spark, work):
    rows = [(*FINDING, json.dumps({"path": "package/f.js", "i": i})) for i in range(2000)]
    docs = findings_io.finding_documents(spark.createDataFrame(rows, SCHEMAS["findings"]), size=500)
    findings_io.write_documents(docs, work + "/docs")
    written = sum(row["length"] for row in spark.read.format("binaryFile").load(work + "/docs").select("length").collect())
    assert written < sum(len(r[-1]) for r in rows)
    back = findings_io.findings_of_documents(findings_io.read_documents(spark, work + "/docs"))
    assert sorted(r["details"] for r in back.collect()) == sorted(r[-1] for r in rows)


def test_findings_do_not_move_to_be_stored(spark, work):
    rows = [("n", "1", "r", "high", f"f{i:03}.js", "{}") for i in range(200)]
    spark.createDataFrame(rows, SCHEMAS["findings"]).coalesce(1).write.parquet(work + "/findings")
    versions = spark.createDataFrame([("n", "1")], "name string, version string")
    none = versions.selectExpr("*", "CAST(NULL AS STRING) AS author", "CAST(NULL AS STRING) AS description")
    rejects = versions.selectExpr("'a' AS archive", "*", "'unreadable' AS status").limit(0)
    scores = versions.selectExpr("*", "1 AS score", "'clean' AS label")
    found = spark.read.parquet(work + "/findings")
    Store(spark, work + "/store").merge_scan(1, ScanResult(versions, found, scores, none, rejects))
    for table in ("findings", "scan_run_findings"):
        stored = spark.read.parquet(f"{work}/store/{table}/commit=1").select("file_path").collect()
        assert [r["file_path"] for r in stored] == [r[4] for r in rows]


def test_names_in_one_piece_are_compared_by_all_cores(spark):
    frame = QUERIES["t5_confusable_substitution"](spark, FOLDER)
    assert "hashpartitioning(p_partkey" in plan_of(frame)


def test_batches_for_python_end_by_bytes(spark):
    def sizes(batches):
        for batch in batches:
            yield pd.DataFrame({"bytes": [int(batch["content"].str.len().sum())]})

    frame = spark.range(0, 4000, 1, 1).selectExpr("CAST(repeat('x', 4096) AS BINARY) AS content")
    found = [r["bytes"] for r in frame.mapInPandas(sizes, "bytes bigint").collect()]
    assert sum(found) == 4000 * 4096 and max(found) <= BATCH_BYTES + 4096


def test_manifests_are_checked_once_and_by_all_cores(spark, work, monkeypatch):
    checks, checked = [], mf.valid_json
    monkeypatch.setattr(mf, "valid_json", lambda text: checks.append(1) or checked(text))
    result = scan_archives(ar.read_archives(spark, write_archives(work)), folder=work + "/shared")
    assert {r["name"]: r["author"] for r in result.metadata.collect()}["@s/p"] == "Ann"
    assert len(checks) == 1
    assert len(result.metadata.inputFiles()) > 1


def test_archives_out_of_a_table_stay_in_pieces(spark):
    rows = [(f"p{k}", "1", f"d/p{k}@1.tgz", b"x") for k in range(40)]
    table = spark.createDataFrame(rows, "name string, version string, path string, content binary")
    wanted = table.select("name", "version").filter("name <> 'p3'").unionByName(
        spark.createDataFrame([("gone", "2")], "name string, version string")
    )
    opened = worker.out_of_table(table)(wanted)
    assert "Sort" not in plan_of(opened)
    found = {r["path"]: r["content"] for r in opened.collect()}
    assert found == {f"d/p{k}@1.tgz": b"x" for k in range(40) if k != 3} | {"downloads/gone@2.tgz": None}
    cores = spark.sparkContext.defaultParallelism
    assert opened.select(F.spark_partition_id()).distinct().count() > cores


def test_headers_of_a_held_archive_are_read_once(monkeypatch):
    opens, opened = [], tarfile.open
    monkeypatch.setattr(tarfile, "open", lambda **how: opens.append(1) or opened(**how))
    packed = tgz([("package/package.json", b"{}"), ("package/a.js", b"one"), ("package/b.js", "hard", "package/a.js")])
    opens.clear()
    members = lambda content: [(r[5], r[6], r[-1]) for r in unpack._members("d/a@1.tgz", content, None, 100)]
    found = members(packed)
    assert len(opens) == 1
    assert found == [
        ("package/package.json", "file", b"{}"), ("package/a.js", "file", b"one"), ("package/b.js", "hardlink", b"one"),
    ]
    # Of several gzip streams or with something behind them, contents are the same.
    plain = gzip.decompress(packed)
    assert members(gzip.compress(plain[:700]) + gzip.compress(plain[700:])) == found
    assert members(packed + b"\0" * 600) == found


def test_holes_of_a_sparse_member_are_filled():
    head = tarfile.TarInfo("package/holes.js")
    head.type, head.size = tarfile.GNUTYPE_SPARSE, 4
    head = bytearray(head.tobuf(tarfile.GNU_FORMAT))
    head[386:410], head[483:495] = b"00000000010\0" + b"00000000004\0", b"00000000014\0"
    head[148:156] = b" " * 8
    head[148:156] = b"%06o\0 " % sum(head)
    content = gzip.compress(bytes(head) + b"data".ljust(512, b"\0") + b"\0" * 1024)
    (row,) = unpack._members("d/a@1.tgz", content, None, 100)
    assert row[-1] == b"\0" * 8 + b"data"


def test_a_batch_of_messages_is_read_once(spark, work):
    reads = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(name):
        reads.add(1)
        return name

    rows = [("dropper", "3.1.0"), ("gone", "1")]
    batch = spark.createDataFrame(rows, "name string, version string").withColumn("rerun_reason", seen("name"))
    folder = write_archives(work)
    store = Store(spark, work + "/store")
    worker.analyse_batch(store, batch, 1, worker.downloaded(spark, folder), folder=work + "/shared", requeue=work + "/again")
    assert reads.value == 2
    again = [json.loads(line) for p in glob.glob(work + "/again/part-*") for line in open(p)]
    assert [(r["name"], r["attempts"], r["rerun_reason"]) for r in again] == [("gone", 1, "gone")]


def test_scores_are_computed_again_without_moving_details(spark, work):
    rows = [("n", f"{k // 3}", "yara_match", "high", f"f{k}.js", json.dumps({"i": k})) for k in range(30)]
    spark.createDataFrame(rows, SCHEMAS["findings"]).write.parquet(work + "/findings")
    found = spark.read.parquet(work + "/findings")
    scores = spark.createDataFrame([("n", str(k), 1, "clean") for k in range(10)], SCHEMAS["scores"])
    touched = scores.filter("version < '4'")
    again = signatures.rescore(found, scores, touched)
    assert {r["version"]: r["score"] for r in again.collect()} == {str(k): 21 if k < 4 else 1 for k in range(10)}
    # Nothing joins the findings before they are summed up.
    assert again._jdf.queryExecution().optimizedPlan().toString().count("LeftSemi") == 0


def test_added_findings_are_written_down_once(spark):
    rows = [("n", "1", "r", "high", "f.js", "{}")]
    base = spark.createDataFrame(rows, SCHEMAS["findings"])
    found = base.withColumn("rule", F.lit("yara_match"))
    kept = []
    keep = lambda added: kept.append(added) or added
    once = signatures.append_signature_findings(base, found, found.select("name", "version"), keep)
    twice = signatures.append_signature_findings(once, found, found.select("name", "version"), keep)
    assert sorted(r["rule"] for r in twice.collect()) == ["r", "yara_match"]
    assert [added.count() for added in kept] == [1, 0]
