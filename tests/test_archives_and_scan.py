from __future__ import annotations

import json
from pathlib import Path

import pytest
from archive_fixtures import ARCHIVES, write_archives

from tarsift.operators.user_rules import RuleSpec
from tarsift.plans.scan import scan_archives
from tarsift.plans.store import SCHEMAS, Store
from tarsift.sources import archives as ar


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def status_of(spark, folder, **kwargs):
    members = ar.read_archives(spark, folder, **kwargs)
    found = members.select("archive", "status").distinct().collect()
    return {r["archive"].rsplit("/", 1)[-1]: r["status"] for r in found}


def test_archive_status(spark, work):
    folder = write_archives(work)
    status = status_of(spark, folder)
    odd = {k: v for k, v in status.items() if v != "ok"}
    assert odd == {
        "escape@1.0.0.tgz": "path_traversal",
        "not-gzip@1.0.0.tgz": "unreadable",
        "cut@1.0.0.tgz": "unreadable",
        "empty@1.0.0.tgz": "unreadable",
    }
    assert set(status) == set(ARCHIVES)


def test_extraction_cap_and_spreading(spark, work):
    folder = write_archives(work)
    status = status_of(spark, folder, max_extract_bytes=50_000, large_bytes=10)
    assert status["big@1.0.0.tgz"] == "over_limit"
    assert status["plain@1.0.0.tgz"] == "ok"
    members = ar.read_archives(spark, folder, max_extract_bytes=50_000, large_bytes=10)
    over = members.filter("status = 'over_limit'")
    assert rows(over, "path", "content") == [(None, None)]
    assert rows(ar.extraction_limit_findings(members, 50_000), "name", "max_extract_bytes") == [
        ("big", 50_000)
    ]


def test_names_from_archive_names(spark, work):
    folder = write_archives(work)
    found = dict(rows(ar.read_archives(spark, folder).distinct(), "archive", "name"))
    by_file = {k.rsplit("/", 1)[-1]: v for k, v in found.items()}
    assert by_file["@s__p@2.0.0.tgz"] == "@s/p"
    assert by_file["noversion.tgz"] is None


def test_member_contents_survive(spark, work):
    members = ar.read_archives(spark, write_archives(work))
    got = rows(members.filter("name = 'big' and path like '%.js'"), "size", "content")
    assert got == [(60_000, bytearray(b"y" * 60_000))]


def test_manifest_choice(spark, work):
    members = ar.read_archives(spark, write_archives(work))
    picked = dict(rows(ar.pick_manifests(members), "name", "path"))
    assert picked["else"] == "alpha/package.json"
    assert picked["plain"] == "package/package.json"
    assert "bare" not in picked


@pytest.fixture(scope="module")
def result(spark, tmp_path_factory):
    """One scan of all fixture archives, with a user rule among the rules."""
    work = str(tmp_path_factory.mktemp("scan"))
    spec = RuleSpec("module_use", "low", r"module\.exports", weight=7)
    members = ar.read_archives(spark, write_archives(work))
    return scan_archives(members, folder=work + "/shared", rules=[spec])


def test_whole_scan(result):
    found = rows(result.findings, "name", "rule")
    of = lambda name: sorted(rule for n, rule in found if n == name)
    assert of("plain") == ["module_use"]
    assert of("@s/p") == ["has_bin", "suspicious_pattern", "suspicious_pattern", "url_outside_allowlist"]
    assert of("links") == ["symlink_escape", "symlink_escape"]
    # Without a manifest only the links and the missing manifest are reported.
    assert of("bare") == ["no_package_json", "symlink_escape"]
    assert of("void") == ["no_package_json"]
    assert of("broken-json") == []
    assert of("packing") == ["lockfile_present", "lockfile_present", "npmrc_present"]
    assert of("dropper") == [
        "env_snoop", "install_chain_risk", "install_persistence_risk", "lifecycle_script",
        "suspicious_pattern", "suspicious_pattern", "typosquat_detected", "url_outside_allowlist",
        "url_outside_allowlist", "writes_outside_pkg",
    ]
    scores = dict((r["name"], (r["score"], r["label"])) for r in result.scores.collect())
    assert scores["plain"] == (7, "suspicious")
    assert scores["broken-json"] == (0, "clean")
    assert scores["dropper"] == (4 + 10 + 10 + 4 + 2 + 2 + 8 + 6 + 6 + 6, "malicious")
    assert "escape" not in scores and "not-gzip" not in scores
    assert rows(result.rejects.na.fill(""), "name", "status") == [
        ("", "unnamed"), ("cut", "unreadable"), ("empty", "unreadable"),
        ("escape", "path_traversal"), ("not-gzip", "unreadable"),
    ]
    details = result.findings.filter("rule = 'writes_outside_pkg'").select("details").first()[0]
    assert json.loads(details)["path"] == "package/steal.js"
    assert dict(rows(result.metadata, "name", "author"))["@s/p"] == "Ann"


def test_one_archive_per_version(spark, work):
    folder = write_archives(work)
    other = Path(folder, "a-mirror")
    other.mkdir()
    (other / "links@1.0.0.tgz").write_bytes(ARCHIVES["dropper@3.1.0.tgz"])
    result = scan_archives(ar.read_archives(spark, folder), folder=work + "/shared")
    assert rows(result.findings.filter("name = 'links'"), "rule") == [("symlink_escape",)] * 2


def state(store):
    fill = lambda frame: frame.drop("last_seen", "created_at", "analyzed_at", "completed_at").na.fill("")
    return {t: sorted(map(str, fill(store.current(t)).collect())) for t in SCHEMAS}


def test_store_merges_are_repeatable(spark, work, result):
    store = Store(spark, work + "/store")
    store.merge_scan(1, result, source="test")
    before = rows(store.current("findings"), "name", "rule", "details")
    assert before == rows(result.findings, "name", "rule", "details")
    first = state(store)
    store.merge_scan(1, result, source="test")
    assert state(store) == first
    store.merge_scan(2, result, source="again")
    assert rows(store.current("findings"), "name", "rule", "details") == before
    assert store.current("versions").filter("status = 'analyzed'").count() == result.versions.count()
    assert store.history("scan_runs").count() == 2 * result.scores.count()
    runs = store.history("scan_runs").filter("name = 'links'")
    assert sorted(tuple(r) for r in runs.select("source", "high_count").collect()) == [
        ("again", 2), ("test", 2)
    ]
    assert store.history("scan_run_findings").count() == 2 * result.findings.count()
    # An older commit that comes again sees what it saw then, and stays older.
    later = state(store)
    store.merge_scan(1, result, source="test")
    assert state(store) == later


def test_a_merge_that_broke_off_shows_no_findings(spark, work, result, monkeypatch):
    store = Store(spark, work + "/store")
    write = Store._write
    broken = lambda self, commit, tables: write(self, commit, {t: f for t, f in tables.items() if t in ("packages", "findings")})
    monkeypatch.setattr(Store, "_write", broken)
    store.merge_scan(1, result)
    assert store.current("findings").count() == 0 and store.current("scores").count() == 0
    monkeypatch.setattr(Store, "_write", write)
    store.merge_scan(1, result)
    assert store.current("findings").count() == result.findings.count()


def test_store_forgets_findings_that_are_gone(spark, work, result):
    store = Store(spark, work + "/store")
    store.merge_scan(1, result)
    nothing = result.findings.limit(0)
    clean = type(result)(result.versions, nothing, result.scores, result.metadata, result.rejects)
    store.merge_scan(2, clean)
    assert store.current("findings").count() == 0


def test_store_keeps_other_versions(spark, work, result):
    store = Store(spark, work + "/store")
    store.merge_scan(1, result)
    part = result.versions.filter("name = 'links'")
    only = type(result)(
        part,
        result.findings.filter("name = 'links'").limit(1),
        result.scores.filter("name = 'links'"),
        result.metadata,
        result.rejects,
    )
    store.merge_scan(2, only)
    now = rows(store.current("findings"), "name", "rule")
    assert [r for r in now if r[0] != "links"] == [
        r for r in rows(result.findings, "name", "rule") if r[0] != "links"
    ]
    assert len([r for r in now if r[0] == "links"]) == 1


def test_a_commit_writes_its_own_rows(spark, work, result):
    store = Store(spark, work + "/store")
    store.merge_scan(1, result)
    part = result.versions.filter("name = 'links'")
    only = type(result)(
        part, result.findings.filter("name = 'links'").limit(1), result.scores.filter("name = 'links'"),
        result.metadata, result.rejects.limit(0),
    )
    files = {p for p in Path(work, "store").rglob("*.parquet")}
    store.merge_scan(2, only)
    assert files <= {p for p in Path(work, "store").rglob("*.parquet")}
    added = spark.read.parquet(work + "/store/versions/commit=2")
    assert [r["name"] for r in added.collect()] == ["links"]


def test_rejects_are_stored(spark, work, result):
    store = Store(spark, work + "/store")
    store.merge_scan(1, result)
    shown = rows(store.history("rejects").na.fill(""), "name", "status")
    assert shown == rows(result.rejects.na.fill(""), "name", "status")


def test_members_as_extracted(spark):
    """Links have the content of what they lead to; the last member of a path counts."""
    import io
    import tarfile

    buffer = io.BytesIO()
    with tarfile.open(fileobj=buffer, mode="w:gz") as tar:
        def add(name, data=b"", kind=tarfile.REGTYPE, target=""):
            info = tarfile.TarInfo(name)
            info.type, info.linkname, info.size = kind, target, len(data)
            tar.addfile(info, io.BytesIO(data))

        add("package/package.json", b"{}")
        add("package/a.js", b"first")
        add("package/early.js", kind=tarfile.LNKTYPE, target="package/a.js")
        add("package/a.js", b"second")
        add("package/late.js", kind=tarfile.LNKTYPE, target="package/a.js")
        add("package/lib/soft.js", kind=tarfile.SYMTYPE, target="../loop.js")
        add("package/loop.js", kind=tarfile.SYMTYPE, target="./a.js")
        add("package/self.js", kind=tarfile.SYMTYPE, target="self.js")
        add("package/out.js", kind=tarfile.SYMTYPE, target="../../x")
        add("package/gone.js", kind=tarfile.SYMTYPE, target="a.js")
        add("package/gone.js", b"own")
    frame = spark.createDataFrame([("d/p@1.tgz", buffer.getvalue())], "path string, content binary")
    found = ar.extract_members(frame).collect()
    shown = sorted((r["path"], r["kind"], bytes(r["content"]).decode() if r["content"] is not None else None) for r in found)
    assert shown == [
        ("package/a.js", "file", "second"), ("package/a.js", "superseded", None),
        ("package/early.js", "hardlink", "first"), ("package/gone.js", "file", "own"),
        ("package/gone.js", "symlink", None), ("package/late.js", "hardlink", "second"),
        ("package/lib/soft.js", "symlink", "second"), ("package/loop.js", "symlink", "second"),
        ("package/out.js", "symlink", None), ("package/package.json", "file", "{}"), ("package/self.js", "symlink", None),
    ]
    assert sorted({r["ordinal"] for r in found}) == list(range(11))
