"""Queries for sources, queue building, merges and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Row
from pyspark.sql import functions as F

from tarsift.catalog.content import _TECHNIQUES
from tarsift.catalog.packing import BASE_SQL, archives
from tarsift.catalog.registry import query, stamp
from tarsift.catalog.reports import sql, tables
from tarsift.config import ScanConfig
from tarsift.functions.timestamps import parse_timestamp
from tarsift.operators import queue_building as qb
from tarsift.plans import merge
from tarsift.plans.scan import ScanResult, scan_archives, written
from tarsift.plans.store import Store
from tarsift.session import checkpoint_folder
from tarsift.sources import archives as ar
from tarsift.sources import queue as qs
from tarsift.sources.feed import stream_feed
from tarsift.sources.findings_io import finding_documents, read_documents, write_documents
from tarsift.streaming import worker
from tarsift.views import table, view, view_sql

c, lit = F.col, F.lit
KEYS = ["name", "version"]


def scratch(spark, label: str) -> str:
    """A new folder under the shared one; under the warehouse where none is named."""
    shared = checkpoint_folder(spark, spark.conf.get("spark.sql.warehouse.dir"))
    return f"{shared}/tarsift-queries/{label}-{uuid.uuid4().hex}"


def members(spark, folder, limit=None):
    return ar.extract_members(archives(spark, folder), limit)


# --- archives ---------------------------------------------------------------------------


@query(
    "s1_archive_members",
    f"""WITH {BASE_SQL} SELECT archive, name, version, path, kind, coalesce(strlen(content), 0) AS size, linkname, md5(content) AS digest FROM o""",
)
def s1(spark, folder):
    return members(spark, folder).filter("status = 'ok'").select(
        "archive", *KEYS, "path", "kind", "size", "linkname", F.md5("content").alias("digest")
    )


@query(
    "s2_rejected_archives",
    f"WITH {BASE_SQL} SELECT archive, name, version, CASE k WHEN 2 THEN 'path_traversal' ELSE 'unreadable' END AS status FROM a WHERE k IN (2, 6)",
)
def s2(spark, folder):
    return ar.rejected_archives(members(spark, folder))


@query(
    "s3_extraction_limit",
    f"""WITH {BASE_SQL} SELECT name, version, 'extraction_limit_exceeded' AS rule, 'low' AS severity, archive AS path, 3000 AS max_extract_bytes
 FROM m WHERE kind = 'file' GROUP BY name, version, archive HAVING sum(strlen(content)) + CASE WHEN any_value(k) = 0 THEN 12 ELSE 0 END > 3000""",
)
def s3(spark, folder):
    return ar.extraction_limit_findings(members(spark, folder, 3000), 3000).drop("explanation")


@query(
    "s4_symlink_escape",
    f"WITH {BASE_SQL} SELECT name, version, 'high' AS severity, path AS entry, linkname AS target FROM o WHERE linkname LIKE '/%' OR linkname LIKE '%..%'",
)
def s4(spark, folder):
    return ar.symlink_escapes(members(spark, folder)).drop("rule")


@query(
    "s5_archive_names",
    "SELECT doc_id, replace(regexp_extract(f, '^(.*)@[^@]*$', 1), '__', '/') AS name, regexp_extract(f, '@([^@]*)$', 1) AS version "
    "FROM (SELECT doc_id, concat('@', source, '__', lang, '@', doc_id, '.0.1') AS f FROM documents) q",
)
def s5(spark, folder):
    file_name = F.concat(lit("d/@"), "source", lit("__"), "lang", lit("@"), "doc_id", lit(".0.1.tgz"))
    name, version = ar.name_and_version(file_name)
    return table(spark, folder, "documents").select("doc_id", name.alias("name"), version.alias("version"))


@query(
    "s6_manifest_pick",
    f"WITH {BASE_SQL} SELECT name, version, min(path) AS path, any_value(content) AS manifest FROM o WHERE path LIKE '%/package.json' AND kind = 'file' GROUP BY name, version",
)
def s6(spark, folder):
    return ar.pick_manifests(members(spark, folder))


@query(
    "s6_no_package_json",
    f"WITH {BASE_SQL} SELECT name, version, 'no_package_json' AS rule, 'low' AS severity FROM a WHERE k = 3",
)
def s6_none(spark, folder):
    return ar.no_manifest_findings(members(spark, folder))


_SCAN_SQL = f"""WITH {BASE_SQL},
t AS (SELECT name, version, {_TECHNIQUES} AS techniques FROM o WHERE k <> 3 AND path LIKE '%.js' AND strlen(content) > 1000),
w AS (
  SELECT name, version, 'advanced_obfuscation' AS rule, CASE WHEN len(techniques) >= 3 THEN 5 ELSE 3 END AS weight FROM t WHERE len(techniques) > 0
  UNION ALL SELECT name, version, 'minified_long_lines', 2 FROM o WHERE k <> 3 AND path LIKE '%.js'
    AND list_contains(list_transform(string_split(content, chr(10)), lambda l: strlen(l) >= 4000), true)
  UNION ALL SELECT name, version, 'npmrc_present', 4 FROM a WHERE k = 5
  UNION ALL SELECT name, version, 'lockfile_present', 1 FROM a WHERE k = 5
  UNION ALL SELECT name, version, 'symlink_escape', 0 FROM a, range(3) WHERE k = 1
  UNION ALL SELECT name, version, 'no_package_json', 0 FROM a WHERE k = 3),
s AS (SELECT a.name, a.version, CAST(coalesce(sum(weight), 0) AS INT) AS score, count(rule) AS findings
      FROM a LEFT JOIN w ON a.name = w.name AND a.version = w.version WHERE k NOT IN (2, 6) GROUP BY a.name, a.version)
SELECT name, version, score, findings, CASE WHEN score >= 12 THEN 'malicious' WHEN score >= 7 THEN 'suspicious' ELSE 'clean' END AS label FROM s"""


def _scored(scores, findings):
    counts = findings.groupBy(*KEYS).agg(F.count("*").alias("findings"))
    return scores.join(counts, KEYS, "left").select(
        *KEYS, "score", F.coalesce("findings", lit(0)).alias("findings"), "label"
    )


@query("e1_batch_scan", _SCAN_SQL)
def e1(spark, folder):
    """The whole batch job: archives to scores."""
    result = scan_archives(members(spark, folder), folder=scratch(spark, "e1"))
    return _scored(result.scores, result.findings)


@query(
    "s17_checksums",
    """SELECT concat('p', doc_id) AS name, '1' AS version, CASE doc_id % 3 WHEN 2 THEN false ELSE true END AS checksum_ok FROM documents""",
)
def s17(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", c("text").cast("binary").alias("content"))
    stored = docs.select(F.concat(lit("d/p"), "doc_id", lit("@1.tgz")).alias("path"), "content")
    shasum = F.when(c("doc_id") % 3 == 0, F.upper(F.sha1("content"))).when(c("doc_id") % 3 == 2, lit("00"))
    queued = docs.select(F.concat(lit("p"), "doc_id").alias("name"), lit("1").alias("version"), shasum.alias("shasum"))
    return ar.verify_checksums(stored, queued).select(*KEYS, "checksum_ok")


@query(
    "s17_checksum_mismatches",
    "SELECT concat('p', doc_id) AS name, '1' AS version, '00' AS shasum FROM documents WHERE doc_id % 3 = 2",
)
def s17_bad(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", c("text").cast("binary").alias("content"))
    stored = docs.select(F.concat(lit("d/p"), "doc_id", lit("@1.tgz")).alias("path"), "content")
    shasum = F.when(c("doc_id") % 3 == 0, F.sha1("content")).when(c("doc_id") % 3 == 2, lit("00"))
    queued = docs.select(F.concat(lit("p"), "doc_id").alias("name"), lit("1").alias("version"), shasum.alias("shasum"))
    return ar.checksum_mismatches(ar.verify_checksums(stored, queued)).drop("sha1")


@query(
    "s18_storage_keys",
    view_sql(
        "names",
        tail="SELECT s_suppkey, concat('npm-raw-tarballs/', name, '/1.0.', s_suppkey, '.tgz') AS storage_key, "
        "concat(replace(name, '/', '__'), '@1.0.', s_suppkey, '.tgz') AS file_name FROM names",
    ),
)
def s18(spark, folder):
    version = F.concat(lit("1.0."), c("s_suppkey"))
    return view(spark, folder, "names").select(
        "s_suppkey",
        ar.storage_key(c("name"), version).alias("storage_key"),
        ar.archive_name(c("name"), version).alias("file_name"),
    )


# --- queue, seeds, documents, feeds -----------------------------------------------------


def queue_records(spark, folder):
    return view(spark, folder, "queue").select(
        *KEYS, F.date_format("queued_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("queued_at"), "source"
    )


@query(
    "s8_queue_read",
    view_sql("queue", tail="SELECT name, version, source, count(*) AS messages FROM queue GROUP BY name, version, source"),
)
def s8(spark, folder):
    path = scratch(spark, "s8")
    qs.write_queue(queue_records(spark, folder), path)
    spark.createDataFrame([("",), ("  ",)], "value string").write.mode("append").text(path)
    return qs.read_queue(spark, path).groupBy(*KEYS, "source").agg(F.count("*").alias("messages"))


@query(
    "s13_queue_append",
    view_sql("queue", tail="SELECT source, 2 * count(*) AS messages FROM queue GROUP BY source"),
)
def s13(spark, folder):
    path = scratch(spark, "s13")
    for _ in range(2):
        qs.write_queue(queue_records(spark, folder), path)
    return qs.read_queue(spark, path).groupBy("source").agg(F.count("*").alias("messages"))


@query(
    "s9_seeds",
    "SELECT DISTINCT name FROM (SELECT c_name AS name FROM customer UNION ALL SELECT 'lodash' UNION ALL SELECT 'left pad') s",
)
def s9(spark, folder):
    path = scratch(spark, "s9")
    lines = table(spark, folder, "customer").select(F.concat(lit("  "), "c_name", lit("\t")).alias("value"))
    lines.unionByName(lines).unionByName(lines.select(lit(" ").alias("value"))).write.text(path)
    return qs.parse_seeds(spark, " lodash, ,left pad,lodash", path)


@query(
    "s10_registry_documents",
    "SELECT concat('lib-', p_partkey) AS name, CASE WHEN p_partkey % 10 <> 0 THEN concat(p_size, '.1.0') END AS latest, "
    "2 AS versions, concat('2024-01-', CASE p_partkey % 3 WHEN 0 THEN '05' WHEN 1 THEN '15' ELSE '25' END, 'T00:00:00.000Z') AS modified FROM part",
)
def s10(spark, folder):
    docs = qs.parse_documents(view(spark, folder, "registry_docs"))
    return docs.select(
        "name",
        F.try_element_at("dist_tags", lit("latest")).alias("latest"),
        F.size("versions").alias("versions"),
        F.try_element_at("time", lit("modified")).alias("modified"),
    )


@query(
    "s11_change_feed",
    view_sql("changes", tail="SELECT id AS name, count(*) AS changes FROM changes WHERE NOT deleted GROUP BY id"),
)
def s11(spark, folder):
    live = qs.live_changes(view(spark, folder, "changes"))
    return live.groupBy("name").agg(F.count("*").alias("changes"))


@query(
    "s12_package_listing",
    view_sql("listing", tail="SELECT coalesce(id, key) AS name FROM listing WHERE coalesce(id, key) NOT LIKE '^_design/%' ESCAPE '^'"),
)
def s12(spark, folder):
    return qs.listed_names(view(spark, folder, "listing"))


@query(
    "s16_findings_sink",
    sql("SELECT severity, count(*) AS findings FROM findings GROUP BY severity"),
)
def s16(spark, folder):
    path = scratch(spark, "s16")
    write_documents(finding_documents(tables(spark, folder).findings), path)
    found = read_documents(spark, path).select(F.explode("findings").alias("f"))
    return found.groupBy("f.severity").agg(F.count("*").alias("findings"))


# --- queue building ---------------------------------------------------------------------

LATEST = """latest AS (SELECT p_partkey, concat('lib-', p_partkey) AS name, concat(p_size, '.1.0') AS version,
  concat('https://r.example/lib-', p_partkey, '.tgz') AS tarball, concat('sha512-', p_partkey * 31) AS integrity, CAST(NULL AS VARCHAR) AS shasum,
  '2023-12-31T10:00:00.000Z' AS published_at,
  concat('2024-01-', CASE p_partkey % 3 WHEN 0 THEN '05' WHEN 1 THEN '15' ELSE '25' END, 'T00:00:00.000Z') AS meta_head
  FROM part WHERE p_partkey % 10 NOT IN (0, 1)),
done AS (SELECT concat('lib-', p_partkey) AS name, concat(p_size, '.1.0') AS version FROM part WHERE p_partkey % 4 = 0),
changed AS (SELECT DISTINCT concat('lib-', user_id) AS name FROM events WHERE event_type <> 'error')"""


def documents(spark, folder):
    return qs.parse_documents(view(spark, folder, "registry_docs"))


def stored_versions(spark, folder):
    """Versions already known: analysed by part key, the others queued."""
    part = table(spark, folder, "part").filter(c("p_partkey") % 2 == 0)
    text = lambda v: lit(v).cast("string")
    return part.select(
        F.concat(lit("lib-"), "p_partkey").alias("name"),
        F.concat("p_size", lit(".1.0")).alias("version"),
        text("https://old.example").alias("tarball_url"),
        text(None).alias("integrity"),
        text("aa").alias("shasum"),
        lit(None).cast("timestamp").alias("published_at"),
        lit(None).cast("timestamp").alias("analyzed_at"),
        F.when(c("p_partkey") % 4 == 0, "analyzed").otherwise("queued").alias("status"),
    )


@query("q1_latest_versions", f"WITH {LATEST} SELECT name, version, tarball, integrity, shasum, published_at, meta_head FROM latest")
def q1(spark, folder):
    return qb.latest_versions(documents(spark, folder))


@query(
    "q2_live_changes",
    view_sql("changes", tail="SELECT DISTINCT id AS name FROM changes WHERE NOT deleted"),
)
def q2(spark, folder):
    return qs.live_changes(view(spark, folder, "changes")).distinct()


@query(
    "q3_listed_names",
    view_sql("listing", tail="SELECT count(*) AS names, count(DISTINCT coalesce(id, key)) AS distinct_names FROM listing WHERE NOT starts_with(coalesce(id, key), '_design/')"),
)
def q3(spark, folder):
    names = qs.listed_names(view(spark, folder, "listing"))
    return names.agg(F.count("*").alias("names"), F.countDistinct("name").alias("distinct_names"))


@query(
    "q4_skip_analyzed",
    f"WITH {LATEST} SELECT name, version FROM latest l WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.name = l.name AND d.version = l.version)",
)
def q4(spark, folder):
    fresh = qb.skip_analyzed(qb.latest_versions(documents(spark, folder)), stored_versions(spark, folder))
    return fresh.select(*KEYS)


@query(
    "q5_queue_from_feeds",
    f"""WITH {LATEST} SELECT l.name, l.version, CASE WHEN l.name IN (SELECT name FROM changed) THEN 'changes' ELSE 'listing' END AS origin
 FROM latest l WHERE (l.name IN (SELECT name FROM changed) OR p_partkey % 200 <> 7 OR p_partkey % 2 = 0)
 AND NOT EXISTS (SELECT 1 FROM done d WHERE d.name = l.name AND d.version = l.version)""",
)
def q5(spark, folder):
    queued = qb.build_queue(
        documents(spark, folder),
        stored_versions(spark, folder),
        changes=qs.live_changes(view(spark, folder, "changes")),
        listing=qs.listed_names(view(spark, folder, "listing")),
    )
    return queued.select(*KEYS, "origin")


@query(
    "q5_queue_from_seeds",
    f"WITH {LATEST} SELECT name, version, 'seeds' AS origin FROM latest WHERE name IN (SELECT concat('lib-', s_suppkey) FROM supplier)",
)
def q5_seeds(spark, folder):
    seeds = table(spark, folder, "supplier").select(F.concat(lit("lib-"), "s_suppkey").alias("name"))
    queued = qb.build_queue(
        documents(spark, folder),
        stored_versions(spark, folder),
        seeds=seeds.unionByName(seeds),
        listing=qs.listed_names(view(spark, folder, "listing")),
    )
    return queued.select(*KEYS, "origin")


@query(
    "q6_recency_window",
    "SELECT concat('lib-', p_partkey) AS name FROM part WHERE p_partkey % 3 <> 0",
)
def q6(spark, folder):
    as_of = lit("2024-01-20").cast("timestamp")
    return qb.touched_since(documents(spark, folder), as_of, 10).select("name")


@query(
    "q7_keyset_page",
    "SELECT DISTINCT id AS name FROM (" + view_sql("listing", tail="SELECT coalesce(id, key) AS id FROM listing") +
    ") l WHERE NOT starts_with(id, '_design/') AND id > 'lib-15' ORDER BY id LIMIT 60",
)
def q7(spark, folder):
    return qb.next_page(qs.listed_names(view(spark, folder, "listing")), "lib-15", 20, 3)


@query(
    "q8_resume_state",
    f"""WITH {LATEST}, page AS (SELECT DISTINCT id AS name FROM ({view_sql("listing", tail="SELECT coalesce(id, key) AS id FROM listing")}) l
   WHERE NOT starts_with(id, '_design/') AND id > 'lib-15' ORDER BY id LIMIT 60)
 SELECT '7' AS last_seq, CASE WHEN count(*) >= 60 THEN max(name) END AS last_startkey, '2024-01-20 00:00:00' AS last_run,
  (SELECT count(*) FROM latest WHERE name IN (SELECT name FROM page)) AS last_processed,
  (SELECT count(*) FROM latest WHERE name IN (SELECT name FROM page)) AS last_new FROM page""",
)
def q8(spark, folder):
    state = spark.createDataFrame([("7", "lib-15")], "last_seq string, last_startkey string")
    page = qb.next_page(qs.listed_names(view(spark, folder, "listing")), qb.resume_cursor(state), 20, 3)
    queued = qb.build_queue(documents(spark, folder), listing=page)
    run_at = lit("2024-01-20").cast("timestamp")
    following = qb.next_state(state, page, 20, 3, run_at, queued)
    return following.withColumn("last_run", stamp(c("last_run")))


@query(
    "q9_upsert_queued",
    f"""WITH {LATEST}, known AS (SELECT concat('lib-', p_partkey) AS name, concat(p_size, '.1.0') AS version, p_partkey FROM part WHERE p_partkey % 2 = 0)
 SELECT coalesce(k.name, l.name) AS name, coalesce(k.version, l.version) AS version,
  CASE WHEN l.name IS NOT NULL THEN l.tarball ELSE 'https://old.example' END AS tarball_url, l.integrity,
  CASE WHEN l.name IS NULL THEN 'aa' END AS shasum, CASE WHEN l.name IS NOT NULL THEN '2023-12-31 10:00:00' END AS published_at,
  CASE WHEN k.p_partkey % 4 = 0 THEN 'analyzed' ELSE 'queued' END AS status
 FROM known k FULL JOIN latest l ON k.name = l.name AND k.version = l.version""",
)
def q9(spark, folder):
    records = qb.latest_versions(documents(spark, folder)).withColumn("queued_at", lit("2024-01-02T00:00:00Z"))
    # Queued twice before, with other facts: the record queued last counts.
    earlier = records.withColumns({"queued_at": lit("2024-01-01T00:00:00Z"), "tarball": lit("a"), "shasum": lit("ff")})
    unknown = records.withColumns({"queued_at": lit(None).cast("string"), "integrity": lit("zz")})
    merged = qb.upsert_queued(
        stored_versions(spark, folder), earlier.unionByName(records).unionByName(unknown)
    )
    return merged.withColumn("published_at", stamp(c("published_at"))).drop("analyzed_at")


@query(
    "q10_enrichment",
    f"WITH {LATEST} SELECT name, version, '2024-01-20 00:00:00' AS queued_at, 'enumerator' AS source, '2024-01-21 00:00:00' AS fetched_at FROM latest",
)
def q10(spark, folder):
    day = lambda d: lit(f"2024-01-{d}").cast("timestamp")
    records = qb.enrich(qb.latest_versions(documents(spark, folder)), "enumerator", day(20))
    fetched = qb.mark_fetched(records, day(21))
    return fetched.select(
        *KEYS, stamp(c("queued_at")).alias("queued_at"), "source", stamp(c("fetched_at")).alias("fetched_at")
    )


@query("q11_run_counters", f"WITH {LATEST} SELECT count(*) AS last_processed, count(*) AS last_new FROM latest")
def q11(spark, folder):
    """Counted while the queue is written, in the same pass."""
    queue, counters = qb.observed(qb.latest_versions(documents(spark, folder)))
    queue.write.json(scratch(spark, "q11"))
    return spark.createDataFrame([Row(**counters.get)], "last_processed bigint, last_new bigint")


# --- merges -----------------------------------------------------------------------------

MOMENT = "2024-02-01 00:00:00"
AT = lambda: lit(MOMENT).cast("timestamp")


@query(
    "u1_upsert_packages",
    sql(
        f"""SELECT p.name, p.ecosystem, coalesce(s.a, p.author) AS author, p.description, p.dependents,
 CASE WHEN s.name IS NOT NULL THEN '{MOMENT}' ELSE '2001-08-01 00:00:00' END AS last_seen, '1999-01-01 00:00:00' AS created_at
 FROM packages p LEFT JOIN (SELECT name, max(CASE WHEN status = 'queued' THEN 'New Author' END) AS a FROM versions GROUP BY name) s ON p.name = s.name
 UNION ALL SELECT DISTINCT concat(name, '-new'), 'npm', NULL, 'fresh', NULL, '{MOMENT}', '{MOMENT}' FROM versions"""
    ),
)
def u1(spark, folder):
    t = tables(spark, folder)
    text = lambda v: lit(v).cast("string")
    known = t.versions.select(
        *KEYS,
        F.when(c("status") == "queued", " New Author ").otherwise("").alias("author"),
        text(None).alias("description"),
    )
    new = t.versions.select(
        F.concat("name", lit("-new")).alias("name"), "version", text(None).alias("author"),
        text("fresh\x00").alias("description"),
    )
    stored = t.packages.withColumn("created_at", lit("1999-01-01 00:00:00").cast("timestamp"))
    merged = merge.upsert_packages(stored, known.unionByName(new), AT())
    return merged.withColumns({"last_seen": stamp(c("last_seen")), "created_at": stamp(c("created_at"))})


@query(
    "u2_upsert_versions",
    sql(
        f"""SELECT name, version, CASE WHEN status = 'queued' THEN '{MOMENT}' ELSE strftime(analyzed_at, '%Y-%m-%d %H:%M:%S') END AS analyzed_at,
 'analyzed' AS status FROM versions
 UNION ALL SELECT name, concat(version, '-b'), '{MOMENT}', 'analyzed' FROM versions WHERE status = 'queued'"""
    ),
)
def u2(spark, folder):
    versions = view(spark, folder, "versions")
    queued = versions.filter("status = 'queued'").select(*KEYS)
    new = queued.withColumn("version", F.concat("version", lit("-b")))
    merged = merge.upsert_versions(versions, queued.unionByName(new), AT())
    return merged.withColumn("analyzed_at", stamp(c("analyzed_at")))


@query(
    "u3_replace_findings",
    sql(
        """SELECT f.name, f.version, f.rule, count(*) AS findings FROM findings f JOIN versions v ON f.name = v.name AND f.version = v.version
 WHERE v.status = 'analyzed' GROUP BY f.name, f.version, f.rule
 UNION ALL SELECT name, version, 'has_bin', 1 FROM versions WHERE status = 'queued'"""
    ),
)
def u3(spark, folder):
    """Every queued version is scanned again and now has one finding."""
    t = tables(spark, folder)
    scanned = t.versions.filter("status = 'queued'").select(*KEYS)
    fresh = scanned.select(
        *KEYS, lit("has_bin").alias("rule"), lit("low").alias("severity"),
        lit(None).cast("string").alias("file_path"), lit("{}").alias("details"),
    )
    merged = merge.replace_findings(t.findings, fresh, scanned)
    return merged.groupBy(*KEYS, "rule").agg(F.count("*").alias("findings"))


@query(
    "u4_upsert_scores",
    sql(
        """SELECT s.name, s.version, CASE WHEN v.status = 'queued' THEN 1 ELSE s.score END AS score,
 CASE WHEN v.status = 'queued' THEN 'clean' ELSE s.label END AS label FROM scores s JOIN versions v ON s.name = v.name AND s.version = v.version"""
    ),
)
def u4(spark, folder):
    t = tables(spark, folder)
    fresh = t.versions.filter("status = 'queued'").select(*KEYS, lit(1).alias("score"), lit("clean").alias("label"))
    return merge.upsert_scores(t.scores, fresh)


@query(
    "u5_run_history",
    sql(
        f"""SELECT s.name, s.version, 'batch' AS source, '{MOMENT}' AS completed_at, s.score, s.label,
 CAST(count(f.rule) FILTER (f.severity = 'high') AS INT) AS high_count, CAST(count(f.rule) FILTER (f.severity = 'medium') AS INT) AS medium_count,
 CAST(count(f.rule) FILTER (f.severity = 'low') AS INT) AS low_count
 FROM scores s LEFT JOIN findings f ON s.name = f.name AND s.version = f.version GROUP BY s.name, s.version, s.score, s.label"""
    ),
)
def u5(spark, folder):
    t = tables(spark, folder)
    runs = merge.scan_run_rows(t.scores, t.findings, AT(), source="batch")
    return runs.select(
        *KEYS, "source", stamp(c("completed_at")).alias("completed_at"), "score", "label",
        "high_count", "medium_count", "low_count",
    )


@query(
    "u6_timestamps",
    """SELECT event_id, CASE event_id % 3 WHEN 2 THEN NULL ELSE strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') END AS parsed FROM events""",
)
def u6(spark, folder):
    ts = c("ts").cast("timestamp")
    raw = (
        F.when(c("event_id") % 3 == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
        .when(c("event_id") % 3 == 1, F.unix_timestamp(ts).cast("string"))
        .otherwise(F.concat(lit("at "), "event_type"))
    )
    return table(spark, folder, "events").select("event_id", stamp(parse_timestamp(raw)).alias("parsed"))


@query(
    "u7_nul_stripping",
    "SELECT doc_id, concat(source, lang) AS rule, concat('{\"a\":\"', source, lang, '\"}') AS details FROM documents",
)
def u7(spark, folder):
    docs = table(spark, folder, "documents")
    dirty = F.concat("source", lit("\x00"), "lang", lit("\x00"))
    rows = docs.select(
        "doc_id", dirty.alias("rule"), F.to_json(F.struct(dirty.alias("a"))).alias("details")
    )
    return merge.sanitized(rows.withColumn("doc_id", c("doc_id").cast("string"))).withColumn(
        "doc_id", c("doc_id").cast("bigint")
    )


@query(
    "u8_zero_finding_versions",
    sql(
        """SELECT s.name, s.version, s.score, s.label FROM scores s
 WHERE NOT EXISTS (SELECT 1 FROM findings f WHERE f.name = s.name AND f.version = s.version)"""
    ),
)
def u8(spark, folder):
    from tarsift.operators.scoring import score_versions

    t = tables(spark, folder)
    scored = score_versions(t.findings, versions=t.versions)
    return scored.join(t.findings.select(*KEYS).distinct(), KEYS, "left_anti")


@query(
    "u_store_merge",
    sql(
        """SELECT v.name, v.version, s.score, s.label, 'analyzed' AS status, count(f.rule) AS findings
 FROM versions v JOIN scores s ON v.name = s.name AND v.version = s.version LEFT JOIN findings f ON v.name = f.name AND v.version = f.version
 GROUP BY v.name, v.version, s.score, s.label"""
    ),
)
def u_store(spark, folder):
    """All versions in overlapping commits, one of them delivered twice; read back."""
    # Tables, as a scan leaves them: each is derived once.
    derived = tables(spark, folder)
    stored = lambda df: written(df, "input", scratch(spark, "store-input"))
    parted = lambda df: df.withColumn("part", F.pmod(F.xxhash64(*KEYS), lit(4)))
    all_versions = stored(parted(derived.versions.select(*KEYS).distinct()))
    all_findings, all_scores = stored(parted(derived.findings)), stored(parted(derived.scores))
    store = Store(spark, scratch(spark, "store"))

    def scan(share: str, findings=all_findings, scores=all_scores) -> ScanResult:
        versions = all_versions.filter(share).select(*KEYS)
        none = versions.select(*KEYS, *[lit(None).cast("string").alias(a) for a in ("author", "description")])
        rejects = versions.select(lit("d/x").alias("archive"), *KEYS, lit("unreadable").alias("status")).limit(0)
        # Rows of a version have its part, so a scan's own rows need no join; without their
        # version they would never be read back.
        of = lambda df: df.filter(share).drop("part")
        return ScanResult(versions, of(findings), of(scores), none, rejects)

    nothing, wrong = all_findings.limit(0), all_scores.withColumn("score", lit(-1))
    store.merge_scan(1, scan("part <= 2", nothing, wrong), AT())
    store.merge_scan(2, scan("part <= 1"), AT())
    # What a first try of a commit left is replaced.
    store.merge_scan(3, scan("part >= 0", nothing, wrong), AT())
    store.merge_scan(3, scan("part >= 2"), AT())
    store.merge_scan(2, scan("part <= 1"), AT())
    counts = store.current("findings").groupBy(*KEYS).agg(F.count("*").alias("findings"))
    versions = store.current("versions").join(store.current("scores"), KEYS).join(counts, KEYS, "left")
    return versions.select(*KEYS, "score", "label", "status", F.coalesce("findings", lit(0)).alias("findings"))


# --- streams ----------------------------------------------------------------------------


def landed_queue(spark, folder, label: str) -> str:
    """Queue messages as JSON files, in four slices."""
    path = scratch(spark, label)
    queue_records(spark, folder).repartition(4, "name").write.json(path)
    return path


def worked_queue(spark, folder):
    """A worker's store after two deliveries of all archives' messages and of missing ones; and
    where messages went that are queued again."""
    packed = archives(spark, folder)
    name, version = ar.name_and_version(c("path"))
    stored = scratch(spark, "archives")
    packed.select(name.alias("name"), version.alias("version"), "path", "content").write.parquet(stored)
    table_of = spark.read.parquet(stored)
    landed, retried = scratch(spark, "messages"), scratch(spark, "retried")
    messages = table_of.select(
        *KEYS, lit("2024-01-01T00:00:00Z").alias("queued_at"), F.concat(lit("asked for "), "name").alias("rerun_reason")
    )
    missing = messages.filter("name LIKE '%5'").withColumn("version", lit("9.9.9"))
    # Two batches, and a third one with what is known already.
    messages.unionByName(missing).repartition(2).write.json(landed)
    store = Store(spark, scratch(spark, "worker-store"))
    found = worker.out_of_table(table_of)
    state, shared = scratch(spark, "worker-state"), scratch(spark, "worker-shared")
    for _ in range(2):
        stream = qs.stream_queue(spark, landed, files_per_batch=1)
        worker.run_available(worker.analyse_worker(stream, store, found, state, folder=shared, requeue=retried))
        messages.repartition(1).write.mode("append").json(landed)
    return store, retried


@query("st1_analyse_worker", _SCAN_SQL)
def st1(spark, folder):
    """The queue worker over all archives: the same result as the batch scan."""
    store, _ = worked_queue(spark, folder)
    return _scored(store.current("scores"), store.current("findings"))


@query(
    "st1_rejects",
    f"WITH {BASE_SQL} SELECT DISTINCT archive, name, version, CASE k WHEN 2 THEN 'path_traversal' ELSE 'unreadable' END AS status, CAST(NULL AS INT) AS attempts FROM a WHERE k IN (2, 6) "
    "UNION ALL SELECT concat('downloads/', replace(name, '/', '__'), '@9.9.9.tgz'), name, '9.9.9', 'missing', 1 FROM a WHERE name LIKE '%5'",
)
def st1_rejects(spark, folder):
    """What the worker could not scan: stored, and missing archives queued again."""
    store, retried = worked_queue(spark, folder)
    again = qs.read_queue(spark, retried).groupBy(*KEYS).agg(F.max("attempts").alias("attempts"))
    rejects = store.history("rejects").drop("completed_at").distinct()
    return rejects.join(again, KEYS, "left").select("archive", *KEYS, "status", "attempts")


@query(
    "st1_run_details",
    f"WITH {BASE_SQL} SELECT name, version, 'queue' AS source, '2024-01-01 00:00:00' AS queued_at, concat('asked for ', name) AS rerun_reason, true AS complete FROM a WHERE k NOT IN (2, 6)",
)
def st1_run_details(spark, folder):
    """What a message said stands in the history of its run."""
    store, _ = worked_queue(spark, folder)
    filled = [c(name).isNotNull() for name in ("started_at", "completed_at", "analyzer_version", "config_hash", "findings_s3_key")]
    complete = filled[0] & filled[1] & filled[2] & filled[3] & filled[4]
    return store.history("scan_runs").select(
        *KEYS, "source", stamp(c("queued_at")).alias("queued_at"), "rerun_reason", complete.alias("complete")
    )


@query(
    "st2_fresh_messages",
    view_sql(
        "queue", "versions",
        tail="SELECT DISTINCT name, version FROM queue WHERE CAST(substr(name, 5) AS INT) % 7 <> 0",
    ),
)
def st2(spark, folder):
    landed = landed_queue(spark, folder, "st2")
    known = view(spark, folder, "queue").select(
        *KEYS, F.when(F.substring("name", 5, 20).cast("int") % 7 == 0, "analyzed").otherwise("queued").alias("status")
    )
    fresh = worker.fresh_messages(qs.stream_queue(spark, landed), known.distinct())
    out = scratch(spark, "st2-out")
    writer = fresh.select(*KEYS).writeStream.format("parquet").option("path", out)
    worker.run_available(writer.option("checkpointLocation", scratch(spark, "st2-state")))
    return spark.read.schema("name string, version string").parquet(out)


@query(
    "st3_daily_activity",
    "SELECT strftime(ts, '%Y-%m-%d') AS date, count(*) AS versions, count(DISTINCT user_id) AS packages, "
    "CAST(sum(event_id % 5) AS BIGINT) AS findings FROM events GROUP BY 1",
)
def st3(spark, folder):
    landed = scratch(spark, "st3")
    events = table(spark, folder, "events").select(
        F.concat(lit("pkg-"), "user_id").alias("name"), c("ts").cast("timestamp").alias("analyzed_at"),
        (c("event_id") % 5).alias("findings"),
    )
    events.repartition(4, "name").write.parquet(landed)
    stream = spark.readStream.schema("name string, analyzed_at timestamp, findings bigint").option("maxFilesPerTrigger", 2).parquet(landed)
    out = scratch(spark, "st3-out")
    worker.run_available(worker.write_daily(stream, out, scratch(spark, "st3-state")))
    return worker.daily_totals(spark, out).withColumn("date", c("date").cast("string"))


@query(
    "st4_follow_changes",
    view_sql("changes", tail="SELECT id AS name, count(*) AS changes FROM changes WHERE NOT deleted GROUP BY id"),
)
def st4(spark, folder):
    """The feed lands in two parts; the second run reads on behind the first one's last seq."""
    landed, out, state = (scratch(spark, f"st4-{part}") for part in ("feed", "queue", "state"))
    feed = view(spark, folder, "changes").select(c("seq").cast("bigint").alias("seq"), "id", "deleted")
    middle = feed.agg(F.expr("percentile_approx(seq, 0.5)")).first()[0] or 0
    for part in (c("seq") <= middle, c("seq") > middle):
        feed.filter(part).write.mode("append").parquet(landed)
        changes = qs.live_changes(stream_feed(spark, landed))
        worker.run_available(worker.follow_changes(changes, out, state))
    names = spark.read.schema("name string").json(out)
    return names.groupBy("name").agg(F.count("*").alias("changes"))
