"""Queries for the reports over stored results."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarsift import fixed_values as fv
from tarsift.catalog.registry import query, stamp
from tarsift.plans import reports as rp
from tarsift.sources.findings_io import (
    c2_urls,
    finding_documents,
    findings_of_documents,
    severity_totals,
    signature_documents,
)
from tarsift.views import view, view_sql

c = F.col


def tables(spark, folder) -> rp.Tables:
    return rp.Tables(
        packages=view(spark, folder, "packages"),
        versions=view(spark, folder, "versions"),
        findings=view(spark, folder, "findings").drop("weight"),
        scores=view(spark, folder, "scores"),
    )


def sql(tail: str) -> str:
    """Over the stored tables; v and f carry package and version names as keys."""
    return view_sql("packages", "versions", "findings", "scores", tail=tail)


PVF = "FROM findings f JOIN versions v ON f.name = v.name AND f.version = v.version JOIN packages p ON v.name = p.name"
PVS = PVF + " LEFT JOIN scores s ON v.name = s.name AND v.version = s.version"
ALL = """FROM packages p LEFT JOIN versions v ON p.name = v.name
LEFT JOIN findings f ON v.name = f.name AND v.version = f.version
LEFT JOIN scores s ON v.name = s.name AND v.version = s.version"""
D = "json_extract_string(f.details, '$.{}')".format


def report(name: str, oracle: str, fn):
    query(name, sql(oracle))(lambda spark, folder: fn(tables(spark, folder)))


report(
    "g1_summary",
    f"""SELECT count(DISTINCT p.name) AS total_packages, count(DISTINCT v.name || '@' || v.version) AS total_versions,
 count(f.rule) AS total_findings, count(DISTINCT CASE WHEN s.label = 'malicious' THEN p.name END) AS malicious_packages,
 count(DISTINCT CASE WHEN s.label = 'suspicious' THEN p.name END) AS suspicious_packages {ALL}""",
    rp.summary,
)
report("g2_findings_per_rule", "SELECT rule, count(*) AS count FROM findings GROUP BY rule", rp.findings_per_rule)
report(
    "g3_findings_per_severity",
    "SELECT severity, count(*) AS count FROM findings GROUP BY severity",
    rp.findings_per_severity,
)
report(
    "g4_riskiest_versions",
    f"""SELECT p.name, v.version, count(*) AS finding_count, string_agg(DISTINCT f.rule, ', ' ORDER BY f.rule) AS triggered_rules
 {PVF} GROUP BY p.name, v.version ORDER BY finding_count DESC, p.name, v.version LIMIT 20""",
    rp.riskiest_versions,
)
report(
    "g5_search",
    """SELECT p.name, v.version, count(f.rule) AS findings, string_agg(DISTINCT f.rule, ', ' ORDER BY f.rule) AS rules,
 max(s.score) AS score, max(s.label) AS label FROM packages p JOIN versions v ON p.name = v.name
 LEFT JOIN findings f ON v.name = f.name AND v.version = f.version LEFT JOIN scores s ON v.name = s.name AND v.version = s.version
 WHERE p.name ILIKE '%MyPack%' AND s.label = 'malicious' GROUP BY p.name, v.version
 ORDER BY coalesce(max(s.score), 0) DESC, findings DESC NULLS LAST, p.name, v.version LIMIT 500""",
    lambda t: rp.search(t, "MyPack", "Malicious"),
)
report(
    "g5_search_by_label",
    """SELECT p.name, v.version, count(f.rule) AS findings, string_agg(DISTINCT f.rule, ', ' ORDER BY f.rule) AS rules,
 max(s.score) AS score, max(s.label) AS label FROM packages p JOIN versions v ON p.name = v.name
 LEFT JOIN findings f ON v.name = f.name AND v.version = f.version LEFT JOIN scores s ON v.name = s.name AND v.version = s.version
 WHERE s.label = 'suspicious' GROUP BY p.name, v.version
 ORDER BY coalesce(max(s.score), 0) DESC, findings DESC NULLS LAST, p.name, v.version LIMIT 500""",
    lambda t: rp.search(t, label="Suspicious"),
)
report(
    "g6_package_findings",
    f"SELECT f.rule, f.severity, f.details, f.file_path {PVF} WHERE p.name = 'mypackage25' OR p.name = 'myPackage25'",
    lambda t: rp.package_findings(t, "myPackage25"),
)
report(
    "g7_lifecycle_commands",
    f"""SELECT DISTINCT p.name, v.version, {D('key')} AS script_type, {D('value')} AS command {PVF}
 WHERE f.rule = 'lifecycle_script' ORDER BY p.name, v.version, script_type, command LIMIT 100""",
    rp.lifecycle_commands,
)
report(
    "g8_base64_files",
    f"""SELECT p.name, v.version, {D('path')} AS file_path, CAST({D('size')} AS INT) AS size_bytes,
 round(CAST({D('size')} AS INT) / 1048576, 2) AS size_mb {PVF}
 WHERE f.rule = 'big_base64_blob' ORDER BY size_bytes DESC NULLS LAST, p.name, v.version, file_path LIMIT 50""",
    rp.base64_files,
)
report(
    "g9_child_process_usage",
    f"""SELECT DISTINCT p.name, {D('path')} AS file_path {PVF} WHERE {D('pattern')} LIKE '%child_process%'
 ORDER BY p.name, file_path LIMIT 50""",
    rp.child_process_usage,
)
report(
    "g10_phishing",
    f"""SELECT DISTINCT p.name, v.version, f.rule, f.severity, {D('form_actions')} AS form_targets, {D('cdn_urls')} AS cdn_urls,
 {D('iframe_urls')} AS iframe_urls, {D('button_samples')} AS button_samples, {D('explanation')} AS explanation {PVF}
 WHERE f.rule IN ('phishing_form', 'external_cdn_load', 'fake_captcha', 'iframe_embed')
 ORDER BY f.severity DESC NULLS LAST, p.name, v.version, f.rule, explanation LIMIT 100""",
    rp.phishing,
)
report(
    "g11_suspicious_scripts",
    f"""SELECT DISTINCT p.name, v.version, f.rule, f.severity, {D('frameworks')} AS frameworks, {D('methods')} AS methods,
 {D('explanation')} AS explanation {PVF} WHERE f.rule IN ('http_server', 'port_binding', 'script_download')
 ORDER BY f.severity DESC NULLS LAST, p.name, v.version, f.rule, explanation LIMIT 100""",
    rp.suspicious_scripts,
)
report(
    "g12_c2_totals",
    f"""SELECT count(DISTINCT p.name) AS packages_with_c2, count(*) AS total_c2_detections,
 count(DISTINCT CASE WHEN s.label = 'malicious' THEN p.name END) AS malicious_with_c2,
 count(DISTINCT CASE WHEN s.label = 'suspicious' THEN p.name END) AS suspicious_with_c2 {PVS} WHERE f.rule = 'c2_webhook'""",
    rp.c2_totals,
)
report(
    "g13_c2_versions",
    """, rules_of AS (SELECT name, version, histogram(rule) AS h, count(*) AS total_findings FROM findings GROUP BY name, version),
counted AS (SELECT name, version, total_findings, CAST(coalesce(h['c2_webhook'], 0) AS BIGINT) AS c2_count,
              CAST(coalesce(h['env_snoop'], 0) AS BIGINT) AS env_snoop_count, CAST(coalesce(h['writes_outside_pkg'], 0) AS BIGINT) AS writes_count FROM rules_of),
flagged AS (SELECT *, max(c2_count) OVER (PARTITION BY name) AS most FROM counted)
SELECT name, version, score, label, c2_count, env_snoop_count, writes_count, total_findings FROM flagged LEFT JOIN scores USING (name, version)
WHERE most > 0 ORDER BY score DESC NULLS LAST, total_findings DESC, name, version LIMIT 50""",
    rp.c2_versions,
)
report(
    "g14_c2_histogram",
    f"""SELECT c2_range, count(*) AS package_count FROM (SELECT CASE WHEN n = 1 THEN '1' WHEN n BETWEEN 2 AND 5 THEN '2-5'
 WHEN n BETWEEN 6 AND 10 THEN '6-10' WHEN n BETWEEN 11 AND 20 THEN '11-20' ELSE '20+' END AS c2_range
 FROM (SELECT p.name, count(*) AS n {PVF} WHERE f.rule = 'c2_webhook' GROUP BY p.name) c) r GROUP BY c2_range""",
    rp.c2_histogram,
)
report(
    "g15_c2_cooccurrence",
    """, flags AS (SELECT name, list_distinct(list(rule)) AS rules, bool_or(rule = 'lifecycle_script' AND severity = 'high') AS hooked
  FROM findings GROUP BY name),
c2 AS (SELECT * FROM flags WHERE list_contains(rules, 'c2_webhook'))
SELECT count_if(list_contains(rules, 'env_snoop')) AS c2_plus_env, count_if(list_contains(rules, 'writes_outside_pkg')) AS c2_plus_write,
 count_if(hooked) AS c2_plus_lifecycle, count_if(list_has_any(rules, ['big_base64_blob', 'high_entropy_blob'])) AS c2_plus_obfuscation FROM c2""",
    rp.c2_cooccurrence,
)


def _family_sql(path: str, pick: int) -> str:
    whens = " ".join(
        f"WHEN regexp_matches({path}, '(?i){mark}') THEN '{names[pick]}'" for mark, names in fv.C2_FAMILIES.items()
    )
    return f"CASE {whens} ELSE '{fv.C2_FAMILY_OTHER[pick]}' END"


_PATH = f"coalesce(f.file_path, {D('path')})"
report(
    "g16_c2_families",
    f""", per_package AS (SELECT name, {_family_sql(_PATH, 1)} AS detected_domain, count(*) AS n
  FROM findings f WHERE rule = 'c2_webhook' GROUP BY ALL)
SELECT detected_domain, CAST(sum(n) AS BIGINT) AS total_findings, count(*) AS unique_packages FROM per_package GROUP BY detected_domain""",
    rp.c2_families,
)
_SAMPLES = f"""SELECT p.name, v.version, s.score, s.label, {_family_sql(_PATH, 0)} AS c2_type, {_PATH} AS detection_path {PVS}
 WHERE f.rule = 'c2_webhook' ORDER BY s.score DESC NULLS LAST, p.name, v.version, detection_path LIMIT 100"""
report("g17_c2_samples", _SAMPLES, rp.c2_samples)
report(
    "g17_c2_samples_of_family",
    f"SELECT * FROM ({_SAMPLES}) q WHERE c2_type = 'Discord'",
    lambda t: rp.c2_samples(t, "Discord"),
)


@query(
    "g18_daily_activity",
    sql(
        f"""SELECT strftime(CAST(v.analyzed_at AS DATE), '%Y-%m-%d') AS date, count(f.rule) AS findings, count(DISTINCT p.name) AS packages {PVF}
 WHERE v.analyzed_at IS NOT NULL GROUP BY 1 ORDER BY date DESC LIMIT 30"""
    ),
)
def g18(spark, folder):
    return rp.daily_activity(tables(spark, folder)).withColumn("date", c("date").cast("string"))


report(
    "g19_packages_per_rule",
    "SELECT f.rule, count(DISTINCT v.name) AS packages_affected FROM findings f JOIN versions v ON f.name = v.name AND f.version = v.version GROUP BY f.rule",
    rp.packages_per_rule,
)
report(
    "g20_finding_histogram",
    """SELECT finding_range, count(*) AS package_count FROM (SELECT CASE WHEN n = 0 THEN '0' WHEN n BETWEEN 1 AND 5 THEN '1-5'
 WHEN n BETWEEN 6 AND 10 THEN '6-10' WHEN n BETWEEN 11 AND 50 THEN '11-50' ELSE '50+' END AS finding_range
 FROM (SELECT p.name, count(f.rule) AS n FROM packages p LEFT JOIN versions v ON p.name = v.name
       LEFT JOIN findings f ON v.name = f.name AND v.version = f.version GROUP BY p.name) c) r GROUP BY finding_range""",
    rp.finding_histogram,
)
report(
    "g21_analyzed_since",
    """SELECT count(DISTINCT p.name) AS packages_today, count(DISTINCT v.name || '@' || v.version) AS versions_today
 FROM versions v JOIN packages p ON v.name = p.name WHERE v.analyzed_at >= DATE '2001-07-01'""",
    lambda t: rp.analyzed_since(t, F.lit("2001-07-01").cast("date")),
)
report(
    "g22_version_changes",
    """SELECT p.name, count(DISTINCT v.version) AS version_count FROM packages p JOIN versions v ON p.name = v.name
 GROUP BY p.name HAVING count(DISTINCT v.version) > 1 ORDER BY version_count DESC, p.name LIMIT 5""",
    rp.version_changes,
)
report(
    "g23_score_board",
    """SELECT p.name, s.score, s.label, count(f.rule) AS findings FROM packages p JOIN versions v ON p.name = v.name
 JOIN scores s ON v.name = s.name AND v.version = s.version LEFT JOIN findings f ON v.name = f.name AND v.version = f.version
 GROUP BY p.name, s.score, s.label""",
    rp.score_board,
)
report(
    "g24_credential_theft",
    f"""SELECT DISTINCT p.name, v.version, s.score {PVF} JOIN scores s ON v.name = s.name AND v.version = s.version
 WHERE f.rule = 'env_snoop'""",
    rp.credential_theft,
)
report(
    "g25_c2_destinations",
    f"SELECT p.name, {D('endpoints')} AS c2_endpoints {PVF} WHERE f.rule = 'c2_webhook'",
    rp.c2_destinations,
)
report(
    "g26_typosquat_list",
    f"""SELECT p.name, {D('target_package')} AS impersonating, {D('similarity')} AS similarity_pct, {D('typosquat_type')} AS attack_type
 {PVF} WHERE f.rule = 'typosquat_detected' ORDER BY CAST({D('similarity')} AS DOUBLE) DESC NULLS LAST, p.name LIMIT 50""",
    lambda t: rp.typosquat_list(t, 50),
)
report(
    "g27_native_binaries",
    f"SELECT p.name, {D('path')} AS binary_path {PVF} WHERE f.rule = 'native_binary_present'",
    rp.native_binaries,
)
report(
    "g28_severity_of_documents",
    "SELECT severity, count(*) AS count FROM findings GROUP BY severity",
    lambda t: severity_totals(finding_documents(t.findings)),
)


@query(
    "g29_c2_urls_of_documents",
    sql(
        """SELECT url, count(*) AS n FROM (SELECT unnest([concat('https://', rule, '.example/', file_path), 'https://fixed.example']) AS url
 FROM findings WHERE rule = 'c2_webhook') u GROUP BY url"""
    ),
)
def g29(spark, folder):
    found = tables(spark, folder).findings
    urls = F.array(
        F.concat(F.lit("https://"), c("rule"), F.lit(".example/"), c("file_path")),
        F.lit("https://fixed.example"),
    )
    with_urls = found.withColumn("details", F.to_json(F.struct(urls.alias("full_urls"))))
    return c2_urls(finding_documents(with_urls)).groupBy("url").agg(F.count("*").alias("n"))


RUNS = """
SELECT name, version, analyzed_at + INTERVAL {} DAY AS completed_at, score + {} AS score FROM (
  SELECT v.name, v.version, v.analyzed_at, s.score FROM versions v JOIN scores s ON v.name = s.name AND v.version = s.version) r"""


def scan_runs(spark, folder):
    """Two runs of every version, a day apart."""
    t = tables(spark, folder)
    first = t.versions.join(t.scores, ["name", "version"]).select(
        "name", "version", c("analyzed_at").alias("completed_at"), "score"
    )
    second = first.withColumns(
        {"completed_at": c("completed_at") + F.expr("INTERVAL 1 DAY"), "score": c("score") + 1}
    )
    return first.unionByName(second)


@query(
    "g30_latest_runs",
    sql(
        f"""SELECT name, version, strftime(completed_at, '%Y-%m-%d %H:%M:%S') AS completed_at, CAST(score AS INT) AS score FROM (
 SELECT *, row_number() OVER (PARTITION BY name, version ORDER BY completed_at DESC) AS rn
 FROM ({RUNS.format(0, 0)} UNION ALL {RUNS.format(1, 1)}) u) q WHERE rn = 1"""
    ),
)
def g30(spark, folder):
    kept = rp.latest_runs(scan_runs(spark, folder))
    return kept.withColumn("completed_at", stamp(c("completed_at")))


report(
    "g31_acceptance",
    """SELECT *, packages >= 2 AND findings > 0 AND documents >= 2 AS passed FROM (SELECT (SELECT count(*) FROM packages) AS packages,
 (SELECT count(*) FROM findings) AS findings, (SELECT count(*) FROM (SELECT DISTINCT name, version FROM findings) d) AS documents) c""",
    lambda t: rp.acceptance(t.packages, t.findings, finding_documents(t.findings)),
)

# One row per package with versions: what it was found to hold.
_PACKAGE_FACTS = """found AS (SELECT name, version, count(*) AS n, sum(CAST(severity = 'high' AS INT)) AS high FROM findings GROUP BY name, version),
facts AS (SELECT v.name, CAST(sum(coalesce(n, 0)) AS BIGINT) AS total_findings, CAST(sum(coalesce(high, 0)) AS BIGINT) AS high, max(score) AS max_score,
            max(label) AS threat_label, max(analyzed_at) AS last_analyzed
          FROM versions v LEFT JOIN found USING (name, version) LEFT JOIN scores USING (name, version) GROUP BY v.name)"""
_TARGETS = ", ".join(f"('{n}')" for n in fv.NAME_REPORT_TARGETS)


@query(
    "t12_name_similarity_report",
    sql(
        f""", {_PACKAGE_FACTS}, target(t) AS (VALUES {_TARGETS}),
kind(rank, attack_type) AS (VALUES (1, 'substring_match'), (2, 'prefix_truncation'), (3, 'zero_to_o'), (4, 'l_to_i'),
  (5, 'one_to_i'), (6, 'three_to_e'), (7, 'other')),
likeness(rank, name, t) AS (
  SELECT 1, name, t FROM packages, target WHERE contains(name, substring(t, 2))
  UNION ALL SELECT 2, name, t FROM packages, target WHERE starts_with(name, left(t, length(t) - 1))
  UNION ALL SELECT k, name, t FROM packages, target, (VALUES (3, '0', 'o'), (4, 'l', 'i'), (5, '1', 'i'), (6, '3', 'e')) swap(k, a, b)
            WHERE replace(name, a, b) = t
  UNION ALL SELECT 7, name, t FROM packages, target WHERE name[1] = '@' AND t[1] <> '@' AND ends_with(name, '/' || substring(t, 2))
  UNION ALL SELECT 7, name, t FROM packages, target WHERE left(name, 3) = left(t, 3) AND length(name) BETWEEN length(t) - 2 AND length(t) + 2),
first_likeness AS (SELECT name, t, min(rank) AS rank FROM likeness WHERE name <> t GROUP BY name, t)
SELECT name AS suspicious_package, t AS target_package, attack_type, total_findings, high AS high_severity_findings, max_score,
 threat_label, strftime(last_analyzed, '%Y-%m-%d %H:%M:%S') AS last_analyzed
FROM first_likeness JOIN kind USING (rank) JOIN facts USING (name) WHERE max_score > 100 OR high > 5
ORDER BY max_score DESC NULLS LAST, total_findings DESC, name, t LIMIT 100"""
    ),
)
def t12(spark, folder):
    found = rp.name_similarity_report(tables(spark, folder))
    return found.withColumn("last_analyzed", stamp(c("last_analyzed")))


report(
    "t13_mixed_case_report",
    f""", {_PACKAGE_FACTS}, shape(rank, case_pattern, test) AS (VALUES (1, 'camelCase_mixed', '[A-Z].*[a-z].*[A-Z]'),
  (2, 'starts_lower_has_upper', '^[a-z]+[A-Z]'), (3, 'multiple_uppercase', '[A-Z]{{2,}}'), (4, 'other_mixed_case', '')),
shaped AS (SELECT name, min_by(case_pattern, rank) AS case_pattern FROM facts, shape WHERE regexp_matches(name, test) GROUP BY name)
SELECT name, total_findings AS findings, max_score AS score, threat_label AS label, case_pattern FROM facts JOIN shaped USING (name)
WHERE upper(name) <> name AND lower(name) <> name AND name[1] <> '@' AND max_score > 50 ORDER BY score DESC NULLS LAST, name LIMIT 50""",
    rp.mixed_case_report,
)


# --- finding documents ------------------------------------------------------------------


@query(
    "s14_finding_documents",
    sql(
        """SELECT concat(name, '@', version, '.tgz') AS tgz, CAST(count(*) AS INT) AS findings,
 CAST(count(*) FILTER (severity = 'high') AS INT) AS high FROM findings GROUP BY name, version"""
    ),
)
def s14(spark, folder):
    docs = finding_documents(tables(spark, folder).findings)
    return docs.select(
        "tgz",
        F.size("findings").alias("findings"),
        F.size(F.filter("findings", lambda f: f["severity"] == "high")).alias("high"),
    )


@query(
    "s15_signature_documents",
    sql(
        """SELECT name, version, 'yara' AS scanner, CAST(count(*) AS INT) AS findings, 1.5 AS scan_time
 FROM findings WHERE rule = 'yara_match' GROUP BY name, version"""
    ),
)
def s15(spark, folder):
    docs = signature_documents(tables(spark, folder).findings, F.lit(1.5).cast("double"))
    return docs.select(
        "package.name", "package.version", "scanner", F.size("findings").alias("findings"), "scan_time"
    )


@query(
    "s19_documents_to_findings",
    sql("SELECT name, version, rule, severity, file_path, details FROM findings"),
)
def s19(spark, folder):
    """There and back, with documents small enough that versions are split into parts."""
    return findings_of_documents(finding_documents(tables(spark, folder).findings, size=3))
