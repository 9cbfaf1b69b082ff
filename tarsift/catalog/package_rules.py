"""Queries for manifest rules, names, scores, signatures and user rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarsift import fixed_values as fv
from tarsift.catalog.content import ALLOWED, CODE, LOWERED, files, found_sql
from tarsift.catalog.registry import ORACLES, flat, query, sql_list, sql_text
from tarsift.config import (
    ScanConfig,
    allow_domains_frame,
    build_tools_frame,
    config_from_mapping,
    weight_rows,
    weights_frame,
)
from tarsift.operators import manifests as mf
from tarsift.operators import scoring, typosquat
from tarsift.operators.signatures import (
    Signature,
    SignatureString,
    append_signature_findings,
    rescore,
    scan_signatures,
)
from tarsift.operators.findings import to_findings
from tarsift.operators.user_rules import RuleSpec, apply_user_rules, with_user_weights
from tarsift.sources.tables import spread
from tarsift.views import FINDING_RULES, view, view_sql

c = F.col

J = "(CASE WHEN json_valid(as_read) THEN as_read ELSE '{}' END)"


def j(path: str) -> str:
    return f"json_extract_string({J}, '$.{path}')"


@query(
    "s7_manifest_parse",
    view_sql(
        "manifests",
        tail=f"""
SELECT name, version, {j('name')} AS package_name,
       CAST(coalesce(len(json_keys(json_extract({J}, '$.scripts'))), 0) AS INT) AS scripts,
       json_valid(as_read) AS valid FROM manifests""",
    ),
)
def s7(spark, folder):
    parsed = mf.parse_manifests(view(spark, folder, "manifests"))
    return parsed.select(
        "name", "version", "package_name",
        F.coalesce(F.size("scripts"), F.lit(0)).alias("scripts"),
        (c("manifest") != "{}").alias("valid"),
    )


@query(
    "m1_package_metadata",
    view_sql(
        "manifests",
        tail=f"""
SELECT name, version,
       CASE c_custkey % 8 WHEN 1 THEN 'Ann Lee' WHEN 4 THEN 'm@x.example' WHEN 5 THEN 'pub' WHEN 6 THEN 'Kim'
            WHEN 7 THEN CASE WHEN c_custkey % 16 <> 15 THEN 'a@b.example' END END AS author,
       CASE c_custkey % 8 WHEN 5 THEN 'https://p.example' WHEN 6 THEN 'https://kim.example' END AS author_url,
       trim({j('description')}) AS description, {j('homepage')} AS homepage,
       coalesce({j('repository.url')}, CASE WHEN json_type({J}, '$.repository') = 'VARCHAR' THEN {j('repository')} END) AS repository,
       {j('publisher.username')} AS npm_username
FROM manifests""",
    ),
)
def m1(spark, folder):
    return mf.package_metadata(view(spark, folder, "manifests"))


MEMBERS = """
SELECT concat('pkg-', source) AS name, concat('1.0.', CAST(doc_id AS VARCHAR)) AS version,
       CASE doc_id % 5 WHEN 0 THEN 'package/.npmrc' WHEN 1 THEN 'package/sub/package-lock.json'
            WHEN 2 THEN 'package/npm-shrinkwrap.json' WHEN 3 THEN 'package/x.npmrc' ELSE 'package/index.js' END AS path
FROM documents"""


def members(spark, folder):
    """A member list: one path per document."""
    return view(spark, folder, "files").select(
        "name",
        F.concat(F.lit("1.0."), c("file_id")).alias("version"),
        F.element_at(
            F.array(*[F.lit(p) for p in (
                "package/.npmrc", "package/sub/package-lock.json", "package/npm-shrinkwrap.json",
                "package/x.npmrc", "package/index.js",
            )]),
            (c("file_id") % 5 + 1).cast("int"),
        ).alias("path"),
    )


@query("m3_npmrc_present", f"SELECT DISTINCT name, version, 'high' AS severity FROM ({MEMBERS}) m WHERE path = 'package/.npmrc'")
def m3(spark, folder):
    return mf.npmrc_present(members(spark, folder)).select("name", "version", "severity")


@query(
    "m4_lockfile_present",
    f"SELECT DISTINCT name, version, 'low' AS severity, regexp_extract(path, '[^/]*$') AS file FROM ({MEMBERS}) m "
    "WHERE regexp_extract(path, '[^/]*$') IN ('npm-shrinkwrap.json', 'package-lock.json')",
)
def m4(spark, folder):
    return mf.lockfile_present(members(spark, folder)).select("name", "version", "severity", "file")


_HOOKS = ", ".join(f"({i}, '{h}')" for i, h in enumerate(fv.LIFECYCLE_HOOKS))
HOOKS = f"""
, hooks AS (SELECT name, version, position, hook, json_extract_string({J}, concat('$.scripts.', hook)) AS cmd
            FROM manifests CROSS JOIN (VALUES {_HOOKS}) h(position, hook)),
tagged AS (SELECT name, version, position, hook, cmd,
  regexp_matches(cmd, '(?i)\\b(sh|bash|zsh|cmd(\\.exe)?|powershell|pwsh)\\b') AS shell,
  regexp_matches(cmd, '(?i)\\b(curl|wget|bitsadmin|certutil|Invoke-WebRequest|iwr|Start-BitsTransfer)\\b') AS down,
  regexp_matches(cmd, '(?i)\\bnode\\b.+\\b(child_process|eval|Function)\\b') AS nodeish,
  regexp_matches(cmd, '(?i)\\bbundle\\.js\\b') AS bundle,
  regexp_matches(cmd, {sql_text('(?i)' + '|'.join(fv.BUILD_TOOLS))}) AS build,
  regexp_matches(cmd, '(?i)https?://') AS url
  FROM hooks WHERE cmd <> '')"""


def _lifecycle_sql(noted: str, severity: str) -> str:
    return view_sql(
        "manifests",
        tail=HOOKS + f"""
SELECT name, version, hook AS "key", cmd AS "value",
       array_to_string(list_sort(list_filter([CASE WHEN shell THEN 'shell_spawn' END, CASE WHEN down THEN 'downloader' END,
         CASE WHEN nodeish THEN 'node_shellish' END, CASE WHEN bundle THEN 'bundle_exec' END,
         CASE WHEN {noted} THEN 'benign_build' END, CASE WHEN url THEN 'url_in_command' END], lambda t: t IS NOT NULL)), '|') AS tags,
       CASE WHEN shell OR down OR nodeish OR bundle THEN 'high' {severity} ELSE 'medium' END AS severity FROM tagged""",
    )


@query("m5_lifecycle_script", _lifecycle_sql("bundle AND build", ""))
def m5(spark, folder):
    return mf.lifecycle_findings(view(spark, folder, "manifests")).select(
        "name", "version", "key", "value", flat(c("tags")).alias("tags"), "severity"
    )


@query("m5_lifecycle_script_strict", _lifecycle_sql("build", "WHEN build AND NOT url THEN 'low'"))
def m5_strict(spark, folder):
    """With the documented downgrade of plain build hooks switched on."""
    config = ScanConfig(strict_benign=True)
    return mf.lifecycle_findings(view(spark, folder, "manifests"), config).select(
        "name", "version", "key", "value", flat(c("tags")).alias("tags"), "severity"
    )


_HOOK_URLS = HOOKS + f"""
, hu AS (SELECT name, version, hook, unnest(regexp_extract_all(cmd, '(?i)https?://[^\\s''"]+')) AS url FROM hooks),
hd AS (SELECT *, regexp_extract(url, '(?i)^https?://([^/?#]*)', 1) AS domain FROM hu)"""


@query(
    "m6_hook_urls",
    view_sql(
        "manifests",
        tail=_HOOK_URLS + f"""
SELECT name, version, hook, url, domain,
       CASE WHEN regexp_full_match(lower(domain), {sql_text(ALLOWED)}) THEN 'url_in_code' ELSE 'url_outside_allowlist' END AS rule,
       CASE WHEN regexp_full_match(lower(domain), {sql_text(ALLOWED)}) THEN 'medium' ELSE 'high' END AS severity FROM hd""",
    ),
)
def m6(spark, folder):
    return mf.hook_urls(view(spark, folder, "manifests")).select(
        "name", "version", "hook", "url", "domain", "rule", "severity"
    )


@query(
    "m7_has_bin",
    view_sql(
        "manifests",
        tail=f"SELECT name, version, 'low' AS severity, CAST(json_extract({J}, '$.bin') AS VARCHAR) AS bin FROM manifests "
        f"WHERE list_contains(json_keys({J}), 'bin')",
    ),
)
def m7(spark, folder):
    return mf.has_bin(view(spark, folder, "manifests")).select("name", "version", "severity", "bin")


_SCRIPTS = f"CAST(json_extract({J}, '$.scripts') AS VARCHAR)"


@query(
    "m8_native_fetcher_in_scripts",
    view_sql(
        "manifests",
        tail=f"SELECT name, version, 'low' AS severity, 'scripts' AS \"where\" FROM manifests WHERE regexp_matches({_SCRIPTS}, '(?i)prebuild-install|node-pre-gyp')",
    ),
)
def m8(spark, folder):
    return mf.native_fetcher_in_scripts(view(spark, folder, "manifests")).select(
        "name", "version", "severity", "where"
    )


@query(
    "m9_native_fetcher_custom_url",
    view_sql(
        "manifests",
        tail=f"SELECT name, version, 'medium' AS severity FROM manifests WHERE regexp_matches({_SCRIPTS}, '(?i)prebuild-install|node-pre-gyp') "
        f"AND regexp_matches({_SCRIPTS}, '(?i)(--download|--build-from-source|--target|--runtime)\\s+https?://')",
    ),
)
def m9(spark, folder):
    return mf.native_fetcher_custom_url(view(spark, folder, "manifests")).select(
        "name", "version", "severity"
    )


# --- names ------------------------------------------------------------------------------

_BARE = "CASE WHEN {0} LIKE '@%/%' THEN split_part({0}, '/', 2) WHEN {0} LIKE '@%' THEN substr({0}, 2) ELSE {0} END"


def _values(names) -> str:
    return ", ".join(f"({sql_text(n)})" for n in names)


@query(
    "t1_scope_strip",
    view_sql("names", tail=f"SELECT s_suppkey, name, {_BARE.format('name')} AS bare_name FROM names"),
)
def t1(spark, folder):
    return view(spark, folder, "names").select(
        "s_suppkey", "name", typosquat.bare_name(c("name")).alias("bare_name")
    )


_CONFUSED = " + ".join(
    f"(CASE WHEN substr(a, {i}, 1) <> substr(b, {i}, 1) AND concat(substr(a, {i}, 1), substr(b, {i}, 1)) IN "
    f"({sql_list([look + ch for ch, looks in fv.CONFUSABLES.items() for look in looks])}) THEN 1 ELSE 0 END)"
    for i in range(1, 26)
)
_EDIT_SQL = f"""
, popular(target) AS (VALUES {_values(fv.POPULAR_NAMES)}),
pairs AS (SELECT s_suppkey, name, target, {_BARE.format('name')} AS bare, {_BARE.format('target')} AS bare_target FROM names CROSS JOIN popular),
measured AS (SELECT *, lower(bare) AS a, lower(bare_target) AS b, levenshtein(lower(bare), lower(bare_target)) AS d,
                    CASE WHEN length(bare_target) > 6 THEN 3 WHEN length(bare_target) >= 4 THEN 2 ELSE 1 END AS k
             FROM pairs WHERE bare <> bare_target AND name <> target),
looked AS (SELECT *, CASE WHEN length(a) = length(b) THEN {_CONFUSED} ELSE 0 END AS swapped FROM measured),
hits AS (SELECT s_suppkey, name, target AS target_package,
           CAST(CASE WHEN d <= k THEN d ELSE swapped END AS INT) AS edit_distance,
           CASE WHEN d <= k THEN round_even((1 - d / greatest(length(a), length(b))) * 100, 1) ELSE 95.0 END AS similarity,
           CASE WHEN d > k THEN 'unicode_substitution' WHEN length(a) = length(b) - 1 THEN 'character_omission'
                WHEN length(a) = length(b) + 1 THEN 'character_insertion' WHEN length(a) = length(b) THEN 'character_substitution'
                ELSE 'edit_distance' END AS typosquat_type
         FROM looked WHERE d <= k OR swapped BETWEEN 1 AND 2)"""


@query(
    "t2_edit_distance_matches",
    view_sql("names", tail=_EDIT_SQL + " SELECT * FROM hits WHERE typosquat_type <> 'unicode_substitution'"),
)
def t2(spark, folder):
    """All matches within the edit-distance limit, with similarity (T3) and type (T4)."""
    found = typosquat.detect_typosquats(spread(view(spark, folder, "names"), "s_suppkey"), all_matches=True)
    return found.filter("typosquat_type <> 'unicode_substitution'").drop("bare_name")


@query(
    "t3_similarity",
    view_sql("names", tail=_EDIT_SQL + " SELECT similarity, count(*) AS pairs FROM hits GROUP BY similarity"),
)
def t3(spark, folder):
    found = typosquat.detect_typosquats(spread(view(spark, folder, "names"), "s_suppkey"), all_matches=True)
    return found.groupBy("similarity").agg(F.count("*").alias("pairs"))


@query(
    "t4_typosquat_types",
    view_sql("names", tail=_EDIT_SQL + " SELECT typosquat_type, count(*) AS pairs FROM hits GROUP BY typosquat_type"),
)
def t4(spark, folder):
    found = typosquat.detect_typosquats(spread(view(spark, folder, "names"), "s_suppkey"), all_matches=True)
    return found.groupBy("typosquat_type").agg(F.count("*").alias("pairs"))


_ZEROED = """
, names AS (SELECT p_partkey AS s_suppkey, replace(replace(p_name, ' ', ''), 'l', '1') AS name FROM part)"""


@query(
    "t5_confusable_substitution",
    "WITH " + _ZEROED.strip()[1:] + _EDIT_SQL + " SELECT s_suppkey AS p_partkey, name, target_package, edit_distance, similarity FROM hits WHERE typosquat_type = 'unicode_substitution'",
)
def t5(spark, folder):
    """Look-alike characters, over part names written with a digit one."""
    parts = spark.read.parquet(f"{folder}/part.parquet").select(
        "p_partkey", F.translate(F.replace("p_name", F.lit(" "), F.lit("")), "l", "1").alias("name")
    )
    found = typosquat.detect_typosquats(spread(parts, "p_partkey"), all_matches=True)
    return found.filter("typosquat_type = 'unicode_substitution'").select(
        "p_partkey", "name", "target_package", "edit_distance", "similarity"
    )


@query(
    "t6_scope_hijacks",
    "SELECT s_suppkey, name, target_package FROM (SELECT s_suppkey, concat('@s', CAST(s_suppkey AS VARCHAR), '/', "
    "CASE s_suppkey % 3 WHEN 0 THEN 'core' WHEN 1 THEN 'cli' ELSE 'zzz' END) AS name FROM supplier) n JOIN "
    f"(SELECT target AS target_package FROM (VALUES {_values(p for p in fv.POPULAR_NAMES if p.startswith('@'))}) v(target)) t "
    "ON split_part(name, '/', 2) = split_part(target_package, '/', 2) AND split_part(name, '/', 1) <> split_part(target_package, '/', 1)",
)
def t6(spark, folder):
    names = spark.read.parquet(f"{folder}/supplier.parquet").select(
        "s_suppkey",
        F.concat(
            F.lit("@s"), c("s_suppkey"), F.lit("/"),
            F.when(c("s_suppkey") % 3 == 0, "core").when(c("s_suppkey") % 3 == 1, "cli").otherwise("zzz"),
        ).alias("name"),
    )
    return typosquat.scope_hijacks(names).select("s_suppkey", "name", "target_package")


@query(
    "t7_first_match",
    view_sql(
        "names",
        tail=_EDIT_SQL + """
SELECT s_suppkey, name, target_package, edit_distance, similarity, typosquat_type FROM (
  SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY edit_distance, target_package) AS rn FROM hits) r WHERE rn = 1""",
    ),
)
def t7(spark, folder):
    return typosquat.detect_typosquats(spread(view(spark, folder, "names"), "s_suppkey")).drop("bare_name")


@query(
    "m2_typosquat_detected",
    view_sql(
        "names",
        tail=_EDIT_SQL + """
SELECT concat('m', CAST(s_suppkey AS VARCHAR)) AS name, '1.0.0' AS version, 'high' AS severity, name AS package_name,
       target_package, edit_distance, similarity, typosquat_type,
       concat('Package "', name, '" appears to typosquat "', target_package, '" (', printf('%.1f', similarity), '% similar, type: ', typosquat_type, ')') AS explanation
FROM (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY edit_distance, target_package) AS rn FROM hits) r WHERE rn = 1""",
    ),
)
def m2(spark, folder):
    """Manifests that declare the derived look-alike names."""
    declared = view(spark, folder, "names").select(
        F.concat(F.lit("m"), c("s_suppkey")).alias("name"), F.lit("1.0.0").alias("version"),
        F.to_json(F.struct("name")).alias("manifest"),
    )
    found = typosquat.typosquat_findings(mf.parse_manifests(declared))
    return found.select(
        "name", "version", "severity", "package_name", "target_package", "edit_distance",
        "similarity", "typosquat_type", "explanation",
    )


_HAMMING = " + ".join(f"(CASE WHEN substr(a, {i}, 1) <> substr(b, {i}, 1) THEN 1 ELSE 0 END)" for i in range(1, 32))
_PAIRS_SQL = f"""
, protected(target) AS (VALUES {_values(typosquat.detector_names())}),
p0 AS (SELECT DISTINCT name, target, {_BARE.format('name')} AS a, {_BARE.format('target')} AS b FROM names CROSS JOIN protected),
p1 AS (SELECT *, levenshtein(a, b) AS d, CASE WHEN length(a) = length(b) THEN {_HAMMING} ELSE 99 END AS hamming FROM p0 WHERE a <> b),
p2 AS (SELECT name AS suspicious_package, target AS legitimate_package, hamming,
              round((1 - levenshtein(lower(name), lower(target)) / greatest(length(name), length(target))) * 100, 6) AS similarity_score,
              CASE WHEN length(a) = length(b) THEN CASE WHEN hamming <= 2 THEN 'character_substitution' ELSE 'character_swap' END
                   WHEN length(a) = length(b) - 1 THEN 'character_omission' WHEN length(a) = length(b) + 1 THEN 'character_insertion'
                   ELSE 'multiple_changes' END AS typosquat_type
       FROM p1 WHERE (length(b) > 6 AND d <= 3) OR (length(b) >= 4 AND d <= 2) OR (length(b) < 4 AND d <= 1) OR hamming <= 2)"""


def _pairs(spark, folder):
    return typosquat.typosquat_pairs(view(spark, folder, "names").select("name").distinct())


@query(
    "t8_all_pairs",
    view_sql("names", tail=_PAIRS_SQL + " SELECT suspicious_package, legitimate_package, similarity_score, typosquat_type FROM p2"),
)
def t8(spark, folder):
    return _pairs(spark, folder).withColumn("similarity_score", F.round("similarity_score", 6))


@query("t8_protected_table", ORACLES["t8_all_pairs"])
def t8_table(spark, folder):
    """The same pairs, with the protected names as a table."""
    protected = spark.createDataFrame([(n,) for n in typosquat.detector_names()], "name string")
    found = typosquat.typosquat_pairs_of_table(view(spark, folder, "names"), protected)
    return found.withColumn("similarity_score", F.round("similarity_score", 6))


@query("t2_protected_table", ORACLES["t2_edit_distance_matches"])
def t2_table(spark, folder):
    protected = spark.createDataFrame([(n,) for n in fv.POPULAR_NAMES], "name string")
    names = view(spark, folder, "names")
    found = typosquat.typosquats_of_table(names, protected).drop("bare_name")
    return names.join(found, "name").filter("typosquat_type <> 'unicode_substitution'")


@query(
    "t9_character_substitution",
    view_sql("names", tail=_PAIRS_SQL + " SELECT suspicious_package, legitimate_package, hamming FROM p2 WHERE hamming BETWEEN 1 AND 2"),
)
def t9(spark, folder):
    found = _pairs(spark, folder).filter("typosquat_type = 'character_substitution'")
    a, b = (typosquat.bare_name(c(n)) for n in ("suspicious_package", "legitimate_package"))
    return found.select(
        "suspicious_package", "legitimate_package",
        typosquat.differing_positions(a, b).alias("hamming"),
    )


@query(
    "t10_pair_types",
    view_sql("names", tail=_PAIRS_SQL + " SELECT typosquat_type, count(*) AS pairs FROM p2 GROUP BY typosquat_type"),
)
def t10(spark, folder):
    return _pairs(spark, folder).groupBy("typosquat_type").agg(F.count("*").alias("pairs"))


_PERM_SQL = f"""
, n AS (SELECT DISTINCT name, CASE WHEN name LIKE '@%/%' THEN substr(split_part(name, '/', 1), 2) ELSE '' END AS scope, {_BARE.format('name')} AS base FROM names),
pos AS (SELECT name, scope, base, unnest(range(0, length(base) + 1)) AS i FROM n),
ins(ch) AS (SELECT unnest(string_split('{fv.INSERTED_CHARACTERS}', ''))),
conf(ch, look) AS (VALUES {", ".join(f"('{ch}', '{look}')" for ch, looks in fv.PERMUTATION_CONFUSABLES.items() for look in looks)}),
raw AS (
  SELECT name, scope, concat(left(base, i), substr(base, i + 2)) AS perm FROM pos WHERE i < length(base)
  UNION SELECT name, scope, concat(left(base, i), substr(base, i + 1, 1), substr(base, i + 1)) FROM pos WHERE i < length(base)
  UNION SELECT name, scope, concat(left(base, i), look, substr(base, i + 2)) FROM pos JOIN conf ON lower(substr(base, i + 1, 1)) = ch WHERE i < length(base)
  UNION SELECT name, scope, concat(left(base, i), substr(base, i + 2, 1), substr(base, i + 1, 1), substr(base, i + 3)) FROM pos WHERE i < length(base) - 1
  UNION SELECT name, scope, concat(left(base, i), ch, substr(base, i + 1)) FROM pos CROSS JOIN ins),
sc(v) AS (VALUES {_values(fv.SCOPE_VARIATIONS)}),
perms AS (SELECT DISTINCT name, permutation FROM (
  SELECT name, CASE WHEN scope <> '' THEN concat('@', scope, '/', perm) ELSE perm END AS permutation FROM raw WHERE length(perm) > 1
  UNION SELECT name, concat('@', v, '/', perm) FROM raw CROSS JOIN sc WHERE length(perm) > 1
  UNION SELECT name, concat('@', perm, '/', v) FROM raw CROSS JOIN sc WHERE length(perm) > 1 AND scope <> '') x
  WHERE permutation <> name AND length(permutation) > 2)"""


@query(
    "t11_permutations",
    view_sql("names", tail=_PERM_SQL + " SELECT name, permutation FROM perms"),
)
def t11(spark, folder):
    return typosquat.permutations_of(view(spark, folder, "names").select("name").distinct())


@query(
    "t11_permutation_join",
    view_sql(
        "names",
        tail=", targets AS (SELECT name FROM names)"
        + _PERM_SQL.replace("FROM names)", f"FROM (VALUES {_values(fv.POPULAR_NAMES)}) q(name))", 1)
        + " SELECT DISTINCT t.name AS suspicious_package, p.name AS legitimate_package FROM targets t JOIN perms p ON t.name = p.permutation",
    ),
)
def t11_join(spark, folder):
    protected = spark.createDataFrame([(p,) for p in fv.POPULAR_NAMES], "name string")
    return typosquat.names_in_permutations(
        view(spark, folder, "names"), typosquat.permutations_of(protected)
    )


# --- cross-rule findings and scores -----------------------------------------------------

_WEIGHTS = ", ".join(f"('{r}', '{v}', {w})" for r, v, w in weight_rows(ScanConfig()))
_EXPECTED = ", ".join(f"('{r}', {w})" for r, _, w in FINDING_RULES)


def findings(spark, folder):
    return view(spark, folder, "findings").drop("weight")


def risky(spark, folder):
    """Versions whose lifecycle finding is high, as the risky-hook input."""
    found = findings(spark, folder).filter("rule = 'lifecycle_script' AND severity = 'high'")
    return found.select("name", "version").distinct().withColumn("lifecycle", F.lit("postinstall"))


@query(
    "x1_install_chain_risk",
    view_sql(
        "findings",
        tail="""SELECT name, version, 'install_chain_risk' AS rule, 'high' AS severity FROM findings GROUP BY name, version
HAVING bool_or(rule = 'lifecycle_script' AND severity = 'high') AND bool_or(rule IN
 ('env_snoop', 'url_in_code', 'url_outside_allowlist', 'net_client_usage', 'c2_webhook', 'webpack_bundle', 'large_js'))""",
    ),
)
def x1(spark, folder):
    found = scoring.cross_rule_findings(findings(spark, folder), risky(spark, folder))
    return found.filter("rule = 'install_chain_risk'").select("name", "version", "rule", "severity")


@query(
    "x2_install_persistence_risk",
    view_sql(
        "findings",
        tail="""SELECT name, version, 'install_persistence_risk' AS rule, 'high' AS severity FROM findings GROUP BY name, version
HAVING bool_or(rule = 'lifecycle_script' AND severity = 'high') AND bool_or(rule = 'writes_outside_pkg')""",
    ),
)
def x2(spark, folder):
    found = scoring.cross_rule_findings(findings(spark, folder), risky(spark, folder))
    return found.filter("rule = 'install_persistence_risk'").select("name", "version", "rule", "severity")


@query(
    "r1_scores",
    view_sql("findings", tail="SELECT name, version, CAST(sum(weight) AS INT) AS score FROM findings GROUP BY name, version"),
)
def r1(spark, folder):
    return scoring.score_versions(findings(spark, folder)).select("name", "version", "score")


@query(
    "r2_labels",
    view_sql("findings", "scores", tail="SELECT name, version, score, label FROM scores"),
)
def r2(spark, folder):
    """All versions, those without findings included (U8)."""
    return scoring.score_versions(
        findings(spark, folder), versions=view(spark, folder, "versions")
    )


@query(
    "r3_severity_counts",
    view_sql(
        "findings",
        tail="""SELECT name, version, CAST(count(*) FILTER (severity = 'high') AS INT) AS high_count,
 CAST(count(*) FILTER (severity = 'medium') AS INT) AS medium_count, CAST(count(*) FILTER (severity = 'low') AS INT) AS low_count,
 0 AS unknown_count FROM findings GROUP BY name, version""",
    ),
)
def r3(spark, folder):
    return scoring.severity_counts(findings(spark, folder))


@query(
    "s20_effective_weights",
    view_sql(
        "findings",
        tail=f"SELECT rule, count(*) AS findings, max(weight) AS weight, (SELECT count(*) FROM (VALUES {_EXPECTED}) e(r, w)) AS rules FROM findings GROUP BY rule",
    ),
)
def s20(spark, folder):
    """Every rule of the findings with the weight the configuration gives it."""
    config = ScanConfig()
    found = scoring.weighted(findings(spark, folder), config)
    return found.groupBy("rule").agg(
        F.count("*").alias("findings"), F.max("weight").alias("weight"),
        F.lit(len(FINDING_RULES)).alias("rules"),
    )


@query(
    "s20_allow_list_off",
    view_sql(
        "files",
        tail=f"""
, u AS (SELECT path, unnest(regexp_extract_all(content, '(?i)https?://[^\\s''"]+')) AS url FROM files WHERE {CODE})
SELECT 'url_in_code' AS rule, 'medium' AS severity, regexp_extract(url, '(?i)^https?://([^/?#]*)', 1) AS domain, count(DISTINCT path) AS files
FROM u WHERE regexp_extract(url, '(?i)^https?://([^/?#]*)', 1) <> '' GROUP BY 3""",
    ),
)
def s20_off(spark, folder):
    from tarsift.operators.content_rules import content_rule

    config = config_from_mapping({"analysis": {"flag_if_url_not_in_allowlist": False}})
    found = content_rule(files(spark, folder), "url_domains", config)
    return found.groupBy("rule", "severity", "domain").agg(F.count("*").alias("files"))


@query(
    "s20_configuration_tables",
    f"""
SELECT 'allowed' AS kind, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS item, count(*) AS rows FROM pages
WHERE regexp_full_match(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), {sql_text(ALLOWED)}) GROUP BY 2
UNION ALL SELECT 'label', CASE WHEN score >= 12 THEN 'malicious' WHEN score >= 7 THEN 'suspicious' ELSE 'clean' END, count(*)
FROM ({view_sql('findings', 'scores', tail='SELECT score FROM scores')}) s GROUP BY 2""",
)
def s20_tables(spark, folder):
    """The allow list and the thresholds used as tables, joined to pages and scores."""
    from tarsift.functions import text as tx

    config = ScanConfig()
    hosts = view(spark, folder, "html_files").select(tx.url_domain(c("url")).alias("item"))
    labels = F.split(c("item"), r"\.")
    # Every dot suffix of a host: a suffix match becomes an equi-join.
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    counted = hosts.groupBy("item").agg(F.count("*").alias("rows"))
    allowed = (
        counted.select("item", "rows", F.explode(F.array_compact(suffixes)).alias("domain"))
        .join(allow_domains_frame(spark, config), "domain", "left_semi")
        .dropDuplicates(["item"])
        .select(F.lit("allowed").alias("kind"), "item", "rows")
    )
    label = scoring.label_of(c("score"), config)
    scores = view(spark, folder, "scores").groupBy(label.alias("item")).agg(F.count("*").alias("rows"))
    return allowed.unionByName(scores.select(F.lit("label").alias("kind"), "item", "rows"))


# --- signatures and user rules ----------------------------------------------------------

SIGNATURES = [
    Signature(
        "Exfil_Post",
        (SignatureString("$a", "post("), SignatureString("$b", "HTTPS://discord", nocase=True)),
        needed=None,
        tags=("Trojan",),
        meta={"description": "Posts to a chat hook"},
    ),
    Signature(
        "Exec_Or_Eval",
        (
            SignatureString("$e", r"\beval \(", is_regex=True),
            SignatureString("$c", r"child_process\.\w+", is_regex=True),
        ),
        needed=1,
        tags=("suspicious", "script"),
    ),
    Signature("Long_Run", (SignatureString("$r", "QkQkQkQk"),), tags=("encoded",)),
    Signature(
        "Accented",
        (
            SignatureString("$p", "ción "),
            SignatureString("$n", "ÈLE", nocase=True),
            SignatureString("$x", r"ß[a-z]+", is_regex=True),
        ),
    ),
]
_SIG = {
    "Exfil_Post": ("high", "content LIKE '%post(%' AND lower(content) LIKE '%https://discord%'",
                   "len(regexp_extract_all(content, 'post\\(')) + len(regexp_extract_all(content, '(?i)https://discord'))",
                   "regexp_extract(content, 'post\\(|(?i)https://discord')"),
    "Exec_Or_Eval": ("medium", "regexp_matches(content, '\\beval \\(|child_process\\.\\w+')",
                     "len(regexp_extract_all(content, '\\beval \\(|child_process\\.\\w+'))",
                     "regexp_extract(content, '\\beval \\(|child_process\\.\\w+')"),
    "Long_Run": ("low", "content LIKE '%QkQkQkQk%'", "len(regexp_extract_all(content, 'QkQkQkQk'))", "'QkQkQkQk'"),
    "Accented": ("low", "regexp_matches(content, 'ción |(?i:èle)|ß[a-z]+')",
                 "len(regexp_extract_all(content, 'ción ')) + len(regexp_extract_all(content, '(?i)èle')) + len(regexp_extract_all(content, 'ß[a-z]+'))",
                 "regexp_extract(content, 'ción |(?i:èle)|ß[a-z]+')"),
}
_SIG_SQL = " UNION ALL ".join(
    f"""SELECT name, version, path, '{rule}' AS yara_rule, '{severity}' AS severity, strlen(content) AS file_size_bytes,
        CAST({count} AS INT) AS match_count,
        CAST(1 + length(left(content, instr(content, {first}) - 1)) - length(replace(left(content, instr(content, {first}) - 1), chr(10), '')) AS INT) AS first_line
        FROM files WHERE {where}"""
    for rule, (severity, where, count, first) in _SIG.items()
)


@query("y1_signature_matches", view_sql("files", tail=_SIG_SQL))
def y1(spark, folder):
    found = scan_signatures(files(spark, folder), SIGNATURES)
    return found.select(
        "name", "version", "path", "yara_rule", "severity", "file_size_bytes", "match_count",
        F.get(c("matched_strings"), F.lit(0))["line_number"].alias("first_line"),
    )


@query(
    "y2_signature_severity",
    view_sql("files", tail=f", m AS ({_SIG_SQL}) SELECT severity, count(*) AS matches FROM m GROUP BY severity"),
)
def y2(spark, folder):
    found = scan_signatures(files(spark, folder), SIGNATURES)
    return found.groupBy("severity").agg(F.count("*").alias("matches"))


@query(
    "y3_signature_size_limit",
    view_sql("binary_files", tail="SELECT name, version, path FROM binary_files WHERE length(magic) / 2 + strlen(text) <= 1048576 AND text LIKE '%the%'"),
)
def y3(spark, folder):
    from tarsift.catalog.content import binary_files

    signature = [Signature("Word", (SignatureString("$t", "the"),))]
    found = scan_signatures(
        binary_files(spark, folder), signature, ScanConfig(signature_max_mb=1)
    )
    return found.select("name", "version", "path")


@query(
    "y4_append_signature_findings",
    view_sql(
        "findings", "scores", "versions",
        tail="""
, extra AS (SELECT name, version FROM versions WHERE status = 'analyzed'),
added AS (SELECT f.name, f.version, count(*) AS n FROM (
    SELECT name, version, rule, file_path FROM findings
    UNION ALL SELECT name, version, 'yara_match', concat('package/s', '.js') FROM extra) f GROUP BY f.name, f.version)
SELECT s.name, s.version, CAST(s.score + CASE WHEN v.status = 'analyzed' THEN 7 ELSE 0 END AS INT) AS score, coalesce(a.n, 0) AS findings
FROM scores s JOIN versions v ON v.name = s.name AND v.version = s.version LEFT JOIN added a ON a.name = s.name AND a.version = s.version""",
    ),
)
def y4(spark, folder):
    """Signature findings for every analysed version and for one unknown version each,
    appended twice: unknown versions and the rerun add nothing."""
    from tarsift.catalog.sources import scratch
    from tarsift.plans.scan import written

    # Stored tables, as they would be: each is derived once.
    stored = lambda df, name: written(df, name, scratch(spark, "y4"))
    base = stored(findings(spark, folder), "findings")
    versions = stored(view(spark, folder, "versions"), "versions")
    known_scores = stored(view(spark, folder, "scores"), "scores")
    analysed = versions.filter("status = 'analyzed'")
    unknown = analysed.withColumn("version", F.concat("version", F.lit("-x")))
    found = analysed.unionByName(unknown).select(
        "name", "version", F.lit("yara_match").alias("rule"), F.lit("high").alias("severity"),
        F.lit("package/s.js").alias("path"), F.lit("Demo").alias("yara_rule"),
    )
    found = to_findings(found)
    added = lambda df: stored(df, "added")
    once = append_signature_findings(base, found, versions, added)
    twice = append_signature_findings(once, found, versions, added)
    scores = rescore(twice, known_scores, analysed)
    counts = twice.groupBy("name", "version").agg(F.count("*").alias("findings"))
    return scores.join(counts, ["name", "version"], "left").select(
        "name", "version", "score", F.coalesce("findings", F.lit(0)).alias("findings")
    )


RULE_SPECS = [
    RuleSpec("axios_call", "high", r"(?i)axios\s*\(", weight=6, explanation="calls axios"),
    RuleSpec("flask_app", "medium", r"(?i)flask", weight=3, suffixes=(".py",)),
    RuleSpec("accent", "low", r"(?i)É[a-z]+", weight=1, suffixes=(".js",)),
]


@query(
    "rs1_user_rules",
    view_sql(
        "files",
        tail=f"""
SELECT name, version, path, 'axios_call' AS rule, 'high' AS severity, CAST(len(regexp_extract_all(content, '(?i)axios\\s*\\(')) AS INT) AS match_count, 6 AS weight
FROM files WHERE {CODE} AND regexp_matches(content, '(?i)axios\\s*\\(')
UNION ALL SELECT name, version, path, 'flask_app', 'medium', CAST(len(regexp_extract_all(content, '(?i)flask')) AS INT), 3
FROM files WHERE suffix = '.py' AND regexp_matches(content, '(?i)flask')
UNION ALL SELECT name, version, path, 'accent', 'low', CAST(len(regexp_extract_all(content, '[Éé][a-zA-Z]+')) AS INT), 1
FROM files WHERE suffix = '.js' AND regexp_matches(content, '[Éé][a-zA-Z]+')""",
    ),
)
def rs1(spark, folder):
    config = with_user_weights(ScanConfig(), RULE_SPECS)
    rows = apply_user_rules(files(spark, folder), RULE_SPECS)
    weights = weights_frame(spark, config).filter("variant = ''").drop("variant")
    return rows.join(weights, "rule").select(
        "name", "version", "path", "rule", "severity", "match_count", "weight"
    )


def _flagship_sql() -> str:
    weights = ", ".join(f"('{rule}', '{variant}', {weight})" for rule, variant, weight in weight_rows(LOWERED))
    return view_sql(
        "files",
        tail=f"""
, weights(rule, variant, weight) AS (VALUES {weights}),
s AS (SELECT f.name, f.version, sum(coalesce(w.weight, 0)) AS score, count(*) AS n FROM ({found_sql()}) f
      LEFT JOIN weights w ON w.rule = f.rule AND w.variant = f.variant GROUP BY f.name, f.version)
SELECT v.name, v.version, CAST(coalesce(s.score, 0) AS INT) AS score,
       CASE WHEN coalesce(s.score, 0) >= 12 THEN 'malicious' WHEN coalesce(s.score, 0) >= 7 THEN 'suspicious' ELSE 'clean' END AS label,
       coalesce(s.n, 0) AS findings
FROM (SELECT DISTINCT name, version FROM files) v LEFT JOIN s ON s.name = v.name AND s.version = v.version""",
    )


@query("flagship_score_board", _flagship_sql())
def flagship(spark, folder):
    """The findings of all file rules in all files, scored and counted per version."""
    from tarsift.operators.content_rules import scan_files

    source = files(spark, folder)
    # The findings are read once for both results.
    totals = scoring.weighted(scan_files(source, LOWERED), LOWERED).groupBy("name", "version").agg(
        F.sum("weight").cast("int").alias("total"), F.count("*").alias("n")
    )
    versions = source.select("name", "version").distinct()
    score = F.coalesce(c("total"), F.lit(0))
    return versions.join(totals, ["name", "version"], "left").select(
        "name", "version", score.alias("score"), scoring.label_of(score, LOWERED).alias("label"),
        F.coalesce("n", F.lit(0)).alias("findings"),
    )
