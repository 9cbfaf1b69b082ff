"""The questions asked of stored scan results.

Tables: packages (name, ...), versions (name, version, analyzed_at, status), findings
(name, version, rule, severity, file_path, details) and scores (name, version, score,
label). Every finding and score belongs to a version and every version to a package, so
a join that would only confirm that is left out. Findings are reduced to one row per
version or package before they meet another table; a single version with a large share
of all findings is reduced where its rows lie.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarsift import fixed_values as fv
from tarsift.operators.findings import detail, detail_as

c, lit = F.col, F.lit
VERSION = ["name", "version"]


@dataclass(frozen=True)
class Tables:
    packages: DataFrame
    versions: DataFrame
    findings: DataFrame
    scores: DataFrame


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "high", 1).when(severity == "medium", 2).when(severity == "low", 3)


def has_rule(*rules: str) -> Column:
    return c("rule").isin(*rules)


def per_version(findings: DataFrame) -> DataFrame:
    """Finding count and triggered rules of each version."""
    # The set holds rule names, a few dozen at most.
    rules = F.array_join(F.array_sort(F.collect_set("rule")), ", ")
    return findings.groupBy(*VERSION).agg(F.count("*").alias("findings"), rules.alias("rules"))


def zero(name: str) -> Column:
    return F.coalesce(c(name), lit(0))


def tally(frames: dict[str, DataFrame], counted: DataFrame | None = None, keys: tuple = ()) -> DataFrame:
    """Row counts of several frames as one row; and the columns ``keys`` of a row of counts."""
    counts = [
        df.agg(F.count("*").alias("n")).select(lit(key).alias("kind"), "n")
        for key, df in frames.items()
    ]
    if counted is not None:
        pairs = F.array(*[F.struct(lit(key).alias("kind"), c(key).alias("n")) for key in keys])
        counts.append(counted.select(F.inline(pairs)))
    stacked = reduce(lambda a, b: a.unionByName(b), counts)
    return stacked.agg(
        *[F.sum(F.when(c("kind") == key, c("n"))).alias(key) for key in (*frames, *keys)]
    )


# --- overview ---------------------------------------------------------------------------


def summary(t: Tables) -> DataFrame:
    # Scores are read once: per package a flag for each label, then their counts.
    flags = t.scores.groupBy("name").agg(
        F.bool_or(c("label") == "malicious").alias("malicious"),
        F.bool_or(c("label") == "suspicious").alias("suspicious"),
    )
    labelled = flags.agg(
        F.count_if("malicious").alias("malicious_packages"),
        F.count_if("suspicious").alias("suspicious_packages"),
    )
    return tally(
        {
            "total_packages": t.packages.select("name"),
            "total_versions": t.versions.select("name"),
            "total_findings": t.findings.select("rule"),
        },
        labelled,
        ("malicious_packages", "suspicious_packages"),
    )


def findings_per_rule(t: Tables) -> DataFrame:
    return t.findings.groupBy("rule").agg(F.count("*").alias("count")).orderBy(
        F.desc("count"), "rule"
    )


def findings_per_severity(t: Tables) -> DataFrame:
    counts = t.findings.groupBy("severity").agg(F.count("*").alias("count"))
    return counts.orderBy(severity_rank(c("severity")).asc_nulls_last())


def riskiest_versions(t: Tables, limit: int = 20) -> DataFrame:
    found = per_version(t.findings).select(
        *VERSION, c("findings").alias("finding_count"), c("rules").alias("triggered_rules")
    )
    return found.orderBy(F.desc("finding_count"), *VERSION).limit(limit)


# --- search -----------------------------------------------------------------------------


def search(
    t: Tables, term: str | None = None, label: str | None = None, limit: int = 500
) -> DataFrame:
    """Versions by part of the package name and by label, riskiest first."""
    named = (lambda df: df.filter(F.ilike("name", lit(f"%{term}%")))) if term else (lambda df: df)
    scores = named(t.scores)
    if label:
        scores = scores.filter(c("label") == label.lower())
    found = (
        named(t.versions)
        .select(*VERSION)
        .join(scores, VERSION, "inner" if label else "left")
        .join(per_version(named(t.findings)), VERSION, "left")
    )
    return (
        found.select(*VERSION, zero("findings").alias("findings"), "rules", "score", "label")
        .orderBy(F.desc(zero("score")), F.desc("findings"), *VERSION)
        .limit(limit)
    )


def package_findings(t: Tables, name: str) -> DataFrame:
    return (
        t.findings.filter(c("name") == name)
        .select("rule", "severity", "details", "file_path")
        .orderBy(severity_rank(c("severity")).asc_nulls_last(), "rule", "file_path")
    )


# --- high risk --------------------------------------------------------------------------


def lifecycle_commands(t: Tables, limit: int = 100) -> DataFrame:
    rows = t.findings.filter(has_rule("lifecycle_script")).select(
        *VERSION, detail("key").alias("script_type"), detail("value").alias("command")
    )
    return rows.distinct().orderBy(*VERSION, "script_type", "command").limit(limit)


def base64_files(t: Tables, limit: int = 50) -> DataFrame:
    rows = t.findings.filter(has_rule("big_base64_blob")).select(
        *VERSION, detail("path").alias("file_path"), detail_as("size", "int").alias("size_bytes")
    )
    top = rows.orderBy(F.desc_nulls_last("size_bytes"), *VERSION, "file_path").limit(limit)
    return top.withColumn("size_mb", F.round(c("size_bytes") / 1048576, 2))


def child_process_usage(t: Tables, limit: int = 50) -> DataFrame:
    rows = t.findings.filter(detail("pattern").like("%child_process%"))
    return (
        rows.select("name", detail("path").alias("file_path"))
        .distinct()
        .orderBy("name", "file_path")
        .limit(limit)
    )


def _explained(t: Tables, rules: list[str], fields: dict[str, str], limit: int) -> DataFrame:
    shown = [detail(path).alias(name) for name, path in fields.items()]
    rows = t.findings.filter(has_rule(*rules)).select(*VERSION, "rule", "severity", *shown)
    order = [F.desc_nulls_last("severity"), *VERSION, "rule", *fields]
    return rows.distinct().orderBy(*order).limit(limit)


def phishing(t: Tables, limit: int = 100) -> DataFrame:
    """Severity sorts as text, descending: medium, low, high."""
    return _explained(
        t,
        ["phishing_form", "external_cdn_load", "fake_captcha", "iframe_embed"],
        {
            "form_targets": "form_actions",
            "cdn_urls": "cdn_urls",
            "iframe_urls": "iframe_urls",
            "button_samples": "button_samples",
            "explanation": "explanation",
        },
        limit,
    )


def suspicious_scripts(t: Tables, limit: int = 100) -> DataFrame:
    return _explained(
        t,
        ["http_server", "port_binding", "script_download"],
        {"frameworks": "frameworks", "methods": "methods", "explanation": "explanation"},
        limit,
    )


# --- command and control ----------------------------------------------------------------


def c2_totals(t: Tables) -> DataFrame:
    versions = t.findings.filter(has_rule("c2_webhook")).groupBy(*VERSION).agg(
        F.count("*").alias("n")
    )
    packages = versions.join(t.scores, VERSION, "left").groupBy("name").agg(
        F.sum("n").alias("n"),
        F.bool_or(c("label") == "malicious").alias("malicious"),
        F.bool_or(c("label") == "suspicious").alias("suspicious"),
    )
    return packages.agg(
        F.count("*").alias("packages_with_c2"),
        F.coalesce(F.sum("n"), lit(0)).alias("total_c2_detections"),
        F.count_if("malicious").alias("malicious_with_c2"),
        F.count_if("suspicious").alias("suspicious_with_c2"),
    )


def c2_versions(t: Tables, limit: int = 50) -> DataFrame:
    """All versions of packages in which any version has a C2 endpoint."""
    count = lambda rule, name: F.count_if(c("rule") == rule).alias(name)
    versions = t.findings.groupBy(*VERSION).agg(
        count("c2_webhook", "c2_count"),
        count("env_snoop", "env_snoop_count"),
        count("writes_outside_pkg", "writes_count"),
        F.count("*").alias("total_findings"),
    )
    most = F.max("c2_count").over(Window.partitionBy("name"))
    found = versions.withColumn("most", most).filter("most > 0").join(t.scores, VERSION, "left")
    return (
        found.select(
            *VERSION, "score", "label", "c2_count", "env_snoop_count", "writes_count",
            "total_findings",
        )
        .orderBy(F.desc_nulls_last("score"), F.desc("total_findings"), *VERSION)
        .limit(limit)
    )


def bucketed(counts: DataFrame, count: str, label: str, edges: list[tuple[int, int, str]], rest: str):
    """Packages per range of a count."""
    rank = F.lit(len(edges))
    name = lit(rest)
    for i, (low, high, text) in reversed(list(enumerate(edges))):
        inside = c(count).between(low, high)
        rank, name = F.when(inside, i).otherwise(rank), F.when(inside, text).otherwise(name)
    grouped = counts.groupBy(rank.alias("rank"), name.alias(label))
    sized = grouped.agg(F.count("*").alias("package_count"))
    return sized.orderBy("rank").select(label, "package_count")


def c2_histogram(t: Tables) -> DataFrame:
    counts = t.findings.filter(has_rule("c2_webhook")).groupBy("name").agg(F.count("*").alias("n"))
    edges = [(1, 1, "1"), (2, 5, "2-5"), (6, 10, "6-10"), (11, 20, "11-20")]
    return bucketed(counts, "n", "c2_range", edges, "20+")


def c2_cooccurrence(t: Tables) -> DataFrame:
    lifecycle = has_rule("lifecycle_script") & (c("severity") == "high")
    flags = t.findings.groupBy("name").agg(
        F.bool_or(has_rule("c2_webhook")).alias("c2"),
        F.bool_or(has_rule("env_snoop")).alias("env"),
        F.bool_or(has_rule("writes_outside_pkg")).alias("write"),
        F.bool_or(F.coalesce(lifecycle, lit(False))).alias("lifecycle"),
        F.bool_or(has_rule("big_base64_blob", "high_entropy_blob")).alias("obfuscation"),
    )
    return flags.filter("c2").agg(
        *[
            F.count_if(name).alias(f"c2_plus_{name}")
            for name in ("env", "write", "lifecycle", "obfuscation")
        ]
    )


def c2_family(path: Column, long_form: bool) -> Column:
    pick = 1 if long_form else 0
    out = lit(fv.C2_FAMILY_OTHER[pick])
    for mark, names in reversed(fv.C2_FAMILIES.items()):
        out = F.when(F.contains(F.lower(path), lit(mark)), lit(names[pick])).otherwise(out)
    return out


def _detection_path() -> Column:
    return F.coalesce(c("file_path"), detail("path"))


def c2_families(t: Tables) -> DataFrame:
    rows = t.findings.filter(has_rule("c2_webhook")).select(
        "name", c2_family(_detection_path(), True).alias("detected_domain")
    )
    return (
        rows.groupBy("detected_domain")
        .agg(F.count("*").alias("total_findings"), F.countDistinct("name").alias("unique_packages"))
        .orderBy(F.desc("total_findings"), "detected_domain")
    )


def c2_samples(t: Tables, family: str | None = None, limit: int = 100) -> DataFrame:
    """The first findings by score; the family filter applies to those.

    The first ``limit`` findings lie in the first ``limit`` versions, so only versions
    are ranked over the shuffle, and the few that lead are looked up by broadcast.
    """
    found = t.findings.filter(has_rule("c2_webhook"))
    order = [F.desc_nulls_last("score"), *VERSION]
    leading = (
        found.select(*VERSION).distinct().join(t.scores, VERSION, "left").orderBy(*order).limit(limit)
    )
    path = _detection_path()
    rows = found.select(
        *VERSION, c2_family(path, False).alias("c2_type"), path.alias("detection_path")
    ).join(F.broadcast(leading), VERSION)
    top = rows.orderBy(*order, "detection_path").limit(limit)
    if family:
        top = top.filter(c("c2_type") == family)
    return top.select(*VERSION, "score", "label", "c2_type", "detection_path")


# --- trends -----------------------------------------------------------------------------


def daily_activity(t: Tables, days: int = 30) -> DataFrame:
    counts = t.findings.groupBy(*VERSION).agg(F.count("*").alias("n"))
    dated = counts.join(t.versions.filter(c("analyzed_at").isNotNull()), VERSION)
    daily = dated.groupBy(F.to_date("analyzed_at").alias("date")).agg(
        F.sum("n").alias("findings"), F.countDistinct("name").alias("packages")
    )
    return daily.orderBy(F.desc("date")).limit(days)


def packages_per_rule(t: Tables) -> DataFrame:
    return (
        t.findings.groupBy("rule")
        .agg(F.countDistinct("name").alias("packages_affected"))
        .orderBy(F.desc("packages_affected"), "rule")
    )


def finding_histogram(t: Tables) -> DataFrame:
    """Packages by number of findings, those without any included."""
    counts = t.findings.groupBy("name").agg(F.count("*").alias("n"))
    every = t.packages.select("name").join(counts, "name", "left").select(zero("n").alias("n"))
    edges = [(0, 0, "0"), (1, 5, "1-5"), (6, 10, "6-10"), (11, 50, "11-50")]
    return bucketed(every, "n", "finding_range", edges, "50+")


def analyzed_since(t: Tables, as_of: Column | None = None) -> DataFrame:
    since = F.current_date() if as_of is None else as_of
    recent = t.versions.filter(c("analyzed_at") >= since.cast("timestamp"))
    return tally(
        {
            "packages_today": recent.select("name").distinct(),
            "versions_today": recent.select(*VERSION).distinct(),
        }
    )


def version_changes(t: Tables, limit: int = 5) -> DataFrame:
    counts = t.versions.groupBy("name").agg(F.countDistinct("version").alias("version_count"))
    return counts.filter("version_count > 1").orderBy(F.desc("version_count"), "name").limit(limit)


# --- lists ------------------------------------------------------------------------------


def score_board(t: Tables) -> DataFrame:
    counts = t.findings.groupBy(*VERSION).agg(F.count("*").alias("n"))
    joined = t.scores.join(counts, VERSION, "left")
    board = joined.groupBy("name", "score", "label").agg(F.sum(zero("n")).alias("findings"))
    return board.orderBy(F.desc_nulls_last("score"), "name")


def credential_theft(t: Tables) -> DataFrame:
    versions = t.findings.filter(has_rule("env_snoop")).select(*VERSION).distinct()
    return versions.join(t.scores, VERSION).select(*VERSION, "score").orderBy(
        F.desc_nulls_last("score"), *VERSION
    )


def c2_destinations(t: Tables) -> DataFrame:
    return t.findings.filter(has_rule("c2_webhook")).select(
        "name", detail("endpoints").alias("c2_endpoints")
    )


def typosquat_list(t: Tables, limit: int | None = None) -> DataFrame:
    rows = t.findings.filter(has_rule("typosquat_detected")).select(
        "name",
        detail("target_package").alias("impersonating"),
        detail("similarity").alias("similarity_pct"),
        detail("typosquat_type").alias("attack_type"),
    )
    by_similarity = F.desc_nulls_last(c("similarity_pct").try_cast("double"))
    ordered = rows.orderBy(by_similarity, "name", "impersonating")
    return ordered.limit(limit) if limit else ordered


def native_binaries(t: Tables) -> DataFrame:
    return t.findings.filter(has_rule("native_binary_present")).select(
        "name", detail("path").alias("binary_path")
    )


# --- name reports -----------------------------------------------------------------------


def _package_facts(t: Tables) -> DataFrame:
    """Per package: findings, high findings, best score and label, last analysis."""
    counts = t.findings.groupBy(*VERSION).agg(
        F.count("*").alias("n"), F.count_if(c("severity") == "high").alias("high")
    )
    versions = t.versions.join(counts, VERSION, "left").join(t.scores, VERSION, "left")
    return versions.groupBy("name").agg(
        F.sum(zero("n")).alias("total_findings"),
        F.sum(zero("high")).alias("high_severity_findings"),
        F.max("score").alias("max_score"),
        F.max("label").alias("threat_label"),
        F.max("analyzed_at").alias("last_analyzed"),
    )


def _attack(name: Column, target: str) -> Column:
    """How a name resembles one target; NULL when it does not."""
    tail, stem = target[1:], target[:-1]
    by_look = [
        ("zero_to_o", F.replace(name, lit("0"), lit("o")) == target),
        ("l_to_i", F.replace(name, lit("l"), lit("i")) == target),
        ("one_to_i", F.replace(name, lit("1"), lit("i")) == target),
        ("three_to_e", F.replace(name, lit("3"), lit("e")) == target),
    ]
    kind = F.when(F.contains(name, lit(tail)), lit("substring_match"))
    kind = kind.when(F.startswith(name, lit(stem)), lit("prefix_truncation"))
    for label, test in by_look:
        kind = kind.when(test, lit(label))
    under_scope = F.startswith(name, lit("@")) & F.endswith(name, lit("/" + tail))
    similar = F.abs(F.length(name) - len(target)).between(0, 2) & F.startswith(
        name, lit(target[:3])
    )
    other = similar if target.startswith("@") else similar | under_scope
    return F.when(name != target, kind.when(other, lit("other")))


def name_similarity_report(t: Tables, limit: int = 100) -> DataFrame:
    """Packages named like a target that carry real findings.

    The targets are a fixed short list: a name is held against all of them in its own
    row, and only names that resemble one go on to the join.
    """
    attacks = [
        F.struct(lit(target).alias("target_package"), _attack(c("name"), target).alias("attack_type"))
        for target in fv.NAME_REPORT_TARGETS
    ]
    hits = F.filter(F.array(*attacks), lambda a: a["attack_type"].isNotNull())
    suspects = t.packages.select("name", F.inline(F.array_compact(hits)))
    rows = suspects.join(_package_facts(t), "name")
    threats = rows.filter((c("max_score") > 100) | (c("high_severity_findings") > 5))
    return (
        threats.withColumnRenamed("name", "suspicious_package")
        .orderBy(
            F.desc_nulls_last("max_score"), F.desc("total_findings"), "suspicious_package",
            "target_package",
        )
        .limit(limit)
    )


def mixed_case_report(t: Tables, limit: int = 50) -> DataFrame:
    name = c("name")
    pattern = (
        F.when(name.rlike("[A-Z].*[a-z].*[A-Z]"), lit("camelCase_mixed"))
        .when(name.rlike("^[a-z]+[A-Z]"), lit("starts_lower_has_upper"))
        .when(name.rlike("[A-Z]{2,}"), lit("multiple_uppercase"))
        .otherwise(lit("other_mixed_case"))
    )
    mixed = lambda df: df.filter(
        name.rlike("[A-Z]") & name.rlike("[a-z]") & ~F.startswith(name, lit("@"))
    )
    facts = _package_facts(
        Tables(t.packages, mixed(t.versions), mixed(t.findings), mixed(t.scores))
    )
    rows = facts.filter("max_score > 50").select(
        "name",
        c("total_findings").alias("findings"),
        c("max_score").alias("score"),
        c("threat_label").alias("label"),
        pattern.alias("case_pattern"),
    )
    return rows.orderBy(F.desc_nulls_last("score"), "name").limit(limit)


# --- history and acceptance -------------------------------------------------------------


def latest_runs(runs: DataFrame) -> DataFrame:
    """The latest run of every version: what retention keeps."""
    whole = F.struct(*runs.columns)
    kept = runs.groupBy(*VERSION).agg(F.max_by(whole, c("completed_at")).alias("run"))
    return kept.select("run.*")


def acceptance(
    packages: DataFrame, findings: DataFrame, documents: DataFrame, least: int = 2
) -> DataFrame:
    """Whether a run produced packages, findings and finding documents."""
    counts = tally(
        {"packages": packages, "findings": findings, "documents": documents}
    )
    passed = (c("packages") >= least) & (c("findings") > 0) & (c("documents") >= least)
    return counts.withColumn("passed", passed)
