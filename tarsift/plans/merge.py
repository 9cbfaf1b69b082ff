"""Merging a scan into the stored tables, as DataFrame expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarsift.functions.timestamps import parse_timestamp
from tarsift.operators.manifests import clean
from tarsift.operators.scoring import severity_counts

c, lit = F.col, F.lit
KEYS = ["name", "version"]


def upsert_packages(packages: DataFrame, scanned: DataFrame, at: Column) -> DataFrame:
    """Insert packages or refresh last_seen. Author and description only change to
    something: an empty one leaves what is stored. ``scanned`` has one row per version."""
    facts = scanned.groupBy("name").agg(
        F.max(clean(c("author"))).alias("new_author"),
        F.max(clean(c("description"))).alias("new_description"),
    )
    merged = packages.join(facts.withColumn("seen", lit(True)), "name", "full_outer")
    untouched = [
        col for col in packages.columns
        if col not in ("name", "ecosystem", "author", "description", "last_seen", "created_at")
    ]
    created = []
    if "created_at" in packages.columns:
        new = F.when(c("ecosystem").isNull(), at)
        created = [F.coalesce("created_at", new).alias("created_at")]
    return merged.select(
        "name",
        F.coalesce("ecosystem", lit("npm")).alias("ecosystem"),
        F.coalesce("new_author", "author").alias("author"),
        F.coalesce("new_description", "description").alias("description"),
        F.when(c("seen"), at).otherwise(c("last_seen")).alias("last_seen"),
        *created,
        *untouched,
    )


def upsert_versions(versions: DataFrame, scanned: DataFrame, at: Column) -> DataFrame:
    fresh = scanned.select(*KEYS).distinct().withColumn("seen", lit(True))
    merged = versions.join(fresh, KEYS, "full_outer")
    untouched = [col for col in versions.columns if col not in (*KEYS, "analyzed_at", "status")]
    return merged.select(
        *KEYS,
        F.when(c("seen"), at).otherwise(c("analyzed_at")).alias("analyzed_at"),
        F.when(c("seen"), lit("analyzed")).otherwise(c("status")).alias("status"),
        *untouched,
    )


def replace_findings(findings: DataFrame, fresh: DataFrame, scanned: DataFrame) -> DataFrame:
    """The findings of the scanned versions are the fresh ones, all others stay."""
    fresh = sanitized(fresh)
    return _without(findings, scanned).unionByName(fresh.select(*findings.columns))


def upsert_scores(scores: DataFrame, fresh: DataFrame) -> DataFrame:
    return _without(scores, fresh).unionByName(fresh.select(*scores.columns))


def _without(table: DataFrame, scanned: DataFrame) -> DataFrame:
    return table.join(scanned.select(*KEYS).distinct(), KEYS, "left_anti")


def sanitized(findings: DataFrame) -> DataFrame:
    """No NUL characters: neither bare ones nor their JSON escape."""
    bare = lambda col: F.translate(c(col), "\x00", "").alias(col)
    # An escape counts only after an even number of backslashes; \\u0000 is plain text.
    json = F.regexp_replace(
        F.translate("details", "\x00", ""), r"(?<!\\)((?:\\\\)*)(?:\\u0000)+", "$1"
    )
    texts = [col for col in findings.columns if col not in ("details",)]
    return findings.select(*[bare(col) for col in texts], json.alias("details")).select(
        *findings.columns
    )


RUN_SCHEMA = (
    "name string, version string, source string, queued_at timestamp, started_at timestamp, "
    "completed_at timestamp, analyzer_version string, config_hash string, score int, label string, "
    "high_count bigint, medium_count bigint, low_count bigint, findings_s3_key string, "
    "rerun_reason string, requested_by string"
)
RUN_COLUMNS = [part.split()[0] for part in RUN_SCHEMA.split(", ")]
RUN_DETAILS = ("source", "queued_at", "started_at", "analyzer_version", "config_hash",
               "findings_s3_key", "rerun_reason", "requested_by")


def scan_run_rows(
    scores: DataFrame,
    findings: DataFrame,
    completed_at: Column,
    messages: DataFrame | None = None,
    **details: Column | str | None,
) -> DataFrame:
    """A history row per scored version, with its severity counts.

    What the version's message says (``messages``, a row per version at most) comes before
    what holds for the whole run (``details``).
    """
    counts = severity_counts(findings)
    rows = scores.join(counts, KEYS, "left").withColumn("completed_at", completed_at)
    said = [name for name in RUN_DETAILS if messages is not None and name in messages.columns]
    if said:
        rows = rows.join(messages.select(*KEYS, *[c(name).alias(f"of_{name}") for name in said]), KEYS, "left")
    for name in RUN_DETAILS:
        value = details.get(name)
        column = value if isinstance(value, Column) else lit(value)
        if name.endswith("_at"):
            own = parse_timestamp(c(f"of_{name}").cast("string")) if name in said else lit(None)
            column = F.coalesce(own.cast("timestamp"), column.cast("timestamp"))
        else:
            own = c(f"of_{name}") if name in said else lit(None)
            column = F.coalesce(own.cast("string"), column.cast("string"))
        rows = rows.withColumn(name, column)
    for name in ("high_count", "medium_count", "low_count"):
        rows = rows.withColumn(name, F.coalesce(c(name), lit(0)))
    return rows.select(*RUN_COLUMNS)


def scan_run_findings(findings: DataFrame, completed_at: Column) -> DataFrame:
    """What each run found, one row per finding, keyed to its run. A run's findings are
    rows and not one array, whose size nothing would bound."""
    return sanitized(findings).withColumn("completed_at", completed_at)
