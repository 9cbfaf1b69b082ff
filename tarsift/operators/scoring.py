"""Findings that follow from other findings, scores, labels and severity counts.

All of these aggregate findings by version. The aggregates are sums and flags, so each
task reduces its own rows first and one row per version crosses the shuffle, however
many findings a single version has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarsift import fixed_values as fv
from tarsift.config import ScanConfig, weight_rows, weights_frame

c, lit = F.col, F.lit
KEYS = ["name", "version"]

NETWORK_RULES = ["url_in_code", "url_outside_allowlist", "net_client_usage", "c2_webhook"]
BUNDLE_RULES = ["webpack_bundle", "large_js"]


def cross_rule_findings(findings: DataFrame, risky: DataFrame) -> DataFrame:
    """install_chain_risk and install_persistence_risk, as typed rows.

    ``risky`` names the versions with a risky hook (name, version, lifecycle).
    """
    has = lambda *rules: F.bool_or(c("rule").isin(*rules))
    relevant = findings.filter(
        c("rule").isin("env_snoop", "writes_outside_pkg", *NETWORK_RULES, *BUNDLE_RULES)
    )
    flags = relevant.groupBy(*KEYS).agg(
        has("env_snoop", *NETWORK_RULES, *BUNDLE_RULES).alias("reaches"),
        has("writes_outside_pkg").alias("writes"),
    )
    both = flags.join(risky, KEYS)
    rows = F.array_compact(
        F.array(
            F.when(c("reaches"), lit("install_chain_risk")),
            F.when(c("writes"), lit("install_persistence_risk")),
        )
    )
    explanation = F.when(
        c("rule") == "install_chain_risk", lit(fv.EXPLAIN["install_chain_risk"])
    ).otherwise(lit(fv.EXPLAIN["install_persistence_risk"]))
    return both.select(*KEYS, "lifecycle", F.explode(rows).alias("rule")).select(
        *KEYS, "rule", lit("high").alias("severity"), explanation.alias("explanation"), "lifecycle"
    )


def weight_variant() -> Column:
    """What the weight of a finding depends on besides its rule."""
    confidence = F.get_json_object("details", "$.confidence")
    return (
        F.when(
            c("rule") == "advanced_obfuscation",
            F.when(confidence == "high", lit("high")).otherwise(lit("other")),
        )
        .when(
            c("rule") == "yara_match",
            F.when(c("severity").isin("high", "medium"), c("severity")).otherwise(lit("other")),
        )
        .otherwise(lit(""))
    )


def weighted(findings: DataFrame, config: ScanConfig) -> DataFrame:
    """Findings with their weight. The weight table has a few dozen rows."""
    weights = weights_frame(findings.sparkSession, config)
    if len(weight_rows(config)) <= 10_000:
        weights = F.broadcast(weights)
    return (
        findings.withColumn("variant", weight_variant())
        .join(weights, ["rule", "variant"], "left")
        .withColumn("weight", F.coalesce("weight", lit(0)))
    )


def label_of(score: Column, config: ScanConfig) -> Column:
    malicious = config.thresholds.get("malicious", fv.FALLBACK_THRESHOLDS["malicious"])
    suspicious = config.thresholds.get("suspicious", fv.FALLBACK_THRESHOLDS["suspicious"])
    return (
        F.when(score >= malicious, lit("malicious"))
        .when(score >= suspicious, lit("suspicious"))
        .otherwise(lit("clean"))
    )


def score_versions(
    findings: DataFrame, config: ScanConfig | None = None, versions: DataFrame | None = None
) -> DataFrame:
    """Score and label per version; with ``versions`` also those without findings."""
    config = config or ScanConfig()
    sums = weighted(findings, config).groupBy(*KEYS).agg(F.sum("weight").alias("score"))
    if versions is not None:
        sums = versions.select(*KEYS).join(sums, KEYS, "left")
    score = F.coalesce(c("score"), lit(0)).cast("int")
    return sums.select(*KEYS, score.alias("score"), label_of(score, config).alias("label"))


def severity_counts(findings: DataFrame) -> DataFrame:
    """high, medium, low and unknown counts per version."""
    severity = F.lower(F.coalesce(F.nullif(c("severity"), lit("")), lit("unknown")))
    count = lambda value: F.count_if(c("sev") == value).cast("int").alias(f"{value}_count")
    return (
        findings.select(*KEYS, severity.alias("sev"))
        .groupBy(*KEYS)
        .agg(count("high"), count("medium"), count("low"), count("unknown"))
    )
