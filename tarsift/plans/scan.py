"""The batch scan: archives in, findings and scores out.

Archives are unpacked and their contents scanned once. That pass keeps no content: of
each member it leaves what was found, the manifest text where it is one, and the path.
The result is small and is written down, in the shared folder the cluster names, so that
everything after it (manifest rules, cross-rule findings, scores, the store) reads a
table instead of unpacking again, also when executors are lost.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarsift.config import ScanConfig
from tarsift.functions import text as tx
from tarsift.operators import manifests as mf
from tarsift.operators.content_rules import FEATURES, RULES, entropy_wanted
from tarsift.operators.file_rules import Feature, as_found, with_found
from tarsift.operators.findings import to_findings, union_findings
from tarsift.operators.long_files import found_in_parts, part_features
from tarsift.operators.scoring import cross_rule_findings, score_versions
from tarsift.operators.signatures import Signature, signature_candidates, signature_rows
from tarsift.operators.typosquat import typosquat_findings
from tarsift.operators.user_rules import RuleSpec, rule_candidates, user_rows, with_user_weights
from tarsift.session import checkpoint_folder
from tarsift.sources import archives as ar
from tarsift.sources.unpack import CONTEXT_BYTES, LONG_BYTES, PART_BYTES

c, lit = F.col, F.lit
KEYS = ["name", "version"]
# Archives with long members that are opened together.
PATHS = 10_000


@dataclass(frozen=True)
class ScanResult:
    """Tables of one scan. ``versions`` are those that count as analysed; archives that
    were rejected or could not be read are in ``rejects`` and get no score."""

    versions: DataFrame
    findings: DataFrame
    scores: DataFrame
    metadata: DataFrame
    rejects: DataFrame


def scan_members(
    members: DataFrame,
    config: ScanConfig | None = None,
    signatures: list[Signature] | None = None,
    rules: list[RuleSpec] | None = None,
) -> DataFrame:
    """The one pass over contents: members without content, with ``found`` and the
    manifest text."""
    config = config or ScanConfig()
    base_name = F.substring_index("path", "/", -1)
    is_file = ar.is_content()
    manifest = F.when(is_file & (base_name == "package.json"), tx.clean_text(c("content")))
    # Only files of archives with a manifest are scanned; without a suffix no rule applies.
    # A long member's content comes in parts; see `with_long_members`.
    suffix = F.when(is_file & c("has_manifest") & ~c("long"), tx.suffix_of(c("path")))
    base = members.withColumns(
        {
            "is_file": is_file,
            "manifest": manifest,
            "suffix": suffix,
            "content": F.when(suffix.isNotNull(), c("content")),
        }
    )
    more = []
    if signatures:
        base = base.withColumn("candidates", signature_candidates(signatures, config))
        more.append(F.transform(signature_rows(), as_found))
    if rules:
        base = base.withColumn("rule_candidates", rule_candidates(rules))
        more.append(F.transform(user_rows(), as_found))
    features = dict(FEATURES)
    base = base.withColumnRenamed("entropy", "measured_entropy")
    if "entropy" in members.columns and config.entropy_sample_bytes is None:
        # Measured where the archive was unpacked: no Python stage in the scan.
        features["entropy"] = Feature(2, lambda config: F.when(entropy_wanted(config), c("measured_entropy")))
    return with_found(base, RULES.values(), features, config, more).drop(
        "measured_entropy", "candidates", "rule_candidates"
    )


def with_long_members(
    facts: DataFrame,
    archives: DataFrame | None,
    config: ScanConfig,
    rules: list[RuleSpec] | None = None,
    folder: str | None = None,
    part_bytes: int = PART_BYTES,
    context_bytes: int = CONTEXT_BYTES,
    long_bytes: int = LONG_BYTES,
) -> DataFrame:
    """Facts with what rules find in long members, which `scan_members` only names.

    Their archives are read once more, PATHS at a time by name, or out of ``archives``; the
    members come in parts, the parts leave features, and these are joined by member.
    """
    spark = facts.sparkSession
    long = facts.filter(c("long") & c("is_file") & c("has_manifest"))
    names = long.select("archive").distinct()
    if names.isEmpty():
        return facts
    if archives is not None:
        chosen = [archives.join(names.withColumnRenamed("archive", "path"), "path", "left_semi")]
    else:
        paths = [row["archive"] for row in names.toLocalIterator()]
        chosen = [ar.archive_files(spark, paths[k : k + PATHS], "*") for k in range(0, len(paths), PATHS)]
    found = []
    for some in chosen:
        parts = ar.long_member_parts(some, config.max_extract_bytes, long_bytes, part_bytes, context_bytes)
        features = written(part_features(parts, config, rules), "scan-parts", folder)
        found.append(found_in_parts(features, config, rules))
    more = reduce(DataFrame.unionByName, found).withColumnRenamed("found", "found_in_parts")
    joined = facts.join(more, ["archive", "ordinal"], "left").withColumn(
        "found", F.when(c("long") & c("has_manifest"), F.coalesce("found_in_parts", "found")).otherwise(c("found"))
    )
    return written(joined.select(*facts.columns), "scan-facts", folder)


def written(df: DataFrame, label: str, folder: str | None = None) -> DataFrame:
    """The frame as a table in the shared folder: read back, never recomputed."""
    root = checkpoint_folder(df.sparkSession, folder)
    path = f"{root}/{label}/{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.parquet(path)


def one_archive_each(facts: DataFrame, folder: str | None = None) -> DataFrame:
    """Facts with one archive per version: where several were read, the last by path.

    The superfluous archives are few, so they are what is joined away; they are written down,
    since everything later reads the facts, and mostly there are none.
    """
    pairs = facts.filter(c("name").isNotNull()).select(*KEYS, "archive").distinct()
    several = pairs.groupBy(*KEYS).agg(
        F.max("archive").alias("kept"), F.count("*").alias("n")
    ).filter("n > 1")
    dropped = pairs.join(several, KEYS).filter(c("archive") != c("kept")).select("archive")
    dropped = written(dropped, "scan-superfluous", folder)
    return facts if dropped.isEmpty() else facts.join(dropped, "archive", "left_anti")


def scanned_versions(facts: DataFrame) -> DataFrame:
    kept = facts.filter(c("status").isin(ar.OK, ar.OVER_LIMIT) & c("name").isNotNull())
    return kept.select(*KEYS).distinct()


def manifests_of(facts: DataFrame) -> DataFrame:
    """The manifest of each version: package/package.json, else the first by path."""
    order = F.struct(c("path") != "package/package.json", c("path"))
    found = facts.filter(c("manifest").isNotNull() & c("name").isNotNull())
    return found.groupBy(*KEYS).agg(F.min_by("manifest", order).alias("manifest"))


def findings_of_facts(
    facts: DataFrame, manifests: DataFrame, config: ScanConfig | None = None
) -> DataFrame:
    """All findings of a scan: of files, manifests, packaging and their combinations."""
    config = config or ScanConfig()
    facts = facts.filter(c("name").isNotNull() & c("version").isNotNull())
    packaged = facts.filter(c("has_manifest") & c("is_file")).select(*KEYS, "path")
    in_files = facts.select(*KEYS, "path", F.inline(F.array_compact("found"))).select(
        *KEYS, "rule", "severity", c("path").alias("file_path"), "details"
    )
    typed = [
        ar.symlink_escapes(facts),
        ar.extraction_limit_findings(facts, config.max_extract_bytes),
        ar.no_manifest_findings(facts),
        typosquat_findings(mf.parse_manifests(manifests)),
        mf.npmrc_present(packaged),
        mf.lockfile_present(packaged),
        mf.hook_urls(manifests, config),
        mf.lifecycle_findings(manifests, config),
        mf.has_bin(manifests),
        mf.native_fetcher_in_scripts(manifests),
        mf.native_fetcher_custom_url(manifests),
    ]
    single = union_findings(in_files, *[to_findings(df) for df in typed])
    combined = cross_rule_findings(single, mf.risky_hooks(manifests, config))
    return union_findings(single, to_findings(combined))


def result_of(
    facts: DataFrame, manifests: DataFrame, findings: DataFrame, config: ScanConfig
) -> ScanResult:
    versions = scanned_versions(facts)
    return ScanResult(
        versions=versions,
        findings=findings,
        scores=score_versions(findings, config, versions),
        metadata=mf.package_metadata(manifests),
        rejects=ar.rejected_archives(facts),
    )


def scan_archives(
    members: DataFrame,
    config: ScanConfig | None = None,
    signatures: list[Signature] | None = None,
    rules: list[RuleSpec] | None = None,
    folder: str | None = None,
    archives: DataFrame | None = None,
    long_bytes: int = LONG_BYTES,
) -> ScanResult:
    """Scan archive members to the end: the whole batch job.

    ``archives`` are what the members were extracted from, where that is not a folder of files
    that can be read by the members' ``archive``; ``long_bytes`` is what they were extracted
    with.
    """
    config = config or ScanConfig()
    if rules:
        config = with_user_weights(config, rules)
    facts = written(scan_members(members, config, signatures, rules), "scan-facts", folder)
    facts = with_long_members(facts, archives, config, rules, folder, long_bytes=long_bytes)
    facts = one_archive_each(facts, folder)
    # Manifests are short and costly: as many files as there are cores, read by all of them, and
    # parsed once for all rules. (By the keys themselves they would count as dealt already.)
    cores = facts.sparkSession.sparkContext.defaultParallelism
    manifests = mf.parse_manifests(manifests_of(facts).repartition(cores, F.xxhash64(*KEYS)))
    manifests = written(manifests, "scan-manifests", folder)
    found = written(findings_of_facts(facts, manifests, config), "scan-findings", folder)
    result = result_of(facts, manifests, found, config)
    # Read several times by whoever stores them.
    versions = written(result.versions, "scan-versions", folder)
    scores = written(score_versions(found, config, versions), "scan-scores", folder)
    return replace(result, versions=versions, scores=scores)
