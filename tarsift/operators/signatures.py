"""Matching a table of signatures against a table of files.

Signatures are a driver-side list of any length. One index of literal fragments serves all of
them (`pattern_index`): a file meets it once, and what comes back is the strings that can occur
in it, with their signatures. Only these are matched, by one expression for all: the plan is the
same for ten signatures and for ten thousand.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarsift import fixed_values as fv
from tarsift.config import ScanConfig
from tarsift.functions import text as tx
from tarsift.operators.file_rules import FILE_KEYS, prepared
from tarsift.operators.pattern_index import PatternIndex
from tarsift.operators.scoring import score_versions

c, lit = F.col, F.lit

SHOWN, CONTEXT = 5, 100


@dataclass(frozen=True)
class SignatureString:
    """A text or a regular expression to look for in the bytes of a file."""

    identifier: str
    value: str
    is_regex: bool = False
    nocase: bool = False

    @property
    def pattern(self) -> str:
        if self.is_regex:
            body = tx.byte_pattern(self.value, self.nocase)
        else:
            plain = [re.escape(char) if char.isascii() else char for char in self.value]
            body = tx.byte_pattern("".join(plain), self.nocase)
        return ("(?i)" if self.nocase else "") + body


@dataclass(frozen=True)
class Signature:
    """``needed`` of the strings must occur; None asks for all of them."""

    rule: str
    strings: tuple[SignatureString, ...]
    needed: int | None = 1
    tags: tuple[str, ...] = ()
    meta: dict[str, str] = field(default_factory=dict)


def severity_of_tags(tags: Column) -> Column:
    low = F.transform(tags, F.lower)
    overlap = lambda known: F.arrays_overlap(low, F.array(*[lit(t) for t in known]))
    return (
        F.when(overlap(fv.HIGH_TAGS), lit("high"))
        .when(overlap(fv.MEDIUM_TAGS), lit("medium"))
        .otherwise(lit("low"))
    )


CANDIDATES = (
    "array<struct<rule:string,tags:array<string>,meta:map<string,string>,needed:int,"
    "strings:array<struct<identifier:string,pattern:string>>>>"
)


def signature_candidates(signatures: list[Signature], config: ScanConfig) -> Column:
    """The signatures of which enough strings may occur in a file, with those strings.

    Best taken before a file's text is: rows that wait for Python carry the content alone."""
    needed = [len(s.strings) if s.needed is None else s.needed for s in signatures]
    strings = [(k, s.identifier, s.pattern) for k, one in enumerate(signatures) for s in one.strings]
    index = PatternIndex([pattern for _, _, pattern in strings])
    plain = [(s.rule, list(s.tags), list(s.meta.items())) for s in signatures]
    always = [k for k, n in enumerate(needed) if n <= 0]

    @F.arrow_udf(CANDIDATES)
    def candidates(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(
            pa.struct(
                [
                    ("rule", pa.string()), ("tags", pa.list_(pa.string())), ("meta", pa.map_(pa.string(), pa.string())),
                    ("needed", pa.int32()),
                    ("strings", pa.list_(pa.struct([("identifier", pa.string()), ("pattern", pa.string())]))),
                ]
            )
        )

        def of(text: bytes | None) -> list[dict] | None:
            if text is None:
                return None
            found: dict[int, list[dict]] = {k: [] for k in always}
            for k in index.candidates(text):
                signature, identifier, pattern = strings[k]
                found.setdefault(signature, []).append({"identifier": identifier, "pattern": pattern})
            return [
                dict(zip(("rule", "tags", "meta"), plain[k]), needed=needed[k], strings=found[k])
                for k in sorted(found)
                if len(found[k]) >= needed[k]
            ] or None

        for batch in batches:
            yield pa.array([of(text.as_py()) for text in batch], kind)

    small_enough = c("size") <= config.signature_max_mb * 1024 * 1024
    return candidates(F.when(small_enough, c("content")))


def _matched_strings(string: Column) -> Column:
    """Every match of one string with its place in the file."""

    def of(matches: Column) -> Column:
        steps = tx.match_steps(F.split(c("body"), string["pattern"], lit(-1)), matches)
        return F.zip_with(
            tx.match_positions(steps),
            matches,
            lambda place, value: F.struct(
                place["offset"].alias("offset"),
                string["identifier"].alias("identifier"),
                place["line"].alias("line_number"),
                F.length(value).alias("data_length"),
                value.alias("value"),
            ),
        )

    found = F.regexp_extract_all(c("body"), string["pattern"], lit(0))
    return tx.let(found, lambda matches: F.when(tx.has(matches), of(matches)))


def _shown(match: Column) -> Column:
    begin = F.greatest(match["offset"] - CONTEXT, lit(0))
    stop = match["offset"] + match["data_length"] + CONTEXT
    context = F.left(tx.clean_text(F.substring(c("content"), begin + 1, stop - begin)), lit(300))
    data = F.left(tx.utf8(match["value"]), lit(200))
    shorten = lambda text, size, short: F.when(F.length(text) > size, short).otherwise(text)
    return F.struct(
        match["identifier"].alias("identifier"),
        match["offset"].alias("offset"),
        match["line_number"].alias("line_number"),
        shorten(data, 150, F.concat(F.left(data, lit(150)), lit("..."))).alias("matched_data"),
        match["data_length"].alias("data_length"),
        shorten(
            context, 250, F.concat(lit("..."), F.substring(context, -247, 247))
        ).alias("context"),
    )


def _signature_row(signature: Column) -> Column:
    """A struct where the file satisfies the signature, NULL elsewhere."""

    def of(matched: Column) -> Column:
        places = tx.let(
            F.array_sort(F.flatten(matched)),
            lambda all_matches: F.struct(
                F.size(all_matches).alias("match_count"),
                F.transform(F.slice(all_matches, 1, SHOWN), _shown).alias("matched_strings"),
            ),
        )
        return F.when(
            F.size(matched) >= signature["needed"],
            F.struct(
                signature["rule"].alias("yara_rule"),
                signature["tags"].alias("yara_tags"),
                signature["meta"].alias("yara_metadata"),
                severity_of_tags(signature["tags"]).alias("severity"),
                places.alias("places"),
            ),
        )

    return tx.let(F.array_compact(F.transform(signature["strings"], _matched_strings)), of)


def _typed(row: Column) -> Column:
    """The details of a match, next to its severity."""
    file_name = F.substring_index(c("path"), "/", -1)
    tags = row["yara_tags"]
    shown_tags = F.when(F.size(tags) > 0, F.array_join(F.slice(tags, 1, 5), ", ")).otherwise(
        lit("suspicious")
    )
    described = F.coalesce(
        F.try_element_at(row["yara_metadata"], lit("description")),
        lit("No description available"),
    )
    matched = row["places"]["matched_strings"]
    line = F.get(matched, lit(0))["line_number"].cast("string")
    explanation = F.concat(
        F.format_string(fv.EXPLAIN["yara_match"], row["yara_rule"], file_name),
        F.coalesce(F.concat(lit(" at line "), line), lit("")),
        lit(". Pattern type: "), shown_tags, lit(". "), described,
    )
    return F.struct(
        lit("yara_match").alias("rule"),
        row["severity"].alias("severity"),
        F.struct(
            c("path").alias("path"),
            file_name.alias("file_name"),
            c("size").alias("file_size_bytes"),
            row["yara_rule"].alias("yara_rule"),
            tags.alias("yara_tags"),
            row["yara_metadata"].alias("yara_metadata"),
            matched.alias("matched_strings"),
            row["places"]["match_count"].alias("match_count"),
            explanation.alias("explanation"),
        ).alias("details"),
    )


def signature_rows() -> Column:
    """array<struct<rule, severity, details>> over ``candidates``, ``body`` and ``content``."""
    rows = F.array_compact(F.transform(c("candidates"), _signature_row))
    return F.transform(rows, _typed)


def scan_signatures(
    files: DataFrame, signatures: list[Signature], config: ScanConfig | None = None
) -> DataFrame:
    """One row per (file, signature), typed."""
    base = prepared(files)
    base = base.withColumn("candidates", signature_candidates(signatures, config or ScanConfig()))
    base = base.filter(c("candidates").isNotNull()).withColumn("body", tx.byte_text(c("content")))
    return base.select(*FILE_KEYS, F.inline(F.array_compact(signature_rows()))).select(
        "name", "version", "rule", "severity", "details.*"
    )


FINDING_KEY = ["name", "version", "rule", "file_path", "signature"]


def append_signature_findings(
    findings: DataFrame,
    found: DataFrame,
    versions: DataFrame,
    stored: Callable[[DataFrame], DataFrame] = lambda added: added,
) -> DataFrame:
    """Findings with the signature findings of known versions added, each only once.

    Both inputs are findings tables. A rerun adds nothing: rows already present are
    recognised by (version, rule, path, signature). Whoever reads the result more than once
    writes the added rows down by ``stored``, so that they are looked for once.
    """
    signature = F.get_json_object("details", "$.yara_rule")
    keyed = lambda df: df.withColumn("signature", F.coalesce(signature, lit(""))).withColumn(
        "file_path", F.coalesce("file_path", lit(""))
    )
    known = keyed(found).join(versions.select("name", "version"), ["name", "version"], "left_semi")
    present = keyed(findings.filter(c("rule") == "yara_match")).select(*FINDING_KEY).distinct()
    fresh = known.dropDuplicates(FINDING_KEY).join(present, FINDING_KEY, "left_anti")
    return findings.unionByName(stored(fresh.select(*findings.columns)))


def rescore(
    findings: DataFrame, scores: DataFrame, touched: DataFrame, config: ScanConfig | None = None
) -> DataFrame:
    """Scores with those of the touched versions computed anew. Findings are summed up where
    they are read; to find the touched among them first would move each with its details."""
    keys = ["name", "version"]
    touched = touched.select(*keys).distinct()
    fresh = score_versions(findings, config, touched)
    return scores.join(touched, keys, "left_anti").unionByName(fresh)
