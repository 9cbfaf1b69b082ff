"""Rules that users add: a pattern, where to look, and a weight.

As with signatures, one index says which rules can match in a file at all, and one expression
serves all of them: the plan does not grow with the rules.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarsift import fixed_values as fv
from tarsift.config import ScanConfig
from tarsift.functions import text as tx
from tarsift.operators.file_rules import FILE_KEYS, finding, prepared
from tarsift.operators.pattern_index import PatternIndex


@dataclass(frozen=True)
class RuleSpec:
    """``pattern`` runs on the bytes of files with one of ``suffixes``; up to ``limit``
    distinct samples are kept."""

    name: str
    severity: str
    pattern: str
    weight: int = 0
    suffixes: tuple[str, ...] = tuple(fv.CODE_SUFFIXES)
    limit: int = 5
    explanation: str | None = None


def with_user_weights(config: ScanConfig, specs: list[RuleSpec]) -> ScanConfig:
    weights = {spec.name: spec.weight for spec in specs}
    return config.with_(user_weights={**config.user_weights, **weights})


def user_rule_pattern(spec: RuleSpec) -> str:
    return tx.byte_pattern(spec.pattern, nocase="(?i)" in spec.pattern)


def user_row(spec: RuleSpec, samples: Column, count: Column) -> Column:
    """The finding of a rule, from its distinct matches and the number of all."""
    explanation = F.lit(spec.explanation).cast("string")
    return _user_row(F.lit(spec.name), F.lit(spec.severity), explanation, samples, count)


def _user_row(name: Column, severity: Column, explanation: Column, samples: Column, count: Column) -> Column:
    shown = F.transform(samples, tx.utf8)
    row = finding(name, severity, samples=shown, match_count=count, explanation=explanation)
    return F.when(F.coalesce(count, F.lit(0)) > 0, row)


CANDIDATES = (
    "array<struct<name:string,severity:string,explanation:string,pattern:string,suffixes:array<string>,most:int>>"
)


def rule_candidates(specs: list[RuleSpec]) -> Column:
    """The rules whose pattern may occur in a file; see `pattern_index`. Best taken before a
    file's text is: rows that wait for Python carry the content alone."""
    patterns = [user_rule_pattern(spec) for spec in specs]
    index = PatternIndex(patterns)
    rows = [
        {
            "name": spec.name, "severity": spec.severity, "explanation": spec.explanation, "pattern": pattern,
            "suffixes": list(spec.suffixes), "most": spec.limit,
        }
        for spec, pattern in zip(specs, patterns, strict=True)
    ]

    @F.arrow_udf(CANDIDATES)
    def candidates(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        fields = [(key, pa.string()) for key in ("name", "severity", "explanation", "pattern")]
        kind = pa.list_(pa.struct([*fields, ("suffixes", pa.list_(pa.string())), ("most", pa.int32())]))
        for batch in batches:
            texts = (text.as_py() for text in batch)
            found = ([rows[k] for k in index.candidates(text)] if text is not None else None for text in texts)
            yield pa.array([some or None for some in found], kind)

    suffixes = sorted({s for spec in specs for s in spec.suffixes})
    return candidates(F.when(F.col("suffix").isin(*suffixes), F.col("content")))


def user_rows() -> Column:
    """array<struct<rule, severity, details>> over ``rule_candidates`` and ``body``."""

    def row(rule: Column) -> Column:
        looked_at = F.array_contains(rule["suffixes"], F.col("suffix"))
        found = F.when(looked_at, F.regexp_extract_all(F.col("body"), rule["pattern"], F.lit(0)))
        samples = lambda matches: F.slice(F.array_distinct(matches), F.lit(1), rule["most"])
        of = lambda matches: _user_row(
            rule["name"], rule["severity"], rule["explanation"], samples(matches), F.size(matches)
        )
        return tx.let(found, of)

    return F.array_compact(F.transform(F.col("rule_candidates"), row))


def apply_user_rules(files: DataFrame, specs: list[RuleSpec]) -> DataFrame:
    """Typed rows for all specs in one pass over the files."""
    suffixes = sorted({s for spec in specs for s in spec.suffixes})
    base = prepared(files).filter(F.col("suffix").isin(*suffixes))
    base = base.withColumn("rule_candidates", rule_candidates(specs))
    base = base.filter(F.col("rule_candidates").isNotNull()).withColumn("body", tx.byte_text(F.col("content")))
    return base.select(*FILE_KEYS, F.inline(F.array_compact(user_rows()))).select(
        "name", "version", "rule", "severity", "details.*"
    )
