"""How file rules are declared and run.

A rule says which files it looks at, which features of a file it needs, and how the
features become rows. Features are columns in layers: matches first, then positions,
then whatever is built on those. Running rules means one projection per layer over the
files table and one ``inline`` at the end. Content never takes part in a shuffle, and
features that several rules need (URLs) are computed once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarsift.config import ScanConfig
from tarsift.functions import text as tx

FILE_KEYS = ["name", "version", "path"]
FINDING_COLUMNS = ["name", "version", "rule", "severity", "file_path", "details"]


@dataclass(frozen=True)
class Feature:
    layer: int
    build: Callable[[ScanConfig], Column]


@dataclass(frozen=True)
class Located:
    """Locations of the first ``count`` matches of a pattern in the file's bytes; None: of all.

    ``matches`` and ``shown`` name features: the matches, and what to show of each.
    ``in_context`` says that the pattern looks at what surrounds a match.
    """

    pattern: str
    matches: str
    shown: str | None = None
    count: int | None = 5
    in_context: bool = False


# Locations come after all matches are there.
LOCATED_LAYER = 4


@dataclass(frozen=True)
class FileRule:
    """``rows`` builds array<struct<rule, severity, details struct>> (NULL for none)."""

    key: str
    applies: Callable[[ScanConfig], Column]
    needs: tuple[str, ...]
    rows: Callable[[ScanConfig], Column]


def row(when: Column, rule: str | Column, severity: str | Column, **details: Column) -> Column:
    """A single finding of a file, where the condition holds."""
    return F.when(when, F.array(finding(rule, severity, **details)))


def finding(rule: str | Column, severity: str | Column, **details: Column) -> Column:
    named = [value.alias(field) for field, value in details.items()]
    return F.struct(
        _text(rule).alias("rule"),
        _text(severity).alias("severity"),
        F.struct(F.col("path").alias("path"), *named).alias("details"),
    )


def _text(value: str | Column) -> Column:
    return F.lit(value) if isinstance(value, str) else value


def with_features(
    files: DataFrame,
    features: dict[str, Feature | Located],
    needed: Iterable[str],
    config: ScanConfig,
) -> DataFrame:
    """Add the needed features, layer by layer.

    A feature that later layers use more than once stays in a projection of its own, so
    it is computed once per file.
    """
    wanted = set(needed)
    plain = {k: f for k, f in features.items() if k in wanted and isinstance(f, Feature)}
    located = {k: f for k, f in features.items() if k in wanted and isinstance(f, Located)}
    layers = {f.layer for f in plain.values()} | ({LOCATED_LAYER} if located else set())
    for layer in sorted(layers):
        added = [f.build(config).alias(k) for k, f in plain.items() if f.layer == layer]
        if layer == LOCATED_LAYER and located:
            added.append(_locations_of(list(located.values())).alias("located"))
        files = files.select("*", *added)
        if layer == LOCATED_LAYER and located:
            each = [F.get("located", F.lit(i)).alias(k) for i, k in enumerate(located)]
            files = files.select("*", *each)
    return files


def _locations_of(located: list[Located]) -> Column:
    """One array of locations per entry, all of them from a single expression."""

    def input_of(item: Located) -> Column:
        first = lambda values: values if item.count is None else F.slice(values, 1, item.count)
        found = first(F.col(item.matches))
        if item.in_context:
            gaps = F.split(F.col("body"), item.pattern, -1 if item.count is None else item.count + 1)
        else:
            gaps = tx.gaps_by_text(F.col("body"), found)
        return F.when(
            tx.has(F.col(item.matches)),
            F.struct(
                found.alias("found"),
                first(F.col(item.shown or item.matches)).alias("shown"),
                gaps.alias("between"),
            ),
        )

    def of(entry: Column) -> Column:
        places = tx.match_positions(tx.match_steps(entry["between"], entry["found"]))
        shown = F.transform(entry["shown"], tx.utf8)
        return F.when(entry.isNotNull(), tx.locations(F.col("content"), places, shown))

    return F.transform(F.array(*[input_of(item) for item in located]), of)


def prepared(files: DataFrame) -> DataFrame:
    """A files table with the columns rules read: suffix and size are derived if absent."""
    if "suffix" not in files.columns:
        files = files.withColumn("suffix", tx.suffix_of(F.col("path")))
    if "size" not in files.columns:
        files = files.withColumn("size", F.octet_length("content").cast("bigint"))
    return files.select(*FILE_KEYS, "suffix", "size", "content")


def rule_frame(
    files: DataFrame,
    rule: FileRule,
    features: dict[str, Feature | Located],
    config: ScanConfig,
) -> DataFrame:
    """One rule as a typed frame: file keys, rule, severity and the detail columns."""
    base = prepared(files).filter(rule.applies(config))
    base = with_features(base, features, rule.needs, config)
    # array_compact keeps the generator input an expression: over a bare column Spark
    # infers a size filter, pushes it down and evaluates the rule twice.
    rows = base.select(*FILE_KEYS, F.inline(F.array_compact(rule.rows(config))))
    return rows.select("name", "version", "rule", "severity", "details.*")


FOUND = "array<struct<rule:string,severity:string,details:string>>"


def with_found(
    base: DataFrame,
    rules: Iterable[FileRule],
    features: dict[str, Feature | Located],
    config: ScanConfig,
    more: Iterable[Column] = (),
) -> DataFrame:
    """The rows of ``base`` without content, with what was found as an array ``found``.

    ``more`` are further columns of the same array type, over ``body`` and ``low``.
    """
    rules = list(rules)
    columns = [col for col in base.columns if col != "content"]
    needed = {key for rule in rules for key in rule.needs} | {"body", "low"}
    featured = with_features(base, features, needed, config)
    per_rule = [
        F.when(rule.applies(config), F.transform(rule.rows(config), as_found)) for rule in rules
    ]
    empty = F.array().cast(FOUND)
    merged = [F.coalesce(rows, empty) for rows in [*per_rule, *more]]
    return featured.select(*columns, F.concat(*merged).alias("found"))


def findings_of(
    files: DataFrame,
    rules: Iterable[FileRule],
    features: dict[str, Feature | Located],
    config: ScanConfig,
) -> DataFrame:
    """Many rules in one pass over the files, as findings with JSON details."""
    found = with_found(prepared(files), rules, features, config)
    return found.select(*FILE_KEYS, F.inline(F.array_compact("found"))).select(
        "name", "version", "rule", "severity", F.col("path").alias("file_path"), "details"
    )


def as_found(item: Column) -> Column:
    return F.struct(
        item["rule"].alias("rule"),
        item["severity"].alias("severity"),
        F.to_json(item["details"]).alias("details"),
    )
