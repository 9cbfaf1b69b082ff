"""The common findings table: typed rule frames in, one schema out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarsift.operators.file_rules import FINDING_COLUMNS

FINDING_SCHEMA = (
    "name string, version string, rule string, severity string, file_path string, details string"
)
KEYS = ["name", "version", "rule", "severity"]


def to_findings(typed: DataFrame) -> DataFrame:
    """Wrap the detail columns of a typed rule frame as JSON."""
    details = [col for col in typed.columns if col not in KEYS]
    path = F.col("path") if "path" in details else F.lit(None).cast("string")
    wrapped = F.to_json(F.struct(*details)) if details else F.lit("{}")
    return typed.select(*KEYS, path.alias("file_path"), wrapped.alias("details"))


def union_findings(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), [f.select(*FINDING_COLUMNS) for f in frames])


def detail(path: str) -> Column:
    """A field of the details; an array or object comes as its JSON text."""
    return F.get_json_object(F.col("details"), f"$.{path}")


def detail_as(path: str, kind: str) -> Column:
    """A typed field of the details, NULL where the text is not of that type."""
    return detail(path).try_cast(kind)
