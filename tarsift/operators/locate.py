"""Where in its file a pattern matches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarsift.functions import text as tx
from tarsift.operators.file_rules import FILE_KEYS, prepared


def locate_matches(files: DataFrame, pattern: str, count: int = 5) -> DataFrame:
    """The first ``count`` matches per file with line, column (in bytes) and snippet."""
    base = prepared(files).withColumn("body", tx.byte_text(F.col("content")))
    base = base.withColumn("found", tx.all_matches(F.col("body"), pattern))
    located = tx.first_locations(F.col("content"), F.col("body"), pattern, F.col("found"), count)
    return base.select(*FILE_KEYS, F.posexplode(F.array_compact(located)).alias("i", "at")).select(
        *FILE_KEYS, (F.col("i") + 1).alias("i"), "at.line", "at.column", "at.match", "at.snippet"
    )
