"""Timestamps that come as ISO text or as epoch seconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_timestamp(value: Column) -> Column:
    """ISO text or epoch seconds as a timestamp; anything else is NULL."""
    text = value.cast("string")
    epoch = F.timestamp_seconds(text.try_cast("double"))
    # A bare number is epoch seconds, not a year.
    return F.when(text.rlike(r"^\s*[+-]?\d+(\.\d+)?\s*$"), epoch).otherwise(
        F.try_to_timestamp(text)
    )
