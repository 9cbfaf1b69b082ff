"""Reading stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows over at least as many partitions as there are cores, by hash of ``keys``.

    For work that is heavy per row on input that came in fewer pieces than that, such as
    a file with a single row group. Input that is already split stays as it is. ``keys``
    should tell rows apart, so that no partition gets more than its share.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df
