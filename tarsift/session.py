"""Session construction and the settings the jobs rely on."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import SparkSession

# Correctness-relevant: timestamps in the stored tables are UTC; of a key that a manifest
# repeats the last value counts, where Spark would refuse the document.
REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.variant.allowDuplicateKeys": "true",
}

# Rows go to Python in batches of so many bytes, however many rows that is: what a worker holds
# does not grow with the rows of a task.
BATCH_BYTES = 4 << 20
REQUIRED["spark.sql.execution.arrow.maxBytesPerBatch"] = str(BATCH_BYTES)

# Worth having on any cluster; a value the deployment already chose is kept.
RECOMMENDED = {
    # Rules are built from many small column calls; recording the call site of each one
    # costs more than building them.
    "spark.sql.dataFrameQueryContext.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def ship_with_tasks(module: str) -> None:
    """Send the functions of a module to the workers by value, so that executors need no
    installed copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings to a session that somebody else built."""
    for key, value in REQUIRED.items():
        spark.conf.set(key, value)
    return spark


def build_session(app: str = "tarsift", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RECOMMENDED, **REQUIRED, **extra}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def checkpoint_folder(spark: SparkSession, fallback: str | None = None) -> str:
    """The shared folder the cluster names; ``fallback`` only where it names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or fallback
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    return folder.rstrip("/")
