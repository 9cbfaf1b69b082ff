"""Stored tables on plain Parquet: a folder for each table, partitioned by commit.

A merge writes the rows of what it touched, and nothing else, into its commit's partitions,
replacing what an earlier try of the same commit left there. A batch that is delivered again
therefore changes nothing, and no log has to say so: a merge reads only commits before its own,
so a second run sees what the first one saw.

Readers take the latest row of each key, by one `max_by` over the commit. Of findings and scores
the rows of the latest scan of their version count, which the small ``scans`` table names; it is
written last, so a merge that broke off shows none of its findings. Commits are ordered by their
number: a stream uses its batch ids, a batch job any number above those before it.

Files pile up by commit; gathering them is left to the user's table format.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarsift.plans import merge
from tarsift.plans.scan import ScanResult

c, lit = F.col, F.lit

VERSION_KEYS = ["name", "version"]
SCHEMAS = {
    "packages": (
        "name string, ecosystem string, author string, description string, dependents int, "
        "last_seen timestamp, created_at timestamp"
    ),
    "versions": (
        "name string, version string, tarball_url string, integrity string, shasum string, "
        "published_at timestamp, analyzed_at timestamp, status string"
    ),
    "findings": (
        "name string, version string, rule string, severity string, file_path string, "
        "details string"
    ),
    "scores": "name string, version string, score int, label string",
    "scan_runs": merge.RUN_SCHEMA,
    "scan_run_findings": (
        "name string, version string, rule string, severity string, file_path string, "
        "details string, completed_at timestamp"
    ),
    "rejects": "archive string, name string, version string, status string, completed_at timestamp",
    # Which versions a commit scanned: of findings and scores the last scan's rows count.
    "scans": "name string, version string",
}
ROW_KEYS = {"packages": ["name"], "versions": VERSION_KEYS, "scans": VERSION_KEYS}
# Findings repeat themselves, and each is stored with its run, too.
CODEC = "zstd"
OF_LAST_SCAN = ("findings", "scores")


@dataclass(frozen=True)
class Store:
    spark: SparkSession
    root: str

    # --- reading

    def _rows(self, table: str, keys: DataFrame | None, before: int | None) -> DataFrame:
        """All stored rows with their commit; of some keys, or of earlier commits only."""
        schema, path = f"{SCHEMAS[table]}, commit bigint", f"{self.root}/{table}"
        if not exists(self.spark, path):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(path)
        if before is not None:
            rows = rows.filter(c("commit") < before)
        if keys is None:
            return rows
        by = ROW_KEYS.get(table, VERSION_KEYS)
        return rows.join(keys.select(*by).distinct(), by, "left_semi")

    def current(self, table: str, keys: DataFrame | None = None, before: int | None = None) -> DataFrame:
        """The current rows of a table, or those of some keys (a frame that has them); as of
        the commits before one."""
        return self._current(table, keys, before).drop("commit")

    def _current(self, table: str, keys: DataFrame | None, before: int | None) -> DataFrame:
        rows = self._rows(table, keys, before)
        if table in OF_LAST_SCAN:
            return rows.join(self._current("scans", keys, before), [*VERSION_KEYS, "commit"], "left_semi")
        if table not in ROW_KEYS:
            return rows
        whole = F.struct(*rows.columns)
        return rows.groupBy(*ROW_KEYS[table]).agg(F.max_by(whole, "commit").alias("r")).select("r.*")

    def history(self, table: str) -> DataFrame:
        """The rows of all commits."""
        return self.current(table)

    # --- merges

    def _write(self, commit: int, tables: dict[str, DataFrame]) -> None:
        """Rows of a commit, each table's in its partition, in the order of SCHEMAS."""
        for table in (t for t in SCHEMAS if t in tables):
            names = [part.split()[0] for part in SCHEMAS[table].split(", ")]
            # Rows do not move to be written. They come out of a shuffle, whose small partitions
            # the adaptive planner joins, or out of a table, whose small files one task reads.
            rows = tables[table].select(*names)
            rows.write.mode("overwrite").parquet(f"{self.root}/{table}/commit={commit}", compression=CODEC)

    def merge_scan(
        self,
        commit: int,
        result: ScanResult,
        at: Column | None = None,
        messages: DataFrame | None = None,
        **run_details,
    ) -> None:
        """Store a scan.

        ``messages`` are the queue's messages, a row per version at most: what they say of a
        run (queued_at, source, rerun_reason, ...) is kept with it.
        """
        at = _now() if at is None else at
        scanned = result.versions
        people = scanned.join(result.metadata, VERSION_KEYS, "left")
        runs = merge.scan_run_rows(result.scores, result.findings, at, messages, **run_details)
        self._write(
            commit,
            {
                "packages": merge.upsert_packages(self.current("packages", scanned, commit), people, at),
                "versions": merge.upsert_versions(self.current("versions", scanned, commit), scanned, at),
                "findings": merge.sanitized(result.findings),
                "scores": result.scores,
                "scan_runs": runs,
                "scan_run_findings": merge.scan_run_findings(result.findings, at),
                "rejects": result.rejects.withColumn("completed_at", at),
                "scans": scanned.select(*VERSION_KEYS).distinct(),
            },
        )

    def merge_queue(self, commit: int, queued: DataFrame, at: Column | None = None) -> None:
        """Record queued versions: new ones as queued, known ones refreshed."""
        from tarsift.operators.queue_building import upsert_queued

        at = _now() if at is None else at
        people = queued.select(
            *VERSION_KEYS,
            lit(None).cast("string").alias("author"),
            lit(None).cast("string").alias("description"),
        )
        self._write(
            commit,
            {
                "packages": merge.upsert_packages(self.current("packages", queued, commit), people, at),
                "versions": upsert_queued(self.current("versions", queued, commit), queued),
            },
        )


def _now() -> Column:
    """One moment for everything a commit writes."""
    return lit(datetime.now(timezone.utc)).cast("timestamp")


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
