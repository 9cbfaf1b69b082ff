"""The queue worker as a stream, and live reports.

Delivery is at least once: a batch may come again after a failure. Every batch therefore
writes the partitions of its own id, which a second delivery replaces by the same rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from tarsift import __version__
from tarsift.config import ScanConfig
from tarsift.functions.timestamps import parse_timestamp
from tarsift.operators.queue_building import skip_analyzed
from tarsift.operators.signatures import Signature
from tarsift.plans.scan import scan_archives, written
from tarsift.plans.store import Store, exists
from tarsift.sources.archives import archive_files, archive_path, extract_members
from tarsift.sources.unpack import MISSING
from tarsift.streaming.messages import told_apart

c, lit = F.col, F.lit
KEYS = ["name", "version"]


# A message whose archive is not there is tried so many times; then it stays in the rejects.
MAX_ATTEMPTS = 5


def fresh_messages(
    messages: DataFrame, versions: DataFrame | None = None, delay: str | None = None
) -> DataFrame:
    """Queue messages, each version once, without analysed ones.

    State is one entry per version. Without ``delay`` none is forgotten and no message comes
    too late; with it an entry is dropped once the watermark has passed it, and so are later
    messages.
    """
    timed = messages.withColumn("queued_at", parse_timestamp(c("queued_at")))
    if delay is None:
        once = timed.dropDuplicates(KEYS)
    else:
        once = timed.withWatermark("queued_at", delay).dropDuplicatesWithinWatermark(KEYS)
    return once if versions is None else skip_analyzed(once, versions)


def daily_activity(versions: DataFrame) -> DataFrame:
    """Analysed versions and their findings by day and package."""
    findings = c("findings") if "findings" in versions.columns else lit(None)
    return (
        versions.filter(c("analyzed_at").isNotNull())
        .groupBy(F.to_date("analyzed_at").alias("date"), "name")
        .agg(F.count("*").alias("versions"), F.coalesce(F.sum(findings.cast("bigint")), lit(0)).alias("findings"))
    )


def write_daily(versions: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """The daily report of a stream of analysed versions, without state.

    Each batch leaves its own sums by day and package, in folders by step and day; a batch that
    is delivered again replaces its step. Sums add up (`daily_totals`), so no day has to be held
    open: a row that comes late, however late, is one more sum of its day.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        sums = daily_activity(batch)
        sums.write.mode("overwrite").partitionBy("date").parquet(f"{path}/step={batch_id}")

    return versions.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)


DAILY_SCHEMA = "name string, versions bigint, findings bigint, step bigint, date date"


def daily_totals(
    spark: SparkSession, path: str, first: str | None = None, last: str | None = None
) -> DataFrame:
    """Versions, packages and findings per day, from what `write_daily` wrote: of all days, or
    of those from ``first`` to ``last``, whose folders alone are then read."""
    sums = spark.read.schema(DAILY_SCHEMA).parquet(path)
    if first is not None:
        sums = sums.filter(c("date") >= lit(first).cast("date"))
    if last is not None:
        sums = sums.filter(c("date") <= lit(last).cast("date"))
    by_package = sums.groupBy("date", "name").agg(F.sum("versions").alias("versions"), F.sum("findings").alias("findings"))
    return by_package.groupBy("date").agg(
        F.sum("versions").alias("versions"),
        F.count("*").alias("packages"),
        F.sum("findings").alias("findings"),
    )


def downloaded(spark: SparkSession, folder: str) -> Callable[[DataFrame], DataFrame]:
    """Archives by their place under a download folder on any Hadoop file system.

    Where an archive lies follows from name and version: just the batch's places are asked for,
    however many archives the folder holds. Places without an archive come without content.
    """

    def opened(wanted: DataFrame) -> DataFrame:
        paths = wanted.select(archive_path(folder, c("name"), c("version")).alias("path")).distinct()
        places = [row["path"] for row in paths.toLocalIterator()]
        there = [place for place in places if exists(spark, place)]
        gone = [(place,) for place in set(places) - set(there)]
        missing = spark.createDataFrame(gone, "path string").select(
            "path", lit(None).cast("bigint").alias("length"), lit(None).cast("binary").alias("content")
        )
        return archive_files(spark, there, "*").unionByName(missing) if there else missing

    return opened


def out_of_table(archives: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Archives out of a table (name, version, path, content), without content where it has none.

    Contents move once and are not sorted. There are several pieces a core and the adaptive
    planner joins none of them: what comes next, unpacking and all rules, is long for few bytes.
    """
    cores = archives.sparkSession.sparkContext.defaultParallelism
    pieces = max(4 * cores, archives.rdd.getNumPartitions())

    def opened(wanted: DataFrame) -> DataFrame:
        asked = wanted.repartition(pieces, *KEYS).hint("shuffle_hash")
        path = F.coalesce("path", archive_path("downloads", c("name"), c("version")))
        dealt = archives.repartition(pieces, *KEYS)
        return dealt.join(asked, KEYS, "right").select(path.alias("path"), "content")

    return opened


def once_each(messages: DataFrame) -> DataFrame:
    """One message per version: the one queued last."""
    whole = F.struct(*messages.columns)
    order = F.struct(parse_timestamp(c("queued_at")), whole) if "queued_at" in messages.columns else whole
    return messages.groupBy(*KEYS).agg(F.max_by(whole, order).alias("m")).select("m.*")


def analyse_batch(
    store: Store,
    batch: DataFrame,
    commit: int,
    open_archives: Callable[[DataFrame], DataFrame],
    config: ScanConfig | None = None,
    signatures: list[Signature] | None = None,
    folder: str | None = None,
    requeue: str | None = None,
) -> None:
    """Scan the archives of one batch of queue messages and store the result.

    ``open_archives`` turns (name, version) into (path, content), without content where there
    is no archive. Rejected archives are stored with the commit. Messages whose archive is
    missing go back to the queue folder ``requeue`` with their attempts counted; a batch that is
    delivered again may send them twice, which the next batch's `once_each` makes good. What is
    known is what commits before this one stored, so a second delivery does the same work.
    """
    config = config or ScanConfig()
    messages = skip_analyzed(once_each(batch), store.current("versions", batch.select(*KEYS), commit))
    # Read for the archives, the rejects and the runs: the batch is read and narrowed down once.
    messages = written(messages, "messages", folder)
    members = extract_members(open_archives(messages.select(*KEYS)), config.max_extract_bytes)
    started = lit(datetime.now(timezone.utc)).cast("timestamp")
    result = scan_archives(members, config, signatures, folder=folder)
    if requeue:
        tries = F.coalesce(c("attempts"), lit(0)) if "attempts" in messages.columns else lit(0)
        gone = result.rejects.filter(c("status") == MISSING).select(*KEYS).distinct()
        again = messages.join(gone, KEYS, "left_semi").withColumn("attempts", (tries + 1).cast("int"))
        # Few rows are one file; the join before that is not one task's work.
        again.filter(c("attempts") < MAX_ATTEMPTS).hint("rebalance").write.mode("append").json(requeue)
    store.merge_scan(
        commit, result, messages=messages, source="queue", started_at=started,
        analyzer_version=__version__, config_hash=hashlib.sha256(repr(config).encode()).hexdigest()[:16],
        findings_s3_key=f"{store.root}/findings/commit={commit}",
    )


def analyse_worker(
    messages: DataFrame,
    store: Store,
    open_archives: Callable[[DataFrame], DataFrame],
    checkpoint: str,
    config: ScanConfig | None = None,
    signatures: list[Signature] | None = None,
    folder: str | None = None,
    requeue: str | None = None,
    first_commit: int = 0,
    keep: timedelta | None = None,
) -> DataStreamWriter:
    """The continuous worker. Choose a trigger and start the writer that comes back.

    Batches are commits from ``first_commit`` on. With ``keep`` messages of versions that were
    asked for within that time are left out before their batch is looked at (`told_apart`);
    what was queued again for a missing archive passes. Such a stream always has a next batch,
    so it takes a time trigger and not availableNow.
    """
    if keep is not None:
        messages = told_apart(messages, keep)

    def run(batch: DataFrame, batch_id: int) -> None:
        if keep is not None:
            # Written down first: the batch is read several times, its state is asked once.
            tried = F.coalesce(c("attempts"), lit(0)) if "attempts" in batch.columns else lit(0)
            batch = batch.filter((c("kind") != "repeat") | (tried > 0)).drop("kind")
            batch = written(batch, "messages", folder)
            if batch.isEmpty():
                return
        commit = first_commit + batch_id
        analyse_batch(store, batch, commit, open_archives, config, signatures, folder, requeue)

    return messages.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)


def follow_changes(changes: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Names of a change feed into a queue folder; the checkpoint is the position."""
    return (
        changes.writeStream.format("json")
        .option("checkpointLocation", checkpoint)
        .option("path", path)
        .outputMode("append")
    )


def run_available(writer: DataStreamWriter) -> StreamingQuery:
    """Process what is there, then stop."""
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query
