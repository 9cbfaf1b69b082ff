"""Queue records, seeds, registry documents and feeds as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

c, lit = F.col, F.lit

QUEUE_SCHEMA = (
    "name string, version string, tarball string, integrity string, shasum string, "
    "published_at string, meta_head string, queued_at string, source string, fetched_at string, "
    "rerun_reason string, requested_by string, attempts int"
)
CHANGE_SCHEMA = "seq string, id string, deleted boolean"
LISTING_SCHEMA = "id string, key string"
DOCUMENT_SCHEMA = (
    "`dist-tags` map<string,string>, "
    "versions map<string,struct<dist:struct<tarball:string,integrity:string,shasum:string>>>, "
    "time map<string,string>"
)


def read_queue(spark: SparkSession, path: str) -> DataFrame:
    """Queue records from NDJSON; blank lines are skipped."""
    return spark.read.schema(QUEUE_SCHEMA).json(path).filter(c("name").isNotNull())


def stream_queue(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """The queue as a stream; ``files_per_batch`` bounds what one batch takes in."""
    reader = spark.readStream.schema(QUEUE_SCHEMA)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path).filter(c("name").isNotNull())


def write_queue(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)


def parse_seeds(spark: SparkSession, listed: str | None = None, path: str | None = None) -> DataFrame:
    """Names from a comma list and a one-per-line file, trimmed, each once."""
    listed_names = spark.createDataFrame([(listed or "",)], "value string").select(
        F.explode(F.split("value", ",")).alias("name")
    )
    names = listed_names
    if path:
        names = names.unionByName(spark.read.text(path).select(c("value").alias("name")))
    trimmed = F.regexp_replace("name", r"^\s+|\s+$", "")
    return names.select(trimmed.alias("name")).filter(c("name") != "").distinct()


def parse_documents(documents: DataFrame) -> DataFrame:
    """Registry documents (name, doc JSON) with typed maps; unreadable ones drop out."""
    parsed = documents.select("name", F.from_json("doc", DOCUMENT_SCHEMA).alias("d"))
    return parsed.filter(c("d").isNotNull()).select(
        "name",
        c("d.dist-tags").alias("dist_tags"),
        c("d.versions").alias("versions"),
        c("d.time").alias("time"),
    )


def live_changes(changes: DataFrame) -> DataFrame:
    """Names from a change feed without the deleted ones."""
    return changes.filter(~F.coalesce("deleted", lit(False))).select(c("id").alias("name"))


def listed_names(listing: DataFrame) -> DataFrame:
    """Names from a package listing without design documents."""
    name = F.coalesce(F.nullif("id", lit("")), F.nullif("key", lit("")))
    return listing.select(name.alias("name")).filter(
        c("name").isNotNull() & ~F.startswith("name", lit("_design/"))
    )


def stream_changes(spark: SparkSession, path: str) -> DataFrame:
    """A change feed landed as JSON files. The checkpoint holds the position."""
    return live_changes(spark.readStream.schema(CHANGE_SCHEMA).json(path))
