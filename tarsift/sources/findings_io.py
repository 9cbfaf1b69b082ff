"""Finding documents: JSON out and back in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

c, lit = F.col, F.lit

FINDING = "struct<rule:string,severity:string,file_path:string,details:string>"
DOCUMENT_SCHEMA = f"tgz string, part int, findings array<{FINDING}>"
SIGNATURE_DOCUMENT_SCHEMA = (
    "package struct<name:string,version:string>, scanner string, part int, "
    f"findings array<{FINDING}>, scan_time double"
)
FACTS = ["rule", "severity", "file_path", "details"]
# A version gets a document for each so many findings.
DOCUMENT_FINDINGS = 5000


def _parts(findings: DataFrame, size: int) -> DataFrame:
    """One row per (name, version, part) with its findings as an array.

    Findings move once, to the task of their version, which numbers them in order and cuts them
    after each ``size``: no array holds more. A large version passes its task as a sorted stream.
    Equal findings may change places, which changes no document.
    """
    keys = ["name", "version"]
    item = F.struct(*FACTS)
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*FACTS))
    numbered = findings.withColumn("part", F.floor((nth - 1) / size).cast("int"))
    return numbered.groupBy(*keys, "part").agg(F.collect_list(item).alias("findings"))


def finding_documents(findings: DataFrame, size: int = DOCUMENT_FINDINGS) -> DataFrame:
    """{tgz, part, findings[]}: a document per version and part."""
    from tarsift.sources.archives import archive_name

    return _parts(findings, size).select(
        archive_name(c("name"), c("version")).alias("tgz"), "part", "findings"
    )


def signature_documents(
    findings: DataFrame, scan_time=None, size: int = DOCUMENT_FINDINGS
) -> DataFrame:
    """{package, scanner, part, findings[], scan_time} for the signature findings."""
    when = F.unix_timestamp().cast("double") if scan_time is None else scan_time
    only = findings.filter(c("rule") == "yara_match")
    return _parts(only, size).select(
        F.struct("name", "version").alias("package"),
        lit("yara").alias("scanner"),
        "part",
        "findings",
        when.alias("scan_time"),
    )


def write_documents(documents: DataFrame, path: str, mode: str = "append") -> None:
    """Under one prefix, any Hadoop path; compressed, since documents repeat themselves."""
    documents.write.mode(mode).json(path, compression="gzip")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DOCUMENT_SCHEMA).json(path)


def findings_of_documents(documents: DataFrame) -> DataFrame:
    """Documents back to one row per finding."""
    from tarsift.sources.archives import name_and_version

    name, version = name_and_version(c("tgz"))
    return documents.select(
        name.alias("name"), version.alias("version"), F.inline(F.array_compact("findings"))
    )


def severity_totals(documents: DataFrame) -> DataFrame:
    return findings_of_documents(documents).groupBy("severity").agg(F.count("*").alias("count"))


def c2_urls(documents: DataFrame) -> DataFrame:
    """All full C2 URLs in the documents."""
    rows = findings_of_documents(documents).filter(c("rule") == "c2_webhook")
    urls = F.from_json(F.get_json_object("details", "$.full_urls"), "array<string>")
    return rows.select(F.explode(F.array_compact(urls)).alias("url"))
