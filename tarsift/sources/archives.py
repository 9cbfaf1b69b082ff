"""Package archives: gzip tars as one row per member.

A gzip stream cannot be split, so an archive is read by one task; archives are what Spark
spreads. Python is used for exactly that: unpacking. Everything derived from a member is
column work afterwards.

Inside a task memory is bounded: headers are read first, which settles whether the
archive is accepted at all, and contents then leave in batches of a fixed byte size. A member
above LONG_BYTES is only named there; `long_member_parts` reads it in parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarsift import fixed_values as fv
from tarsift.functions import text as tx
from tarsift.sources.unpack import (
    CONTEXT_BYTES,
    LONG_BYTES,
    MEMBER_SCHEMA,
    OK,
    OVER_LIMIT,
    PART_BYTES,
    PART_SCHEMA,
    part_maker,
    unpacker,
)

c, lit = F.col, F.lit


# An archive of more compressed bytes than this has its members spread.
LARGE_ARCHIVE_BYTES = 64 << 20

# A value of a row ends at 2 GB: archives of more compressed bytes than this come without content.
MAX_ARCHIVE_BYTES = 1 << 30

UNNAMED = "unnamed"


def archive_files(spark: SparkSession, path: str | list[str], glob: str = "*.tgz") -> DataFrame:
    """The archives under a folder as (path, length, content).

    An archive that no row can hold comes without content and ends as "too_large"."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob)
    found = reader.option("recursiveFileLookup", "true").load(path)
    held = found.filter(c("length") <= MAX_ARCHIVE_BYTES).select("path", "length", "content")
    named = found.filter(c("length") > MAX_ARCHIVE_BYTES).select(
        "path", "length", lit(None).cast("binary").alias("content")
    )
    return held.unionByName(named)


def read_archives(
    spark: SparkSession,
    path: str,
    max_extract_bytes: int | None = None,
    large_bytes: int = LARGE_ARCHIVE_BYTES,
) -> DataFrame:
    """Members of all archives under a folder."""
    return extract_members(archive_files(spark, path), max_extract_bytes, large_bytes)


def extract_members(
    archives: DataFrame,
    max_extract_bytes: int | None = None,
    large_bytes: int = LARGE_ARCHIVE_BYTES,
    long_bytes: int = LONG_BYTES,
) -> DataFrame:
    """One row per archive member, for a frame of (path, content) and best their length.
    Without content an archive counts as missing.

    ``status`` says what became of the archive. Of one that is not "ok" only a single
    row without content remains, so nothing in it is scanned; so it is with an archive
    that has no members. The members of an accepted
    archive are regular files ("file"), links ("symlink", "hardlink") and the rest. They are
    what extraction leaves: of several members of one path the last counts, the others are
    "superseded" and without content, and a link to a file of the archive has its content. A
    member of more than ``long_bytes`` is marked "long" and has no content here.

    Members of a large archive are spread over the cluster before anything scans them, so
    that one huge archive does not keep one task busy with all rules.
    """
    limit = _limit(max_extract_bytes)
    sized = _sized(archives)

    unpacked = lambda some: some.mapInPandas(unpacker(limit, long_bytes), MEMBER_SCHEMA)
    if "length" in archives.columns:
        is_large = F.coalesce(c("length") > large_bytes, lit(False))
        rows = unpacked(sized.filter(~is_large)).unionByName(
            unpacked(sized.filter(is_large)).repartition("archive", "ordinal")
        )
    else:
        rows = unpacked(sized)
    name, version = name_and_version(c("archive"))
    return rows.select(name.alias("name"), version.alias("version"), "*")


def long_member_parts(
    archives: DataFrame,
    max_extract_bytes: int | None = None,
    long_bytes: int = LONG_BYTES,
    part_bytes: int = PART_BYTES,
    context_bytes: int = CONTEXT_BYTES,
) -> DataFrame:
    """The members of more than ``long_bytes`` in parts, each with what surrounds it.

    One task reads a member, since its archive cannot be split, and holds one part at a time;
    the parts are dealt out before anything looks at them. See `unpack.cut` for the columns.
    """
    parts = part_maker(_limit(max_extract_bytes), long_bytes, part_bytes, context_bytes)
    return _sized(archives).mapInPandas(parts, PART_SCHEMA).repartition("archive", "ordinal", "part")


def _limit(max_extract_bytes: int | None) -> int | None:
    return max_extract_bytes if max_extract_bytes and max_extract_bytes > 0 else None


def _sized(archives: DataFrame) -> DataFrame:
    length = c("length") if "length" in archives.columns else F.octet_length("content")
    return archives.select("path", length.cast("bigint").alias("length"), "content")


def name_and_version(archive):
    """(name, version) from an archive path: the version follows the last @, and __
    stands for the / of a scope. Without an @ both are NULL."""
    base = F.regexp_replace(F.substring_index(archive, "/", -1), r"\.[^.]*$", "")
    split = base.rlike("@")
    name = F.replace(F.regexp_extract(base, r"(?s)^(.*)@[^@]*$", 1), lit("__"), lit("/"))
    return (
        F.when(split, name),
        F.when(split, F.regexp_extract(base, r"(?s)@([^@]*)$", 1)),
    )


def archive_name(name, version):
    """The file name of a version's archive; the inverse of :func:`name_and_version`."""
    return F.concat(F.replace(name, lit("/"), lit("__")), lit("@"), version, lit(".tgz"))


def archive_path(folder: str, name, version):
    """Where the archive of a version lies under a download folder."""
    return F.concat(lit(folder.rstrip("/") + "/"), archive_name(name, version))


def storage_key(name, version):
    return F.concat(lit("npm-raw-tarballs/"), name, lit("/"), version, lit(".tgz"))


# --- tables derived from the members ----------------------------------------------------


def is_content() -> Column:
    """Members that are files once the archive is extracted: files, and links to files in it."""
    link = c("kind").isin("symlink", "hardlink") & (c("content").isNotNull() | c("long"))
    return (c("kind") == "file") | link


def regular_files(members: DataFrame) -> DataFrame:
    """The files to scan. An archive without a manifest is not scanned further."""
    kept = members.filter(is_content() & ~c("long") & c("has_manifest"))
    return kept.select(
        "name", "version", "path", tx.suffix_of(c("path")).alias("suffix"), "size", "content"
    )


def pick_manifests(members: DataFrame) -> DataFrame:
    """(name, version, path, manifest): package/package.json, else the first by path.

    Only manifest files take part, and each task first keeps its own best one.
    """
    base = F.substring_index("path", "/", -1)
    found = members.filter(is_content() & ~c("long") & (base == "package.json"))
    found = found.filter(c("name").isNotNull())
    order = F.struct(c("path") != "package/package.json", c("path"))
    best = F.min_by(F.struct("path", "content"), order)
    return found.groupBy("name", "version").agg(best.alias("best")).select(
        "name", "version", "best.path", tx.clean_text(c("best.content")).alias("manifest")
    )


def rejected_archives(members: DataFrame) -> DataFrame:
    """Archives that give no result, with the reason; one without a name and version has
    nothing its findings could belong to."""
    unnamed = c("name").isNull() | c("version").isNull()
    failed = ~c("status").isin(OK, OVER_LIMIT)
    status = F.when(failed, c("status")).otherwise(lit(UNNAMED))
    rows = members.filter(failed | unnamed).select("archive", "name", "version", status.alias("status"))
    return rows.distinct()


def symlink_escapes(members: DataFrame) -> DataFrame:
    target = c("linkname")
    risky = F.startswith(target, lit("/")) | F.contains(target, lit(".."))
    return members.filter(c("kind").isin("symlink", "hardlink") & risky).select(
        "name",
        "version",
        lit("symlink_escape").alias("rule"),
        lit("high").alias("severity"),
        c("path").alias("entry"),
        target.alias("target"),
    )


def extraction_limit_findings(members: DataFrame, max_extract_bytes: int | None) -> DataFrame:
    return members.filter(c("status") == OVER_LIMIT).select(
        "name",
        "version",
        lit("extraction_limit_exceeded").alias("rule"),
        lit("low").alias("severity"),
        c("archive").alias("path"),
        lit(max_extract_bytes).cast("bigint").alias("max_extract_bytes"),
        lit(fv.EXPLAIN["extraction_limit_exceeded"]).alias("explanation"),
    )


def no_manifest_findings(members: DataFrame) -> DataFrame:
    """Accepted archives without any package.json, whether or not they hold files."""
    missing = members.filter((c("status") == OK) & ~c("has_manifest"))
    return missing.select("name", "version").distinct().select(
        "*", lit("no_package_json").alias("rule"), lit("low").alias("severity")
    )


# --- checksums --------------------------------------------------------------------------


def verify_checksums(archives: DataFrame, queue: DataFrame) -> DataFrame:
    """Archives of a queue with ``checksum_ok``; a record without a checksum passes.

    The digest is taken where the archive is read; contents do not move.
    """
    name, version = name_and_version(c("path"))
    digests = archives.select(
        name.alias("name"), version.alias("version"), F.sha1("content").alias("sha1")
    )
    expected = F.nullif(c("shasum"), lit(""))
    return queue.join(digests, ["name", "version"]).withColumn(
        "checksum_ok", F.coalesce(c("sha1") == F.lower(expected), lit(True))
    )


def checksum_mismatches(verified: DataFrame) -> DataFrame:
    return verified.filter(~c("checksum_ok")).select("name", "version", "shasum", "sha1")
