"""A change feed as a streaming source whose position is the feed's own sequence number.

The feed is an append-only folder of Parquet files with ``seq`` (ascending as changes happen),
``id`` and ``deleted``, on any file system that pyarrow opens. A query's offset is the last seq
it has read, kept in its checkpoint, so a restart goes on behind that change and not behind some
file. Each batch is the range of seqs after the last offset up to the highest one landed, dealt
into partitions by range; a task reads just the row groups its range meets.

A change that lands late, with a seq at or below the offset, is not read: the feed promises
ascending numbers, and reading behind the position would count other changes twice.
`late_changes` lists such rows, so that none is lost unnoticed.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tarsift.session import ship_with_tasks

FEED_SCHEMA = "seq bigint, id string, deleted boolean"
#: Sequence numbers of one partition, and partitions of one batch at most (then they get wider).
RANGE = 100_000
MOST_RANGES = 1_000
START = -1


class SeqRange(InputPartition):
    """Changes after ``after`` up to ``upto``."""

    def __init__(self, after: int, upto: int):
        self.after, self.upto = after, upto


class FeedReader(DataSourceStreamReader):
    def __init__(self, path: str, start: int, width: int):
        self.path, self.start, self.width = path, start, width
        self.seen: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {"seq": self.start}

    def latestOffset(self) -> dict:
        """The highest landed seq, from the footers of files not looked at before."""
        import pyarrow.parquet as pq

        system, files = landed(self.path)
        for name in files:
            if name not in self.seen:
                with system.open_input_file(name) as file:
                    self.seen[name] = highest(pq.ParquetFile(file))
        return {"seq": max([self.start, *self.seen.values()])}

    def partitions(self, start: dict, end: dict) -> list[SeqRange]:
        after, upto = start["seq"], end["seq"]
        width = max(self.width, -(-(upto - after) // MOST_RANGES))
        return [SeqRange(at, min(at + width, upto)) for at in range(after, upto, width)]

    def read(self, partition: SeqRange) -> Iterator:
        import pyarrow as pa
        import pyarrow.dataset as ds

        system, files = landed(self.path)
        if not files:
            return
        seq = ds.field("seq")
        wanted = (seq > partition.after) & (seq <= partition.upto)
        kind = pa.schema([("seq", pa.int64()), ("id", pa.string()), ("deleted", pa.bool_())])
        rows = ds.dataset(files, schema=kind, filesystem=system, format="parquet")
        for batch in rows.to_batches(filter=wanted):
            if batch.num_rows:
                yield batch

    def commit(self, end: dict) -> None:
        pass


def landed(path: str) -> tuple:
    """The file system and the data files of a feed."""
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    hidden = lambda info: info.base_name.startswith(("_", "."))
    return system, sorted(i.path for i in found if i.is_file and i.path.endswith(".parquet") and not hidden(i))


def highest(file) -> int:
    """The greatest seq of a Parquet file, by its statistics where it has them."""
    place = file.schema_arrow.names.index("seq")
    best = START
    for k in range(file.metadata.num_row_groups):
        group = file.metadata.row_group(k)
        told = group.column(place).statistics
        if told is not None and told.has_min_max:
            best = max(best, told.max)
        elif group.num_rows:
            values = file.read_row_group(k, columns=["seq"])["seq"].drop_null()
            best = max([best, *values.to_pylist()])
    return best


class ChangeFeed(DataSource):
    """Options: ``path``, ``since`` (changes after this seq; all by default), ``range``."""

    @classmethod
    def name(cls) -> str:
        return "change_feed"

    def schema(self) -> str:
        return FEED_SCHEMA

    def streamReader(self, schema) -> FeedReader:
        start = int(self.options.get("since", START))
        return FeedReader(self.options["path"], start, int(self.options.get("range", RANGE)))


def stream_feed(spark: SparkSession, path: str, since: int | None = None, range_width: int = RANGE) -> DataFrame:
    """The feed's changes as a stream: seq, id, deleted."""
    spark.dataSource.register(ChangeFeed)
    reader = spark.readStream.format("change_feed").option("path", path).option("range", range_width)
    return (reader if since is None else reader.option("since", since)).load()


def late_changes(spark: SparkSession, path: str, read: DataFrame) -> DataFrame:
    """Changes of the feed that are missing among those that were ``read`` (their seqs), though
    later ones are there: they landed behind the position."""
    feed = spark.read.schema(FEED_SCHEMA).parquet(path)
    position = read.agg(F.max("seq").alias("position"))
    behind = feed.join(F.broadcast(position), F.col("seq") <= F.col("position")).drop("position")
    return behind.join(read.select("seq"), "seq", "left_anti")


ship_with_tasks(__name__)
