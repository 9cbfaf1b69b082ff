"""Helpers the training-data operators share: Arrow text as flat bytes, hashes, packed rows.

Texts reach Python as Arrow batches. Their bytes are looked at as one flat array per chunk of
documents, so that hashing and word finding are array operations, never per-word Python.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarsift.session import ship_with_tasks

#: Bytes of text that are looked at together; a longer document is a chunk of its own.
CHUNK = 1 << 20
#: Spark's hash is 64 bits; buckets are taken from the upper ones after this multiplication.
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
U64 = np.uint64

_rng = np.random.default_rng(20240229)
_BYTE = [_rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1) for _ in range(2)]
_BASE = [int(x) | 5 for x in _rng.integers(1 << 40, 1 << 62, 2)]
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
#: The white space of the contracts: [\x20\x09-\x0D].
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared checkpoint folder of the session.

    The folder named by spark.checkpoint.dir is used; only where none is named (tests on one
    machine) the warehouse is.
    """
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{top.rstrip('/')}/tarsift-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def stored(frame: DataFrame) -> DataFrame:
    """The frame written to the shared folder and read again: lineage ends here."""
    path = scratch(frame.sparkSession)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def discard(frame: DataFrame) -> None:
    """Deletes what `stored` wrote, once nothing reads it any more."""
    spark = frame.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in frame.inputFiles()}:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def sent(spark: SparkSession, value) -> Callable[[], object]:
    """Broadcasts an object together with its class, so that workers need no copy of this
    package; in a task the result gives the object, decoded at each call."""
    shared = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: cloudpickle.loads(shared.value)


class Remembered:
    """A function of texts with its last results, those of long texts left out, so that what it
    holds has a bound. It travels to the workers without results."""

    def __init__(self, work: Callable, most: int, longest: int):
        self.work, self.most, self.longest, self.have = work, most, longest, {}

    def __call__(self, *texts: str):
        value = self.have.get(texts)
        if value is None:
            value = self.work(*texts)
            if sum(map(len, texts)) <= self.longest:
                if len(self.have) >= self.most:
                    self.have.clear()
                self.have[texts] = value
        return value

    def __getstate__(self) -> dict:
        return {**self.__dict__, "have": {}}


def remembered(most: int, longest: int = 256) -> Callable[[Callable], Remembered]:
    return lambda work: Remembered(work, most, longest)


def documents(frame: DataFrame, *others: str) -> DataFrame:
    """doc_id (long), text (null: empty) and the named columns; other columns are left out."""
    return frame.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        *others,
    )


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def bucket_count(total: int, each: int, least: int = 256) -> int:
    """Buckets in proportion to the data, so that one bucket stays as small at any size."""
    return max(least, -(-total // each))


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """crc32 of doc_id as text, modulo 5, is 0; a missing doc_id is not held out."""
    value = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(value.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and n + 1 offsets into them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if offsets else np.zeros(1, np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[at[0] : at[-1]], at - at[0]


def chunks(
    data: np.ndarray, at: np.ndarray, most: int = CHUNK, most_rows: int | None = None
) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose bytes are at most `most` together, or one row; of at most `most_rows`."""
    row, rows = 0, len(at) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(at, at[row] + most, "right")) - 1)
        end = min(end, rows, row + (most_rows or rows))
        yield row, end
        row = end


def powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64."""
    have = _POWERS.get(which)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        base = _BASE[which]
        out = []
        for step in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, U64(step))
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = _POWERS[which] = (out[0], out[1])
    return have


def prefix_sums(data: np.ndarray, which: int = 0) -> np.ndarray:
    """Sums by which any range of the bytes is hashed; see `range_hash`."""
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[which][data] * powers(len(data) + 1, which)[0][: len(data)], out=sums[1:])
    return sums


def value_sums(values: np.ndarray, which: int = 0) -> np.ndarray:
    """As prefix_sums, over 64-bit values (hashes of words, for instance)."""
    sums = np.empty(len(values) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(values * powers(len(values) + 1, which)[0][: len(values)], out=sums[1:])
    return sums


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes from start to end, for many ranges."""
    inverse = powers(len(sums), which)[1]
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads all bits over all bits; one to one."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


def sliding(values: np.ndarray, width: int, best: np.ufunc, beyond: int) -> np.ndarray:
    """best (minimum or maximum) of values[i : i + width]; `beyond` stands after the end."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        shifted = np.full(len(out), U64(beyond))
        if step < len(out):
            shifted[:-step] = out[step:]
        out = best(out, shifted)
        have += step
    return out


def words(
    data: np.ndarray, at: np.ndarray, space: np.ndarray = SPACE
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the index of the first word of each document (n + 1)."""
    black = ~space[data]
    first = np.zeros(len(data) + 1, bool)
    first[at] = True
    before = np.empty(len(data), bool)
    if len(data):
        before[0] = False
        before[1:] = black[:-1]
    start = np.flatnonzero(black & (~before | first[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = black[1:]
    end = np.flatnonzero(black & (~after | first[1:])) + 1
    return start, end, np.searchsorted(start, at)


def pack(*columns: np.ndarray) -> bytes:
    """Columns of one length after one another; compresses better than rows."""
    return b"".join(np.ascontiguousarray(c).tobytes() for c in columns)


def unpack(blobs: list[bytes], kinds: tuple) -> list[np.ndarray]:
    """The columns that `pack` wrote, over all blobs."""
    width = sum(np.dtype(k).itemsize for k in kinds)
    out: list[list[np.ndarray]] = [[] for _ in kinds]
    for blob in blobs:
        n, offset = len(blob) // width, 0
        for k, kind in enumerate(kinds):
            out[k].append(np.frombuffer(blob, kind, n, offset))
            offset += n * np.dtype(kind).itemsize
    return [np.concatenate(c) if c else np.zeros(0, kind) for c, kind in zip(out, kinds, strict=True)]


def by_bucket(bucket: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
    """One packed row for each bucket that occurs."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    columns = [c[order] for c in columns]
    cut = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
    cut = cut if len(bucket) else np.zeros(1, np.int64)
    blobs = [pack(*(c[a:b] for c in columns)) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket[cut[:-1]].astype(np.int32)), pa.array(blobs, pa.binary())], ["bucket", "packed"]
    )


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h * GOLDEN) >> U64(33)).astype(np.int64) % buckets


def runs(*columns: np.ndarray) -> np.ndarray:
    """True where a sorted row differs from the row before it."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def covered(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """True at each of n places that one of the ranges covers."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, start, 1)
    np.add.at(steps, end, -1)
    return np.cumsum(steps[:-1]) > 0


ship_with_tasks(__name__)
