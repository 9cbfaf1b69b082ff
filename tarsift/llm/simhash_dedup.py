"""SimHash near-duplicates: pigeonring filtering of fingerprints, then connected components.

1. `fingerprints`: per document, in one pass without a shuffle, the 64-bit SimHash of its word
   shingles. Equal fingerprints become one row with the smallest doc_id.
2. `links`: the 64 bits are a ring of m segments. If two fingerprints differ in at most r bits,
   some segment begins a chain of which every length l has at most floor(l * r / m) differing
   bits. The first segment of a chain is the key of an equi-join by buckets (all values within
   its budget are tried on one side); within a key the chain conditions for l = 2, 3, ... are
   checked in turn, and only what is left gets the full Hamming check. Keys with very many
   fingerprints are dealt out over several buckets. Of each bucket only a spanning forest of its
   links leaves the task, never all pairs of a group; a forest connects what the links connect.
3. `components`: alternating large-star and small-star rounds, each written to the shared folder.

A null text has no words; without words the fingerprint is zero and links like any other. Rows
without doc_id get a fingerprint and, where nothing with a doc_id is near, a null component_id.
Repeated rows are reported as often as they occur. Only doc_id and text are read. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarsift.llm.common import U64, bucket_count, bucket_of, by_bucket, discard, mix, runs, stored, unpack
from tarsift.session import ship_with_tasks

BITS = 64
#: Shingles that the bit counters take before they are emptied: a byte each.
LANES = 255
#: Fingerprints of a bucket, on average.
BUCKET_ROWS = 4096
#: Fingerprints with one key in one bucket; more are dealt over further buckets.
HOT = 16384
#: Pairs that are looked at together.
PAIRS = 1 << 20
ONES = U64(0x0101010101010101)


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """The hashes of one text's word shingles, repeated ones too."""
    found = text.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    line = b" ".join(found)
    size = np.fromiter(map(len, found), np.int64, len(found))
    end = np.cumsum(size + 1) - 1
    start = end - size
    n = max(1, len(found) - shingle + 1)
    of = xxhash.xxh64_intdigest
    last = end[min(shingle, len(found)) - 1 :]
    return np.fromiter(
        (of(line[a:b], 42) for a, b in zip(start[:n].tolist(), last.tolist(), strict=True)), np.uint64, n
    )


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes."""
    n = len(hashes)
    if not n:
        return 0
    cuts = np.arange(0, n, LANES)
    value = 0
    for bit in range(8):
        lanes = np.add.reduceat((hashes >> U64(bit)) & ONES, cuts)
        counts = lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
        for byte in np.flatnonzero(2 * counts > n):
            value |= 1 << (8 * int(byte) + bit)
    return value


def simhash(text: bytes, shingle: int) -> int:
    """The fingerprint of one text: bits set in over half of the shingles' hashes."""
    return majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and fp, the fingerprint as a long, for each row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            values = np.fromiter((simhash(t.as_py() or b"", shingle) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        scan, "doc_id long, fp long"
    )


def layout(segments: int) -> list[tuple[int, int]]:
    """Shift and width of each segment."""
    edges = [BITS * k // segments for k in range(segments + 1)]
    return [(a, b - a) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def segment(values: np.ndarray, shift: int, width: int) -> np.ndarray:
    return (values >> U64(shift)) & U64((1 << width) - 1)


def flips(width: int, budget: int) -> np.ndarray:
    """All changes of at most `budget` of `width` bits, none first."""
    return np.array([sum(1 << b for b in some) for k in range(budget + 1) for some in combinations(range(width), k)], np.uint64)


def key_of(index: int, value: np.ndarray) -> np.ndarray:
    return value * U64(64) + U64(index)


def hot_keys(fps: DataFrame, segments: int) -> dict[int, int]:
    """Keys with more than HOT fingerprints and into how many parts they go; there are at most
    segments * rows / HOT of them, and none unless fingerprints crowd."""
    column = F.col("fp")
    parts = [
        (F.shiftrightunsigned(column, shift).bitwiseAND(F.lit((1 << width) - 1)) * 64 + k)
        for k, (shift, width) in enumerate(layout(segments))
    ]
    counts = fps.select(F.explode(F.array(*parts)).alias("key")).groupBy("key").count()
    return {r["key"]: -(-r["count"] // HOT) for r in counts.where(F.col("count") > HOT).collect()}


def links(fps: DataFrame, radius: int, segments: int) -> DataFrame:
    """a, b: a forest that connects all fingerprints (distinct, column fp) within the radius."""
    rows = fps.count()
    buckets = bucket_count(rows * segments, BUCKET_ROWS)
    hot = hot_keys(fps, segments)
    ring = layout(segments)
    budgets = [radius * length // segments for length in range(segments + 1)]

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(sorted(hot), np.uint64)
        parts = np.array([hot[int(k)] for k in names], np.int64)

        def spread(key: np.ndarray) -> np.ndarray:
            if not len(names):
                return np.ones(len(key), np.int64)
            at = np.minimum(np.searchsorted(names, key), len(names) - 1)
            return np.where(names[at] == key, parts[at], 1)

        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for k, (shift, width) in enumerate(ring):
                own = segment(fp, shift, width)
                # The known side has its own value as key, once for each part of that key; the
                # asking side has every value within the budget, in one part.
                key = key_of(k, own)
                copies = spread(key)
                known = np.repeat(np.arange(len(fp)), copies)
                part = np.arange(len(known)) - np.repeat(np.cumsum(copies) - copies, copies)
                out = [(key[known], part.astype(np.uint64), fp[known], np.zeros(len(known), np.uint8))]
                for change in flips(width, budgets[1]):
                    key = key_of(k, own ^ change)
                    part = mix(fp) % spread(key).astype(np.uint64)
                    out.append((key, part, fp, np.ones(len(fp), np.uint8)))
                key, part, value, asks = (np.concatenate(c) for c in zip(*out, strict=True))
                yield by_bucket(bucket_of(mix(key) + part, buckets), [key * U64(1 << 20) + part, value, asks])

    def reduce(table: pa.Table) -> pa.Table:
        key, value, asks = unpack(table["packed"].to_pylist(), ("u8", "u8", "u1"))
        order = np.lexsort((value, asks, key))
        key, value, asks = key[order], value[order], asks[order].astype(bool)
        new = np.flatnonzero(np.append(runs(key), True))
        # Of each key: where the known side begins and how many it has.
        group = np.repeat(np.arange(len(new) - 1), np.diff(new))
        known = np.add.reduceat((~asks).astype(np.int64), new[:-1]) if len(key) else np.zeros(0, np.int64)
        probe = np.flatnonzero(asks)
        probe = probe[known[group[probe]] > 0]
        sizes = known[group[probe]]
        left, right, at, total = [], [], 0, np.cumsum(sizes)
        while at < len(probe):
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, "right")))
            some, count = probe[at:to], sizes[at:to]
            a = np.repeat(some, count)
            b = np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(new[group[some]], count)
            x, y, first = value[a], value[b], (key[a] // U64(1 << 20)) % U64(64)
            x, y, first = (c[value[a] != value[b]] for c in (x, y, first))
            x, y = chained(x, y, first)
            if len(x):
                x, y = forest(x, y)
                left.append(x)
                right.append(y)
            at = to
        x = np.concatenate(left) if left else np.zeros(0, np.uint64)
        y = np.concatenate(right) if right else np.zeros(0, np.uint64)
        x, y = forest(x, y)
        return pa.table({"a": x.view(np.int64), "b": y.view(np.int64)})

    def chained(x: np.ndarray, y: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs whose chain from the first segment keeps every budget, then the whole radius."""
        shifts = np.array([s for s, _ in ring], np.uint64)
        masks = np.array([(1 << w) - 1 for _, w in ring], np.uint64)
        differ = x ^ y
        so_far = np.zeros(len(x), np.int64)
        for length in range(1, segments + 1):
            k = ((first + U64(length - 1)) % U64(segments)).astype(np.int64)
            so_far += np.bitwise_count((differ >> shifts[k]) & masks[k])
            keep = so_far <= budgets[length]
            x, y, first, differ, so_far = x[keep], y[keep], first[keep], differ[keep], so_far[keep]
        near = np.bitwise_count(differ) <= radius
        return x[near], y[near]

    return (
        fps.select("fp")
        .mapInArrow(keyed, "bucket int, packed binary")
        .groupBy("bucket")
        .applyInArrow(reduce, "a long, b long")
    )


def forest(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each value but the smallest of its component with that smallest one."""
    names, ends = np.unique(np.concatenate((x, y)), return_inverse=True)
    a, b = ends[: len(x)], ends[len(x) :]
    label = np.arange(len(names))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for end in (a, b):
            np.minimum.at(new, end, low)
            np.minimum.at(new, label[end], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    other = np.flatnonzero(label != np.arange(len(names)))
    return names[other], names[label[other]]


def components(edges: DataFrame) -> DataFrame:
    """node, root (its component's smallest node), for nodes that have an edge."""

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.union(pairs.select("b", "a")) if large else pairs
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        met = both.join(least, F.col("a") == F.col("k"))
        if large:
            return met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        rest = met.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return rest.union(least.select("k", "m")).where("a != b").distinct()

    def sign(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = sign(now)
    while before[0]:
        new = stored(star(star(now, True), False))
        discard(now)
        now, after = new, sign(new)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def hexadecimal(fp: Column | str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2, segments: int = 3) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id that chains of near fingerprints reach."""
    prints = stored(fingerprints(docs, shingle))
    smallest = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    near = components(links(smallest, radius, segments))
    rooted = smallest.join(near, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    roots = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(roots, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, shingle: int, radius: int, segments: int) -> DataFrame:
    """The rows of docs, all columns: of each group of near texts the smallest doc_id stays.

    Rows with one doc_id are one document, of which one row stays (the smallest hash of its
    text). Rows without doc_id stay.
    """
    seen = docs.select("doc_id", "text")
    near = near_duplicates(seen, shingle, radius, segments)
    return smallest_rows(docs, near)


def smallest_rows(docs: DataFrame, near: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is a component_id of near, one for each; and those without doc_id."""
    names = docs.columns
    hidden = [f"c{k}" for k in range(len(names))]
    frame = docs.toDF(*hidden)
    doc_id, text = hidden[names.index("doc_id")], hidden[names.index("text")]
    stays = near.where("doc_id = component_id").select(F.col("doc_id").alias("id")).distinct()
    first = Window.partitionBy("id").orderBy(F.xxhash64(text))
    kept = (
        frame.withColumn("id", F.col(doc_id).cast("long"))
        .join(stays, "id", "left_semi")
        .withColumn("nth", F.row_number().over(first))
        .where("nth = 1")
    )
    return kept.select(*hidden).union(frame.where(F.col(doc_id).isNull())).toDF(*names)


ship_with_tasks(__name__)
