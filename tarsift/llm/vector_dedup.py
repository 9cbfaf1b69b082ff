"""Embedding near-dedup: spherical k-means cells, blocked cosine products, one row per group kept.

1. `distinct`: equal vectors of one label become one row with their number and smallest vec_id.
2. `centres`: spherical k-means over a bounded sample (the SAMPLE smallest hashes); at most CELLS
   centres, so the broadcast has a bound. The number of cells follows the largest label.
3. `placed`: every vector lives in its nearest cell and visits each cell that can hold a partner.
   A pair of cosine t lies chord = sqrt(2 - 2t) apart, so the vector y of home h has a partner x
   of home c only if y.(h - c) <= |h - c| * chord. Along one direction of d the chord shows
   chord / sqrt(d) on average; REACH of these are allowed for. Up to REACH**2 dimensions that is
   the exact bound; in more it misses pairs whose difference points at a centre more closely.
4. `compared`: cells of a label with many rows are cut into parts, and each two parts are a tile of
   bounded size, so a hot cell is many tasks' work. In a tile cosines are taken in double precision
   by blocks; a pair that meets in both its cells counts in the smaller one. Only counts by vector
   and a spanning forest of the links leave the tile, never pairs.
5. Components come from star rounds over the forests.

Vectors without label, null, empty, zero or with null or non-finite components link with nothing
and stay. Vectors of different lengths do not link. Rows are vectors: repeated rows link with each
other and each is reported; a row without vec_id is reported with the smallest vec_id it reaches
(null if none) and kept only if that is null. Other columns are not read. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarsift.llm.common import bucket_count, flat, stored
from tarsift.llm.simhash_dedup import components, forest
from tarsift.session import ship_with_tasks

#: Vectors that the centres are fitted on, and the most centres there are.
SAMPLE = 20000
CELLS = 4096
#: Vectors of the largest label for each cell.
PER_CELL = 512
ROUNDS = 12
#: Mean projections of a pair's difference that the bound on visits allows for.
REACH = 3.0
#: Rows of one cell and label in one part of a tile.
PART = 4096
#: Rows of all tiles that one task gets, on average.
BUCKET_ROWS = 16384
#: Cosines that are held at once.
BLOCK = 1 << 20
#: Cells with more than one part are broadcast up to this many.
HOT_CELLS = 100_000


def comparable(vectors: DataFrame) -> DataFrame:
    """vec_id, label, vector (doubles), and k1, k2, a 128-bit hash of label and vector: null where
    the row links with nothing."""
    vector = F.col("vector")
    finite = ~F.exists(
        vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    ) & F.exists(vector, lambda x: x != 0)
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("vector")
    )
    fit = F.col("label").isNotNull() & F.coalesce(finite, F.lit(False))
    return rows.select(
        "vec_id",
        *(F.when(fit, F.xxhash64(F.lit(seed), "label", "vector")).alias(k) for k, seed in (("k1", 1), ("k2", 2))),
        F.when(fit, F.col("label")).alias("label"),
        F.when(fit, vector).alias("vector"),
    )


def distinct(rows: DataFrame) -> DataFrame:
    """id, k1, k2, label, vector, copies and the smallest vec_id of each distinct vector of a label."""
    groups = rows.where("k1 is not null").groupBy("k1", "k2").agg(
        F.any_value("label").alias("label"),
        F.any_value("vector").alias("vector"),
        F.count("*").alias("copies"),
        F.min("vec_id").alias("least"),
    )
    return groups.withColumn("id", F.monotonically_increasing_id())


def unit(rows: np.ndarray) -> np.ndarray:
    # Scaled first, so that very large and very small components keep their length.
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def centres(vectors: DataFrame) -> np.ndarray:
    """Spherical k-means: unit rows, of the length that most of the sample has."""
    size = vectors.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    if not size:
        return np.zeros((1, 1))
    sample = vectors.select("vector", F.xxhash64("k1").alias("order")).orderBy("order", "vector").limit(SAMPLE)
    drawn = [np.array(r["vector"]) for r in sample.collect()]
    lengths = np.array([len(v) for v in drawn])
    most = np.bincount(lengths).argmax()
    points = unit(np.stack([v for v in drawn if len(v) == most]))
    cells = int(min(CELLS, max(1, -(-size // PER_CELL)), max(1, len(points) // 4)))
    # Starts far from each other: farthest-first over a few candidates each, ties by position.
    chosen = [0]
    nearest = points @ points[0]
    step = max(1, len(points) // 512)
    for _ in range(1, cells):
        k = len(chosen) % step
        chosen.append(int(k + step * np.argmin(nearest[k::step])))
        nearest = np.maximum(nearest, points @ points[chosen[-1]])
    means = points[chosen]
    for _ in range(ROUNDS):
        home = (points @ means.T).argmax(axis=1)
        new = np.zeros_like(means)
        np.add.at(new, home, points)
        length = np.sqrt((new * new).sum(axis=1, keepdims=True))
        new = np.where(length > 1e-9, new / np.maximum(length, 1e-9), means)
        if np.abs(new - means).max() < 1e-6:
            break
        means = new
    return means


def placed(vectors: DataFrame, means: np.ndarray, least_cosine: float) -> DataFrame:
    """One row for each cell that a vector lives in or visits."""
    sent = vectors.sparkSession.sparkContext.broadcast(means)
    chord = np.sqrt(max(0.0, 2 - 2 * least_cosine))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        means = sent.value
        apart = np.sqrt(np.maximum(0, 2 - 2 * means @ means.T))
        reach = chord * min(1.0, REACH / np.sqrt(means.shape[1]))
        for batch in batches:
            values, cuts = batch.column(1).flatten().to_numpy(), batch.column(1).value_lengths().to_numpy().cumsum()
            rows = [values[end - n : end] for end, n in zip(cuts, np.diff(cuts, prepend=0), strict=True)]
            fits = np.array([len(v) == means.shape[1] for v in rows], bool)
            cells = [np.zeros(1, np.int32)] * len(rows)
            for at in range(0, len(rows), 1024):
                some = [k for k in range(at, min(at + 1024, len(rows))) if fits[k]]
                if not some:
                    continue
                near = unit(np.stack([rows[k] for k in some])) @ means.T
                home = near.argmax(axis=1)
                lead = near[np.arange(len(some)), home][:, None] - near
                visits = lead <= reach * apart[home] + 1e-9
                visits[np.arange(len(some)), home] = False
                for k, h, others in zip(some, home, visits, strict=True):
                    cells[k] = np.concatenate(([h], np.flatnonzero(others))).astype(np.int32)
            count = [len(c) for c in cells]
            again = pa.array(np.repeat(np.arange(len(rows)), count))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(again),
                    batch.column(2).take(again),
                    batch.column(3).take(again),
                    pa.array(np.repeat(np.array([len(v) for v in rows], np.int32), count)),
                    pa.array(np.concatenate(cells) if cells else np.zeros(0, np.int32)),
                    pa.array([c.tobytes() for c in cells], pa.binary()).take(again),
                    pa.array([v.tobytes() for v in rows], pa.binary()).take(again),
                ],
                ["id", "copies", "label", "length", "cell", "cells", "body"],
            )

    label = vectors.schema["label"].dataType.simpleString()
    return vectors.select("id", "vector", "copies", "label").mapInArrow(
        scan, f"id long, copies long, label {label}, length int, cell int, cells binary, body binary"
    )


def tiled(places: DataFrame) -> DataFrame:
    """The places once for each tile: tile hashes label, length, cell and the two parts."""
    key = ["label", "length", "cell"]
    hot = (
        places.groupBy(*key)
        .count()
        .where(F.col("count") > PART)
        .select(*key, F.ceil(F.col("count") / PART).cast("int").alias("parts"))
    )
    hot = stored(hot)
    if hot.count() <= HOT_CELLS:
        hot = F.broadcast(hot)
    rows = places.join(hot, key, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return rows.select(
        F.xxhash64(*key, F.least("part", "other"), F.greatest("part", "other")).alias("tile"),
        (F.col("part") > F.col("other")).alias("right"),
        (F.col("part") == F.col("other")).alias("own"),
        *("id", "copies", "cell", "cells", "body"),
    )


class Side:
    """The rows of one part: unit vectors, homes and visited cells."""

    def __init__(self, table: pa.Table, rows: np.ndarray):
        table = table.take(pa.array(rows))
        self.id = table["id"].to_numpy()
        self.copies = table["copies"].to_numpy()
        self.unit = unit(flat(table["body"])[0].view(np.float64).reshape(len(rows), -1))
        cells, ends = flat(table["cells"])
        self.cells, self.starts = cells.view(np.int32), ends // 4
        self.home = self.cells[self.starts[:-1]]

    def meets_at(self, homes: np.ndarray) -> np.ndarray:
        """For each row and each of the (sorted) homes: does the row live there or visit it?"""
        at = np.minimum(np.searchsorted(homes, self.cells), len(homes) - 1)
        here = homes[at] == self.cells
        out = np.zeros((len(self.home), len(homes)), bool)
        out[np.repeat(np.arange(len(self.home)), np.diff(self.starts))[here], at[here]] = True
        return out


def wanted(left: Side, right: Side, cell: int, some: slice) -> np.ndarray:
    """Pairs that count in this cell: one of them lives here, and they do not meet in a smaller
    cell that the other lives in."""
    a, b = left.home[some, None] == cell, right.home[None] == cell
    homes_b, of_b = np.unique(right.home, return_inverse=True)
    homes_a, of_a = np.unique(left.home[some], return_inverse=True)
    there_b = left.meets_at(homes_b)[some][:, of_b]
    there_a = right.meets_at(homes_a).T[of_a]
    first = ~there_b | (right.home[None] >= cell)
    second = ~there_a | (left.home[some, None] >= cell)
    return (a & b) | (a & ~b & first) | (~a & b & second)


def tile_links(left: Side, right: Side, cell: int, same: bool, least_cosine: float) -> tuple:
    """Links of each row (by copies) and a forest of the links."""
    n_left, n_right = np.zeros(len(left.id), np.int64), np.zeros(len(right.id), np.int64)
    near_x, near_y = np.zeros(0, np.int64), np.zeros(0, np.int64)
    step = max(1, BLOCK // max(1, len(right.id)))
    names = np.unique(np.concatenate((left.id, right.id)))
    label = names.copy()
    at_left, at_right = np.searchsorted(names, left.id), np.searchsorted(names, right.id)
    for at in range(0, len(left.id), step):
        some = slice(at, min(at + step, len(left.id)))
        near = left.unit[some] @ right.unit.T >= least_cosine
        if same:
            near[np.arange(near.shape[0]), np.arange(at, at + near.shape[0])] = False
        if not near.any():
            continue
        near &= wanted(left, right, cell, some)
        n_left[some] += near @ right.copies
        if not same:
            n_right += left.copies[some] @ near
        # Only pairs that the forest so far leaves apart extend it.
        near &= label[at_left[some]][:, None] != label[at_right][None]
        x, y = np.nonzero(near)
        if len(x):
            near_x, near_y = forest(
                np.concatenate((near_x, left.id[some][x])), np.concatenate((near_y, right.id[y]))
            )
            label = names.copy()
            label[np.searchsorted(names, near_x)] = near_y
    return n_left, n_right, near_x, near_y


def compared(tiles: DataFrame, rows: int, least_cosine: float) -> DataFrame:
    """a, b, n: rows with n are a vector's links in a tile; rows without are links of a forest."""
    buckets = bucket_count(rows, BUCKET_ROWS, 16)

    def reduce(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        tile, right = table["tile"].to_numpy(), table["right"].to_numpy(zero_copy_only=False)
        order = np.lexsort((table["id"].to_numpy(), right, tile))
        cuts = np.flatnonzero(np.append(True, tile[order][1:] != tile[order][:-1])) if len(order) else []
        out: list[tuple] = [(np.zeros(0, np.int64),) * 3]
        for start, end in zip(cuts, [*cuts[1:], len(order)], strict=True):
            rows = order[start:end]
            if len(rows) < 2:
                continue
            own = table["own"][int(rows[0])].as_py()
            cell = table["cell"][int(rows[0])].as_py()
            one, two = rows[~right[rows]], rows[right[rows]]
            if not len(one) or not (own or len(two)):
                continue
            a = Side(table, one)
            b = a if own else Side(table, two)
            n_a, n_b, x, y = tile_links(a, b, cell, own, least_cosine)
            for ids, n in ((a.id, n_a), (b.id, n_b)):
                linked = n > 0
                out.append((ids[linked], np.full(linked.sum(), -1), n[linked]))
            out.append((x, y, np.zeros(len(x), np.int64)))
        a, b, n = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.table({"a": a, "b": b, "n": n})

    return (
        tiles.withColumn("bucket", F.pmod("tile", F.lit(buckets)))
        .groupBy("bucket")
        .applyInArrow(reduce, "a long, b long, n long")
    )


def near_vectors(vectors: DataFrame, least_cosine: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each row of vectors."""
    rows = stored(comparable(vectors))
    kinds = stored(distinct(rows))
    places = stored(placed(kinds, centres(kinds), least_cosine))
    found = stored(compared(tiled(places), places.count(), least_cosine))
    links = found.where("n > 0").groupBy("a").agg(F.sum("n").alias("links"))
    roots = components(found.where("n = 0").select("a", "b"))
    named = (
        kinds.select("k1", "k2", "id", "copies", "least")
        .join(links, F.col("id") == F.col("a"), "left")
        .join(roots, F.col("id") == F.col("node"), "left")
        .select(
            *("k1", "k2", "least"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"),
            F.coalesce("root", "id").alias("root"),
        )
    )
    groups = named.groupBy("root").agg(F.min("least").alias("component"))
    named = named.join(groups, "root").select("k1", "k2", "links", "component")
    component = F.when(F.col("k1").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return rows.select("vec_id", "k1", "k2").join(named, ["k1", "k2"], "left").select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )


ship_with_tasks(__name__)
