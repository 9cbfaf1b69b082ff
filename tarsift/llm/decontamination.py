"""Finding benchmark items in documents: SimHash of item-sized windows, exact verification.

1. Gate: a window that reaches a weighted-shingle similarity of 0.8 with an item shares a
   shingle of five words with it. Places of shared shingles give the windows to look at, of the
   item's own size and aligned as the shingle is in the item; nothing else can qualify.
2. The SimHash of each such window is looked up among the items of that size by multi-index
   hashing: the 64 bits are cut into blocks, and if two fingerprints differ in at most r bits,
   some block differs in at most r / blocks of them; all such values are probed, so that every
   item within the radius is found.
3. Candidates are verified by the exact weighted similarity of their shingles (repeats count;
   a shingle that many items share weighs less).

Words are runs of letters, digits and non-ASCII characters, A-Z as a-z. Benchmarks are small
beside the corpus but need not be: items are taken in blocks of at most `ITEM_WORDS` words,
each block against all documents, so that what a task holds has a fixed bound. An item with
fewer words than a shingle is one shingle as a whole: documents match that hold its words in a
row (`shortest` sets the fewest words an item must have to be looked for). The documents are not
shuffled; matches are grouped by document only when there are several blocks.

A null text has no words and matches nothing, nor does a null item. Documents without doc_id
are looked at like others; an item without item_id is named by a null. Equal rows get equal results, equal items are all named. Only
doc_id and text, item_id and text are read. Empty tables: no documents give no rows, no items
give rows without matches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarsift.llm.common import U64, chunks, documents, flat, mix, prefix_sums, range_hash, sent, value_sums, words
from tarsift.session import ship_with_tasks

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 20
BLOCKS = 8
#: Words of the items that one pass over the documents looks for: about 60 MB in a task.
ITEM_WORDS = 1 << 20
#: Bits of the table that answers first whether a shingle may be an item's.
GATE = 22
#: Windows that are looked at together.
WINDOWS = 4096

_code = np.arange(256)
#: Everything but letters, digits and bytes of non-ASCII characters separates words.
BREAK = ~(
    ((_code >= 48) & (_code < 58)) | ((_code >= 65) & (_code < 91)) | ((_code >= 97) & (_code < 123)) | (_code >= 128)
)
LOWER = np.where((_code >= 65) & (_code < 91), _code + 32, _code).astype(np.uint8)


def shingles(data: np.ndarray, at: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the shingle at each word (0 where the text ends first), and each text's first word."""
    data = LOWER[data]
    start, end, first = words(data, at, BREAK)
    n = len(start)
    hashes = range_hash(prefix_sums(data), start, end)
    last = np.repeat(first[1:], np.diff(first))
    place = np.arange(n)
    out = np.zeros(n, np.uint64)
    inside = np.flatnonzero(place + shingle <= last)
    out[inside] = range_hash(value_sums(hashes), inside, inside + shingle) | U64(1)
    return out, first


def simhashes(grams: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The weighted SimHash of each row of shingle hashes; hashes of 0 count nothing."""
    bits = np.unpackbits(mix(grams).astype("<u8").view(np.uint8).reshape(*grams.shape, 8), axis=-1, bitorder="little")
    weights = np.where(grams == 0, 0.0, weights)
    sums = np.einsum("ij,ijk->ik", weights, bits.reshape(*grams.shape, 64))
    return np.packbits(2 * sums > weights.sum(1)[:, None], axis=1, bitorder="little").view("<u8")[:, 0].astype(np.uint64)


def flips(width: int, most: int) -> list[int]:
    return [sum(1 << b for b in some) for k in range(most + 1) for some in combinations(range(width), k)]


@dataclass
class Items:
    """A block of items, ready for lookups."""

    ids: list[int | None]
    grams: list[np.ndarray]
    names: np.ndarray  # distinct shingles, sorted
    weight: np.ndarray  # of each, and at the end of one that no item has
    gate: np.ndarray
    uses: np.ndarray  # (item, offset) of each shingle, in the order of names
    first_use: np.ndarray
    prints: np.ndarray
    tables: dict  # (words, block, value) to items
    short: dict  # of items with fewer words than a shingle, by words: sorted hashes and their items

    @classmethod
    def of(cls, rows: list[tuple[int | None, str]], shingle: int, shortest: int = 1) -> Items:
        texts = [(text or "").encode() for _, text in rows]
        at = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        # Long gaps of documents keep items apart: shingles never cross a text's end.
        data = np.frombuffer(b"".join(texts), np.uint8)
        hashes, first = shingles(data, at, shingle)
        grams = [g[: max(0, len(g) - shingle + 1)] for g in np.split(hashes, first[1:-1])][: len(rows)]
        item = np.repeat(np.arange(len(rows)), [len(g) for g in grams])
        offset = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
        every = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        order = np.argsort(every, kind="stable")
        names, begin = np.unique(every[order], return_index=True)
        pairs = np.unique(np.stack((np.searchsorted(names, every), item)), axis=1)
        shared = np.bincount(pairs[0], minlength=len(names)) if len(names) else np.zeros(0)
        weight = np.log1p(len(rows) / np.maximum(1, np.append(shared, 1)))
        gate = np.zeros(1 << GATE, bool)
        gate[(names >> U64(64 - GATE)).astype(np.int64)] = True
        short = {}
        for size in range(shortest, shingle):
            few = np.flatnonzero(np.diff(first)[: len(rows)] == size)
            if len(few):
                own = shingles(data, at, size)[0][first[few]]
                by_hash = np.argsort(own, kind="stable")
                short[size] = own[by_hash], few[by_hash]
        made = cls(
            [i for i, _ in rows], grams, names, weight, gate, np.stack((item[order], offset[order])),
            np.append(begin, len(every)), np.zeros(len(rows), np.uint64), {}, short,
        )
        for k, g in enumerate(grams):
            if not len(g):
                continue
            made.prints[k] = simhashes(g[None], made.weights(g)[None])[0]
            for block, value in enumerate(blocks(made.prints[k])):
                made.tables.setdefault((len(g), block, value), []).append(k)
        return made

    def weights(self, grams: np.ndarray) -> np.ndarray:
        if not len(self.names):
            return np.full(grams.shape, self.weight[-1])
        at = np.minimum(np.searchsorted(self.names, grams), len(self.names) - 1)
        return np.where(self.names[at] == grams, self.weight[at], self.weight[-1])

    def within(self, size: int, value: int, radius: int) -> list[int]:
        """Items of so many shingles whose fingerprints are within the radius."""
        found: set[int] = set()
        for block, part in enumerate(blocks(value)):
            for change in PROBES[radius // BLOCKS]:
                found.update(self.tables.get((size, block, part ^ change), ()))
        return [k for k in found if (int(self.prints[k]) ^ int(value)).bit_count() <= radius]

    def similarity(self, item: int, grams: np.ndarray) -> float:
        """Weighted: the shared weight over the weight of both, repeats counted."""
        names, where = np.unique(np.concatenate((self.grams[item], grams[grams != 0])), return_inverse=True)
        own = np.bincount(where[: len(self.grams[item])], minlength=len(names))
        other = np.bincount(where[len(self.grams[item]) :], minlength=len(names))
        weight = self.weights(names)
        return float((weight * np.minimum(own, other)).sum() / (weight * np.maximum(own, other)).sum())


PROBES = {k: flips(64 // BLOCKS, k) for k in range(4)}


def blocks(value: int) -> list[int]:
    width = 64 // BLOCKS
    return [(int(value) >> (width * k)) & ((1 << width) - 1) for k in range(BLOCKS)]


def matches(items: Items, data: np.ndarray, at: np.ndarray, shingle: int, radius: int, least: float):
    """(row, item, similarity) of the documents of a chunk."""
    for size, (hashes, whose) in items.short.items():
        own, first = shingles(data, at, size)
        low, high = (np.searchsorted(hashes, own, side) for side in ("left", "right"))
        for place in np.flatnonzero(high > low):
            row = int(np.searchsorted(first, place, "right")) - 1
            for k in whose[low[place] : high[place]].tolist():
                yield row, k, 1.0
    grams, first = shingles(data, at, shingle)
    maybe = np.flatnonzero(items.gate[(grams >> U64(64 - GATE)).astype(np.int64)] & (grams != 0))
    name = np.minimum(np.searchsorted(items.names, grams[maybe]), max(0, len(items.names) - 1))
    if not len(items.names):
        return
    sure = items.names[name] == grams[maybe]
    place, name = maybe[sure], name[sure]
    uses = items.first_use[name + 1] - items.first_use[name]
    place = np.repeat(place, uses)
    use = np.arange(len(place)) - np.repeat(np.cumsum(uses) - uses, uses) + np.repeat(items.first_use[name], uses)
    item, offset = items.uses[0][use], items.uses[1][use]
    row = np.searchsorted(first, place, "right") - 1
    size = np.array([len(g) for g in items.grams], np.int64)[item]
    # Windows of the item's size, aligned with the shingle and moved into the document.
    most = np.maximum(first[row + 1] - first[row] - (size + shingle - 1), 0)
    begin = first[row] + np.clip(place - offset - first[row], 0, most)
    windows = np.unique(np.stack((size, begin, row)), axis=1)
    for n in np.unique(windows[0]):
        _, begins, rows = windows[:, windows[0] == n]
        for a in range(0, len(begins), WINDOWS):
            some, whose = begins[a : a + WINDOWS], rows[a : a + WINDOWS]
            index = some[:, None] + np.arange(n)
            inside = index < first[whose + 1][:, None]
            body = np.where(inside, grams[np.minimum(index, len(grams) - 1)], U64(0))
            prints = simhashes(body, items.weights(body))
            for r, g, value in zip(whose.tolist(), body, prints.tolist(), strict=True):
                for k in items.within(int(n), value, radius):
                    found = items.similarity(k, g)
                    if found >= least:
                        yield r, k, found


def item_blocks(benchmark: DataFrame, shingle: int, shortest: int = 1) -> Iterator[Items]:
    rows, size = [], 0
    chosen = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null")
    for item, text in chosen.toLocalIterator():
        rows.append((item, text))
        size += len(text.split())
        if size >= ITEM_WORDS:
            yield Items.of(rows, shingle, shortest)
            rows, size = [], 0
    if rows or not size:
        yield Items.of(rows, shingle, shortest)


def found_in(
    docs: DataFrame, items: Items, shingle: int, radius: int, least: float, columns: list[str], schema: str
) -> DataFrame:
    shared = sent(docs.sparkSession, items)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared()
        for batch in batches:
            data, at = flat(batch.column("text"))
            best: dict[int, dict[int | None, float]] = {}
            for a, b in chunks(data, at):
                for row, k, value in matches(items, data[at[a] : at[b]], at[a : b + 1] - at[a], shingle, radius, least):
                    own, item = best.setdefault(a + row, {}), items.ids[k]
                    own[item] = max(value, own.get(item, 0.0))
            rows = len(at) - 1
            # In order, a null first, as sort_array has them.
            hits = [sorted(best.get(i, {}).items(), key=lambda h: (h[0] is not None, h[0] or 0)) for i in range(rows)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in columns]
                + [
                    pa.array([[k for k, _ in h] for h in hits], pa.list_(pa.int64())),
                    pa.array([max((v for _, v in h), default=0.0) for h in hits], pa.float64()),
                ],
                [*columns, "item_ids", "similarity"],
            )

    return docs.mapInArrow(scan, f"{schema}, item_ids array<long>, similarity double")


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    shingle: int = SHINGLE,
    radius: int = RADIUS,
    least: float = SIMILARITY,
    shortest: int = 1,
) -> DataFrame:
    """doc_id, contaminated, item_ids (ascending) and the greatest similarity, a row per document."""
    parts = [
        found_in(documents(docs), items, shingle, radius, least, ["doc_id"], "doc_id long")
        for items in item_blocks(benchmark, shingle, shortest)
    ]
    out = parts[0]
    if len(parts) > 1:
        # Of rows with one doc_id each keeps its own matches: a row number within the doc_id
        # cannot be had without a sort, so that the rows of one doc_id share their matches.
        every = parts[0].select("doc_id").groupBy("doc_id").count()
        hits = parts[0].where("similarity > 0")
        for part in parts[1:]:
            hits = hits.union(part.where("similarity > 0"))
        met = hits.groupBy(F.col("doc_id").alias("of")).agg(
            F.sort_array(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"),
            F.max("similarity").alias("similarity"),
        )
        out = (
            every.join(met, F.col("doc_id").eqNullSafe(F.col("of")), "left")
            .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "count")))
            .select(
                "doc_id",
                F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"),
                F.coalesce("similarity", F.lit(0.0)).alias("similarity"),
            )
        )
    return out.select("doc_id", (F.col("similarity") > 0).alias("contaminated"), "item_ids", "similarity")


def clean(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """The rows of docs, all columns, that hold no benchmark item. Block after block of items
    looks at what the ones before left, so that nothing is joined or grouped."""
    shingle, radius = settings.get("shingle", SHINGLE), settings.get("radius", RADIUS)
    least = settings.get("least", SIMILARITY)
    names = docs.columns
    hidden = [f"c{k}" for k in range(len(names))]
    text = hidden[names.index("text")]
    frame = docs.toDF(*hidden)
    for items in item_blocks(benchmark, shingle, settings.get("shortest", 1)):
        frame = frame.withColumn("text", F.coalesce(F.col(text).cast("string"), F.lit("")))
        schema = ", ".join(f"{c} {frame.schema[c].dataType.simpleString()}" for c in hidden)
        found = found_in(frame, items, shingle, radius, least, hidden, schema)
        frame = found.where("similarity = 0").select(*hidden)
    return frame.toDF(*names)


ship_with_tasks(__name__)
