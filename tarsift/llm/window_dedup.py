"""Removal of word windows that an earlier document has: count-min prefilter, then exact groups.

A window of 13 words that occurs twice has the same smallest hash of five words among its nine
in both places. So a window cannot be more frequent than that gram, and grams are counted:

Documents are dealt to groups of some megabytes of text by a hash of doc_id; the texts move once,
and all passes read that one exchange.

1. Each group counts the grams that are smallest in some window (about one word in five) in its
   own count-min sketch: of two rows of counters only those that are not zero, cut into blocks.
2. Block by block the groups' sketches are added up. Each group hears which of its own counters
   reached two in the sum. The number of blocks follows the size of the corpus, so that the rate
   of false estimates does not grow with it, and no sketch is broadcast.
3. A window leaves its group only if both counters of its smallest gram reached two. Counters
   only ever overestimate, so no repeated window stays behind. Windows that leave are grouped
   exactly, by a 96-bit hash of their words. All of them but those of the smallest doc_id are
   removed.

Within a group equal grams are one counter and equal windows meet before they leave: what a
smaller doc_id of the same group has already is decided there, so that a passage in many
documents costs a row for each group, not for each document.

Words are [^\\x20\\x09-\\x0D]+, unchanged. A null text has no words. Rows without doc_id are
kept unchanged and count for nobody. All rows of one doc_id are in one group. Rows that repeat a doc_id and its text get equal results.
Only doc_id and text are read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarsift.llm.common import (
    GOLDEN,
    U64,
    bucket_count,
    bucket_of,
    by_bucket,
    chunks,
    covered,
    documents,
    flat,
    mix,
    pack,
    prefix_sums,
    range_hash,
    runs,
    sliding,
    text_bytes,
    unpack,
    value_sums,
    words,
)
from tarsift.session import ship_with_tasks

WINDOW = 13
GRAM = 5
#: Text bytes of a group of documents; there are as many groups, blocks of the sketch and buckets of windows.
BUCKET_BYTES = 4 << 20
#: Rows of the sketch, and counters of a row in a block: some eight for each gram of 4 MB of text.
ROWS = 2
COUNTERS = 1 << 20
NEVER = (1 << 64) - 1


class Windows:
    """The windows of a chunk of documents, and the smallest gram of each."""

    def __init__(self, data: np.ndarray, at: np.ndarray, window: int, gram: int):
        start, end, first = words(data, at)
        self.first, n = first, len(start)
        self.row = np.repeat(np.arange(len(at) - 1), np.diff(first))
        self.hashes = [range_hash(prefix_sums(data, k), start, end, k) for k in range(2)]
        place = np.arange(n)
        last = first[self.row + 1] if n else place
        sums = value_sums(self.hashes[0])
        inside = place + gram <= last
        self.grams = np.full(n, U64(NEVER))
        self.grams[inside] = range_hash(sums, place[inside], place[inside] + gram)
        self.least = sliding(self.grams, window - gram + 1, np.minimum, NEVER)
        self.valid = place + window <= last
        self.place = place - first[self.row] if n else place

    def smallest(self, width: int) -> np.ndarray:
        """Places of the grams that are smallest in some window."""
        least = np.where(self.valid, self.least, U64(0))
        most = sliding(least[::-1], width, np.maximum, 0)[::-1]
        return np.flatnonzero((most == self.grams) & (self.grams != U64(NEVER)))

    def keys(self, places: np.ndarray, window: int) -> list[np.ndarray]:
        return [range_hash(value_sums(h, k), places, places + window, k) for k, h in enumerate(self.hashes)]


def counters(grams: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block and counter of each gram, a line for each row of the sketch."""
    h = np.stack([mix(grams + U64(row) * GOLDEN) for row in range(ROWS)])
    first = (np.arange(ROWS) * COUNTERS)[:, None]
    return bucket_of(h, blocks), (h % U64(COUNTERS)).astype(np.int64) + first


def found_windows(table: pa.Table, window: int, gram: int) -> Iterator[tuple[Windows, np.ndarray]]:
    """The windows of a group's documents, chunk by chunk, and the documents' ids."""
    for batch in table.to_batches():
        data, at = flat(batch.column("text"))
        ids = batch.column("id").to_numpy(zero_copy_only=False)
        for a, b in chunks(data, at):
            yield Windows(data[at[a] : at[b]], at[a : b + 1] - at[a], window, gram), ids[a:b]


def sketched(texts: DataFrame, blocks: int, window: int, gram: int) -> DataFrame:
    """Each group's sketch: by block its counters that are not zero, with what they count (2: or more)."""

    def scan(table: pa.Table) -> pa.Table:
        grams = [w.grams[w.smallest(window - gram + 1)] for w, _ in found_windows(table, window, gram)]
        block, counter = counters(np.concatenate([*grams, np.zeros(0, np.uint64)]), blocks)
        key, count = np.unique(block.ravel() << 32 | counter.ravel(), return_counts=True)
        counter, count = (key & 0xFFFFFFFF).astype(np.uint32), np.minimum(count, 2).astype(np.uint8)
        out = pa.Table.from_batches([by_bucket(key >> 32, [counter, count])])
        return out.append_column("grp", pa.array(np.full(len(out), table["grp"][0].as_py(), np.int32)))

    return texts.groupBy("grp").applyInArrow(scan, "bucket int, packed binary, grp int")


def added(sketches: DataFrame) -> DataFrame:
    """grp, block, counters: those of a group's sketch that are two or more in the sum of all sketches."""

    def reduce(table: pa.Table) -> pa.Table:
        total = np.zeros(ROWS * COUNTERS, np.uint8)
        own = [unpack([blob], ("u4", "u1")) for blob in table["packed"].to_pylist()]
        for counter, count in own:  # a counter stands once in a group's sketch
            total[counter] = np.minimum(2, total[counter] + count)
        packed = [pack(counter[total[counter] >= 2]) for counter, _ in own]
        return pa.table(
            {"grp": table["grp"], "block": table["bucket"], "counters": pa.array(packed, pa.binary())}
        ).filter(pa.array([len(p) > 0 for p in packed], pa.bool_()))

    return sketches.groupBy("bucket").applyInArrow(reduce, "grp int, block int, counters binary")


def estimated_repeated(grams: np.ndarray, reached: np.ndarray, blocks: int) -> np.ndarray:
    """True where every row's counter of the gram is among those that reached two."""
    if not len(reached) or not len(grams):
        return np.zeros(len(grams), bool)
    block, counter = counters(grams, blocks)
    key = block << 32 | counter
    return (reached[np.minimum(np.searchsorted(reached, key), len(reached) - 1)] == key).all(axis=0)


def windows_of(texts: DataFrame, answers: DataFrame, buckets: int, window: int, gram: int) -> DataFrame:
    """Per bucket, packed: the windows estimated repeated (kind 0: two hashes, doc_id, place), one
    for each group and word sequence; and (kind 1: doc_id, start, end) what the group decided."""

    def scan(table: pa.Table, answer: pa.Table) -> pa.Table:
        blobs = answer["counters"].to_pylist()
        parts = [np.frombuffer(c, "<u4").astype(np.int64) for c in blobs]
        block = np.repeat(answer["block"].to_numpy().astype(np.int64), [len(p) for p in parts])
        reached = np.sort(block << 32 | np.concatenate([*parts, np.zeros(0, np.int64)]))
        found = [[np.zeros(0, k) for k in ("u8", "u4", "i8", "i4")]]
        for w, ids in found_windows(table, window, gram):
            i = np.flatnonzero(w.valid)
            i = i[estimated_repeated(w.least[i], reached, buckets)]
            h0, h1 = w.keys(i, window)
            found.append([h0, h1.astype(np.uint32), ids[w.row[i]].astype(np.int64), w.place[i].astype(np.int32)])
        h0, h1, doc, place = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.lexsort((place, doc, h1, h0))
        h0, h1, doc, place = h0[order], h1[order], doc[order], place[order]
        new = runs(h0, h1)
        least = doc[new][np.cumsum(new) - 1] if len(doc) else doc
        here = doc > least
        start, end, whose = merged(doc[here], place[here].astype(np.int64), window)
        # By the window, not by its gram: a frequent phrase has other windows in each document.
        leave = by_bucket(bucket_of(h0[~here], buckets), [x[~here] for x in (h0, h1, doc, place)])
        ready = by_bucket(bucket_of(whose.astype(np.uint64), buckets), [whose, start, end])
        return pa.Table.from_batches([kinds(0, leave), kinds(1, ready)])

    def kinds(kind: int, batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(np.full(len(batch), kind, np.int32)), batch.column(1)],
            ["bucket", "kind", "packed"],
        )

    return (
        texts.groupBy("grp")
        .cogroup(answers.groupBy("grp"))
        .applyInArrow(scan, "bucket int, kind int, packed binary")
    )


def merged(doc: np.ndarray, place: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of words that windows at these places cover, touching ones as one."""
    order = np.lexsort((place, doc))
    doc, place = doc[order], place[order]
    new = runs(doc)
    new[1:] |= np.diff(place) > window
    last = np.append(new[1:], True) if len(new) else new
    return place[new].astype(np.int32), (place[last] + window).astype(np.int32), doc[new]


def repeated_windows(packed: DataFrame, window: int) -> DataFrame:
    """doc_id, start, end: words of windows that a smaller doc_id has."""

    def reduce(table: pa.Table) -> pa.Table:
        kind = np.array(table["kind"].to_pylist())
        blobs = table["packed"].to_pylist()
        h0, h1, doc, place = unpack([b for b, k in zip(blobs, kind, strict=True) if k == 0], ("u8", "u4", "i8", "i4"))
        order = np.lexsort((doc, h1, h0))
        h0, h1, doc, place = h0[order], h1[order], doc[order], place[order]
        new = runs(h0, h1)
        later = doc > doc[new][np.cumsum(new) - 1] if len(doc) else new
        start, end, whose = merged(doc[later], place[later].astype(np.int64), window)
        ready = unpack([b for b, k in zip(blobs, kind, strict=True) if k == 1], ("i8", "i4", "i4"))
        return pa.table(
            {
                "doc_id": np.concatenate((whose, ready[0])),
                "start": np.concatenate((start, ready[1])),
                "end": np.concatenate((end, ready[2])),
            }
        )

    return packed.groupBy("bucket").applyInArrow(reduce, "doc_id long, start int, end int")


KEPT = "doc_id long, n_words long, n_removed long, kept string"


def remaining(batch: pa.RecordBatch, doc: np.ndarray, low: np.ndarray, high: np.ndarray) -> pa.RecordBatch:
    """The documents of a batch (id, text) without the words of ranges, which are in order of doc."""
    data, at = flat(batch.column("text"))
    ids = batch.column("id").to_numpy(zero_copy_only=False)
    if len(doc):
        begin, end = (np.searchsorted(doc, ids, side) for side in ("left", "right"))
    else:
        begin = end = np.zeros(len(ids), np.int64)
    ranges = end - begin
    total, gone, kept = [], [], []
    for a, b in chunks(data, at):
        body, edges = data[at[a] : at[b]], at[a : b + 1] - at[a]
        start, end_, first = words(body, edges)
        row = np.repeat(np.arange(b - a), ranges[a:b])
        own = np.arange(len(row)) - np.repeat(np.cumsum(ranges[a:b]) - ranges[a:b] - begin[a:b], ranges[a:b])
        out = covered(len(start), first[row] + low[own], first[row] + high[own])
        row = np.repeat(np.arange(b - a), np.diff(first))
        k = np.flatnonzero(~out)
        mask = covered(len(body), start[k], end_[k])
        between = k[np.append(row[k][1:] == row[k][:-1], False)] if len(k) else k
        text = body.copy()
        text[end_[between]] = 0x20
        mask[end_[between]] = True
        sizes = np.concatenate(([0], np.cumsum(mask)))[edges]
        total.append(np.diff(first))
        gone.append(np.bincount(row[out], minlength=b - a))
        kept.append(pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), b - a, [None, pa.py_buffer(sizes.astype(np.int64)), pa.py_buffer(text[mask])]
        ).cast(pa.binary()).cast(pa.string()))
    return pa.RecordBatch.from_arrays(
        [
            batch.column("id"),
            pa.array(np.concatenate([*total, np.zeros(0)]).astype(np.int64)),
            pa.array(np.concatenate([*gone, np.zeros(0)]).astype(np.int64)),
            pa.concat_arrays(kept) if kept else pa.array([], pa.string()),
        ],
        ["doc_id", "n_words", "n_removed", "kept"],
    )


def remove(texts: DataFrame, ranges: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the other words, joined by one space)."""

    def cut(table: pa.Table, found: pa.Table) -> pa.Table:
        found = found.sort_by("doc_id")
        columns = [found[c].to_numpy().astype(np.int64) for c in ("doc_id", "start", "end")]
        none = pa.schema([("doc_id", "i8"), ("n_words", "i8"), ("n_removed", "i8"), ("kept", "string")]).empty_table()
        return pa.Table.from_batches([*none.to_batches(), *(remaining(b, *columns) for b in table.to_batches())], none.schema)

    return texts.groupBy("grp").cogroup(ranges.groupBy("grp")).applyInArrow(cut, KEPT)


def untouched(texts: DataFrame) -> DataFrame:
    """As `remove`, where there is nothing to remove."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        for batch in batches:
            yield remaining(batch, none, none, none)

    return texts.mapInArrow(cut, KEPT)


def dedup_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Every document without the words of windows that a document with a smaller doc_id has."""
    docs = documents(docs).withColumnRenamed("doc_id", "id")
    buckets = bucket_count(text_bytes(docs), BUCKET_BYTES)
    group = lambda of: F.pmod(F.xxhash64(of), F.lit(buckets)).cast("int")
    texts = docs.where("id is not null").withColumn("grp", group("id"))
    answers = added(sketched(texts, buckets, window, gram))
    ranges = repeated_windows(windows_of(texts, answers, buckets, window, gram), window)
    kept = remove(texts, ranges.withColumn("grp", group("doc_id")))
    return kept.unionByName(untouched(docs.where("id is null")))


ship_with_tasks(__name__)
