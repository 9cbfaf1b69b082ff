"""Removal of long repeated byte strings, by merged suffix orders (Burrows-Wheeler style).

A string of `length` bytes that occurs twice has the same smallest 32-byte hash at the same
offset in both places (winnowing, smallest of every 69 for a length of 100). Only such anchors
that occur twice can lie in a repeated string, so the suffix structures are built over the
suffixes that begin at those anchors, not over all suffixes:

1. `anchors`: one pass over the texts; per bucket of anchor hashes one packed row of
   (anchor, hash of its surroundings, doc_id, place). Of the occurrences in a batch with equal
   surroundings only the earliest goes there; the others are known to be later.
2. `repeated_anchors`: a bucket keeps anchors that occur more than once. Occurrences with equal
   surroundings are one weighted string: all but the first are covered whole, the first stands
   for them.
3. `surroundings`: the bytes around the remaining anchors. Of an anchor with more than HOT kinds
   of surroundings, instead, a 96-bit hash of each string of `length` bytes that holds it, by
   buckets of that hash.
4. `repeats`: per bucket, shards of sorted suffixes with their preceding bytes (the transform's
   column) are merged by interleave refinement: the merged order starts as the shards after one
   another; each round splits the blocks by the next eight bytes, shards keep their own order,
   and blocks of one shard or one suffix are left alone. The round in which a border appears
   gives the common prefix of its neighbours. Then the column of preceding bytes extends all
   intervals backwards, one byte a step; an interval whose left and right parts reach the length
   is a repeated string, and all its places but the first are covered. The strings of hot anchors
   are grouped by their hashes.
5. `remove`: the covered ranges of each document meet its text.

Equal strings collapse on both sides of the shuffle. The bytes and strings of a hot anchor are
dealt out by content, to as many buckets as there are; step 2 alone has all kinds of surroundings
of one anchor in one task, at 28 bytes each.

Rows with null text count as empty. Rows without doc_id are kept unchanged. doc_id names a
document: rows that repeat one repeat its text and get equal results, none is earlier than the
other. Only doc_id and text are read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarsift.llm.common import (
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
)
from tarsift.llm.window_dedup import merged
from tarsift.session import ship_with_tasks

LENGTH = 100
GRAM = 32
#: Text bytes for each bucket of anchors.
BUCKET_BYTES = 4 << 20
#: Suffixes of one shard.
SHARD = 4096
#: Distinct surroundings of one anchor beyond which its strings are dealt out by their hashes.
HOT = 4096
#: What a packed row of step 3 holds: surroundings, hashes of a hot anchor's strings, known ranges.
PLAIN, STRINGS, RANGES = range(3)
NEVER = (1 << 64) - 1
#: 48 bits of an anchor's hash (its bucket knows more) and of its surroundings', doc_id, place.
KINDS = ("u4", "u2", "u4", "u2", "i8", "i4")
#: Two hashes of a string, doc_id, where it starts.
STRING_KINDS = ("u8", "u4", "i8", "i4")


def find_anchors(data: np.ndarray, at: np.ndarray, length: int, gram: int):
    """Row, place, hash and surroundings' hash of each anchor of a chunk of documents."""
    n, width = len(data), length - gram + 1
    sizes = np.diff(at)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    left_in = at[rows + 1] - np.arange(n) if n else np.zeros(0, np.int64)
    sums = prefix_sums(data)
    place = np.arange(max(0, n - gram + 1))
    grams = np.full(n, U64(NEVER))
    grams[: len(place)] = range_hash(sums, place, place + gram)
    grams[grams == 0] = U64(1)
    grams[left_in < gram] = U64(NEVER)
    least = sliding(grams, width, np.minimum, NEVER)
    least[left_in < length] = 0
    most = sliding(least[::-1], width, np.maximum, 0)[::-1]
    j = np.flatnonzero((most == grams) & (grams != U64(NEVER)))
    row = rows[j]
    start = np.maximum(at[row], j - (length - gram))
    end = np.minimum(at[row + 1], j + length)
    around = range_hash(sums, start, end) ^ mix((j - start).astype(np.uint64))
    return row, j - at[row], grams[j], around


def halves(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lower 48 bits in two columns."""
    return h.astype(np.uint32), (h >> U64(32)).astype(np.uint16)


def labelled(batch: pa.RecordBatch, name: str, value: int) -> pa.RecordBatch:
    """bucket, the named column with one value, packed."""
    return pa.RecordBatch.from_arrays(
        [batch.column(0), pa.array(np.full(len(batch), value, np.int32)), batch.column(1)], ["bucket", name, "packed"]
    )


def earliest(names: list[np.ndarray], doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that are the first (doc, place) of their name, one for each; and rows that are later."""
    order = np.argsort(names[0], kind="stable")
    new = runs(*(c[order] for c in names))
    many = ~(new & np.append(new[1:], True)) if len(new) else new
    single, order = order[~many], order[many]
    order = order[np.lexsort((place[order], doc[order], *(c[order] for c in names[::-1])))]
    new = runs(*(c[order] for c in names))
    first = order[new][np.cumsum(new) - 1] if len(order) else order
    later = (doc[order] != doc[first]) | (place[order] != place[first])
    return np.concatenate((single, order[new])), order[later]


def anchors(docs: DataFrame, buckets: int, length: int, gram: int) -> DataFrame:
    """Per bucket, packed: kind 0, the occurrences, one for each batch, anchor and surroundings;
    kind 1 (doc_id, place), those that the batch has earlier with equal surroundings."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = flat(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            found = []
            for a, b in chunks(data, at):
                row, place, gram_hash, around = find_anchors(data[at[a] : at[b]], at[a : b + 1] - at[a], length, gram)
                found.append((gram_hash, around, ids[a + row], place.astype(np.int32)))
            if found:
                gram_hash, around, doc, place = (np.concatenate(c) for c in zip(*found, strict=True))
                i, later = earliest([around, gram_hash], doc, place)
                own = [*halves(gram_hash[i]), *halves(around[i]), doc[i], place[i]]
                yield labelled(by_bucket(bucket_of(gram_hash[i], buckets), own), "kind", 0)
                whose = doc[later]
                yield labelled(by_bucket(bucket_of(whose.astype(np.uint64), buckets), [whose, place[later]]), "kind", 1)

    return docs.select("doc_id", "text").mapInArrow(scan, "bucket int, kind int, packed binary")


def repeated_anchors(packed: DataFrame, length: int, gram: int) -> DataFrame:
    """doc_id, place, first: of the anchors that occur more than once.

    first: the earliest occurrence with its surroundings, needed by step 4 (its bucket and
    anchor come along); others are covered whole. Earliest occurrences of anchors with one kind
    of surroundings are of no more use and are left out.
    """

    def reduce(table: pa.Table) -> pa.Table:
        kind, blobs = table["kind"].to_pylist(), table["packed"].to_pylist()
        known_doc, known_place = unpack([b for b, k in zip(blobs, kind, strict=True) if k], ("i8", "i4"))
        low, high, low_around, high_around, doc, place = unpack(
            [b for b, k in zip(blobs, kind, strict=True) if not k], KINDS
        )
        anchor = low.astype(np.uint64) | high.astype(np.uint64) << U64(32)
        around = low_around.astype(np.uint64) | high_around.astype(np.uint64) << U64(32)
        order = np.lexsort((place, doc, around, anchor))
        anchor, around, doc, place = anchor[order], around[order], doc[order], place[order]
        new_anchor, new_class = runs(anchor), runs(anchor, around)
        group = np.cumsum(new_anchor) - 1
        kind = np.cumsum(new_class) - 1
        classes = np.bincount(group, new_class, minlength=1)[group] if len(group) else group
        first_doc, first_place = doc[new_class][kind], place[new_class][kind]
        later = (doc != first_doc) | (place != first_place)
        wanted = new_class & (classes > 1)
        keep = later | wanted
        bucket = table["bucket"][0].as_py()
        n, known = int(keep.sum()), np.zeros(len(known_doc), bool)
        return pa.table(
            {
                "doc_id": np.concatenate((doc[keep], known_doc)),
                "place": np.concatenate((place[keep], known_place)),
                "first": np.concatenate((wanted[keep], known)),
                "bucket": np.full(n + len(known), bucket, np.int32),
                "hot": np.concatenate((classes[keep] > HOT, known)),
            }
        )

    return packed.groupBy("bucket").applyInArrow(
        reduce, "doc_id long, place int, first boolean, bucket int, hot boolean"
    )


def surroundings(joined: DataFrame, buckets: int, length: int, gram: int) -> DataFrame:
    """Per bucket, packed. PLAIN: left and right sizes, doc_id, place; and the bytes. Of hot anchors
    STRINGS: two hashes, doc_id and start, one for each batch and string; RANGES: doc_id, start and
    end of what the batch has earlier."""
    reach = length - gram

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = flat(batch.column("text"))
            marks = batch.column("marks")
            of = np.repeat(np.arange(len(marks)), marks.value_lengths().to_numpy(zero_copy_only=False))
            inner = marks.flatten()
            place, first, bucket, hot = (inner.field(k).to_numpy(zero_copy_only=False) for k in range(4))
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            take = np.flatnonzero(first)
            of, place, bucket, hot = of[take], place[take].astype(np.int64), bucket[take], hot[take]
            some = np.flatnonzero(~hot)
            for c in range(0, len(some), 1 << 14):
                i = some[c : c + (1 << 14)]
                j = at[of[i]] + place[i]
                left = np.minimum(place[i], reach).astype(np.int16)
                right = (np.minimum(at[of[i] + 1], j + length) - j).astype(np.int16)
                yield strings(data, j, left, right, reach, length, bucket[i], ids[of[i]], place[i])
            if hot.any():
                yield from hashed(data, at, ids, of[hot], place[hot])

    def hashed(data, at, ids, of, place) -> Iterator[pa.RecordBatch]:
        for a, b in chunks(data, at):
            own = (of >= a) & (of < b)
            if not own.any():
                continue
            sums = [prefix_sums(data[at[a] : at[b]], k) for k in range(2)]
            # Each place where a string that holds the anchor starts, once for each row of docs.
            row = np.repeat(of[own], reach + 1)
            start = np.repeat(place[own], reach + 1) - np.tile(np.arange(reach + 1), int(own.sum()))
            inside = (start >= 0) & (start + length <= (at[1:] - at[:-1])[row])
            row, start = row[inside], start[inside]
            i = at[row] - at[a] + start
            h0, h1 = (range_hash(sums[k], i, i + length, k) for k in range(2))
            h1, doc, start = h1.astype(np.uint32), ids[row], start.astype(np.int32)
            i, later = earliest([h0, h1], doc, start)
            yield labelled(by_bucket(bucket_of(h0[i], buckets), [h0[i], h1[i], doc[i], start[i]]), "part", STRINGS)
            low, high, whose = merged(doc[later], start[later].astype(np.int64), length)
            yield labelled(by_bucket(bucket_of(whose.astype(np.uint64), buckets), [whose, low, high]), "part", RANGES)

    def strings(data, j, left, right, most_left, most_right, bucket, doc, place):
        span = np.arange(-most_left, most_right)
        inside = (span >= -left[:, None]) & (span < right[:, None])
        index = np.clip(j[:, None] + span, 0, max(0, len(data) - 1))
        body = np.where(inside, data[index], np.uint8(0))
        order = np.argsort(bucket, kind="stable")
        edge = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))
        blobs, names = [], []
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            k = order[a:b]
            blobs.append(pack(left[k], right[k], doc[k], place[k].astype(np.int32), body[k]))
            names.append(bucket[k[0]])
        n = len(names)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.array(names, np.int32)), pa.array(np.full(n, PLAIN, np.int32)), pa.array(blobs, pa.binary())],
            ["bucket", "part", "packed"],
        )

    return joined.mapInArrow(cut, "bucket int, part int, packed binary")


def shard_order(words: np.ndarray) -> np.ndarray:
    """The sorted order of one shard's suffixes, given as rows of big-endian words."""
    return np.lexsort(words.T[::-1])


def merged_order(words: np.ndarray, shards: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes in order, and the common prefix (in bytes) of each with the one before.

    Interleave refinement: `order` lists suffixes by block; within a block every shard's
    suffixes stand in that shard's order. A round splits blocks by the next word. A stable sort
    of (block, word) keeps the shards' own order, so that blocks of one suffix or of one shard
    need no more rounds for the order; for the common prefixes their words are compared once.
    """
    order = np.concatenate(shards) if shards else np.zeros(0, np.int64)
    n, rounds = len(order), words.shape[1]
    shard = np.repeat(np.arange(len(shards)), [len(s) for s in shards])
    border = np.zeros(n, bool)
    border[:1] = True
    common = np.full(n, rounds * 8, np.int32)
    common[:1] = 0
    for t in range(rounds):
        block = np.cumsum(border) - 1
        size = np.bincount(block) if n else block
        live = np.flatnonzero(size[block] > 1) if n else block
        if not len(live):
            break
        symbol = words[order[live], t]
        mixed = runs(block[live]) | (np.diff(shard[live], prepend=-1) == 0)
        if not mixed.all():  # some block has suffixes of several shards
            again = np.lexsort((symbol, block[live]))
            order[live], shard[live], symbol = order[live][again], shard[live][again], symbol[again]
        split = np.zeros(len(live), bool)
        split[1:] = (symbol[1:] != symbol[:-1]) & (block[live][1:] == block[live][:-1])
        i = np.flatnonzero(split)
        common[live[i]] = 8 * t + equal_bytes(symbol[i], symbol[i - 1])
        border[live[i]] = True
    first = np.flatnonzero(border)
    common[first[common[first] == rounds * 8]] = 0
    return order, common


def equal_bytes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal leading bytes of two different big-endian words."""
    differ, out = a ^ b, np.zeros(len(a), np.int32)
    for k in range(1, 8):
        out += (differ >> U64(64 - 8 * k)) == 0
    return out


def repeats(context: DataFrame, length: int, gram: int) -> DataFrame:
    """doc_id, start, end: bytes that an earlier place covers, from merged suffix orders."""
    reach = length - gram

    def reduce(table: pa.Table) -> pa.Table:
        part = table["part"][0].as_py()
        blobs = table["packed"].to_pylist()
        del table
        if part == STRINGS:
            h0, h1, doc, start = unpack(blobs, STRING_KINDS)
            _, later = earliest([h0, h1], doc, start)
            start, end, whose = merged(doc[later], start[later].astype(np.int64), length)
            return pa.table({"doc_id": whose, "start": start, "end": end})
        if part == RANGES:
            return pa.table(dict(zip(("doc_id", "start", "end"), unpack(blobs, ("i8", "i4", "i4")), strict=True)))
        wide = reach + length
        left, right, doc, place, body = [], [], [], [], []
        for blob in blobs:
            n = len(blob) // (16 + wide)
            for into, kind, offset in ((left, "i2", 0), (right, "i2", 2), (doc, "i8", 4), (place, "i4", 12)):
                into.append(np.frombuffer(blob, kind, n, offset * n))
            body.append(np.frombuffer(blob, np.uint8, n * wide, 16 * n).reshape(n, wide))
        left, right, doc, place = map(np.concatenate, (left, right, doc, place))
        body = np.concatenate(body)
        del blobs
        low_cut, high_cut = backward(left, right, doc, place, body)
        hit = np.flatnonzero(high_cut >= 0)
        return pa.table(
            {
                "doc_id": doc[hit],
                "start": (place[hit] - high_cut[hit]).astype(np.int32),
                "end": (place[hit] - low_cut[hit] + length).astype(np.int32),
            }
        )

    def backward(left, right, doc, place, body):
        """Least and most offset of the windows that an earlier place has, by suffix; -1: none."""
        n, high = len(left), reach
        most_right = body.shape[1] - high
        padded = np.zeros((n, -(-most_right // 8) * 8), np.uint8)
        padded[:, :most_right] = body[:, high:]
        words = padded.view(">u8").astype(np.uint64)
        shards = [a + shard_order(words[a : a + SHARD]) for a in range(0, n, SHARD)]
        order, common = merged_order(words, shards)
        left, right, body = left[order], right[order], body[order]
        when = np.empty(n, np.int64)
        when[np.lexsort((place[order], doc[order]))] = np.arange(n)
        same = doc[order], place[order]
        least, most = np.full(n, -1, np.int16), np.full(n, -1, np.int16)
        # Blocks of equal left parts; the column of preceding bytes refines them a byte a step.
        block = np.zeros(n, np.int64)
        live = np.arange(n)
        for o in range(high + 1):
            if o:
                live = live[left[live] >= o]
                key = block[live] * 256 + body[live, high - o]
                _, block_live = np.unique(key, return_inverse=True)
                block[live] = block_live
            interval = np.cumsum(common < length - o)
            some = live[right[live] >= length - o]
            if len(some) < 2:
                continue
            key = block[some] * (n + 1) + interval[some]
            by = np.lexsort((when[some], key))
            some, key = some[by], key[by]
            first = some[np.maximum.accumulate(np.where(runs(key), np.arange(len(some)), 0))]
            later = (same[0][some] != same[0][first]) | (same[1][some] != same[1][first])
            hit = some[later]
            least[hit] = np.where(least[hit] < 0, o, least[hit])
            most[hit] = o
        back_least, back_most = np.empty(n, np.int64), np.empty(n, np.int64)
        back_least[order], back_most[order] = least, most
        return back_least, back_most

    return context.groupBy("bucket", "part").applyInArrow(reduce, "doc_id long, start int, end int")


def covered_ranges(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """docs with what is to be removed from each row's text: marks and ranges (null: none).

    Both joins are by doc_id over the same exchange of the texts, which moves once.
    """
    keyed = docs.where("doc_id is not null")
    buckets = bucket_count(text_bytes(docs), BUCKET_BYTES)
    found = repeated_anchors(anchors(keyed, buckets, length, gram), length, gram)
    per_doc = found.groupBy(F.col("doc_id").alias("of")).agg(
        F.collect_list(F.struct("place", "first", "bucket", "hot")).alias("marks")
    )
    # Under another name: of a column that keeps its name one of the two plans would lose the
    # alias, and the exchanges would no longer be equal.
    texts = keyed.withColumnRenamed("doc_id", "id")
    marked = texts.join(per_doc.hint("shuffle_hash"), F.col("id") == F.col("of"), "left").drop("of")
    context = surroundings(marked.where("exists(marks, m -> m.first)"), buckets, length, gram)
    cut = (
        repeats(context, length, gram)
        .groupBy(F.col("doc_id").alias("of"))
        .agg(F.collect_list(F.struct("start", "end")).alias("ranges"))
    )
    ranged = marked.join(cut.hint("shuffle_hash"), F.col("id") == F.col("of"), "left").drop("of")
    ranged = ranged.withColumnRenamed("id", "doc_id")
    return ranged.unionByName(docs.where("doc_id is null"), allowMissingColumns=True)


def remove(ranged: DataFrame, length: int, gram: int, columns: list[str]) -> DataFrame:
    """The named columns, n_bytes, n_removed, n_spans, kept (the remaining bytes)."""
    reach = length - gram
    own_schema = ", ".join(f"{c} {ranged.schema[c].dataType.simpleString()}" for c in columns)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = flat(batch.column("text"))
            sizes = np.diff(at)
            rows = len(sizes)
            marks, ranges = batch.column("marks"), batch.column("ranges")
            gone, spans, kept = np.zeros(rows, np.int64), np.zeros(rows, np.int64), []
            for i in range(rows):
                own = data[at[i] : at[i + 1]]
                start, end = [], []
                if marks[i].is_valid:
                    inner = marks[i].values
                    place = inner.field(0).to_numpy()[~inner.field(1).to_numpy(zero_copy_only=False)].astype(np.int64)
                    start.append(np.maximum(0, place - reach))
                    end.append(np.minimum(len(own), place + length))
                if ranges[i].is_valid:
                    inner = ranges[i].values
                    start.append(inner.field(0).to_numpy())
                    end.append(inner.field(1).to_numpy())
                if start:
                    out = covered(len(own), np.concatenate(start), np.concatenate(end))
                    gone[i] = out.sum()
                    spans[i] = (out & ~np.concatenate(([False], out[:-1]))).sum()
                    own = own[~out]
                kept.append(own.tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in columns]
                + [pa.array(sizes), pa.array(gone), pa.array(spans), pa.array(kept, pa.binary())],
                [*columns, "n_bytes", "n_removed", "n_spans", "kept"],
            )

    return ranged.select("text", "marks", "ranges", *columns).mapInArrow(
        cut, f"{own_schema}, n_bytes long, n_removed long, n_spans long, kept binary"
    )


def dedup_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id and its text without the strings of `length` bytes that start earlier as well."""
    return remove(covered_ranges(documents(docs), length, gram), length, gram, ["doc_id"])


def whole_characters(kept: Column) -> Column:
    """The bytes as text. Cut characters become U+FFFD, which goes unless the text holds its own."""
    text = F.make_valid_utf8(kept.cast("string"))
    return F.when(F.is_valid_utf8(kept.cast("string")), text).otherwise(F.replace(text, F.lit("\ufffd"), F.lit("")))


def dedup_documents(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """The rows of docs, all columns, with the remaining text and (where there is one) its n_chars.

    Unchanged texts stay as they are. Of a character that is removed in part nothing stays.
    """
    names = docs.columns
    hidden = [f"c{k}" for k in range(len(names))]
    frame = docs.toDF(*hidden)
    doc_id, text = hidden[names.index("doc_id")], hidden[names.index("text")]
    rows = frame.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
        F.struct(*(c for c in hidden if c != text), F.col(text).isNull().alias("none")).alias("rest"),
    )
    cut = remove(covered_ranges(rows, length, gram), length, gram, ["rest"])
    out = cut.withColumn("new", F.when(~F.col("rest.none"), whole_characters(F.col("kept"))))
    columns = []
    for name, c in zip(names, hidden, strict=True):
        if c == text:
            columns.append(F.col("new"))
        elif name == "n_chars":
            kind = frame.schema[c].dataType
            columns.append(F.coalesce(F.length("new").cast(kind), F.col(f"rest.{c}")))
        else:
            columns.append(F.col(f"rest.{c}"))
    return out.select(*columns).toDF(*names)


ship_with_tasks(__name__)
