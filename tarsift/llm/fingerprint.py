"""Document fingerprints: bottom-k sketches of shingle hashes. Built-in functions only.

A sketch is the sorted array of the k smallest distinct 64-bit hashes of a text's shingles (five
words; a text with fewer is one shingle, a text without words has none). Equal texts have equal
sketches. Sketches of parts merge to the sketch of the whole. Two sketches estimate the
resemblance and the containment of their shingle sets, one estimates how many there are; sets
with at most k shingles are known exactly. Two empty sets resemble each other fully.

`with_next` gives every document the text that follows in descending doc_id (ties in the order
of a hash of the text, missing doc_ids last; after the last comes the first). Documents are
dealt to ranges of doc_id between approximate quantiles, which are doc_ids themselves; the
document on a boundary stands in the next range as well, behind its last one, so that each
range is a window of its own and nothing is sorted in one place.

Null texts count as empty. Repeated rows are documents of their own. Other columns are not
read. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarsift.llm.common import documents, text_bytes
from tarsift.llm.mixing import WHITE

K = 128
SHINGLE = 5
#: Text bytes of a range of documents.
RANGE_BYTES = 4 << 20
#: Most boundaries of ranges; they are part of the plan.
MOST_RANGES = 1 << 16
#: The smallest long, which stands for a missing doc_id.
LEAST = -(1 << 63)


def words(text: Column) -> Column:
    return F.filter(F.split(F.btrim(text, F.lit(WHITE)), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def with_sketch(frame: DataFrame, text: str, into: str, k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """The frame with the sketch of a text column. Word hashes are a column of their own, or the
    words would be cut anew for every shingle."""
    hashes, n = f"{into}_hashes", F.size(f"{into}_hashes")
    at = lambda i, j: F.get(F.col(hashes), i + j)
    several = F.transform(F.sequence(F.lit(0), n - shingle), lambda i: F.xxhash64(*(at(i, j) for j in range(shingle))))
    one = F.array(F.aggregate(hashes, F.lit(0).cast("long"), lambda a, w: F.xxhash64(a, w)))
    none = F.array().cast("array<bigint>")
    shingles = F.when(n >= shingle, several).when(n > 0, one).otherwise(none)
    return (
        frame.withColumn(hashes, F.transform(words(F.col(text)), lambda w: F.xxhash64(w)))
        .withColumn(into, bottom(shingles, k))
        .drop(hashes)
    )


def bottom(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together."""
    return bottom(F.concat(a, b), k)


def merged(frame: DataFrame, keys: list[str], sketch: str, k: int = K, salts: int = 64) -> DataFrame:
    """One sketch for each key over any number of rows, in two steps with bounded groups' state:
    hashes are counted distinct per (key, salt), each salt keeps k, then the salts meet."""
    rows = frame.select(*keys, F.explode(sketch).alias("h")).distinct()
    order = Window.partitionBy(*keys, "salt").orderBy("h")
    least = rows.withColumn("salt", F.pmod("h", F.lit(salts))).withColumn("n", F.row_number().over(order))
    kept = least.where(F.col("n") <= k).groupBy(*keys).agg(bottom(F.collect_list("h"), k).alias(sketch))
    empty = frame.select(*keys).distinct()
    return empty.join(kept, keys, "left").withColumn(sketch, F.coalesce(sketch, F.array().cast("array<bigint>")))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated shared part of all shingles of both, 0 to 1."""
    both = merge(a, b, k)
    shared = F.size(F.array_intersect(F.array_intersect(both, a), b))
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(shared / F.size(both))


def distinct_shingles(sketch: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    span = (F.element_at(sketch, -1).cast("double") - float(LEAST)) / float(1 << 64)
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise((k - 1) / span)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated part of a's shingles that b has, 0 to 1; 1 for an empty a."""
    j = resemblance(a, b, k)
    union = distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), j * union / distinct_shingles(a, k)))


def as_text(sketch: Column) -> Column:
    """The sketch as hexadecimal digits, 16 for each hash, in order."""
    return F.lower(F.array_join(F.transform(sketch, lambda h: F.lpad(F.hex(h), 16, "0")), ""))


def with_next(docs: DataFrame, columns: dict[str, str], step=lambda frame: frame) -> DataFrame:
    """docs (doc_id, text) with columns of the following document: {new name: its column}.

    `step` may add columns on the way, from which those named later in `columns` are taken.
    """
    key = F.coalesce("doc_id", F.lit(LEAST))
    ranges = max(1, min(MOST_RANGES, text_bytes(docs) // RANGE_BYTES))
    parts = [k / ranges for k in range(1, ranges + 1)]
    found = docs.agg(F.percentile_approx(key, parts, max(10_000, 4 * ranges))).first()[0] or [0]
    edges = sorted(set(found))
    array, last = F.array(*map(F.lit, edges)), len(edges) - 1
    if last > 255:  # a search by halves; short lists are one pass
        steps = [1 << b for b in range((last + 1).bit_length(), -1, -1)]
        place = F.aggregate(
            F.array(*map(F.lit, steps)),
            F.lit(0),
            lambda at, s: F.when(F.get(array, at + s - 1) < F.col("key"), at + s).otherwise(at),
        )
    else:
        place = F.size(F.filter(array, lambda edge: edge < F.col("key")))
    own = F.struct(F.col("place"), F.lit(0).alias("ghost"))
    behind = F.struct(
        F.when(F.col("place") == last, 0).otherwise(F.col("place") + 1).alias("place"),
        F.when(F.col("place") == last, 2).otherwise(1).alias("ghost"),
    )
    edge = F.get(array, F.col("place")) == F.col("key")
    order = Window.partitionBy("place").orderBy(F.col("ghost") == 2, F.col("key").desc(), "tie")
    frame = (
        docs.withColumn("key", key)
        .withColumn("place", place)
        .withColumn("stand", F.explode(F.when(edge, F.array(own, behind)).otherwise(F.array(own))))
        .withColumns({"place": F.col("stand.place"), "ghost": F.col("stand.ghost"), "tie": F.xxhash64("text")})
        .drop("stand")
    )
    for k, (name, column) in enumerate(columns.items()):
        frame = step(frame) if k == 1 else frame
        frame = frame.withColumn(name, F.lead(column).over(order))
    return frame.where("ghost = 0").drop("key", "place", "ghost", "tie")


def fingerprinted(docs: DataFrame, k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text, sketch; the edited text and its sketch; the next document's sketch."""
    docs = documents(docs)
    frame = with_next(
        docs, {"next_text": "text", "next_sketch": "sketch"}, lambda f: with_sketch(f, "text", "sketch", k, shingle)
    )
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.left("text", F.length("text") - half), F.left("next_text", half))
    return with_sketch(frame.withColumn("edited", edited), "edited", "edited_sketch", k, shingle)
