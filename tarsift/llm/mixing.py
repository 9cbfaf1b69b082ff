"""Mixing sources to target weights, by hash-threshold histograms. Built-in functions only.

Sources in code point order (missing last) weigh 3, 1, 2, repeating, and share 150 % of all
words. A target stops at twice its source's size; the excess goes to the others by weight. The
level at which the shares stand solves sum(min(2 * size, level * weight)) = budget, which is a
minimum of straight lines, so that the level is the largest of (budget - caps) / weights over
the sources in the order in which they reach their caps.

A document has a 60-bit hash of its doc_id. A source takes every document floor(target / size)
times, and once more those whose hash is below a threshold. The threshold is found from
histograms: words by source and upper 12 bits; the bucket in which the budget ends is refined by
the next 12 bits, and so on. Nothing is sorted, no source is gathered: rows meet the table of
(source, bucket), so that a source with a third of all rows is spread over 4,096 keys.

The document on which the budget ends is taken if that brings the source nearer to its target.
Documents with one doc_id have one hash and are taken together. Null text has size 0; a missing
doc_id is a value like any other; null is a source of its own. Other columns are not read. An
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarsift.llm.common import stored

#: Fixed values of the task: white space, weights, the share of all words, the cap.
WHITE = " \t\n\x0b\f\r"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
BITS = 12
LEVELS = 5
#: Sources whose plan (4,096 rows each) is sent to all executors: at most about 20 MB.
BROADCAST_SOURCES = 64


def word_count(text: Column) -> Column:
    body = F.btrim(text, F.lit(WHITE))
    return F.when(F.length(body) > 0, F.size(F.split(body, r"[\x20\x09-\x0D]+"))).otherwise(0).cast("long")


def bucket(level: int) -> Column:
    """The bits of the hash that a level's histogram is by."""
    return F.shiftright("h", BITS * (LEVELS - 1 - level)).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")


def facts_of(doc_id: Column, text: Column, source: Column) -> list[Column]:
    """source, size, and the hash: the upper 60 bits of an MD5 of doc_id."""
    name = F.concat(F.lit("mix:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return [
        source.cast("string").alias("source"),
        word_count(F.coalesce(text.cast("string"), F.lit(""))).alias("size"),
        F.conv(F.substring(F.md5(name.cast("binary")), 1, 15), 16, 10).cast("long").alias("h"),
    ]


def sized(docs: DataFrame) -> DataFrame:
    facts = facts_of(F.col("doc_id"), F.col("text"), F.col("source"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *facts)


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target, copies and rest, from source and source_size (a row each)."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weights = F.array(*map(F.lit, WEIGHTS))
    weighed = sizes.select(
        "*",
        F.get(weights, (F.row_number().over(order) - 1) % len(WEIGHTS)).alias("weight"),
        (F.sum("source_size").over(everything) * SHARE).alias("budget"),
    ).withColumn("full_at", CAP * F.col("source_size") / F.col("weight"))
    by_cap = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    after = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    capped = F.coalesce(F.sum("source_size").over(before), F.lit(0)) * CAP
    level = F.max((F.col("budget") - F.col("capped")) / F.col("open")).over(everything)
    target = F.least((CAP * F.col("source_size")).cast("double"), F.col("level") * F.col("weight"))
    return (
        weighed.select("*", capped.alias("capped"), F.sum("weight").over(after).alias("open"))
        .select("source", "source_size", "weight", level.alias("level"))
        .select("source", "source_size", target.alias("target"))
        .withColumn(
            "copies",
            F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"),
        )
        .withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size"))
    )


def ends(histogram: DataFrame, budgets: DataFrame) -> DataFrame:
    """source, bucket, left, words: where each source's budget (column left) ends, and what of
    it is left at the bucket's beginning. Sources whose budget never ends are missing."""
    running = Window.partitionBy("source").orderBy("bucket")
    summed = histogram.withColumn("upto", F.sum("words").over(running))
    met = summed.join(budgets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
    before = F.col("upto") - F.col("words")
    return met.where((before <= F.col("left")) & (F.col("left") < F.col("upto"))).select(
        "source", "bucket", (F.col("left") - before).alias("left"), "words"
    )


def thresholds(docs: DataFrame, budgets: DataFrame) -> DataFrame:
    """source and limit: documents with a smaller hash are taken once more."""
    found, inside = budgets, docs
    limit = F.lit(0).cast("long")
    for level in range(LEVELS):
        histogram = inside.groupBy("source", bucket(level).alias("bucket")).agg(F.sum("size").alias("words"))
        end = ends(histogram, found.select("source", "left"))
        if level:
            end = end.join(
                found.select(F.col("source").alias("of"), F.col("limit").alias("upper")),
                F.col("source").eqNullSafe(F.col("of")),
            )
        limit = (F.col("upper") * (1 << BITS) if level else F.lit(0).cast("long")) + F.col("bucket")
        # Written down: a row for each source, and next the rows of one bucket of each. A level
        # that were a plan over the levels before it would double with each of them.
        found = stored(end.select("source", "bucket", "left", "words", limit.alias("limit")))
        if level < LEVELS - 1:
            keys = found.select(F.col("source").alias("of"), F.col("bucket").alias("at"))
            within = F.col("source").eqNullSafe(F.col("of")) & (bucket(level) == F.col("at"))
            inside = stored(inside.join(keys, within).drop("of", "at"))
    # The last bucket holds the documents of one hash: taken if that is nearer to the target.
    nearer = (F.col("left") >= F.col("words") - F.col("left")).cast("long")
    return found.select("source", (F.col("limit") + nearer).alias("limit"))


def planned(docs: DataFrame) -> DataFrame:
    """Of each source (of) and bucket (at): source_size, target, copies, rest and limit."""
    histogram = docs.groupBy("source", bucket(0).alias("bucket")).agg(F.sum("size").alias("words"))
    shares = stored(targets(histogram.groupBy("source").agg(F.sum("words").alias("source_size"))))
    limits = thresholds(docs, shares.select("source", F.col("rest").alias("left")))
    # Rows meet (source, bucket), not the source alone: a hot source has as many keys as buckets.
    return (
        histogram.select("source", "bucket")
        .join(shares.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
        .join(limits.withColumnRenamed("source", "t"), F.col("source").eqNullSafe(F.col("t")), "left")
        .select(F.col("source").alias("of"), F.col("bucket").alias("at"), "source_size", "target", "copies", "rest", "limit")
    )


def taken(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """docs (source, size, h and others) with source_size, target, copies and taken."""
    # A budget that never ends takes everything; without a rest nothing is taken once more.
    more = F.when(F.col("limit").isNull(), F.col("rest") > 0).otherwise(F.col("h") < F.col("limit")).cast("long")
    return (
        docs.join(plan, F.col("source").eqNullSafe(F.col("of")) & (bucket(0) == F.col("at")))
        .withColumn("copies", F.col("copies") + more)
        .withColumn("taken", F.col("copies") * F.col("size"))
        .drop("of", "at", "rest", "limit")
    )


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, copies (times the document is taken), taken."""
    docs = stored(sized(docs))
    return taken(docs, planned(docs)).drop("h")


def mixture(docs: DataFrame) -> DataFrame:
    """The rows of docs that the mix takes, all columns, with copies: how often it takes them.

    The texts do not move if the plan is small (`BROADCAST_SOURCES` sources at most: it has a
    row for each source and bucket); else rows meet the plan by source and bucket.
    """
    names = docs.columns
    hidden = [f"c{k}" for k in range(len(names))]
    frame = docs.toDF(*hidden)
    facts = facts_of(*(F.col(hidden[names.index(c)]) for c in ("doc_id", "text", "source")))
    plan = stored(planned(stored(frame.select(*facts))))
    if plan.select("of").distinct().limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    return taken(frame.select(*hidden, *facts), plan).where("copies > 0").select(*hidden, "copies").toDF(*names, "copies")


#: DuckDB SQL for `mix` over documents, with plain running sums.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT] AS weight
  FROM d GROUP BY source),
c AS (
  SELECT *, coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / weight, source NULLS LAST
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
         sum(weight) OVER (ORDER BY 2 * source_size / weight, source NULLS LAST
                           ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS room
  FROM s),
v AS (SELECT max((1.5 * (SELECT sum(source_size) FROM s) - capped) / room) AS level FROM c),
t AS (
  SELECT source, source_size, least(2.0 * source_size, level * weight)::DOUBLE AS target,
         CASE WHEN source_size > 0 THEN floor(least(2.0 * source_size, level * weight)::DOUBLE / source_size)
              ELSE 0 END AS copies
  FROM s, v),
r AS (
  SELECT d.*, t.source_size, t.target, t.copies, t.target - t.copies * t.source_size AS rest,
         sum(size) OVER (PARTITION BY d.source ORDER BY h) AS upto,
         sum(size) OVER (PARTITION BY d.source, h) AS tied
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, round(target, 3) AS target,
       (size * (copies + CASE WHEN upto <= rest AND rest > 0 THEN 1
                              WHEN upto - tied <= rest AND rest - (upto - tied) >= upto - rest THEN 1
                              ELSE 0 END))::BIGINT AS taken
FROM r
"""
