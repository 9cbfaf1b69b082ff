"""The corpus pipeline: stages over documents, each written and read again as the next one's input.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept. All but
the last return the columns of documents.

1. quality_classifier: documents that the classifier rejects go.
2. simhash_near_dedup: of each group of near copies the smallest doc_id stays. Documents link
   whose SimHash fingerprints (three-word shingles) differ in at most 2 of 64 bits, as in op5.
3. suffix_array_dedup: strings of 100 bytes that an earlier place has are cut from the texts.
4. benchmark_decontamination: documents that hold a benchmark item go.
5. source_mixing: documents that the mix takes, with `copies`: how often it takes them.

Rows without doc_id pass stages 2 and 3 as they are; null texts count as empty throughout. An
empty table passes all stages. No SQL expresses the classifier; tests hold stages against brute
force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarsift.llm import decontamination, mixing, quality, simhash_dedup, suffix_dedup
from tarsift.llm.common import stored


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.accepted(docs, quality.fit(docs, labels))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_dedup.one_of_each(docs, shingle=3, radius=2, segments=3)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_documents(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixture(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs)
    return docs
