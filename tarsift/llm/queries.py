"""The registered queries over the training-data operators, each over its whole table."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarsift.llm import (
    conversation_repair,
    decontamination,
    fingerprint,
    html_text,
    language_id,
    mixing,
    quality,
    simhash_dedup,
    suffix_dedup,
    token_alignment,
    token_counts,
    vector_dedup,
    window_dedup,
)
from tarsift.llm.common import held_out


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.dedup_repeats(table(spark, folder, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


def op2_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return window_dedup.dedup_windows(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")
    )


def op3_token_counts(spark: SparkSession, folder: str, vocabulary: str | None = None) -> DataFrame:
    """vocabulary: a file of a public tokenizer; none: the installed piece vocabulary."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("piece_bpe_32k.model")
    return token_counts.token_counts(table(spark, folder, "documents"), token_counts.unigram_pieces(str(vocabulary)))


def op4_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return quality.quality(docs, quality.fit(docs, table(spark, folder, "labels")))


def op5_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, folder, "documents")).select(
        "doc_id", simhash_dedup.hexadecimal().alias("fingerprint"), "component_id"
    )


def op6_document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    own, edited, following = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return fingerprint.fingerprinted(table(spark, folder, "documents")).select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint.as_text(own).alias("fingerprint"),
        fingerprint.as_text(edited).alias("edited_fingerprint"),
        fingerprint.resemblance(own, edited).alias("near_edited"),
        fingerprint.resemblance(own, following).alias("near_next"),
        fingerprint.containment(own, edited).alias("contained_in_edited"),
        fingerprint.distinct_shingles(own).alias("distinct_shingles"),
    )


def op7_mixing_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents")).select(
        "doc_id", "size", "source_size", F.round("target", 3).alias("target"), "taken"
    )


def op8_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return html_text.main_text(pages, html_text.fit(pages)).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars")
    )


def op9_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op10_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return language_id.identify(docs, language_id.fit(docs)).select(
        "doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected"
    )


def op11_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return vector_dedup.near_vectors(table(spark, folder, "embeddings"), least_cosine=0.93)


def file_bytes(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def op12_token_alignment(
    spark: SparkSession, folder: str, a_file: str | None = None, b_file: str | None = None
) -> DataFrame:
    """a_file, b_file: paths that Spark can read; none: the installed public tokenizers' files."""
    import public_tokenizers

    contents = []
    for path, name in ((a_file, "byte_bpe_50k.json"), (b_file, "piece_bpe_32k.model")):
        contents.append(file_bytes(spark, path) if path else Path(public_tokenizers.path(name)).read_bytes())
    return token_alignment.alignment(table(spark, folder, "documents"), *contents)


def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return conversation_repair.repair(table(spark, folder, "conversations"))


QUERIES = {
    query.__name__: query
    for query in (
        op1_suffix_array_dedup,
        op2_substring_dedup,
        op3_token_counts,
        op4_quality_classifier,
        op5_simhash_near_dedup,
        op6_document_fingerprints,
        op7_mixing_sources,
        op8_html_extraction,
        op9_benchmark_decontamination,
        op10_language_id,
        op11_embedding_near_dedup,
        op12_token_alignment,
        op13_conversation_repair,
    )
}
#: The others are held against brute force, held-out labels or an exact rule in tests/llm.
ORACLES: dict[str, str] = {"op7_mixing_sources": mixing.ORACLE}
