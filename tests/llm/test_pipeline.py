"""The pipeline's stages one by one and as a whole, on odd rows and on the driver's tables."""

from __future__ import annotations

import pytest

import corpus_pipeline
from tarsift.llm import decontamination, quality, simhash_dedup, suffix_dedup
from tarsift.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def folder(spark, docs, rows, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("tables"))
    docs.write.parquet(f"{top}/documents.parquet")
    labels = [(r[0], int(k % 5 > 0)) for k, r in enumerate(rows) if k % 2]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{top}/labels.parquet")
    item = next(t for _, t, *_ in rows if t and len(t.split()) > 100)
    bench = [(1, " ".join(item.split()[40:70])), (2, None)]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return top


def by_hand(rows) -> set[int]:
    """The smallest doc_id of each group that links of at most two bits connect."""
    prints = [(r.doc_id, simhash_dedup.simhash((r.text or "").encode(), 3)) for r in rows]
    least = {i: i for i, _ in prints}
    changed = True
    while changed:
        changed = False
        for i, x in prints:
            for j, y in prints:
                if (x ^ y).bit_count() <= 2 and least[j] < least[i]:
                    least[i], changed = least[j], True
    return set(least.values())


def test_stages(spark, docs, folder):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == [
        "quality_classifier", "simhash_near_dedup", "suffix_array_dedup", "benchmark_decontamination", "source_mixing",
    ]
    current = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, current, folder)
        path = f"{folder}/stage-{k}"
        after.write.parquet(path)
        after = spark.read.parquet(path)
        if k + 1 < len(names):
            assert after.columns == docs.columns, name
        before, kept = (sorted(str(r.doc_id) for r in f.collect()) for f in (current, after))
        assert set(kept) <= set(before)
        if name == "simhash_near_dedup":
            groups = by_hand(current.where("doc_id is not null").select("doc_id", "text").collect())
            assert sorted(r.doc_id for r in after.where("doc_id is not null").collect()) == sorted(groups)
        if name == "suffix_array_dedup":
            assert kept == before
            # What an earlier place had is gone: exact copies of 100 bytes start only once.
            again = suffix_dedup.dedup_repeats(current).where("n_removed > 0").select("doc_id").collect()
            changed = {r.doc_id: r.text for r in current.collect()}
            now = {r.doc_id: r.text for r in after.collect()}
            assert {r.doc_id for r in again} == {i for i in now if i is not None and now[i] != changed[i]}
        if name == "benchmark_decontamination":
            bench = spark.read.parquet(f"{folder}/benchmark.parquet")
            assert not any(r.contaminated for r in decontamination.contamination(after, bench).collect())
        current = after


def test_run_is_the_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    want = sorted((str(r.doc_id), r.text or "", r.copies) for r in docs.collect())
    assert sorted((str(r.doc_id), r.text or "", r.copies) for r in corpus_pipeline.run(spark, folder).collect()) == want


def test_empty_table_passes(spark, no_docs, folder):
    docs = no_docs
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    assert docs.count() == 0


def test_registered(spark):
    import __spark_entry__ as entry

    assert {*QUERIES, "pipeline"} <= set(entry.queries())
    assert set(ORACLES) <= set(entry.oracle_sql())
    assert len({name.split("_")[0] for name in QUERIES}) == 13
    assert quality.THRESHOLD == 0.3


def test_mix_against_sql(spark):
    import duckdb

    folder = "/root/testdata/sf0.01"
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet')")
    want = sorted(db.sql(ORACLES["op7_mixing_sources"]).fetchall())
    assert sorted(map(tuple, QUERIES["op7_mixing_sources"](spark, folder).collect())) == want
