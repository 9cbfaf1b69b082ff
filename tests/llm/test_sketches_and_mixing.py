"""Document fingerprints and mixing against plain models."""

from __future__ import annotations

from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tarsift.llm import fingerprint, mixing


def shingles(text):
    w = (text or "").encode().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints(docs, rows):
    """Against the order by doc_id; rows that tie by doc_id are equal here but for the missing ids."""
    found = fingerprint.fingerprinted(docs).select(
        "doc_id", "text", "edited", "next_text",
        fingerprint.as_text(F.col("sketch")).alias("own"),
        fingerprint.resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        fingerprint.resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    ).collect()
    assert len(found) == len(rows)
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: -r[0])
    following = {}
    for a, b in zip(order, order[1:], strict=False):
        if a[0] != b[0]:
            following[a[0]] = b[1] or ""
    same = {}
    for r in found:
        half = len(r.text) // 2
        assert r.edited == r.text[: len(r.text) - half] + r.next_text[:half]
        if r.doc_id in following and sum(i == r.doc_id for i, *_ in rows) == 1:
            assert r.next_text == following[r.doc_id]
        exact = likeness(shingles(r.text), shingles(r.edited))
        assert abs(r.near_edited - exact) < (0.2 if len(shingles(r.text) | shingles(r.edited)) > 128 else 1e-9)
        assert 0 <= r.near_next <= 1
        assert same.setdefault(r.text, r.own) == r.own
    # After the last (a missing doc_id) comes the first.
    last = [r for r in found if r.doc_id is None]
    assert sum(r.next_text == (order[0][1] or "") for r in last) >= 1


def test_ranges_do_not_change_the_order(docs, monkeypatch):
    want = Counter((r.doc_id, r.text, r.next_text) for r in fingerprint.fingerprinted(docs).collect())
    monkeypatch.setattr(fingerprint, "RANGE_BYTES", 500)
    assert Counter((r.doc_id, r.text, r.next_text) for r in fingerprint.fingerprinted(docs).collect()) == want


def test_sketches_merge(spark, docs):
    frame = fingerprint.with_sketch(docs.where("text is not null").select("doc_id", "text"), "text", "s", 16)
    parts = frame.withColumn("part", F.lit("all"))
    whole = fingerprint.merged(parts, ["part"], "s", 16).first()["s"]
    every = sorted({h for r in frame.collect() for h in r.s})[:16]
    assert whole == every
    two = spark.createDataFrame([([1, 5, 9], [2, 5])], "a array<long>, b array<long>")
    a, b = F.col("a"), F.col("b")
    got = two.select(
        fingerprint.merge(a, b, 3), fingerprint.resemblance(a, b, 8), fingerprint.containment(b, a, 8),
        fingerprint.distinct_shingles(a, 8),
    ).first()
    assert got[0] == [1, 2, 5]
    assert (got[1], got[2], got[3]) == (0.25, 0.5, 3.0)


def model_targets(sizes):
    """Reshares what is above the caps by weight until nothing is."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    budget, capped = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = budget - sum(2 * sizes[s] for s in capped)
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = {s for s in free if share[s] > 2 * sizes[s]}
        if not above:
            return {s: 2.0 * sizes[s] if s in capped else share[s] for s in names}
        capped |= above


def test_mix(docs, rows):
    sizes, most = defaultdict(int), defaultdict(int)
    for _, text, _, source, *_ in rows:
        n = len((text or "").encode().split())
        sizes[source] += n
        most[source] = max(most[source], n)
    want = model_targets(sizes)
    found = mixing.mix(docs).collect()
    assert len(found) == len(rows)
    taken = defaultdict(int)
    for r in found:
        assert r.source_size == sizes[r.source]
        assert abs(r.target - want[r.source]) < 1e-6
        assert r.taken == r.copies * r.size <= 2 * r.size
        taken[r.source] += r.taken
    for s in sizes:
        # Rows that repeat a doc_id are taken together: three of the largest at most.
        assert abs(taken[s] - want[s]) <= 3 * most[s]
    assert Counter(map(tuple, mixing.mix(docs).collect())) == Counter(map(tuple, found))


def test_mixture_keeps_columns(docs, monkeypatch):
    found = mixing.mixture(docs)
    assert found.columns == [*docs.columns, "copies"]
    want = Counter((r.doc_id, r.source, r.copies) for r in mixing.mix(docs).collect() if r.copies > 0)
    assert Counter((r.doc_id, r.source, r.copies) for r in found.collect()) == want
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert Counter((r.doc_id, r.source, r.copies) for r in mixing.mixture(docs).collect()) == want


def test_empty_tables(no_docs):
    assert fingerprint.fingerprinted(no_docs).count() == 0
    assert mixing.mix(no_docs).count() == 0
    assert mixing.mixture(no_docs).count() == 0


def test_native_plans_have_no_python(docs):
    for frame in (fingerprint.fingerprinted(docs), mixing.mix(docs)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
