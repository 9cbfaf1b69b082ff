"""Suffix, window and SimHash dedup against brute force, odd rows included."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from tarsift.llm import simhash_dedup, suffix_dedup, window_dedup


def utf8(text):
    return (text or "").encode()


def without_strings(rows, length=100):
    """(doc_id, text) to (removed, spans, remaining bytes)."""
    keyed = sorted({(i, t) for i, t, *_ in rows if i is not None}, key=lambda r: r[0])
    seen, out = set(), {}
    for i, text in keyed:
        b = utf8(text)
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if b[s : s + length] in seen:
                gone[s : s + length] = True
            seen.add(b[s : s + length])
        spans = int((gone & ~np.append([False], gone[:-1])).sum())
        out[i, text] = (int(gone.sum()), spans, np.frombuffer(b, np.uint8)[~gone].tobytes())
    return out


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 1])
def test_suffix_dedup(docs, rows, monkeypatch, hot):
    """With hot = 1 every anchor's window offsets are dealt out; results stay."""
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    want = without_strings(rows)
    found = suffix_dedup.dedup_repeats(docs).collect()
    assert len(found) == len(rows)
    of = {i: v for (i, _), v in want.items()}
    size = {i: len(utf8(t)) for i, t, *_ in rows}
    for r in found:
        if r.doc_id is not None:
            assert (r.n_removed, r.n_spans, bytes(r.kept)) == of[r.doc_id]
            assert r.n_bytes == size[r.doc_id]
    loose = Counter(bytes(r.kept) for r in found if r.doc_id is None)
    assert loose == Counter(utf8(t) for i, t, *_ in rows if i is None)


def test_suffix_dedup_rows(docs, rows):
    """All columns stay; texts are whole characters; unchanged rows, nulls too, are as they were."""
    found = suffix_dedup.dedup_documents(docs)
    assert found.columns == docs.columns
    want = without_strings(rows)
    kept = {i: b.decode(errors="ignore") for (i, _), (_, _, b) in want.items()}
    before = {i: t for i, t, *_ in rows if i is not None}
    for r in found.collect():
        if r.doc_id is None:
            continue
        if before[r.doc_id] is None:
            assert r.text is None
        else:
            assert r.text == kept[r.doc_id]
            assert r.n_chars == len(r.text)
        assert r.bucket == 3.0


def test_merged_order_is_sorted():
    rng = np.random.default_rng(1)
    body = rng.integers(97, 99, (500, 24)).astype(np.uint8)
    body[100:200] = body[:100]
    words = body.view(">u8").astype(np.uint64)
    shards = [a + suffix_dedup.shard_order(words[a : a + 64]) for a in range(0, 500, 64)]
    order, common = suffix_dedup.merged_order(words, shards)
    lines = [body[k].tobytes() for k in order]
    assert lines == sorted(lines)
    for k in range(1, 500):
        equal = next((j for j in range(24) if lines[k][j] != lines[k - 1][j]), 24)
        assert common[k] == equal


def test_window_dedup(docs, rows):
    keyed = sorted({(i, t) for i, t, *_ in rows if i is not None}, key=lambda r: r[0])
    seen, want = set(), {}
    for i, text in keyed:
        w = utf8(text).split()
        gone, new = [False] * len(w), set()
        for s in range(len(w) - 12):
            key = tuple(w[s : s + 13])
            if key in seen:
                gone[s : s + 13] = [True] * 13
            new.add(key)
        seen |= new
        want[i] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode())
    found = window_dedup.dedup_windows(docs).collect()
    assert len(found) == len(rows)
    for r in found:
        if r.doc_id is not None:
            assert (r.n_words, r.n_removed, r.kept) == want[r.doc_id]
        else:
            assert r.n_removed == 0


def plain_simhash(text, shingle):
    w = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "").encode().split()
    parts = [b" ".join(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))] if w else []
    counts = [0] * 64
    for part in parts:
        h = xxhash.xxh64_intdigest(part, seed=42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(parts))


def roots_of(values, radius):
    values = sorted(set(values))
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for k, a in enumerate(values):
        for b in values[:k]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    return {v: find(v) for v in values}


@pytest.mark.parametrize(("shingle", "radius", "segments"), [(3, 2, 3), (5, 7, 4)])
def test_simhash(docs, rows, shingle, radius, segments):
    prints = [plain_simhash(t, shingle) for _, t, *_ in rows]
    roots = roots_of(prints, radius)
    least = {}
    for (i, *_), f in zip(rows, prints, strict=True):
        if i is not None:
            least[roots[f]] = min(i, least.get(roots[f], i))
    want = Counter((i, f"{f:016x}", least.get(roots[f])) for (i, *_), f in zip(rows, prints, strict=True))
    found = simhash_dedup.near_duplicates(docs, shingle, radius, segments).select(
        "doc_id", simhash_dedup.hexadecimal().alias("fingerprint"), "component_id"
    )
    assert Counter(map(tuple, found.collect())) == want


@pytest.mark.parametrize(("radius", "segments", "hot"), [(2, 3, 16384), (7, 4, 16384), (7, 4, 5)])
def test_links_connect_what_is_near(spark, monkeypatch, radius, segments, hot):
    """Crowded fingerprints: the forest has the components of all pairs, hot keys dealt out or not."""
    monkeypatch.setattr(simhash_dedup, "HOT", hot)
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    values = set()
    for b in base:
        for _ in range(40):
            v = int(b)
            for bit in rng.choice(64, rng.integers(0, 6), replace=False):
                v ^= 1 << int(bit)
            values.add(v)
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    edges = simhash_dedup.links(spark.createDataFrame([(v,) for v in signed], "fp long"), radius, segments)
    named = {r.node: r.root for r in simhash_dedup.components(edges).collect()}
    roots = roots_of(values, radius)
    mine, groups = {}, {}
    for v, s in zip(values, signed, strict=True):
        mine.setdefault(named.get(s, s), set()).add(v)
        groups.setdefault(roots[v], set()).add(v)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, groups.values()))


def test_one_of_each(docs, rows):
    found = simhash_dedup.one_of_each(docs, 5, 7, 4)
    assert found.columns == docs.columns
    kept = found.collect()
    named = [r.doc_id for r in kept if r.doc_id is not None]
    assert len(named) == len(set(named))
    near = {r.component_id for r in simhash_dedup.near_duplicates(docs, 5, 7, 4).collect() if r.component_id is not None}
    assert set(named) == near
    assert len(kept) - len(named) == sum(i is None for i, *_ in rows)


def test_empty_tables(no_docs):
    assert suffix_dedup.dedup_repeats(no_docs).count() == 0
    assert suffix_dedup.dedup_documents(no_docs).count() == 0
    assert window_dedup.dedup_windows(no_docs).count() == 0
    assert simhash_dedup.near_duplicates(no_docs).count() == 0
    assert simhash_dedup.one_of_each(no_docs, 5, 7, 4).count() == 0


def with_phrase(phrase, documents):
    """Documents with one phrase in words that no other has; every tenth is the one before again."""
    texts = [" ".join([*(f"a{k}x{j}" for j in range(30)), phrase, *(f"b{k}x{j}" for j in range(30))]) for k in range(documents)]
    return [(k, texts[k - (k % 10 == 9)]) for k in range(documents)]


def largest_share(rows, of=lambda r: (r.bucket,)):
    sizes = Counter()
    for r in rows:
        sizes[of(r)] += len(r.packed)
    return max(sizes.values()) / sum(sizes.values())


def test_hot_anchor_is_dealt_out(spark, monkeypatch):
    """A phrase below the length, in other surroundings each time: no task gets it all."""
    monkeypatch.setattr(suffix_dedup, "HOT", 16)
    rows = with_phrase("a license line of some seventy bytes that is in every one of them", 300)
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    context, whole = [], suffix_dedup.repeats

    def seen(frame, length, gram):
        context.extend(frame.collect())
        return whole(frame, length, gram)

    monkeypatch.setattr(suffix_dedup, "repeats", seen)
    found = suffix_dedup.dedup_repeats(docs).collect()
    want = without_strings(rows)
    assert {(r.doc_id, r.n_removed, bytes(r.kept)) for r in found} == {(i, n, b) for (i, _), (n, _, b) in want.items()}
    assert largest_share(context, lambda r: (r.bucket, r.part)) < 0.05


def test_equal_surroundings_meet_before_the_shuffle(spark):
    text = with_phrase("some words", 1)[0][1]
    sizes = []
    for copies in (1, 50):
        docs = spark.createDataFrame([(k, text) for k in range(copies)], "doc_id long, text string").coalesce(1)
        found = suffix_dedup.anchors(docs, 8, 100, 32).collect()
        sizes.append(sum(len(r.packed) for r in found if r.kind == 0))
    assert sizes[0] == sizes[1] > 0


def test_windows_of_a_hot_gram_are_dealt_out(spark, monkeypatch):
    rows = with_phrase("six words that every document has", 300)
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    packed, whole = [], window_dedup.repeated_windows

    def seen(frame, window):
        packed.extend(frame.where("kind = 0").collect())
        return whole(frame, window)

    monkeypatch.setattr(window_dedup, "repeated_windows", seen)
    found = {r.doc_id: r.n_removed for r in window_dedup.dedup_windows(docs).collect()}
    assert found == {k: 66 if k % 10 == 9 else 0 for k, _ in rows}
    assert largest_share(packed) < 0.05


@pytest.mark.parametrize("size", [8, 1 << 10])
def test_small_sketches_overestimate_and_lose_nothing(spark, docs, rows, monkeypatch, size):
    """With few counters nearly all windows are estimated repeated; the result stays."""
    as_is = sorted((r.doc_id or -1, r.n_words, r.n_removed, r.kept) for r in window_dedup.dedup_windows(docs).collect())
    monkeypatch.setattr(window_dedup, "COUNTERS", size)
    few = sorted((r.doc_id or -1, r.n_words, r.n_removed, r.kept) for r in window_dedup.dedup_windows(docs).collect())
    assert few == as_is


def test_added_sketches_never_underestimate(spark, monkeypatch):
    """Every gram that several groups hold, or one twice, is estimated repeated; with wide sketches only few others."""
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdefgh") + str(rng.randrange(400)) for _ in range(90)) for _ in range(60)]
    texts += [f"{t} {texts[k]}" for k, t in enumerate(texts[:20], 7)]
    rows = [(k, t, k % 5) for k, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "id long, text string, grp int")
    for size, most in ((1 << 20, 0.05), (16, 1.01)):
        monkeypatch.setattr(window_dedup, "COUNTERS", size)
        reached = {k: [] for k in range(5)}
        for r in window_dedup.added(window_dedup.sketched(frame, 3, 13, 5)).collect():
            reached[r.grp] += [r.block << 32 | int(c) for c in np.frombuffer(r.counters, "<u4")]
        grams, count = {}, Counter()
        for _, t, grp in rows:
            data = np.frombuffer(t.encode(), np.uint8)
            w = window_dedup.Windows(data, np.array([0, len(data)]), 13, 5)
            own = w.grams[w.smallest(9)]
            grams.setdefault(grp, []).append(own)
            count.update(own.tolist())
        false, single = 0, 0
        for grp, parts in grams.items():
            own = np.concatenate(parts)
            said = window_dedup.estimated_repeated(own, np.sort(np.array(reached[grp], np.int64)), 3)
            twice = np.array([count[g] > 1 for g in own.tolist()])
            assert said[twice].all()
            false, single = false + said[~twice].sum(), single + (~twice).sum()
        assert false <= most * single
