"""Token alignment, vector near-dedup and conversation repair against brute force."""

from __future__ import annotations

import functools
import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql.types import (
    ArrayType,
    DoubleType,
    FloatType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from tarsift.llm import conversation_repair, token_alignment, vector_dedup
from tests.llm.conftest import SCHEMA, corpus, row

public_tokenizers = pytest.importorskip("public_tokenizers")
EMPTY = hashlib.sha256(b"").hexdigest()


@functools.cache
def files() -> tuple[bytes, bytes]:
    names = ("byte_bpe_50k.json", "piece_bpe_32k.model")
    return tuple(open(public_tokenizers.path(name), "rb").read() for name in names)


def whole_text_alignment(rows: list[tuple]) -> list[tuple]:
    """Both tokenizers over whole texts, groups by common ends, links by comparing byte ranges."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_file, b_file = files()
    a_side = Tokenizer.from_str(a_file.decode())
    a_side.encode_special_tokens = True
    names = {v: k for k, v in a_side.get_vocab(with_added_tokens=True).items()}
    plain = list(range(33, 127)) + list(range(161, 173)) + list(range(174, 256))
    letters = {chr(b): b for b in plain}
    letters.update({chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)})
    b_side = sentencepiece.SentencePieceProcessor(model_proto=b_file)

    def b_bytes(k):
        name = b_side.id_to_piece(k)
        return bytes([int(name[3:5], 16)]) if b_side.is_byte(k) else name.replace("▁", " ").encode()

    docs, counts = [], Counter()
    for doc_id, text in rows:
        a = b = []
        if text:
            body = (" " + text).encode()
            a = [(t, bytes(letters[c] for c in names[t])) for t in a_side.encode(" " + text, add_special_tokens=False).ids]
            b = [(t, b_bytes(t)) for t in b_side.encode(text)]
            if b"".join(x for _, x in a) != body or b"".join(x for _, x in b) != body:
                a = b = []
        spans = []
        for side in (a, b):
            at, out = 0, []
            for t, body in side:
                out.append((t, at, at + len(body)))
                at += len(body)
            spans.append(out)
        ends = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        links, groups, start = [], [], 0
        for end in ends:
            in_a = [x for x in spans[0] if start <= x[1] < end]
            in_b = [x for x in spans[1] if start <= x[1] < end]
            groups.append(",".join(str(x[0]) for x in in_a) + "|" + ",".join(str(x[0]) for x in in_b))
            links += [(x[0], y[0]) for x in in_a for y in in_b if x[1] < y[2] and y[1] < x[2]]
            start = end
        counts.update(links)
        docs.append((doc_id, len(a), len(b), groups, links))
    best = defaultdict(int)
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return sorted(
        (
            (
                doc_id,
                a,
                b,
                len(groups),
                len(links),
                sum(counts[p] == best[p[1]] for p in links),
                sum(counts[p] for p in links),
                hashlib.sha256(";".join(groups).encode()).hexdigest() if a else "",
            )
            for doc_id, a, b, groups, links in docs
        ),
        key=repr,
    )


ODD_TEXTS = [
    None, "", " ", "   ", "a", "  a  b ", "a\n b", "a \n  b\t\tc\n", "x\x1c y\x1c\x1c z", "don't  won't 's",
    "<|endoftext|> <s> </s> <unk> <0x41>", "a▁b", "▁", "é é ﬁ 日本語 テキスト 👩‍👩‍👧 　x y   z", "\x00", "!" * 300,
    "a" * 3000 + " " + "1" * 2000, "\r\n\r\n x\r y", "Thé Thé the the THE", "x " * 500, "\u0085 a\u0085 b",
]


def test_alignment_is_that_of_whole_texts(spark, monkeypatch):
    texts = [(k, t) for k, t in enumerate(ODD_TEXTS)] + [(r[0], r[1]) for r in corpus()]
    texts += [(None, "no id"), (3, "again"), (3, "again")]
    frame = spark.createDataFrame([row(i, t) for i, t in texts], SCHEMA).repartition(3)
    got = token_alignment.alignment(frame, *files())
    assert got.columns == token_alignment.NAMES
    assert sorted(map(tuple, got.collect()), key=repr) == whole_text_alignment(texts)


@pytest.mark.parametrize("part", [1, 50])
def test_alignment_does_not_depend_on_parts(part):
    tokenizers = token_alignment.Tokenizers(*files())
    pieces = sorted({p for t in ODD_TEXTS if t for p in token_alignment.CUT.split(" " + t)})
    whole = token_alignment.Aligned(tokenizers, pieces)
    for at in range(0, len(pieces), part):
        some = token_alignment.Aligned(tokenizers, pieces[at : at + part])
        assert some.text == whole.text[at : at + part]
        assert (some.sizes == whole.sizes[at : at + part]).all()


def test_long_texts_are_cut_where_nothing_crosses(monkeypatch):
    monkeypatch.setattr(token_alignment, "STRETCH", 7)
    for text in filter(None, ODD_TEXTS):
        found = list(token_alignment.stretches(" " + text))
        assert "".join(found) == " " + text
        cut = [p for s in found for p in token_alignment.CUT.split(s)]
        assert cut == token_alignment.CUT.split(" " + text)


def test_intervals_coalesce_where_both_end():
    a, b = np.array([0, 2, 3, 7, 9]), np.array([0, 3, 5, 9])
    group_a, group_b, left, right = token_alignment.coalesce(a[:-1], a[1:], b[:-1], b[1:])
    assert group_a.tolist() == [0, 0, 1, 1] and group_b.tolist() == [0, 1, 1]
    assert list(zip(left.tolist(), right.tolist(), strict=True)) == [(0, 0), (1, 0), (2, 1), (2, 2), (3, 2)]


def test_alignment_of_an_empty_table(spark):
    got = token_alignment.alignment(spark.createDataFrame([], SCHEMA), *files())
    assert got.columns == token_alignment.NAMES and got.count() == 0


VECTORS = StructType(
    [
        StructField("vec_id", LongType()),
        StructField("embedding", ArrayType(FloatType())),
        StructField("label", IntegerType()),
        *[StructField(name, DoubleType()) for name in ("id", "k1", "cell", "tile", "bucket", "n", "root", "a")],
    ]
)


def vector_rows(seed: int, dims: int, groups: int) -> list[tuple]:
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        centre = rng.normal(size=dims)
        for _ in range(int(rng.integers(1, 9))):
            near = centre + rng.normal(size=dims) * rng.choice([0.02, 0.15, 0.25, 0.3]) * rng.uniform(0.5, 1.2)
            rows.append(((near * rng.uniform(0.1, 50)).tolist(), int(g % 3)))
    rows += [rows[0]] * 5 + [(rows[1][0], 2)]
    rows += [(rows[2][0], None), (None, 1), ([], 1), ([0.0] * dims, 1), ([float("nan")] * dims, 1)]
    rows += [([float("inf")] + [1.0] * (dims - 1), 1), ([None] + [1.0] * (dims - 1), 1), ([1.0, 2.0], 1), ([2.0, 4.0], 1)]
    out = [(7 * k % 1009, v, label) for k, (v, label) in enumerate(rows)]
    out += [(None, rows[4][0], rows[4][1]), (out[5][0], *rows[5])]
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in out]


def all_pairs(rows: list[tuple], least: float) -> list[tuple]:
    def usable(v, label):
        return label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    n = len(rows)
    near = [[] for _ in rows]
    for i, j in itertools.combinations(range(n), 2):
        (_, v, a), (_, w, b) = rows[i], rows[j]
        if a == b and usable(v, a) and usable(w, b) and len(v) == len(w):
            v, w = np.array(v), np.array(w)
            if v @ w / (np.linalg.norm(v) * np.linalg.norm(w)) >= least:
                near[i].append(j)
                near[j].append(i)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[k][0] for k in seen if rows[k][0] is not None]
        low = min(ids) if ids else None
        out.append((rows[i][0], len(near[i]), low, rows[i][0] == low))
    return sorted(out, key=repr)


@pytest.mark.parametrize("dims", [5, 16])
def test_vectors_link_as_all_pairs_do(spark, monkeypatch, dims):
    """Visits are exact up to REACH**2 dimensions; parts of 3 rows make tiles of every kind."""
    monkeypatch.setattr(vector_dedup, "REACH", 4.0)
    monkeypatch.setattr(vector_dedup, "PART", 3)
    monkeypatch.setattr(vector_dedup, "PER_CELL", 8)
    monkeypatch.setattr(vector_dedup, "BLOCK", 4)
    rows = vector_rows(dims, dims, 40)
    frame = spark.createDataFrame([(*r, *[1.0] * 8) for r in rows], VECTORS)
    got = vector_dedup.near_vectors(frame)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(map(tuple, got.collect()), key=repr) == all_pairs(rows, 0.93)


def test_vectors_of_many_dimensions_keep_nearly_all_links(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "PER_CELL", 4)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(400, 64))
    pairs = base + rng.normal(size=base.shape) * 0.38
    rows = [(k, v.tolist(), 1) for k, v in enumerate(np.concatenate((base, pairs)).astype(np.float32))]
    frame = spark.createDataFrame([(*r, *[1.0] * 8) for r in rows], VECTORS)
    assert len(vector_dedup.centres(vector_dedup.distinct(vector_dedup.comparable(frame)))) > 100
    unit = np.array([r[1] for r in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    truth = ((unit @ unit.T) >= 0.93).sum() - len(rows)
    found = sum(r["n_links"] for r in vector_dedup.near_vectors(frame).collect())
    assert 200 < truth and 0.99 * truth <= found <= truth


def test_no_vectors(spark):
    assert vector_dedup.near_vectors(spark.createDataFrame([], VECTORS)).count() == 0
    odd = [(1, None, 1), (2, [1.0], None)]
    got = vector_dedup.near_vectors(spark.createDataFrame([(*r, *[1.0] * 8) for r in odd], VECTORS))
    assert sorted(map(tuple, got.collect())) == [(1, 0, 1, True), (2, 0, 2, True)]


def cheapest(rows: list[tuple[str, int]]) -> tuple[int, str]:
    """Row by row over the states of the pattern's automaton, audits compared in full."""
    states = {"start": (0, "")}
    moves = {("start", "s"): "s", ("start", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def better(into, state, value):
        if state not in into or value < into[state]:
            into[state] = value
            return True
        return False

    def insertions(states):
        grown = True
        while grown:
            grown = False
            for state, (cost, audit) in list(states.items()):
                for role in "ua":
                    if (state, role) in moves:
                        grown |= better(states, moves[state, role], (cost + 5, audit + "I"))
        return states

    for initial, fault in rows:
        new: dict = {}
        for state, (cost, audit) in insertions(states).items():
            better(new, state, (cost + 2, audit + "D"))
            if fault in (0, 3):
                more = 5 if fault == 3 else 0
                if (state, initial) in moves:
                    better(new, moves[state, initial], (cost + more, audit + "K"))
                for role in "ua":
                    if (state, role) in moves:
                        better(new, moves[state, role], (cost + 1 + more, audit + "R"))
        states = new
    states = insertions(states)
    return min(states[s] for s in ("start", "a") if s in states)


def test_parsing_finds_the_cheapest_edits():
    for n in range(5):
        for rows in itertools.product([(i, f) for i in "uasx" for f in (0, 1, 3)], repeat=n):
            assert conversation_repair.parse_rows(list(rows)) == cheapest(list(rows))
    rng = random.Random(4)
    for _ in range(300):
        kinds = rng.choice([(0, 0, 0, 1, 2, 3), (0,), (3,), (0, 0, 0, 0, 0, 0, 3)])
        rows = [(rng.choice("uasx"), rng.choice(kinds)) for _ in range(rng.choice([5, 9, 12, 13, 30, 145]))]
        assert conversation_repair.parse_rows(rows) == cheapest(rows)


CONVERSATIONS = StructType(
    [
        StructField("conv_id", LongType()),
        StructField("turn", LongType()),
        StructField("role", StringType()),
        StructField("text", StringType()),
        *[StructField(name, DoubleType()) for name in ("mark", "fault", "audit", "of", "step", "gaps", "place")],
    ]
)


def conversations(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for conv in [*range(60), None, 2**40]:
        long = rng.choice([0, 1, 3, 6, 9]) if conv != 7 else 400
        for k in range(long):
            turn = rng.choice([k, k, k, k, k + 1, None]) if conv != 8 else None
            role = rng.choice(["user", "assistant"] * 4 + ["system", "", None, "Üser", "tool"])
            role = ["user", "assistant"][k % 2] if rng.random() < 0.6 else role
            text = rng.choice(["Hello.", "ok", "What?\t \n", "", " \x0b", None, "a ", "No!", f"line {k}\nmore {k}."])
            rows.append((conv, turn, role, text))
    return rows + rows[3:5]


def repaired(rows: list[tuple]) -> list[tuple]:
    out = []
    for conv in {r[0] for r in rows}:
        damaged = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = (" " if x is None else x for x in (role, text))
            name = ":".join(" " if x is None else str(x) for x in (conv, turn))
            kind = zlib.crc32(name.encode()) % 20
            if kind == 1:
                text = ""
            if kind == 2:
                text = re.sub("[.!?]", "", text)
            if kind == 4:
                role = "user"
            damaged += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
        # Rows of one turn have no order of their own here: the operator's is asked for.
        damaged.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), MARKS[r[2]]))
        seen, faults = set(), []
        for _, role, text in damaged:
            black = re.sub(r"[\x20\x09-\x0d]", "", text)
            fault = 1 if not black else 2 if (role, text) in seen else 3 if black[-1] not in ".!?" else 0
            seen.add((role, text))
            faults.append(fault)
        turns = [t for t, _, _ in damaged if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[1][:1] for r in damaged]
        illegal = sum(x + y not in ("su", "ua", "au") for x, y in itertools.pairwise(initials))
        cost, audit = cheapest(list(zip(initials, faults, strict=True)))
        lines, last, at = [], "", 0
        for letter in audit:
            role, text = ("", "") if letter == "I" else damaged[at][1:]
            at += letter != "I"
            if letter in "IR":
                role = "assistant" if last == "u" else "user"
            if letter != "D":
                lines.append(f"{role}:{text}")
                last = role[0]
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv, gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit, sha))
    return sorted(out, key=repr)


MARKS: dict[str, int] = {}


@pytest.mark.parametrize("leaves", [2, 12])
def test_conversations_are_repaired_as_by_brute_force(spark, monkeypatch, leaves):
    monkeypatch.setattr(conversation_repair, "LEAVES", leaves)
    rows = conversations(9)
    frame = spark.createDataFrame([(*r, *[1.0] * 7) for r in rows], CONVERSATIONS)
    damaged = conversation_repair.damaged(frame).selectExpr("text", "xxhash64(text) AS mark").distinct()
    MARKS.update({r["text"]: r["mark"] for r in damaged.collect()})
    got = conversation_repair.repair(frame)
    assert got.columns == [c.split()[0] for c in conversation_repair.COLUMNS.split(", ")]
    assert sorted(map(tuple, got.collect()), key=repr) == repaired(rows)


def test_no_conversations(spark):
    assert conversation_repair.repair(spark.createDataFrame([], CONVERSATIONS)).count() == 0


def test_a_conversation_without_rows_after_damage(spark):
    gone = next((c, t) for c in range(100) for t in range(9) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    frame = spark.createDataFrame([(*gone, "user", "Hi.", *[1.0] * 7)], CONVERSATIONS)
    assert list(map(tuple, conversation_repair.repair(frame).collect())) == [(gone[0], 0, 0, 0, 0, 0, 0, "", EMPTY)]
