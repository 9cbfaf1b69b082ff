"""One index for many patterns: no match is lost, and the plan does not grow with them."""

from __future__ import annotations

import random
import re

import pytest

from tarsift.config import ScanConfig
from tarsift.operators.pattern_index import PatternIndex, fragment
from tarsift.operators.signatures import Signature, SignatureString, scan_signatures
from tarsift.operators.user_rules import RuleSpec, apply_user_rules


@pytest.mark.parametrize(("pattern", "want"), [
    ("abc", b"abc"), ("ABCd", b"abcd"), (r"a\.b+cdef", b"cdef"), (r"(?i)x{2}Post\(", b"post("), ("(abc)+de", b"abc"),
    ("a|bcd", b""), ("[abc]de", b"de"), ("(?:ab|ac)xyz", b"xyz"), (r"\bfoo\s*bar_", b"bar_"), ("x?yz", b"yz"),
    (r"\p{L}abc", b""), (r"\0101bcd", b""), ("[a[bc]]def", b""), ("(?=abc)xy", b"xy"), ("", b""), ("a(?:bc){0,2}d", b"a"),
    (r"(?<!q)eval\s*\(", b"eval"), ("ab(cd(ef)?gh)ij", b"abcd"),
])
def test_fragments(pattern, want):
    assert fragment(pattern) == want


def test_no_pattern_that_matches_is_missing():
    rng = random.Random(2)
    pieces = ["foo", "Bar", "ev", "al", r"\d+", "[xyz]", "(a|b)", "q?", r"\s", "zz{2}", "(?:no)+", r"\.", "é"]
    patterns = ["".join(rng.choices(pieces, k=rng.randint(1, 4))) for _ in range(400)]
    patterns = [("(?i)" if rng.random() < 0.3 else "") + p.encode().decode("latin-1") for p in patterns]
    index = PatternIndex(patterns)
    compiled = [re.compile(p) for p in patterns]
    hit = seen = 0
    for _ in range(150):
        text = "".join(rng.choices(["foo", "BAR", "bar", "ev", "al", "7", "x", "a", " ", "zzz", "nono", ".", "é"], k=9))
        text = text.encode().decode("latin-1")
        found = set(index.candidates(text.encode("latin-1")))
        matching = {k for k, one in enumerate(compiled) if one.search(text)}
        assert matching <= found
        hit, seen = hit + len(matching), seen + len(found)
    assert hit and seen < 150 * 400


def by_hand(files, signatures):
    out = []
    for _, _, path, content in files:
        text = content.decode("latin-1")
        for one in signatures:
            spans = [[m.span() for m in re.finditer(s.pattern, text)] for s in one.strings]
            needed = len(one.strings) if one.needed is None else one.needed
            if sum(bool(s) for s in spans) >= needed:
                first = min((a, s.identifier) for s, found in zip(one.strings, spans, strict=True) for a, _ in found)
                out.append((path, one.rule, sum(map(len, spans)), first))
    return sorted(out)


def signatures(n: int, seed: int = 4) -> list[Signature]:
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh_", k=rng.randint(3, 9)))
    out = []
    for k in range(n):
        strings = []
        for i in range(rng.randint(1, 4)):
            kind = rng.randrange(3)
            value = word() if kind < 2 else word() + r"\d{1,3}" + rng.choice(["", word()])
            strings.append(SignatureString(f"${i}", value, is_regex=kind == 2, nocase=rng.random() < 0.3))
        out.append(Signature(f"rule{k}", tuple(strings), rng.choice([1, 1, 2, None]), tags=("apt",) * (k % 2)))
    return out


def planted(rng, some, words):
    out = [rng.choice(words) for _ in range(60)]
    for s in rng.sample([s for one in some for s in one.strings], 6):
        out.insert(rng.randrange(len(out)), re.sub(r"\\d\{1,3\}", "42", s.value))
    return " ".join(out).encode()


def test_five_thousand_signatures(spark):
    many = signatures(5000)
    rng = random.Random(6)
    files = [("n", "1", f"f{k}.js", planted(rng, many, ["abc", "hello", "xyz", "99"])) for k in range(60)]
    frame = spark.createDataFrame(files, "name string, version string, path string, content binary").repartition(4)
    plan = lambda found: re.sub(r"\d+", "", found._jdf.queryExecution().optimizedPlan().toString())
    few, all_of = scan_signatures(frame, many[:10]), scan_signatures(frame, many)
    assert plan(all_of) == plan(few)
    got = [
        (r["path"], r["yara_rule"], r["match_count"], (r["matched_strings"][0]["offset"], r["matched_strings"][0]["identifier"]))
        for r in all_of.collect()
    ]
    assert sorted(got) == by_hand(files, many)
    assert len({rule for _, rule, *_ in got}) > 100


def test_limits_and_empty_lists(spark):
    files = [("n", "1", "a.js", b"abcdef " * 300_000), ("n", "1", "b.js", b"abcdef"), ("n", "1", "c.js", b"")]
    frame = spark.createDataFrame(files, "name string, version string, path string, content binary")
    one = [Signature("r", (SignatureString("$a", "abcdef"),))]
    assert [r["path"] for r in scan_signatures(frame, one, ScanConfig(signature_max_mb=1)).collect()] == ["b.js"]
    assert scan_signatures(frame, []).count() == 0
    assert apply_user_rules(frame, []).count() == 0


def test_many_user_rules(spark):
    rng = random.Random(8)
    specs = [RuleSpec(f"r{k}", "low", f"w{k}x[0-9]+", suffixes=(".js",) if k % 3 else (".py",), limit=2) for k in range(1500)]
    texts = [" ".join(f"w{rng.randrange(1500)}x{rng.randrange(5)}" for _ in range(40)) for _ in range(20)]
    files = [("n", "1", f"f{k}{('.js', '.py')[k % 2]}", t.encode()) for k, t in enumerate(texts)]
    frame = spark.createDataFrame(files, "name string, version string, path string, content binary")
    want = []
    for _, _, path, content in files:
        for spec in specs:
            found = re.findall(spec.pattern, content.decode())
            if found and path.endswith(spec.suffixes):
                want.append((path, spec.name, len(found), list(dict.fromkeys(found))[:2]))
    got = [(r["path"], r["rule"], r["match_count"], r["samples"]) for r in apply_user_rules(frame, specs).collect()]
    assert sorted(got) == sorted(want)
