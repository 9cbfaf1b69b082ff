from __future__ import annotations

import base64
import json
import random
import re

import pytest

from tarsift import fixed_values as fv
from tarsift.config import ScanConfig
from tarsift.functions import text as tx
from tarsift.operators.content_rules import RULES, content_rule, scan_files
from tarsift.operators.locate import locate_matches
from tarsift.operators.signatures import Signature, SignatureString, scan_signatures
from pyspark.sql import functions as F


def files(spark, contents: dict[str, bytes]):
    rows = [("n", "1", path, content) for path, content in contents.items()]
    return spark.createDataFrame(rows, "name string, version string, path string, content binary")


def found(spark, rule, contents, config=None):
    rows = content_rule(files(spark, contents), rule, config).collect()
    return {r["path"]: r.asDict(recursive=True) for r in rows}


# --- a plain model of locations and URL findings, to hold the columns against -----------


def model_location(raw: bytes, start: int, size: int) -> tuple:
    line = raw[:start].count(b"\n") + 1
    column = start - (raw.rfind(b"\n", 0, start) + 1) + 1
    piece = raw[max(0, start - 120) : start + max(size, 60)].decode("utf-8", "ignore")
    piece = piece.replace("\x00", "").strip()
    return line, column, (piece[:237] + "..." if len(piece) > 240 else piece) or None


def model_urls(raw: bytes) -> dict:
    out: dict = {}
    for m in re.finditer(rb"https?://[^\s'\"]+", raw, re.I):
        url = m.group(0).decode("utf-8", "ignore")
        domain = re.match(r"[a-zA-Z]+://([^/?#]*)", url).group(1)
        if not domain or ("[" in domain) != ("]" in domain):
            continue
        entry = out.setdefault(domain, {"n": 0, "urls": [], "places": []})
        entry["n"] += 1
        entry["urls"].append(url)
        entry["places"].append(model_location(raw, m.start(), len(m.group(0))))
    return out


PIECES = [
    b"https://a.example/x ", b"HTTP://b.dev?q'", b"https://a.example/y\"", b"http://[::1/z ",
    b"https:///nothing ", b"https://\xff\xfe.c/ ", "https://é.net/ü ".encode(), b"\n", b"\n\n",
    b"text ", b"\x00", "жук ".encode(), b"\xe9(", b"   ", b"x" * 70, b"https://[fe80::1]:8/p ",
]


def random_contents(seed: int, count: int = 40) -> dict[str, bytes]:
    rng = random.Random(seed)
    sizes = [0, 1, 3, 20, 60, 700, 1500]
    return {
        f"package/f{i}.js": b"".join(rng.choices(PIECES, k=rng.choice(sizes))) for i in range(count)
    }


def test_url_findings_match_a_plain_model(spark):
    contents = random_contents(1)
    rows = content_rule(files(spark, contents), "url_domains").collect()
    got = {(r["path"], r["domain"]): r for r in rows}
    want = {(p, d): e for p, raw in contents.items() for d, e in model_urls(raw).items()}
    assert set(got) == set(want)
    for key, entry in want.items():
        row = got[key]
        assert row["url_count"] == entry["n"]
        assert row["sample_urls"] == entry["urls"][:3]
        places = [(p["line"], p["column"], p["snippet"]) for p in row["locations"]]
        assert places == entry["places"][:5]
        assert [p["match"] for p in row["locations"]] == entry["urls"][:5]


def test_many_matches_cross_chunks(spark):
    raw = b"".join(b"ab%d\n" % (i % 7) if i % 3 else b"  ab" for i in range(2000))
    rows = locate_matches(files(spark, {"a.js": raw}), "ab", 5000).orderBy("i").collect()
    want = [model_location(raw, m.start(), 2)[:2] for m in re.finditer(b"ab", raw)]
    assert [(r["line"], r["column"]) for r in rows] == want
    assert len(rows) > 2 * tx.CHUNK


def test_matches_that_span_lines(spark):
    raw = b"a\naxios\n\n(x) axios (y)\n axios\n("
    hit = found(spark, "net_client_usage", {"a.js": raw})["a.js"]
    want = [model_location(raw, m.start(), len(m.group(0)))[:2] for m in re.finditer(rb"axios\s*\(", raw)]
    assert [(p["line"], p["column"]) for p in hit["locations"]] == want
    assert hit["methods"] == ["axios\n\n(", "axios (", "axios\n("]


# --- single rules -----------------------------------------------------------------------


CASES = [
    ("net_client_usage", "http.get(x)", True),
    ("net_client_usage", "node_fetch (x)", True),
    ("net_client_usage", "httpXget", False),
    ("c2_webhook", "mytoast.show()", True),
    ("c2_webhook", "https://DISCORDAPP.com/API/x", True),
    ("c2_webhook", "discord.com/docs", False),
    ("writes_outside_pkg", "fs.writeFile('~/.bashrc')", True),
    ("writes_outside_pkg", "fs.writeFileSync('~/.bashrc')", False),
    ("writes_outside_pkg_candidate", "fs.writeFileSync('x')", False),
    ("writes_outside_pkg_candidate", "FS.mkdir (x)", True),
    ("ci_evasion", "if (process.env.CI_JOB) {}", True),
    ("env_snoop", "process.env.AWS_SECRET", True),
    ("env_snoop", "process.env.HOME", False),
    ("webpack_bundle", "var webpackJsonp=1", True),
    ("native_fetcher_present", "NODE-pre-gyp install", True),
    ("suspicious_pattern", "medieval (x)", False),
    ("suspicious_pattern", "é" + "eval(x)", True),
    ("suspicious_pattern", "new \n Function (x)", True),
    ("big_base64_blob", "A" * 119, False),
    ("big_base64_blob", "A" * 120, True),
    ("minified_long_lines", "a" * 3999 + "\n" + "b" * 3999, False),
    ("minified_long_lines", "a\r" + "b" * 3998, True),
    ("advanced_obfuscation", "function" * 50 + " " * 1000, False),
    ("advanced_obfuscation", "function " * 51 + " " * 1000, True),
    ("advanced_obfuscation", "\\x61" + " " * 1000, False),
    ("advanced_obfuscation", "жжж ж " * 3 + " " * 1000, False),
    ("advanced_obfuscation", "жжж ж " * 4 + " " * 1000, True),
]


@pytest.mark.parametrize("rule", sorted({case[0] for case in CASES}))
def test_javascript_rules(spark, rule):
    texts = {f"p/{i}.js": (text, hit) for i, (r, text, hit) in enumerate(CASES) if r == rule}
    hits = found(spark, rule, {path: text.encode() for path, (text, _) in texts.items()})
    assert {path: path in hits for path in texts} == {path: hit for path, (_, hit) in texts.items()}


def test_suffix_routing(spark):
    line = b"eval(x) https://evil.example/ "
    names = ["a.JS", "b.cjs", ".npmrc", "LICENSE", "c.tsx", "d.md", "e.json", "f.ts", "g.node"]
    rows = scan_files(files(spark, {f"package/{n}": line for n in names})).collect()
    scanned = {r["file_path"].rsplit("/", 1)[-1] for r in rows}
    assert scanned == {"a.JS", "b.cjs", ".npmrc", "LICENSE", "e.json", "f.ts"}


def test_magic_numbers(spark):
    heads = {"wasm": "0061736d", "pe": "4d5a", "elf": "7f454c46", "m1": "cffaedfe", "m2": "feedfacf", "m3": "cafebabe"}
    contents = {f"{k}.js": bytes.fromhex(h) + b"\x00rest" for k, h in heads.items()}
    contents |= {"elf": bytes.fromhex("7f454c46"), "x.node": bytes.fromhex("7f454c46"), "t.js": b"xMZ"}
    assert set(found(spark, "native_binary_present", contents)) == {"pe.js", "elf.js", "m1.js", "m2.js", "m3.js", "elf"}
    every = found(spark, "native_binary_present", contents, ScanConfig(magic_in_all_files=True))
    assert "x.node" in every
    assert set(found(spark, "wasm_present", contents)) == {"wasm.js"}


def test_entropy(spark):
    rng = random.Random(3)
    noise = bytes(rng.randrange(256) for _ in range(20_000))
    plain_head = b"a" * 4096 + noise
    contents = {"noise.js": noise, "short.js": noise[:9000], "text.js": b"words and words " * 2000, "late.js": plain_head}
    # Whole files are measured, also behind a plain head; a number of bytes measures heads only.
    hits = found(spark, "high_entropy_blob", contents)
    assert set(hits) == {"noise.js", "late.js"}
    assert 7.2 <= hits["late.js"]["entropy"] < hits["noise.js"]["entropy"] <= 8
    heads = found(spark, "high_entropy_blob", contents, ScanConfig(entropy_sample_bytes=4096))
    assert set(heads) == {"noise.js"}


def test_large_js_boundary(spark):
    contents = {"a.js": b"x" * 99, "b.js": b"x" * 100, "c.ts": b"x" * 100}
    hits = found(spark, "large_js", contents, ScanConfig(big_js_bytes=100))
    assert set(hits) == {"b.js"}
    assert hits["b.js"]["locations"][0]["line"] == 1


def test_base64_previews(spark):
    blob = base64.b64encode(b"console.log('this is a plain payload'); " * 5)
    exotic = base64.b64encode("пример текста ".encode() * 8)
    contents = {
        "text.js": blob,
        "binary.js": b"x" * 400,
        "odd.js": b"A" * 121,
        "padded.js": b"A" * 122 + b"==",
        "exotic.js": exotic,
        "three.js": b" ".join([b"Qk" * 60] * 4),
    }
    # Every run is reported; max_blobs keeps the first ones.
    rows = content_rule(files(spark, contents), "big_base64_blob").collect()
    first = content_rule(files(spark, contents), "big_base64_blob", ScanConfig(max_blobs=3)).collect()
    assert len([r for r in rows if r["path"] == "three.js"]) == 4
    assert len([r for r in first if r["path"] == "three.js"]) == 3

    def preview(run: bytes) -> str:
        try:
            raw = base64.b64decode(run[:200])
        except Exception:
            return "<decode failed>"
        shown = raw[:100].decode("utf-8", "ignore")
        return shown if shown.isprintable() else f"<binary data: {len(raw)} bytes>"

    for path, content in contents.items():
        runs = re.findall(rb"[A-Za-z0-9+/]{120,}={0,2}", content)
        got = [r for r in rows if r["path"] == path]
        assert sorted(r["decoded_preview"] for r in got) == sorted(preview(run) for run in runs)
        assert sorted(r["blob_length"] for r in got) == sorted(len(run) for run in runs)


def test_long_line_location(spark):
    raw = b"one\ntwo\n" + b"z" * 5000 + b"\nend"
    hit = found(spark, "minified_long_lines", {"a.js": raw, "b.js": b"y" * 4000})
    assert hit["a.js"]["locations"][0]["line"] == 3
    assert hit["b.js"]["locations"][0]["line"] == 1
    assert hit["a.js"]["locations"][0]["snippet"] == model_location(raw, 8, 5000)[2]


def test_obfuscation_details(spark):
    text = "var _0x1a2b = ['\\x61\\x70\\x69']; while(!![]){ s.charCodeAt(i) ^ 7 }" + " " * 1000
    hit = found(spark, "advanced_obfuscation", {"a.js": text.encode()})["a.js"]
    assert hit["severity"] == "high" and hit["confidence"] == "high"
    assert hit["techniques"] == [
        "hex_encoding", "xor_encryption", "string_array_obfuscation", "control_flow_flattening",
    ]
    assert hit["obfuscation_details"]["hex_decoded_sample"] == "api"


def test_very_long_hex_runs(spark):
    hit = found(spark, "advanced_obfuscation", {"a.js": b"\\x41" * 200_000})["a.js"]
    assert hit["obfuscation_details"]["hex_decoded_sample"] == "A" * 50


def test_invalid_utf8_is_dropped(spark):
    raw = b"\xff\xfe" * 5 + b"send(process.env.NPM_TOKEN) \xe9\n\xc3"
    hit = found(spark, "env_snoop", {"a.js": raw})["a.js"]
    assert hit["env_keys"] == ["process.env.NPM_TOKEN"]
    assert hit["locations"][0]["column"] == 6


def test_c2_urls(spark):
    text = "a https://x.example/WebHook?1 b webhook c https://y.example/ https://hooks.slack.com/s"
    hit = found(spark, "c2_webhook", {"a.js": text.encode()})["a.js"]
    assert hit["endpoints"] == ["WebHook", "hooks.slack.com", "webhook"]
    assert hit["full_urls"] == ["https://hooks.slack.com/s", "https://x.example/WebHook?1"]


def test_page_rules(spark):
    page = (
        b"<form action='https://evil.example/p'><input name=user></form>"
        b"<form action='https://github.com/p'></form><form action='/local'></form>"
        b"<iframe src='a'></iframe><IFRAME x src=\"b\"></iframe>"
        b"<script src='https://unpkg.com/a.js'></script><link href='https://cdnjs.x/b.css'>"
    )
    contents = {"a.html": page, "b.php": b"are you not a ROBOT", "c.htm": b"<button x>Fix</button>"}
    hit = found(spark, "phishing_form", contents)
    assert hit["a.html"]["form_actions"] == ["https://evil.example/p"]
    assert not found(spark, "phishing_form", contents, ScanConfig(allow_domains=()))
    captcha = found(spark, "fake_captcha", contents)
    assert captcha["b.php"]["button_samples"] == [] and captcha["c.htm"]["button_samples"] == ["Fix"]
    assert found(spark, "iframe_embed", contents)["a.html"]["iframe_urls"] == ["a", "b"]
    cdn = found(spark, "external_cdn_load", contents)["a.html"]
    assert cdn["cdn_urls"] == ["https://cdnjs.x/b.css", "https://unpkg.com/a.js"]


def test_script_rules(spark):
    contents = {
        "a.py": b"from flask import x\nrequests.post(u)\ns.listen(1)\n",
        "b.sh": b"curl -s \\\n https://x.example",
        "c.ps1": b"iwr  -useb https://x.example",
        "d.py": b"print(1)",
    }
    assert found(spark, "http_server", contents)["a.py"]["frameworks"] == ["from flask import"]
    assert found(spark, "python_download", contents)["a.py"]["methods"] == ["requests.post"]
    assert set(found(spark, "port_binding", contents)) == {"a.py"}
    assert set(found(spark, "shell_download", contents)) == {"c.ps1"}


def test_one_pass_equals_the_single_rules(spark):
    contents = random_contents(5, 12)
    contents |= {
        "p/a.js": b"fs.mkdir('x'); eval(y); process.env.TOKEN; child_process.exec(z); axios(u)",
        "p/b.html": b"<iframe src='q'>captcha",
        "p/c.py": b"requests.get(u); bind(x)",
        "p/d.sh": b"wget http://x.example",
        "p/e.js": b"Qk" * 2100 + b" \\x61\\x62 webhook is-wsl prebuild-install",
    }
    base = files(spark, contents)
    together = sorted((r["rule"], r["file_path"]) for r in scan_files(base).collect())
    apart = sorted(
        (r["rule"], r["path"]) for key in RULES for r in content_rule(base, key).select("rule", "path").collect()
    )
    assert together == apart
    one = scan_files(base).filter("rule = 'c2_webhook'").select("details").first()[0]
    assert json.loads(one)["endpoints"] == ["webhook"]


def test_signature_matches(spark):
    signature = Signature(
        "Two",
        (SignatureString("$a", "Alpha", nocase=True), SignatureString("$b", r"b\d+", is_regex=True)),
        needed=None,
        tags=("RAT",),
        meta={"description": "two strings"},
    )
    contents = {"x": b"alpha\nALPHA b12", "y": b"alpha only", "z.bin": b"\xff\xffalpha b1"}
    rows = {r["path"]: r for r in scan_signatures(files(spark, contents), [signature]).collect()}
    assert set(rows) == {"x", "z.bin"}
    assert rows["x"]["severity"] == "high" and rows["x"]["match_count"] == 3
    shown = [(m["identifier"], m["offset"], m["line_number"], m["matched_data"]) for m in rows["x"]["matched_strings"]]
    assert shown == [("$a", 0, 1, "alpha"), ("$a", 6, 2, "ALPHA"), ("$b", 12, 2, "b12")]
    assert "at line 1" in rows["x"]["explanation"]
    assert rows["z.bin"]["matched_strings"][0]["offset"] == 2


def test_domains(spark):
    cases = {
        "https://a.b:8/x": "a.b:8", "http://u@h?q": "u@h", "HTTPS://X.Y#f": "X.Y", "https:///x": "",
        "https://[bad/x": "", "https://a.com);": "a.com);", "http:/x": "",
    }
    rows = spark.createDataFrame([(u,) for u in cases], "u string").select("u", tx.url_domain(F.col("u"))).collect()
    assert {r[0]: r[1] for r in rows} == cases
    allowed = {"github.com": True, "api.GitHub.com": True, "notgithub.com": False, "github.com.evil": False, "": True}
    rows = spark.createDataFrame([(d,) for d in allowed], "d string").select(
        "d", tx.domain_allowed(F.col("d"), tuple(fv.ALLOW_DOMAINS))
    ).collect()
    assert {r[0]: r[1] for r in rows} == allowed


def test_suffixes(spark):
    cases = {"a/b.JS": ".js", ".npmrc": "", "a/.eslintrc.json": ".json", "LICENSE": "", "x.tar.gz": ".gz", "a.d/b": ""}
    rows = spark.createDataFrame([(p,) for p in cases], "p string").select("p", tx.suffix_of(F.col("p"))).collect()
    assert {r[0]: r[1] for r in rows} == cases


def test_byte_patterns():
    from tarsift.functions import text as tx

    assert tx.byte_pattern("abc[d-f]+") == "abc[d-f]+"
    assert tx.byte_pattern("né+") == "n(?:" + "é".encode().decode("latin-1") + ")+"
    both = tx.byte_pattern("É", nocase=True)
    assert all(f.encode().decode("latin-1") in both for f in "éÉ")
    for refused in ("[äö]", "\\ä"):
        with pytest.raises(ValueError):
            tx.byte_pattern(refused)
