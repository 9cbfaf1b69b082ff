"""Rules over code, page and script files."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarsift import fixed_values as fv
from tarsift.config import ScanConfig
from tarsift.functions import text as tx
from tarsift.functions.entropy import byte_entropy
from tarsift.operators.file_rules import (
    Feature,
    FileRule,
    Located,
    finding,
    findings_of,
    row,
    rule_frame,
)

c, lit = F.col, F.lit


def explain(key: str, *parts: Column) -> Column:
    return F.format_string(fv.EXPLAIN[key], *parts) if parts else lit(fv.EXPLAIN[key])


def joined(values: Column, sep: str = ", ") -> Column:
    return F.array_join(values, sep)


def real_text(values: Column) -> Column:
    return F.transform(values, tx.utf8)


# --- routing ----------------------------------------------------------------------------


def _routed(*suffixes: str):
    return lambda config: c("suffix").isin(*suffixes)


is_code = _routed(*fv.CODE_SUFFIXES)
is_js = _routed(*fv.JS_SUFFIXES)
is_html = _routed(*fv.HTML_SUFFIXES)
is_python = _routed(*fv.PYTHON_SUFFIXES)
is_shell = _routed(*fv.SHELL_SUFFIXES)


def is_large_enough_js(config: ScanConfig) -> Column:
    return is_js(config) & (c("size") > 1000)


def may_be_binary(config: ScanConfig) -> Column:
    return lit(True) if config.magic_in_all_files else is_code(config)


# --- features ---------------------------------------------------------------------------
# Gates name literals the pattern cannot match without; `low` is the lower-cased body, so
# for most files a rule costs a few substring searches and no regex at all.


def _mentions(*literals: str | tuple[str, ...]) -> Column:
    """One of the literals occurs. A tuple is a literal that must occur before any of
    the longer ones that contain it is looked for."""
    tests = [
        F.contains(c("low"), lit(item))
        if isinstance(item, str)
        else F.contains(c("low"), lit(item[0])) & tx.contains_any(c("low"), list(item[1:]))
        for item in literals
    ]
    return reduce(lambda a, b: a | b, tests)


def _found(pattern: str, *literals: str | tuple[str, ...], route=is_code, group: int = 0):
    return lambda config: tx.all_matches(
        c("body"), pattern, route(config) & _mentions(*literals), group
    )


def _dynamic_code(config: ScanConfig) -> Column:
    constructed = F.contains(c("low"), lit("function")) & c("low").rlike(r"new\s+function")
    gate = is_code(config) & (_mentions("eval") | constructed)
    return tx.all_matches(c("body"), fv.DYNAMIC_CODE, gate)


def _url_hits(config: ScanConfig) -> Column:
    """URLs with their domain and ordinal, domain first: sorting groups them by domain."""
    items = F.transform(
        c("urls"),
        lambda raw, i: tx.let(
            tx.utf8(raw), lambda url: F.struct(tx.url_domain(url).alias("domain"), i.alias("i"), url.alias("url"))
        ),
    )
    return F.array_sort(F.filter(items, lambda hit: hit["domain"] != ""))


def _url_run_starts(config: ScanConfig) -> Column:
    """Where in the sorted URLs each domain begins."""
    hits = c("url_hits")
    index = F.sequence(lit(0), F.size(hits) - 1)
    begins = lambda i: (i == 0) | (
        F.get(hits, i)["domain"] != F.get(hits, F.greatest(i - 1, lit(0)))["domain"]
    )
    return F.when(tx.has(hits), F.filter(index, begins))


def _url_places(config: ScanConfig) -> Column:
    gaps = F.split(c("body"), fv.URL, -1)
    return F.when(tx.has(c("urls")), tx.match_positions(tx.match_steps(gaps, c("urls"))))


def _url_domains(config: ScanConfig) -> Column:
    """Per domain: count, first URLs and first locations, by first ordinal."""
    hits, starts, places = c("url_hits"), c("url_run_starts"), c("url_places")

    def of_domain(start: Column, k: Column) -> Column:
        count = F.coalesce(F.get(starts, k + 1), F.size(hits)) - start
        first = F.slice(hits, start + 1, F.least(count, lit(5)))
        return F.struct(
            F.get(hits, start)["domain"].alias("domain"),
            count.alias("url_count"),
            F.transform(F.slice(first, 1, 3), lambda h: h["url"]).alias("sample_urls"),
            F.transform(
                first,
                lambda h: tx.let(
                    F.get(places, h["i"]),
                    lambda p: tx.location(
                        p, h["url"], tx.snippet_at(c("content"), p["offset"], p["span"])
                    ),
                ),
            ).alias("locations"),
        )

    return F.when(tx.has(starts), F.transform(starts, of_domain))


def _c2_urls(config: ScanConfig) -> Column:
    """The first URLs that carry one of the file's endpoints."""

    def carrying(known: Column) -> Column:
        inside = lambda url: F.exists(known, lambda m: F.contains(F.lower(url), m))
        return F.slice(F.filter(F.coalesce(c("urls"), F.array()), inside), 1, 5)

    marks = F.array_distinct(F.transform(c("c2"), F.lower))
    return F.when(tx.has(c("c2")), tx.let(marks, carrying))


def _env_locations(config: ScanConfig) -> Column:
    def of(head: Column) -> Column:
        gaps = F.split(c("decoded"), fv.ENV_SECRET, 6)
        places = tx.match_positions(tx.match_steps(gaps, head))
        return F.zip_with(
            places,
            head,
            lambda p, v: tx.location(
                p, v, tx.text_snippet_at(c("decoded"), p["offset"], p["span"])
            ),
        )

    return F.when(tx.has(c("env_keys")), tx.let(F.slice(c("env_keys"), 1, 5), of))


def _long_line_at(config: ScanConfig) -> Column:
    """Offset of the first line of 4000 bytes or more; NULL without one."""
    long_enough = F.exists(F.split(c("body"), "\n"), lambda line: F.length(line) >= 4000)
    gate = is_js(config) & (c("size") >= 4000) & long_enough
    starts_line = lambda at: F.substring(c("content"), at, lit(1)) == F.unhex(lit("0A"))
    return tx.let(
        F.when(gate, F.regexp_instr(c("body"), lit(fv.LONG_LINE))),
        lambda at: F.when(starts_line(at), at).otherwise(at - 1),
    )


def _long_line_location(config: ScanConfig) -> Column:
    at, content = c("long_line_at"), c("content")
    before = tx.byte_text(F.substring(content, lit(1), at))
    line = F.length(before) - F.length(F.replace(before, lit("\n"), lit(""))) + 1
    rest = tx.byte_text(F.substring(content, at + 1, c("size").cast("int") - at))
    span = F.length(F.substring_index(rest, "\n", 1))
    return F.when(
        at.isNotNull(),
        F.array(
            F.struct(
                line.alias("line"),
                lit(1).alias("column"),
                tx.snippet_at(content, at, span).alias("snippet"),
            )
        ),
    )


def entropy_wanted(config: ScanConfig) -> Column:
    return is_code(config) & (c("size") > fv.ENTROPY_MIN_BYTES)


def _head(config: ScanConfig) -> Column:
    """The start of a script that is reported for its size."""
    return F.when(is_js(config) & (c("size") >= config.big_js_bytes), tx.snippet_at(c("content"), lit(0), lit(1)))


def _long_head(config: ScanConfig) -> Column:
    """The start of a file that is reported for its entropy."""
    snippet = tx.snippet_at(c("content"), lit(0), F.least(c("size"), lit(200)).cast("int"))
    return F.when(c("entropy") >= config.high_entropy, snippet)


def _entropy_input(config: ScanConfig) -> Column:
    data = c("content")
    if config.entropy_sample_bytes is not None:
        data = F.substring(data, lit(1), lit(config.entropy_sample_bytes))
    return byte_entropy(F.when(entropy_wanted(config), data))


def _base64_blobs(config: ScanConfig) -> Column:
    # A run holds no space, so a file without a long word has none.
    long_word = F.exists(F.split(c("body"), " "), lambda word: F.length(word) >= 120)
    gate = is_code(config) & (c("size") >= 120) & long_word
    found = tx.all_matches(c("body"), fv.BASE64_RUN, gate)
    return found if config.max_blobs is None else F.slice(found, 1, config.max_blobs)


def _blobs_shown(config: ScanConfig) -> Column:
    """What a finding says of each blob."""
    return F.when(
        tx.has(c("blobs")),
        F.zip_with(
            c("blobs"),
            c("blob_locations"),
            lambda blob, place: F.struct(
                F.length(blob).alias("length"), _preview(blob).alias("preview"), place.alias("place")
            ),
        ),
    )


def _hex_runs(config: ScanConfig) -> Column:
    # After the first escape of a run comes space, a backslash or the next escape's x.
    gate = is_large_enough_js(config) & c("body").rlike(fv.HEX_RUN_START)
    return F.when(gate, F.nullif(F.regexp_extract(c("decoded"), fv.HEX_RUN, 0), lit("")))


def _function_count(config: ScanConfig) -> Column:
    text = c("decoded")
    return F.when(
        F.contains(text, lit("function")),
        (F.length(text) - F.length(F.replace(text, lit("function"), lit("")))) / 8,
    )


def _xor_code(config: ScanConfig) -> Column:
    marks = ["fromcharcode(", ".charcodeat(", "xor"]
    return tx.contains_any(c("low"), marks) & c("decoded").rlike(fv.XOR_CODE)


def _techniques(config: ScanConfig) -> Column:
    checks = [
        ("hex_encoding", c("hex_runs").isNotNull()),
        ("xor_encryption", c("xor_code")),
        ("unicode_obfuscation", c("non_ascii_runs") > 3),
        ("string_array_obfuscation", c("string_array")),
        ("control_flow_flattening", c("flattened_loop")),
        ("dead_code_injection", (c("function_count") > 50) & (c("decoded_length") < 50000)),
    ]
    found = F.array(*[F.when(test, lit(name)) for name, test in checks])
    return F.when(is_large_enough_js(config), F.array_compact(found))


def _hex_sample(config: ScanConfig) -> Column:
    """The decoded start of the first hex run; NULL where it does not decode."""
    digits = F.left(F.regexp_replace(c("hex_runs"), r"\\x|x| ", ""), lit(100))
    packed = F.regexp_replace(digits, r"[\t\n\x0B\f\r]", "")
    raw = F.when(F.length(packed) % 2 == 0, F.unhex(packed))
    return F.left(F.regexp_replace(tx.byte_text(raw), r"[^\x00-\x7F]", ""), lit(50))


def _decoded(config: ScanConfig) -> Column:
    wanted = is_large_enough_js(config) | (
        is_code(config) & F.contains(c("low"), lit(".env."))
    )
    return F.when(wanted, tx.clean_text(c("content")))


def _non_ascii_runs(config: ScanConfig) -> Column:
    # Byte text holds each non-ASCII byte in two bytes; equal sizes mean pure ASCII.
    exotic = is_large_enough_js(config) & (F.octet_length(c("body")) > c("size"))
    return F.when(exotic, F.regexp_count(c("decoded"), lit(fv.NON_ASCII_RUN)))


def _cdn_urls(config: ScanConfig) -> Column:
    gate = is_html(config) & c("has_cdn")
    both = F.concat(
        F.regexp_extract_all("body", lit(fv.SCRIPT_SRC), lit(1)),
        F.regexp_extract_all("body", lit(fv.LINK_HREF), lit(1)),
    )
    marked = F.filter(both, lambda u: tx.contains_any(u, fv.CDN_MARKS))
    return F.when(gate, F.array_sort(F.array_distinct(real_text(F.slice(marked, 1, 10)))))


def _form_actions(config: ScanConfig) -> Column:
    """Actions of credential forms that lead off the allow list."""
    credential = c("body").rlike(fv.PASSWORD_INPUT) | c("body").rlike(fv.CREDENTIAL_INPUT)
    gate = is_html(config) & tx.contains_all(c("low"), ["<input", "<form"]) & credential
    actions = real_text(F.regexp_extract_all("body", lit(fv.FORM_ACTION), lit(1)))
    outward = lambda a: F.startswith(a, lit("http")) & tx.off_list(
        tx.url_domain(a), config.allow_domains
    )
    return F.when(gate, F.filter(actions, outward))


FEATURES: dict[str, Feature | Located] = {
    "body": Feature(0, lambda config: tx.byte_text(c("content"))),
    "low": Feature(1, lambda config: F.lower(c("body"))),
    "urls": Feature(2, _found(fv.URL, ("://", "http://", "https://"))),
    "url_hits": Feature(3, _url_hits),
    "url_places": Feature(3, _url_places),
    "url_run_starts": Feature(4, _url_run_starts),
    "url_domains": Feature(5, _url_domains),
    "net": Feature(
        2,
        _found(
            fv.NET_CLIENT,
            ("http", "http.get", "https.get", "http.request"),
            ("node", "node-fetch", "node_fetch"),
            "undici", "axios",
        ),
    ),
    "net_locations": Located(fv.NET_CLIENT, "net"),
    "c2": Feature(
        2,
        _found(
            fv.C2_ENDPOINT,
            (".com", "discord.com/api", "discordapp.com/api", "hooks.slack.com", "pastebin.com"),
            ("://", "ipfs://"),
            "api.telegram.org", "webhook", "ngrok.io", "oast.",
        ),
    ),
    "c2_locations": Located(fv.C2_ENDPOINT, "c2"),
    "c2_urls": Feature(3, _c2_urls),
    "writes": Feature(
        2,
        _found(
            fv.FS_WRITE,
            (
                "fs.", "fs.writefile", "fs.appendfile", "fs.createwritestream", "fs.copyfile",
                "fs.mkdir",
            ),
        ),
    ),
    "write_locations": Located(fv.FS_WRITE, "writes"),
    "hints": Feature(
        3, lambda config: tx.all_matches(c("body"), fv.SENSITIVE_PATH, tx.has(c("writes")))
    ),
    "hint_locations": Located(fv.SENSITIVE_PATH, "hints"),
    "ci": Feature(2, _found(fv.CI_CHECK, ("process.env.", "process.env.ci"), "is-docker", "is-wsl")),
    "ci_locations": Located(fv.CI_CHECK, "ci"),
    "decoded": Feature(2, _decoded),
    "env_keys": Feature(
        3,
        lambda config: tx.all_matches(
            c("decoded"),
            fv.ENV_SECRET,
            is_code(config) & F.contains(c("low"), lit(".env.")),
        ),
    ),
    "env_locations": Feature(4, _env_locations),
    "long_line_at": Feature(2, _long_line_at),
    "long_line_location": Feature(3, _long_line_location),
    # Before there are texts: rows that wait for Python carry the content alone.
    "entropy": Feature(0, _entropy_input),
    "head": Feature(2, _head),
    "long_head": Feature(3, _long_head),
    "wasm": Feature(2, lambda config: _magic(fv.WASM_MAGIC)),
    "native": Feature(2, lambda config: _magic(*fv.NATIVE_MAGICS)),
    "webpack": Feature(2, lambda config: tx.contains_any(c("low"), fv.WEBPACK_MARKS)),
    "fetcher": Feature(2, lambda config: tx.contains_any(c("low"), fv.NATIVE_FETCHERS)),
    "captcha": Feature(2, lambda config: tx.contains_any(c("low"), fv.CAPTCHA_TEXTS)),
    "py_socket": Feature(2, lambda config: tx.contains_any(c("low"), fv.PY_SOCKET_CALLS)),
    "shell_fetch": Feature(
        2, lambda config: F.contains(c("low"), lit("://")) & c("body").rlike(fv.SHELL_DOWNLOAD)
    ),
    "blobs": Feature(2, _base64_blobs),
    "blob_locations": Located(fv.BASE64_RUN, "blobs", count=None),
    "blobs_shown": Feature(5, _blobs_shown),
    "spawns": Feature(2, _found(fv.CHILD_PROCESS, "child_process")),
    "spawn_calls": Feature(2, _found(fv.CHILD_PROCESS, "child_process", group=1)),
    "spawn_locations": Located(fv.CHILD_PROCESS, "spawns", "spawn_calls"),
    "dynamic": Feature(2, _dynamic_code),
    "dynamic_locations": Located(fv.DYNAMIC_CODE, "dynamic", in_context=True),
    "url_locations": Located(fv.URL, "urls"),
    "env_reads": Feature(2, _found(fv.PROCESS_ENV, "process.env.")),
    "env_read_locations": Located(fv.PROCESS_ENV, "env_reads"),
    "hex_runs": Feature(3, _hex_runs),
    "xor_code": Feature(3, _xor_code),
    "string_array": Feature(
        3, lambda config: F.contains(c("low"), lit("_0x")) & c("decoded").rlike(fv.STRING_ARRAY)
    ),
    "flattened_loop": Feature(
        3, lambda config: F.contains(c("low"), lit("!!")) & c("decoded").rlike(fv.FLATTENED_LOOP)
    ),
    "function_count": Feature(3, _function_count),
    "decoded_length": Feature(3, lambda config: F.length(c("decoded"))),
    "non_ascii_runs": Feature(3, _non_ascii_runs),
    "techniques": Feature(4, _techniques),
    "has_cdn": Feature(
        2,
        lambda config: is_html(config) & tx.contains_any(c("low"), fv.CDN_HOSTS),
    ),
    "cdn_urls": Feature(3, _cdn_urls),
    "form_actions": Feature(2, _form_actions),
    "lure_buttons": Feature(2, _found(fv.LURE_BUTTON, "<button", route=is_html, group=1)),
    "iframes": Feature(2, _found(fv.IFRAME_SRC, "<iframe", route=is_html, group=1)),
    "py_servers": Feature(
        2,
        _found(
            fv.PY_SERVER, "from flask import", "from fastapi import", "http.server",
            "httpserver", "socketserver", route=is_python,
        ),
    ),
    "py_downloads": Feature(
        2,
        _found(
            fv.PY_DOWNLOAD, "requests.", "urllib.request", "wget", "curl",
            route=is_python, group=1,
        ),
    ),
}

#: Match features that rules count.
COUNTED = (
    "net", "c2", "writes", "hints", "ci", "env_keys", "spawns", "dynamic", "urls", "env_reads",
    "form_actions", "lure_buttons", "iframes", "py_servers", "py_downloads",
)
FEATURES |= {
    f"{key}_count": Feature(FEATURES[key].layer + 1, lambda config, key=key: F.size(c(key))) for key in COUNTED
}


# --- rows -------------------------------------------------------------------------------
# Rows are built from features and the columns of a file other than its content, so that they
# can also be built from features that were put together from parts of a file.


def _url_rows(config: ScanConfig) -> Column:
    def of(entry: Column) -> Column:
        outside = tx.off_list(entry["domain"], config.allow_domains)
        return finding(
            F.when(outside, lit("url_outside_allowlist")).otherwise(lit("url_in_code")),
            F.when(outside, lit("high")).otherwise(lit("medium")),
            domain=entry["domain"],
            url_count=entry["url_count"],
            sample_urls=entry["sample_urls"],
            locations=entry["locations"],
            explanation=F.when(outside, explain("url_outside_allowlist", entry["domain"])),
        )

    return F.transform(c("url_domains"), of)


def _net_rows(config: ScanConfig) -> Column:
    methods = tx.first_distinct(real_text(F.slice(c("net"), 1, 20)), 20, 10)
    return row(
        tx.has(c("net")), "net_client_usage", "medium",
        methods=methods,
        explanation=explain("net_client_usage", joined(methods)),
        locations=c("net_locations"),
        match_count=c("net_count"),
    )


def _c2_rows(config: ScanConfig) -> Column:
    endpoints = F.array_sort(tx.first_distinct(real_text(F.slice(c("c2"), 1, 5)), 5))
    full_urls = F.array_sort(F.array_distinct(real_text(c("c2_urls"))))
    return row(
        tx.has(c("c2")), "c2_webhook", "high",
        endpoints=endpoints,
        full_urls=full_urls,
        explanation=explain(
            "c2_webhook",
            F.get(endpoints, lit(0)),
            F.coalesce(F.get(full_urls, lit(0)), lit("N/A")),
        ),
        locations=c("c2_locations"),
        match_count=c("c2_count"),
    )


def _write_methods() -> Column:
    return tx.first_distinct(real_text(F.slice(c("writes"), 1, 10)), 10, 5)


def _write_rows(config: ScanConfig) -> Column:
    targets = tx.first_distinct(real_text(F.slice(c("hints"), 1, 5)), 5)
    return row(
        tx.has(c("hints")), "writes_outside_pkg", "high",
        write_methods=_write_methods(),
        target_paths=targets,
        explanation=explain("writes_outside_pkg", joined(F.slice(targets, 1, 3))),
        locations=c("hint_locations"),
        match_count=c("hints_count"),
    )


def _write_candidate_rows(config: ScanConfig) -> Column:
    return row(
        tx.has(c("writes")) & ~tx.has(c("hints")), "writes_outside_pkg_candidate", "medium",
        write_methods=_write_methods(),
        locations=c("write_locations"),
        match_count=c("writes_count"),
    )


def _ci_rows(config: ScanConfig) -> Column:
    return row(
        tx.has(c("ci")), "ci_evasion", "low",
        checks=tx.first_distinct(c("ci"), 10, 5),
        locations=c("ci_locations"),
        match_count=c("ci_count"),
    )


def _env_rows(config: ScanConfig) -> Column:
    keys = F.slice(F.array_distinct(c("env_keys")), 1, 10)
    return row(
        tx.has(c("env_keys")), "env_snoop", "medium",
        env_keys=keys,
        explanation=explain("env_snoop", joined(F.slice(keys, 1, 5))),
        locations=c("env_locations"),
        match_count=c("env_keys_count"),
    )


def _head_location(snippet: Column) -> Column:
    return F.array(
        F.struct(lit(1).alias("line"), lit(1).alias("column"), snippet.alias("snippet"))
    )


def _large_js_rows(config: ScanConfig) -> Column:
    megabytes = F.bround(c("size") / 1024 / 1024, 2)
    return row(
        c("size") >= config.big_js_bytes, "large_js", "medium",
        bytes=c("size"),
        explanation=explain("large_js", megabytes.cast("string")),
        locations=_head_location(c("head")),
    )


def _webpack_rows(config: ScanConfig) -> Column:
    return row(c("webpack"), "webpack_bundle", "medium")


def _long_line_rows(config: ScanConfig) -> Column:
    return row(
        c("long_line_at").isNotNull(), "minified_long_lines", "low",
        locations=c("long_line_location"),
    )


def _entropy_rows(config: ScanConfig) -> Column:
    shown = F.bround(c("entropy"), 2)
    return row(
        (c("entropy") >= config.high_entropy) & (c("size") > fv.ENTROPY_MIN_BYTES),
        "high_entropy_blob", "medium",
        entropy=shown,
        bytes=c("size"),
        explanation=explain("high_entropy_blob", shown.cast("string")),
        locations=_head_location(c("long_head")),
    )


def _preview(blob: Column) -> Column:
    """What the first 200 characters of a blob decode to."""
    head = F.left(blob, lit(200))
    data = F.rtrim(head, lit("="))
    padding = F.length(head) - F.length(data)
    over = F.length(data) % 4
    complete = (over == 0) | ((over == 2) & (padding >= 2)) | ((over == 3) & (padding >= 1))

    def shown(raw: Column) -> Column:
        text = tx.clean_text(F.substring(raw, lit(1), lit(100)))
        unprintable = text.rlike(r"[\p{C}\p{Z}&&[^ ]]")
        size = F.octet_length(raw).cast("string")
        return F.when(
            unprintable, F.concat(lit("<binary data: "), size, lit(" bytes>"))
        ).otherwise(text)

    return F.when(complete, tx.let(F.unbase64(data), shown)).otherwise(lit("<decode failed>"))


def _base64_rows(config: ScanConfig) -> Column:
    def of(blob: Column) -> Column:
        place = blob["place"]
        return finding(
            "big_base64_blob", "medium",
            size=c("size"),
            blob_length=blob["length"],
            decoded_preview=blob["preview"],
            explanation=explain("big_base64_blob"),
            locations=F.array(
                F.struct(place["line"], place["column"], place["snippet"])
            ),
        )

    return F.transform(c("blobs_shown"), of)


def _magic(*hexes: str) -> Column:
    tests = [F.startswith(c("content"), F.unhex(lit(h))) for h in hexes]
    out = tests[0]
    for test in tests[1:]:
        out = out | test
    return out


def _wasm_rows(config: ScanConfig) -> Column:
    return row(
        c("wasm"), "wasm_present", "medium", explanation=explain("wasm_present")
    )


def _native_rows(config: ScanConfig) -> Column:
    return row(
        c("native"), "native_binary_present", "high",
        explanation=explain("native_binary_present"),
    )


def _native_fetcher_rows(config: ScanConfig) -> Column:
    return row(
        c("fetcher"), "native_fetcher_present", "low"
    )


def _generic_rows(config: ScanConfig) -> Column:
    """One finding per (file, pattern); a pattern with a group shows the group."""

    def of(pattern: str, matches: str, samples: str, places: str) -> Column:
        shown = real_text(F.slice(c(samples), 1, 10))
        item = finding(
            "suspicious_pattern", "medium",
            pattern=lit(fv.GENERIC_PATTERN_NAMES[pattern]),
            samples=tx.first_distinct(shown, 10, 5),
            locations=c(places),
            match_count=c(f"{matches}_count"),
        )
        return F.when(tx.has(c(matches)), item)

    return F.array_compact(
        F.array(
            of("child_process", "spawns", "spawn_calls", "spawn_locations"),
            of("dynamic_code", "dynamic", "dynamic", "dynamic_locations"),
            of("url", "urls", "urls", "url_locations"),
            of("process_env", "env_reads", "env_reads", "env_read_locations"),
        )
    )


def _obfuscation_rows(config: ScanConfig) -> Column:
    count = F.size(c("techniques"))
    confidence = (
        F.when(count >= 3, lit("high")).when(count >= 2, lit("medium")).otherwise(lit("low"))
    )
    return row(
        tx.has(c("techniques")), "advanced_obfuscation",
        F.when(count >= 3, lit("high")).otherwise(lit("medium")),
        techniques=c("techniques"),
        confidence=confidence,
        obfuscation_details=F.struct(
            _hex_sample(config).alias("hex_decoded_sample"),
            F.when(c("non_ascii_runs") > 3, c("non_ascii_runs")).alias("unicode_sample_count"),
        ),
        explanation=explain("advanced_obfuscation", confidence, joined(c("techniques"))),
    )


def _phishing_rows(config: ScanConfig) -> Column:
    return row(
        tx.has(c("form_actions")), "phishing_form", "high",
        form_actions=F.slice(c("form_actions"), 1, 5),
        match_count=c("form_actions_count"),
        explanation=explain("phishing_form", F.get(c("form_actions"), lit(0))),
    )


def _captcha_rows(config: ScanConfig) -> Column:
    return row(
        tx.has(c("lure_buttons")) | c("captcha"), "fake_captcha", "medium",
        button_samples=F.coalesce(
            real_text(F.slice(c("lure_buttons"), 1, 3)), F.array().cast("array<string>")
        ),
        match_count=F.coalesce(c("lure_buttons_count"), lit(0)),
        explanation=explain("fake_captcha"),
    )


def _cdn_rows(config: ScanConfig) -> Column:
    count = F.size(c("cdn_urls"))
    return row(
        c("has_cdn"), "external_cdn_load", "medium",
        cdn_urls=c("cdn_urls"),
        cdn_count=count,
        explanation=explain("external_cdn_load", count.cast("string")),
    )


def _iframe_rows(config: ScanConfig) -> Column:
    urls = real_text(F.slice(c("iframes"), 1, 5))
    return row(
        tx.has(c("iframes")), "iframe_embed", "medium",
        iframe_urls=urls,
        match_count=c("iframes_count"),
        explanation=explain("iframe_embed", F.get(urls, lit(0))),
    )


def _py_server_rows(config: ScanConfig) -> Column:
    found = F.array_sort(tx.first_distinct(real_text(F.slice(c("py_servers"), 1, 5)), 5))
    return row(
        tx.has(c("py_servers")), "http_server", "medium",
        frameworks=found,
        match_count=c("py_servers_count"),
        explanation=explain("http_server", F.get(found, lit(0))),
    )


def _py_socket_rows(config: ScanConfig) -> Column:
    return row(
        c("py_socket"), "port_binding", "medium",
        explanation=explain("port_binding"),
    )


def _py_download_rows(config: ScanConfig) -> Column:
    methods = F.array_sort(tx.first_distinct(real_text(F.slice(c("py_downloads"), 1, 5)), 5))
    return row(
        tx.has(c("py_downloads")), "script_download", "medium",
        methods=methods,
        explanation=explain("script_download_python", joined(methods)),
        match_count=c("py_downloads_count"),
    )


def _shell_download_rows(config: ScanConfig) -> Column:
    return row(c("shell_fetch"), "script_download", "high", explanation=explain("script_download_shell"))


_TEXT = ("body", "low")


def _counting(rule: FileRule) -> FileRule:
    return replace(rule, needs=(*rule.needs, *(f"{n}_count" for n in rule.needs if n in COUNTED)))


RULES: dict[str, FileRule] = {
    rule.key: _counting(rule)
    for rule in [
        FileRule(
            "url_domains", is_code,
            (*_TEXT, "urls", "url_hits", "url_places", "url_run_starts", "url_domains"),
            _url_rows,
        ),
        FileRule("net_client_usage", is_code, (*_TEXT, "net", "net_locations"), _net_rows),
        FileRule("c2_webhook", is_code, (*_TEXT, "urls", "c2", "c2_urls", "c2_locations"), _c2_rows),
        FileRule(
            "writes_outside_pkg", is_code, (*_TEXT, "writes", "hints", "hint_locations"),
            _write_rows,
        ),
        FileRule(
            "writes_outside_pkg_candidate", is_code,
            (*_TEXT, "writes", "hints", "write_locations"), _write_candidate_rows,
        ),
        FileRule("ci_evasion", is_code, (*_TEXT, "ci", "ci_locations"), _ci_rows),
        FileRule(
            "env_snoop", is_code, (*_TEXT, "decoded", "env_keys", "env_locations"), _env_rows
        ),
        FileRule("large_js", is_js, ("head",), _large_js_rows),
        FileRule("webpack_bundle", is_js, (*_TEXT, "webpack"), _webpack_rows),
        FileRule(
            "minified_long_lines", is_js, ("body", "long_line_at", "long_line_location"),
            _long_line_rows,
        ),
        FileRule("high_entropy_blob", is_code, ("entropy", "long_head"), _entropy_rows),
        FileRule(
            "big_base64_blob", is_code, ("body", "blobs", "blob_locations", "blobs_shown"), _base64_rows
        ),
        FileRule("wasm_present", may_be_binary, ("wasm",), _wasm_rows),
        FileRule("native_binary_present", may_be_binary, ("native",), _native_rows),
        FileRule("native_fetcher_present", is_code, (*_TEXT, "fetcher"), _native_fetcher_rows),
        FileRule(
            "suspicious_pattern", is_code,
            (
                *_TEXT, "urls", "url_locations", "spawns", "spawn_calls", "spawn_locations",
                "dynamic", "dynamic_locations", "env_reads", "env_read_locations",
            ),
            _generic_rows,
        ),
        FileRule(
            "advanced_obfuscation", is_large_enough_js,
            (
                *_TEXT, "decoded", "hex_runs", "non_ascii_runs", "xor_code", "string_array",
                "flattened_loop", "function_count", "decoded_length", "techniques",
            ),
            _obfuscation_rows,
        ),
        FileRule("phishing_form", is_html, (*_TEXT, "form_actions"), _phishing_rows),
        FileRule("fake_captcha", is_html, (*_TEXT, "lure_buttons", "captcha"), _captcha_rows),
        FileRule("external_cdn_load", is_html, (*_TEXT, "has_cdn", "cdn_urls"), _cdn_rows),
        FileRule("iframe_embed", is_html, (*_TEXT, "iframes"), _iframe_rows),
        FileRule("http_server", is_python, (*_TEXT, "py_servers"), _py_server_rows),
        FileRule("port_binding", is_python, (*_TEXT, "py_socket"), _py_socket_rows),
        FileRule("python_download", is_python, (*_TEXT, "py_downloads"), _py_download_rows),
        FileRule("shell_download", is_shell, (*_TEXT, "shell_fetch"), _shell_download_rows),
    ]
}


def content_rule(files: DataFrame, key: str, config: ScanConfig | None = None) -> DataFrame:
    """One rule over a files table, with typed columns."""
    return rule_frame(files, RULES[key], FEATURES, config or ScanConfig())


def scan_files(files: DataFrame, config: ScanConfig | None = None, rules=None) -> DataFrame:
    """All content rules in one pass over a files table."""
    chosen = [RULES[key] for key in rules] if rules else RULES.values()
    return findings_of(files, chosen, FEATURES, config or ScanConfig())
