"""Queries for the rules over code, page and script files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarsift import fixed_values as fv
from tarsift.catalog.registry import ORACLES, flat, query, sql_list, sql_text
from tarsift.config import ScanConfig
from tarsift.operators.content_rules import content_rule, scan_files
from tarsift.operators.locate import locate_matches
from tarsift.sources.tables import spread
from tarsift.views import view, view_sql

KEYS = ["name", "version", "path", "severity"]
CODE = f"suffix IN ({sql_list(fv.CODE_SUFFIXES)})"
JS = f"suffix IN ({sql_list(fv.JS_SUFFIXES)})"
URL = r"""'(?i)https?://[^\s''"]+'"""
ALLOWED = "(.*\\.)?(" + "|".join(d.replace(".", "\\.") for d in fv.ALLOW_DOMAINS) + ")"


def files(spark: SparkSession, folder: str) -> DataFrame:
    rows = view(spark, folder, "files").withColumn("content", F.col("content").cast("binary"))
    return spread(rows, "path")


def html_files(spark: SparkSession, folder: str) -> DataFrame:
    rows = view(spark, folder, "html_files")
    return spread(rows.withColumn("content", F.col("content").cast("binary")), "path")


def binary_files(spark: SparkSession, folder: str) -> DataFrame:
    rows = view(spark, folder, "binary_files").withColumn(
        "content", F.concat(F.unhex("magic"), F.col("text").cast("binary"))
    )
    return spread(rows, "path")


def first_at() -> list:
    at = F.get(F.col("locations"), F.lit(0))
    return [at["line"].alias("first_line"), at["column"].alias("first_column")]


def sql_at(match: str) -> str:
    """Line and byte column of the first occurrence of a text in ``content``."""
    before = f"left(content, instr(content, {match}) - 1)"
    return (
        f"CAST(1 + length({before}) - length(replace({before}, chr(10), '')) AS INT) AS first_line, "
        f"CAST(strlen(split_part({before}, chr(10), -1)) + 1 AS INT) AS first_column"
    )


def sql_first_distinct(pattern: str, count: int, group: int = 0) -> str:
    found = f"regexp_extract_all(content, {pattern}, {group})"
    return f"array_to_string(list_sort(list_distinct(list_slice({found}, 1, {count}))), '|')"


def sql_rule(severity: str, where: str, *columns: str, source: str = "files", prefix: str = "") -> str:
    extra = "".join(f", {c}" for c in columns)
    return view_sql(
        source,
        tail=f"{prefix} SELECT name, version, path, '{severity}' AS severity{extra} FROM {source} WHERE {where}",
    )


NET = sql_text(fv.NET_CLIENT)
C2 = sql_text(fv.C2_ENDPOINT)
WRITE = sql_text(fv.FS_WRITE)
HINT = sql_text(fv.SENSITIVE_PATH)
CI = sql_text(fv.CI_CHECK)
ENV = sql_text(fv.ENV_SECRET.replace("(?iu)", "(?i)"))

_URL_ORACLE = view_sql(
    "files",
    tail=f"""
, u AS (SELECT name, version, path, content, unnest(regexp_extract_all(content, {URL})) AS url,
               unnest(range(1, 1 + len(regexp_extract_all(content, {URL})))) AS i
        FROM files WHERE {CODE}),
d AS (SELECT *, regexp_extract(url, '(?i)^[a-z][a-z0-9+.\\-]*://([^/?#]*)', 1) AS domain FROM u),
g AS (SELECT name, version, path, any_value(content) AS content, domain, count(*) AS url_count,
             array_to_string(list_slice(list(url ORDER BY i), 1, 3), '|') AS sample_urls,
             arg_min(url, i) AS first_url
      FROM d WHERE domain <> '' GROUP BY name, version, path, domain)
SELECT name, version, path, domain, CAST(url_count AS INT) AS url_count, sample_urls,
       CASE WHEN regexp_full_match(lower(domain), {sql_text(ALLOWED)}) THEN 'url_in_code' ELSE 'url_outside_allowlist' END AS rule,
       CASE WHEN regexp_full_match(lower(domain), {sql_text(ALLOWED)}) THEN 'medium' ELSE 'high' END AS severity,
       {sql_at("first_url")}
FROM g""",
)


@query("c1_url_domains", _URL_ORACLE)
def c1(spark, folder):
    return content_rule(files(spark, folder), "url_domains").select(
        *KEYS, "rule", "domain", "url_count", flat(F.col("sample_urls"), False).alias("sample_urls"),
        *first_at(),
    )


@query(
    "c1_page_hosts",
    view_sql(
        "html_files",
        tail=f"""
SELECT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, count(*) AS pages,
       regexp_full_match(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), {sql_text(ALLOWED)}) AS allowed
FROM html_files GROUP BY 1, 3""",
    ),
)
def c1_hosts(spark, folder):
    from tarsift.functions import text as tx

    host = tx.url_domain(F.col("url")).alias("host")
    pages = view(spark, folder, "html_files").select(host)
    allowed = tx.domain_allowed(F.col("host"), ScanConfig().allow_domains).alias("allowed")
    return pages.groupBy("host").agg(F.count("*").alias("pages")).select("host", "pages", allowed)


@query(
    "c2_net_client_usage",
    sql_rule(
        "medium", f"{CODE} AND regexp_matches(content, {NET})",
        f"{sql_first_distinct(NET, 20)} AS methods", sql_at(f"regexp_extract(content, {NET})"),
    ),
)
def c2(spark, folder):
    return content_rule(files(spark, folder), "net_client_usage").select(
        *KEYS, flat(F.col("methods")).alias("methods"), *first_at()
    )


@query(
    "c3_c2_webhook",
    sql_rule(
        "high", f"{CODE} AND regexp_matches(content, {C2})",
        f"{sql_first_distinct(C2, 5)} AS endpoints",
        f"array_to_string(list_sort(list_distinct(list_slice(list_filter(regexp_extract_all(content, {URL}), "
        f"lambda u: regexp_matches(u, {C2})), 1, 5))), '|') AS full_urls",
        sql_at(f"regexp_extract(content, {C2})"),
    ),
)
def c3(spark, folder):
    return content_rule(files(spark, folder), "c2_webhook").select(
        *KEYS, flat(F.col("endpoints")).alias("endpoints"), flat(F.col("full_urls")).alias("full_urls"),
        *first_at(),
    )


@query(
    "c4_writes_outside_pkg",
    sql_rule(
        "high", f"{CODE} AND regexp_matches(content, {WRITE}) AND regexp_matches(content, {HINT})",
        f"{sql_first_distinct(WRITE, 10)} AS write_methods",
        f"{sql_first_distinct(HINT, 5)} AS target_paths",
        sql_at(f"regexp_extract(content, {HINT})"),
    ),
)
def c4(spark, folder):
    return content_rule(files(spark, folder), "writes_outside_pkg").select(
        *KEYS, flat(F.col("write_methods")).alias("write_methods"),
        flat(F.col("target_paths")).alias("target_paths"), *first_at(),
    )


@query(
    "c5_writes_outside_pkg_candidate",
    sql_rule(
        "medium", f"{CODE} AND regexp_matches(content, {WRITE}) AND NOT regexp_matches(content, {HINT})",
        f"{sql_first_distinct(WRITE, 10)} AS write_methods",
        sql_at(f"regexp_extract(content, {WRITE})"),
    ),
)
def c5(spark, folder):
    return content_rule(files(spark, folder), "writes_outside_pkg_candidate").select(
        *KEYS, flat(F.col("write_methods")).alias("write_methods"), *first_at()
    )


@query(
    "c6_ci_evasion",
    sql_rule(
        "low", f"{CODE} AND regexp_matches(content, {CI})",
        f"{sql_first_distinct(CI, 10)} AS checks", sql_at(f"regexp_extract(content, {CI})"),
    ),
)
def c6(spark, folder):
    return content_rule(files(spark, folder), "ci_evasion").select(
        *KEYS, flat(F.col("checks")).alias("checks"), *first_at()
    )


@query(
    "c7_env_snoop",
    sql_rule(
        "medium", f"{CODE} AND regexp_matches(content, {ENV})",
        f"array_to_string(list_sort(list_distinct(regexp_extract_all(content, {ENV}))), '|') AS env_keys",
        f"CAST(length(split_part(left(content, instr(content, regexp_extract(content, {ENV})) - 1), chr(10), -1)) + 1 AS INT) AS first_column",
    ),
)
def c7(spark, folder):
    return content_rule(files(spark, folder), "env_snoop").select(
        *KEYS, flat(F.col("env_keys")).alias("env_keys"), first_at()[1]
    )


@query(
    "c8_large_js",
    sql_rule("medium", f"{JS} AND strlen(content) >= 2000", "strlen(content) AS bytes"),
)
def c8(spark, folder):
    config = ScanConfig(big_js_bytes=2000)
    return content_rule(files(spark, folder), "large_js", config).select(*KEYS, "bytes")


@query("c9_webpack_bundle", sql_rule("medium", f"{JS} AND regexp_matches(content, '(?i)__webpack_require__|webpackJsonp|/\\*! For license information please see')"))
def c9(spark, folder):
    return content_rule(files(spark, folder), "webpack_bundle").select(*KEYS)


_LINES = "list_transform(string_split(content, chr(10)), lambda l: strlen(l) >= 4000)"


@query(
    "c10_minified_long_lines",
    sql_rule(
        "low", f"{JS} AND list_contains({_LINES}, true)",
        f"CAST(list_position({_LINES}, true) AS INT) AS first_line", "1 AS first_column",
    ),
)
def c10(spark, folder):
    return content_rule(files(spark, folder), "minified_long_lines").select(*KEYS, *first_at())


def _entropy_sql(measured: str, digits: str) -> str:
    return f"""
SELECT '{measured}' AS measured, name, version, path, 'medium' AS severity, bytes, round(entropy, 2) AS entropy FROM (
  SELECT name, version, path, any_value(bytes) AS bytes,
         log2(sum(n)) - sum(n * log2(n)) / sum(n) AS entropy
  FROM (SELECT name, version, path, b, any_value(bytes) AS bytes, count(*) AS n
        FROM (SELECT name, version, path, strlen(content) AS bytes, unnest(regexp_extract_all({digits}, '..')) AS b
              FROM files WHERE {CODE} AND strlen(content) > 10000) x GROUP BY name, version, path, b) y
  GROUP BY name, version, path) z
WHERE entropy >= 4.0"""


@query(
    "c11_high_entropy_blob",
    view_sql(
        "files",
        tail=_entropy_sql("head", "left(hex(encode(content)), 8192)")
        + " UNION ALL "
        + _entropy_sql("whole", "hex(encode(content))"),
    ),
)
def c11(spark, folder):
    """The rule's own measure (the head of a file) next to the whole file's."""
    frames = []
    for measured, sample in (("head", fv.ENTROPY_SAMPLE_BYTES), ("whole", None)):
        config = ScanConfig(high_entropy=4.0, entropy_sample_bytes=sample)
        found = content_rule(files(spark, folder), "high_entropy_blob", config)
        frames.append(found.select(*KEYS, "bytes", "entropy", F.lit(measured).alias("measured")))
    return frames[0].unionByName(frames[1])


_BLOBS = "regexp_extract_all(content, '[A-Za-z0-9+/]{120,}={0,2}')"


@query(
    "c12_big_base64_blob",
    view_sql(
        "files",
        tail=f"""
, b AS (SELECT name, version, path, content, unnest({_BLOBS}) AS blob FROM files WHERE {CODE}),
r AS (SELECT *, from_base64(left(blob, 200)) AS raw FROM b WHERE length(regexp_replace(left(blob, 200), '=', '', 'g')) % 4 = 0)
SELECT name, version, path, 'medium' AS severity, strlen(content) AS size, CAST(length(blob) AS INT) AS blob_length,
       CASE WHEN regexp_matches(left(hex(raw), 200), '^(2[0-9A-F]|[3-6][0-9A-F]|7[0-9A-E])*$')
            THEN left(decode(CASE WHEN regexp_matches(hex(raw), '^(2[0-9A-F]|[3-6][0-9A-F]|7[0-9A-E])*$') THEN raw ELSE ''::BLOB END), 100)
            ELSE concat('<binary data: ', octet_length(raw), ' bytes>') END AS decoded_preview,
       {sql_at("blob")}
FROM r
UNION ALL
SELECT name, version, path, 'medium', strlen(content), CAST(length(blob) AS INT), '<decode failed>', {sql_at("blob")}
FROM b WHERE length(regexp_replace(left(blob, 200), '=', '', 'g')) % 4 <> 0""",
    ),
)
def c12(spark, folder):
    return content_rule(files(spark, folder), "big_base64_blob").select(
        *KEYS, "size", "blob_length", "decoded_preview", *first_at()
    )


@query("c13_wasm_present", sql_rule("medium", f"{CODE} AND magic = '0061736D'", source="binary_files"))
def c13(spark, folder):
    return content_rule(binary_files(spark, folder), "wasm_present").select(*KEYS)


@query(
    "c14_native_binary_present",
    sql_rule("high", f"{CODE} AND magic IN ('4D5A', '7F454C46', 'CFFAEDFE', 'CAFEBABE')", source="binary_files"),
)
def c14(spark, folder):
    return content_rule(binary_files(spark, folder), "native_binary_present").select(*KEYS)


@query(
    "c14_native_binary_all_files",
    sql_rule("high", "magic IN ('4D5A', '7F454C46', 'CFFAEDFE', 'CAFEBABE')", source="binary_files"),
)
def c14_all(spark, folder):
    config = ScanConfig(magic_in_all_files=True)
    return content_rule(binary_files(spark, folder), "native_binary_present", config).select(*KEYS)


@query(
    "c15_native_fetcher_present",
    sql_rule("low", f"{CODE} AND regexp_matches(content, '(?i)prebuild-install|node-pre-gyp')"),
)
def c15(spark, folder):
    return content_rule(files(spark, folder), "native_fetcher_present").select(*KEYS)


def _generic_sql(name: str, pattern: str, group: int = 0) -> str:
    shown = fv.GENERIC_PATTERN_NAMES[name]
    return f"""SELECT name, version, path, 'medium' AS severity, {sql_text(shown)} AS pattern,
       {sql_first_distinct(pattern, 10, group)} AS samples, {sql_at(f"regexp_extract(content, {pattern})")}
FROM files WHERE {CODE} AND regexp_matches(content, {pattern})"""


@query(
    "c16_suspicious_pattern",
    view_sql(
        "files",
        tail=" UNION ALL ".join(
            [
                _generic_sql("child_process", sql_text(fv.CHILD_PROCESS), 1),
                _generic_sql("dynamic_code", r"'(?i)\beval\s*\(|new\s+Function\s*\('"),
                _generic_sql("url", URL),
                _generic_sql("process_env", sql_text(fv.PROCESS_ENV)),
            ]
        ),
    ),
)
def c16(spark, folder):
    return content_rule(files(spark, folder), "suspicious_pattern").select(
        *KEYS, "pattern", flat(F.col("samples")).alias("samples"), *first_at()
    )


WORD = r"[A-Z][a-z]+"


@query(
    "c17_match_locations",
    view_sql(
        "files",
        tail=f"""
, l AS (SELECT name, version, path, unnest(string_split(content, chr(10))) AS line,
               unnest(range(1, 1 + len(string_split(content, chr(10))))) AS ln FROM files),
m AS (SELECT name, version, path, ln, unnest(range(1, 1 + len(regexp_extract_all(line, '{WORD}')))) AS k,
             unnest(regexp_extract_all(line, '{WORD}')) AS word,
             unnest(list_slice(string_split_regex(line, '{WORD}'), 1, len(regexp_extract_all(line, '{WORD}')))) AS gap
      FROM l),
p AS (SELECT name, version, path, ln, k, word,
             sum(strlen(gap) + strlen(word)) OVER (PARTITION BY name, version, path, ln ORDER BY k) - strlen(word) + 1 AS col,
             row_number() OVER (PARTITION BY name, version, path ORDER BY ln, k) AS i FROM m)
SELECT name, version, path, CAST(i AS INT) AS i, CAST(ln AS INT) AS line, CAST(col AS INT) AS "column", word AS "match"
FROM p WHERE i <= 5""",
    ),
)
def c17(spark, folder):
    return locate_matches(files(spark, folder), WORD).drop("snippet")


_FUNCTIONS = "(length(content) - length(replace(content, 'function', ''))) / 8"
_TECHNIQUES = r"""list_filter([
  CASE WHEN regexp_matches(content, '\\?x[0-9a-fA-F]{2}(?:\s*\\?x[0-9a-fA-F]{2})+') THEN 'hex_encoding' END,
  CASE WHEN regexp_matches(content, '(?i)(String\.fromCharCode\([^)]*\^|\.charCodeAt\([^)]*\)\s*\^|xor\s*\()') THEN 'xor_encryption' END,
  CASE WHEN len(regexp_extract_all(content, '[^\x00-\x7F]{3,}')) > 3 THEN 'unicode_obfuscation' END,
  CASE WHEN regexp_matches(content, '(?i)var\s+_0x[a-f0-9]{4,}\s*=\s*\[') THEN 'string_array_obfuscation' END,
  CASE WHEN regexp_matches(content, 'while\s*\(\s*!!\s*\[\s*\]\s*\)') THEN 'control_flow_flattening' END,
  CASE WHEN """ + _FUNCTIONS + """ > 50 AND length(content) < 50000 THEN 'dead_code_injection' END], lambda t: t IS NOT NULL)"""


@query(
    "o1_advanced_obfuscation",
    view_sql(
        "files",
        tail=f"""
, t AS (SELECT name, version, path, {_TECHNIQUES} AS techniques FROM files WHERE {JS} AND strlen(content) > 1000)
SELECT name, version, path, CASE WHEN len(techniques) >= 3 THEN 'high' ELSE 'medium' END AS severity,
       CASE WHEN len(techniques) >= 3 THEN 'high' WHEN len(techniques) = 2 THEN 'medium' ELSE 'low' END AS confidence,
       array_to_string(list_sort(techniques), '|') AS techniques
FROM t WHERE len(techniques) > 0""",
    ),
)
def o1(spark, folder):
    return content_rule(files(spark, folder), "advanced_obfuscation").select(
        *KEYS, "confidence", flat(F.col("techniques")).alias("techniques")
    )


_ACTIONS = (
    r"""list_filter(regexp_extract_all(content, '(?i)<form[^>]*action=["'']([^"'']+)', 1), """
    f"lambda a: a LIKE 'http%' AND regexp_extract(a, '^[a-zA-Z]+://([^/?#]*)', 1) <> '' AND NOT "
    f"regexp_full_match(lower(regexp_extract(a, '^[a-zA-Z]+://([^/?#]*)', 1)), {sql_text(ALLOWED)}))"
)


@query(
    "h1_phishing_form",
    sql_rule(
        "high",
        rf"""(regexp_matches(content, {sql_text(fv.PASSWORD_INPUT)}) OR regexp_matches(content, {sql_text(fv.CREDENTIAL_INPUT)}))
         AND len({_ACTIONS}) > 0""",
        f"array_to_string(list_sort(list_slice({_ACTIONS}, 1, 5)), '|') AS form_actions",
        source="html_files",
    ),
)
def h1(spark, folder):
    return content_rule(html_files(spark, folder), "phishing_form").select(
        *KEYS, flat(F.col("form_actions")).alias("form_actions")
    )


@query(
    "h2_fake_captcha",
    sql_rule(
        "medium",
        f"regexp_matches(content, {sql_text(fv.LURE_BUTTON)}) OR regexp_matches(content, {sql_text('(?i)' + '|'.join(fv.CAPTCHA_TEXTS))})",
        f"array_to_string(list_slice(regexp_extract_all(content, {sql_text(fv.LURE_BUTTON)}, 1), 1, 3), '|') AS button_samples",
        source="html_files",
    ),
)
def h2(spark, folder):
    return content_rule(html_files(spark, folder), "fake_captcha").select(
        *KEYS, flat(F.col("button_samples"), False).alias("button_samples")
    )


_CDN = (
    f"list_distinct(list_slice(list_filter(list_concat(regexp_extract_all(content, {sql_text(fv.SCRIPT_SRC)}, 1), "
    f"regexp_extract_all(content, {sql_text(fv.LINK_HREF)}, 1)), "
    r"lambda u: regexp_matches(u, 'unpkg\.com|jsdelivr\.net|cdnjs|esm\.sh|skypack')), 1, 10))"
)


@query(
    "h3_external_cdn_load",
    sql_rule(
        "medium", f"regexp_matches(content, {sql_text('(?i)' + '|'.join(h.replace('.', '[.]') for h in fv.CDN_HOSTS))})",
        f"array_to_string(list_sort({_CDN}), '|') AS cdn_urls", f"CAST(len({_CDN}) AS INT) AS cdn_count",
        source="html_files",
    ),
)
def h3(spark, folder):
    return content_rule(html_files(spark, folder), "external_cdn_load").select(
        *KEYS, flat(F.col("cdn_urls")).alias("cdn_urls"), "cdn_count"
    )


@query(
    "h4_iframe_embed",
    sql_rule(
        "medium", f"regexp_matches(content, {sql_text(fv.IFRAME_SRC)})",
        f"array_to_string(list_slice(regexp_extract_all(content, {sql_text(fv.IFRAME_SRC)}, 1), 1, 5), '|') AS iframe_urls",
        source="html_files",
    ),
)
def h4(spark, folder):
    return content_rule(html_files(spark, folder), "iframe_embed").select(
        *KEYS, flat(F.col("iframe_urls"), False).alias("iframe_urls")
    )


@query(
    "p1_http_server",
    sql_rule(
        "medium", f"suffix = '.py' AND regexp_matches(content, {sql_text(fv.PY_SERVER)})",
        f"{sql_first_distinct(sql_text(fv.PY_SERVER), 5)} AS frameworks",
    ),
)
def p1(spark, folder):
    return content_rule(files(spark, folder), "http_server").select(
        *KEYS, flat(F.col("frameworks")).alias("frameworks")
    )


@query(
    "p2_port_binding",
    sql_rule("medium", f"suffix = '.py' AND regexp_matches(content, {sql_text('(?i)socket[.]socket|(bind|listen|accept)[(]')})"),
)
def p2(spark, folder):
    return content_rule(files(spark, folder), "port_binding").select(*KEYS)


@query(
    "p3_python_download",
    sql_rule(
        "medium", f"suffix = '.py' AND regexp_matches(content, {sql_text(fv.PY_DOWNLOAD)})",
        f"{sql_first_distinct(sql_text(fv.PY_DOWNLOAD), 5, 1)} AS methods",
    ),
)
def p3(spark, folder):
    return content_rule(files(spark, folder), "python_download").select(
        *KEYS, flat(F.col("methods")).alias("methods")
    )


@query(
    "sh1_shell_download",
    sql_rule("high", f"suffix IN ('.sh', '.bash', '.cmd', '.ps1') AND regexp_matches(content, {sql_text(fv.SHELL_DOWNLOAD.replace('(?d)', ''))})"),
)
def sh1(spark, folder):
    return content_rule(files(spark, folder), "shell_download").select(*KEYS)


# --- all rules in one pass ---------------------------------------------------------------

# Thresholds low enough that the two rules find something in the driver's texts.
LOWERED = ScanConfig(high_entropy=4.0, big_js_bytes=2000)
# The checking SQL of each rule's own query, and the rule it checks.
_CHECKED = [
    ("c2_net_client_usage", "net_client_usage"), ("c3_c2_webhook", "c2_webhook"),
    ("c4_writes_outside_pkg", "writes_outside_pkg"),
    ("c5_writes_outside_pkg_candidate", "writes_outside_pkg_candidate"), ("c6_ci_evasion", "ci_evasion"),
    ("c7_env_snoop", "env_snoop"), ("c8_large_js", "large_js"), ("c9_webpack_bundle", "webpack_bundle"),
    ("c10_minified_long_lines", "minified_long_lines"), ("c12_big_base64_blob", "big_base64_blob"),
    ("c15_native_fetcher_present", "native_fetcher_present"), ("c16_suspicious_pattern", "suspicious_pattern"),
    ("p1_http_server", "http_server"), ("p2_port_binding", "port_binding"),
    ("p3_python_download", "script_download"), ("sh1_shell_download", "script_download"),
]
_CHECKED_PAGES = [
    ("h1_phishing_form", "phishing_form", "high"), ("h2_fake_captcha", "fake_captcha", "medium"),
    ("h3_external_cdn_load", "external_cdn_load", "medium"), ("h4_iframe_embed", "iframe_embed", "medium"),
]


def found_sql() -> str:
    """name, version, path, rule, severity and weight variant of every finding in files."""
    row = "SELECT name, version, path, '{}' AS rule, {} AS severity, {} AS variant FROM ({}) q"
    parts = [row.format(rule, "severity", "''", ORACLES[name]) for name, rule in _CHECKED]
    parts.append(f"SELECT name, version, path, rule, severity, '' FROM ({ORACLES['c1_url_domains']}) q")
    parts.append(row.format("high_entropy_blob", "severity", "''", ORACLES["c11_high_entropy_blob"]) + " WHERE measured = 'whole'")
    by_confidence = "CASE confidence WHEN 'high' THEN 'high' ELSE 'other' END"
    parts.append(row.format("advanced_obfuscation", "severity", by_confidence, ORACLES["o1_advanced_obfuscation"]))
    for name, rule, severity in _CHECKED_PAGES:
        where = ORACLES[name].split("FROM html_files WHERE ", 1)[1]
        pages = view_sql("files", tail=f"SELECT * FROM files WHERE suffix IN ('.html', '.htm') AND ({where})")
        parts.append(row.format(rule, f"'{severity}'", "''", pages))
    magic = f"{CODE} AND (starts_with(content, 'MZ') OR starts_with(content, concat(chr(127), 'ELF')))"
    parts.append(row.format("native_binary_present", "'high'", "''", view_sql("files", tail=f"SELECT * FROM files WHERE {magic}")))
    return " UNION ALL ".join(parts)


@query(
    "scan_rule_counts",
    f"SELECT rule, severity, count(*) AS findings, count(DISTINCT path) AS files FROM ({found_sql()}) f GROUP BY rule, severity",
)
def scan_counts(spark, folder):
    """All rules in one pass over the files, counted."""
    found = scan_files(files(spark, folder), LOWERED)
    return found.groupBy("rule", "severity").agg(
        F.count("*").alias("findings"), F.countDistinct("file_path").alias("files")
    )
