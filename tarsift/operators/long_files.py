"""Rules over files that come in parts.

Of a long file each part is a row (see `unpack.cut`): its core, which belongs to it alone, and
what surrounds the core. A match belongs to the part in whose core it begins; the text before
the core shows where matching stands when the core begins, the text after it how the match
ends. `part_features` leaves of each part what it adds to the file's features, with places
counted from the start of the file; `joined_features` puts the parts of a file together in
their order; rules then make their rows of features as they do for any other file.

Counts add up, lists of first matches are cut after joining, flags hold if they hold anywhere,
URLs are joined by domain. What a part leaves does not grow with the number of parts, and no
content is shuffled after this. Parts end after white space or quotes, where names, URLs and
encoded runs end; a single match that is longer than the surroundings of a part (256 KiB) is
seen as far as they reach.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarsift import fixed_values as fv
from tarsift.config import ScanConfig
from tarsift.functions import text as tx
from tarsift.functions.entropy import byte_entropy
from tarsift.operators import content_rules as cr
from tarsift.operators.file_rules import FOUND, as_found
from tarsift.operators.user_rules import RuleSpec, user_row, user_rule_pattern

c, lit = F.col, F.lit
MEMBER = ["archive", "ordinal"]

#: Of a list of first matches rules read so many at most.
FIRST = 20
LOCATIONS = 5

#: Feature: pattern, files it is looked for in, and the group that is shown.
MATCHES = {
    "urls": (fv.URL, cr.is_code, 0),
    "net": (fv.NET_CLIENT, cr.is_code, 0),
    "c2": (fv.C2_ENDPOINT, cr.is_code, 0),
    "writes": (fv.FS_WRITE, cr.is_code, 0),
    "hints": (fv.SENSITIVE_PATH, cr.is_code, 0),
    "ci": (fv.CI_CHECK, cr.is_code, 0),
    "spawns": (fv.CHILD_PROCESS, cr.is_code, 1),
    "dynamic": (fv.DYNAMIC_CODE, cr.is_code, 0),
    "env_reads": (fv.PROCESS_ENV, cr.is_code, 0),
    "blobs": (fv.BASE64_RUN, cr.is_code, 0),
    "form_actions": (fv.FORM_ACTION, cr.is_html, 1),
    "lure_buttons": (fv.LURE_BUTTON, cr.is_html, 1),
    "iframes": (fv.IFRAME_SRC, cr.is_html, 1),
    "scripts": (fv.SCRIPT_SRC, cr.is_html, 1),
    "links": (fv.LINK_HREF, cr.is_html, 1),
    "py_servers": (fv.PY_SERVER, cr.is_python, 0),
    "py_downloads": (fv.PY_DOWNLOAD, cr.is_python, 1),
}
#: What the joined features are called where a rule reads another name.
LOCATION_NAMES = {
    "net": "net_locations", "c2": "c2_locations", "writes": "write_locations", "hints": "hint_locations",
    "ci": "ci_locations", "spawns": "spawn_locations", "dynamic": "dynamic_locations", "urls": "url_locations",
    "env_reads": "env_read_locations", "env_keys": "env_locations",
}
FLAGS = ("webpack", "fetcher", "captcha", "py_socket", "shell_fetch", "has_cdn", "wasm", "native")
TEXT_FLAGS = ("xor_code", "string_array", "flattened_loop", "credential")
SUMS = ("non_ascii_runs", "function_count", "decoded_length")


def _items(text: Column, pattern: str, begin: Column, end: Column, lead: Column, group: int = 0) -> Column:
    """The matches that begin from ``begin`` to ``end``: place in the file, offset in the text,
    match and group. ``lead`` is how far into its line the text begins."""

    def of(found: Column) -> Column:
        steps = tx.match_steps(F.split(text, pattern, -1), found)
        shown = F.regexp_extract_all(text, lit(pattern), lit(group)) if group else found
        placed = F.zip_with(
            F.zip_with(tx.match_positions(steps), found, lambda p, v: F.struct(p.alias("p"), v.alias("found"))),
            shown,
            lambda item, v: F.struct(
                item["p"]["offset"].alias("offset"),
                (c("lines") + item["p"]["line"]).cast("int").alias("line"),
                (item["p"]["column"] + F.when(item["p"]["line"] == 1, lead).otherwise(lit(0))).cast("int").alias("column"),
                item["p"]["span"].alias("span"),
                item["found"].alias("found"),
                v.alias("shown"),
            ),
        )
        return F.filter(placed, lambda item: (item["offset"] >= begin) & (item["offset"] < end))

    return tx.let(F.regexp_extract_all(text, lit(pattern), lit(0)), lambda found: F.when(tx.has(found), of(found)))


def _byte_items(pattern: str, group: int = 0) -> Column:
    lead = c("at") - c("line_at")
    return _items(c("body"), pattern, c("before"), c("before") + c("core"), lead, group)


def _first(items: Column, n: int = FIRST) -> Column:
    return F.slice(items, 1, n)


def _texts(items: Column, field: str = "found") -> Column:
    return F.transform(items, lambda item: item[field])


def _byte_locations(items: Column) -> Column:
    first = _first(items, LOCATIONS)
    return tx.locations(c("content"), first, F.transform(first, lambda item: tx.utf8(item["shown"])))


def _text_locations(items: Column) -> Column:
    at = lambda item: tx.text_snippet_at(c("decoded"), item["offset"], item["span"])
    return F.transform(_first(items, LOCATIONS), lambda item: tx.location(item, item["shown"], at(item)))


def _blobs(items: Column) -> Column:
    def of(item: Column) -> Column:
        place = tx.location(item, tx.utf8(item["found"]), tx.snippet_at(c("content"), item["offset"], item["span"]))
        return F.struct(
            F.length(item["found"]).alias("length"), cr._preview(item["found"]).alias("preview"), place.alias("place")
        )

    return F.transform(items, of)


def _long_line() -> Column:
    """Offset in the content of the first long line, if it begins in the core."""
    later = F.regexp_instr(c("body"), lit(fv.LONG_LINE.replace(r"(?:\A|\n)", r"\n")))
    found = F.when(c("part") == 0, F.regexp_instr(c("body"), lit(fv.LONG_LINE))).otherwise(later)
    broken = lambda at: F.substring(c("content"), at, lit(1)) == F.unhex(lit("0A"))
    start = tx.let(F.when(found > 0, found), lambda at: F.when(broken(at), at).otherwise(at - 1))
    return tx.let(start, lambda at: F.when((at >= c("before")) & (at < c("before") + c("core")), at))


def _long_line_location() -> Column:
    at = c("long_line")
    before = tx.byte_text(F.substring(c("content"), lit(1), at))
    line = c("lines") + F.length(before) - F.length(F.replace(before, lit("\n"), lit(""))) + 1
    rest = tx.byte_text(F.substring(c("content"), at + 1, F.octet_length("content") - at))
    span = F.length(F.substring_index(rest, "\n", 1))
    place = F.struct(
        line.cast("int").alias("line"), lit(1).alias("column"), tx.snippet_at(c("content"), at, span).alias("snippet")
    )
    return F.when(at.isNotNull(), F.array(place))


def part_features(parts: DataFrame, config: ScanConfig, rules: list[RuleSpec] | None = None) -> DataFrame:
    """What each part adds to the features of its file: archive, ordinal, path, size, part, p."""
    base = parts.withColumn("suffix", tx.suffix_of(c("path")))
    base = base.withColumn("body", tx.byte_text(c("content"))).withColumn("low", F.lower("body"))
    is_script = cr.is_large_enough_js(config)
    decoded = F.when(is_script | cr.is_code(config), tx.clean_text(c("content")))
    own = F.when(decoded.isNotNull(), tx.clean_text(F.substring("content", c("before") + 1, c("core"))))
    base = base.withColumn("own", own).withColumn("decoded", decoded)
    lead_in = F.length(tx.clean_text(F.substring("content", lit(1), c("before"))))
    base = base.withColumn("begin", F.when(decoded.isNotNull(), lead_in))
    keys = _items(c("decoded"), fv.ENV_SECRET, c("begin"), c("begin") + F.length("own"), c("line_chars"))
    items = {f"{k}_items": F.when(route(config), _byte_items(pattern, group)) for k, (pattern, route, group) in MATCHES.items()}
    items["env_keys_items"] = F.when(cr.is_code(config) & F.contains(c("low"), lit(".env.")), keys)
    items |= {f"rule{i}_items": F.when(c("suffix").isin(*r.suffixes), _byte_items(user_rule_pattern(r))) for i, r in enumerate(rules or [])}
    base = base.select("*", *[column.alias(k) for k, column in items.items()], _long_line().alias("long_line"))

    is_first = c("part") == 0
    flags = {k: cr.FEATURES[k].build(config) for k in FLAGS}
    flags |= {k: is_first & flags[k] for k in ("wasm", "native")}
    scripts_only = lambda column: F.when(is_script, column)
    base = base.select(
        "*",
        _texts(c("urls_items")).alias("urls"),
        c("urls_items").alias("url_places"),
        _texts(c("c2_items")).alias("c2"),
        scripts_only(F.nullif(F.regexp_extract("decoded", fv.HEX_RUN, 0), lit(""))).alias("hex_runs"),
        scripts_only(F.regexp_count("own", lit(fv.NON_ASCII_RUN))).alias("non_ascii_runs"),
        scripts_only(cr._xor_code(config)).alias("xor_code"),
        scripts_only(F.contains(c("low"), lit("_0x")) & c("decoded").rlike(fv.STRING_ARRAY)).alias("string_array"),
        scripts_only(F.contains(c("low"), lit("!!")) & c("decoded").rlike(fv.FLATTENED_LOOP)).alias("flattened_loop"),
        scripts_only((F.length("own") - F.length(F.replace("own", lit("function"), lit("")))) / 8).alias("function_count"),
        scripts_only(F.length("own")).alias("decoded_length"),
        (cr.is_html(config) & (c("body").rlike(fv.PASSWORD_INPUT) | c("body").rlike(fv.CREDENTIAL_INPUT))).alias("credential"),
        *[flag.alias(k) for k, flag in flags.items()],
    )
    base = base.withColumn("url_hits", cr._url_hits(config)).withColumn("c2_urls", cr._c2_urls(config))
    base = base.withColumn("url_run_starts", cr._url_run_starts(config))
    base = base.withColumn("url_domains", cr._url_domains(config))

    outward = lambda a: F.startswith(a, lit("http")) & tx.off_list(tx.url_domain(a), config.allow_domains)
    actions = F.filter(cr.real_text(_texts(c("form_actions_items"), "shown")), outward)
    marked = lambda k: F.filter(_texts(c(f"{k}_items"), "shown"), lambda u: tx.contains_any(u, fv.CDN_MARKS))
    measured = c("entropy")
    if config.entropy_sample_bytes is not None:
        sample = F.substring("content", lit(1), lit(config.entropy_sample_bytes))
        measured = byte_entropy(F.when(is_first & cr.entropy_wanted(config), sample))

    def of(k: str) -> Column:
        found = c(f"{k}_items")
        return F.struct(
            F.size(found).alias("count"),
            _texts(_first(found)).alias("first"),
            _texts(_first(found), "shown").alias("shown"),
            (_text_locations(found) if k == "env_keys" else _byte_locations(found)).alias("locations"),
        )

    matched = [k for k in (*MATCHES, "env_keys") if k not in ("form_actions", "scripts", "links", "blobs")]
    p = F.struct(
        *[of(k).alias(k) for k in matched],
        _first(F.array_distinct(_texts(c("env_keys_items"))), 10).alias("env_names"),
        F.struct(F.size(actions).alias("count"), _first(actions).alias("first")).alias("form_actions"),
        _first(marked("scripts"), 10).alias("scripts"),
        _first(marked("links"), 10).alias("links"),
        _blobs(c("blobs_items")).alias("blobs_shown"),
        *[c(k) for k in ("c2_urls", "hex_runs", *FLAGS, *TEXT_FLAGS, *SUMS)],
        F.when(is_first, tx.snippet_at(c("content"), lit(0), lit(1))).alias("head"),
        F.when(is_first, tx.snippet_at(c("content"), lit(0), F.least(c("size"), lit(200)).cast("int"))).alias("long_head"),
        measured.alias("entropy"),
        (c("at") + c("long_line")).alias("long_line_at"),
        _long_line_location().alias("long_line_location"),
        *[
            F.struct(
                F.size(c(f"rule{i}_items")).alias("count"),
                _first(F.array_distinct(_texts(c(f"rule{i}_items"))), r.limit).alias("first"),
            ).alias(f"rule{i}")
            for i, r in enumerate(rules or [])
        ],
    )
    return base.select(*MEMBER, "path", "suffix", "size", "part", p.alias("p"), "url_domains")


def _chain(value) -> Column:
    """Lists of all parts, one after another."""
    return F.flatten(F.array_compact(F.transform(c("parts"), lambda part: value(part["p"]))))


def _values(value) -> Column:
    return F.array_compact(F.transform(c("parts"), lambda part: value(part["p"])))


def _total(value) -> Column:
    zero = lit(0).cast("double")
    return F.aggregate(_values(value), zero, lambda total, n: total + n.cast("double"))


def _any(value) -> Column:
    return F.exists(c("parts"), lambda part: F.coalesce(value(part["p"]), lit(False)))


def joined_features(features: DataFrame, config: ScanConfig) -> DataFrame:
    """The features of whole files, one row for each, under the names that rules read."""
    domains = (
        features.select(*MEMBER, "part", F.inline("url_domains"))
        .groupBy(*MEMBER, "domain")
        .agg(
            F.sum("url_count").cast("int").alias("url_count"),
            F.sort_array(F.collect_list(F.struct("part", "sample_urls", "locations"))).alias("pieces"),
        )
        .select(
            *MEMBER,
            F.struct(
                "domain",
                "url_count",
                F.slice(F.flatten("pieces.sample_urls"), 1, 3).alias("sample_urls"),
                F.slice(F.flatten("pieces.locations"), 1, LOCATIONS).alias("locations"),
            ).alias("entry"),
        )
        .groupBy(*MEMBER)
        .agg(F.collect_list("entry").alias("url_domains"))
    )
    files = features.groupBy(*MEMBER).agg(
        *[F.any_value(k).alias(k) for k in ("path", "suffix", "size")],
        F.array_sort(F.collect_list(F.struct("part", "p")), lambda x, y: x["part"] - y["part"]).alias("parts"),
    )
    files = files.join(domains, MEMBER, "left")
    columns: dict[str, Column] = {}
    matched = [k for k in (*MATCHES, "env_keys") if k not in ("form_actions", "scripts", "links", "blobs")]
    for k in matched:
        columns[k] = F.slice(_chain(lambda p, k=k: p[k]["first"]), 1, FIRST)
        columns[f"{k}_count"] = _total(lambda p, k=k: F.greatest(p[k]["count"], lit(0))).cast("int")
        if k in LOCATION_NAMES:
            columns[LOCATION_NAMES[k]] = F.slice(_chain(lambda p, k=k: p[k]["locations"]), 1, LOCATIONS)
    columns["spawn_calls"] = F.slice(_chain(lambda p: p["spawns"]["shown"]), 1, FIRST)
    for k in ("lure_buttons", "iframes", "py_downloads"):
        columns[k] = F.slice(_chain(lambda p, k=k: p[k]["shown"]), 1, FIRST)
    columns["env_keys"] = F.array_distinct(_chain(lambda p: p["env_names"]))
    # Names of sensitive places count in files that write.
    columns["hints"] = F.when(_any(lambda p: p["writes"]["count"] > 0), columns["hints"])
    columns["c2_urls"] = F.slice(_chain(lambda p: p["c2_urls"]), 1, 5)
    columns["blobs_shown"] = _chain(lambda p: p["blobs_shown"])
    if config.max_blobs is not None:
        columns["blobs_shown"] = F.slice(columns["blobs_shown"], 1, config.max_blobs)
    columns["form_actions"] = F.when(
        _any(lambda p: p["credential"]), F.slice(_chain(lambda p: p["form_actions"]["first"]), 1, FIRST)
    )
    columns["form_actions_count"] = _total(lambda p: F.greatest(p["form_actions"]["count"], lit(0))).cast("int")
    loaded = F.slice(F.concat(_chain(lambda p: p["scripts"]), _chain(lambda p: p["links"])), 1, 10)
    columns["cdn_urls"] = F.array_sort(F.array_distinct(cr.real_text(loaded)))
    columns |= {k: _any(lambda p, k=k: p[k]) for k in (*FLAGS, *TEXT_FLAGS)}
    columns |= {k: _total(lambda p, k=k: p[k]) for k in SUMS}
    columns["non_ascii_runs"] = columns["non_ascii_runs"].cast("int")
    for k in ("hex_runs", "head", "long_head", "long_line_at", "long_line_location"):
        columns[k] = F.get(_values(lambda p, k=k: p[k]), lit(0))
    columns["entropy"] = F.get(_values(lambda p: p["entropy"]), lit(0))
    files = files.select(*MEMBER, "path", "suffix", "size", "url_domains", "parts", *[v.alias(k) for k, v in columns.items()])
    return files.withColumn("techniques", cr._techniques(config))


def found_in_parts(features: DataFrame, config: ScanConfig, rules: list[RuleSpec] | None = None) -> DataFrame:
    """archive, ordinal and what all rules find in the files whose parts' features these are."""
    files = joined_features(features, config)
    rows = [F.when(rule.applies(config), F.transform(rule.rows(config), as_found)) for rule in cr.RULES.values()]
    for i, spec in enumerate(rules or []):
        count = _total(lambda p, i=i: F.greatest(p[f"rule{i}"]["count"], lit(0))).cast("int")
        samples = F.slice(F.array_distinct(_chain(lambda p, i=i: p[f"rule{i}"]["first"])), 1, spec.limit)
        rows.append(F.transform(F.array_compact(F.array(user_row(spec, samples, count))), as_found))
    empty = F.array().cast(FOUND)
    return files.select(*MEMBER, F.concat(*[F.coalesce(row, empty) for row in rows]).alias("found"))
