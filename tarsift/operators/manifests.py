"""Rules over package manifests: metadata, install hooks, packaging hints.

Input is a manifests table (name, version, manifest STRING), one row per package
version, and where needed the member list (name, version, path) of the archives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarsift import fixed_values as fv
from tarsift.config import ScanConfig
from tarsift.functions import text as tx

c, lit = F.col, F.lit
KEYS = ["name", "version"]
# The number words some JSON readers take, where a value stands.
NOT_A_NUMBER = r"([:\[,]\s*)(?:NaN|-?Infinity)(?=\s*[,}\]])"


def valid_json(manifest: Column) -> Column:
    """The manifest where it is one JSON object, else '{}': a broken manifest counts as an
    empty one and the scan goes on.

    As readers of manifests do, of a repeated key the last value counts (the session allows
    them, see ``session.REQUIRED``), and NaN and Infinity are no error: they read as null.
    """
    text = F.regexp_replace(manifest, r"^\s+|\s+$", "")
    whole = F.startswith(text, lit("{")) & F.endswith(text, lit("}"))
    numbered = F.regexp_replace(text, NOT_A_NUMBER, "$1null")
    document = F.coalesce(F.try_parse_json(text), F.try_parse_json(numbered))
    return tx.let(document, lambda d: F.when(whole & d.isNotNull(), F.to_json(d)).otherwise(lit("{}")))


def parse_manifests(manifests: DataFrame) -> DataFrame:
    """Keys, the checked JSON text, the declared package name and the scripts map. What this
    made of a manifests table counts as one, and is not checked again."""
    if "scripts" in manifests.columns:
        return manifests
    checked = manifests.select(*KEYS, valid_json(c("manifest")).alias("manifest"))
    return checked.select(
        *KEYS,
        "manifest",
        field("name").alias("package_name"),
        F.from_json(field("scripts"), "map<string,string>").alias("scripts"),
    )


def field(path: str, source: str = "manifest") -> Column:
    return F.get_json_object(c(source), f"$.{path}")


# --- metadata ---------------------------------------------------------------------------


def clean(value: Column) -> Column:
    """Text without NUL characters and outer space; empty becomes NULL."""
    return F.nullif(tx.strip(F.translate(value, "\x00", "")), lit(""))


def _first_filled(document: Column, *fields: str) -> Column:
    """The first of the fields that is present and not empty."""
    values = [F.nullif(F.get_json_object(document, f"$.{name}"), lit("")) for name in fields]
    return clean(F.coalesce(*values))


def _person(document: Column) -> Column:
    """struct<name, url> of a person given as an object or as plain text."""
    is_object = F.startswith(document, lit("{"))
    name = F.when(
        is_object, _first_filled(document, "name", "username", "login", "email")
    ).otherwise(clean(document))
    url = F.when(is_object, _first_filled(document, "url", "homepage", "web"))
    return F.struct(name.alias("name"), url.alias("url"))


def _first_person(documents: Column) -> Column:
    """The first person of a JSON array who has a name."""
    people = F.transform(F.from_json(documents, "array<string>"), _person)
    return F.get(F.filter(people, lambda p: p["name"].isNotNull()), lit(0))


def package_metadata(manifests: DataFrame) -> DataFrame:
    """author, author_url, description, homepage, repository, npm_username per version.

    The author is the author field (text, object, or the first named of a list), else
    the first named maintainer, else the publisher.
    """
    base = parse_manifests(manifests).select(
        *KEYS,
        *[field(f).alias(f) for f in ("description", "homepage", "repository", "author")],
        *[field(f).alias(f) for f in ("maintainers", "publisher")],
    )
    listed = F.startswith(c("author"), lit("["))
    author = F.when(listed, _first_person(c("author"))).when(
        c("author").isNotNull(), _person(c("author"))
    )
    maintainers = F.when(
        F.startswith(c("maintainers"), lit("[")), _first_person(c("maintainers"))
    )
    by_object = F.startswith(c("publisher"), lit("{"))
    base = base.withColumns({"by_author": author, "by_maintainers": maintainers})
    person = F.when(c("by_author.name").isNotNull(), c("by_author")).otherwise(c("by_maintainers"))
    base = base.withColumn("person", person)
    publisher_name = F.when(by_object, _first_filled(c("publisher"), "name", "username")).otherwise(
        clean(c("publisher"))
    )
    in_repository = F.startswith(c("repository"), lit("{"))
    return base.select(
        *KEYS,
        F.coalesce(c("person.name"), publisher_name).alias("author"),
        F.coalesce(
            c("person.url"), F.when(by_object, _first_filled(c("publisher"), "url"))
        ).alias("author_url"),
        clean(c("description")).alias("description"),
        clean(c("homepage")).alias("homepage"),
        F.when(in_repository, _first_filled(c("repository"), "url", "web", "https"))
        .otherwise(clean(c("repository")))
        .alias("repository"),
        F.when(by_object, _first_filled(c("publisher"), "username")).alias("npm_username"),
    )


# --- install hooks ----------------------------------------------------------------------


def hook_tags(command: Column, config: ScanConfig) -> Column:
    bundle = command.rlike(fv.HOOK_BUNDLE)
    benign = command.rlike("(?iU)" + "|".join(config.build_tools))
    # As shipped, a build tool is only noted next to a bundle, which is high anyway.
    noted = benign if config.strict_benign else bundle & benign
    tests = [
        ("shell_spawn", command.rlike(fv.HOOK_SHELL)),
        ("downloader", command.rlike(fv.HOOK_DOWNLOADER)),
        ("node_shellish", command.rlike(fv.HOOK_NODE_EVAL)),
        ("bundle_exec", bundle),
        ("benign_build", noted),
        ("url_in_command", command.rlike(fv.HOOK_URL)),
    ]
    return F.array_compact(F.array(*[F.when(test, lit(tag)) for tag, test in tests]))


def lifecycle_hooks(manifests: DataFrame, config: ScanConfig | None = None) -> DataFrame:
    """One row per declared hook: key, value, tags, severity, is_risky."""
    config = config or ScanConfig()
    hooks = F.array(
        *[
            F.struct(
                lit(i).alias("position"),
                lit(key).alias("key"),
                F.try_element_at(c("scripts"), lit(key)).alias("value"),
            )
            for i, key in enumerate(fv.LIFECYCLE_HOOKS)
        ]
    )
    declared = F.filter(hooks, lambda h: F.coalesce(h["value"], lit("")) != "")
    rows = parse_manifests(manifests).select(*KEYS, F.inline(F.array_compact(declared)))
    rows = rows.withColumn("tags", hook_tags(c("value"), config))
    risky = F.arrays_overlap(c("tags"), F.array(*[lit(t) for t in fv.RISKY_HOOK_TAGS]))
    severity = F.when(risky, lit("high"))
    severity = severity.when(c("tags") == F.array(lit("benign_build")), lit("low"))
    return rows.withColumns({"is_risky": risky, "severity": severity.otherwise(lit("medium"))})


def lifecycle_findings(manifests: DataFrame, config: ScanConfig | None = None) -> DataFrame:
    tags = F.array_join(c("tags"), ", ")
    plain = (c("severity") == "medium") & ~F.array_contains("tags", "benign_build")
    explanation = F.when(
        c("severity") == "high", F.format_string(fv.EXPLAIN["lifecycle_high"], c("key"), tags)
    ).when(plain, F.format_string(fv.EXPLAIN["lifecycle_medium"], c("key"), tags))
    return lifecycle_hooks(manifests, config).select(
        *KEYS,
        lit("lifecycle_script").alias("rule"),
        "severity",
        "key",
        "value",
        "tags",
        explanation.alias("explanation"),
    )


def hook_urls(manifests: DataFrame, config: ScanConfig | None = None) -> DataFrame:
    """One finding per URL in a hook command."""
    config = config or ScanConfig()
    urls = F.regexp_extract_all("value", lit(fv.HOOK_URL_TEXT), lit(0))
    rows = lifecycle_hooks(manifests, config).filter(c("value").rlike(fv.HOOK_URL))
    rows = rows.select(
        *KEYS, c("key").alias("hook"), F.explode(F.array_compact(urls)).alias("url")
    ).withColumn("domain", tx.url_domain(c("url")))
    outside = tx.off_list(c("domain"), config.allow_domains)
    return rows.select(
        *KEYS,
        F.when(outside, lit("url_outside_allowlist")).otherwise(lit("url_in_code")).alias("rule"),
        F.when(outside, lit("high")).otherwise(lit("medium")).alias("severity"),
        lit("<lifecycle:cmd>").alias("path"),
        "url",
        "domain",
        "hook",
        F.when(
            outside, F.format_string(fv.EXPLAIN["hook_url"], c("hook"), c("domain"))
        ).alias("explanation"),
    )


def risky_hooks(manifests: DataFrame, config: ScanConfig | None = None) -> DataFrame:
    """Versions with a risky hook and the hooks that make them so."""
    found = lifecycle_hooks(manifests, config).filter("is_risky")
    hooks = F.collect_set(F.struct("position", "key", "tags"))
    ordered = F.transform(F.array_sort(hooks), lambda h: F.struct(h["key"], h["tags"]))
    # One entry per hook kind and tag set, so the set is short.
    return found.groupBy(*KEYS).agg(ordered.alias("lifecycle"))


# --- packaging hints --------------------------------------------------------------------


def _base_name() -> Column:
    return F.substring_index(c("path"), "/", -1)


def npmrc_present(members: DataFrame) -> DataFrame:
    found = members.filter(_base_name() == ".npmrc").select(*KEYS).distinct()
    return found.select(
        *KEYS, lit("npmrc_present").alias("rule"), lit("high").alias("severity")
    )


def lockfile_present(members: DataFrame) -> DataFrame:
    """One finding per lock file name, however often it occurs."""
    found = members.select(*KEYS, _base_name().alias("file"))
    found = found.filter(c("file").isin(*fv.LOCKFILES)).distinct()
    return found.select(
        *KEYS, lit("lockfile_present").alias("rule"), lit("low").alias("severity"), "file"
    )


def has_bin(manifests: DataFrame) -> DataFrame:
    """The key counts, whatever its value: a JSON null too."""
    base = parse_manifests(manifests)
    return base.filter(F.array_contains(F.json_object_keys("manifest"), "bin")).select(
        *KEYS, lit("has_bin").alias("rule"), lit("low").alias("severity"), field("bin").alias("bin")
    )


def _fetches_natively() -> Column:
    return F.exists(F.map_values("scripts"), lambda v: v.rlike(fv.SCRIPT_FETCHER))


def native_fetcher_in_scripts(manifests: DataFrame) -> DataFrame:
    return parse_manifests(manifests).filter(_fetches_natively()).select(
        *KEYS,
        lit("native_fetcher_present").alias("rule"),
        lit("low").alias("severity"),
        lit("scripts").alias("where"),
    )


def native_fetcher_custom_url(manifests: DataFrame) -> DataFrame:
    carries_url = F.exists(F.map_values("scripts"), lambda v: v.rlike(fv.SCRIPT_FETCHER_URL))
    return parse_manifests(manifests).filter(_fetches_natively() & carries_url).select(
        *KEYS, lit("native_fetcher_custom_url").alias("rule"), lit("medium").alias("severity")
    )
