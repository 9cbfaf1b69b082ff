"""Look-alike package names.

The protected lists are short and fixed, so a name is compared with all of them inside
its own row: an array literal, a length test, then the thresholded edit distance. There
is no join and nothing to shuffle; names are processed where they are read. For long
lists `permutations_of` turns protected names into their misspellings, and finding those
among millions of names is a plain equi-join (`names_in_permutations`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarsift import fixed_values as fv
from tarsift.functions import text as tx

c, lit = F.col, F.lit


def bare_name(name: Column) -> Column:
    """``@scope/name`` -> ``name``, ``@x`` -> ``x``."""
    parts = F.split(name, "/")
    return F.when(
        F.startswith(name, lit("@")),
        F.when(F.size(parts) > 1, F.get(parts, lit(1))).otherwise(F.substring(name, 2, 2**31 - 1)),
    ).otherwise(name)


def scope_of(name: Column) -> Column:
    return F.substring_index(name, "/", 1)


def allowed_distance(target: Column) -> Column:
    size = F.length(target)
    return F.when(size > 6, lit(3)).when(size >= 4, lit(2)).otherwise(lit(1))


def _protected(names: list[str]) -> Column:
    # One literal, folded to an array once per query.
    return F.split(lit("\n".join(names)), "\n")


def similarity_percent(distance: Column, a: Column, b: Column) -> Column:
    return (1 - distance / F.greatest(F.length(a), F.length(b))) * 100


def _confusable_count(name: Column, target: Column) -> Column:
    """Positions where the name shows a listed look-alike of the target's character.
    Other differences are not counted."""
    pairs = [look + char for char, looks in fv.CONFUSABLES.items() for look in looks]
    hits = F.zip_with(
        F.split(F.lower(name), ""),
        F.split(F.lower(target), ""),
        lambda n, t: F.concat(n, t).isin(*pairs),
    )
    return F.size(F.filter(hits, lambda h: h))


def _length_type(name: Column, target: Column, same: Column, other: Column) -> Column:
    difference = F.length(name) - F.length(target)
    return (
        F.when(difference == -1, lit("character_omission"))
        .when(difference == 1, lit("character_insertion"))
        .when(difference == 0, same)
        .otherwise(other)
    )


_MATCH = "struct<edit_distance:int,target_package:string,similarity:double,typosquat_type:string>"


def _match(name: Column, popular: Column) -> Column:
    """How a bare name resembles a protected one; NULL when it does not."""
    target = bare_name(popular)
    limit = allowed_distance(target)
    near = F.abs(F.length(name) - F.length(target)) <= limit
    # With a threshold the distance stops early and is -1 beyond it.
    distances = [
        (size, F.levenshtein(F.lower(name), F.lower(target), size)) for size in (1, 2, 3)
    ]
    distance = F.when(limit == 1, distances[0][1]).when(limit == 2, distances[1][1])
    distance = F.when(near, distance.otherwise(distances[2][1])).otherwise(lit(-1))
    swapped = F.when(
        F.length(name) == F.length(target), _confusable_count(name, target)
    ).otherwise(lit(0))
    by_distance = F.struct(
        distance.alias("edit_distance"),
        popular.alias("target_package"),
        F.bround(similarity_percent(distance, name, target), 1).alias("similarity"),
        _length_type(
            name, target, lit("character_substitution"), lit("edit_distance")
        ).alias("typosquat_type"),
    ).cast(_MATCH)
    by_look = F.struct(
        swapped.alias("edit_distance"),
        popular.alias("target_package"),
        lit(95.0).alias("similarity"),
        lit("unicode_substitution").alias("typosquat_type"),
    ).cast(_MATCH)
    return F.when(name != target, F.when(distance >= 0, by_distance).when(
        swapped.between(1, 2), by_look
    ))


def detect_typosquats(
    names: DataFrame, popular: list[str] | None = None, all_matches: bool = False
) -> DataFrame:
    """Names that resemble a protected name, with the closest match (or all of them).

    Adds bare_name, target_package, edit_distance, similarity and typosquat_type to the
    rows that match. Among equally close targets the first by name wins.
    """
    listed = _protected(sorted(popular or fv.POPULAR_NAMES))
    base = names.withColumn("bare_name", bare_name(c("name")))
    pairs = F.filter(listed, lambda p: p != c("name"))
    found = F.array_sort(F.array_compact(F.transform(pairs, lambda p: _match(c("bare_name"), p))))
    kept = found if all_matches else F.slice(found, 1, 1)
    rows = base.select("*", F.inline(kept))
    return rows.select(
        *base.columns, "target_package", "edit_distance", "similarity", "typosquat_type"
    )


def typosquat_findings(manifests: DataFrame) -> DataFrame:
    """The rule over parsed manifests (name, version, package_name)."""
    declared = manifests.filter(F.coalesce("package_name", lit("")) != "").select(
        c("name").alias("key_name"), "version", c("package_name").alias("name")
    )
    found = detect_typosquats(declared)
    return found.select(
        c("key_name").alias("name"),
        "version",
        lit("typosquat_detected").alias("rule"),
        lit("high").alias("severity"),
        c("name").alias("package_name"),
        "target_package",
        "similarity",
        "edit_distance",
        "typosquat_type",
        F.format_string(
            fv.EXPLAIN["typosquat_detected"],
            c("name"),
            c("target_package"),
            c("similarity").cast("string"),
            c("typosquat_type"),
        ).alias("explanation"),
    )


def scope_hijacks(names: DataFrame, popular: list[str] | None = None) -> DataFrame:
    """Scoped names whose bare name is a protected scoped name's, under another scope."""
    scoped = [p for p in (popular or fv.POPULAR_NAMES) if p.startswith("@")]
    listed = _protected(sorted(scoped))
    same = F.filter(
        listed,
        lambda p: (bare_name(p) == c("bare_name")) & (scope_of(p) != scope_of(c("name"))),
    )
    base = names.filter(F.startswith("name", lit("@"))).withColumn(
        "bare_name", bare_name(c("name"))
    )
    return base.select("*", F.explode(F.array_compact(same)).alias("target_package")).select(
        "*",
        lit(100.0).alias("similarity"),
        lit(0).alias("edit_distance"),
        lit("scope_hijacking").alias("typosquat_type"),
    )


# --- the all-pairs detector -------------------------------------------------------------


def detector_names() -> list[str]:
    """The detector's list: every unscoped name also under common scopes."""
    names = set(fv.DETECTOR_NAMES)
    for name in fv.DETECTOR_NAMES:
        if not name.startswith("@"):
            names.update(form.format(name) for form in fv.DETECTOR_SCOPED_FORMS)
    return sorted(names)


def differing_positions(a: Column, b: Column) -> Column:
    """Positions at which two texts of one length differ."""
    unequal = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x != y)
    return F.size(F.filter(unequal, lambda u: u))


def few_substitutions(a: Column, b: Column) -> Column:
    """Same length and one or two differing positions."""
    return (F.length(a) == F.length(b)) & differing_positions(a, b).between(1, 2)


def _resembles(name: Column, target: Column) -> Column:
    limit = allowed_distance(target)
    near = F.abs(F.length(name) - F.length(target)) <= limit
    within = lambda size: F.levenshtein(name, target, size) >= 0
    close = F.when(limit == 1, within(1)).when(limit == 2, within(2)).otherwise(within(3))
    return (name != target) & ((near & close) | few_substitutions(name, target))


def typosquat_pairs(names: DataFrame, protected: list[str] | None = None) -> DataFrame:
    """All (suspicious_package, legitimate_package) pairs that resemble each other."""
    listed = _protected(protected or detector_names())
    base = names.select(c("name").alias("suspicious_package"))
    base = base.withColumn("bare", bare_name(c("suspicious_package")))
    near = F.filter(listed, lambda p: _resembles(c("bare"), bare_name(p)))
    return _described(base.select(
        "suspicious_package", "bare", F.explode(F.array_compact(near)).alias("legitimate_package")
    ))


def _described(pairs: DataFrame) -> DataFrame:
    """The detector's columns of (suspicious_package, bare, legitimate_package)."""
    full = [F.lower("suspicious_package"), F.lower("legitimate_package")]
    target = bare_name(c("legitimate_package"))
    same = F.when(few_substitutions(c("bare"), target), lit("character_substitution")).otherwise(
        lit("character_swap")
    )
    score = similarity_percent(
        F.levenshtein(*full), c("suspicious_package"), c("legitimate_package")
    )
    return pairs.select(
        "suspicious_package",
        "legitimate_package",
        score.alias("similarity_score"),
        _length_type(c("bare"), target, same, lit("multiple_changes")).alias("typosquat_type"),
    )


# --- protected names as a table ---------------------------------------------------------
# For lists of any length: keys that two names share if one resembles the other, an
# equi-join on them, and the exact test on what meets. Short names share what is left of them
# after a few deletions, long ones one of their quarters.

_KEY = "array<struct<size:int,part:int,text:string>>"
# Parts of look-alike keys are numbered from here on, by position.
_LOOKS_FROM = 100
# Targets of up to so many letters are found by deletion variants, longer ones by parts.
_VARIANTS_UPTO = 9


def _parts_of(size: Column) -> Column:
    """One part more than the edits that a long target allows: of two names within that
    distance some part is in both, moved by no more than the edits."""
    return lit(4)


def _part_start(i: Column, size: Column) -> Column:
    return F.floor(i * size / _parts_of(size)).cast("int")


def _key(size: Column, part: Column, text: Column) -> Column:
    return F.struct(
        size.cast("int").alias("size"), part.cast("int").alias("part"), text.alias("text")
    )


def _variants(text: Column, edits: int) -> Column:
    """The text and all that is left of it after up to so many deletions. Two texts within an
    edit distance have such a rest in common: each edit is a deletion on one side or both."""

    def shorter(one: Column) -> Column:
        without = lambda i: F.concat(F.left(one, i - 1), F.substring(one, i + 1, F.length(one)))
        return F.when(F.length(one) > 0, F.transform(F.sequence(lit(1), F.length(one)), without)).otherwise(
            F.array().cast("array<string>")
        )

    found = last = F.array(text)
    for _ in range(edits):
        step = lambda texts: F.array_distinct(F.flatten(F.transform(texts, shorter)))
        last = tx.let(last, step)
        found = F.concat(found, last)
    return F.array_distinct(found)


def _variant_keys(text: Column, allowed: int) -> Column:
    """Keys of the targets that allow so many edits; two substitutions are always looked for."""
    found = _variants(text, max(allowed, 2))
    return F.transform(found, lambda v: _key(lit(-1), lit(-allowed), v)).cast(_KEY)


def target_keys(target: Column) -> Column:
    """The keys of a protected bare name (lower case)."""
    size = F.length(target)

    def part(i: Column) -> Column:
        start, end = _part_start(i, size), _part_start(i + 1, size)
        return _key(size, i, F.substring(target, start + 1, end - start))

    cut = F.transform(F.sequence(lit(0), _parts_of(size) - 1), part).cast(_KEY)
    at = F.transform(
        F.sequence(lit(0), size - 1),
        lambda p: _key(size, p + _LOOKS_FROM, F.substring(target, p + 1, lit(1))),
    ).cast(_KEY)
    looked_for = F.filter(at, lambda k: k["text"].isin(*fv.CONFUSABLES))
    limit = allowed_distance(target)
    short = F.when(limit == 1, _variant_keys(target, 1)).when(limit == 2, _variant_keys(target, 2))
    keys = F.when(size > _VARIANTS_UPTO, cut).otherwise(short.otherwise(_variant_keys(target, 3)))
    return F.when(size > 0, F.concat(keys, looked_for)).otherwise(keys)


def name_keys(name: Column) -> Column:
    """The keys under which a protected name that this bare name (lower case) resembles lies."""
    n = F.length(name)
    none = F.array().cast(_KEY)

    def of_part(size: Column, i: Column) -> Column:
        start, width = _part_start(i, size), _part_start(i + 1, size) - _part_start(i, size)
        moved = F.transform(F.sequence(lit(-3), lit(3)), lambda s: start + s)
        inside = F.filter(moved, lambda at: (at >= 0) & (at + width <= n))
        return F.transform(inside, lambda at: _key(size, i, F.substring(name, at + 1, width))).cast(_KEY)

    def of_size(size: Column) -> Column:
        return F.flatten(F.transform(F.sequence(lit(0), _parts_of(size) - 1), lambda i: of_part(size, i)))

    first = F.greatest(n - 3, lit(_VARIANTS_UPTO + 1))
    parts = F.when(n + 3 > _VARIANTS_UPTO, F.flatten(F.transform(F.sequence(first, n + 3), of_size))).otherwise(none)
    # Which targets allow one, two or three edits follows from their length.
    short = [
        F.when(n.between(least, most), _variant_keys(name, allowed)).otherwise(none)
        for allowed, least, most in ((1, 0, 3 + 1), (2, 4 - 2, 6 + 2), (3, 7 - 3, _VARIANTS_UPTO + 3))
    ]
    meant: dict[str, list[str]] = {}
    for char, looks in fv.CONFUSABLES.items():
        for look in looks:
            meant.setdefault(look, []).append(char)
    by_look = F.create_map(*[x for k, v in meant.items() for x in (lit(k), F.array(*map(lit, v)))])
    at = F.transform(
        F.sequence(lit(0), n - 1),
        lambda p: F.transform(
            F.coalesce(F.try_element_at(by_look, F.substring(name, p + 1, lit(1))), F.array().cast("array<string>")),
            lambda char: _key(n, p + _LOOKS_FROM, char),
        ),
    )
    looks = F.when(n > 0, F.flatten(at)).otherwise(none)
    return F.array_distinct(F.concat(parts, *short, looks))


def near_names(names: DataFrame, protected: DataFrame) -> DataFrame:
    """(name, bare, target): pairs that may resemble each other; none that does is missing.

    Both frames have a column ``name``; names are taken once each. Short targets are met by what
    is left after deletions, long ones by a quarter of them, so that no key gathers more than
    the names that are nearly alike; only the listed look-alike characters, which match whatever
    else differs, bring names together by a single letter.
    """
    keyed = lambda df, keys: (
        df.select("name").filter(c("name").isNotNull()).distinct()
        .withColumn("bare", bare_name(c("name")))
        .select("name", "bare", F.explode(keys(F.lower("bare"))).alias("key"))
    )
    targets = keyed(protected, target_keys).select(c("name").alias("target"), "key")
    return keyed(names, name_keys).join(targets, "key").select("name", "bare", "target").distinct()


def typosquats_of_table(names: DataFrame, protected: DataFrame) -> DataFrame:
    """All matches of `detect_typosquats` against a table of protected names."""
    found = near_names(names, protected).filter(c("name") != c("target"))
    rows = found.withColumn("match", _match(c("bare"), c("target"))).filter(c("match").isNotNull())
    return rows.select("name", c("bare").alias("bare_name"), "match.*").select(
        "name", "bare_name", "target_package", "edit_distance", "similarity", "typosquat_type"
    )


def typosquat_pairs_of_table(names: DataFrame, protected: DataFrame) -> DataFrame:
    """`typosquat_pairs` against a table of protected names."""
    found = near_names(names, protected).filter(_resembles(c("bare"), bare_name(c("target"))))
    return _described(found.select(
        c("name").alias("suspicious_package"), "bare", c("target").alias("legitimate_package")
    ))


# --- permutations -----------------------------------------------------------------------


def _spliced(base: Column, keep: Column, middle: Column, resume: Column) -> Column:
    """The first ``keep`` characters, ``middle``, then everything from ``resume`` on."""
    rest = F.substring(base, resume + 1, F.length(base))
    return F.concat(F.left(base, keep), middle, rest)


def _base_permutations(base: Column) -> Column:
    size = F.length(base)
    places = F.when(size > 0, F.sequence(lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
    char = lambda i: F.substring(base, i + 1, lit(1))
    inserted = F.split(lit(fv.INSERTED_CHARACTERS), "")
    looks = F.create_map(
        *[
            part
            for ch, options in fv.PERMUTATION_CONFUSABLES.items()
            for part in (lit(ch), F.array(*[lit(o) for o in options]))
        ]
    )
    none = F.array().cast("array<string>")
    return F.array_distinct(
        F.concat(
            F.transform(places, lambda i: _spliced(base, i, lit(""), i + 1)),
            F.transform(places, lambda i: _spliced(base, i, char(i), i)),
            F.flatten(
                F.transform(
                    places,
                    lambda i: F.transform(
                        F.coalesce(F.try_element_at(looks, F.lower(char(i))), none),
                        lambda look: _spliced(base, i, look, i + 1),
                    ),
                )
            ),
            F.transform(
                F.filter(places, lambda i: i < size - 1),
                lambda i: _spliced(base, i, F.concat(char(i + 1), char(i)), i + 2),
            ),
            F.flatten(
                F.transform(
                    F.sequence(lit(0), size),
                    lambda i: F.transform(inserted, lambda ch: _spliced(base, i, ch, i)),
                )
            ),
        )
    )


def permutations_of(names: DataFrame) -> DataFrame:
    """(name, permutation): misspellings of each name, also under common scopes."""
    scope = F.regexp_extract("name", r"(?s)^@([^/]+)/.+", 1)
    base = (
        F.when(scope != "", F.regexp_extract("name", r"^@[^/]+/(.+)", 1))
        .when(F.startswith("name", lit("@")), F.substring("name", 2, 2**31 - 1))
        .otherwise(c("name"))
    )
    prepared = names.select("name", scope.alias("scope"), base.alias("base")).distinct()
    variations = F.split(lit(" ".join(fv.SCOPE_VARIATIONS)), " ")

    def forms(perm: Column) -> Column:
        under = F.transform(variations, lambda v: F.concat(lit("@"), v, lit("/"), perm))
        around = F.transform(variations, lambda v: F.concat(lit("@"), perm, lit("/"), v))
        own = F.array(F.concat(lit("@"), c("scope"), lit("/"), perm))
        return F.when(c("scope") != "", F.concat(own, under, around)).otherwise(
            F.concat(F.array(perm), under)
        )

    long_enough = F.filter(_base_permutations(c("base")), lambda p: F.length(p) > 1)
    # A name's permutations are some thousands: each row keeps its own apart.
    every = F.array_distinct(F.flatten(F.transform(long_enough, forms)))
    wanted = F.filter(every, lambda p: (p != c("name")) & (F.length(p) > 2))
    return prepared.select("name", F.explode(F.array_compact(wanted)).alias("permutation"))


def names_in_permutations(names: DataFrame, permutations: DataFrame) -> DataFrame:
    """Registered names that are a misspelling of a protected one."""
    return names.select(c("name").alias("permutation")).distinct().join(
        permutations, "permutation"
    ).select(
        c("permutation").alias("suspicious_package"), c("name").alias("legitimate_package")
    )
