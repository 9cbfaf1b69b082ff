"""Column functions over file contents.

Rules over bytes run on the ISO-8859-1 reading of a file: one character per byte, so
offsets and lengths are byte offsets, and ASCII patterns behave as they do on bytes.
Text taken out of that reading goes back through :func:`utf8` before anyone sees it.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarsift import fixed_values as fv

REPLACEMENT = "�"

# Matches per step of the two-level scan in `match_positions`. Appending to an array
# copies it, so one flat pass over n matches costs n^2; chunks keep it near n * CHUNK.
CHUNK = 256


def byte_text(content: Column) -> Column:
    """Binary content as one character per byte."""
    return F.decode(content, "ISO-8859-1")


def byte_literal(value: str) -> str:
    """A text as it stands in the byte reading of a file."""
    return value.encode().decode("latin-1")


def byte_pattern(pattern: str, nocase: bool = False) -> str:
    """A regular expression for the byte reading of a file.

    A non-ASCII character becomes the bytes it is stored as, in one group so that what follows
    applies to all of them; without regard to case, either of its two forms. A set of
    characters is one byte wide in that reading, so one that names non-ASCII characters is
    refused, and so is one of them after a backslash.
    """
    if pattern.isascii():
        return pattern
    out, escaped, inside = [], False, False
    for char in pattern:
        if char.isascii():
            out.append(char)
            if escaped:
                escaped = False
            elif char == "\\":
                escaped = True
            elif char == "[":
                inside = True
            elif char == "]":
                inside = False
            continue
        if escaped or inside:
            raise ValueError(f"no byte pattern for {char!r} in {pattern!r}")
        forms = {f for f in (char, char.lower(), char.upper()) if len(f) == 1} if nocase else {char}
        out.append("(?:" + "|".join(re.escape(byte_literal(f)) for f in sorted(forms)) + ")")
    return "".join(out)


def clean_text(content: Column) -> Column:
    """Binary content as UTF-8 text, invalid bytes dropped."""
    return F.replace(F.make_valid_utf8(content.cast("string")), F.lit(REPLACEMENT), F.lit(""))


def utf8(text: Column) -> Column:
    """Byte text (or a piece of it) as real text, invalid bytes dropped."""
    return clean_text(F.encode(text, "ISO-8859-1"))


def strip(text: Column) -> Column:
    """Without white space at either end, Unicode's included."""
    return F.btrim(text, F.lit(fv.WHITESPACE))


def suffix_of(path: Column) -> Column:
    """Lower-cased file suffix with its dot; '' when there is none or for a dot file."""
    base = F.substring_index(path, "/", -1)
    return F.lower(F.regexp_extract(base, r"(?s)^.+(\.[^.]+)$", 1))


def contains_any(text: Column, needles: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(n)) for n in needles])


def contains_all(text: Column, needles: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.contains(text, F.lit(n)) for n in needles])


def all_matches(text: Column, pattern: str, gate: Column | None = None, group: int = 0) -> Column:
    """Every match of a literal pattern; NULL without one.

    ``gate`` is a cheap necessary condition (a literal the pattern cannot match without):
    the regex engine then never sees most files.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    return found if gate is None else F.when(gate, found)


def has(matches: Column) -> Column:
    return F.coalesce(F.size(matches), F.lit(0)) > 0


def first_distinct(matches: Column, scanned: int, kept: int | None = None) -> Column:
    """Distinct values, in order, among the first ``scanned`` matches."""
    found = F.array_distinct(F.slice(matches, 1, scanned))
    return found if kept is None else F.slice(found, 1, kept)


def url_domain(url: Column) -> Column:
    """The authority of a URL: port, user info and case kept; '' when there is none.

    An authority with an unbalanced square bracket is no valid URL and gives ''.
    """
    authority = F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.\-]*://([^/?#]*)", 1)
    opened, closed = F.contains(authority, F.lit("[")), F.contains(authority, F.lit("]"))
    return F.when(opened != closed, F.lit("")).otherwise(authority)


def domain_allowed(domain: Column, allowed: tuple[str, ...]) -> Column:
    """Exact or dot-suffix match on the lower-cased domain; no domain passes."""
    passes = F.coalesce(domain, F.lit("")) == ""
    if not allowed:
        return passes
    listed = "|".join(re.escape(d) for d in allowed)
    return passes | F.lower(domain).rlike(rf"(?s)\A(?:.*\.)?(?:{listed})\z")


def off_list(domain: Column, allowed: tuple[str, ...]) -> Column:
    """True for a domain to report; with an empty allow list nothing is."""
    return ~domain_allowed(domain, allowed) if allowed else F.lit(False)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once.

    A lambda body is evaluated for every element, and with it every expression it
    captures. Binding a costly expression to a lambda variable first avoids that.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


# --- positions of matches ---------------------------------------------------------------


def match_steps(gaps: Column, matches: Column) -> Column:
    """One step per match: the text from the previous match's start to this one's.

    Only three numbers are kept of it: its length, its line breaks, and the length
    after the last of them.
    """


    def steps(pair: Column) -> Column:
        found, between = pair["found"], pair["between"]

        def step(match: Column, i: Column) -> Column:
            lead = F.when(i > 0, F.get(found, i - 1)).otherwise(F.lit(""))
            return _lead_in(F.concat(lead, F.get(between, i)), F.length(match))

        return F.transform(found, step)

    return let(F.struct(matches.alias("found"), gaps.alias("between")), steps)


def _lead_in(lead: Column, match_length: Column) -> Column:
    return let(
        lead,
        lambda text: F.struct(
            F.length(text).alias("chars"),
            (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))).alias("breaks"),
            F.length(F.substring_index(text, "\n", -1)).alias("tail"),
            match_length.alias("span"),
        ),
    )


def _advance(state: Column, step: Column) -> Column:
    offset = state["offset"] + step["chars"]
    return F.struct(
        offset.alias("offset"),
        (state["line"] + step["breaks"]).alias("line"),
        F.when(step["breaks"] > 0, offset - step["tail"]).otherwise(state["start"]).alias("start"),
    )


def _origin() -> Column:
    return F.struct(
        F.lit(0).alias("offset"), F.lit(1).alias("line"), F.lit(0).alias("start")
    )


_STATE = "struct<offset:int,line:int,start:int>"


def gaps_by_text(text: Column, matches: Column) -> Column:
    """The text before each of a few matches, found by looking for their texts in turn.

    Much cheaper than running a slow pattern once more, and the same for any pattern that
    depends on nothing around a match: an earlier place with the same text would have
    matched itself.
    """

    def find(state: Column, match: Column) -> Column:
        return let(
            F.call_function("locate", match, text, state["at"]),
            lambda found: F.struct(
                (found + F.length(match)).alias("at"),
                F.concat(
                    state["gaps"], F.array(F.substring(text, state["at"], found - state["at"]))
                ).alias("gaps"),
            ),
        )

    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<string>").alias("gaps"))
    return F.aggregate(matches, start, find, lambda state: state["gaps"])


def match_positions(steps: Column, chunk: int = CHUNK) -> Column:
    """array<struct<offset, line, column, span>> of the matches, in order.

    A running sum over the steps in two levels: the state at the head of every chunk,
    then the positions inside each chunk.
    """
    return let(steps, lambda found: F.when(F.size(found) > 0, _positions(found, chunk)))


def _positions(steps: Column, chunk: int) -> Column:
    chunks = F.transform(
        F.sequence(F.lit(0), F.size(steps) - 1, F.lit(chunk)),
        lambda at: F.slice(steps, at + 1, F.lit(chunk)),
    )
    heads = F.aggregate(
        chunks,
        F.struct(
            _origin().cast(_STATE).alias("state"),
            F.array().cast(f"array<{_STATE}>").alias("heads"),
        ),
        lambda acc, part: F.struct(
            F.aggregate(part, acc["state"], _advance).cast(_STATE).alias("state"),
            F.concat(acc["heads"], F.array(acc["state"])).alias("heads"),
        ),
        lambda acc: acc["heads"],
    )
    place = "struct<offset:int,line:int,column:int,span:int>"

    def inside(part: Column, head: Column) -> Column:
        return F.aggregate(
            part,
            F.struct(head.alias("state"), F.array().cast(f"array<{place}>").alias("out")),
            lambda acc, step: _placed(_advance(acc["state"], step), step, acc["out"], place),
            lambda acc: acc["out"],
        )

    return F.flatten(F.zip_with(chunks, heads, inside))


def _placed(state: Column, step: Column, out: Column, place: str) -> Column:
    here = F.struct(
        state["offset"].alias("offset"),
        state["line"].alias("line"),
        (state["offset"] - state["start"] + 1).alias("column"),
        step["span"].alias("span"),
    ).cast(place)
    return F.struct(state.cast(_STATE).alias("state"), F.concat(out, F.array(here)).alias("out"))


# --- snippets ---------------------------------------------------------------------------

SNIPPET_BEFORE, SNIPPET_AFTER, SNIPPET_MAX = 120, 60, 240


def _tidy_snippet(raw: Column) -> Column:
    """Without NULs and outer space, shortened; NULL when nothing is left."""

    def shortened(text: Column) -> Column:
        size = F.length(text)
        return F.when(
            size > SNIPPET_MAX, F.concat(F.left(text, F.lit(SNIPPET_MAX - 3)), F.lit("..."))
        ).when(size > 0, text)

    return let(strip(F.translate(raw, "\x00", "")), shortened)


def snippet_at(content: Column, offset: Column, span: Column) -> Column:
    """The text around a byte offset. Works on the binary column: a byte slice of binary
    is a copy of that slice, while a character slice of text walks from its start."""
    begin = F.greatest(offset - SNIPPET_BEFORE, F.lit(0))
    # A slice past the end of the content simply stops there.
    stop = offset + F.greatest(span, F.lit(SNIPPET_AFTER))
    piece = F.substring(content, begin + 1, stop - begin)
    return _tidy_snippet(clean_text(piece))


def text_snippet_at(text: Column, offset: Column, span: Column) -> Column:
    """As :func:`snippet_at`, by characters of decoded text."""
    begin = F.greatest(offset - SNIPPET_BEFORE, F.lit(0))
    stop = offset + F.greatest(span, F.lit(SNIPPET_AFTER))
    return _tidy_snippet(F.substring(text, begin + 1, stop - begin))


def location(place: Column, value: Column, snippet: Column) -> Column:
    return F.struct(
        place["line"].alias("line"),
        place["column"].alias("column"),
        snippet.alias("snippet"),
        F.when(value != "", value).alias("match"),
    )


def locations(content: Column, places: Column, values: Column) -> Column:
    """array<struct<line, column, snippet, match>> for places with their match texts."""
    return F.zip_with(
        places,
        values,
        lambda p, v: location(p, v, snippet_at(content, p["offset"], p["span"])),
    )


def first_locations(content: Column, text: Column, pattern: str, matches: Column, count: int = 5):
    """Locations of the first ``count`` matches of a pattern in byte text."""

    def of(head: Column) -> Column:
        places = match_positions(match_steps(F.split(text, pattern, count + 1), head))
        return locations(content, places, F.transform(head, utf8))

    return F.when(has(matches), let(F.slice(matches, 1, count), of))
