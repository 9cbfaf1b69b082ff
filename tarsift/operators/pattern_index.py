"""An index over many patterns: which of them can occur in a text at all.

Of every pattern one literal fragment is taken that each of its matches holds (the longest that
its regular expression names, lower-cased). A posting list leads from four bytes of the fragment
to the fragment, from there to the patterns. A text meets the index once: its four-byte windows
are looked up in one array operation, the fragments behind the windows that are known are looked
for, and the patterns of those that occur are candidates. What a candidate really matches is
decided by its regular expression afterwards. The cost of a text hardly depends on the number of
patterns, and the plan of a query not at all, since candidates are data.

Patterns without a fragment of three bytes are candidates for every text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from re import _parser as grammar

import numpy as np

from tarsift.session import ship_with_tasks

GRAM = 4
SHORTEST = 3
#: Bits of the filter that most windows of a text do not pass.
FILTER_BITS = 20
#: Bytes of a text whose windows are looked up together.
PIECE = 1 << 22
OTHERWISE_READ = re.compile(r"\\0|\[[^\]]*\[|&&")


def fragment(pattern: str) -> bytes:
    """The longest run of characters that every match of the pattern holds, lower-cased; empty
    if none is known. The pattern is over byte text, one character for each byte. What this
    grammar and the matching engine's read differently (octal escapes, sets in sets) has none."""
    if OTHERWISE_READ.search(pattern):
        return b""
    try:
        parsed = grammar.parse(pattern, re.DOTALL)
    except (re.error, OverflowError, RecursionError):
        return b""
    best = run = b""
    for piece in _runs(parsed):
        run = run + piece if piece is not None else b""
        best = max(best, run, key=len)
    return best


def _runs(parsed: Iterable) -> Iterable[bytes | None]:
    """Characters in order; None where anything else may stand."""
    for kind, value in parsed:
        name = str(kind)
        if name == "LITERAL":
            yield chr(value).encode("latin-1").lower() if value < 256 else None
        elif name == "SUBPATTERN":
            yield from _runs(value[3])
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] >= 1:
            yield from _runs(value[2])
            if value[1] != 1:
                yield None
        elif name in ("AT", "ASSERT", "ASSERT_NOT"):
            continue
        else:
            yield None


class PatternIndex:
    """Candidates among patterns, by number. Holds arrays and byte strings only."""

    def __init__(self, patterns: list[str]):
        by_fragment: dict[bytes, list[int]] = {}
        for k, pattern in enumerate(patterns):
            by_fragment.setdefault(fragment(pattern), []).append(k)
        self.always = sorted(k for f, ks in by_fragment.items() if len(f) < SHORTEST for k in ks)
        self.short = [(f, ks) for f, ks in sorted(by_fragment.items()) if SHORTEST <= len(f) < GRAM]
        long = [(f, ks) for f, ks in sorted(by_fragment.items()) if len(f) >= GRAM]
        # Of a fragment's windows the one that fewest fragments have is its key.
        grams = [self.grams(np.frombuffer(f, np.uint8)) for f, _ in long]
        values, counts = np.unique(np.concatenate(grams) if grams else np.zeros(0, np.uint32), return_counts=True)
        keys = [g[np.argmin(counts[np.searchsorted(values, g)])] for g in grams]
        order = np.argsort(keys, kind="stable") if keys else np.zeros(0, np.int64)
        self.fragments = [long[k] for k in order]
        self.keys, self.starts = np.unique(np.array(keys, np.uint32)[order], return_index=True)
        self.starts = np.append(self.starts, len(order))
        self.known = np.zeros(1 << FILTER_BITS, bool)
        self.known[self.slot(self.keys)] = True

    @staticmethod
    def grams(text: np.ndarray) -> np.ndarray:
        a = text.astype(np.uint32)
        return a[:-3] | (a[1:-2] << 8) | (a[2:-1] << 16) | (a[3:] << 24) if len(a) >= GRAM else np.zeros(0, np.uint32)

    @staticmethod
    def slot(grams: np.ndarray) -> np.ndarray:
        return (grams * np.uint32(2654435761)) >> np.uint32(32 - FILTER_BITS)

    def candidates(self, text: bytes) -> list[int]:
        """The numbers of all patterns that may match somewhere in the text, in order."""
        low = text.lower()
        found = list(self.always)
        for piece, patterns in self.short:
            if piece in low:
                found += patterns
        for at in range(0, len(low), PIECE):
            grams = self.grams(np.frombuffer(low, np.uint8)[at : at + PIECE + GRAM - 1])
            grams = grams[self.known[self.slot(grams)]]
            if len(grams):
                for k in np.flatnonzero(np.isin(self.keys, grams)):
                    for piece, patterns in self.fragments[self.starts[k] : self.starts[k + 1]]:
                        if piece in low:
                            found += patterns
        return sorted(set(found))


ship_with_tasks(__name__)
