"""Literals of which every match of a pattern holds one, derived from the pattern itself.

A text without any of them can't match, so an automaton over them may pick the
texts that are searched by the patterns, and no case is lost by it.
"""

from __future__ import annotations

import sys
from re import _constants as C
from re import _parser

# Alternatives of a pattern's part from which on the part is cut.
MOST = 3000
# Words too common to pick texts by, where a pattern has another part (for speed only).
COMMON = frozenset(("please", "enable"))


def _begin(op, av) -> tuple[set[str], bool]:
    """Strings (lower case) with one of which every match of a part begins; whether they are whole matches."""
    if op is C.LITERAL:
        return {chr(av).lower()}, True
    if op in (C.AT, C.ASSERT_NOT):
        return {""}, True
    if op is C.ASSERT:
        return (_starts(av[1])[0], False) if av[0] == 1 else ({""}, True)
    if op is C.SUBPATTERN:
        return _starts(av[-1])
    if op is C.BRANCH:
        parts = [_starts(p) for p in av[1]]
        return set().union(*(s for s, _ in parts)), all(w for _, w in parts)
    if op is C.IN:
        out = set()
        for kind, v in av:
            if kind is C.LITERAL:
                out.add(chr(v).lower())
            elif kind is C.RANGE:
                out |= {chr(c).lower() for c in range(v[0], v[1] + 1)}
            elif kind is C.CATEGORY and v is C.CATEGORY_DIGIT:
                out |= set("0123456789")
            else:
                return {""}, False
        return out, True
    if op in (C.MAX_REPEAT, C.MIN_REPEAT):
        least, most, p = av
        if (least, most) == (0, 1):
            s, whole = _starts(p)
            return s | {""}, whole
        s, whole = _starts(list(p) * least)
        return s, whole and least == most
    return {""}, False


def _starts(parts) -> tuple[set[str], bool]:
    now = {""}
    for op, av in parts:
        s, whole = _begin(op, av)
        if len(now) * len(s) > MOST:
            return now, False
        now = {a + b for a in now for b in s}
        if not whole:
            return now, False
    return now, True


def _rank(s: set[str]) -> tuple[bool, int, int]:
    return (not s & COMMON, min(map(len, s)), -len(s)) if all(s) and s else (False, 0, 0)


def _needed(parts) -> set[str]:
    found, now = [], {""}
    for op, av in parts:
        s, whole = _begin(op, av)
        if len(now) * len(s) > MOST:
            found.append(now)
            now = {""}
        now = {a + b for a in now for b in s}
        if not whole:
            found.append(now)
            now = {""}
            if op is C.SUBPATTERN:
                found.append(_needed(av[-1]))
            elif op is C.BRANCH:
                each = [_needed(p) for p in av[1]]
                found.append(set().union(*each) if all(each) else set())
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and av[0]:
                found.append(_needed(av[2]))
    best = max([*found, now], key=_rank)
    return best if all(best) else set()


def needed(pattern: str, flags: int = 0) -> set[str]:
    """Literals of which the lower case of every text with a match holds one, or one of unusual().

    A pattern that has none is refused.
    """
    found = _needed(_parser.parse(pattern, flags))
    if not found:
        raise ValueError(f"no literal is in every match of {pattern}")
    return found


def unusual() -> list[str]:
    """What patterns take for ASCII letters and digits though its lower case is another character."""
    return ["ı", "ſ", "i̇", *(c for c in map(chr, range(128, sys.maxunicode + 1)) if c.isdecimal())]


class Prefilter:
    """Tells which patterns may match in a text, and whether `least` of the words (lower case letters) may stand in it as words, with endings of up to two letters."""

    def __init__(self, patterns: list[tuple[str, int]], words: list[str], least: int) -> None:
        import ahocorasick

        self.least, self.all = least, frozenset(range(len(patterns)))
        which: dict[str, set[int]] = {}
        for i, (p, flags) in enumerate(patterns):
            for t in needed(p, flags):
                which.setdefault(t, set()).add(i)
        self.automaton = ahocorasick.Automaton()
        for t in (*which, *words):
            self.automaton.add_word(t, (len(t) if t in words else 0, frozenset(which.get(t, ()))))
        for t in unusual():
            self.automaton.add_word(t, (0, self.all))
        self.automaton.make_automaton()

    def may(self, text: str) -> bool:
        """Whether the text may hold a match or the words."""
        low, seen = text.lower(), 0
        for end, (n, some) in self.automaton.iter(low):
            if some or n and self._whole(low, end, n) and (seen := seen + 1) == self.least:
                return True
        return False

    def suspects(self, text: str) -> tuple[frozenset[int], bool]:
        """Places of the patterns that may match, and whether the words may be there."""
        low, seen, found = text.lower(), 0, frozenset()
        for end, (n, some) in self.automaton.iter(low):
            if not some <= found:
                found |= some
            if n and self._whole(low, end, n):
                seen += 1
        return found, seen >= self.least or found == self.all

    @staticmethod
    def _whole(low: str, end: int, n: int) -> bool:
        """Whether a word starts there and goes on for at most two letters."""
        return (end < n or not low[end - n].isalpha()) and not (len(rest := low[end + 1 : end + 4]) == 3 and rest.isalpha())
