"""Trigram queries derived from regular expressions, and an inverted index to answer them.

A query is a nested tuple: ("tri", "abc"), ("and", [queries]), ("or", [queries]), or ANY, which holds
for every text. It is a necessary condition: a text that matches the expression satisfies the query.
Trigrams are over UTF-8 bytes with A-Z lower-cased, so one index serves expressions of either case.
"""

from __future__ import annotations

import re
from re import _constants as op
from re import _parser

import numpy as np

ANY = ("any",)
MAX_STRINGS = 64  # alternatives written out before an expression counts as open
MAX_CLASS = 8


def _all_of(parts: list[tuple]) -> tuple:
    parts = list(dict.fromkeys(p for p in parts if p != ANY))
    return ANY if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _one_of(parts: list[tuple]) -> tuple:
    parts = list(dict.fromkeys(parts))
    return ANY if ANY in parts or not parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _of_strings(strings: set[str]) -> tuple:
    queries = []
    for s in sorted(strings):
        folded = s.encode().lower()
        queries.append(_all_of([("tri", folded[i : i + 3]) for i in range(len(folded) - 2)]))
    return _one_of(queries)


def _item(code, arg) -> tuple[set[str] | None, tuple]:
    """(every string the item can match, or None if too many; its query)."""
    if code is op.LITERAL:
        return {chr(arg)}, ANY
    if code is op.AT or code in (op.ASSERT, op.ASSERT_NOT):
        return {""}, ANY
    if code is op.IN:
        if len(arg) <= MAX_CLASS and all(c is op.LITERAL for c, _ in arg):
            return {chr(v) for _, v in arg}, ANY
        return None, ANY
    if code is op.SUBPATTERN:
        return _sequence(arg[-1])
    if code is op.BRANCH:
        found = [_sequence(branch) for branch in arg[1]]
        if all(s is not None for s, _ in found):
            strings = set().union(*(s for s, _ in found))
            if len(strings) <= MAX_STRINGS:
                return strings, ANY
        return None, _one_of([_all_of([q, _of_strings(s) if s is not None else ANY]) for s, q in found])
    if code in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
        least, most, inner = arg
        strings, query = _sequence(inner)
        if strings is not None and most == 1:
            return (strings | {""} if least == 0 else strings), ANY
        if least == 0:
            return None, ANY
        return None, _all_of([query, _of_strings(strings) if strings is not None else ANY])
    return None, ANY


def _sequence(items) -> tuple[set[str] | None, tuple]:
    run, parts, closed = {""}, [], True
    for code, arg in items:
        strings, query = _item(code, arg)
        parts.append(query)
        joined = {a + b for a in run for b in strings} if strings and len(run) * len(strings) <= MAX_STRINGS else None
        if joined is None:
            parts.append(_of_strings(run))
            closed, run = False, strings if strings and len(strings) <= MAX_STRINGS else {""}
        else:
            run = joined
    if closed:
        return run, _all_of(parts)
    return None, _all_of([*parts, _of_strings(run)])


def trigram_query(pattern: str, flags: int = 0) -> tuple:
    """The Boolean trigram query of an expression; ANY if it has no mandatory trigram."""
    strings, query = _sequence(_parser.parse(pattern, flags & ~re.IGNORECASE))
    return _all_of([query, _of_strings(strings)]) if strings is not None else query


def trigrams_in(query: tuple) -> set[bytes]:
    if query[0] == "tri":
        return {query[1]}
    return set().union(*(trigrams_in(q) for q in query[1])) if query[0] in ("and", "or") else set()


class Vocabulary:
    """The trigrams that some query mentions, as a lookup table from packed bytes to numbers from 1."""

    def __init__(self, trigrams: set[bytes]):
        self.numbers = {t: i + 1 for i, t in enumerate(sorted(trigrams))}
        self.table = np.zeros(1 << 24, np.uint16)
        for t, i in self.numbers.items():
            self.table[t[0] << 16 | t[1] << 8 | t[2]] = i


class SegmentIndex:
    """Postings of one segment of texts: for each vocabulary trigram the sorted numbers of texts with it."""

    def __init__(self, lowered: np.ndarray, offsets: np.ndarray, vocabulary: Vocabulary):
        self.size = len(offsets) - 1
        self.numbers = vocabulary.numbers
        wide = lowered.astype(np.uint32)
        number = vocabulary.table[wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:]] if len(wide) > 2 else wide[:0]
        at = np.flatnonzero(number)
        text = np.searchsorted(offsets, at, "right") - 1
        inside = at + 3 <= offsets[text + 1]
        pairs = np.unique(number[at[inside]].astype(np.int64) * self.size + text[inside])
        self.keys, self.texts = pairs // max(self.size, 1), pairs % max(self.size, 1)

    def postings(self, trigram: bytes) -> np.ndarray:
        k = self.numbers[trigram]
        return self.texts[np.searchsorted(self.keys, k) : np.searchsorted(self.keys, k, "right")]

    def candidates(self, query: tuple) -> np.ndarray:
        """Numbers of the texts that satisfy the query, by intersecting and uniting postings."""
        if query[0] == "any":
            return np.arange(self.size)
        if query[0] == "tri":
            return self.postings(query[1])
        lists = sorted((self.candidates(q) for q in query[1]), key=len)
        result = lists[0]
        for other in lists[1:]:
            result = (np.intersect1d if query[0] == "and" else np.union1d)(result, other)
        return result
