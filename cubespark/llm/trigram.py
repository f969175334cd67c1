"""Boolean trigram queries of regular expressions, and an inverted index of a block of texts."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np

try:
    from re import _constants as C
    from re import _parser as parser
except ImportError:  # Python 3.10
    import sre_constants as C
    import sre_parse as parser

#: Alternatives of a literal run that are spelled out before the run is closed.
MAX_EXACT = 64


@dataclass(frozen=True)
class Query:
    """ANY (matches all), AND or OR over trigrams and sub-queries."""

    op: str
    grams: frozenset = frozenset()
    subs: tuple = ()

    def grams_used(self) -> set[bytes]:
        return set(self.grams).union(*(s.grams_used() for s in self.subs)) if self.subs else set(self.grams)


ANY = Query("any")


def both(a: Query, b: Query) -> Query:
    if a.op == "any" or b.op == "any":
        return b if a.op == "any" else a
    grams = frozenset().union(*(q.grams for q in (a, b) if q.op == "and"))
    subs = tuple(s for q in (a, b) for s in (q.subs if q.op == "and" else (q,)))
    return Query("and", grams, subs)


def either(parts: list[Query]) -> Query:
    if any(p.op == "any" for p in parts):
        return ANY
    return parts[0] if len(parts) == 1 else Query("or", frozenset(), tuple(parts))


def of_strings(strings: set[bytes]) -> Query:
    """Texts that hold one of the strings hold all trigrams of that one."""
    return either([Query("and", frozenset(s[i : i + 3] for i in range(len(s) - 2))) if len(s) >= 3 else ANY for s in sorted(strings)])


def _charset(items) -> set[str] | None:
    found: set[str] = set()
    for op, value in items:
        if op is C.LITERAL:
            found.add(chr(value))
        elif op is C.RANGE and value[1] - value[0] < 16:
            found |= {chr(c) for c in range(value[0], value[1] + 1)}
        else:
            return None
        if len(found) > 16:
            return None
    return found


def derive(pattern: str) -> Query:
    """A query that every text with a match of the pattern satisfies; letters are folded to lower case."""

    def fold(c: str) -> bytes:
        return c.lower().encode()

    def walk(items) -> Query:
        query, exact = ANY, {b""}

        def close():
            nonlocal query, exact
            query, exact = both(query, of_strings(exact)), {b""}

        def extend(options: set[bytes] | None):
            nonlocal exact
            if options is None:
                close()
            elif len(exact) * len(options) > MAX_EXACT:
                close()
                exact = set(options) if len(options) <= MAX_EXACT else {b""}
            else:
                exact = {a + b for a in exact for b in options}

        for op, value in items:
            if op is C.LITERAL:
                extend({fold(chr(value))})
            elif op is C.IN:
                chars = _charset(value)
                extend(None if chars is None else {fold(c) for c in chars})
            elif op is C.SUBPATTERN:
                if (options := strings(value[3])) is not None:
                    extend(options)
                else:
                    close()
                    query = both(query, walk(value[3]))
            elif op is C.BRANCH:
                if (options := branch_strings(value[1])) is not None:
                    extend(options)
                else:
                    close()
                    query = both(query, either([walk(b) for b in value[1]]))
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
                low, high, body = value
                options = strings(body)
                if options is not None and (low, high) == (0, 1):
                    extend(options | {b""})
                elif options is not None and low and len(options) ** low <= MAX_EXACT and low <= 16:
                    for _ in range(low):
                        extend(options)
                    if high != low:
                        close()
                else:
                    close()
                    if low:
                        query = both(query, walk(body))
            elif op is C.AT:
                continue
            elif op in (C.ASSERT, C.ASSERT_NOT):
                continue
            else:
                close()
        close()
        return query

    def branch_strings(branches) -> set[bytes] | None:
        found = [strings(b) for b in branches]
        if any(x is None for x in found):
            return None
        total = set().union(*found)
        return total if len(total) <= MAX_EXACT else None

    def strings(items) -> set[bytes] | None:
        """All strings of a finite small language, else None."""
        out = {b""}
        for op, value in items:
            if op is C.LITERAL:
                more = {fold(chr(value))}
            elif op is C.IN:
                chars = _charset(value)
                more = None if chars is None else {fold(c) for c in chars}
            elif op is C.SUBPATTERN:
                more = strings(value[3])
            elif op is C.BRANCH:
                more = branch_strings(value[1])
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and tuple(value[:2]) == (0, 1):
                more = strings(value[2])
                more = None if more is None else more | {b""}
            else:
                more = None
            if more is None or len(out) * len(more) > MAX_EXACT:
                return None
            out = {a + b for a in out for b in more}
        return out

    return walk(parser.parse(pattern, re.ASCII))


class Vocabulary:
    """The trigrams that some rule's query mentions, as slots of a table over all 2^24 byte trigrams."""

    def __init__(self, queries: list[Query]):
        self.grams = sorted(set().union(*(q.grams_used() for q in queries)) if queries else set())
        self.slot = {g: i for i, g in enumerate(self.grams)}
        self._table = None

    def table(self) -> np.ndarray:
        if self._table is None:
            self._table = np.zeros(1 << 24, np.uint16)
            for g, i in self.slot.items():
                self._table[g[0] << 16 | g[1] << 8 | g[2]] = i + 1
        return self._table

    def __getstate__(self):
        return {"grams": self.grams, "slot": self.slot, "_table": None}


def postings(vocabulary: Vocabulary, texts: list[bytes]) -> list[np.ndarray]:
    """For each trigram of the vocabulary, the sorted numbers of the texts that hold it."""
    joined = np.frombuffer(b"\0\0".join(t.lower() for t in texts) + b"\0\0", np.uint8)
    ends = np.cumsum([len(t) + 2 for t in texts])
    codes = joined[:-2].astype(np.uint32)
    codes <<= 8
    codes |= joined[1:-1]
    codes <<= 8
    codes |= joined[2:]
    slots = vocabulary.table()[codes]
    at = np.flatnonzero(slots)
    doc = np.searchsorted(ends, at, side="right")
    key = np.unique(slots[at].astype(np.int64) * (len(texts) + 1) + doc)
    slot, doc = np.divmod(key, len(texts) + 1)
    bounds = np.searchsorted(slot, np.arange(1, len(vocabulary.grams) + 2))
    return [doc[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def candidates(query: Query, vocabulary: Vocabulary, lists: list[np.ndarray], n: int) -> np.ndarray:
    """Numbers of the texts that satisfy the query: postings intersected for AND, united for OR."""
    if query.op == "any":
        return np.arange(n)
    if query.op == "or":
        return np.unique(np.concatenate([candidates(s, vocabulary, lists, n) for s in query.subs]))
    parts = sorted([lists[vocabulary.slot[g]] for g in query.grams], key=len) + [candidates(s, vocabulary, lists, n) for s in query.subs]
    out = parts[0]
    for p in parts[1:]:
        if not len(out):
            break
        out = np.intersect1d(out, p, assume_unique=True)
    return out
