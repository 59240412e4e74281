"""Boolean trigram queries from regular expressions.

`required(pattern)` is a query over the ASCII-lower-cased text that every match satisfies: ANY, a trigram, or
("and" | "or", queries). Strings a node can match exactly are carried on while there are few of them, so that
trigrams across neighbouring nodes are found; where a node may match too much, the strings so far become
trigrams and the walk starts anew behind it.
"""

from __future__ import annotations

import re
from re import _constants as C, _parser as parser

import numpy as np

ANY = None
MOST_STRINGS = 32


def _all(parts: list) -> object:
    parts = list(dict.fromkeys(p for p in parts if p is not ANY))
    return ANY if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _some(parts: list) -> object:
    parts = list(dict.fromkeys(parts))
    return ANY if not parts or ANY in parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _of_strings(strings: set[bytes]) -> object:
    return _some([_all([s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _lower(code: int) -> bytes:
    return chr(code).encode().lower() if code < 128 else chr(code).encode()


def _class(items: list) -> set[bytes] | None:
    out: set[bytes] = set()
    for kind, value in items:
        if kind is C.LITERAL:
            out.add(_lower(value))
        elif kind is C.RANGE and value[1] - value[0] < MOST_STRINGS:
            out |= {_lower(c) for c in range(value[0], value[1] + 1)}
        else:
            return None
    return out if len(out) <= 8 else None


def _walk(nodes, fold: bool) -> tuple[set[bytes] | None, object]:
    """Strings the sequence matches exactly, if few, and the query of all else."""
    strings: set[bytes] | None = {b""}
    whole, needs = True, []

    def cut() -> None:
        nonlocal strings, whole
        needs.append(_of_strings(strings))
        strings, whole = {b""}, False

    for kind, value in nodes:
        if kind is C.LITERAL:
            exact, need = ({_lower(value)} if value < 128 or not fold else None), ANY
        elif kind is C.IN:
            exact, need = _class(value), ANY
        elif kind is C.SUBPATTERN:
            exact, need = _walk(value[-1], fold or bool(value[1] & re.I))
        elif kind is C.BRANCH:
            each = [_walk(b, fold) for b in value[1]]
            exact = set().union(*(e for e, _ in each)) if all(e is not None for e, _ in each) else None
            need = ANY if exact is not None else _some([n if e is None else _all([n, _of_strings(e)]) for e, n in each])
        elif kind in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            low, high, inner = value
            exact, need = _walk(inner, fold)
            if exact is not None and (low, high) == (0, 1):
                exact = exact | {b""}
            elif not (low == high == 1):
                if exact is not None and low == high and len(exact) == 1:
                    exact = {next(iter(exact)) * low}
                else:
                    need = _all([need, _of_strings(exact)] if exact is not None else [need]) if low else ANY
                    exact = None
        elif kind in (C.AT, C.ASSERT, C.ASSERT_NOT):
            continue
        else:
            exact, need = None, ANY
        if exact is None:
            cut()
            needs.append(need)
            continue
        joined = {a + b for a in strings for b in exact}
        if len(joined) > MOST_STRINGS:
            cut()
            joined = exact
        strings = joined
    if whole:
        return strings, ANY
    return None, _all([*needs, _of_strings(strings)])


def required(pattern: str) -> object:
    tree = parser.parse(pattern)
    exact, need = _walk(tree, bool(tree.state.flags & re.I))
    return need if exact is None else _of_strings(exact)


def trigrams(query: object) -> set[bytes]:
    if query is ANY:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*(trigrams(q) for q in query[1]))


class Index:
    """Postings of the wanted trigrams over the rows of one segment: sorted row numbers per trigram."""

    def __init__(self, wanted: list[bytes], lowered: np.ndarray, offsets: np.ndarray) -> None:
        self.rows = len(offsets) - 1
        self.postings = {t: np.zeros(0, np.int64) for t in wanted}
        if len(lowered) < 3 or not wanted:
            return
        number = {t[0] << 16 | t[1] << 8 | t[2]: k for k, t in enumerate(wanted)}
        first, pair = np.zeros(256, bool), np.zeros(1 << 16, bool)
        for code in number:
            first[code >> 16] = pair[code >> 8] = True
        at = np.flatnonzero(first[lowered[:-2]])
        codes = (lowered[at].astype(np.int32) << 8) | lowered[at + 1]
        hit = pair[codes]
        at, codes = at[hit], (codes[hit] << 8) | lowered[at[hit] + 2]
        known = np.array(sorted(number), np.int32)
        place = np.minimum(np.searchsorted(known, codes), len(known) - 1)
        hit = known[place] == codes
        at, codes = at[hit], codes[hit]
        row = np.searchsorted(offsets, at, "right") - 1
        inside = at + 3 <= offsets[row + 1]
        both = np.unique(np.searchsorted(known, codes[inside]).astype(np.int64) * self.rows + row[inside])
        for k, code in enumerate(known):
            low, high = np.searchsorted(both, (k * self.rows, (k + 1) * self.rows))
            self.postings[wanted[number[int(code)]]] = both[low:high] - k * self.rows

    def candidates(self, query: object) -> np.ndarray:
        """Rows that satisfy the query: intersections and unions of postings."""
        if query is ANY:
            return np.arange(self.rows)
        if isinstance(query, bytes):
            return self.postings[query]
        op, parts = query
        found = [self.candidates(q) for q in parts]
        if op == "or":
            return np.unique(np.concatenate(found))
        found.sort(key=len)
        out = found[0]
        for other in found[1:]:
            if not len(out):
                break
            out = np.intersect1d(out, other, assume_unique=True)
        return out
