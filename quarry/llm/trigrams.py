"""Boolean trigram queries from regular expressions, and trigram indexes of text slices to answer them.

A query says which trigrams a text must have for the expression to match: ("tri", bytes),
("and", queries), ("or", queries) or ("all",) where no trigram is mandatory. ASCII letters are
folded to lower case on both sides, so a query may let a text pass that does not match, and
never the other way round.
"""

from __future__ import annotations

import itertools
from re import _constants as op
from re import _parser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

ALL = ("all",)
#: Different strings that are followed side by side; characters of a set that are spelled out.
STRINGS, CHARS = 64, 8


def _and(*queries):
    flat = [q for q in queries if q != ALL]
    flat = list(dict.fromkeys(itertools.chain.from_iterable(q[1] if q[0] == "and" else [q] for q in flat)))
    return ALL if not flat else flat[0] if len(flat) == 1 else ("and", tuple(flat))


def _or(*queries):
    if not queries or ALL in queries:
        return ALL
    flat = list(dict.fromkeys(queries))
    return flat[0] if len(flat) == 1 else ("or", tuple(flat))


def of_string(s: str):
    b = s.encode().lower()
    return _and(*(("tri", b[i:i + 3]) for i in range(len(b) - 2)))


def _of_strings(strings):
    return _or(*(of_string(s) for s in sorted(strings)))


def _set(items) -> set[str] | None:
    """The lower-case characters of a set, if they are few."""
    out: set[str] = set()
    for kind, arg in items:
        if kind is op.LITERAL:
            out.add(chr(arg).lower())
        elif kind is op.RANGE and arg[1] - arg[0] < 2 * CHARS:
            out |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return out if len(out) <= CHARS else None


def _walk(tree):
    """(strings or None, query): the strings a part stands for if they are few, and what else it demands."""
    runs, demands = {""}, []

    def cut(query=ALL):
        nonlocal runs
        demands.extend((_of_strings(runs), query))
        runs = {""}

    for kind, arg in tree:
        strings, query = None, ALL
        if kind is op.LITERAL:
            strings = {chr(arg).lower()}
        elif kind is op.IN:
            strings = _set(arg)
        elif kind is op.SUBPATTERN:
            strings, query = _walk(arg[-1])
        elif kind is op.BRANCH:
            parts = [_walk(p) for p in arg[1]]
            if all(s is not None for s, _ in parts):
                strings = set().union(*(s for s, _ in parts))
            else:
                query = _or(*(_and(q, ALL if s is None else _of_strings(s)) for s, q in parts))
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
            low, high, body = arg
            inner, query = _walk(body)
            if low == 0:
                strings, query = ({""} | inner, ALL) if inner is not None and high == 1 else (None, ALL)
            elif low == high == 1:
                strings = inner
            elif inner is not None:
                query = _and(query, _of_strings(inner))
        elif kind in (op.AT, op.ASSERT, op.ASSERT_NOT):
            continue  # takes no characters
        if strings is None or len(strings) > STRINGS or len(runs) * len(strings) > STRINGS:
            cut(query if strings is None else _of_strings(strings))
        else:
            demands.append(query)
            runs = {a + b for a in runs for b in strings}
    if not any(d != ALL for d in demands) and len(demands) == sum(1 for k, _ in tree if k not in (op.AT, op.ASSERT, op.ASSERT_NOT)):
        return runs, ALL
    return None, _and(*demands, _of_strings(runs))


def query_of(pattern: str):
    """The Boolean trigram query of a regular expression (Python syntax)."""
    strings, query = _walk(list(_parser.parse(pattern)))
    return query if strings is None else _and(query, _of_strings(strings))


def trigrams_of(query) -> set[bytes]:
    return {query[1]} if query[0] == "tri" else set() if query == ALL else set().union(*map(trigrams_of, query[1]))


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


class Index:
    """Inverted index of a slice of texts over the trigrams that some queries ask for."""

    def __init__(self, wanted: dict[bytes, int]):
        self.wanted = wanted
        self.table = np.zeros(1 << 24, dtype=np.uint16)
        for t, k in wanted.items():
            self.table[t[0] << 16 | t[1] << 8 | t[2]] = k + 1

    def build(self, texts: pa.Array) -> None:
        texts = pc.fill_null(texts, "")
        size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(size)
        b = _FOLD[np.frombuffer("".join(texts.to_pylist()).encode("utf-8", "surrogatepass"), dtype=np.uint8)].astype(np.uint32)
        self.n = len(texts)
        self.postings: dict[int, np.ndarray] = {}
        if len(b) < 3:
            return
        k = self.table[b[:-2] << 16 | b[1:-1] << 8 | b[2:]]
        at = np.flatnonzero(k)
        row = np.searchsorted(ends, at, "right")
        inside = at + 2 < ends[row]
        pair = np.unique((k[at[inside]].astype(np.int64) - 1) * self.n + row[inside])
        tri, row = pair // self.n, pair % self.n
        cuts = np.searchsorted(tri, np.arange(len(self.wanted) + 1))
        self.postings = {t: row[cuts[t]:cuts[t + 1]] for t in range(len(self.wanted))}

    def rows(self, query) -> np.ndarray:
        """The texts that a query lets pass, by intersecting and uniting postings."""
        none = np.zeros(0, dtype=np.int64)
        if query == ALL:
            return np.arange(self.n)
        if query[0] == "tri":
            return self.postings.get(self.wanted[query[1]], none)
        parts = [self.rows(q) for q in query[1]]
        if query[0] == "or":
            return np.unique(np.concatenate(parts))
        parts.sort(key=len)
        out = parts[0]
        for p in parts[1:]:
            if not len(out):
                break
            out = np.intersect1d(out, p, assume_unique=True)
        return out
