"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

A text holds an item if a stretch of it is within the edit budget of the whole item, or of one
of its pieces of 128 characters (a copy of a part). Pieces start every 16 characters. For the
whole, items are also cut into disjoint tiles of about equal length: one of them has no more
than its share of the edits, and where a tile is found the whole item is aligned.

A stretch of text within e edits of a piece of m characters shares at least
m - q + 1 - q * e of its q-grams, and all of them on diagonals (text position minus
piece position) that lie at most e apart. So the shared q-grams are counted in overlapping
bands of diagonals, bands that reach the bound are kept, and an alignment inside the band
tells whether the edit budget holds. The filter loses nothing; the alignment decides.

Case and runs of white space don't count. The benchmark goes to the tasks in blocks of
bounded size; documents are read once per block and never shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.slices import giving_back
from quarry.llm.common import codepoints, documents, lower_letters, prepare, table, text_slices

Q = 8
#: Characters of a piece and from one piece of an item to the next; edits over characters.
PIECE, STRIDE, BUDGET = 128, 16, 0.1
#: Diagonals from one band to the next (a band has twice as many); at least a piece's edits.
BAND = 16
#: Characters of benchmark text in one broadcast block.
BLOCK_CHARS = 4 << 20
#: Cells of text that are aligned at once.
CELLS = 1 << 17
#: Bits of the table that passes over most q-grams that no piece has.
SIEVE = 22
MIX = np.uint64(0x9E3779B97F4A7C15)
HIT = "array<struct<item_id:bigint,start:bigint,stop:bigint,edits:int>>"


def normal(cps: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded text, the place of each kept character, and the new bounds of the rows."""
    low = lower_letters(cps)
    low = np.where(low == 0, cps, low)
    space = (cps == 32) | ((cps >= 9) & (cps <= 13)) | (cps == 0xA0)
    low[space] = 32
    keep = ~space
    keep[1:] |= ~space[:-1]
    first = bounds[:-1][bounds[:-1] < bounds[1:]]
    keep[first] = ~space[first]  # none at the start of a text
    at = np.flatnonzero(keep)
    return low[at].astype(np.uint64), at, np.searchsorted(at, bounds)


def q_grams(s: np.ndarray) -> np.ndarray:
    """Hash of every q-gram, by doubling (q is a power of two)."""
    h, b, n = s, 1000003, 1
    while n < Q:
        if len(h) <= n:
            return np.zeros(0, dtype=np.uint64)
        h = h[:-n] * np.uint64(b) + h[n:]
        b, n = b * b % (1 << 64), 2 * n
    return h * MIX


class Pieces:
    """The items of a block, the index of their q-grams, and their pieces: overlapping ones for
    copies of a part, then the tiles of longer items, which are seeds for the whole item."""

    def __init__(self, items: list[tuple[int, str]], piece: int = PIECE, stride: int = STRIDE, budget: float = BUDGET):
        texts, self.item = [], []
        for item, text in items:
            cps, bounds = codepoints(pa.array([text], pa.string()))
            s = normal(cps, bounds)[0]
            s = s[:-1] if len(s) and s[-1] == 32 else s
            if len(s) < Q:
                continue  # shorter than one q-gram: no evidence of anything
            texts.append(s)
            self.item.append(item)
        self.size = np.array([len(t) for t in texts], dtype=np.int64)
        self.most = (self.size * budget).astype(np.int64)
        self.off = np.cumsum(self.size) - self.size
        self.text = np.concatenate(texts) if texts else np.zeros(0, dtype=np.uint64)
        parts, tiles = [], []  # (item, start, length), in order
        for k, m in enumerate(self.size.tolist()):
            last = max(0, m - piece)
            parts += [(k, a, min(m, piece)) for a in [*range(0, last, stride), last]]
            if last:
                # one of the tiles has no more than its share of the item's edits
                n = -(-m // piece)
                cuts = [m * x // n for x in range(n + 1)]
                tiles += [(k, a, z - a) for a, z in zip(cuts, cuts[1:])]
        self.parts = len(parts)
        self.of, self.start, self.length = np.array(parts + tiles, dtype=np.int64).reshape(-1, 3).T
        self.edits = np.minimum(np.minimum((self.length * budget).astype(np.int64), (self.length - Q) // Q), BAND)
        self.bound = self.length - Q + 1 - Q * self.edits
        self.least = np.full(len(texts), np.iinfo(np.int64).max)
        np.minimum.at(self.least, self.of, self.bound)
        grams = [q_grams(t) for t in texts]
        h = np.concatenate(grams) if grams else np.zeros(0, dtype=np.uint64)
        order = np.argsort(h, kind="stable")
        self.hash, self.at, self.n = np.unique(h[order], return_index=True, return_counts=True)
        self.owner = np.repeat(np.arange(len(texts)), [len(g) for g in grams])[order]
        self.pos = np.concatenate([np.arange(len(g)) for g in grams])[order] if grams else np.zeros(0, dtype=np.int64)
        # the parts and the tiles that hold a q-gram stand side by side
        place, begin = self.off[self.owner] + self.pos, self.off[self.of] + self.start
        self.held = []
        for lo, hi in ((0, self.parts), (self.parts, len(self.of))):
            x = np.searchsorted((begin + self.length)[lo:hi], place + Q)
            y = np.searchsorted(begin[lo:hi], place, "right")
            self.held.append(((lo + x).astype(np.int32), np.maximum(y - x, 0).astype(np.int32)))
        self.sieve = np.zeros(1 << SIEVE, dtype=bool)
        self.sieve[(h >> np.uint64(64 - SIEVE)).astype(np.int64)] = True

    def bands(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(piece, first diagonal) of every band that reaches its piece's bound; diagonals are
        text position minus position in the item."""
        h = q_grams(s)
        at = np.flatnonzero(self.sieve[(h >> np.uint64(64 - SIEVE)).astype(np.int64)])
        x = np.minimum(np.searchsorted(self.hash, h[at]), len(self.hash) - 1)
        ok = self.hash[x] == h[at]
        at, x = at[ok], x[ok]
        lo, n = self.at[x], self.n[x]
        entry = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        shift = (int(self.size.max(initial=0)) // BAND + 2) * BAND
        span = (len(s) + shift) // BAND + 3
        key = self.owner[entry] * span + (np.repeat(at, n) - self.pos[entry] + shift) // BAND  # band never below 1
        # a piece's q-grams in a band are no more than its item's
        seen, count = np.unique(key, return_counts=True)
        after = np.r_[seen[1:] == seen[:-1] + 1, False][:len(seen)]
        both = count + np.where(after, np.r_[count[1:], 0][:len(seen)], 0)
        before = np.r_[False, after[:-1]][:len(seen)]
        down = count + np.where(before, np.r_[0, count[:-1]][:len(seen)], 0)
        least = self.least[seen // span]
        found = []
        for good, less in ((seen[both >= least], 0), (seen[down >= least], 1)):
            if len(good):
                ok = good[np.minimum(np.searchsorted(good, key), len(good) - 1)] == key
                e, band = entry[ok], key[ok] % span - less
                for first, n in self.held:
                    m = n[e]
                    found.append((np.repeat(first[e] - np.cumsum(m) + m, m) + np.arange(m.sum())) * span + np.repeat(band, m))
        key, count = np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *found]), return_counts=True)
        piece = key // span
        ok = count >= self.bound[piece]
        return piece[ok], (key[ok] % span) * BAND - shift

    def align(self, s: np.ndarray, start: np.ndarray, length: np.ndarray, first: np.ndarray, width: int = 2 * BAND,
              lo: np.ndarray | int = 0, hi: np.ndarray | int | None = None, back: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Least edits of each stretch of ``text`` within a band of ``width`` diagonals from ``first``
        on, and where the best alignment ends (``back``: starts). Only s[lo:hi] is looked at."""
        n, rows = len(start), max(1, CELLS // (int(length.max(initial=0)) + width))
        hi = len(s) if hi is None else hi
        lo, hi = np.broadcast_to(lo, n), np.broadcast_to(hi, n)
        done = [self._align(s, *(x[a:a + rows] for x in (start, length, first, lo, hi)), width, back) for a in range(0, n, rows)]
        zero = np.zeros(0, dtype=np.int64)
        return np.concatenate([zero, *(e for e, _ in done)]), np.concatenate([zero, *(x for _, x in done)])

    def _align(self, s, start, length, first, lo, hi, width, back):
        most, least = int(length.max()), int(length.min())
        kind = np.int16 if most < 1 << 14 else np.int32
        d = np.zeros((len(start), width), dtype=kind)
        k = np.arange(width, dtype=kind)
        # all that a band can see, once; back: both texts from their ends, so diagonals turn round
        j = (first + length - 1 + width - 1)[:, None] - np.arange(most + width) if back else first[:, None] + np.arange(most + width)
        ok = (j >= lo[:, None]) & (j < hi[:, None])
        seen = np.where(ok, s[np.where(ok, j, 0)], np.uint64(1 << 33))
        i = np.minimum(np.arange(most), length[:, None] - 1)
        p = self.text[start[:, None] + (length[:, None] - 1 - i if back else i)]
        for i in range(most):
            e = d + (seen[:, i:i + width] != p[:, i, None])
            e[:, :-1] = np.minimum(e[:, :-1], d[:, 1:] + 1)
            e = np.minimum.accumulate(e - k, axis=1) + k
            d = e if i < least else np.where((i < length)[:, None], e, d)
        best = d.argmin(axis=1)
        edits = d[np.arange(len(start)), best]
        return edits, first + width - 1 - best if back else first + length + best

    def whole(self, s: np.ndarray, k: int, first: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Least edits of item ``k`` in s[lo:hi] where it passes a band from ``first`` on, start and stop.
        Whoever passes the band within the budget is nowhere further from it than the budget."""
        e = int(self.most[k])
        start, length = np.full(len(first), self.off[k]), np.full(len(first), self.size[k])
        edits, stop = self.align(s, start, length, first - e, 2 * (BAND + e), lo, hi)
        ok = np.flatnonzero(edits <= e)
        begin = np.zeros(len(first), dtype=np.int64)
        begin[ok] = self.align(s, start[ok], length[ok], first[ok] - e, 2 * (BAND + e), lo[ok], hi[ok], back=True)[1]
        return edits, np.maximum(begin, lo), np.minimum(stop, hi)


def find(texts: pa.Array, pieces: Pieces) -> list[list[dict]]:
    """For every text its items: places (code points, end exclusive) and least edits of a piece,
    or of the whole item where no piece holds its own budget."""
    out: list[list[dict]] = [[] for _ in range(len(texts))]
    if not len(pieces.hash):
        return out
    for a, b in text_slices(texts):
        cps, bounds = codepoints(texts[a:b])
        s, at, bounds = normal(cps, bounds)
        # texts stand apart by a character that no text has, so that nothing runs across
        gap = np.uint64(1 << 32)
        joined = np.insert(s, bounds[1:], gap)
        starts = bounds[:-1] + np.arange(b - a)
        piece, band = pieces.bands(joined)
        # in every text that the band touches and that is long enough
        first, length = band + pieces.start[piece], pieces.length[piece]
        r0 = np.searchsorted(starts, np.clip(first, 0, None), "right") - 1
        n = np.searchsorted(starts, first + length + 2 * BAND, "left") - r0
        row = np.repeat(r0 - np.cumsum(n) + n, n) + np.arange(n.sum())
        piece, band = np.repeat(piece, n), np.repeat(band, n)
        size = np.diff(bounds)
        ok = size[row] >= pieces.length[piece] - pieces.edits[piece]
        row, piece, band = row[ok], piece[ok], band[ok]
        begin, length, first = pieces.off[pieces.of[piece]] + pieces.start[piece], pieces.length[piece], band + pieces.start[piece]
        lo, hi = starts[row], starts[row] + size[row]
        edits, stop = pieces.align(joined, begin, length, first, lo=lo, hi=hi)
        ok = edits <= pieces.edits[piece]
        seed = np.flatnonzero(ok & (piece >= pieces.parts))
        ok = np.flatnonzero(ok & (piece < pieces.parts))
        _, start = pieces.align(joined, begin[ok], length[ok], first[ok], lo=lo[ok], hi=hi[ok], back=True)
        start, stop = np.maximum(start, lo[ok]), np.minimum(stop, hi)[ok]
        base = np.cumsum(np.r_[0, [0 if x is None else len(x) for x in texts[a:b].to_pylist()]])
        found: dict = {}

        def add(k: int, r: int, x: int, y: int, e: int) -> None:
            # back to places in the text as it came
            lo, hi = int(at[min(max(x - r, 0), len(at) - 1)] - base[r]), int(at[min(max(y - r - 1, 0), len(at) - 1)] - base[r]) + 1
            was = found.get((r, k), (lo, hi, e))
            found[r, k] = (min(lo, was[0]), max(hi, was[1]), min(e, was[2]))

        for hit in zip(pieces.of[piece[ok]].tolist(), row[ok].tolist(), start.tolist(), stop.tolist(), edits[ok].tolist()):
            add(*hit)
        # items of which a tile is there
        near: dict = {}
        for k, r, x in zip(pieces.of[piece[seed]].tolist(), row[seed].tolist(), band[seed].tolist()):
            if (r, k) not in found and size[r] >= pieces.size[k] - pieces.most[k]:
                near.setdefault(k, set()).add((r, x))
        for k, places in near.items():
            r, x = np.array(sorted(places), dtype=np.int64).T
            e, start, stop = pieces.whole(joined, k, x, starts[r], starts[r] + size[r])
            for hit in zip(r.tolist(), start.tolist(), stop.tolist(), e.tolist()):
                if hit[3] <= pieces.most[k]:
                    add(k, *hit)
        merged: dict = {}  # an id may stand for several items
        for (r, k), (lo, hi, e) in found.items():
            was = merged.get((r, pieces.item[k]), (lo, hi, e))
            merged[r, pieces.item[k]] = (min(lo, was[0]), max(hi, was[1]), min(e, was[2]))
        for (r, item), (lo, hi, e) in sorted(merged.items(), key=lambda kv: (kv[0][0], -1 if kv[0][1] is None else kv[0][1])):
            out[a + r].append({"item_id": item, "start": lo, "stop": hi, "edits": e})
    return out


def blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[Pieces]:
    """The items, in blocks of about ``block_chars`` characters; null texts are left out."""
    items = benchmark.select(F.col("item_id").cast("long"), "text").where("text IS NOT NULL")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / block_chars))
    for k in range(n):
        yield Pieces([tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()])


def leaks(text: Column, pieces: Pieces, spark: SparkSession) -> Column:
    """Items of one block in the text: array of (item_id, start, stop, edits)."""
    held = spark.sparkContext.broadcast(pieces)
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("edits", pa.int32())]))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for a, b in text_slices(texts):
                yield pa.array(find(texts[a:b], held.value), kind)

    return F.arrow_udf(giving_back(run), HIT).asNondeterministic()(text)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document and item found in it: doc_id, item_id, start, stop, edits.

    Null and empty texts have none; a null id is carried. Repeated rows and items that repeat
    give repeated rows. Items shorter than one q-gram are not looked for. Other columns are not read."""
    out = None
    for pieces in blocks(benchmark, block_chars):
        part = docs.select(F.col(id_col).alias("doc_id"), leaks(F.col(text_col), pieces, docs.sparkSession).alias("hits"))
        part = part.select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.*")
        out = part if out is None else out.union(part)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` without the rows that hold an item; columns as they are."""
    names = [f"`{c}`" for c in docs.columns]
    row = docs.select(F.struct(*[F.col(c) for c in names]).alias("_row"), F.col(text_col).alias("_text"))
    for pieces in blocks(benchmark, block_chars):
        row = row.withColumn("_hits", leaks(F.col("_text"), pieces, docs.sparkSession)).where(F.size("_hits") == 0)
    return row.select("_row.*")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return contamination(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


QUERIES = {"op9_decontamination": op9_decontamination}
