"""Language identification by rank-order profiles (out-of-place distance).

A profile lists a language's most frequent letter n-grams (orders 1 to 3, words padded with a
boundary) by rank. A document's own most frequent n-grams are compared to every profile: each
n-gram costs the distance of its two ranks, or the profile's length if the profile lacks it.
N-gram counts of documents are made with numpy in Arrow batches; profiles are sums over all
rows learnt from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import codepoints, documents, held_out, lower_letters, prepare, text_slices

#: N-grams of a profile and of a document that count.
TOP = 300
#: Bits of a symbol: 0 padding, 1 boundary, letters below 3,072 as they are, others in as many classes as are left.
BITS, PLAIN = 15, 3072
#: Sharpness of the score: weight of a language is exp(-SHARP * distance), distance from 0 to 1.
SHARP = 20.0
#: Different (language, n-gram) counts that a task holds before it passes them on.
HOLD = 1 << 20
NONE = "und"


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, n-gram, count), sorted by row and n-gram."""
    cps, bounds = codepoints(texts)
    low = lower_letters(cps).astype(np.int64)
    s = np.where(low == 0, 1, np.where(low < PLAIN, low, PLAIN + low % ((1 << BITS) - PLAIN)))
    row = np.repeat(np.arange(len(texts)), np.diff(bounds))
    # a boundary after and before every text; runs of boundaries count once
    at = np.concatenate([bounds[1:], bounds[:-1]])
    rows = np.concatenate([np.arange(len(texts))] * 2)
    s, row = np.insert(s, at, 1), np.insert(row, at, rows)
    keep = np.ones(len(s), dtype=bool)
    keep[1:] = (s[1:] != 1) | (s[:-1] != 1) | (row[1:] != row[:-1])
    s, row = s[keep], row[keep]
    base = row << (3 * BITS)
    word = s != 1
    one = (base | s)[word]
    two = (base[1:] | s[:-1] << BITS | s[1:])[(row[1:] == row[:-1]) & (word[1:] | word[:-1])]
    three = (base[2:] | s[:-2] << 2 * BITS | s[1:-1] << BITS | s[2:])[(row[2:] == row[:-2]) & word[1:-1]]
    key = np.concatenate([one, two, three])
    key.sort()
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, dtype=np.int64)
    count = np.diff(np.r_[first, len(key)])
    key = key[first]
    return key >> (3 * BITS), key & ((1 << 3 * BITS) - 1), count


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    names: dict[str, int] = {}
    size = 0

    def merged():
        lang, gram, n = (np.concatenate([h[k] for h in held]) for k in range(3))
        key, back = np.unique(lang << (3 * BITS) | gram, return_inverse=True)
        return key >> (3 * BITS), key & ((1 << 3 * BITS) - 1), np.bincount(back, n, minlength=len(key)).astype(np.int64)

    def out(lang, gram, n):
        known = np.array(list(names), dtype=object)
        return pa.RecordBatch.from_arrays([pa.array(known[lang], pa.string()), pa.array(gram), pa.array(n)], ["lang", "gram", "n"])

    for b in batches:
        for a, e in text_slices(b.column(0)):
            row, gram, n = grams(b.column(0)[a:e])
            of = np.array([names.setdefault(x, len(names)) for x in b.column(1)[a:e].to_pylist()], dtype=np.int64)
            held.append((of[row], gram, n))
            size += len(gram)
            if size > 4 * HOLD:
                held = [merged()]
                size = len(held[0][0])
                if size > HOLD:
                    yield out(*held.pop())
                    size = 0
    if held:
        yield out(*merged())


def profiles(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", top: int = TOP) -> dict[str, np.ndarray]:
    """{language: its ``top`` most frequent n-grams by rank}; ties by n-gram. Rows with a null
    language teach nothing. Languages times ``top`` rows come to the driver."""
    counts = (docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l"))
              .mapInArrow(_sums, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram"))
    best = counts.withColumn("rank", rank).where(F.col("rank") <= top).collect()
    out: dict[str, np.ndarray] = {}
    for lang in sorted({r.lang for r in best}):
        out[lang] = np.array([r.gram for r in sorted((r for r in best if r.lang == lang), key=lambda r: r.rank)], dtype=np.int64)
    return out


class Ranks:
    """All profiles as one table: n-gram by language, ``top`` where a profile lacks it."""

    def __init__(self, found: dict[str, np.ndarray], top: int = TOP):
        self.langs, self.top = list(found), top
        self.grams = np.unique(np.concatenate([*found.values(), np.zeros(0, dtype=np.int64)]))
        self.ranks = np.full((len(self.grams) + 1, len(found)), -1, dtype=np.int64)
        for k, g in enumerate(found.values()):
            self.ranks[np.searchsorted(self.grams, g), k] = np.arange(len(g))

    def distances(self, texts: pa.Array) -> np.ndarray:
        """Out-of-place distance of every text to every language, as a share of the greatest; NaN without a letter."""
        row, gram, n = grams(texts)
        order = np.argsort(row << 32 | ((1 << 32) - 1 - n), kind="stable")  # ties by n-gram
        row, gram = row[order], gram[order]
        begin = np.searchsorted(row, np.arange(len(texts)))
        place = np.arange(len(row)) - begin[row]
        ok = place < self.top
        row, gram, place = row[ok], gram[ok], place[ok]
        out = np.full((len(texts), len(self.langs)), np.nan)
        if not len(row) or not self.langs:
            return out
        at = np.minimum(np.searchsorted(self.grams, gram), max(0, len(self.grams) - 1))
        r = self.ranks[np.where(self.grams[at] == gram, at, len(self.grams))]
        cost = np.where(r < 0, self.top, np.abs(r - place[:, None]))
        rows, first = np.unique(row, return_index=True)
        size = np.diff(np.r_[first, len(row)])
        out[rows] = np.add.reduceat(cost, first, axis=0) / (size * self.top)[:, None]
        return out


KIND = pa.struct([("lang", pa.string()), ("score", pa.float64())])


def language(text: Column, ranks: Ranks) -> Column:
    """struct(lang, score): the nearest profile (ties: first by name) and its share of the
    weights; ``und`` and 0 for a null text, one without a letter, or without any profile."""
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            lang, score = [NONE] * len(texts), np.zeros(len(texts))
            for a, b in text_slices(texts):
                d = ranks.distances(texts[a:b])
                if not d.size:
                    continue
                for k in np.flatnonzero(~np.isnan(d[:, 0])):
                    best = int(d[k].argmin())
                    lang[a + k] = ranks.langs[best]
                    score[a + k] = 1 / np.exp(-SHARP * (d[k] - d[k, best])).sum()
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score)], fields=list(KIND))

    return F.arrow_udf(run, "lang string, score double").asNondeterministic()(text)


def identify(docs: DataFrame, learn_from: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", top: int = TOP) -> DataFrame:
    """One row per document: doc_id, lang_pred, score. ``learn_from`` selects the rows whose
    language is learnt. Null ids and repeated rows are carried; an empty table gives no rows."""
    ranks = Ranks(profiles(docs.where(learn_from), lang_col, text_col, top), top)
    out = docs.select(F.col(id_col).alias("doc_id"), language(F.col(text_col), ranks).alias("l"))
    return out.select("doc_id", F.col("l.lang").alias("lang_pred"), F.col("l.score").alias("score"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    out = identify(documents(spark, sf_dir), ~held_out("doc_id", 4, 2))
    return out.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")


QUERIES = {"op5_language": op5_language}
