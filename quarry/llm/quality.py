"""Quality rules: base counts of every text and a calibrated logistic model on hashed n-grams.

Features are shares: of each word and word pair among a text's words, of each character and
character triple among its characters, hashed into one table. The model is fitted on a bounded
sample of labelled rows, calibrated on rows of the sample that the fit did not see (Platt), and
scored in Arrow batches: a text's logit is a sum of mean weights, so no vectors are built.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import codepoints, documents, materialize, prepare, table, text_slices
from quarry.llm.hashing import mix, span_hashes, word_bounds

BITS = 16
#: Labelled rows of each class that the model is fitted and calibrated on (one in CALIBRATE for the latter).
SAMPLE, CALIBRATE = 2000, 4
#: Shares are multiplied by this before the fit.
SCALE = 20.0
#: Fixed thresholds: probability of good quality; words at least; repeated words in 100 at most.
KEEP, LEAST_WORDS, MOST_REPEATS = 0.5, 50, 50
# Characters that count as symbols.
SYMBOLS = "#*$%&|<>"


def _family(h: np.ndarray, no: int) -> np.ndarray:
    return (mix(h + np.uint64(no)) >> np.uint64(64 - BITS)).astype(np.int64)


class Slice:
    """Words, n-gram buckets and base counts of a slice of texts."""

    def __init__(self, texts: pa.Array):
        self.n = len(texts)
        self.cps, self.bounds = codepoints(texts)
        self.start, self.stop, self.row = word_bounds(self.cps, self.bounds)
        self.word = span_hashes(self.cps, self.start, self.stop)

    def per_row(self, row: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(row, weights, minlength=self.n)

    def counts(self) -> dict[str, np.ndarray]:
        n_words = self.per_row(self.row)
        at = np.flatnonzero(np.isin(self.cps, np.array([ord(c) for c in SYMBOLS], dtype=np.uint32)))
        out = {"n_words": n_words, "word_chars": self.per_row(self.row, self.stop - self.start),
               "n_symbols": self.per_row(np.searchsorted(self.bounds, at, "right") - 1)}
        # lines with a word: every one after the first of its kind in the text
        a, b, row = word_bounds(self.cps, self.bounds, self.cps == 10)
        words = np.searchsorted(self.start, b) > np.searchsorted(self.start, a)
        out["n_dup_lines"] = self._repeats(span_hashes(self.cps, a[words], b[words]), row[words])[1]
        # words of three-word windows that the text has more than once
        w, r = self.word, self.row
        hit = np.zeros(len(w), dtype=bool)
        if len(w) > 2:
            same = r[2:] == r[:-2]
            h = mix(mix(mix(w[:-2]) + w[1:-1]) + w[2:])
            many = np.zeros(len(h), dtype=bool)
            many[same] = self._repeats(h[same], r[:-2][same])[0]
            hit[:-2] |= many
            hit[1:-1] |= many
            hit[2:] |= many
        out["n_repeat_words"] = self.per_row(r[hit])
        return {k: v.astype(np.int64) for k, v in out.items()}

    def _repeats(self, h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which entries their row has more than once; how many of each row are not the first of their kind."""
        key = mix(h + mix(row.astype(np.uint64)))
        order = np.argsort(key, kind="stable")
        k = key[order]
        new = np.ones(len(k), dtype=bool)
        new[1:] = k[1:] != k[:-1]
        run = np.cumsum(new) - 1
        many = np.zeros(len(k), dtype=bool)
        many[order] = (np.bincount(run, minlength=1) > 1)[run]
        return many, self.per_row(row[order][~new])

    def buckets(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row, bucket) of every n-gram, one family after the other."""
        yield self.row, _family(self.word, 1)
        same = self.row[1:] == self.row[:-1]
        yield self.row[1:][same], _family((self.word[:-1] * np.uint64(31) + self.word[1:])[same], 2)
        row = np.repeat(np.arange(self.n), np.diff(self.bounds))
        c = self.cps.astype(np.uint64)
        yield row, _family(c, 3)
        same = row[2:] == row[:-2]
        yield row[2:][same], _family((c[:-2] << np.uint64(42) | c[1:-1] << np.uint64(21) | c[2:])[same], 4)

    def logits(self, weights: np.ndarray) -> np.ndarray:
        z = np.zeros(self.n)
        for row, bucket in self.buckets():
            n = self.per_row(row)
            z += SCALE * self.per_row(row, weights[bucket]) / np.maximum(n, 1)
        return z

    def features(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """(buckets, values) of every text."""
        keys, values = [], []
        for row, bucket in self.buckets():
            n = self.per_row(row)
            key, count = np.unique(row << BITS | bucket, return_counts=True)
            keys.append(key)
            values.append(SCALE * count / n[key >> BITS])
        key, back = np.unique(np.concatenate(keys), return_inverse=True)
        value = np.bincount(back, np.concatenate(values), minlength=len(key))
        cut = np.searchsorted(key >> BITS, np.arange(self.n + 1))
        return [((key[a:b] & ((1 << BITS) - 1)).astype(np.int32), value[a:b].astype(np.float32)) for a, b in zip(cut[:-1], cut[1:])]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _fit(at: np.ndarray, value: np.ndarray, of: np.ndarray, y: np.ndarray, l2: float = 1e-5, rounds: int = 150) -> np.ndarray:
    """Weights and intercept, by Adam on all rows; both classes weigh the same."""
    size = 1 << BITS
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum()))
    w, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    for k in range(1, rounds + 1):
        z = w[-1] + np.bincount(of, w[at] * value, minlength=len(y))
        e = share * (_sigmoid(z) - y)
        g = np.append(np.bincount(at, e[of] * value, minlength=size) + l2 * w[:-1], e.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.03 * (m / (1 - 0.9 ** k)) / (np.sqrt(v / (1 - 0.99 ** k)) + 1e-8)
    return w


def _platt(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """a, b with P(good) = sigmoid(a z + b), on targets smoothed towards the middle, by Newton's steps."""
    pos, neg = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = _sigmoid(a * z + b)
        e, h = weight * (p - t), weight * p * (1 - p) + 1e-9
        g = np.array([(e * z).sum() + 1e-6 * a, e.sum()])
        hess = np.array([[(h * z * z).sum() + 1e-6, (h * z).sum()], [(h * z).sum(), h.sum()]])
        step = np.linalg.solve(hess, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return (float(a), float(b)) if a > 0 and math.isfinite(a + b) else (1.0, 0.0)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for s, e in text_slices(b.column(0)):
            f = Slice(b.column(0)[s:e]).features()
            yield pa.RecordBatch.from_arrays([b.column(1)[s:e], b.column(2)[s:e], pa.array([x for x, _ in f], pa.list_(pa.int32())),
                                              pa.array([x for _, x in f], pa.list_(pa.float32()))], ["doc_id", "y", "at", "value"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float] | None:
    """(weights, intercept) with calibration folded in, from at most ``sample`` labelled rows of
    each class (the smallest hashes of their ids); None unless there are rows of both classes.
    Of a document's several labels the smaller holds; labels other than 0 and 1 are left out. Of the
    rows that repeat an id the one with the smallest hash of its text is learnt from."""
    ok = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("y"))
    ok = materialize(ok)
    n = {r.y: r["count"] for r in ok.groupBy("y").count().collect()}
    if len(n) < 2:
        return None
    pick = [ok.where(F.col("y") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for c in (0, 1)]
    chosen = materialize(pick[0].union(pick[1]))
    rows = (docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y")
            .agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("text", "doc_id", "y")
            .mapInArrow(_features, "doc_id long, y int, at array<int>, value array<float>").toArrow())
    rows = rows.take(pc.sort_indices(rows["doc_id"])).combine_chunks()
    y = rows["y"].to_numpy().astype(float)
    if len(set(y)) < 2:
        return None
    size = pc.list_value_length(rows["at"]).to_numpy()
    all_at, all_value = (pc.list_flatten(rows[c]).to_numpy() for c in ("at", "value"))
    later = (mix(rows["doc_id"].to_numpy().view(np.uint64)) % np.uint64(CALIBRATE)) == 0

    def flat(mask):
        some = np.repeat(mask, size)
        return all_at[some], all_value[some], np.repeat(np.arange(mask.sum()), size[mask])

    fit = ~later if len(set(y[~later])) == 2 and len(set(y[later])) == 2 else np.ones(len(y), dtype=bool)
    w = _fit(*flat(fit), y[fit])
    rest = later if (~fit).any() else fit
    at, value, of = flat(rest)
    z = w[-1] + np.bincount(of, w[at] * value, minlength=int(rest.sum()))
    # the sample has both classes alike; the rows' weights bring back their true shares
    share = np.where(y[rest] > 0, n[1] / max(1, (y > 0).sum()), n[0] / max(1, (y <= 0).sum()))
    a, b = _platt(z, y[rest], share)
    return a * w[:-1], a * w[-1] + b


KIND = {"n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "score": "double"}


def measures(text: Column, model: tuple[np.ndarray, float] | None) -> Column:
    """struct of the base counts and ``score``, the probability of good quality (null without a model)."""
    fields = [pa.field(k, pa.float64() if t == "double" else pa.int64()) for k, t in KIND.items()]

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = []
            for a, b in text_slices(texts):
                s = Slice(texts[a:b])
                got = s.counts()
                got["score"] = _sigmoid(s.logits(model[0]) + model[1]) if model else [None] * s.n
                parts.append(pa.StructArray.from_arrays([pa.array(got[f.name], f.type) for f in fields], fields=fields))
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.struct(fields))

    return F.arrow_udf(run, ", ".join(f"{k} {t}" for k, t in KIND.items())).asNondeterministic()(text)


def judge(docs: DataFrame, model: tuple[np.ndarray, float] | None, id_col: str = "doc_id", text_col: str = "text", keep: float = KEEP) -> DataFrame:
    """One row per document: doc_id, the counts, base_failed, score, kept.

    Null and empty texts have counts of zero and fail the base rules; without a model the base
    rules alone decide. Null ids and repeated rows are carried; other columns are not read."""
    m = docs.select(F.col(id_col).alias("doc_id"), measures(F.col(text_col), model).alias("m")).select("doc_id", "m.*")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATS * F.col("n_words"))
    m = m.withColumn("base_failed", failed)
    return m.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("score") >= keep, F.lit(True)))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return judge(docs, train(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op7_quality": op7_quality}
