"""Toxicity of texts after noisy-channel deobfuscation.

A character language model (trigrams over a folded alphabet, counted over all texts) and a
channel of leetspeak, spacing and repetition span a lattice over every stretch of text that
the channel could have changed; Viterbi's algorithm picks the likeliest original. Elsewhere
the lattice is a single path, the text itself. A logistic model on the restored words and
their beginnings, trained on labelled rows, scores the restored text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.slices import giving_back
from quarry.llm.common import codepoints, documents, held_out, lower_letters, materialize, prepare, table, text_slices

# Letters that a symbol may stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "+": "t", "|": "il"}
#: Log probabilities of the channel: a symbol for a letter, a symbol as itself, a separator put
#: between letters, a separator that was there, a run of three or more letters from one or from two,
#: an exclamation mark as itself where no letter or digit follows in the stretch.
AS_LETTER, AS_SYMBOL, PUT_IN, WAS_THERE, FROM_ONE, FROM_TWO, ENDING = -1.0, -4.0, -0.7, -2.5, -0.5, -1.5, -0.5
SEPARATORS = " .-_*"
#: Stretches that the channel could have changed (lower case): a symbol beside a letter, a run of
#: one letter, single letters, digits or symbols with one separator between any two. What else
#: stands beside a spaced stretch (quotes, brackets, the end of a sentence) is no part of it.
SUSPECT = re.compile(
    r"(?P<leet>[0134578@$!+|][^\W\d_]|[^\W\d_][0134578@$!+|])"
    r"|(?P<run>([^\W\d_])\3\3)"
    r"|(?P<spaced>(?<![^\W_])(?:[^\W_]|[@$!+|])(?:[ .\-_*](?:[^\W_]|[@$!+|])){2,}(?![^\W_]))")
SPACE = re.compile(r"\s")
WORDS = re.compile(r"[^\W\d_]+")
#: Labelled rows of each class that the classifier is fitted on, beginnings of words.
SAMPLE, PREFIXES = 6000, (4, 5)
THRESHOLD = 0.7
#: Restored stretches that a worker remembers.
REMEMBER = 200_000


# ---------------------------------------------------------------- character language model
def fold(low: np.ndarray) -> np.ndarray:
    """Lower-case letters (0: none) to 64 symbols: 0 boundary, a-z, 37 classes of other letters."""
    latin = (low >= 97) & (low <= 122)
    return np.where(low == 0, 0, np.where(latin, low - 96, 27 + low % 37)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(64 ** 3, dtype=np.int64)
    for batch in batches:
        texts = batch.column(0)
        for a, b in text_slices(texts):
            cps, bounds = codepoints(texts[a:b])
            # a boundary before every text and one at the end; runs of boundaries count once
            s = np.insert(fold(lower_letters(cps)), bounds, 0)
            s = s[np.r_[True, (s[1:] != 0) | (s[:-1] != 0)]] if len(s) else s
            if len(s) > 1:
                s = np.r_[0, s]
                total += np.bincount(s[:-2] << 12 | s[1:-1] << 6 | s[2:], minlength=64 ** 3)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["gram", "n"])


def char_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Log probabilities [a, b, c] of symbol c after a, b, from all texts. At most 64 ** 3 sums
    come to the driver, whatever the input."""
    found = docs.select(text_col).mapInArrow(giving_back(_count), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(64 ** 3)
    for r in found:
        n[r.gram] = r.n
    tri = n.reshape(64, 64, 64)
    bi, uni = tri.sum(axis=0), tri.sum(axis=(0, 1))
    p1 = (uni + 0.5) / (uni.sum() + 32)
    p2 = (bi + 8 * p1) / (bi.sum(axis=1, keepdims=True) + 8)
    p3 = (tri + 8 * p2[None]) / (tri.sum(axis=2, keepdims=True) + 8)
    return np.log(p3).astype(np.float32)


# ---------------------------------------------------------------- Viterbi over the lattice
def _edges(s: str, spaced: bool) -> list[list[tuple[int, str, float]]]:
    """Per position: (next position, what it stands for, log probability of the channel)."""
    out: list[list[tuple[int, str, float]]] = [[] for _ in s]
    end = len(s)
    while end and not s[end - 1].isalnum():
        end -= 1
    i = 0
    while i < len(s):
        c = s[i]
        j = i + 1
        if c.isalpha():
            while j < len(s) and s[j] == c:
                j += 1
            if j - i >= 3:
                out[i] = [(j, c, FROM_ONE), (j, c + c, FROM_TWO)]
                i = j
                continue
            out[i] = [(i + 1, c, 0.0)]
        elif spaced and c in SEPARATORS:
            out[i] = [(i + 1, "", PUT_IN), (i + 1, c, WAS_THERE)]
        else:
            out[i] = [(i + 1, c, ENDING if c == "!" and i >= end else AS_SYMBOL if c in LEET else 0.0), *((i + 1, x, AS_LETTER) for x in LEET.get(c, ""))]
        i += 1
    return out


def _symbol(c: str) -> int:
    return 0 if not c.isalpha() else ord(c) - 96 if "a" <= c <= "z" else 27 + ord(c) % 37


def viterbi(s: str, log_p: list, spaced: bool = False) -> str:
    """The likeliest original of ``s``. A state is the last two symbols. ``log_p``: nested lists or an array."""
    edges = _edges(s, spaced)
    front: list[dict] = [{} for _ in range(len(s) + 1)]
    front[0][(0, 0)] = (0.0, None)
    for i, here in enumerate(front[:-1]):
        for state, (score, _) in here.items():
            for j, emit, channel in edges[i]:
                a, b = state
                total = score + channel
                for c in emit:
                    x = _symbol(c)
                    if x or b:  # one boundary follows another for nothing
                        total += log_p[a][b][x]
                        a, b = b, x
                if total > front[j].get((a, b), (-math.inf,))[0]:
                    front[j][(a, b)] = (total, (i, state, emit))
    # a boundary follows
    state = max(front[-1], key=lambda st: front[-1][st][0] + (log_p[st[0]][st[1]][0] if st[1] else 0.0))
    at, out = len(s), []
    while at:
        at, state, emit = front[at][state][1]
        out.append(emit)
    return "".join(reversed(out))


def restore(text: str | None, log_p, memory: dict) -> str:
    """``text`` in lower case with every suspect stretch decoded."""
    low = (text or "").lower()
    out, done, m = [], 0, SUSPECT.search(low)
    while m:
        a, b = m.span()
        spaced = m.lastgroup == "spaced" or m.group("spaced") is not None
        if not spaced:  # the whole token
            while a > done and not low[a - 1].isspace():
                a -= 1
            end = SPACE.search(low, b)
            b = end.start() if end else len(low)
        piece = low[a:b]
        if spaced and not WORDS.search(piece):
            good = piece
        else:
            good = memory.get((piece, spaced))
            if good is None:
                if len(memory) >= REMEMBER:
                    memory.clear()
                good = memory[(piece, spaced)] = viterbi(piece, log_p, spaced)
        out += (low[done:a], good)
        done, m = b, SUSPECT.search(low, b)
    out.append(low[done:])
    return "".join(out)


def restored(text: Column, log_p: np.ndarray) -> Column:
    """The restored text as a column."""
    held = log_p.tolist()

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        memory: dict = {}
        for texts in batches:
            for a, b in text_slices(texts):
                yield pa.array([None if t is None else restore(t, held, memory) for t in texts[a:b].to_pylist()], pa.string())

    return F.arrow_udf(giving_back(run), "string").asNondeterministic()(text)


# ---------------------------------------------------------------- classifier
def _features(words: set[str]) -> list[str]:
    return sorted({"w" + w for w in words} | {f"{k}{w[:k]}" for w in words for k in PREFIXES if len(w) > k})


def _fit(rows: list[np.ndarray], y: np.ndarray, size: int, l2: float = 1e-4, rounds: int = 400) -> np.ndarray:
    """Weights and intercept of a logistic model on presence features, both classes with equal
    weight, by Adam on all rows (L2 on the weights alone)."""
    at = np.concatenate(rows) if rows else np.zeros(0, dtype=np.int64)
    of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum()))
    w, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    for k in range(1, rounds + 1):
        z = w[-1] + np.bincount(of, w[at], minlength=len(rows))
        e = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        g = np.append(np.bincount(at, e[of], minlength=size), e.sum()) + l2 * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - 0.1 * (m / (1 - 0.9 ** k)) / (np.sqrt(v / (1 - 0.99 ** k)) + 1e-8)
    return w


def train(docs: DataFrame, labels: DataFrame, allowed: Column, log_p: np.ndarray, sample: int = SAMPLE) -> tuple[dict, float]:
    """({feature: weight}, intercept) from at most ``sample`` labelled rows of each class (the
    smallest hashes of their ids); ``allowed`` selects the label rows to learn from. Features are
    all those that toxic rows of the sample have over three times as often, in four rows at least;
    the sample bounds them.

    Of the rows that repeat an id the one with the smallest hash of its text is learnt from.
    Without rows of both classes there are no weights, and the intercept is that of the share."""
    ok = labels.where(allowed & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ok = materialize(ok.where("doc_id IS NOT NULL"))
    n = {r.toxic: r["count"] for r in ok.groupBy("toxic").count().collect()}
    if len(n) < 2:
        return {}, math.log((n.get(1, 0) + 1e-3) / (n.get(0, 0) + 1))
    pick = [ok.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for c in (0, 1)]
    chosen = materialize(pick[0].union(pick[1]))
    held = log_p.tolist()

    def run(batches):
        memory: dict = {}
        for b in batches:
            for a, z in text_slices(b.column(0)):
                found = [_features(set(WORDS.findall(restore(t, held, memory)))) for t in b.column(0)[a:z].to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(1)[a:z], pa.array(found, pa.list_(pa.string()))], ["y", "f"])

    rows = (docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", F.col("toxic").alias("y"))
            .agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("text", "y").mapInArrow(giving_back(run), "y int, f array<string>"))
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()))
    size = {c: min(n[c], sample) for c in n}
    p, q = F.sum("y") / size[1], F.sum(1 - F.col("y")) / size[0]
    counted = rows.select("y", F.explode("f").alias("f")).groupBy("f").agg(p.alias("p"), q.alias("q"), F.count("*").alias("n")).where("n >= 4 AND p > 3 * q")
    names = sorted(r.f for r in counted.select("f").collect())
    where = F.broadcast(docs.sparkSession.createDataFrame(list(enumerate(names)), "k int, name string"))
    hits = rows.select("row", F.explode("f").alias("f")).join(where, F.col("f") == F.col("name")).groupBy("row").agg(F.sort_array(F.collect_list("k")).alias("k"))
    data = rows.select("row", "y").join(hits, "row", "left").orderBy("row").toPandas()
    xs = [np.asarray(k if k is not None else [], dtype=np.int64) for k in data["k"]]
    y = data["y"].to_numpy(dtype=float)
    w = _fit(xs, y, len(names))
    return {f: float(x) for f, x in zip(names, w) if abs(x) > 1e-9}, float(w[-1])


def toxicity(text: Column, log_p: np.ndarray, model: tuple[dict, float]) -> Column:
    """Score (0 to 1) of the restored text; a null or empty text has that of no words."""
    weights, intercept = model
    held = log_p.tolist()
    kinds = {k: {f[1:]: w for f, w in weights.items() if f[0] == k} for k in ("w", *map(str, PREFIXES))}

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        memory: dict = {}
        sets = {k: (pa.array(list(d), pa.string()), np.append(list(d.values()), 0.0)) for k, d in kinds.items()}
        for texts in batches:
            z = np.full(len(texts), intercept)
            for a, b in text_slices(texts):
                found = [WORDS.findall(restore(t, held, memory)) for t in texts[a:b].to_pylist()]
                row = np.repeat(np.arange(a, b), [len(f) for f in found])
                enc = pa.array([w for f in found for w in f], pa.string()).dictionary_encode()
                code, words = enc.indices.to_numpy(), enc.dictionary
                for k, (known, w) in sets.items():
                    if not len(known) or not len(words):
                        continue
                    key = words if k == "w" else pc.if_else(pc.greater(pc.utf8_length(words), int(k)), pc.utf8_slice_codeunits(words, 0, int(k)), None)
                    at = pc.fill_null(pc.index_in(key, known, skip_nulls=True), len(known)).to_numpy()
                    hit = at[code]
                    some = hit < len(known)
                    pair = np.unique(row[some] * (len(known) + 1) + hit[some])
                    np.add.at(z, pair // (len(known) + 1), w[pair % (len(known) + 1)])
            yield pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))))

    return F.arrow_udf(giving_back(run), "double").asNondeterministic()(text)


def _learn(spark: SparkSession, docs: DataFrame, sf_dir: str) -> tuple[np.ndarray, tuple[dict, float]]:
    log_p = char_model(docs)
    return log_p, train(docs, table(spark, sf_dir, "labels"), ~held_out("doc_id", 3, 1), log_p)


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; columns as they are."""
    names = [f"`{c}`" for c in docs.columns]
    log_p, model = _learn(spark, docs, sf_dir)
    row = docs.select(F.struct(*[F.col(c) for c in names]).alias("_row"), F.col("text").alias("_text"))
    return row.withColumn("_score", toxicity(F.col("_text"), log_p, model)).where(F.col("_score") < threshold).select("_row.*")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    prepare(spark)
    docs = documents(spark, sf_dir).select("doc_id", "text")
    log_p, model = _learn(spark, docs, sf_dir)
    out = docs.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), toxicity(F.col("text"), log_p, model).alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


QUERIES = {"op4_toxicity": op4_toxicity}
