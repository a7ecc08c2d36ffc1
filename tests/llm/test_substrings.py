"""Repeated passages against brute force, at several window and shard sizes."""

import hashlib
import random
import re

import pytest

from pyspark.sql import functions as F

from quarry.llm import substrings


def slow(rows, window):
    """[(n_words, n_removed, sha256)] of (id, text) rows."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    first = {}
    for (d, _), w in zip(rows, words):
        for i in range(len(w) - window + 1):
            k = tuple(w[i:i + window])
            first[k] = min(first.get(k, d), d)
    out = []
    for (d, _), w in zip(rows, words):
        gone = {i + j for i in range(len(w) - window + 1) if first[tuple(w[i:i + window])] < d for j in range(window)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_matching_statistics():
    rnd = random.Random(5)
    for _ in range(200):
        known = [[rnd.randrange(3) for _ in range(rnd.randrange(1, 14))] for _ in range(rnd.randrange(1, 5))]
        auto = substrings.SuffixAutomaton()
        for k in known:
            auto.add(k)
        subs = {tuple(k[i:j]) for k in known for i in range(len(k)) for j in range(i, len(k) + 1)}
        text = [rnd.randrange(4) for _ in range(30)]
        want = [max(m for m in range(e + 2) if tuple(text[e + 1 - m:e + 1]) in subs | {()}) for e in range(30)]
        assert auto.match(text) == want


def corpus(seed, n=70):
    rnd = random.Random(seed)
    vocab = [f"w{i}é" for i in range(40)]
    passages = [[rnd.choice(vocab) for _ in range(rnd.randrange(5, 60))] for _ in range(6)]
    rows = []
    for d in range(n):
        w = []
        for _ in range(rnd.randrange(0, 5)):
            w += rnd.choice(passages) if rnd.random() < 0.6 else [rnd.choice(vocab) for _ in range(rnd.randrange(1, 30))]
        if rows and rnd.random() < 0.3:  # near copy
            w = (rnd.choice(rows)[1] or "").split()
            for _ in range(rnd.randrange(3)):
                if w:
                    w[rnd.randrange(len(w))] = "edit"
        rows.append((d, rnd.choice([" ", "\n", " \t "]).join(w)))
    rows += [(200, None), (201, ""), (202, " x " * 300), (203, "x " * 300), (204, "y")]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("window,gram,shard,seed", [(12, 3, 512, 1), (12, 3, 1, 2), (7, 7, 2, 3), (5, 1, 512, 4)])
def test_matches_brute_force(spark, window, gram, shard, seed):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in substrings.without_repeats(df, window=window, gram=gram, shard=shard, with_text=True).collect()}
    assert len(got) == len(rows)
    some = 0
    for (d, t), want in zip(rows, slow(rows, window)):
        g = got[d]
        assert (g.n_words, g.n_removed, g.kept_sha256) == want
        assert sum(s.stop - s.start for s in g.spans) == g.n_removed
        assert hashlib.sha256(g.kept.encode()).hexdigest() == g.kept_sha256
        some += g.n_removed
    assert some


def test_edge_rows(spark):
    text = " ".join(f"t{i}" for i in range(60))
    rows = [(4, text, "x"), (4, text, "x"), (4, "other " + text, "y"), (9, text, "x"), (None, text, None), (None, text, None), (None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, id string")
    got = sorted((r.doc_id or 99, r.n_words, r.n_removed) for r in substrings.without_repeats(df).collect())
    assert got == [(4, 60, 0), (4, 60, 0), (4, 61, 0), (9, 60, 60), (99, 0, 0), (99, 60, 60), (99, 60, 60)]
    assert substrings.without_repeats(df.limit(0)).count() == 0


def test_repeated_rows_share_their_cuts(spark):
    """Copies of one row, with and without an id, carry a document's cuts once each."""
    text = " ".join(f"w{k}" for k in range(400))
    rows = [(1, text)] + [(2, text)] * 200 + [(None, text + " more")] * 100
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = substrings.without_repeats(df)
    assert sorted({(r.doc_id or 0, r.n_removed) for r in got.collect()}) == [(0, 400), (1, 0), (2, 400)] and got.count() == 301
    ids = df.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("id"), "text")
    cuts = {r.id_: len(r.cuts) for r in substrings.covered(ids, substrings.WINDOW, substrings.GRAM, substrings.SHARD).collect()}
    once = {r.id_: len(r.cuts) for r in substrings.covered(ids.distinct(), substrings.WINDOW, substrings.GRAM, substrings.SHARD).collect()}
    assert cuts == once
