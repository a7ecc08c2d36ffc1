"""Restoration against an exhaustive search, and accuracy on held-out rows."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import toxicity
from quarry.llm.common import documents, table
from tests.conftest import SF_ORACLE


@pytest.fixture(scope="module")
def log_p(spark):
    return toxicity.char_model(documents(spark, SF_ORACLE)).tolist()


def total(path, log_p):
    """Log probability of a path through the lattice: channel and characters, a boundary behind."""
    a = b = 0
    out = 0.0
    for emit, channel in path:
        out += channel
        for c in emit:
            x = toxicity._symbol(c)
            if x or b:
                out += log_p[a][b][x]
                a, b = b, x
    return out + (log_p[a][b][0] if b else 0.0)


@pytest.mark.parametrize("s,spaced", [("m0r0n", False), ("1d1ot", False), ("s t u p", True), ("looooser", False), ("a5$", False), ("i.d-i o", True), ("4", False)])
def test_viterbi_finds_the_best_path(log_p, s, spaced):
    edges = toxicity._edges(s, spaced)

    def paths(i):
        if i == len(s):
            yield []
            return
        for j, emit, channel in edges[i]:
            for rest in paths(j):
                yield [(emit, channel), *rest]

    best = max(paths(0), key=lambda p: total(p, log_p))
    got = toxicity.viterbi(s, log_p, spaced)
    want = "".join(e for e, _ in best)
    same = [p for p in paths(0) if "".join(e for e, _ in p) == got]
    assert got == want or max(total(p, log_p) for p in same) == pytest.approx(total(best, log_p))


@pytest.mark.parametrize("noisy,clean", [
    ("you are a stup1d m0r0n", "you are a stupid moron"), ("s t u p i d", "stupid"), ("stuuuupid loooser", "stupid loser"), ("$cum", "scum"),
    ("plain words, all of them.", "plain words, all of them."), ("192.168.1.1 12 3", "192.168.1.1 12 3"), ("", ""), (None, "")])
def test_restoration(log_p, noisy, clean):
    assert toxicity.restore(noisy, log_p, {}) == clean


def test_char_model_counts_every_text(spark):
    df = spark.createDataFrame([("ab",), ("Ab b",), (None,), ("",)], "text string")
    p = np.exp(toxicity.char_model(df))
    assert p.shape == (64, 64, 64) and np.allclose(p.sum(axis=2), 1, atol=1e-4)
    assert p[0, 0, 1] > p[0, 0, 2]  # two words begin with a, one with b


def test_long_stretches_are_decoded_in_one_pass(log_p):
    s = "a1" * 20_000
    assert len(toxicity.restore(s, log_p, {})) == len(s)
    assert toxicity.restore("x " * 5000, log_p, {}).count("x") == 5000


def test_held_out_accuracy(spark):
    got = toxicity.op4_toxicity(spark, SF_ORACLE).toPandas()
    n = documents(spark, SF_ORACLE).count()
    assert len(got) == n and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.7)).all()
    both = got.merge(table(spark, SF_ORACLE, "labels").toPandas(), on="doc_id")
    both = both[both.held_out]
    hit = ((both.predicted == 1) & (both.toxic == 1)).sum()
    assert hit / max(1, (both.predicted == 1).sum()) > 0.8
    auc = np.mean([(x > y) + 0.5 * (x == y) for x, y in itertools.product(both.score[both.toxic == 1], both.score[both.toxic == 0])])
    assert auc > 0.8


def test_edge_rows(spark):
    from pyspark.sql import functions as F

    rows = [(1, "vile words", "x"), (1, "vile words", "x"), (2, "kind words", None), (3, None, None), (None, "vile", "z"), (4, "", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (3, 0), (9, 1), (4, None)], "doc_id long, toxic int")
    lp = toxicity.char_model(df)
    weights, intercept = toxicity.train(df, labels, F.lit(True), lp)
    assert math.isfinite(intercept)
    assert toxicity.train(df, labels.limit(0), F.lit(True), lp)[0] == {}
    got = df.select("doc_id", toxicity.toxicity(F.col("text"), lp, (weights, intercept)).alias("s")).collect()
    assert len(got) == len(rows) and all(0 <= r.s <= 1 for r in got)
    assert toxicity.char_model(df.limit(0)).shape == (64, 64, 64)


@pytest.mark.parametrize("noisy,clean", [
    ("i.d.i.o.t.", "idiot."), ("i.d.i.o.t, you", "idiot, you"), ("i-d-i-o-t!", "idiot!"), ("l.o.s.e.r.", "loser."), ("(i d i o t)", "(idiot)"),
    ('"i d i o t"', '"idiot"'), ("an i d i o t.", "an idiot."), ("i d ! o t", "idiot"), ("$ t u p i d", "stupid"), ("_l_o_s_e_r_", "_loser_"),
    ("l 0 $ e r", "loser"), ("idiot!", "idiot!"), ("from!! pathetic!", "from!! pathetic!"), ("path3t!c!!", "pathetic!!"), ("| 5 | 3 | 1 |", "| 5 | 3 | 1 |")])
def test_punctuation_and_symbols_around_noise(log_p, noisy, clean):
    assert toxicity.restore(noisy, log_p, {}) == clean


def test_symbols_at_the_end_of_a_word(spark):
    df = spark.createDataFrame([("what an ass and dumbass he is, all bullshit and loss",)] * 200, "text string")
    lp = toxicity.char_model(df).tolist()
    for noisy, clean in (("a$$", "ass"), ("dumba$$", "dumbass"), ("bullsh!+", "bullshit"), ("los$", "loss"), ("he is!", "he is!")):
        assert toxicity.restore(noisy, lp, {}) == clean


def test_a_large_toxic_vocabulary_is_kept(spark):
    from pyspark.sql import functions as F

    words = [chr(97 + k % 26) + chr(97 + k // 26) + "zqrstu" for k in range(400)]
    toxic = [(k, " ".join(words[(k + 100 * x) % 400] for x in range(4))) for k in range(400)]
    df = spark.createDataFrame(toxic + [(400 + k, "nothing of that kind here") for k in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k < 400)) for k in range(440)], "doc_id long, toxic int")
    weights, _ = toxicity.train(df, labels, F.lit(True), toxicity.char_model(df))
    assert {f"{k}{w[:n]}" for w in words for k, n in (("w", 99), ("4", 4), ("5", 5))} <= set(weights)


def test_a_repeated_id_teaches_once(spark):
    rows = [(k, f"you worthless thing {k}" if k % 2 else f"what a fine day {k}") for k in range(40)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int")
    kind = "doc_id long, text string"
    log_p = toxicity.char_model(spark.createDataFrame(rows, kind))
    once = toxicity.train(spark.createDataFrame(rows, kind), labels, F.lit(True), log_p)
    many = toxicity.train(spark.createDataFrame(rows + [rows[3]] * 500 + [(None, "x")], kind), labels, F.lit(True), log_p)
    assert once[0].keys() == many[0].keys() and abs(once[1] - many[1]) < 1e-6
