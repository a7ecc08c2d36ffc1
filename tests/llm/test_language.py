"""Profiles and distances against a plain count, and held-out accuracy."""

from collections import Counter

import numpy as np
import pyarrow as pa

from quarry.llm import language
from quarry.llm.common import documents
from pyspark.sql import functions as F
from tests.conftest import SF_ORACLE


def slow_ranking(text, top):
    """The most frequent n-grams as tuples of symbols."""
    sym = lambda c: ord(c) if ord(c) < 3072 else 3072 + ord(c) % 29696
    words = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text or "").split()
    n = Counter()
    for w in words:
        s = [1, *map(sym, w), 1]
        n.update((0, 0, x) for x in s[1:-1])
        n.update((0, *s[i:i + 2]) for i in range(len(s) - 1))
        n.update(tuple(s[i:i + 3]) for i in range(len(s) - 2))
    return [g for g, _ in sorted(n.items(), key=lambda kv: (-kv[1], kv[0]))][:top]


def number(g):
    return g[0] << 30 | g[1] << 15 | g[2]


TEXTS = ["The cat sat, the rat ran.", "Der Hund und die Katze ÄÖ", None, "", " 12 .,\n", "x", "ὀδύσσεια 中文 中", "a a a b b c " * 50, "ภาษาไทย 한국어 かな", "\U00030000\U000313af \U000323af", "word again " * 40_000]


def test_distances_against_plain_counts():
    found = {"de": np.array([number(g) for g in slow_ranking(TEXTS[1], 20)]), "en": np.array([number(g) for g in slow_ranking(TEXTS[0], 20)])}
    d = language.Ranks(found, 20).distances(pa.array(TEXTS))
    for k, t in enumerate(TEXTS):
        own = slow_ranking(t, 20)
        for j, prof in enumerate(found.values()):
            if not own:
                assert np.isnan(d[k, j])
                continue
            place = {g: r for r, g in enumerate(prof.tolist())}
            want = sum(abs(place[number(g)] - r) if number(g) in place else 20 for r, g in enumerate(own)) / (len(own) * 20)
            assert abs(d[k, j] - want) < 1e-12


def test_profiles_are_sums_over_all_rows(spark):
    rows = [(1, t, l) for t, l in zip(TEXTS, ["en", "de", "en", "en", "de", None, "gr", "en", "th", "zh", "en"])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = language.profiles(df, top=15)
    assert list(got) == ["de", "en", "gr", "th", "zh"]
    text = " . ".join(t for _, t, l in rows if l == "en" and t)
    assert got["en"].tolist() == [number(g) for g in slow_ranking(text, 15)]


def test_held_out_accuracy(spark):
    got = language.op5_language(spark, SF_ORACLE).toPandas()
    want = documents(spark, SF_ORACLE).select("doc_id", "lang").toPandas()
    both = got.merge(want, on="doc_id")
    assert len(got) == len(want)
    assert (both.lang_pred == both.lang)[both.held_out].mean() > 0.95
    assert both.score.between(0, 1).all()


def test_edge_rows(spark):
    rows = [(1, t, "en", "x") for t in TEXTS] + [(None, "the", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    got = language.identify(df, F.lit(True)).collect()
    assert len(got) == len(rows)
    assert [(r.lang_pred, r.score) for r in got[2:5]] == [("und", 0.0)] * 3
    assert {r.lang_pred for r in language.identify(df, F.lit(False)).collect()} == {"und"}
    assert language.identify(df.limit(0), F.lit(True)).count() == 0


def test_every_letter_makes_a_language(spark):
    """Also letters of the last planes; and equal texts of two languages tie to the first name."""
    rows = [(1, "\U00030000\U00030001 \U00031350", "zh"), (2, "คำ ไทย", "th"), (3, "same text", "b"), (4, "same text", "a"), (5, "\ue000 \U000e0001 12", "xx")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in language.identify(df, F.lit(True)).collect()}
    assert got == {1: "zh", 2: "th", 3: "a", 4: "a", 5: "und"}


def test_short_rows_are_cut_into_lots(monkeypatch):
    from quarry.llm import common

    monkeypatch.setattr(common, "SLICE_ROWS", 3)
    assert list(common.text_slices(pa.array(["a", None, "", "b" * 50, "c", "d", "e", "f"]), 20)) == [(0, 3), (3, 4), (4, 7), (7, 8)]
