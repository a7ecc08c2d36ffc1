"""Phrase mining against counting by hand, with small slices, ties and edge rows."""

import random
import re
import tracemalloc
from collections import Counter
from unittest import mock

import pyarrow as pa
import pytest

from quarry.llm import phrases as P
from quarry.llm.common import documents
from tests.conftest import SF_SMALL


def slow(rows, least, best, swallow=50):
    """(lang, rank, phrase, a, l, r, n, score) by the contract, one lang after the other."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n-\r]", low):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            for m in (1, 2, 3):
                for i in range(len(w) - m + 1):
                    f[lang, tuple(w[i:i + m])] += 1
    found = {}
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    for (lang, ws), a in cand.items():
        longer = [b for (x, y), b in cand.items() if x == lang and len(y) > len(ws) and any(y[i:i + len(ws)] == ws for i in range(len(y)))]
        if any(100 * b >= swallow * a for b in longer):
            continue
        cuts = [(1_000_000 * a * a // (f[lang, ws[:k]] * f[lang, ws[k:]]), k) for k in range(1, len(ws))]
        score, k = min(cuts)
        found.setdefault(lang, []).append((-score, -a, " ".join(ws).encode(), a, f[lang, ws[:k]], f[lang, ws[k:]], score))
    out = []
    for lang, rows in found.items():
        out += [(lang, rank, p.decode(), a, l, r, n[lang], s) for rank, (_, _, p, a, l, r, s) in enumerate(sorted(rows)[:best], 1)]
    return sorted(out)


def mined(df, **how):
    return sorted(tuple(r) for r in P.phrases(df, **how).collect())


def test_all_documents_match_counting(spark):
    docs = documents(spark, SF_SMALL)
    rows = [(r.text, r.lang) for r in docs.collect()]
    assert mined(docs) == slow(rows, P.LEAST, P.BEST)


@pytest.mark.parametrize("limit", [40, 1 << 20])
def test_slices_do_not_change_the_result(spark, limit):
    rnd = random.Random(5)
    words = ["a", "b", "C", "d\x1ce", "é", "É", "中文", "x"]
    rows = [("".join(rnd.choice(words) + rnd.choice([" ", " ", "\t ", ", ", "\n", ". "]) for _ in range(rnd.randint(0, 60))), rnd.choice(["en", "und", None, "de"])) for _ in range(30)]
    rows += [rows[0]] * 5 + [(None, "en"), ("", "en"), (None, None), ("...!,,", "fr")]
    rows += [("a b C " * 700, "en"), ("a b C, " * 90, "de"), ("w" * 5000 + " q", "en")]  # very long, as one piece and as many
    df = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    want = slow(rows, 3, 9)
    assert want and mined(df, least=3, best=9, limit=limit) == want
    assert len(mined(df, least=3, best=None, limit=limit)) > len(want)


def test_edge_tables_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "text string, lang string")
    assert mined(empty) == []
    assert mined(spark.createDataFrame([(None, None), ("one", "en")], "text string, lang string"), least=1) == []
    # repeated rows count as often as they stand; other columns, whatever their names, are not read
    df = spark.createDataFrame([("x y", "en", 1, 2, "z")] * 4, "text string, lang string, slice int, code int, `a.b` string")
    got = P.phrases(df, least=4).collect()
    assert [tuple(r) for r in got] == [("en", 1, "x y", 4, 4, 4, 8, 1_000_000)]
    assert got[0].asDict().keys() == {"lang", "rank", "phrase", "a", "l", "r", "n", "score"}


def test_cuts_tie_to_the_shorter_first_part(spark):
    rows = [("p q r", "en")] * 3 + [("p", "en"), ("r", "en")]
    df = spark.createDataFrame(rows, "text string, lang string")
    # both cuts of "p q r" score 9 / (4 * 3); the first is given
    assert mined(df, least=3) == slow(rows, 3, 2000) == [("en", 1, "p q r", 3, 4, 3, 11, 750_000)]


def test_score_is_exact_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    for a, left, right in [(10 ** 13 - 1, 10 ** 13, 10 ** 13), (99_999_999_999_999, 99_999_999_999_999, 99_999_999_999_999), (3 ** 20, 3 ** 21 + 1, 3 ** 22 - 2)]:
        row = spark.createDataFrame([(a, left, right)], "a long, l long, r long").select(P._score("l", "r").alias("s"), F.lit(0)).first()
        assert row.s == 1_000_000 * a * a // (left * right)


def test_a_slice_has_its_number():
    with pytest.raises(ValueError):
        from unittest import mock
        with mock.patch.object(P.TaskContext, "get") as ctx:
            ctx.return_value.partitionId.return_value = 0
            P._slice_number(1 << P.SEQ_BITS)


@pytest.mark.parametrize("words", [[f"w{k}" for k in range(30_000)], ["a", "b", "C"]])
def test_a_slice_takes_little_memory_beside_its_words(words):
    rnd = random.Random(7)
    rows = [" ".join(rnd.choices(words, k=400)) + "." for _ in range(500)]
    batch = pa.RecordBatch.from_arrays([pa.array(rows), pa.array([("en", "de")[k % 2] for k in range(500)])], ["t", "l"])
    del rows
    with mock.patch.object(P, "_slice_number", lambda seq: seq):
        tracemalloc.start()
        found = sum(sum(x.column("n").drop_null().to_pylist()) for x in P._words(P.SLICE)(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
    assert found == 500 * 400
    assert peak < 48 * found  # bytes; sorting with np.unique's inverse took 52 to 59
