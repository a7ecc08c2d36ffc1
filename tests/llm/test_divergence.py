"""Source divergence against counting by hand; small hashes and batches; edge rows."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from quarry.llm import divergence as D
from quarry.llm.common import documents
from tests.conftest import SF_SMALL


def slow(rows, least, best):
    docs, count, groups = Counter(), Counter(), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        for t in set(terms):
            docs[lang, t] += 1
        for t in terms:
            count[lang, source, t] += 1
    out = []
    for lang in {x for x, _ in groups}:
        own = sorted(s for x, s in groups if x == lang)
        kept = [t for (x, t), n in docs.items() if x == lang and n >= least]
        v = len(kept)

        def share(n, total):
            return 1 + 1_000_000_000 * (n + 5) // (total + 5 * v)

        total = {s: sum(count[lang, s, t] for t in kept) for s in own}
        p = {s: {t: share(count[lang, s, t], total[s]) for t in kept} for s in own}
        q = {t: share(sum(count[lang, s, t] for s in own), sum(total.values())) for t in kept}
        for s in own:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in own if o != s]
            terms = [(q[t] - p[s][t], t.encode(), t) for t in kept if count[lang, s, t] > 0 and p[s][t] > q[t]]
            out += [(lang, s, "pair", o, -f, k) for k, (f, _, o) in enumerate(sorted(pairs), 1)]
            out += [(lang, s, "term", t, -f, k) for k, (f, _, t) in enumerate(sorted(terms)[:best], 1)]
    return sorted(out)


def found(df, **how):
    return sorted(tuple(r) for r in D.divergences(df, **how).collect())


def test_all_documents_match_counting(spark):
    docs = documents(spark, SF_SMALL)
    want = slow([(r.text, r.lang, r.source) for r in docs.collect()], D.LEAST_DOCS, D.BEST)
    assert found(docs) == want and {r[2] for r in want} == {"pair", "term"}


def rows_of(seed, n=80):
    rnd = random.Random(seed)
    words = ["The", "the", "é", "É", "中文", "a1b", "x_y", "\x7f", "\U0001f600", "don't", "zz"] + [f"w{c}" for c in "abcdefghijk"]
    rows = [(" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 30))), rnd.choice(["en", None, "de"]), rnd.choice(["s1", "s2", None, "S", "é"])) for _ in range(n)]
    return rows + [(None, "en", "only"), ("", "fr", None), ("123 ,;", "fr", "x"), ("the " * 20_000 + "é" * 9000, "en", "s1")] + [rows[0]] * 4


@pytest.mark.parametrize("terms,cells,size", [(1, 1, 1), (5, 40, 7), (1 << 19, 1 << 21, 1 << 21)])
def test_spills_and_batches_do_not_change_the_result(spark, monkeypatch, terms, cells, size):
    groups = D.Groups([("en", "a"), ("de", "b"), ("en", "c")])
    assert groups.names == [("de", "b"), ("en", "a"), ("en", "c")] and groups.of(1).tolist() == [1, 2]
    rows = rows_of(3)
    monkeypatch.setattr(D, "HOLD_TERMS", terms)
    monkeypatch.setattr(D, "HOLD_CELLS", cells)
    monkeypatch.setattr(D, "CELLS", size)
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(4)
    # the settings are read in this process: fold, merge and emit as the tasks do
    import pyarrow as pa

    from quarry.llm.common import text_slices
    read = [(t or "", x or "", s or "") for t, x, s in rows]
    groups = D.Groups(list({(x, s) for _, x, s in read}))
    batches = []
    stripes = D.Stripes(groups)
    for k in range(0, len(read), 7):
        part = read[k:k + 7]
        texts = pa.array([t for t, _, _ in part], pa.string())
        for a, e in text_slices(texts, 64):
            stripes.add(texts[a:e], np.array([groups.number[x, s] for _, x, s in part[a:e]], dtype=np.int64))
            if stripes.full():
                batches += list(stripes.spill())
    batches += list(stripes.spill())
    whole = pa.Table.from_batches(batches, D.STRIPES).sort_by([("lang", "ascending"), ("term", "ascending")])
    kept = pa.Table.from_batches(list(D._merge(3)(iter(whole.to_batches(max_chunksize=max(1, size % 97))))), D.STRIPES)
    again = pa.Table.from_batches(list(D._merge(3)(iter(whole.to_batches()))), D.STRIPES)
    assert kept.combine_chunks().equals(again.combine_chunks())
    want = slow(rows, 3, 4)
    assert found(df, least_docs=3, best=4) == want


def test_shares_are_exact_with_large_counts():
    for n, total, v in [(10 ** 14, 3 * 10 ** 14, 10 ** 6), (0, 7, 1), (7, 7, 1), (123_456_789_012, 9 * 10 ** 14, 99_999_999)]:
        assert int(D.shares(np.array([n]), total, v)[0]) == 1 + 1_000_000_000 * (n + 5) // (total + 5 * v)


def test_edge_tables_and_clashing_columns(spark):
    kind = "text string, lang string, source string"
    assert found(spark.createDataFrame([], kind)) == []
    # no term is kept: pairs with value 0, ties by name; a source alone in its language has no pair
    rows = [("a", "en", "y"), (None, "en", None), ("b", "en", "x"), ("c", "de", "x")]
    assert found(spark.createDataFrame(rows, kind)) == slow(rows, 30, 50)
    df = spark.createDataFrame([(*r, 1, 2, "q", 3) for r in rows_of(9, 30)], kind + ", g int, value int, `a.b` string, term int")
    assert found(df, least_docs=2) == slow(rows_of(9, 30), 2, 50)
