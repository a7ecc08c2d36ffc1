"""Items in texts against a full alignment of every piece with every text."""

import random

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import decontamination as D
from quarry.llm.common import codepoints, documents, table
from tests.conftest import SF_ORACLE


def folded(t):
    cps, bounds = codepoints(pa.array([t], pa.string()))
    s = D.normal(cps, bounds)[0]
    return s[:-1] if len(s) and s[-1] == 32 else s


def least_edits(piece, text):
    """Fewest edits between the piece and any stretch of the text, by the full table."""
    row = np.zeros(len(text) + 1, dtype=np.int64)
    k = np.arange(len(text) + 1)
    for i, c in enumerate(piece):
        new = np.r_[i + 1, np.minimum(row[:-1] + (text != c), row[1:] + 1)]
        row = np.minimum.accumulate(new - k) + k
    return int(row.min())


def slow(items, text, budget=D.BUDGET):
    out = set()
    s = folded(text or "")
    for item, t in items:
        p = folded(t)
        if len(p) < D.Q:
            continue
        last = max(0, len(p) - D.PIECE)
        for a in [*range(0, last, D.STRIDE), last]:
            piece = p[a:a + D.PIECE]
            most = min(int(len(piece) * budget), (len(piece) - D.Q) // D.Q, D.BAND)
            if len(s) and least_edits(piece, s) <= most:
                out.add(item)
    return out


def edited(rnd, t, n):
    s = list(t)
    for _ in range(n):
        k = rnd.randrange(len(s))
        kind = rnd.randrange(3)
        s[k:k + 1] = [] if kind == 0 else ["q"] if kind == 1 else [s[k], "zé"]
    return "".join(s)


@pytest.mark.parametrize("seed", range(3))
def test_finds_what_full_alignment_finds(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(k, prose(rnd.randrange(2, 70))) for k in range(12)] + [(50, "short"), (51, "ab cd efg")]
    texts = [None, "", " \n ", prose(30)]
    for _ in range(40):
        item = rnd.choice(items)[1]
        copy = edited(rnd, item, rnd.randrange(0, 2 + len(item) // 8))
        cut = copy[rnd.randrange(0, 20):] if rnd.random() < 0.3 else copy
        texts.append(prose(rnd.randrange(0, 20)) + rnd.choice([" ", "\n\n", ""]) + rnd.choice([cut, cut.upper(), cut.replace(" ", "  \t")]) + " " + prose(rnd.randrange(0, 20)))
    got = [{h["item_id"] for h in x} for x in D.find(pa.array(texts, pa.string()), D.Pieces(items))]
    want = [slow(items, t) for t in texts]
    assert got == want and sum(map(len, want)) > 10


def test_spans_point_into_the_text():
    item = "An item of the benchmark with enough words to be found again, somewhere in a text."
    texts = ["", "  Été\n " + item + " and more", "none here", item, "x" * 50 + " " + item.upper().replace(" ", "\n\n")]
    got = D.find(pa.array(texts), D.Pieces([(7, item)]))
    assert [len(x) for x in got] == [0, 1, 0, 1, 1]
    assert texts[1][got[1][0]["start"]:got[1][0]["stop"]] == item
    assert texts[4][got[4][0]["start"]:got[4][0]["stop"]].split() == item.upper().split()


def test_query_finds_every_passage(spark):
    got = {(r.doc_id, r.item_id) for r in D.op9_decontamination(spark, SF_ORACLE).collect()}
    items = [tuple(r) for r in table(spark, SF_ORACLE, "benchmark").collect()]
    exact = {(d.doc_id, i) for d in documents(spark, SF_ORACLE).collect() for i, t in items if t in (d.text or "")}
    assert exact and exact <= got
    for d in documents(spark, SF_ORACLE).where("doc_id % 25 = 0").collect():  # brute force is slow
        assert {i for x, i in got if x == d.doc_id} == slow(items, (d.text or "")[:20_000]) or len(d.text or "") > 20_000


def test_edge_rows_and_blocks(spark):
    item = "a benchmark item that is long enough to be found in any text that holds it"
    bench = spark.createDataFrame([(1, item), (None, item), (2, None), (3, ""), (4, "tiny"), (5, "another item that no text has, of similar length")], "item_id long, text string")
    rows = [(1, "so " + item, "x"), (1, "so " + item, "x"), (None, item, None), (2, None, None), (3, "clean text", "y"), (4, "", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    for size in (1 << 20, 40):
        got = sorted((r.doc_id or -1, r.item_id or -1) for r in D.contamination(df, bench, block_chars=size).collect())
        assert got == sorted([(d, i) for d in (1, 1, -1) for i in (1, -1)])
        kept = D.without_leaks(df, bench, block_chars=size)
        assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4]
    assert D.contamination(df.limit(0), bench).count() == 0
    assert D.contamination(df, bench.limit(0)).count() == 0 and D.without_leaks(df, bench.limit(0)).count() == len(rows)


def holds_whole(item, text):
    p, s = folded(item), folded(text)
    return len(s) > 0 and least_edits(p, s) <= int(len(p) * D.BUDGET)


@pytest.mark.parametrize("seed", range(3))
def test_the_budget_holds_over_the_whole_item(seed):
    """Edits in one place, or anywhere, up to the budget of the item and a little above."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeéfgh") for _ in range(rnd.randrange(1, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(k, prose(rnd.randrange(30, 110))) for k in range(10)]
    texts, lost = ["", None, prose(40)], 0
    for k, item in items:
        for n in (16, len(item) // 10 - 1, len(item) // 8):
            a = (len(item) - n) // 2
            changed = item[:a] + "".join(rnd.choice("xyz") for _ in range(n + rnd.randrange(-2, 3))) + item[a + n:]
            texts.append(rnd.choice(["", prose(9) + " "]) + changed + rnd.choice(["", " " + prose(9)]))
        texts += [item[3:-3], "ü" + item, edited(rnd, item, len(item) // 11)]
    got = [{h["item_id"] for h in x} for x in D.find(pa.array(texts, pa.string()), D.Pieces(items))]
    for t, g in zip(texts, got):
        part = slow(items, t)
        want = part | {k for k, x in items if holds_whole(x, t or "")}
        lost += len(want - part)
        assert g == want
    assert lost


def test_a_phrase_changed_in_the_middle():
    items = [(k, f"{k} " + " ".join(f"word{(k * 31 + x * 7) % 97}" for x in range(n))) for k, n in enumerate(range(21, 33))]
    items = [(k, t) for k, t in items if 129 < len(t) < 230]
    texts = [t[:len(t) // 2 - 8] + "q" * 16 + t[len(t) // 2 + 8:] for _, t in items]
    want = [k for (k, t), x in zip(items, texts) if holds_whole(t, x)]
    got = D.find(pa.array([f"before it {x} and behind it" for x in texts]), D.Pieces(items))
    assert len(want) >= 5 and all(k in {h["item_id"] for h in got[[i for i, _ in items].index(k)]} for k in want)
    k = [i for i, _ in items].index(want[-1])
    hit = next(h for h in got[k] if h["item_id"] == want[-1])
    assert f"before it {texts[k]} and"[hit["start"]:hit["stop"]] == texts[k]


def test_parts_of_an_item():
    rnd = random.Random(5)
    item = "".join(rnd.choice("abcdefgh ") for _ in range(600)).strip()
    n = D.PIECE + D.STRIDE - 1
    texts = [f"so {item[a:a + n]} on" for a in range(0, len(item) - n, 5)]
    assert n <= 143 and all(D.find(pa.array(texts), D.Pieces([(1, item)])))


def test_items_stay_in_their_texts():
    item = " ".join(f"some{x}thing" for x in range(12))
    half = len(item) // 2
    texts = ["a" * 200, item[3:], "b" * 200, item[:half], item[half:], None, "", item]
    assert [len(x) for x in D.find(pa.array(texts), D.Pieces([(1, item)]))] == [0, 1, 0, 0, 0, 0, 0, 1]


def test_tasks_give_memory_back():
    from quarry.functions import slices
    ended = []
    run = slices.giving_back(lambda batches: (b + 1 for b in batches))
    was, slices.trim = slices.trim, lambda: ended.append(1)
    try:
        assert list(run(iter([1, 2]))) == [2, 3] and ended == [1]
    finally:
        slices.trim = was
