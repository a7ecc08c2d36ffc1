"""Targets against the step-by-step rule, the draw against its definition, and edge rows."""

import hashlib
import random

import pytest

from quarry.llm import mixing
from quarry.llm.common import documents
from tests.conftest import SF_ORACLE, SF_SMALL


def slow_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Reshare what lies above the caps until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-32-be")) + [None] * (None in sizes)
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        per = left / sum(w[s] for s in open_)
        above = [s for s in open_ if per * w[s] > most * sizes[s]]
        if not above:
            return out | {s: per * w[s] for s in open_}
        for s in above:
            out[s] = most * sizes[s]
            left -= out[s]
            open_.discard(s)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_targets(spark, seed):
    rnd = random.Random(seed)
    sizes = {s: rnd.choice([0, 1, 5, 40, 1000]) for s in ["b", "a", "Z", "é", "\U0001f600", None, "c"][: 3 + 2 * seed]}
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    want = slow_targets(sizes)
    assert got.keys() == want.keys()
    for s in got:
        assert got[s] == pytest.approx(want[s])


def test_mix_of_the_documents(spark):
    rows = mixing.op1_pareto_mix(spark, SF_ORACLE).collect()
    again = {r.doc_id: r.taken for r in mixing.op1_pareto_mix(spark, SF_ORACLE).collect()}
    docs = {r.doc_id: r for r in documents(spark, SF_ORACLE).collect()}
    assert {r.doc_id for r in rows} == docs.keys()
    taken, target, size = {}, {}, {}
    for r in rows:
        assert r.size == len((docs[r.doc_id].text or "").encode().split())
        assert r.taken in (0, r.size, 2 * r.size) and again[r.doc_id] == r.taken
        s = docs[r.doc_id].source
        taken[s] = taken.get(s, 0) + r.taken
        size[s] = size.get(s, 0) + r.size
        target[s] = r.target
    want = slow_targets(size)
    for s in size:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - target[s]) < 0.05 * target[s]
    assert abs(sum(taken.values()) / sum(target.values()) - 1) < 0.01


def test_draw_is_the_start_of_the_pareto_ranking(spark):
    """The definition: u from the digest, p proportional to size with the expected words that are missing."""
    rows = mixing.mix(documents(spark, SF_ORACLE)).select("_row.doc_id", "_row.text", "_row.source", "_mix.*").collect()
    unequal = 0
    for s in {r.source for r in rows}:
        own = [r for r in rows if r.source == s and r["size"] > 0]
        ratio = own[0].target / own[0].source_size
        missing = own[0].target - int(ratio + 1e-12) * own[0].source_size
        if ratio - int(ratio + 1e-12) <= 1e-9:
            assert len({r.copies for r in own}) == 1
            continue
        lo, hi = 0.0, 1.0  # c by bisection, where the operator solves for it
        for _ in range(200):
            c = (lo + hi) / 2
            lo, hi = (c, hi) if sum(min(1.0, c * r["size"]) * r["size"] for r in own) < missing else (lo, c)
        ranked = []
        for r in own:
            unit = hashlib.md5(f"{r.doc_id}:{hashlib.md5(r.text.encode()).hexdigest()}:{mixing.SEED}".encode()).hexdigest()
            u, p = (int(unit[:13], 16) + 0.5) / 2 ** 52, min(1.0, c * r["size"])
            ranked.append((0.0 if p > 1 - 1e-12 else u / (1 - u) / (p / (1 - p)), unit, r))
            unequal += 0 < p < 1
        ranked.sort(key=lambda x: x[:2])
        words, out = 0, 0
        for k, (_, _, r) in enumerate(ranked):
            if words + r["size"] > missing:
                break
            words += r["size"]
            out = k + 1
        least = int(ratio + 1e-12)
        drawn = [r.copies - least for _, _, r in ranked]
        assert drawn[:out] == [1] * out and sum(drawn[out:]) <= 1  # the top-up
        if sum(drawn[out:]):
            topped = ranked[out + drawn[out:].index(1)][2]["size"]
            assert abs(words + topped - missing) < missing - words
    assert unequal > 100


@pytest.mark.parametrize("slices", [1, 7, 2048])
def test_slices_do_not_change_the_draw(spark, slices):
    a = {r._row.doc_id: r._mix.copies for r in mixing.mix(documents(spark, SF_SMALL), slices=slices).collect()}
    b = {r._row.doc_id: r._mix.copies for r in mixing.mix(documents(spark, SF_SMALL)).collect()}
    assert a == b


@pytest.mark.parametrize("alike", [False, True])
def test_null_and_repeated_ids_meet_the_targets(spark, alike):
    """Half of the ids null, or half of the rows copies of one row."""
    rnd = random.Random(alike)
    rows = [(None if k % 2 else k, "same words here" if alike and k % 2 else " ".join(["w"] * rnd.randint(1, 9) + [str(k)]), f"s{k % 3}") for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    out = mixing.mix(df).select("_mix.*", "_row.source").collect()
    for s in ("s0", "s1", "s2"):
        own = [r for r in out if r.source == s]
        assert abs(sum(r["size"] * r.copies for r in own) - own[0].target) < 0.06 * own[0].target
        assert all(0 <= r.copies <= 2 for r in own)


def test_very_long_texts_do_not_pass_twice_their_size(spark):
    rows = [(k, "w " * (200_000 if k == 0 else 3), "a" if k < 60 else "b") for k in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert all(r._mix.copies <= 2 for r in mixing.mix(df).collect())


def test_edge_rows_and_clashing_columns(spark):
    rows = [(1, "a b", "x", 9, 8, 7, 6), (1, "a b", "x", 9, 8, 7, 6), (None, "c", "x", 9, 8, 7, 6), (2, None, "y", 9, 8, 7, 6), (3, "", None, 9, 8, 7, 6),
            (4, "d " * 50, None, 9, 8, 7, 6), (None, None, None, 9, 8, 7, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size long, _copy long, _mix long, `a.b` long")
    got = mixing.mix(df)
    assert got.columns == ["_row", "_mix"] and got.count() == len(rows) and got.schema["_row"].dataType == df.schema
    assert all(0 <= r._mix.copies <= 2 for r in got.collect())
    out = mixing.mixed_documents(df)
    assert out.schema == df.schema and out.count() > 0
    assert {tuple(r)[3:] for r in out.collect()} == {(9, 8, 7, 6)}
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.mixed_documents(df.limit(0)).count() == 0
    assert mixing.mix(df.where("text IS NULL")).count() == 2


def test_plan_has_no_python(spark):
    plan = mixing.mixed_documents(documents(spark, SF_SMALL))._jdf.queryExecution().executedPlan().toString()
    assert not any(k in plan for k in ("Python", "Arrow", "Pandas", "CartesianProduct", "NestedLoop"))
