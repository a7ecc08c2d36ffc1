"""Fingerprints and components against brute force."""

import random

import pytest
import xxhash

from quarry.llm import simhash
from quarry.llm.common import documents
from tests.conftest import SF_SMALL


def slow_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\r\x0b\x0c":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    sh = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hs = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(fps):
    """{index: component} by comparing every pair."""
    up = list(range(len(fps)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return [top(i) for i in range(len(fps))]


@pytest.mark.parametrize("text", [None, "", "  \n", "One", "a B", "a b c", "A b C d", "é É  x y z w " * 9, "w%d " * 400])
def test_fingerprint(text):
    assert simhash.fingerprint_of(text) == slow_fingerprint(text)


def test_query_matches_brute_force(spark):
    got = {r.doc_id: r for r in simhash.op2_simhash_dedup(spark, SF_SMALL).collect()}
    rows = documents(spark, SF_SMALL).select("doc_id", "text").orderBy("doc_id").collect()
    assert len(got) == len(rows)
    fps = [slow_fingerprint(r.text) for r in rows]
    comp = slow_components(fps)
    for r, f, c in zip(rows, fps, comp):
        assert got[r.doc_id].fingerprint == f"{f:016x}"
        assert got[r.doc_id].component_id == rows[c].doc_id


@pytest.mark.parametrize("bucket", [1, 3, 16])
def test_links_and_chains_at_any_bucket_size(spark, bucket):
    rnd = random.Random(7)
    fps = {rnd.getrandbits(64) for _ in range(40)}
    for f in list(fps)[:12]:  # chains that drift by two bits at a time, and a dense ball
        for _ in range(12):
            f ^= (1 << rnd.randrange(64)) | (1 << rnd.randrange(64))
            fps.add(f)
    centre = rnd.getrandbits(64)
    fps |= {centre ^ 1 << b for b in range(64)}
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = {r.fp: r.root for r in simhash.classes(df, bucket).collect()}
    want = slow_components(fps)
    for i, f in enumerate(signed):
        members = [signed[j] for j in range(len(fps)) if want[j] == want[i]]
        assert got[f] == min(members)


def test_edge_rows(spark):
    rows = [(1, "a b c d e", "x"), (1, "a b c d e", "x"), (None, "a b c d e", "y"), (2, None, "x"), (3, "", None), (None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted((r.doc_id or -1, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect())
    f = f"{slow_fingerprint('a b c d e'):016x}"
    assert got == sorted([(1, f, 1), (1, f, 1), (-1, f, 1), (2, "0" * 16, 2), (3, "0" * 16, 2), (-1, "0" * 16, 2)])
    kept = simhash.without_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2]
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    assert simhash.without_near_duplicates(df.limit(0)).count() == 0
