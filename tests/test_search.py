"""Search operators against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import search as S
from quarry.operators.filters import SearchFilters


def _fixture(spark, n_docs=4, per_doc=5, dims=8, seed=3):
    rnd = random.Random(seed)
    docs = [(d, 1 + d % 2, f"title {chr(100 - d)}", '{}', [], 1) for d in range(n_docs)]
    items = []
    for d in range(n_docs):
        for c in range(per_doc):
            items.append((d * 10 + c, [rnd.uniform(-1, 1) for _ in range(dims)], d))
    D = spark.createDataFrame(docs, "id long, org_id int, title string, data string, tags array<string>, connector_id int")
    I = spark.createDataFrame(items, "id long, embeddings array<float>, document_id long")
    return D, I, items


def _cos(a, b):
    dot = sum(x * y for x, y in zip(a, b))
    return 1 - dot / (math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(y * y for y in b)))


@pytest.mark.parametrize("method", ["sql", "arrow"])
def test_best_per_document_equals_brute_force(spark, method):
    D, I, items = _fixture(spark)
    q = items[0][1]
    got = S.search(I, D, q, SearchFilters(connectors=[1]), threshold=1.0, limit=None, method=method)
    got = {r.document_id: (r.item_id, round(r.distance, 6)) for r in got.collect()}
    # float32 storage: brute force on the rounded-trip values
    stored = {r.id: list(r.embeddings) for r in I.collect()}
    exp = {}
    for iid, _, d in items:
        dist = round(_cos(stored[iid], stored[0]), 6)
        if dist < 2.0 and (d not in exp or (dist, iid) < (exp[d][1], exp[d][0])):
            exp[d] = (iid, dist)
    assert len(got) == 4 and got.keys() == exp.keys()
    for d in exp:
        assert got[d][0] == exp[d][0]
        assert abs(got[d][1] - exp[d][1]) < 1e-5


def test_best_n_keeps_duplicates_per_document(spark):
    D, I, items = _fixture(spark, n_docs=3)
    got = S.search_best(I, D, items[0][1], SearchFilters(connectors=[1]), n=None)
    assert got.count() == 15
    top = S.search_best(I, D, items[0][1], SearchFilters(connectors=[1]), n=5)
    assert [r.rank for r in top.orderBy("rank").collect()] == [1, 2, 3, 4, 5]


def test_batch_search_matches_single_search(spark):
    D, I, items = _fixture(spark, n_docs=6)
    D = D.withColumn("org_id", F.lit(1))
    qids = [items[i][0] for i in (0, 7, 13)]
    queries = spark.createDataFrame([(items[i][0], 1, items[i][1]) for i in (0, 7, 13)],
                                    "query_id long, org_id int, embedding array<float>")
    got = S.batch_search(I, D, queries, SearchFilters(connectors=[1]), threshold=0.9, k=3)
    for qid in qids:
        q = [float(x) for x in I.where(F.col("id") == qid).first().embeddings]
        one = S.search(I, D, q, SearchFilters(connectors=[1]), threshold=0.9, limit=3)
        exp = [(r.item_id, r.document_id) for r in one.orderBy("rank").collect()]
        b = [(r.item_id, r.document_id) for r in got.where(F.col("query_id") == qid).orderBy("rank").collect()]
        assert b == exp


def test_alphabetical_pins_most_relevant(spark):
    D, I, items = _fixture(spark, n_docs=4)
    hits = S.search(I, D, items[25 % len(items)][1], SearchFilters(connectors=[1]), threshold=1.0, limit=4)
    out = S.alphabetical(hits, D).orderBy("position").collect()
    assert out[0].rank == 1
    assert [r.title for r in out[1:]] == sorted(r.title for r in out[1:])


def test_zero_vector_is_excluded_by_threshold_and_sorts_last(spark):
    D, I, items = _fixture(spark, n_docs=2)
    zero = spark.createDataFrame([(999, [0.0] * 8, 1)], "id long, embeddings array<float>, document_id long")
    I2 = I.unionByName(zero)
    q = items[0][1]
    hits = S.search(I2, D, q, SearchFilters(connectors=[1]), threshold=1.0, limit=None)
    assert 999 not in [r.item_id for r in hits.collect()]
    best = S.search_best(I2, D, q, SearchFilters(connectors=[1]), n=None)
    last = best.orderBy(F.col("distance").asc(), F.col("item_id").asc()).collect()[-1]
    assert last.item_id == 999 and math.isnan(last.distance)


def test_suggestions_keep_wildcards(spark):
    from quarry.operators.catalog import suggestions
    D, _, _ = _fixture(spark, n_docs=4)
    D = D.withColumn("description", F.lit(None).cast("string"))
    got = [r.suggestion for r in suggestions(D, "t%e d", SearchFilters(connectors=[1, 2]), limit=10).collect()]
    assert got and all(s.startswith("title") for s in got)


def test_requests_share_the_masks_of_a_block():
    """A condition is worked out once per block, however many requests ask for it; a search of
    many requests at once gives what one at a time gives."""
    import numpy as np
    import pyarrow as pa

    from quarry.operators import search as S
    n = 60
    vec = np.random.default_rng(3).normal(size=(n, 4)).round(3)
    batch = pa.RecordBatch.from_pydict({
        "id": pa.array(range(n), pa.int64()), "document_id": pa.array([k // 5 for k in range(n)], pa.int64()),
        "embeddings": pa.array(vec.tolist(), pa.list_(pa.float32())), "connector_id": pa.array([k // 5 % 3 for k in range(n)], pa.int32()),
        "tags": [[f"t{k // 5 % 2}", None] if k % 7 else None for k in range(n)], "language": ["en" if k % 2 else None for k in range(n)],
        "data": [f'{{"a": {k % 4}.0}}' if k % 3 else "no json" for k in range(n)]})
    items = S._Items(batch)
    f = {"connectors": [0, 2], "tags": ["t0", "t1"], "languages": ["e"], "data": '{"a": [1, 3]}'}
    want = [k // 5 % 3 != 1 and bool(k % 7) and bool(k % 2) and bool(k % 3) and k % 4 in (1, 3) for k in range(n)]
    assert items.mask(f).tolist() == want
    made = len(items.made)
    items.batch = None  # all that the requests ask for is there
    assert items.mask(f).tolist() == want and len(items.made) == made

    masks = np.array([np.ones(n, dtype=bool), want])
    which, asked = np.arange(20) % 2, vec[:20]
    for dedup in (True, False):
        got = {(int(q), int(r)) for q, row, _ in S._nearest(items, masks, which, asked, 3, 1.4, dedup) for q, r in zip(q, row)}
        for q in range(20):
            d = 1 - vec @ asked[q] / (np.linalg.norm(vec, axis=1) * np.linalg.norm(asked[q]))
            hits = sorted((round(d[r], 5), r) for r in range(n) if masks[which[q]][r] and d[r] < 1.4)
            if dedup:
                hits = [h for h in hits if h[1] == min((x for x in hits if x[1] // 5 == h[1] // 5))[1]]
            assert {r for x, r in got if x == q} == {r for _, r in hits[:3]}
