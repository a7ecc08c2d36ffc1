"""Pruned search against the full scan: identical rows, and how much is read."""

import random

import numpy as np
import pytest

from quarry.operators import pruned as P
from quarry.operators import search as S
from quarry.operators.filters import SearchFilters


def fixture(spark, tmp_path, spread, n=1200, dims=12, seed=4, clusters=16):
    rnd = np.random.default_rng(seed)
    heads = rnd.normal(size=(10, dims))
    vectors = heads[rnd.integers(0, 10, n)] + spread * rnd.normal(size=(n, dims))
    vectors[5] = 0
    vectors[7] = vectors[8] = vectors[9]  # ties
    docs = spark.createDataFrame([(d, 1 + d % 2, f"t{d}", "{}", [f"k{d % 3}"], 1 + d % 3, "en") for d in range(n // 4)],
                                 "id long, org_id int, title string, data string, tags array<string>, connector_id int, language string")
    items = spark.createDataFrame([(k, vectors[k].astype(np.float32).tolist() if k != 11 else [], k // 4) for k in range(n)],
                                  "id long, embeddings array<float>, document_id long").repartition(4)
    path = f"file://{tmp_path}/c"
    P.write_clusters(items, docs, path, clusters)
    return docs, items, P.Clusters(spark, path), vectors


def rows(df):
    return sorted((r.item_id, r.document_id, round(r.distance, 9) if r.distance == r.distance else None) for r in df.collect())


@pytest.mark.parametrize("spread", [0.05, 5.0])
def test_rows_are_those_of_a_full_scan(spark, tmp_path, spread):
    docs, items, table, vectors = fixture(spark, tmp_path, spread)
    rnd = random.Random(1)
    for q in [vectors[9], vectors[rnd.randrange(12, 1200)], -vectors[20]]:
        q = [float(x) for x in np.asarray(q, dtype=np.float32)]
        for filters in (SearchFilters(org_id=1, connectors=[1, 2, 3]), SearchFilters(connectors=[2])):
            for threshold, limit in ((0.7, 10), (0.05, 10), (1.0, 3), (0.3, None)):
                assert rows(table.search(q, filters, threshold, limit, first=2)) == rows(S.search(items, docs, q, filters, threshold, limit))
            assert rows(table.search_best(q, filters, 7)) == rows(S.search_best(items, docs, q, filters, 7))
    f = SearchFilters(connectors=[1, 2, 3])
    # more than there are with a direction: those without one come last
    assert len(rows(table.search_best(q, f, 5000))) == len(rows(S.search_best(items, docs, q, f, 5000)))


def test_close_clusters_are_pruned_and_reported(spark, tmp_path):
    _, _, table, vectors = fixture(spark, tmp_path, 0.05)
    plan = table.plan([float(x) for x in vectors[30]], SearchFilters(connectors=[1, 2, 3]), 0.7, 10)
    assert plan.total == 1200 and 0 < plan.rows < 0.4 * plan.total
    got = table._rows(plan, SearchFilters(connectors=[1, 2, 3]))
    shown = got._jdf.queryExecution().executedPlan().toString()
    assert "(angle" in shown and "Exchange" not in shown and got.count() <= plan.rows
    assert {r.cluster for r in got.select("cluster").distinct().collect()} <= set(plan.bands) and len(plan.bands) < 8


def test_edge_tables(spark, tmp_path):
    docs, items, table, vectors = fixture(spark, tmp_path, 1.0, n=40, clusters=3)
    f = SearchFilters(connectors=[1, 2, 3])
    zero = [0.0] * 12
    assert rows(table.search(zero, f, 0.7, 5)) == [] and len(rows(table.search_best(zero, f, 5))) == 5
    assert rows(table.search([1.0] * 12, SearchFilters(org_id=77, connectors=[1]), 0.7, 5)) == []
    P.write_clusters(items.limit(0), docs, f"file://{tmp_path}/empty")
    empty = P.Clusters(spark, f"file://{tmp_path}/empty")
    assert rows(empty.search([1.0] * 12, f, 0.7, 5)) == [] == rows(empty.search_best([1.0] * 12, f, 5))
