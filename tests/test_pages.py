"""Pages from the index against pages from a sort, at any depth."""

import re

import pytest

from quarry.operators import catalog
from quarry.operators import pages as P


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k * 7919 % 100_003, 1 + k % 3, 1 + k % 5, f"d{k}") for k in range(20_000)]
    return spark.createDataFrame(rows, "id long, org_id int, connector_id int, document_id string").repartition(5)


@pytest.fixture(scope="module")
def table(docs, tmp_path_factory):
    return P.fresh(docs, f"file://{tmp_path_factory.mktemp('pages')}", 32)


@pytest.mark.parametrize("org,connector", [(1, None), (None, 4), (2, 3), (9, 9)])
def test_pages_equal_those_of_a_sort(docs, table, org, connector):
    every = [tuple(r) for r in docs.where(P.documents_by_org_connector(org, connector)).orderBy("id").collect()]
    for limit, offset in ((10, 0), (10, 1), (25, 1307), (3, len(every) - 2), (10, len(every)), (5000, 300), (7, 6660)):
        offset = max(0, offset)
        assert [tuple(r) for r in table.page(org, connector, limit, offset).orderBy("id").collect()] == every[offset:offset + limit]
    assert table.locate(org, connector, 10, 0)[2] == len(every)


def test_a_deep_page_reads_its_range_only(docs, table):
    held, skip, total = table.locate(1, None, 10, 6000)
    assert len(held) <= 2 and skip < total / 8
    got = table.page(1, None, 10, 6000)
    assert [r.id for r in got.collect()] == [r.id for r in catalog.documents_page(docs, 1, None, 10, 6000).collect()]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*range", plan)


def test_equal_ids_and_empty_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, 1, f"d{k}") for k in range(50)], "id long, org_id int, connector_id int, document_id string")
    assert P.fresh(df, f"file://{tmp_path}", 4).page(1, 1, 60, 0).count() == 50
    assert P.fresh(df.limit(0), f"file://{tmp_path}", 4).page(1, 1, 60, 0).count() == 0
