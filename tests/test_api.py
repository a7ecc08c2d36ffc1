"""Service-style entry points over the derived tables."""

import pytest
from pyspark.sql import functions as F

from quarry.api import Request, SearchService
from quarry.plans.search_queries import query_vector
from quarry.sources.derived import agent_tags, connectors, gold_documents, gold_items, widgets
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def svc(spark):
    return SearchService(spark, gold_documents(spark, SF_SMALL), gold_items(spark, SF_SMALL),
                         widgets(spark, SF_SMALL), connectors(spark, SF_SMALL), agent_tags(spark, SF_SMALL))


def test_search_respects_widget_filters(spark, svc):
    # user 1: org 2, trees disabled, external sources [3, 4]
    req = Request(org_id=2, deployment_id="dep-1")
    f = svc.resolve(req)
    assert f.connectors == [3, 4] and f.zt_connector_id is None
    opts, meta = svc.search(req, query_vector(spark, SF_SMALL), limit=5)
    rows = opts.collect()
    assert 0 < len(rows) <= 5
    assert all(r.document.orgId == 2 and r.document.connectorId in (3, 4) for r in rows)
    assert meta.first().dropped == 0


def test_alphabetical_and_missing_widget(spark, svc):
    req = Request(org_id=2, deployment_id="dep-1")
    opts, _ = svc.search(req, query_vector(spark, SF_SMALL), limit=5, sort_by="alphabetical")
    rows = opts.orderBy("position").collect()
    assert "position" in opts.columns and rows[0].rank == 1
    assert [r.document.title for r in rows[1:]] == sorted(r.document.title for r in rows[1:])
    with pytest.raises(LookupError):
        svc.search(Request(org_id=1, deployment_id="dep-nope"), query_vector(spark, SF_SMALL))


def test_catalog_methods(spark, svc):
    grouped, meta = svc.tags(1, with_meta=True)
    assert {r.key for r in grouped.collect()} == {"source", "lang", "zt_trees_trees"} and meta.count() > 0
    assert svc.languages(1).count() >= 1
    page = svc.documents_list(1, None, limit=5, offset=0).collect()
    assert len(page) == 5 and page[0].payload.tags is not None
    sugg = svc.suggestions(Request(org_id=2, deployment_id="dep-1"), "de", limit=3).collect()
    assert len(sugg) <= 3
    assert svc.deployments_with_documents().where(F.col("has_documents")).count() > 0
