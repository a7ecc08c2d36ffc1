"""Usage pagination and session goldens (hand-derived: the reference has none)."""

from datetime import datetime, timedelta

from quarry.operators import sessions as SS
from quarry.operators import usage as U

T0 = datetime(2024, 1, 1)


def _log(spark):
    rows = []
    def add(i, op, chain, chain_op, minutes, out=None, inp='"text"', org=1):
        rows.append((i, op, None, inp, None, out, chain, chain_op, 1, org, 1, T0 + timedelta(minutes=minutes),
                     T0 + timedelta(minutes=minutes)))
    add(1, "summarize", "c1", "summarize", 30, '"short"', '"alpha"')
    add(2, "moderation", "c1", "summarize", 31, '"true"')
    add(3, "translate", "c2", "translate", 10, '"hola"', '"beta"')
    add(4, "moderation", "c2", "translate", 9, '"false"')
    add(5, "fix-grammar", "c3", "fix-grammar", 50, '"fixed"', '"gamma"', org=2)
    add(6, "moderation", "c3", "fix-grammar", 51, '"false"')
    add(7, "moderation", "c4", "not-an-authoring-op", 1, '"true"')
    from quarry.schemas import USAGE_LOG
    return spark.createDataFrame(rows, USAGE_LOG)


def test_pagination_orders_chains_by_min_created(spark):
    heads, links, meta = U.usage_page(_log(spark), U.UsageFilters(), page=1, per_page=2)
    h = heads.orderBy("position").collect()
    assert [r.chain_id for r in h] == ["c2", "c1"]
    assert h[0].created_at == "2024-01-01 00:09:00" and h[0].n_links == 2
    assert h[0].chain_operation == "translate"
    assert sorted(r.id for r in links.collect()) == [1, 2, 3, 4]
    m = meta.first()
    assert (m.current_page, m["from"], m.to, m.per_page, m.total, m.last_page) == (1, 1, 2, 2, 3, 2)
    m2 = U.usage_page(_log(spark), U.UsageFilters(), page=2, per_page=2)[2].first()
    assert (m2["from"], m2.to) == (3, 3)


def test_failed_and_search_filters_return_whole_chains(spark):
    heads, links, _ = U.usage_page(_log(spark), U.UsageFilters(failed=True), page=1, per_page=10)
    assert [r.chain_id for r in heads.collect()] == ["c1"]
    heads, links, _ = U.usage_page(_log(spark), U.UsageFilters(search="hol"), page=1, per_page=10)
    assert [r.chain_id for r in heads.collect()] == ["c2"]
    assert sorted(r.id for r in links.collect()) == [3, 4]  # full chain, not only matching rows
    heads, _, _ = U.usage_page(_log(spark), U.UsageFilters(org_id=2, prompts=["fix-grammar"]), 1, 10)
    assert [r.chain_id for r in heads.collect()] == ["c3"]
    heads, _, _ = U.usage_page(_log(spark), U.UsageFilters(start_date="2024-01-01T00:20:00",
                                                           end_date="2024-01-01T00:40:00"), 1, 10)
    assert [r.chain_id for r in heads.collect()] == ["c1"]


def test_session_update_and_append(spark):
    s = spark.createDataFrame(
        [("s1", "search", "d", None, None, None, T0, 5, "User", 1),
         ("s2", "search", "d", "web", "x", None, T0, 6, "User", 1)],
        "id string, operation string, deployment_id string, current_deployment_type string, location string, "
        "previous_session_id string, created_at timestamp, causer_id long, causer_type string, org_id int")
    req = spark.createDataFrame(
        [(1, "s1", 5, "User", T0, "chat", "a", "p"),
         (2, "s1", 5, "User", T0 + timedelta(seconds=1), "web", None, None),
         (3, "s2", 6, "Agent", T0, "chat", "b", "q")],
        "request_id long, session_id string, causer_id long, causer_type string, requested_at timestamp, "
        "current_deployment_type string, location string, previous_session_id string")
    out = {r.id: r for r in SS.update_sessions(s, req).collect()}
    assert (out["s1"].current_deployment_type, out["s1"].location) == ("web", None)  # latest wins, NULL overwrites
    assert (out["s2"].current_deployment_type, out["s2"].location) == ("web", "x")   # causer mismatch: rejected
    acc = {r.request_id: r.accepted for r in SS.append_events(s, req).collect()}
    assert acc == {1: True, 2: True, 3: False}


def test_new_sessions_are_deterministic(spark):
    req = spark.createDataFrame([(1, "d1", 5, "User", 1, T0), (2, "d1", 6, "User", 1, T0)],
                                "request_id long, deployment_id string, causer_id long, causer_type string, "
                                "org_id int, requested_at timestamp")
    a = sorted(r.id for r in SS.new_sessions(req).collect())
    b = sorted(r.id for r in SS.new_sessions(req).collect())
    assert a == b and len(set(a)) == 2 and all(len(x) == 36 for x in a)


def test_keyset_paging_matches_offset_paging(spark):
    from quarry.operators.catalog import documents_after, documents_page
    from quarry.sources.derived import gold_documents
    from tests.conftest import SF_SMALL
    d = gold_documents(spark, SF_SMALL)
    first = [r.id for r in documents_page(d, 1, None, limit=10, offset=0).collect()]
    second = [r.id for r in documents_page(d, 1, None, limit=10, offset=10).collect()]
    assert [r.id for r in documents_after(d, 1, None, first[-1], 10).collect()] == second


def test_search_event_payload_shape(spark):
    import json
    hits = spark.createDataFrame([(1, 2, 20, 7, 0.2), (1, 1, 10, 7, 0.1)],
                                 "request_id long, rank int, item_id long, document_id long, distance double")
    req = spark.createDataFrame([(1, "test text", 5, "relevance", '{"tags":{}}'), (2, "none", 5, None, None)],
                                "request_id long, query string, limit int, sort_by string, filters string")
    docs = spark.createDataFrame([(7, 3, "doc-7", "Title")], "id long, connector_id int, document_id string, title string")
    items = spark.createDataFrame([(10, "s10"), (20, "s20")], "id long, snippet string")
    ev = {r.request_id: r for r in SS.search_event_payload(hits, req, docs, items).collect()}
    assert ev[1].message == "Found 2 options for test text" and ev[2].n_options == 0
    data = json.loads(ev[1].data)
    assert data["request"] == {"query": "test text", "limit": 5, "sort_by": "relevance", "filters": '{"tags":{}}'}
    assert [o["id"] for o in data["options"]] == [10, 20]
    assert data["options"][0] == {"id": 10, "snippet": "s10", "distance": 0.1,
                                  "document": {"id": 7, "connectorId": 3, "documentId": "doc-7", "title": "Title"}}


def test_connectors_belong_to_their_org(spark):
    from quarry.operators import resolve as R

    conns = spark.createDataFrame(
        [(1, 11, "zingtree", True, True), (1, 12, "zingtree", True, True), (1, 13, "kb", True, True), (2, 21, "zingtree", False, True),
         (2, 22, "zingtree", True, True), (2, 13, "kb", True, False), (3, 31, "kb", True, True)],
        "org_id int, id int, provider string, active boolean, type_active boolean")
    wid = spark.createDataFrame(
        [("a", 1, True, True, True, False, [7], [13, 22]), ("b", 2, True, True, True, True, [8], [13, 11]), ("c", 3, True, True, False, False, [9], [31])],
        "deployment_id string, org_id int, active boolean, enable_trees boolean, enable_external boolean, all_trees boolean, "
        "tree_ids array<int>, external_ids array<int>")
    got = {r.deployment_id: r for r in R.resolved_widgets(wid, conns).collect()}
    assert [(got[d].widget_connectors, got[d].zt_connector_id, got[d].zt_missing) for d in "abc"] == [([11, 13], 11, False), ([22], 22, False), ([], None, True)]
    assert sorted(tuple(r) for r in R.deployment_connectors(wid, conns).collect()) == [("a", 11, "zingtree"), ("a", 13, "kb"), ("b", 22, "zingtree")]
    assert {r.connector_id for r in R.org_connectors(conns, 1).collect()} == {11, 12, 13}
