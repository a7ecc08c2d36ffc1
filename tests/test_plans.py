"""Plan-shape guards for scale: no pair-producing joins, pre-shuffle limits, pruning."""

import pytest

import __spark_entry__ as E
from quarry.plans import registry
from quarry.plans.search_queries import knn_best_per_doc
from tests.conftest import SF_SMALL

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_no_pair_producing_joins(spark, name):
    plan = _plan(E.queries()[name](spark, SF_SMALL))
    for op in FORBIDDEN:
        assert op not in plan, f"{name} plans a {op}"


@pytest.mark.parametrize("method,distance", [("arrow", "ArrowEvalPython"), ("sql", "aggregate(zip_with")])
def test_search_limits_before_shuffle_and_prunes(spark, method, distance):
    df = knn_best_per_doc(spark, SF_SMALL, method=method)
    df.collect()  # final adaptive plan
    plan = _plan(df).split("== Initial Plan ==")[0]
    assert plan.count("WindowGroupLimit") >= 2          # partial (map side) + final
    assert "TakeOrderedAndProject" in plan
    assert plan.count(distance) == 1                     # distance evaluated once
    scans = [line for line in plan.splitlines() if "ReadSchema" in line]
    assert scans and not any("text:string" in line for line in scans)   # text never read


@pytest.mark.parametrize("name", ["knn_best_per_doc", "knn_threshold", "knn_best_n", "alphabetical_pinned", "search_response"])
def test_vectors_are_not_shuffled(spark, name):
    """Also where the filtered ids fit no broadcast."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = E.queries()[name](spark, SF_SMALL)
        rows = df.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert rows and exchanges_with(df, "document_id") and not exchanges_with(df, "embedding")


def exchanges_with(df, column):
    """Shuffles of the physical plan whose rows hold a column of that name."""
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if name.endswith("QueryStage"):
            todo.append(node.plan())
            continue
        if name.startswith("Exchange") and any(column in str(node.output().apply(i)) for i in range(node.output().size())):
            found.append(node.toString()[:200])
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return found


def test_the_search_table_prunes_its_scan(spark, tmp_path):
    from quarry.operators import search as S
    from quarry.operators.filters import SearchFilters
    from quarry.sources.derived import gold_documents, gold_items

    docs, items = gold_documents(spark, SF_SMALL), gold_items(spark, SF_SMALL)
    S.write_search_table(items, docs, f"file://{tmp_path}/t")
    table = spark.read.parquet(f"file://{tmp_path}/t")
    q = [float(x) for x in items.where("id = 0").first().embeddings]
    for f in (SearchFilters(org_id=1, connectors=[1, 2]), SearchFilters(org_id=2, connectors=[3], languages=["en"], tags={"source": ["src3", "src7"]})):
        got = S.candidates(table, docs, q, f)
        plan = _plan(got)
        assert "PartitionFilters: [isnotnull(org_id" in plan and "Join" not in plan and "Exchange" not in plan
        key = lambda df: sorted((r.item_id, r.document_id, round(r.distance, 9)) for r in df.collect())
        assert key(got) == key(S.candidates(items, docs, q, f))
