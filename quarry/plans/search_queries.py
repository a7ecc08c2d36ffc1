"""Registered search queries (L1, L2, F1, F2, G1, G2, B1-B9) and their oracle SQL.

Parameters are fixed, documented constants; the query vector is read from the
data (the embedding of item 0), as a search request would carry it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import search as S
from quarry.operators.pruned import Clusters, write_clusters
from quarry.operators.filters import ScopeSource, SearchFilters, filter_predicate
from quarry.plans.oracle import query_vector_sql, with_ctes
from quarry.session import ensure_checkpoint_dir
from quarry.sources.derived import gold_documents, gold_items
from quarry.sources.tables import table

QUERY_VEC_ID = 0
ORG = 1
ALL_CONNECTORS = [1, 2, 3, 4, 5]
TOP_K = 10


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = QUERY_VEC_ID) -> list[float]:
    """One bounded row (a single vector) fetched to parameterise the plan."""
    row = (table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id)
           .select("embedding").first())
    return list(row[0])


def _r6(c):
    return F.round(F.col(c), 6).alias(c)


def _sql_dist(alias: str = "i") -> str:
    return (f"1 - list_cosine_similarity({alias}.embeddings::DOUBLE[], "
            f"{query_vector_sql(QUERY_VEC_ID)})")


def _sql_doc_filter(pred: str) -> str:
    return f"document_id IN (SELECT id FROM g_documents WHERE {pred})"


# ---------------------------------------------------------------- knn_best_per_doc
def knn_best_per_doc(spark: SparkSession, sf_dir: str, method: str = "arrow") -> DataFrame:
    docs = gold_documents(spark, sf_dir)
    hits = S.search(gold_items(spark, sf_dir), docs, query_vector(spark, sf_dir),
                    SearchFilters(org_id=ORG, connectors=ALL_CONNECTORS),
                    threshold=0.7, limit=TOP_K, method=method)
    return S.with_payload(hits, docs).select(
        F.col("rank").cast("long"), "item_id", "document_id", _r6("distance"), "title")


def _knn_sql(pred: str, threshold: float, limit: int | None, cols: str) -> str:
    body = f"""
, cand AS (
  SELECT i.id AS item_id, i.document_id, {_sql_dist()} AS distance
  FROM g_items i WHERE i.{_sql_doc_filter(pred)}
), best AS (
  SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY distance, item_id) AS rn
  FROM cand WHERE distance < {2 * threshold}
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY distance, item_id) AS rank FROM best WHERE rn = 1
)
SELECT {cols} FROM ranked r JOIN g_documents d ON d.id = r.document_id
{'' if limit is None else f'WHERE rank <= {limit}'}"""
    return with_ctes(["g_documents", "g_items"], body).replace("\n\n,", "\n,")


SQL = {}
SQL["knn_best_per_doc"] = _knn_sql(
    "org_id = 1 AND connector_id IN (1,2,3,4,5)", 0.7, TOP_K,
    "CAST(rank AS BIGINT) AS rank, item_id, r.document_id AS document_id, round(distance, 6) AS distance, d.title")


# ---------------------------------------------------------------- knn_threshold
def knn_threshold(spark: SparkSession, sf_dir: str, method: str = "arrow") -> DataFrame:
    """All documents whose best chunk is under a tighter threshold (no limit)."""
    hits = S.search(gold_items(spark, sf_dir), gold_documents(spark, sf_dir), query_vector(spark, sf_dir),
                    SearchFilters(org_id=ORG, connectors=ALL_CONNECTORS), threshold=0.5, limit=None,
                    method=method)
    return hits.select("item_id", "document_id", _r6("distance"))


SQL["knn_threshold"] = _knn_sql("org_id = 1 AND connector_id IN (1,2,3,4,5)", 0.5, None,
                                "item_id, r.document_id AS document_id, round(distance, 6) AS distance")


# ---------------------------------------------------------------- knn_search_table
def knn_search_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1 on a search table: the org's folder and the carried filter columns, no join before the top-k."""
    docs = gold_documents(spark, sf_dir)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/quarry-tables/search-{uuid.uuid4().hex}"
    S.write_search_table(gold_items(spark, sf_dir), docs, path)
    hits = S.search(spark.read.parquet(path), docs, query_vector(spark, sf_dir),
                    SearchFilters(org_id=ORG, connectors=[1, 3, 4], languages=["en", "f"], tags={"source": ["src3", "src5", "src7", "src9"]}),
                    threshold=0.7, limit=TOP_K)
    return S.with_payload(hits, docs).select(
        F.col("rank").cast("long"), "item_id", "document_id", _r6("distance"), "title")


SQL["knn_search_table"] = _knn_sql(
    "org_id = 1 AND connector_id IN (1,3,4) AND (language LIKE 'en%' OR language LIKE 'f%') AND "
    "list_has_any(tags, ['\"source\".\"src3\"', '\"source\".\"src5\"', '\"source\".\"src7\"', '\"source\".\"src9\"'])", 0.7, TOP_K,
    "CAST(rank AS BIGINT) AS rank, item_id, r.document_id AS document_id, round(distance, 6) AS distance, d.title")


# ---------------------------------------------------------------- knn_pruned
def _clusters(spark: SparkSession, sf_dir: str) -> Clusters:
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/quarry-tables/clusters-{uuid.uuid4().hex}"
    write_clusters(gold_items(spark, sf_dir), gold_documents(spark, sf_dir), path)
    return Clusters(spark, path)


def knn_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1 on clusters with radius bounds: the rows of ``knn_best_per_doc``."""
    hits = _clusters(spark, sf_dir).search(query_vector(spark, sf_dir), SearchFilters(org_id=ORG, connectors=ALL_CONNECTORS), threshold=0.7, limit=TOP_K)
    return S.with_payload(hits, gold_documents(spark, sf_dir)).select(
        F.col("rank").cast("long"), "item_id", "document_id", _r6("distance"), "title")


SQL["knn_pruned"] = SQL["knn_best_per_doc"]


def knn_best_n_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G2 on clusters: the rows of ``knn_best_n``."""
    hits = _clusters(spark, sf_dir).search_best(query_vector(spark, sf_dir), SearchFilters(org_id=ORG, connectors=ALL_CONNECTORS), n=5)
    return hits.select(F.col("rank").cast("long"), "item_id", "document_id", _r6("distance"))


# ---------------------------------------------------------------- knn_best_n
def knn_best_n(spark: SparkSession, sf_dir: str, method: str = "arrow") -> DataFrame:
    hits = S.search_best(gold_items(spark, sf_dir), gold_documents(spark, sf_dir), query_vector(spark, sf_dir),
                         SearchFilters(org_id=ORG, connectors=ALL_CONNECTORS), n=5, method=method)
    return hits.select(F.col("rank").cast("long"), "item_id", "document_id", _r6("distance"))


SQL["knn_best_n"] = with_ctes(["g_documents", "g_items"], f"""
, cand AS (
  SELECT i.id AS item_id, i.document_id, {_sql_dist()} AS distance
  FROM g_items i WHERE i.{_sql_doc_filter("org_id = 1 AND connector_id IN (1,2,3,4,5)")}
), ranked AS (SELECT *, row_number() OVER (ORDER BY distance, item_id) AS rank FROM cand)
SELECT CAST(rank AS BIGINT) AS rank, item_id, document_id, round(distance, 6) AS distance
FROM ranked WHERE rank <= 5""")
SQL["knn_best_n_pruned"] = SQL["knn_best_n"]


# ---------------------------------------------------------------- alphabetical_pinned
def alphabetical_pinned(spark: SparkSession, sf_dir: str, method: str = "arrow") -> DataFrame:
    docs = gold_documents(spark, sf_dir)
    hits = S.search(gold_items(spark, sf_dir), docs, query_vector(spark, sf_dir),
                    SearchFilters(org_id=ORG, connectors=ALL_CONNECTORS), threshold=0.7, limit=TOP_K,
                    method=method)
    return S.alphabetical(hits, docs).select(
        F.col("position").cast("long"), F.col("rank").cast("long"), "item_id", "title", _r6("distance"))


SQL["alphabetical_pinned"] = with_ctes(["g_documents", "g_items"], f"""
, cand AS (
  SELECT i.id AS item_id, i.document_id, {_sql_dist()} AS distance
  FROM g_items i WHERE i.{_sql_doc_filter("org_id = 1 AND connector_id IN (1,2,3,4,5)")}
), best AS (
  SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY distance, item_id) AS rn
  FROM cand WHERE distance < 1.4
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY distance, item_id) AS rank FROM best WHERE rn = 1
), top AS (
  SELECT r.*, d.title, json_extract_string(d.data, '$.node_id') AS node_id
  FROM ranked r JOIN g_documents d ON d.id = r.document_id WHERE rank <= 10
)
SELECT CAST(row_number() OVER (ORDER BY CASE WHEN rank = 1 THEN 0 ELSE 1 END, title,
                                        node_id ASC NULLS FIRST, rank) AS BIGINT) AS position,
       CAST(rank AS BIGINT) AS rank, item_id, title, round(distance, 6) AS distance
FROM top""")


# ---------------------------------------------------------------- document filters
# Each filter query lists every gold document passing one B-predicate (whole table).
FILTER_CASES: dict[str, tuple[SearchFilters, str]] = {
    "filter_tags": (
        SearchFilters(connectors=ALL_CONNECTORS, tags={"source": ["src3", "src7"], "lang": ["xx"]}),
        "list_has_any(tags, ['\"source\".\"src3\"', '\"source\".\"src7\"', '\"lang\".\"xx\"'])"),
    "filter_connectors": (
        SearchFilters(org_id=2, connectors=[2, 4]),
        "org_id = 2 AND connector_id IN (2, 4)"),
    "filter_languages": (
        SearchFilters(connectors=ALL_CONNECTORS, languages=["e", "fr"]),
        "(starts_with(language, 'e') OR starts_with(language, 'fr'))"),
    "filter_tree_ids": (
        SearchFilters(connectors=ALL_CONNECTORS, zt_connector_id=1, zt_tree_ids=[3, 7]),
        "(connector_id <> 1 OR CAST(json_extract(data, '$.tree_id') AS VARCHAR) IN ('\"3000\"', '\"7000\"'))"),
    "filter_tree_tags": (
        SearchFilters(connectors=ALL_CONNECTORS, zt_connector_id=1, zt_tags=["tt2", "tt5"]),
        "(connector_id <> 1 OR list_has_any(tags, "
        "['\"zt_trees_trees\".\"tt2\"', '\"zt_trees_trees\".\"tt5\"']))"),
    "filter_content_scope": (
        SearchFilters(connectors=ALL_CONNECTORS, content_scope=[
            ScopeSource(2, "show", ['"lang"."en"', '"lang"."de"']),
            ScopeSource(3, "hide", ['"source"."src1"']),
            ScopeSource(4, "hide", []),
            ScopeSource(5, "show", []),
        ]),
        "((connector_id = 2 AND list_has_any(tags, ['\"lang\".\"en\"', '\"lang\".\"de\"']))"
        " OR (connector_id = 3 AND NOT list_has_any(tags, ['\"source\".\"src1\"']))"
        " OR connector_id = 4) AND connector_id <> 5"),
}

# B6 matrix over the derived `data` JSON ({"bucket": int, "source": str, "tree_id": str}).
JSON_CASES: list[tuple[str, dict, str]] = [
    ("none", {}, "TRUE"),
    ("missing_key", {"absent": "src1"}, "FALSE"),
    ("str_eq", {"source": "src3"}, "jt(data,'source') = '\"src3\"'"),
    ("str_wrong", {"source": "src"}, "jt(data,'source') = '\"src\"'"),
    ("int_eq", {"bucket": 3}, "jt(data,'bucket') = '3'"),
    ("int_as_str", {"bucket": "3"}, "jt(data,'bucket') = '\"3\"'"),
    ("str_and_int", {"source": "src3", "bucket": 3},
     "jt(data,'source') = '\"src3\"' AND jt(data,'bucket') = '3'"),
    ("int_list", {"bucket": [1, 2]}, "jt(data,'bucket') IN ('1','2')"),
    ("int_list_on_str", {"tree_id": [3000, 5000]}, "jt(data,'tree_id') IN ('3000','5000')"),
    ("str_list", {"tree_id": ["3000", "5000"]}, "jt(data,'tree_id') IN ('\"3000\"','\"5000\"')"),
    ("str_list_on_int", {"bucket": ["1", "2"]}, "jt(data,'bucket') IN ('\"1\"','\"2\"')"),
    ("empty_list", {"bucket": []}, "FALSE"),
    ("unsupported_float", {"bucket": 1.5}, "TRUE"),
    ("unsupported_dict", {"source": {"a": "b"}, "bucket": 4}, "jt(data,'bucket') = '4'"),
    ("unsupported_list_of_dict", {"source": [{"a": 1}]}, "TRUE"),
]


def _filter_query(f: SearchFilters):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = gold_documents(spark, sf_dir)
        return d.where(filter_predicate(f)).select("id", "connector_id", "language")
    return run


def _filter_sql(pred: str) -> str:
    return with_ctes(["g_documents"], f"\nSELECT id, connector_id, language FROM g_documents WHERE {pred}")


def filter_json_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The B6 matrix over every document in one scan: each case is a boolean
    predicate, and a document row is emitted once per case it passes."""
    import warnings
    d = gold_documents(spark, sf_dir).where(F.col("connector_id").isin(ALL_CONNECTORS))
    labels = []
    for name, data, _ in JSON_CASES:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            pred = filter_predicate(SearchFilters(connectors=ALL_CONNECTORS, data=data))
        labels.append(F.when(pred, F.lit(name)))
    hits = F.filter(F.array(*labels), lambda x: x.isNotNull())
    return d.select(F.explode(hits).alias("case_name"), "id")


def _jt_sql(expr: str) -> str:
    import re
    return re.sub(r"jt\(data,'([^']+)'\)", r"CAST(json_extract(data, '$.\1') AS VARCHAR)", expr)


SQL["filter_json_data"] = with_ctes(["g_documents"], "\n" + "\nUNION ALL\n".join(
    f"SELECT '{name}' AS case_name, id FROM g_documents WHERE connector_id IN (1,2,3,4,5) "
    f"AND COALESCE({_jt_sql(pred)}, FALSE)"
    for name, _, pred in JSON_CASES))


QUERIES = {
    "knn_best_per_doc": knn_best_per_doc,
    "knn_threshold": knn_threshold,
    "knn_search_table": knn_search_table,
    "knn_pruned": knn_pruned,
    "knn_best_n_pruned": knn_best_n_pruned,
    "knn_best_n": knn_best_n,
    "alphabetical_pinned": alphabetical_pinned,
    "filter_json_data": filter_json_data,
}
for _name, (_f, _pred) in FILTER_CASES.items():
    QUERIES[_name] = _filter_query(_f)
    SQL[_name] = _filter_sql(_pred)
