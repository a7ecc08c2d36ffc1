"""Registered catalog and filter-resolution queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import catalog as C
from quarry.operators import pages
from quarry.operators import resolve as R
from quarry.operators.filters import SearchFilters
from quarry.plans.oracle import with_ctes
from quarry.session import ensure_checkpoint_dir
from quarry.sources.derived import agent_tags, connectors, gold_documents, gold_items, search_requests, widgets

ALL_CONNECTORS = [1, 2, 3, 4, 5]
SQL: dict[str, str] = {}


def suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.suggestions(gold_documents(spark, sf_dir), "de",
                         SearchFilters(org_id=1, connectors=ALL_CONNECTORS), limit=10)


SQL["suggestions"] = with_ctes(["g_documents"], """
, base AS (SELECT * FROM g_documents WHERE org_id = 1 AND connector_id IN (1,2,3,4,5))
, t AS (SELECT DISTINCT title AS suggestion, CAST(length(title) AS BIGINT) AS len FROM base
        WHERE title ILIKE '%de%' ORDER BY len, suggestion LIMIT 10)
, d AS (SELECT DISTINCT description AS suggestion, CAST(length(description) AS BIGINT) AS len FROM base
        WHERE description ILIKE '%de%' ORDER BY len, suggestion LIMIT 10)
, u AS (SELECT DISTINCT * FROM (SELECT * FROM t UNION ALL SELECT * FROM d))
SELECT suggestion, len, CAST(rank AS BIGINT) AS rank FROM (
  SELECT *, row_number() OVER (ORDER BY len, suggestion) AS rank FROM u) WHERE rank <= 10""")


def tag_connector_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.tag_connector_counts(gold_documents(spark, sf_dir), org_id=1)


SQL["tag_connector_counts"] = with_ctes(["g_documents"], """
, x AS (SELECT unnest(tags) AS tag, connector_id FROM g_documents WHERE org_id = 1)
SELECT tag, trim(regexp_extract(tag, '"(.*)"\\."(.*)"', 1), '"') AS key,
       trim(regexp_extract(tag, '"(.*)"\\."(.*)"', 2), '"') AS value, connector_id, count(*) AS count
FROM x GROUP BY tag, connector_id""")


def distinct_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.distinct_tags(gold_documents(spark, sf_dir), org_id=1)


SQL["distinct_tags"] = with_ctes(["g_documents"], """
, x AS (SELECT DISTINCT unnest(tags) AS tag FROM g_documents WHERE org_id = 1)
, kv AS (SELECT trim(regexp_extract(tag, '"(.*)"\\."(.*)"', 1), '"') AS key,
                trim(regexp_extract(tag, '"(.*)"\\."(.*)"', 2), '"') AS value FROM x)
SELECT DISTINCT key, value FROM kv""")


def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.languages(gold_documents(spark, sf_dir), org_id=2)


SQL["languages"] = with_ctes(["g_documents"], "\nSELECT DISTINCT language FROM g_documents WHERE org_id = 2")


def documents_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = C.documents_page(gold_documents(spark, sf_dir), org_id=2, connector_id=3, limit=20, offset=40)
    return d.select("id", "document_id", "title", "language")


SQL["documents_page"] = with_ctes(["g_documents"], """
SELECT id, document_id, title, language FROM g_documents WHERE org_id = 2 AND connector_id = 3
ORDER BY id LIMIT 20 OFFSET 40""")


def documents_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G3 by key: the page behind a document id; the scan skips all pages before."""
    d = C.documents_after(gold_documents(spark, sf_dir), org_id=2, connector_id=3, last_id=100, limit=20)
    return d.select("id", "document_id", "title", "language")


SQL["documents_after"] = with_ctes(["g_documents"], """
SELECT id, document_id, title, language FROM g_documents WHERE org_id = 2 AND connector_id = 3 AND id > 100
ORDER BY id LIMIT 20""")


def _resolved(spark, sf_dir):
    return R.resolve_filters(search_requests(spark, sf_dir), widgets(spark, sf_dir),
                             connectors(spark, sf_dir), agent_tags(spark, sf_dir))


def resolve_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _resolved(spark, sf_dir)
    return r.select("request_id", "deployment_id", "status",
                    F.array_join("connectors", ",").alias("connectors"),
                    "zt_connector_id", F.array_join("zt_tree_ids", ",").alias("zt_tree_ids"),
                    "scope_id", F.array_join("zt_tags", ",").alias("zt_tags"))


_W_SQL = """
, act AS (SELECT org_id, id FROM connectors WHERE active AND type_active)
, zt AS (SELECT org_id, min(id) AS zt FROM connectors WHERE active AND type_active AND provider = 'zingtree' GROUP BY org_id)
, aw AS (SELECT widgets.*, zt.zt FROM widgets LEFT JOIN zt USING (org_id) WHERE active)
, wc AS (
  SELECT c.deployment_id, list_sort(list(DISTINCT c.cid)) AS widget_connectors FROM (
    SELECT deployment_id, org_id, unnest(
      (CASE WHEN enable_trees THEN [zt] ELSE []::INTEGER[] END)
      || (CASE WHEN enable_external THEN external_ids ELSE []::INTEGER[] END)) AS cid FROM aw) c
  JOIN act ON act.id = c.cid AND act.org_id = c.org_id GROUP BY c.deployment_id)
, rw AS (
  SELECT aw.*, COALESCE(wc.widget_connectors, []::INTEGER[]) AS widget_connectors,
         CASE WHEN enable_trees THEN zt END AS zt_connector_id,
         CASE WHEN enable_trees AND NOT all_trees THEN tree_ids END AS zt_tree_ids
  FROM aw LEFT JOIN wc USING (deployment_id))"""

SQL["resolve_filters"] = with_ctes(["connectors", "widgets", "agent_tags", "search_requests"], _W_SQL + """
SELECT r.request_id, r.deployment_id,
       CASE WHEN rw.deployment_id IS NULL THEN 'widget_not_found' ELSE 'ok' END AS status,
       array_to_string(CASE WHEN r.connectors IS NULL THEN rw.widget_connectors
            ELSE list_sort(list_intersect(rw.widget_connectors, r.connectors)) END, ',') AS connectors,
       rw.zt_connector_id, array_to_string(rw.zt_tree_ids, ',') AS zt_tree_ids,
       CASE WHEN r.team_param = 't' || CAST(rw.user_id % 4 AS VARCHAR) THEN 'scope-a'
            WHEN r.team_param = 't' || CAST((rw.user_id + 1) % 4 AS VARCHAR) THEN 'scope-b' END AS scope_id,
       CASE WHEN r.causer_type = 'App\\Models\\Agent' AND len(a.tags) > 0 THEN array_to_string(a.tags, ',') END AS zt_tags
FROM search_requests r
LEFT JOIN rw ON rw.deployment_id = r.deployment_id AND rw.org_id = r.org_id
LEFT JOIN agent_tags a ON a.agent_id = r.causer_id""")


def connectors_of_deployment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.deployment_connectors(widgets(spark, sf_dir), connectors(spark, sf_dir))


SQL["connectors_of_deployment"] = with_ctes(["connectors", "widgets"], """
, act AS (SELECT * FROM connectors WHERE active AND type_active)
, aw AS (SELECT * FROM widgets WHERE active)
SELECT DISTINCT deployment_id, connector_id, provider FROM (
  SELECT x.deployment_id, act.id AS connector_id, act.provider
  FROM (SELECT deployment_id, org_id, unnest(external_ids) AS id FROM aw WHERE enable_external) x JOIN act USING (org_id, id)
  UNION ALL
  SELECT aw.deployment_id, act.id, act.provider FROM aw JOIN act
    ON act.org_id = aw.org_id AND act.id = (SELECT min(a.id) FROM act a WHERE a.provider = 'zingtree' AND a.org_id = aw.org_id)
  WHERE aw.enable_trees)""")


def connectors_of_org(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.org_connectors(connectors(spark, sf_dir), org_id=3)


SQL["connectors_of_org"] = with_ctes(["connectors"], """
SELECT id AS connector_id, provider FROM connectors WHERE org_id = 3 AND active AND type_active""")


def has_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.deployments_with_documents(widgets(spark, sf_dir), connectors(spark, sf_dir),
                                        gold_documents(spark, sf_dir))


SQL["has_documents"] = with_ctes(["connectors", "widgets"], _W_SQL + """
SELECT rw.deployment_id, EXISTS (
  SELECT 1 FROM g_documents d WHERE d.org_id = rw.org_id AND list_contains(rw.widget_connectors, d.connector_id)
    AND (d.connector_id <> rw.zt_connector_id OR rw.zt_connector_id IS NULL OR rw.zt_tree_ids IS NULL
         OR list_contains(list_transform(rw.zt_tree_ids, lambda t: '"' || CAST(t * 1000 AS VARCHAR) || '"'),
                          CAST(json_extract(d.data, '$.tree_id') AS VARCHAR)))) AS has_documents
FROM rw""")


def documents_deep_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G3 from the order-statistics index: the last pages of an org."""
    docs = gold_documents(spark, sf_dir)
    table = pages.fresh(docs, f"{ensure_checkpoint_dir(spark).rstrip('/')}/quarry-tables", 32)
    total = table.locate(2, None, 1, 0)[2]
    return table.page(2, None, 25, max(0, total - 60)).select("id", "document_id", "title", "language")


SQL["documents_deep_page"] = with_ctes(["g_documents"], """
, n AS (SELECT greatest(0, count(*) - 60) AS o FROM g_documents WHERE org_id = 2)
, r AS (SELECT *, row_number() OVER (ORDER BY id) AS k FROM g_documents WHERE org_id = 2)
SELECT id, document_id, title, language FROM r, n WHERE k > o AND k <= o + 25""")


QUERIES = {
    "documents_deep_page": documents_deep_page,
    "suggestions": suggestions,
    "tag_connector_counts": tag_connector_counts,
    "distinct_tags": distinct_tags,
    "languages": languages,
    "documents_page": documents_page,
    "documents_after": documents_after,
    "resolve_filters": resolve_filters,
    "connectors_of_deployment": connectors_of_deployment,
    "connectors_of_org": connectors_of_org,
    "has_documents": has_documents,
}


# ---------------------------------------------------------------- lookups / response
def items_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items a request lists (every embedding labelled 1) that belong to org 1."""
    from quarry.sources.tables import table
    ids = table(spark, sf_dir, "embeddings").where(F.col("label") == 1).select(F.col("vec_id").alias("id"))
    return C.items_by_ids(gold_items(spark, sf_dir), gold_documents(spark, sf_dir), ids, org_id=1) \
        .select("id", "document_id")


SQL["items_by_ids"] = with_ctes(["g_documents", "g_items"], """
SELECT id, document_id FROM g_items
WHERE id IN (SELECT vec_id FROM embeddings WHERE label = 1)
  AND document_id IN (SELECT id FROM g_documents WHERE org_id = 1)""")


def tree_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.tree_documents(gold_documents(spark, sf_dir), "t3", org_id=1).select("id", "document_id")


SQL["tree_documents"] = with_ctes(["g_documents"], """
SELECT id, document_id FROM g_documents WHERE starts_with(document_id, 't3::') AND org_id = 1""")


def search_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H23 over the flagship hits: decoded tags and parsed data of each option."""
    from quarry.operators import search as S
    from quarry.plans.search_queries import ALL_CONNECTORS as AC, query_vector
    docs = gold_documents(spark, sf_dir)
    hits = S.search(gold_items(spark, sf_dir), docs,
                    query_vector(spark, sf_dir), SearchFilters(org_id=1, connectors=AC), limit=10)
    ok, _ = C.search_response(hits, docs)
    d = F.col("document")
    return ok.select(F.col("rank").cast("long"), "item_id", d["articleId"].alias("article_id"),
                     F.array_join(F.array_sort(F.map_keys(d["tags"])), ",").alias("tag_keys"),
                     F.array_join(d["tags"]["source"], ",").alias("source_values"),
                     F.variant_get(d["data"], "$.bucket", "int").alias("bucket"))


SQL["search_response"] = with_ctes(["g_documents", "g_items"], """
, cand AS (
  SELECT i.id AS item_id, i.document_id,
         1 - list_cosine_similarity(i.embeddings::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS distance
  FROM g_items i WHERE i.document_id IN (SELECT id FROM g_documents WHERE org_id = 1 AND connector_id IN (1,2,3,4,5)))
, best AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY distance, item_id) AS rn FROM cand)
, ranked AS (SELECT *, row_number() OVER (ORDER BY distance, item_id) AS rank FROM best WHERE rn = 1 AND distance < 1.4)
SELECT CAST(r.rank AS BIGINT) AS rank, r.item_id, d.document_id AS article_id, 'lang,source,zt_trees_trees' AS tag_keys,
       substr(d.tags[1], 11, length(d.tags[1]) - 11) AS source_values,
       CAST(json_extract(d.data, '$.bucket') AS INTEGER) AS bucket
FROM ranked r JOIN g_documents d ON d.id = r.document_id WHERE r.rank <= 10""")

QUERIES.update({"items_by_ids": items_by_ids, "tree_documents": tree_documents, "search_response": search_response})
