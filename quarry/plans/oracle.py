"""DuckDB SQL mirrors of the derived tables (``quarry.sources.derived``).

Used by ``oracle_sql()`` so the oracle derives gold from the same input views
the Spark queries read. Keep each CTE in step with its Spark twin.
"""

from __future__ import annotations

CTES: dict[str, str] = {}

CTES["g_documents"] = """
g_documents AS (
  SELECT doc_id AS id,
         CAST(doc_id % 3 + 1 AS INTEGER) AS org_id,
         lang AS language,
         concat_ws(' ', source, lang, CAST(doc_id AS VARCHAR)) AS title,
         text AS description,
         ['"source"."' || source || '"', '"lang"."' || lang || '"',
          '"zt_trees_trees"."tt' || CAST(doc_id % 7 AS VARCHAR) || '"'] AS tags,
         '{"bucket":' || CAST(n_chars % 10 AS VARCHAR) || ',"source":"' || source
           || '","tree_id":"' || CAST((doc_id % 20) * 1000 AS VARCHAR) || '"}' AS data,
         CAST(doc_id % 5 + 1 AS INTEGER) AS connector_id,
         't' || CAST(doc_id % 20 AS VARCHAR) || '::' || CAST(doc_id AS VARCHAR) AS document_id,
         TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(doc_id % 365 AS INTEGER)) AS created_at,
         TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(doc_id % 365 AS INTEGER))
           + to_hours(CAST(doc_id % 7 AS INTEGER)) AS updated_at
  FROM documents
)"""

CTES["g_items"] = """
g_items AS (
  SELECT vec_id AS id, embedding AS embeddings, vec_id // 5 AS document_id FROM embeddings
)"""

CTES["connectors"] = """
connectors AS (
  SELECT org_id, connector_id AS id, 'connector-' || CAST(connector_id AS VARCHAR) AS name,
         CASE connector_id WHEN 1 THEN 'zingtree' WHEN 2 THEN 'kb_articles' WHEN 3 THEN 'html_pages'
              WHEN 4 THEN 'kb_articles' WHEN 5 THEN 'html_pages' ELSE 'external' END AS provider,
         connector_id <> 5 AS active, NOT (org_id = 3 AND connector_id IN (3, 5)) AS type_active
  FROM (SELECT DISTINCT org_id, connector_id FROM g_documents)
)"""

# Dependencies between CTEs (emitted in this order).
DEPS = {
    "connectors": ["g_documents"],
}


def with_ctes(names: list[str], body: str) -> str:
    order: list[str] = []

    def add(n):
        for d in DEPS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(CTES[n].strip() for n in order) + "\n" + body


def query_vector_sql(vec_id: int = 0) -> str:
    return f"(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = {vec_id})"

CTES["widgets"] = """
widgets AS (
  SELECT 'dep-' || CAST(user_id AS VARCHAR) AS deployment_id, CAST(user_id % 3 + 1 AS INTEGER) AS org_id,
         user_id % 10 <> 9 AS active, user_id % 2 = 0 AS enable_trees, user_id % 3 <> 0 AS enable_external,
         user_id % 4 = 0 AS all_trees,
         [CAST(user_id % 20 AS INTEGER), CAST((user_id + 7) % 20 AS INTEGER)] AS tree_ids,
         [CAST(user_id % 4 + 2 AS INTEGER), CAST(5 - user_id % 3 AS INTEGER)] AS external_ids,
         user_id
  FROM (SELECT DISTINCT user_id FROM events)
)"""

CTES["agent_tags"] = """
agent_tags AS (
  SELECT user_id AS agent_id,
         CASE WHEN user_id % 10 = 0 THEN []::VARCHAR[] ELSE ['tt' || CAST(user_id % 7 AS VARCHAR)] END AS tags
  FROM (SELECT DISTINCT user_id FROM events) WHERE user_id % 5 = 0
)"""

CTES["search_requests"] = """
search_requests AS (
  SELECT event_id AS request_id, CAST(user_id % 3 + 1 AS INTEGER) AS org_id,
         'dep-' || CAST(user_id AS VARCHAR) AS deployment_id,
         CASE WHEN event_type = 'view' THEN NULL WHEN event_type = 'purchase' THEN []::INTEGER[]
              WHEN event_type = 'click' THEN [2, 3] ELSE [1, 2, 3, 4, 5] END AS connectors,
         CASE WHEN event_type IN ('click', 'error') THEN 't' || CAST(CAST(json_extract(props, '$.k') AS INTEGER) % 4 AS VARCHAR)
              END AS team_param,
         event_type, user_id AS causer_id,
         CASE WHEN user_id % 5 = 0 THEN 'App\\Models\\Agent' ELSE 'App\\Models\\User' END AS causer_type
  FROM events
)"""


def json_quote_sql(x: str) -> str:
    return ("'\"' || replace(replace(replace(" + x + ", '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n') || '\"'")


_OPS = ["fix-grammar", "summarize", "summarize-into-steps", "change-tone", "translate",
        "improve-writing", "reduce-reading-complexity", "reduce-reading-time", "expand-writing"]
_OPS_SQL = "[" + ", ".join(f"'{o}'" for o in _OPS) + "]"

CTES["usage_log"] = f"""
usage_log AS (
  SELECT conv_id * 1000 + turn AS id,
         CASE WHEN role = 'user' THEN {_OPS_SQL}[conv_id % 9 + 1] ELSE 'moderation' END AS operation,
         {json_quote_sql("text")} AS input,
         CASE WHEN role = 'user' THEN {json_quote_sql("text")}
              WHEN length(text) % 5 = 0 THEN '"true"' ELSE '"false"' END AS output,
         'chain-' || CAST(conv_id AS VARCHAR) AS chain_id,
         {_OPS_SQL}[conv_id % 9 + 1] AS chain_operation,
         conv_id % 17 AS user_id, CAST(conv_id % 3 + 1 AS INTEGER) AS org_id, conv_id % 5 AS project_id,
         TIMESTAMP '2024-01-01 00:00:00' + to_seconds(conv_id * 3600 + turn * 60) AS created_at
  FROM conversations
)"""

CTES["sessions"] = """
sessions AS (
  SELECT 's-' || CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y%m%d') AS id, user_id AS causer_id,
         CASE WHEN user_id % 5 = 0 THEN 'App\\Models\\Agent' ELSE 'App\\Models\\User' END AS causer_type,
         min(ts) AS created_at, CAST(user_id % 3 + 1 AS INTEGER) AS org_id,
         'dep-' || CAST(user_id AS VARCHAR) AS deployment_id
  FROM events GROUP BY 1, 2
)"""

CTES["session_events"] = """
session_events AS (
  SELECT event_id AS id, event_type AS operation, ts AS created_at, props AS data, user_id, value,
         's-' || CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y%m%d') AS semantic_search_sessions_id
  FROM events
)"""
