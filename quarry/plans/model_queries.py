"""Registered model-backed queries (K1-K8, E9, E10, H22, B24) and oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import models as M
from quarry.operators import search as S
from quarry.operators.filters import SearchFilters
from quarry.sources.derived import gold_documents, gold_items
from quarry.sources.tables import table

SQL: dict[str, str] = {}
ALL_CONNECTORS = [1, 2, 3, 4, 5]
K = 5


def query_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search requests carrying a vector: every embedding labelled 0 is a query,
    issued by the org of its document."""
    e = table(spark, sf_dir, "embeddings").where(F.col("label") == 0)
    return e.select(F.col("vec_id").alias("query_id"),
                    ((F.col("vec_id") / 5).cast("long") % 3 + 1).cast("int").alias("org_id"), "embedding")


def _items_with_org(spark, sf_dir):
    return gold_items(spark, sf_dir)


def batch_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = S.batch_search(_items_with_org(spark, sf_dir), gold_documents(spark, sf_dir), query_set(spark, sf_dir),
                          SearchFilters(connectors=ALL_CONNECTORS), threshold=0.7, k=K)
    return hits.select("query_id", F.col("rank").cast("long").alias("rank"), "item_id", "document_id",
                       F.round("distance", 6).alias("distance"))


_Q_SQL = """
WITH q AS (SELECT vec_id AS query_id, (vec_id // 5) % 3 + 1 AS org_id, embedding::DOUBLE[] AS qv FROM embeddings WHERE label = 0)
, docs AS (SELECT doc_id AS id, doc_id % 3 + 1 AS org_id FROM documents WHERE doc_id % 5 + 1 IN (1,2,3,4,5))
, cand AS (
  SELECT q.query_id, e.vec_id AS item_id, e.vec_id // 5 AS document_id,
         1 - list_cosine_similarity(e.embedding::DOUBLE[], q.qv) AS distance
  FROM q JOIN docs d ON d.org_id = q.org_id JOIN embeddings e ON e.vec_id // 5 = d.id)"""

SQL["batch_knn"] = _Q_SQL + f"""
, best AS (SELECT *, row_number() OVER (PARTITION BY query_id, document_id ORDER BY distance, item_id) AS rn
           FROM cand WHERE distance < 1.4)
, ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, item_id) AS rank FROM best WHERE rn = 1)
SELECT query_id, CAST(rank AS BIGINT) AS rank, item_id, document_id, round(distance, 6) AS distance
FROM ranked WHERE rank <= {K}"""


def context_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E9 over G2: per query, the snippets of its 5 closest chunks (no per-document
    dedup, no threshold) joined by a space in rank order."""
    q = query_set(spark, sf_dir)
    items = gold_items(spark, sf_dir, with_text=True)
    hits = S.batch_search(items, gold_documents(spark, sf_dir), q, SearchFilters(connectors=ALL_CONNECTORS),
                          threshold=None, k=K, dedup=False)
    snip = items.select(F.col("id").alias("item_id"), "snippet")
    return (hits.join(snip, "item_id")
            .groupBy("query_id")
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "snippet"))),
                                          lambda x: x["snippet"]), " ").alias("context"),
                 F.count(F.lit(1)).alias("n_options")))


SQL["context_assembly"] = _Q_SQL.replace("WITH q AS", "WITH q AS", 1) + f"""
, ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, item_id) AS rank
             FROM cand WHERE NOT isnan(distance))
, top AS (SELECT r.query_id, r.rank, substr(d.text, CAST((r.item_id % 5) * ((length(d.text) + 4) // 5) + 1 AS INTEGER), CAST((length(d.text) + 4) // 5 AS INTEGER)) AS snippet
          FROM ranked r LEFT JOIN documents d ON d.doc_id = r.document_id WHERE rank <= {K})
SELECT query_id, string_agg(snippet, ' ' ORDER BY rank) AS context, count(*) AS n_options FROM top GROUP BY query_id"""


def batch_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1 over every document description (the whole text)."""
    d = gold_documents(spark, sf_dir).select("id", "description")
    e = M.embed(d, "description", 64)
    return e.select("id", F.size("embedding").cast("long").alias("dims"), "embed_error",
                    F.round(F.aggregate("embedding", F.lit(0.0).cast("double"),
                                        lambda a, x: a + x.cast("double") * x.cast("double")), 4).alias("sq_norm"))


SQL["batch_embed"] = """
SELECT doc_id AS id, CASE WHEN length(text) > 0 THEN CAST(64 AS BIGINT) END AS dims,
       CASE WHEN coalesce(length(text), 0) = 0 THEN 'empty text' END AS embed_error,
       CASE WHEN length(text) > 0 THEN CAST(1 AS DOUBLE) END AS sq_norm FROM documents"""


def moderation_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K6 + B24 over every document text: passed / violation (error 4019)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    passed, viol = M.moderation_gate(d, "text")
    return (passed.select("doc_id", F.lit("pass").alias("outcome"), F.lit(None).cast("int").alias("error_code"))
            .unionByName(viol.select("doc_id", F.lit("violation").alias("outcome"), "error_code")))


SQL["moderation_gate"] = f"""
SELECT doc_id, CASE WHEN regexp_matches(text, '{M.BLOCKED_PATTERN.replace("(?i)", "")}', 'i') THEN 'violation' ELSE 'pass' END AS outcome,
       CASE WHEN regexp_matches(text, '{M.BLOCKED_PATTERN.replace("(?i)", "")}', 'i') THEN {M.VIOLATION_ERROR} END AS error_code
FROM documents"""

QUERIES = {
    "batch_knn": batch_knn,
    "context_assembly": context_assembly,
    "batch_embed": batch_embed,
    "moderation_gate": moderation_gate,
}


# ---------------------------------------------------------------- authoring
def authoring_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One authoring request per user turn of a conversation."""
    from quarry.sources.derived import AUTHORING_OPERATIONS
    cv = table(spark, sf_dir, "conversations").where(F.col("role") == "user")
    ops = F.array(*[F.lit(o) for o in AUTHORING_OPERATIONS])
    c = F.col("conv_id")
    return cv.select(
        (c * 1000 + F.col("turn")).alias("request_id"),
        F.element_at(ops, (c % 9 + 1).cast("int")).alias("operation"),
        F.col("text"),
        F.element_at(F.array(F.lit("friendly"), F.lit("formal"), F.lit("casual")), (c % 3 + 1).cast("int")).alias("tone"),
        F.element_at(F.array(F.lit("en"), F.lit("fr"), F.lit("de"), F.lit("es")), (c % 4 + 1).cast("int")).alias("language"))


def _tmpl_sql() -> str:
    rows = []
    for op, kind, system, user in M.DEFAULT_TEMPLATES:
        q = lambda s: "NULL" if s is None else "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
        rows.append(f"('{op}', '{kind}', {q(system)}, {q(user)})")
    return "tmpl(operation, kind, system, user_t) AS (VALUES " + ", ".join(rows) + ")"


_REQ_SQL = """
, ops AS (SELECT ['fix-grammar','summarize','summarize-into-steps','change-tone','translate','improve-writing',
                  'reduce-reading-complexity','reduce-reading-time','expand-writing'] AS o)
, req AS (
  SELECT conv_id * 1000 + turn AS request_id, (SELECT o FROM ops)[conv_id % 9 + 1] AS operation, text,
         ['friendly','formal','casual'][conv_id % 3 + 1] AS tone, ['en','fr','de','es'][conv_id % 4 + 1] AS language
  FROM conversations WHERE role = 'user')
, rendered AS (
  SELECT r.*, t.kind,
         CASE WHEN t.kind = 'chat'
              THEN replace(replace(replace(t.user_t, '{{text}}', coalesce(r.text, '')), '{{tone}}', coalesce(r.tone, '')),
                           '{{language}}', coalesce(r.language, ''))
              ELSE replace(t.user_t, '{{text}}', coalesce(r.text, '')) END AS prompt
  FROM req r LEFT JOIN tmpl t USING (operation))"""


def prompt_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = M.render_prompts(authoring_requests(spark, sf_dir), M.templates(spark))
    return r.select("request_id", "operation", "prompt",
                    F.size(F.coalesce("messages", F.array())).cast("long").alias("n_messages"))


SQL["prompt_render"] = "WITH " + _tmpl_sql() + _REQ_SQL + """
SELECT request_id, operation, prompt, CAST(CASE WHEN kind = 'chat' THEN 2 ELSE 0 END AS BIGINT) AS n_messages FROM rendered"""


def author_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = M.author(authoring_requests(spark, sf_dir), M.templates(spark))
    return a.select("request_id", "operation", "output", "status", "error_code", F.col("steps").cast("long"))


_BLOCK = M.BLOCKED_PATTERN.replace("(?i)", "")
SQL["author_chain"] = "WITH " + _tmpl_sql() + _REQ_SQL + f"""
, ans AS (SELECT *, regexp_replace(string_split(prompt, chr(10) || chr(10))[-1], '^\\s+|\\s+$', '', 'g') AS answer,
                 regexp_matches(coalesce(text, ''), '{_BLOCK}', 'i') AS pre_flag FROM rendered)
, fl AS (SELECT *, regexp_matches(coalesce(answer, ''), '{_BLOCK}', 'i') AS post_flag FROM ans)
SELECT request_id, operation,
       CASE WHEN (operation = 'translate' AND pre_flag) OR (operation <> 'translate' AND post_flag) THEN NULL ELSE answer END AS output,
       CASE WHEN (operation = 'translate' AND pre_flag) OR (operation <> 'translate' AND post_flag) THEN 'violation' ELSE 'ok' END AS status,
       CASE WHEN (operation = 'translate' AND pre_flag) OR (operation <> 'translate' AND post_flag) THEN {M.VIOLATION_ERROR} END AS error_code,
       CAST(CASE WHEN operation = 'translate' AND pre_flag THEN 1 ELSE 2 END AS BIGINT) AS steps
FROM fl"""


def author_usage_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K8: the usage-log rows the chains write."""
    rows = M.usage_rows(M.author(authoring_requests(spark, sf_dir), M.templates(spark)))
    return rows.select("chain_id", F.col("step").cast("long").alias("step"), "operation", "chain_operation",
                       "input", "output")


SQL["author_usage_log"] = "WITH " + _tmpl_sql() + _REQ_SQL + f"""
, ans AS (SELECT *, regexp_replace(string_split(prompt, chr(10) || chr(10))[-1], '^\\s+|\\s+$', '', 'g') AS answer,
                 regexp_matches(coalesce(text, ''), '{_BLOCK}', 'i') AS pre_flag FROM rendered)
, fl AS (SELECT *, regexp_matches(coalesce(answer, ''), '{_BLOCK}', 'i') AS post_flag,
                'chain-' || CAST(request_id AS VARCHAR) AS chain_id FROM ans)
, steps AS (
  SELECT chain_id, 0 AS step, operation AS op, operation AS chain_operation, text AS inp,
         to_json(answer)::VARCHAR AS output FROM fl WHERE operation <> 'translate'
  UNION ALL
  SELECT chain_id, 1, 'moderation', operation, answer,
         CASE WHEN post_flag THEN '"true"' ELSE '"false"' END FROM fl WHERE operation <> 'translate'
  UNION ALL
  SELECT chain_id, 0, 'moderation', operation, text,
         CASE WHEN pre_flag THEN '"true"' ELSE '"false"' END FROM fl WHERE operation = 'translate'
  UNION ALL
  SELECT chain_id, 1, operation, operation, text, to_json(answer)::VARCHAR FROM fl
  WHERE operation = 'translate' AND NOT pre_flag)
SELECT chain_id, CAST(step AS BIGINT) AS step, op AS operation, chain_operation,
       to_json(inp)::VARCHAR AS input, output FROM steps"""


# ---------------------------------------------------------------- K4 / E10
def summarize_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    ctx = context_assembly(spark, sf_dir)
    q = query_set(spark, sf_dir).select("query_id")
    c = q.join(ctx, "query_id", "left").withColumn(
        "question", F.concat(F.lit("what about "), F.col("query_id").cast("string")))
    return M.summarize_answers(c).select("query_id", "answer")


SQL["summarize_answers"] = SQL["context_assembly"].replace(
    "SELECT query_id, string_agg(snippet, ' ' ORDER BY rank) AS context, count(*) AS n_options FROM top GROUP BY query_id",
    """, ctx AS (SELECT query_id, string_agg(snippet, ' ' ORDER BY rank) AS context FROM top GROUP BY query_id)
SELECT q.query_id, CASE WHEN ctx.context IS NULL THEN 'There is no context to answer this question.'
  ELSE regexp_replace(string_split('Question: what about ' || CAST(q.query_id AS VARCHAR) || chr(10) || chr(10) || ctx.context,
                                   chr(10) || chr(10))[-1], '^\\s+|\\s+$', '', 'g') END AS answer
FROM q LEFT JOIN ctx USING (query_id)""")


def search_session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One analytics event per batch search request."""
    from quarry.operators.sessions import search_event_payload
    q = query_set(spark, sf_dir)
    hits = S.batch_search(gold_items(spark, sf_dir), gold_documents(spark, sf_dir), q,
                          SearchFilters(connectors=ALL_CONNECTORS), threshold=0.7, k=K)
    req = q.select("query_id", F.concat(F.lit("q"), F.col("query_id").cast("string")).alias("query"),
                   F.lit(K).alias("limit")).withColumnRenamed("query_id", "request_id")
    ev = search_event_payload(hits.withColumnRenamed("query_id", "request_id"), req,
                              gold_documents(spark, sf_dir), gold_items(spark, sf_dir, with_text=True))
    return ev.select(F.col("request_id").alias("query_id"), "message", "n_options")


SQL["search_session_events"] = SQL["batch_knn"].replace(
    f"""SELECT query_id, CAST(rank AS BIGINT) AS rank, item_id, document_id, round(distance, 6) AS distance
FROM ranked WHERE rank <= {K}""",
    f""", hits AS (SELECT query_id, count(*) AS n FROM ranked WHERE rank <= {K} GROUP BY query_id)
SELECT q.query_id, 'Found ' || CAST(coalesce(h.n, 0) AS VARCHAR) || ' options for q' || CAST(q.query_id AS VARCHAR) AS message,
       CAST(coalesce(h.n, 0) AS BIGINT) AS n_options
FROM q LEFT JOIN hits h USING (query_id)""")

QUERIES.update({
    "prompt_render": prompt_render,
    "author_chain": author_chain,
    "author_usage_log": author_usage_log,
    "summarize_answers": summarize_answers,
    "search_session_events": search_session_events,
})


# ---------------------------------------------------------------- L1 batch
def search_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1 for a batch of requests: every click event is a search request; its filters
    are resolved against widget and connector dimensions (C1-C5), its vector is an
    embedding chosen by request id, and it gets its top-5 documents (best chunk each,
    under the threshold) under all of its own filters: org, connectors, tree ids, agent tags,
    content scope, and the tags, languages and data that some requests ask for."""
    from quarry.operators.resolve import resolve_filters
    from quarry.sources.derived import agent_tags, connectors, search_requests, widgets
    reqs = search_requests(spark, sf_dir).join(
        table(spark, sf_dir, "events").where(F.col("event_type") == "click")
        .select(F.col("event_id").alias("request_id")), "request_id", "left_semi")
    res = resolve_filters(reqs, widgets(spark, sf_dir), connectors(spark, sf_dir), agent_tags(spark, sf_dir)) \
        .where(F.col("status") == "ok")
    emb = table(spark, sf_dir, "embeddings")
    n_vec = emb.agg(F.count(F.lit(1))).first()[0]  # one scalar
    r = F.col("request_id")
    q = res.join(emb.select(F.col("vec_id").alias("_v"), "embedding"), (r % F.lit(n_vec)) == F.col("_v")).select(
        r.alias("query_id"), "org_id", "embedding", "connectors", "zt_connector_id", "zt_tree_ids", "zt_tags", "scope_sources",
        F.when(r % 5 == 1, F.array(F.concat(F.lit('"source"."src'), (r % 20).cast("string"), F.lit('"')), F.lit('"lang"."en"'))).alias("tags"),
        F.when(r % 3 == 1, F.array(F.lit("en"), F.lit("f"))).alias("languages"),
        F.when(r % 7 == 2, F.lit('{"bucket": [1, 2, 3, 4, 5, 6]}')).when(r % 7 == 4, F.lit('{"source": "src0", "none": {"no": 1}}')).alias("data"))
    hits = S.batch_search(gold_items(spark, sf_dir), gold_documents(spark, sf_dir), q,
                          SearchFilters(connectors=ALL_CONNECTORS), threshold=0.7, k=K)
    return hits.select(F.col("query_id").alias("request_id"), F.col("rank").cast("long"), "item_id",
                       "document_id", F.round("distance", 6).alias("distance"))


def _search_batch_sql() -> str:
    from quarry.plans.catalog_queries import _W_SQL
    from quarry.plans.oracle import with_ctes
    return with_ctes(["g_documents", "connectors", "widgets", "agent_tags", "search_requests"], _W_SQL + f"""
, nv AS (SELECT count(*) AS n FROM embeddings)
, req AS (
  SELECT r.request_id, r.org_id,
         CASE WHEN r.connectors IS NULL THEN rw.widget_connectors
              ELSE list_sort(list_intersect(rw.widget_connectors, r.connectors)) END AS conns,
         rw.zt_connector_id, rw.zt_tree_ids, rw.user_id,
         CASE WHEN r.team_param = 't' || CAST(rw.user_id % 4 AS VARCHAR) THEN 'a'
              WHEN r.team_param = 't' || CAST((rw.user_id + 1) % 4 AS VARCHAR) THEN 'b' END AS scope,
         CASE WHEN r.causer_type = 'App\\Models\\Agent' AND len(a.tags) > 0 THEN a.tags END AS zt_tags
  FROM search_requests r JOIN rw ON rw.deployment_id = r.deployment_id AND rw.org_id = r.org_id
  LEFT JOIN agent_tags a ON a.agent_id = r.causer_id
  WHERE r.event_type = 'click')
, q AS (SELECT req.*, e.embedding::DOUBLE[] AS qv FROM req JOIN embeddings e ON e.vec_id = req.request_id % (SELECT n FROM nv))
, cand AS (
  SELECT q.request_id, i.vec_id AS item_id, i.vec_id // 5 AS document_id,
         1 - list_cosine_similarity(i.embedding::DOUBLE[], q.qv) AS distance
  FROM q JOIN g_documents d ON d.org_id = q.org_id AND list_contains(q.conns, d.connector_id)
         AND (q.zt_connector_id IS NULL OR q.zt_tree_ids IS NULL OR d.connector_id <> q.zt_connector_id
              OR list_contains(list_transform(q.zt_tree_ids, lambda t: '"' || CAST(t * 1000 AS VARCHAR) || '"'),
                               CAST(json_extract(d.data, '$.tree_id') AS VARCHAR)))
         AND (q.zt_connector_id IS NULL OR q.zt_tags IS NULL OR d.connector_id <> q.zt_connector_id
              OR list_has_any(d.tags, list_transform(q.zt_tags, lambda t: '"zt_trees_trees"."' || t || '"')))
         AND (q.request_id % 5 <> 1 OR list_has_any(d.tags, ['"source"."src' || CAST(q.request_id % 20 AS VARCHAR) || '"', '"lang"."en"']))
         AND (q.request_id % 3 <> 1 OR d.language LIKE 'en%' OR d.language LIKE 'f%')
         AND (q.request_id % 7 <> 2 OR CAST(json_extract(d.data, '$.bucket') AS INTEGER) IN (1, 2, 3, 4, 5, 6))
         AND (q.request_id % 7 <> 4 OR json_extract_string(d.data, '$.source') = 'src0')
         AND (q.scope IS NULL
              OR (q.scope = 'a' AND (d.connector_id = 3 OR (d.connector_id = 2 AND list_contains(d.tags, '"lang"."en"'))))
              OR (q.scope = 'b' AND d.connector_id = 4 AND d.connector_id <> 1
                  AND NOT list_contains(d.tags, '"source"."src' || CAST(q.user_id % 20 AS VARCHAR) || '"')))
  JOIN embeddings i ON i.vec_id // 5 = d.id)
, best AS (SELECT *, row_number() OVER (PARTITION BY request_id, document_id ORDER BY distance, item_id) AS rn
           FROM cand WHERE distance < 1.4)
, ranked AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY distance, item_id) AS rank
             FROM best WHERE rn = 1)
SELECT request_id, CAST(rank AS BIGINT) AS rank, item_id, document_id, round(distance, 6) AS distance
FROM ranked WHERE rank <= {K}""")


SQL["search_batch"] = _search_batch_sql()
QUERIES["search_batch"] = search_batch
