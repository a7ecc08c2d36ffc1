"""Registered ingestion queries (I1-I7, H4-H10, H12, H14, H16, H2/H3) and oracle SQL.

Gold pipelines use the character chunker (max 1000), which is what the
reference's own test configuration selects; the sentence chunker has its own
rows-only query and a brute-force property test, because DuckDB's regex
engine has no look-behind for the sentence boundary.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import tags as TG
from quarry.functions.text import html_to_text, normalize_date, printable_ascii, strip_control
from quarry.operators.chunking import chunk
from quarry.plans import ingest as I
from quarry.plans.oracle import with_ctes
from quarry.sources.derived import article_bronze, connectors, html_silver, tree_raw
from quarry.sources.tables import table

SQL: dict[str, str] = {}
TS_FMT = "yyyy-MM-dd HH:mm:ss"
HTML_CONNECTOR = 3
TREE_CONNECTOR = 1
ARTICLE_CFG = I.ChunkConfig("characters", 1000, "suffix")
HTML_CFG = I.ChunkConfig("characters", 1000, "prefix")
TREE_CFG = I.ChunkConfig("characters", 1000, "prefix")

# ---------------------------------------------------------------- SQL building blocks
STRIP_TAGS = "regexp_replace({x}, '<[^>]*>', '', 'g')"
NON_PRINTABLE = "regexp_replace({x}, '[^\\x20-\\x7E\\t\\n\\r\\x0B\\x0C]', '', 'g')"
CONTROL = "regexp_replace({x}, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x{{9F}}]', '', 'g')"


def _iso_norm_sql(x: str) -> str:
    t = f"TRY_CAST(replace({x}, 'Z', '') AS TIMESTAMP)"
    return (f"CASE WHEN {t} IS NOT NULL THEN lpad(CAST(year({t}) AS VARCHAR), 4, '0') || "
            f"strftime({t}, '-%m-%dT%H:%M:%S') || '+00:00' END")


def _page_text_sql(x: str) -> str:
    s = x
    for pat in ["<!--.*?-->", "<script[^>]*>.*?</script>", "<style[^>]*>.*?</style>", "<!DOCTYPE[^>]*>", "<[^>]*>"]:
        s = f"regexp_replace({s}, '{pat}', '', 'gs')"
    for ent, ch in [("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'),
                    ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")]:
        s = f"replace({s}, '{ent}', '{ch}')"
    return s


def _char_chunks_sql(src: str, key_cols: str, mode: str, max_len: int = 1000) -> str:
    """Character chunker over CTE ``src`` with columns (keys..., t, title, ctx)."""
    chunk = {"prefix": "ctx || ' ' || snippet", "suffix": "snippet || ' ' || ctx"}.get(mode, "snippet")
    return f"""
, cp AS (SELECT *, CASE WHEN length(ctx) > 0 THEN {max_len} - length(ctx) - 1 ELSE {max_len} END AS n FROM {src})
, cpieces AS (SELECT {key_cols}, title, ctx, n, unnest(range(0, length(t), n)) AS i, t FROM cp)
, call AS (
  SELECT {key_cols}, CAST(i // n AS INTEGER) AS chunk_no, substr(t, i + 1, n) AS snippet, ctx FROM cpieces
  UNION ALL
  SELECT {key_cols}, CAST((length(t) + n - 1) // n AS INTEGER) AS chunk_no, title AS snippet, NULL AS ctx
  FROM cp WHERE length(title) > 0)
, chunks AS (SELECT {key_cols}, chunk_no, snippet,
                    CASE WHEN ctx IS NULL THEN snippet ELSE {chunk} END AS chunk FROM call)"""


# ---------------------------------------------------------------- H4 / H5 / H6 / H7
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H4 over every page (Arrow UDF around the HTML parser)."""
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", html_to_text(F.col("html")).alias("text"))


SQL["html_text"] = f"SELECT page_id, {_page_text_sql('html')} AS text FROM pages"


def normalize_ascii(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", printable_ascii(F.col("text")).alias("text"))


SQL["normalize_ascii"] = f"SELECT doc_id, {NON_PRINTABLE.format(x='text')} AS text FROM documents"


def normalize_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", strip_control(F.col("text")).alias("text"))


SQL["normalize_control"] = f"SELECT doc_id, {CONTROL.format(x='text')} AS text FROM documents"


def normalize_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = article_bronze(spark, sf_dir)
    return b.select("id", *[normalize_date(F.col(c)).alias(c) for c in ("createdAt", "updatedAt", "publishedAt")])


_ART_DATES_SQL = """
, ab AS (
  SELECT 'a' || CAST(doc_id AS VARCHAR) AS id,
    strftime(TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(doc_id % 365 AS INTEGER)), '%Y-%m-%dT%H:%M:%SZ') AS createdAt,
    CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 13 = 0 THEN '2023-09-11T08:61:52'
         ELSE strftime(TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(doc_id % 365 AS INTEGER))
                       + to_hours(CAST(doc_id % 7 AS INTEGER)), '%Y-%m-%dT%H:%M:%SZ') END AS updatedAt,
    '0001-01-01T00:00:00Z' AS publishedAt
  FROM documents)"""

SQL["normalize_dates"] = ("WITH _x AS (SELECT 1)" + _ART_DATES_SQL + f"""
SELECT id, {_iso_norm_sql('createdAt')} AS createdAt, {_iso_norm_sql('updatedAt')} AS updatedAt,
       {_iso_norm_sql('publishedAt')} AS publishedAt FROM ab""")


# ---------------------------------------------------------------- H2 / H3
def tag_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = article_bronze(spark, sf_dir)
    return b.select("id", F.array_join(TG.encode_pairs(F.col("tags")), "|").alias("tags"))


SQL["tag_encode"] = """
SELECT 'a' || CAST(doc_id AS VARCHAR) AS id, '"source"."' || source || '"|"lang"."' || lang || '"' AS tags FROM documents"""


def tag_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.sources.derived import gold_documents
    d = gold_documents(spark, sf_dir)
    x = d.select("id", F.posexplode("tags").alias("pos", "tag"))
    return x.select("id", F.col("pos").cast("long").alias("pos"), TG.tag_key("tag").alias("key"),
                    TG.tag_value("tag").alias("value"))


SQL["tag_decode"] = with_ctes(["g_documents"], """
, x AS (SELECT id, unnest(tags) AS tag, unnest(range(len(tags))) AS pos FROM g_documents)
SELECT id, CAST(pos AS BIGINT) AS pos, trim(regexp_extract(tag, '"(.*)"\\."(.*)"', 1), '"') AS key,
       trim(regexp_extract(tag, '"(.*)"\\."(.*)"', 2), '"') AS value FROM x""")


# ---------------------------------------------------------------- chunkers over documents
def chunk_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H12/H14 over every document text (ctx = source, prefix mode, max 1000)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.concat_ws(" ", "source", "lang").alias("title"))
    c = chunk(d, "characters", 1000, "prefix", ctx_col=F.col("title"))
    return c.where(F.col("chunk_no").isNotNull()).select("doc_id", "chunk_no", "chunk", "snippet")


SQL["chunk_characters"] = ("WITH src AS (SELECT doc_id, coalesce(text, '') AS t, concat_ws(' ', source, lang) AS title,"
                           " concat_ws(' ', source, lang) AS ctx FROM documents)"
                           + _char_chunks_sql("src", "doc_id", "prefix")
                           + "\nSELECT doc_id, chunk_no, chunk, snippet FROM chunks")


def chunk_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H15/H16 over every document text (sentence packing, max 1000, no context)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.concat_ws(" ", "source", "lang").alias("title"))
    c = chunk(d, "sentences", 1000, None)
    return c.where(F.col("chunk_no").isNotNull()).select("doc_id", "chunk_no", "chunk", "snippet")


# Sentence ends by the characters before each blank, then the packing sentence by sentence.
SQL["chunk_sentences"] = """
WITH RECURSIVE d AS (SELECT doc_id, text, concat_ws(' ', source, lang) AS title, string_split(text, '') AS c FROM documents)
, e AS (
  SELECT doc_id, text, title, list_concat([0], list_filter(range(2, len(c) + 1), lambda i: regexp_full_match(c[i], '\\s') AND c[i - 1] IN ('.', '?', '!')
    AND NOT (i > 4 AND regexp_full_match(c[i - 4], '[\\p{L}\\p{N}_]') AND c[i - 3] = '.' AND regexp_full_match(c[i - 2], '[\\p{L}\\p{N}_]'))
    AND NOT (i > 3 AND c[i - 3] BETWEEN 'A' AND 'Z' AND c[i - 2] BETWEEN 'a' AND 'z' AND c[i - 1] = '.')), [len(c) + 1]) AS cut FROM d)
, k AS (SELECT doc_id, text, cut, unnest(range(1, len(cut))) AS k FROM e)
, s AS (SELECT doc_id, k, substr(text, cut[k] + 1, cut[k + 1] - cut[k] - 1) AS s FROM k)
, p AS (
  SELECT doc_id, CAST(0 AS BIGINT) AS k, '' AS cur, CAST([] AS VARCHAR[]) AS emitted FROM d
  UNION ALL
  SELECT s.doc_id, s.k, CASE WHEN length(s) >= 1000 THEN cur WHEN length(cur) + length(s) > 1000 OR cur = '' THEN s ELSE cur || ' ' || s END,
    CASE WHEN length(s) >= 1000 THEN list_transform(range(0, length(s), 999), lambda x: substr(s, x + 1, 999))
         WHEN length(cur) + length(s) > 1000 AND cur <> '' THEN [cur] ELSE [] END
  FROM p JOIN s ON s.doc_id = p.doc_id AND s.k = p.k + 1)
, o AS (
  SELECT doc_id, k, generate_subscripts(emitted, 1) AS i, unnest(emitted) AS snippet FROM p
  UNION ALL SELECT doc_id, 1000000000, 1, arg_max(cur, k) FROM p GROUP BY doc_id HAVING arg_max(cur, k) <> ''
  UNION ALL SELECT doc_id, 1000000001, 1, title FROM d WHERE title <> '')
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k, i) - 1 AS INTEGER) AS chunk_no, snippet AS chunk, snippet FROM o"""


# ---------------------------------------------------------------- articles
def _article_chunks(spark, sf_dir):
    return I.article_chunks(I.article_silver(article_bronze(spark, sf_dir)), ARTICLE_CFG)


def article_silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = I.article_silver(article_bronze(spark, sf_dir))
    return s.select("id", "title", F.array_join("tags", "|").alias("tags"), "content",
                    "createdAt", "updatedAt", "publishedAt")


_ART_SILVER_SQL = _ART_DATES_SQL + f"""
, asv AS (
  SELECT ab.id, d.doc_id, d.lang, d.source,
         CASE WHEN d.doc_id % 17 = 0 THEN '' ELSE 'Article ' || CAST(d.doc_id AS VARCHAR) END AS title,
         '"source"."' || d.source || '"|"lang"."' || d.lang || '"' AS tags,
         {NON_PRINTABLE.format(x=STRIP_TAGS.format(x="array_to_string(list_transform(list_filter(string_split(coalesce(d.text, ''), chr(10)), lambda p: length(p) > 0), lambda p: '<p>' || p || '</p>'), chr(10))"))} AS content,
         {_iso_norm_sql('ab.createdAt')} AS createdAt, {_iso_norm_sql('ab.updatedAt')} AS updatedAt, ab.updatedAt IS NOT NULL AS updated_given,
         {_iso_norm_sql('ab.publishedAt')} AS publishedAt,
         CAST(d.doc_id % 3 + 1 AS INTEGER) AS org_id
  FROM documents d JOIN ab ON ab.id = 'a' || CAST(d.doc_id AS VARCHAR))"""

SQL["article_silver"] = ("WITH _x AS (SELECT 1)" + _ART_SILVER_SQL
                         + "\nSELECT id, title, tags, content, createdAt, updatedAt, publishedAt FROM asv")


def article_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.gold_rows(I.embed_chunks(_article_chunks(spark, sf_dir), I.EmbedConfig(dims=64)))
    return rows.select(F.col("document_id").alias("article_id"), "chunk_no", "chunk", "snippet", "title", "data",
                       F.date_format("created_at", TS_FMT).alias("created_at"),
                       F.date_format("updated_at", TS_FMT).alias("updated_at"),
                       F.size("embedding").cast("long").alias("dims"))


SQL["article_gold"] = ("WITH _x AS (SELECT 1)" + _ART_SILVER_SQL + """
, src AS (SELECT id AS article_id, doc_id, content AS t, title, title AS ctx, createdAt, updatedAt, updated_given, publishedAt, source FROM asv
          WHERE length(content) > 0 OR length(title) > 0)""" + _char_chunks_sql("src", "article_id", "suffix") + """
SELECT c.article_id, c.chunk_no, c.chunk, c.snippet, s.title,
       '{"articleNumber":"KB' || lpad(CAST(s.doc_id AS VARCHAR), 7, '0') || '","contentType":"article","articleType":"faq","filePath":"/kb/'
         || s.source || '/' || CAST(s.doc_id AS VARCHAR) || '","version":' || CAST(s.doc_id % 4 + 1 AS VARCHAR)
         || ',"publishedAt":"' || s.publishedAt || '"}' AS data,
       strftime(CAST(replace(s.createdAt, '+00:00', '') AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS created_at,
       strftime(CAST(replace(CASE WHEN s.updated_given THEN s.updatedAt ELSE s.createdAt END, '+00:00', '') AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS updated_at,
       CAST(64 AS BIGINT) AS dims
FROM chunks c JOIN src s USING (article_id)""")


# ---------------------------------------------------------------- HTML pages
def html_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.gold_rows(I.embed_chunks(I.html_chunks(html_silver(spark, sf_dir), F.lit(HTML_CONNECTOR), HTML_CFG),
                                      I.EmbedConfig(dims=64)))
    return rows.select(F.col("document_id").alias("html_id"), "chunk_no", "chunk", "snippet", "title", "language",
                       F.size("embedding").cast("long").alias("dims"))


SQL["html_gold"] = f"""
WITH hs AS (
  SELECT 'p' || CAST(page_id AS VARCHAR) AS html_id, {_page_text_sql('html')} AS content,
         regexp_extract(html, '<html lang="([^"]*)"', 1) AS language,
         regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages)
, src AS (SELECT html_id, content AS t, title, title AS ctx, language FROM hs
          WHERE length(content) > 0 OR length(title) > 0)""" + _char_chunks_sql("src", "html_id", "prefix") + """
SELECT c.html_id, c.chunk_no, c.chunk, c.snippet, s.title, s.language, CAST(64 AS BIGINT) AS dims
FROM chunks c JOIN src s USING (html_id)"""


# ---------------------------------------------------------------- trees
def tree_bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bronze_columns(I.tree_bronze(tree_raw(spark, sf_dir)))


def tree_unwrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I1 from trees as delivered: JSON text in the first detail of a record."""
    raw = tree_raw(spark, sf_dir)
    value = F.to_json(F.struct(*raw.columns), {"ignoreNullFields": "false"})
    delivered = raw.select(F.array(F.struct(F.lit("tree").alias("name"), F.lit("Tree").alias("label"), value.alias("value"))).alias("details"))
    return _bronze_columns(I.tree_bronze(I.unwrap_trees(delivered)))


def ingest_connectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D8 for every tree and page: its org's connector of the source, or the reject's reason."""
    conns = connectors(spark, sf_dir)
    trees = I.with_connector(tree_raw(spark, sf_dir).select("id", "org_id"), conns, "zingtree")
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"),
                                                 (F.col("page_id") % 3 + 1).cast("string").alias("org_id"))
    return trees.unionByName(I.with_connector(pages, conns, "html_pages")).select("id", "org_id", "connector_id", "connector_error")


SQL["ingest_connectors"] = with_ctes(["connectors"], f"""
, act AS (SELECT org_id, provider, min(id) AS cid FROM connectors WHERE active AND type_active GROUP BY org_id, provider)
, rec AS (
  SELECT DISTINCT CAST((doc_id // 10) * 1000 + 7 AS VARCHAR) AS id, (doc_id // 10) % 3 + 1 AS org, 'zingtree' AS provider FROM documents
  UNION ALL SELECT 'p' || CAST(page_id AS VARCHAR), page_id % 3 + 1, 'html_pages' FROM pages)
SELECT rec.id, CAST(rec.org AS VARCHAR) AS org_id, act.cid AS connector_id, CASE WHEN act.cid IS NULL THEN '{{e}}' END AS connector_error
FROM rec LEFT JOIN act ON act.org_id = rec.org AND act.provider = rec.provider""".replace("{e}", I.NOT_CONFIGURED))


def _bronze_columns(b: DataFrame) -> DataFrame:
    m = F.col("meta")
    return b.select(m["id"].alias("id"), m["name"].alias("name"), F.array_join(m["tags"], "|").alias("tags"),
                    m["active"].alias("active"), m["is_private"].alias("is_private"),
                    m["create_date"].alias("create_date"), m["last_opened"].alias("last_opened"),
                    m["last_modified"].alias("last_modified"), F.size("nodes").cast("long").alias("n_nodes"))


_TREE_SQL = """
, tr AS (
  SELECT doc_id // 10 AS tree, count(*) FILTER (WHERE doc_id % 10 <> 9) AS n_content FROM documents GROUP BY 1)
, tb AS (
  SELECT CAST(tree * 1000 + 7 AS VARCHAR) AS id, tree,
         '<h1>Tree ' || CAST(tree AS VARCHAR) || '</h1>' AS raw_name,
         CASE WHEN tree % 2 = 0 THEN '' ELSE 'a <i>tree</i> description' END AS raw_description,
         CASE WHEN tree % 3 = 0 THEN '' ELSE 'tree|t' || CAST(tree % 5 AS VARCHAR) END AS tags,
         tree % 5 <> 0 AS active, FALSE AS is_private,
         strftime(TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(tree % 365 AS INTEGER)), '%Y-%m-%dT%H:%M:%S') || '+00:00' AS create_date,
         CASE WHEN tree % 7 = 0 THEN NULL ELSE strftime(TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(tree % 365 AS INTEGER)), '%Y-%m-%dT%H:%M:%S') || '+00:00' END AS last_opened,
         strftime(TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(tree % 365 AS INTEGER) + 1), '%Y-%m-%dT%H:%M:%S') || '+00:00' AS last_modified,
         n_content
  FROM tr)"""

SQL["tree_bronze"] = ("WITH _x AS (SELECT 1)" + _TREE_SQL + """
SELECT id, raw_name AS name, tags, active, is_private, create_date, last_opened, last_modified,
       CAST(n_content AS BIGINT) AS n_nodes FROM tb""")

SQL["tree_unwrapped"] = SQL["tree_bronze"]


def _tree_silver(spark, sf_dir):
    return I.tree_silver(I.tree_bronze(tree_raw(spark, sf_dir)))


def tree_silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _tree_silver(spark, sf_dir)
    return s.select(F.col("meta.id").alias("tree_id"), "node_id", F.col("meta.name").alias("name"),
                    F.array_join("meta.tags", "|").alias("tags"),
                    F.col("node.content.page_title").alias("page_title"),
                    F.col("node.content.content").alias("content"),
                    F.col("node.content.question").alias("question"),
                    F.array_join("node.meta.keywords", "|").alias("keywords"),
                    F.array_join("node.meta.tag", "|").alias("tag"))


_NODE_SQL = f"""
, nodes AS (
  SELECT CAST((doc_id // 10) * 1000 + 7 AS VARCHAR) AS tree_id, doc_id // 10 AS tree, CAST(doc_id % 10 AS VARCHAR) AS node_id,
         {CONTROL.format(x=STRIP_TAGS.format(x="'<b>' || CASE WHEN doc_id % 12 = 11 THEN text ELSE source || ' ' || CAST(doc_id AS VARCHAR) END || '</b>'"))} AS page_title,
         CASE WHEN doc_id % 6 = 5 THEN '' ELSE {CONTROL.format(x=STRIP_TAGS.format(x="'<p id=\"x\">' || text || '</p>'"))} END AS content,
         CASE WHEN doc_id % 12 = 5 THEN {CONTROL.format(x=STRIP_TAGS.format(x="'<p>' || text || '</p>'"))}
              WHEN doc_id % 3 = 0 THEN 'Is this ' || source || '?' ELSE '' END AS question,
         source || '|' || lang AS keywords, CASE WHEN doc_id % 2 = 0 THEN lang ELSE '' END AS tag
  FROM documents WHERE doc_id % 10 <> 9)"""

SQL["tree_silver"] = ("WITH _x AS (SELECT 1)" + _TREE_SQL + _NODE_SQL + """
SELECT n.tree_id, n.node_id, 'Tree ' || CAST(t.tree AS VARCHAR) AS name,
       CASE WHEN t.tags = '' THEN '' ELSE list_aggregate(list_transform(string_split(t.tags, '|'),
            lambda x: '"zt_trees_trees"."' || x || '"'), 'string_agg', '|') END AS tags,
       n.page_title, n.content, n.question, n.keywords, n.tag
FROM nodes n JOIN tb t ON t.id = n.tree_id""")


def tree_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.gold_rows(I.embed_chunks(I.tree_chunks(_tree_silver(spark, sf_dir), F.lit(TREE_CONNECTOR), TREE_CFG),
                                      I.EmbedConfig(dims=64)))
    return rows.select(F.col("document_id").alias("node_doc_id"), "chunk_no", "chunk", "snippet", "title",
                       "description", "org_id", F.size("embedding").cast("long").alias("dims"))


SQL["tree_gold"] = ("WITH _x AS (SELECT 1)" + _TREE_SQL + _NODE_SQL + """
, sel AS (
  SELECT n.tree_id || '::' || n.node_id AS node_doc_id, 'Tree ' || CAST(t.tree AS VARCHAR) AS tree_name,
         {desc} AS description, CAST(t.tree % 3 + 1 AS INTEGER) AS org_id, n.page_title,
         CASE WHEN length(n.content) > 0 THEN concat_ws(' ', n.content, nullif(n.question, ''))
              WHEN length(n.question) > 0 OR length(n.page_title) > 0
                THEN concat_ws(' ', nullif('Tree ' || CAST(t.tree AS VARCHAR), ''), nullif(n.page_title, ''), nullif(n.question, ''))
              ELSE '' END AS t0
  FROM nodes n JOIN tb t ON t.id = n.tree_id)
, src AS (SELECT node_doc_id, CASE WHEN length(t0) > 0 THEN t0 ELSE page_title END AS t,
                 concat_ws(' ', tree_name, page_title) AS title, '' AS ctx, description, org_id FROM sel
          WHERE length(CASE WHEN length(t0) > 0 THEN t0 ELSE page_title END) > 0)""".replace(
    "{desc}", "CASE WHEN t.tree % 2 = 0 THEN '' ELSE 'a tree description' END")
    + _char_chunks_sql("src", "node_doc_id", "prefix").replace(
        "CASE WHEN length(ctx) > 0 THEN 1000 - length(ctx) - 1 ELSE 1000 END", "1000") + """
SELECT c.node_doc_id, c.chunk_no, c.chunk, c.snippet, s.title, s.description, s.org_id, CAST(64 AS BIGINT) AS dims
FROM chunks c JOIN src s USING (node_doc_id)""")


QUERIES = {
    "html_text": html_text,
    "normalize_ascii": normalize_ascii,
    "normalize_control": normalize_control,
    "normalize_dates": normalize_dates,
    "tag_encode": tag_encode,
    "tag_decode": tag_decode,
    "chunk_characters": chunk_characters,
    "chunk_sentences": chunk_sentences,
    "article_silver": article_silver,
    "article_gold": article_gold,
    "html_gold": html_gold,
    "tree_bronze": tree_bronze,
    "tree_unwrapped": tree_unwrapped,
    "ingest_connectors": ingest_connectors,
    "tree_silver": tree_silver,
    "tree_gold": tree_gold,
}
