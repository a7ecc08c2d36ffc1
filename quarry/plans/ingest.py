"""Medallion pipelines (I1-I7): raw -> bronze -> silver -> gold, per source kind.

Each stage is a DataFrame -> DataFrame function over many documents at once
(sources are spread over task slots where they are read, see ``session.spread``);
the reference processes one JSON object per call. Gold is produced as one
row per chunk (``gold_chunks``) from which ``split_gold`` derives the
documents and items tables. Ids are deterministic hashes of the business
key, so re-running a batch rewrites identical rows (idempotent upserts).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.pairs import paired, unpaired
from quarry.functions.tags import encode_pairs
from quarry.functions.text import (csv_or_empty, details_text, flag, html_to_printable_ascii, html_to_stripped,
                                   normalize_date)
from quarry.operators.chunking import chunk
from quarry.operators.filters import TREE_TAG_KEY
from quarry.operators.models import embed, model_key
from quarry.session import hold

def _empty_strs():
    return F.array().cast("array<string>")


@dataclass
class ChunkConfig:
    method: str = "sentences"     # "sentences" | "characters"
    max_length: int = 1000
    mode: str | None = None       # None | "prefix" | "suffix"


@dataclass
class EmbedConfig:
    dims: int = 64
    factory: object = None        # callable returning an embedder; None = hashing embedder
    enabled: bool = True
    key: str = field(default_factory=model_key, init=False)  # all uses of the config share a worker's model


def _ts(iso: Column) -> Column:
    return F.try_to_timestamp(iso)


def document_key_id(org: Column, conn: Column, doc: Column) -> Column:
    return F.xxhash64(org, conn, doc)


# ------------------------------------------------------------------ articles
def article_silver(bronze: DataFrame) -> DataFrame:
    """I4: drop details and raw dates, encode tags, normalise content (H10, H4, H5) and
    dates (H7)."""
    content = html_to_printable_ascii(details_text(F.col("details")))
    keep = [c for c in bronze.columns if c not in ("details", "createdAt", "updatedAt", "publishedAt", "tags")]
    return bronze.select(
        *keep,
        encode_pairs(F.col("tags")).alias("tags"),
        content.alias("content"),
        normalize_date(F.col("createdAt")).alias("createdAt"),
        normalize_date(F.col("updatedAt")).alias("updatedAt"),
        F.col("updatedAt").isNotNull().alias("updatedAtGiven"),
        normalize_date(F.col("publishedAt")).alias("publishedAt"),
    )


def residual(silver: DataFrame, *used: str) -> Column:
    """JSON of every silver column that no gold column is made of."""
    rest = [c for c in silver.columns if c not in used]
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in rest]) if rest else F.struct(), {"ignoreNullFields": "false"})


def article_chunks(silver: DataFrame, cfg: ChunkConfig) -> DataFrame:
    """I5 (before embedding): rename, skip empty records (B23), chunk."""
    docs = silver.where((F.length("content") > 0) | (F.length("title") > 0)).select(
        "org_id", F.col("lang").alias("language"), "title", F.lit(None).cast("string").alias("description"),
        F.coalesce("tags", _empty_strs()).alias("tags"),
        residual(silver, "org_id", "lang", "title", "tags", "connector_id", "id", "createdAt", "updatedAt", "updatedAtGiven",
                 "content").alias("data"),
        "connector_id", F.col("id").alias("document_id"),
        _ts(F.col("createdAt")).alias("created_at"),
        # Creation stands in for an update that is not given, not for one that can't be read
        _ts(F.when(F.col("updatedAtGiven"), F.col("updatedAt")).otherwise(F.col("createdAt"))).alias("updated_at"),
        F.col("content").alias("text"))
    return chunk(docs, cfg.method, cfg.max_length, cfg.mode).where(F.col("chunk_no").isNotNull()).drop("text")


# ------------------------------------------------------------------ HTML pages
def html_chunks(silver: DataFrame, connector_id: Column, cfg: ChunkConfig) -> DataFrame:
    """I6 (before embedding): html_id/lang renamed, tags [], dates NULL, data keeps
    the other columns (content, url, type and description among them)."""
    if "description" not in silver.columns:
        silver = silver.withColumn("description", F.lit(None).cast("string"))
    data = residual(silver, "org_id", "lang", "title", "id", "connector_id")
    docs = silver.where((F.length("content") > 0) | (F.length("title") > 0)).select(
        "org_id", F.col("lang").alias("language"), "title", F.lit(None).cast("string").alias("description"),
        _empty_strs().alias("tags"), data.alias("data"), connector_id.cast("int").alias("connector_id"),
        F.col("id").alias("document_id"), F.lit(None).cast("timestamp").alias("created_at"),
        F.lit(None).cast("timestamp").alias("updated_at"), F.col("content").alias("text"))
    return chunk(docs, cfg.method, cfg.max_length, cfg.mode).where(F.col("chunk_no").isNotNull()).drop("text")


# ------------------------------------------------------------------ decision trees
# The tree meta keys bronze keeps (in this order).
TREE_META_KEYS = ["id", "name", "description", "tags", "org_id", "active", "create_date",
                  "last_opened", "last_modified", "is_private", "language"]


#: A delivered tree: its meta keys and its nodes by id.
RAW_TREE = (", ".join(f"{k} string" for k in TREE_META_KEYS)
            + ", nodes map<string, struct<type:string,page_title:string,content:string,question:string,keywords:string,tag:string>>")


def unwrap_trees(delivered: DataFrame, extra: tuple = ()) -> DataFrame:
    """I1, first step: a tree comes as JSON text in the value of its record's first detail. A
    record without a readable tree gives no row."""
    tree = F.from_json(F.try_element_at(F.col("details"), F.lit(1))["value"], RAW_TREE)
    return delivered.select(tree.alias("_t"), *extra).where(F.col("_t.id").isNotNull()).select("_t.*", *extra)


NOT_CONFIGURED = "Connector or ConnectorType not configured for organization"


def with_connector(records: DataFrame, connectors: DataFrame, provider: str, org: str = "org_id") -> DataFrame:
    """Every record with ``connector_id``, the first active connector of the provider in the
    record's org, or with ``connector_error`` where the org has none."""
    first = (connectors.where(F.col("active") & F.col("type_active") & (F.col("provider") == provider))
             .groupBy(F.col("org_id").alias("_org")).agg(F.min("id").cast("int").alias("connector_id")))
    return (records.join(first, F.col(org).try_cast("int") == F.col("_org"), "left").drop("_org")
            .withColumn("connector_error", F.when(F.col("connector_id").isNull(), F.lit(NOT_CONFIGURED))))


def tree_bronze(raw: DataFrame, extra: tuple = ()) -> DataFrame:
    """Keep allow-listed meta keys (tags split, flags cast, dates to UTC) and the
    content nodes (B22) with their allow-listed keys (keywords/tag split)."""
    cast = {"tags": csv_or_empty, "active": flag, "is_private": flag, "create_date": normalize_date,
            "last_opened": normalize_date, "last_modified": normalize_date}
    meta = F.struct(*[cast.get(k, lambda c: c)(F.col(k)).alias(k) for k in TREE_META_KEYS])
    nodes = F.transform_values(
        F.map_filter(F.col("nodes"), lambda k, v: v["type"] == "Content"),
        lambda k, v: F.struct(v["page_title"].alias("page_title"), v["content"].alias("content"),
                              v["question"].alias("question"),
                              csv_or_empty(v["keywords"]).alias("keywords"), csv_or_empty(v["tag"]).alias("tag")))
    return raw.select(meta.alias("meta"), nodes.alias("nodes"), *extra)


def nstruct(**cols: Column) -> Column:
    """Struct with explicit field names (aliases of Python-UDF results inside
    ``struct`` are not kept by the planner)."""
    args = []
    for k, v in cols.items():
        args += [F.lit(k), v]
    return F.named_struct(*args)


def _norm_tree_text(c: Column) -> Column:
    return html_to_stripped(c)


def tree_silver(bronze: DataFrame) -> DataFrame:
    """Tree name/description and node page_title/content/question normalised
    (H4 + H6, Unicode kept); tree tags encoded under the tree tag key; node keywords
    and tags move to the node meta.

    Silver is laid out one row per (tree, node): ``meta`` (tree), ``node_id`` and
    ``node`` = struct<content struct<page_title, content, question>, meta
    struct<keywords, tag>>, so no tree is ever regrouped into one row again."""
    m = F.col("meta")
    meta = nstruct(
        id=m["id"], name=_norm_tree_text(m["name"]), description=_norm_tree_text(m["description"]),
        tags=F.transform(m["tags"], lambda t: F.concat(F.lit(f'"{TREE_TAG_KEY}"."'), t, F.lit('"'))),
        org_id=m["org_id"], active=m["active"], create_date=m["create_date"], last_opened=m["last_opened"],
        last_modified=m["last_modified"], is_private=m["is_private"], language=m["language"])
    others = [c for c in bronze.columns if c not in ("meta", "nodes")]
    exploded = bronze.select(meta.alias("meta"), F.explode("nodes").alias("node_id", "n"), *others)
    node = nstruct(
        content=nstruct(page_title=_norm_tree_text(F.col("n.page_title")),
                        content=_norm_tree_text(F.col("n.content")),
                        question=_norm_tree_text(F.col("n.question"))),
        meta=nstruct(keywords=F.col("n.keywords"), tag=F.col("n.tag")))
    return exploded.select("meta", "node_id", node.alias("node"), *others)


def tree_chunks(silver: DataFrame, connector_id: Column, cfg: ChunkConfig) -> DataFrame:
    """I3 (before embedding): one document per content node; H17 text selection;
    title = tree name + page title; document id = tree id::node id; residual data
    (H19). The chunk context is always empty for trees (its keys are tree_name /
    tree_description, not title / description)."""
    m = F.col("meta")
    n = silver.withColumnRenamed("node", "n")
    content, question, page_title = F.col("n.content.content"), F.col("n.content.question"), F.col("n.content.page_title")
    tree_name = m["name"]

    def join_nonempty(*cols):
        return F.array_join(F.filter(F.array(*cols), lambda x: F.length(x) > 0), " ")

    text = (F.when(F.length(content) > 0, join_nonempty(content, question))
            .when((F.length(question) > 0) | (F.length(page_title) > 0), join_nonempty(tree_name, page_title, question))
            .otherwise(F.lit("")))
    text = F.when(F.length(text) > 0, text).otherwise(page_title)
    data = F.to_json(F.struct(
        F.col("n.meta.keywords").alias("node_keywords"), F.col("n.meta.tag").alias("node_tags"),
        m["active"].alias("tree_active"), m["last_opened"].alias("tree_last_opened"),
        m["is_private"].alias("tree_is_private"), m["id"].alias("tree_id"),
        F.struct(F.coalesce(tree_name, F.lit("")).alias("title"),
                 F.coalesce(page_title, F.lit("")).alias("subtitle")).alias("display")),
        {"ignoreNullFields": "false"})
    docs = n.where(F.length(text) > 0).select(
        m["org_id"].try_cast("int").alias("org_id"), m["language"].alias("language"),
        F.concat_ws(" ", tree_name, page_title).alias("title"), m["description"].alias("description"),
        m["tags"].alias("tags"), data.alias("data"), connector_id.cast("int").alias("connector_id"),
        F.concat(m["id"], F.lit("::"), F.col("node_id")).alias("document_id"),
        _ts(m["create_date"]).alias("created_at"), _ts(m["last_modified"]).alias("updated_at"),
        text.alias("text"))
    return (chunk(docs, cfg.method, cfg.max_length, cfg.mode, ctx_col=F.lit(""))
            .where(F.col("chunk_no").isNotNull()).drop("text"))


# ------------------------------------------------------------------ gold
def embed_chunks(chunks: DataFrame, cfg: EmbedConfig) -> DataFrame:
    """K1 + I7: one embedding per chunk row (no zip); failed rows flagged."""
    if not cfg.enabled:
        return chunks.withColumn("embedding", F.lit(None).cast("array<float>")).withColumn(
            "embed_error", F.lit(None).cast("string"))
    return embed(chunks, "chunk", cfg.dims, cfg.factory, key=cfg.key)


def hold_chunks(rows: DataFrame) -> DataFrame:
    """``hold`` for chunk rows, which store chunk and snippet as a pair."""
    return unpaired(hold(paired(rows))).select(*rows.columns)


DOC_COLS = ["org_id", "language", "title", "description", "tags", "data", "connector_id", "document_id",
            "created_at", "updated_at"]


def split_gold(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Gold documents, gold items and rejected chunk rows from embedded chunk rows."""
    doc_id = document_key_id(F.col("org_id"), F.col("connector_id"), F.col("document_id"))
    ok = rows.where(F.col("embed_error").isNull() & F.col("chunk_error").isNull())
    # from the first chunk that was accepted, so that no document is lost with its chunk 0
    docs = (ok.groupBy(doc_id.alias("id")).agg(F.min_by(F.struct(*DOC_COLS), F.struct("chunk_no", "snippet")).alias("d"))
            .select("id", "d.*"))
    items = ok.select(
        F.xxhash64(F.col("org_id"), F.col("connector_id"), F.col("document_id"), F.col("chunk_no")).alias("id"),
        F.col("embedding").alias("embeddings"), "chunk", "snippet", doc_id.alias("document_id"), "chunk_no",
        "org_id", F.col("document_id").alias("source_id"))
    rejects = rows.where(F.col("embed_error").isNotNull() | F.col("chunk_error").isNotNull())
    return docs, items, rejects


def gold_rows(rows: DataFrame) -> DataFrame:
    """Accepted chunk rows with their gold ids (item ``id``, document ``doc_key``): the
    denormalised gold in one pass, for readers that want documents and items together."""
    doc_id = document_key_id(F.col("org_id"), F.col("connector_id"), F.col("document_id"))
    ok = rows.where(F.col("embed_error").isNull() & F.col("chunk_error").isNull())
    return ok.select(
        F.xxhash64(F.col("org_id"), F.col("connector_id"), F.col("document_id"), F.col("chunk_no")).alias("id"),
        doc_id.alias("doc_key"), *[c for c in ok.columns if c not in ("embed_error", "chunk_error")])
