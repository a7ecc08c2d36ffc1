"""Catalog operators over gold documents.

All are aggregations Spark can combine map-side: a tag or language held by a
third of all documents is pre-aggregated per task before the shuffle, so hot
keys never gather their rows into one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.tags import tag_key, tag_value
from quarry.operators.filters import SearchFilters, documents_by_org_connector, filter_predicate, substring_ilike


def suggestions(documents: DataFrame, search: str, filters: SearchFilters, limit: int | None = 10) -> DataFrame:
    """Title and description branches (distinct, shortest first, limit each),
    UNION ALL, distinct, shortest first, limit. Ties broken by the text itself."""
    base = documents.where(filter_predicate(filters))

    def branch(col: str) -> DataFrame:
        b = (base.where(substring_ilike(F.col(col), search))
             .select(F.col(col).alias("suggestion"), F.length(col).cast("long").alias("len"))
             .distinct())
        return b.orderBy("len", "suggestion").limit(limit) if limit else b

    out = branch("title").unionByName(branch("description")).distinct()
    if not limit:
        return out
    top = out.orderBy("len", "suggestion").limit(limit)
    # bounded by `limit` rows
    return top.withColumn("rank", F.row_number().over(Window.orderBy("len", "suggestion")).cast("long"))


def tag_connector_counts(documents: DataFrame, org_id: int) -> DataFrame:
    """Documents per (tag, connector) within an org, with the decoded key/value."""
    counts = (documents.where(F.col("org_id") == org_id)
              .select(F.explode("tags").alias("tag"), "connector_id")
              .groupBy("tag", "connector_id").agg(F.count(F.lit(1)).alias("count")))
    return counts.select("tag", tag_key("tag").alias("key"), tag_value("tag").alias("value"),
                         "connector_id", "count")


def distinct_tags(documents: DataFrame, org_id: int) -> DataFrame:
    """Distinct tags decoded, one row per (key, value). A key's values are rows and not a
    list, so a key with a large vocabulary never meets in one row or task."""
    tags = (documents.where(F.col("org_id") == org_id)
            .select(F.explode("tags").alias("tag")).distinct())
    kv = tags.select(tag_key("tag").alias("key"), tag_value("tag").alias("value")).where(F.col("key").isNotNull())
    return kv.distinct()


def languages(documents: DataFrame, org_id: int) -> DataFrame:
    """Distinct languages of an org, NULL kept."""
    return documents.where(F.col("org_id") == org_id).select("language").distinct()


def documents_page(documents: DataFrame, org_id: int | None, connector_id: int | None,
                   limit: int | None = None, offset: int | None = None) -> DataFrame:
    """Documents by org and/or connector, ordered by id; limit+offset both or neither.

    Spark plans ``TakeOrderedAndProject(limit+offset)``: each task keeps its
    best ``limit+offset`` rows, so no global sort of the table happens."""
    d = documents.where(documents_by_org_connector(org_id, connector_id))
    if limit is None or offset is None:
        return d
    return d.orderBy("id").offset(offset).limit(limit)


def documents_after(documents: DataFrame, org_id: int | None, connector_id: int | None,
                    last_id: int, limit: int) -> DataFrame:
    """Keyset paging (``id > last``): the scan-side filter skips earlier pages entirely."""
    d = documents.where(documents_by_org_connector(org_id, connector_id) & (F.col("id") > last_id))
    return d.orderBy("id").limit(limit)


# ------------------------------------------------------------------ lookups
def document_lookup(documents: DataFrame, document_id: str, connector_id: int, org_id: int) -> DataFrame:
    """A document by its business key (at most one row)."""
    return documents.where((F.col("document_id") == document_id) & (F.col("connector_id") == connector_id)
                           & (F.col("org_id") == org_id)).limit(1)


def items_by_ids(items: DataFrame, documents: DataFrame, ids: DataFrame, org_id: int) -> DataFrame:
    """B13 + D10: items whose id is in ``ids`` (a DataFrame with ``id``) and whose own
    document belongs to the org — a real join, not "any document of the org". A
    left-semi join, so the id list may be as large as the items table."""
    docs = documents.where(F.col("org_id") == org_id).select(F.col("id").alias("document_id"))
    return items.join(ids.select("id"), "id", "left_semi").join(docs, "document_id", "left_semi")


def tree_documents(documents: DataFrame, tree_id: str, org_id: int) -> DataFrame:
    """Documents of one tree (``document_id LIKE '<tree>::%'``) in an org."""
    return documents.where(F.col("document_id").startswith(tree_id + "::") & (F.col("org_id") == org_id))


def insert_if_absent(existing: DataFrame, new: DataFrame, keys=("document_id", "connector_id", "org_id")) -> DataFrame:
    """Rows of ``new`` whose business key is not in ``existing`` (to append)."""
    return new.join(existing.select(*keys), list(keys), "left_anti")


# ------------------------------------------------------------------ H23 response mapping
def document_payload(documents: DataFrame) -> DataFrame:
    """API shape of a document — tags decoded to ``map<key, array<value>>``, data
    parsed, renamed fields. Rows with a malformed tag get ``payload`` NULL and
    ``mapping_error`` set (Q14: the caller drops them and reports partial results)."""
    from quarry.functions.tags import decode_tags
    kv = decode_tags(F.col("tags"))
    malformed = F.exists(kv, lambda x: x["key"].isNull())
    entries = F.aggregate(
        kv, F.create_map().cast("map<string,array<string>>"),
        lambda acc, x: F.map_concat(
            F.map_filter(acc, lambda k, v: k != x["key"]),
            F.create_map(x["key"], F.concat(F.coalesce(acc[x["key"]], F.array().cast("array<string>")),
                                            F.array(x["value"])))))
    payload = F.struct(
        F.col("id").alias("id"), F.col("org_id").alias("orgId"), F.col("language").alias("language"),
        F.col("title").alias("title"), F.col("description").alias("description"), entries.alias("tags"),
        F.try_parse_json(F.col("data")).alias("data"), F.col("connector_id").alias("connectorId"),
        F.col("document_id").alias("articleId"), F.col("created_at").alias("createdAt"),
        F.col("updated_at").alias("updatedAt"))
    return documents.select("*", F.when(malformed, F.lit(None)).otherwise(payload).alias("payload"),
                            F.when(malformed, F.lit("malformed tag")).alias("mapping_error"))


def search_response(hits: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """H23 for search hits: (options, meta). Options whose document cannot be mapped are
    dropped; ``meta`` reports the dropped count and the partial-result error code."""
    docs = document_payload(documents).select(F.col("id").alias("document_id"), "payload", "mapping_error")
    h = hits.join(docs, "document_id", "inner")
    keep = [c for c in hits.columns if c != "document_id"]
    ok = h.where(F.col("mapping_error").isNull()).select(*keep, F.col("payload").alias("document"))
    meta = h.agg(F.count_if(F.col("mapping_error").isNotNull()).alias("dropped")).select(
        "dropped", F.when(F.col("dropped") > 0, F.lit(2001)).alias("error_code"))
    return ok, meta
