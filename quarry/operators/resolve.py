"""Batch filter resolution: requests x widget x connectors.

The reference resolves one request at a time against REST dimensions; here a
DataFrame of requests is joined to dimension DataFrames (widgets, connectors,
agent tags). Dimensions are joined with plain equi-joins so AQE broadcasts
them when their runtime size is under the broadcast threshold and falls back
to a shuffle join otherwise; no dimension is collected to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.filters import json_text
from quarry.sources.derived import AGENT, TREE_PROVIDER

def _empty_ints():
    return F.array().cast("array<int>")


def active_connectors(connectors: DataFrame) -> DataFrame:
    """B21 + D7: active connectors of active connector types."""
    return connectors.where(F.col("active") & F.col("type_active"))


def tree_connectors(connectors: DataFrame) -> DataFrame:
    """(org_id, zt): the first active connector of the tree provider, per org."""
    return active_connectors(connectors).where(F.col("provider") == TREE_PROVIDER).groupBy("org_id").agg(F.min("id").cast("int").alias("zt"))


def widget_connectors(widgets: DataFrame, connectors: DataFrame) -> DataFrame:
    """(deployment_id, widget_connectors) of widgets with ``zt``: the org's tree connector if
    trees are enabled plus the external ids if external sources are enabled, kept only when
    active in the widget's org."""
    zt_arr = F.when(F.col("enable_trees") & F.col("zt").isNotNull(), F.array("zt")).otherwise(_empty_ints())
    cand = widgets.select("deployment_id", "org_id", F.explode(F.concat(
        zt_arr, F.when(F.col("enable_external"), F.col("external_ids")).otherwise(_empty_ints()))).alias("cid"))
    kept = cand.join(active_connectors(connectors).select("org_id", F.col("id").alias("cid")), ["org_id", "cid"], "left_semi")
    return kept.groupBy("deployment_id").agg(F.array_sort(F.collect_set("cid")).alias("widget_connectors"))


def resolved_widgets(widgets: DataFrame, connectors: DataFrame) -> DataFrame:
    """Active widgets with their connector set, tree connector and tree ids."""
    w = widgets.where(F.col("active")).join(tree_connectors(connectors), "org_id", "left")
    wc = widget_connectors(w, connectors)
    return (w.join(wc, "deployment_id", "left")
            .withColumn("widget_connectors", F.coalesce("widget_connectors", _empty_ints()))
            .withColumn("zt_connector_id", F.when(F.col("enable_trees"), F.col("zt")))
            .withColumn("zt_tree_ids", F.when(F.col("enable_trees") & ~F.col("all_trees") & F.col("zt").isNotNull(),
                                              F.col("tree_ids")))
            .withColumn("zt_missing", F.col("enable_trees") & F.col("zt").isNull()).drop("zt"))


def resolve_filters(requests: DataFrame, widgets: DataFrame, connectors: DataFrame,
                    agent_tags: DataFrame) -> DataFrame:
    """One resolved filter row per request; ``status`` reports a missing widget or
    tree connector instead of raising, so one bad request never fails the batch."""
    w = resolved_widgets(widgets, connectors)
    r = requests.join(w.withColumn("_w", F.lit(True)), ["deployment_id", "org_id"], "left")
    req = F.col("connectors")
    merged = F.when(req.isNull(), F.col("widget_connectors")).otherwise(
        F.array_sort(F.array_intersect(F.col("widget_connectors"), req)))
    params = F.col("scope_params")
    match = F.filter(F.col("content_scopes"), lambda s: F.exists(
        params, lambda p: (p["name"] == s["parameter"]["name"]) & (p["value"] == s["parameter"]["value"])))
    scope = F.when(params.isNotNull(), F.try_element_at(match, F.lit(1)))
    a = agent_tags.select(F.col("agent_id").alias("causer_id"), F.col("tags").alias("_agent_tags"))
    r = r.join(a, "causer_id", "left")
    zt_tags = F.when((F.col("causer_type") == AGENT) & (F.size("_agent_tags") > 0), F.col("_agent_tags"))
    status = (F.when(F.col("_w").isNull(), F.lit("widget_not_found"))
              .when(F.col("zt_missing"), F.lit("tree_connector_not_found"))
              .otherwise(F.lit("ok")))
    return r.select(
        "request_id", "deployment_id", "org_id", status.alias("status"),
        merged.alias("connectors"), "zt_connector_id", "zt_tree_ids",
        scope["id"].alias("scope_id"), scope["sources"].alias("scope_sources"),
        zt_tags.alias("zt_tags"))


def deployment_connectors(widgets: DataFrame, connectors: DataFrame) -> DataFrame:
    """Per active deployment, its org's active external connectors listed in the widget (if
    enabled) plus the org's tree connector (if trees are enabled); one row per connector."""
    act = active_connectors(connectors).select("org_id", "id", "provider")
    w = widgets.where(F.col("active"))
    ext = (w.where(F.col("enable_external")).select("deployment_id", "org_id", F.explode("external_ids").alias("id"))
           .join(act, ["org_id", "id"], "inner"))
    trees = w.where(F.col("enable_trees")).join(tree_connectors(connectors), "org_id", "inner")
    return (ext.select("deployment_id", F.col("id").alias("connector_id"), "provider")
            .unionByName(trees.select("deployment_id", F.col("zt").alias("connector_id"), F.lit(TREE_PROVIDER).alias("provider")))
            .distinct())


def org_connectors(connectors: DataFrame, org_id: int) -> DataFrame:
    """C6 without a deployment: all active connectors of an org."""
    return active_connectors(connectors).where(F.col("org_id") == org_id).select(F.col("id").alias("connector_id"), "provider")


def deployments_with_documents(widgets: DataFrame, connectors: DataFrame, documents: DataFrame) -> DataFrame:
    """E4 for every active deployment: does any document pass the widget's filters
    (org, connector set, tree ids)?

    Documents are first reduced to their distinct (org, connector, tree id) keys
    (map-side partial aggregation), then matched by equi-joins, so no
    document x deployment pairs are formed."""
    keys = documents.select("org_id", "connector_id",
                            json_text(F.col("data"), "tree_id").alias("tree_id")).distinct()
    return deployments_present(widgets, connectors, keys)


def deployments_present(widgets: DataFrame, connectors: DataFrame, keys: DataFrame) -> DataFrame:
    """The same from the (org_id, connector_id, tree_id) there are, as maintained facets know them."""
    w = resolved_widgets(widgets, connectors)
    conn_keys = keys.select("org_id", "connector_id").distinct()
    need = w.select("deployment_id", "org_id", "zt_connector_id", "zt_tree_ids",
                    F.explode("widget_connectors").alias("connector_id"))
    is_tree = (F.col("connector_id") == F.col("zt_connector_id")) & F.col("zt_tree_ids").isNotNull()
    plain = need.where(~is_tree | is_tree.isNull()).join(conn_keys, ["org_id", "connector_id"], "left_semi")
    trees = (need.where(is_tree)
             .select("deployment_id", "org_id", "connector_id",
                     F.explode("zt_tree_ids").alias("tid"))
             .withColumn("tree_id", F.concat(F.lit('"'), (F.col("tid") * 1000).cast("string"), F.lit('"')))
             .join(keys, ["org_id", "connector_id", "tree_id"], "left_semi"))
    hit = plain.select("deployment_id").unionByName(trees.select("deployment_id")).distinct()
    return (w.select("deployment_id").join(hit.withColumn("has_documents", F.lit(True)), "deployment_id", "left")
            .select("deployment_id", F.coalesce("has_documents", F.lit(False)).alias("has_documents")))
