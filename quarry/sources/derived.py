"""Gold, dimension and analytics tables derived from the input tables.

The inputs are generic (documents, embeddings, pages, conversations, events);
these functions turn them, with Spark, into the tables the search engine works
on. The same derivations are written in SQL in ``quarry.plans.oracle`` for the
DuckDB oracle, so any change here must be mirrored there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.tables import table

DAY = 86400
EPOCH_2024 = 1704067200  # 2024-01-01T00:00:00Z

# The nine authoring operations, in their declared order.
AUTHORING_OPERATIONS = [
    "fix-grammar", "summarize", "summarize-into-steps", "change-tone", "translate",
    "improve-writing", "reduce-reading-complexity", "reduce-reading-time", "expand-writing",
]

# Connector dimension: connector id -> (name, provider, active). Fixed, small.
CONNECTOR_PROVIDERS = {1: "zingtree", 2: "kb_articles", 3: "html_pages", 4: "kb_articles", 5: "html_pages"}
TREE_PROVIDER = "zingtree"


def _ts(seconds: F.Column) -> F.Column:
    return F.timestamp_seconds(seconds)


def gold_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    doc = F.col("doc_id")
    created = _ts(F.lit(EPOCH_2024) + (doc % 365) * DAY)
    return d.select(
        doc.alias("id"),
        (doc % 3 + 1).cast("int").alias("org_id"),
        F.col("lang").alias("language"),
        F.concat_ws(" ", "source", "lang", doc.cast("string")).alias("title"),
        F.col("text").alias("description"),
        F.array(
            F.concat(F.lit('"source"."'), "source", F.lit('"')),
            F.concat(F.lit('"lang"."'), "lang", F.lit('"')),
            F.concat(F.lit('"zt_trees_trees"."tt'), (doc % 7).cast("string"), F.lit('"')),
        ).alias("tags"),
        F.to_json(F.struct(
            (F.col("n_chars") % 10).alias("bucket"),
            F.col("source").alias("source"),
            ((doc % 20) * 1000).cast("string").alias("tree_id"),
        )).alias("data"),
        (doc % 5 + 1).cast("int").alias("connector_id"),
        F.concat(F.lit("t"), (doc % 20).cast("string"), F.lit("::"), doc.cast("string")).alias("document_id"),
        created.alias("created_at"),
        (created + F.make_interval(hours=(doc % 7).cast("int"))).alias("updated_at"),
    )


def gold_items(spark: SparkSession, sf_dir: str, with_text: bool = False) -> DataFrame:
    """Items: five chunks per document (``vec_id div 5``), the fifths of its text on demand."""
    e = table(spark, sf_dir, "embeddings")
    items = e.select(
        F.col("vec_id").alias("id"),
        F.col("embedding").alias("embeddings"),
        (F.col("vec_id").cast("long") / 5).cast("long").alias("document_id"),
    )
    if not with_text:
        return items
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "text")
    return (items.join(d, "document_id", "left")
            .withColumn("_fifth", F.ceil(F.length("text") / 5).cast("int"))
            .withColumn("snippet", F.expr("substring(text, cast((id % 5) * _fifth + 1 as int), _fifth)"))
            .withColumn("chunk", F.col("snippet"))
            .drop("text", "_fifth"))


def connector_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connector types by org: one row per (org, provider); pages are switched off for org 3."""
    return _connector_rows(spark, sf_dir).select(
        "org_id", "provider", (~((F.col("org_id") == 3) & (F.col("provider") == "html_pages"))).alias("active")).distinct()


def _connector_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    prov = F.create_map(*[x for k, v in CONNECTOR_PROVIDERS.items() for x in (F.lit(k), F.lit(v))])
    return (gold_documents(spark, sf_dir).select("org_id", F.col("connector_id").alias("id")).distinct()
            .withColumn("provider", F.coalesce(prov[F.col("id")], F.lit("external"))))


def connectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connectors (one per org and connector id present in the gold documents) joined with
    their org's connector types; derived, so it grows with the documents' connectors."""
    types = connector_types(spark, sf_dir).withColumnRenamed("active", "type_active")
    return _connector_rows(spark, sf_dir).join(types, ["org_id", "provider"], "left").select(
        "org_id", "id",
        F.concat(F.lit("connector-"), F.col("id").cast("string")).alias("name"),
        "provider",
        (F.col("id") != 5).alias("active"),
        F.coalesce("type_active", F.lit(False)).alias("type_active"),
    )


# ------------------------------------------------------------------ widgets, requests
AGENT = "App\\Models\\Agent"
USER = "App\\Models\\User"


def widgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One search widget per deployment (= distinct ``events.user_id``)."""
    u = F.col("user_id")
    src = F.struct  # readability alias
    scopes = F.array(
        src(F.lit("scope-a").alias("id"),
            src(F.lit("team").alias("name"), F.concat(F.lit("t"), (u % 4).cast("string")).alias("value")).alias("parameter"),
            F.array(src(F.lit(2).alias("connectorId"), F.lit("show").alias("action"),
                        F.array(F.lit('"lang"."en"')).alias("tags")),
                    src(F.lit(3).alias("connectorId"), F.lit("hide").alias("action"),
                        F.array().cast("array<string>").alias("tags"))).alias("sources")),
        src(F.lit("scope-b").alias("id"),
            src(F.lit("team").alias("name"), F.concat(F.lit("t"), ((u + 1) % 4).cast("string")).alias("value")).alias("parameter"),
            F.array(src(F.lit(4).alias("connectorId"), F.lit("hide").alias("action"),
                        F.array(F.concat(F.lit('"source"."src'), (u % 20).cast("string"), F.lit('"'))).alias("tags")),
                    src(F.lit(1).alias("connectorId"), F.lit("show").alias("action"),
                        F.array().cast("array<string>").alias("tags"))).alias("sources")),
    )
    return (table(spark, sf_dir, "events").select("user_id").distinct().select(
        F.concat(F.lit("dep-"), u.cast("string")).alias("deployment_id"),
        (u % 3 + 1).cast("int").alias("org_id"),
        (u % 10 != 9).alias("active"),
        (u % 2 == 0).alias("enable_trees"),
        (u % 3 != 0).alias("enable_external"),
        (u % 4 == 0).alias("all_trees"),
        F.array((u % 20).cast("int"), ((u + 7) % 20).cast("int")).alias("tree_ids"),
        F.array((u % 4 + 2).cast("int"), (5 - u % 3).cast("int")).alias("external_ids"),
        scopes.alias("content_scopes"),
    ))


def agent_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    return (table(spark, sf_dir, "events").select("user_id").distinct().where(u % 5 == 0)
            .select(u.alias("agent_id"),
                    F.when(u % 10 == 0, F.array().cast("array<string>"))
                    .otherwise(F.array(F.concat(F.lit("tt"), (u % 7).cast("string")))).alias("tags")))


def search_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One search request per event: deployment, requested connectors, scope parameters."""
    u, et = F.col("user_id"), F.col("event_type")
    k = F.get_json_object("props", "$.k").try_cast("int")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_id"),
        (u % 3 + 1).cast("int").alias("org_id"),
        F.concat(F.lit("dep-"), u.cast("string")).alias("deployment_id"),
        F.when(et == "view", F.lit(None).cast("array<int>"))
         .when(et == "purchase", F.array().cast("array<int>"))
         .when(et == "click", F.array(F.lit(2), F.lit(3)))
         .otherwise(F.array(*[F.lit(i) for i in range(1, 6)])).alias("connectors"),
        F.when(et.isin("click", "error"),
               F.array(F.struct(F.lit("team").alias("name"),
                                F.concat(F.lit("t"), (k % 4).cast("string")).alias("value"))))
         .when(et == "signup", F.array().cast("array<struct<name:string,value:string>>"))
         .alias("scope_params"),
        u.alias("causer_id"),
        F.when(u % 5 == 0, F.lit(AGENT)).otherwise(F.lit(USER)).alias("causer_type"),
    )


# ------------------------------------------------------------------ usage log, sessions
def json_quote(c: F.Column) -> F.Column:
    """JSON string literal of a text column (escapes backslash, quote, newline)."""
    esc = F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')),
                    F.lit("\n"), F.lit("\\n"))
    return F.concat(F.lit('"'), esc, F.lit('"'))


def usage_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authoring usage log: one chain per conversation; user turns are the chain's
    operation, other turns are moderation steps with output ``"true"``/``"false"``."""
    cv = table(spark, sf_dir, "conversations")
    ops = F.array(*[F.lit(o) for o in AUTHORING_OPERATIONS])
    chain_op = F.element_at(ops, (F.col("conv_id") % 9 + 1).cast("int"))
    is_user = F.col("role") == "user"
    op = F.when(is_user, chain_op).otherwise(F.lit("moderation"))
    created = _ts(F.lit(EPOCH_2024) + F.col("conv_id") * 3600 + F.col("turn") * 60)
    out = F.when(is_user, json_quote(F.col("text"))).otherwise(
        F.when(F.length("text") % 5 == 0, F.lit('"true"')).otherwise(F.lit('"false"')))
    return cv.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
        op.alias("operation"),
        json_quote(op).alias("prompt"),
        json_quote(F.col("text")).alias("input"),
        F.lit(None).cast("string").alias("response"),
        out.alias("output"),
        F.concat(F.lit("chain-"), F.col("conv_id").cast("string")).alias("chain_id"),
        chain_op.alias("chain_operation"),
        (F.col("conv_id") % 17).alias("user_id"),
        (F.col("conv_id") % 3 + 1).cast("int").alias("org_id"),
        (F.col("conv_id") % 5).alias("project_id"),
        created.alias("created_at"),
        created.alias("updated_at"),
    )


def _session_id(user: F.Column, ts: F.Column) -> F.Column:
    return F.concat(F.lit("s-"), user.cast("string"), F.lit("-"), F.date_format(ts, "yyyyMMdd"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search sessions: one per (user, day) of events."""
    u = F.col("user_id")
    ev = table(spark, sf_dir, "events")
    return (ev.groupBy(_session_id(u, F.col("ts")).alias("id"), u.alias("user_id"))
            .agg(F.min("ts").alias("created_at"))
            .select("id", F.lit("search").alias("operation"),
                    F.concat(F.lit("dep-"), F.col("user_id").cast("string")).alias("deployment_id"),
                    F.lit(None).cast("string").alias("current_deployment_type"),
                    F.lit(None).cast("string").alias("location"),
                    F.lit(None).cast("string").alias("previous_session_id"),
                    F.col("created_at").cast("timestamp").alias("created_at"),
                    F.col("user_id").alias("causer_id"),
                    F.when(F.col("user_id") % 5 == 0, F.lit(AGENT)).otherwise(F.lit(USER)).alias("causer_type"),
                    (F.col("user_id") % 3 + 1).cast("int").alias("org_id")))


def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id").alias("id"), F.col("event_type").alias("operation"),
        F.col("ts").cast("timestamp").alias("created_at"),
        F.concat(F.col("event_type"), F.lit(" "), F.col("value").cast("string")).alias("message"),
        F.col("props").alias("data"),
        _session_id(F.col("user_id"), F.col("ts")).alias("semantic_search_sessions_id"))


# ------------------------------------------------------------------ stage records
def _iso(ts: F.Column) -> F.Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def article_bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Knowledge-base articles as delivered (bronze): details are HTML paragraphs of
    the document text; some titles are empty, some dates missing or invalid."""
    from quarry.session import spread
    d = spread(table(spark, sf_dir, "documents"))
    doc = F.col("doc_id")
    created = _ts(F.lit(EPOCH_2024) + (doc % 365) * DAY)
    paras = F.split(F.coalesce(F.col("text"), F.lit("")), "\n")
    details = F.transform(paras, lambda p, i: F.struct(
        F.concat(F.lit("d"), i.cast("string")).alias("name"), F.lit("Detail").alias("label"),
        F.when(F.length(p) > 0, F.concat(F.lit("<p>"), p, F.lit("</p>"))).otherwise(F.lit("")).alias("value")))
    tags = F.array(
        F.struct(F.lit("source").alias("name"), F.array(F.col("source")).alias("values")),
        F.struct(F.lit("lang").alias("name"), F.array(F.col("lang")).alias("values")),
        F.struct(F.lit("draft").alias("name"), F.lit(None).cast("array<string>").alias("values")))
    return d.select(
        F.concat(F.lit("a"), doc.cast("string")).alias("id"),
        F.col("lang").alias("lang"),
        F.concat(F.lit("KB"), F.lpad(doc.cast("string"), 7, "0")).alias("articleNumber"),
        F.lit("article").alias("contentType"),
        F.when(doc % 17 == 0, F.lit("")).otherwise(F.concat(F.lit("Article "), doc.cast("string"))).alias("title"),
        F.lit("faq").alias("articleType"),
        F.concat(F.lit("/kb/"), F.col("source"), F.lit("/"), doc.cast("string")).alias("filePath"),
        (doc % 4 + 1).cast("int").alias("version"),
        details.alias("details"),
        tags.alias("tags"),
        _iso(created).alias("createdAt"),
        F.when(doc % 4 == 0, F.lit(None).cast("string"))
         .when(doc % 13 == 0, F.lit("2023-09-11T08:61:52"))
         .otherwise(_iso(created + F.make_interval(hours=(doc % 7).cast("int")))).alias("updatedAt"),
        F.lit("0001-01-01T00:00:00Z").alias("publishedAt"),
        (doc % 3 + 1).cast("int").alias("org_id"),
        F.lit(2).alias("connector_id"),
    )


def html_silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawled pages as silver records: text content (H4), url, type, lang, title."""
    from quarry.functions.text import html_to_text
    from quarry.session import spread
    p = spread(table(spark, sf_dir, "pages"))
    return p.select(
        F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"),
        html_to_text(F.col("html")).alias("content"),
        F.col("url"),
        F.lit("page").alias("type"),
        F.regexp_extract("html", '<html lang="([^"]*)"', 1).alias("lang"),
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
        (F.col("page_id") % 3 + 1).cast("int").alias("org_id"),
    )


NODES_PER_TREE = 10


def tree_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decision trees as delivered (raw): one row per tree of ``NODES_PER_TREE``
    documents (bounded by construction); the last node of each tree is a non-content
    node that bronze drops."""
    d = table(spark, sf_dir, "documents")
    doc = F.col("doc_id")
    node = F.struct(
        F.when(doc % NODES_PER_TREE == NODES_PER_TREE - 1, F.lit("Question")).otherwise(F.lit("Content")).alias("type"),
        # a node without content has its text as page title or as question
        F.concat(F.lit("<b>"), F.when(doc % 12 == 11, F.col("text")).otherwise(F.concat_ws(" ", "source", doc.cast("string"))),
                 F.lit("</b>")).alias("page_title"),
        F.when(doc % 6 == 5, F.lit("")).otherwise(
            F.concat(F.lit('<p id="x">'), F.col("text"), F.lit("</p>"))).alias("content"),
        F.when(doc % 12 == 5, F.concat(F.lit("<p>"), F.col("text"), F.lit("</p>")))
         .when(doc % 3 == 0, F.concat(F.lit("Is this "), F.col("source"), F.lit("?"))).otherwise(F.lit("")).alias("question"),
        F.concat_ws(",", "source", "lang").alias("keywords"),
        F.when(doc % 2 == 0, F.col("lang")).otherwise(F.lit("")).alias("tag"),
    )
    tid = (doc / NODES_PER_TREE).cast("long")
    trees = d.groupBy(tid.alias("tree")).agg(
        F.map_from_entries(F.collect_list(F.struct((doc % NODES_PER_TREE).cast("string"), node))).alias("nodes"),
        F.min_by("lang", doc).alias("language"))
    t = F.col("tree")
    created = _ts(F.lit(EPOCH_2024) + (t % 365) * DAY)
    return trees.select(
        (t * 1000 + 7).cast("string").alias("id"),
        F.concat(F.lit("<h1>Tree "), t.cast("string"), F.lit("</h1>")).alias("name"),
        F.when(t % 2 == 0, F.lit("")).otherwise(F.lit("a <i>tree</i> description")).alias("description"),
        "language",
        F.when(t % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("tree,t"), (t % 5).cast("string"))).alias("tags"),
        (t % 3 + 1).cast("string").alias("org_id"),
        F.when(t % 5 == 0, F.lit("0")).otherwise(F.lit("1")).alias("active"),
        F.lit("0").alias("is_private"),
        F.date_format(created, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("create_date"),
        F.when(t % 7 == 0, F.lit("not a date")).otherwise(_iso(created)).alias("last_opened"),
        _iso(created + F.make_interval(days=F.lit(1))).alias("last_modified"),
        "nodes",
    )


# ------------------------------------------------------------------ change events
ARTICLE_SOURCE = "kb_articles"


def change_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change events (A8 payload) for every article and every tree.

    Articles: doc_id % 10 in 0..5 CREATE, 6..7 UPDATE, 8..9 DELETE; every 7th
    article also has an older, superseded event. Trees: tree % 4 == 3 DELETE,
    1 UPDATE, else CREATE."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    doc = F.col("doc_id")
    art_op = F.when(doc % 10 < 6, 0).when(doc % 10 < 8, 1).otherwise(2)

    def ev(op, ts, suffix):
        aid = F.concat(F.lit("a"), doc.cast("string"))
        org = (doc % 3 + 1).cast("int")
        return F.struct(
            F.concat(F.lit("ev-a"), doc.cast("string"), F.lit(suffix)).alias("id"), aid.alias("articleId"),
            org.alias("orgId"), F.lit(2).alias("connectorId"), F.lit(ARTICLE_SOURCE).alias("source"),
            ts.cast("long").alias("timestamp"), op.cast("int").alias("operation"),
            F.struct(F.lit("landing-bronze").alias("bucket"), F.lit("us-east-1").alias("region"),
                     F.concat(F.lit("bronze/articles/"), org.cast("string"), F.lit("/"), aid, F.lit(".json")).alias("path")
                     ).alias("location"),
            F.concat(F.lit("job-"), (doc % 50).cast("string")).alias("jobId"))

    arts = d.select(F.explode(F.array(
        ev(art_op, F.lit(1000) + doc, ""),
        F.when(doc % 7 == 0, ev(F.lit(2) - art_op % 2, F.lit(500) + doc, "-old")))).alias("e")) \
        .where(F.col("e").isNotNull()).select("e.*")
    t = F.col("tree")
    trees = d.select((doc / NODES_PER_TREE).cast("long").alias("tree")).distinct()
    tid = (t * 1000 + 7).cast("string")
    org = (t % 3 + 1).cast("int")
    tree_ev = trees.select(
        F.concat(F.lit("ev-t"), t.cast("string")).alias("id"), tid.alias("articleId"), org.alias("orgId"),
        F.lit(1).alias("connectorId"), F.lit(TREE_PROVIDER).alias("source"), (F.lit(2000) + t).cast("long").alias("timestamp"),
        F.when(t % 4 == 3, 2).when(t % 4 == 1, 1).otherwise(0).cast("int").alias("operation"),
        F.struct(F.lit("landing-raw").alias("bucket"), F.lit("us-east-1").alias("region"),
                 F.concat(F.lit("raw/zt_trees/"), org.cast("string"), F.lit("/"), tid, F.lit("/"), tid, F.lit(".json"))
                 .alias("path")).alias("location"),
        F.concat(F.lit("job-t"), (t % 50).cast("string")).alias("jobId"))
    return arts.unionByName(tree_ev)


def article_landing(spark: SparkSession, sf_dir: str, old: bool = False) -> DataFrame:
    """Landing table of article bronze records keyed by (org_id, id). ``old`` gives the
    previous version (titles prefixed ``Old``) of the articles that exist before the
    events (doc_id % 10 >= 6)."""
    b = article_bronze(spark, sf_dir)
    if not old:
        return b
    n = F.expr("cast(substring(id, 2) as long)")
    return (b.where(n % 10 >= 6)
            .withColumn("title", F.when(F.length("title") > 0, F.concat(F.lit("Old "), F.col("title")))
                        .otherwise(F.col("title"))))


def tree_landing(spark: SparkSession, sf_dir: str, old: bool = False) -> DataFrame:
    """Landing table of raw trees keyed by (org_id, id). ``old`` gives the previous
    version of trees 1 and 3 mod 4, in which the non-content node was still content
    (so an update must make it vanish)."""
    r = tree_raw(spark, sf_dir)
    if not old:
        return r
    t = (F.col("id").try_cast("long") - 7) / 1000
    return (r.where((t % 4 == 1) | (t % 4 == 3))
            .withColumn("nodes", F.transform_values("nodes", lambda k, v: v.withField("type", F.lit("Content")))))
