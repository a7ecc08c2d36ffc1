"""Search-session analytics.

Requests to update a session or append an event must match the session on
(id, causer_id, causer_type); they are resolved with equi-joins and split into
accepted and rejected rows rather than failing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SESSION_KEYS = ["id", "causer_id", "causer_type"]
UPDATABLE = ["current_deployment_type", "location", "previous_session_id"]


def session_activity(sessions: DataFrame, events: DataFrame) -> DataFrame:
    """Sessions with their events' counts and span (1:N join, aggregated
    map-side per session before the join, so a hot session is combined early)."""
    per = events.groupBy(F.col("semantic_search_sessions_id").alias("id")).agg(
        F.count(F.lit(1)).alias("n_events"),
        F.count_if(F.col("operation") == "error").alias("n_errors"),
        F.min("created_at").alias("first_event_at"),
        F.max("created_at").alias("last_event_at"))
    return sessions.join(per, "id", "left")


def match_requests(sessions: DataFrame, requests: DataFrame) -> DataFrame:
    """Flags each request with ``accepted`` = a session matches on all 3 keys."""
    keys = sessions.select(*SESSION_KEYS).withColumn("_hit", F.lit(True))
    req = requests.withColumnRenamed("session_id", "id")
    return (req.join(keys, SESSION_KEYS, "left")
            .withColumn("accepted", F.coalesce("_hit", F.lit(False))).drop("_hit")
            .withColumnRenamed("id", "session_id"))


def append_events(sessions: DataFrame, requests: DataFrame) -> DataFrame:
    """(request_id, session_id, operation, message, data, accepted); accepted rows are
    the new session events (A14), rejected ones go to the rejects output."""
    return match_requests(sessions, requests)


def update_sessions(sessions: DataFrame, requests: DataFrame) -> DataFrame:
    """Overwrite the three updatable fields from the latest accepted request per
    session (NULL overwrites too). ``max_by`` is a partial aggregate, so many updates
    to one session are combined map-side."""
    acc = match_requests(sessions, requests).where("accepted")
    latest = acc.groupBy(F.col("session_id").alias("id")).agg(
        F.max_by(F.struct(*UPDATABLE), F.struct("requested_at", "request_id")).alias("_u"))
    s = sessions.join(latest, "id", "left")
    return s.select(*[F.when(F.col("_u").isNotNull(), F.col("_u")[c]).otherwise(F.col(c)).alias(c)
                      if c in UPDATABLE else F.col(c) for c in sessions.columns])


def search_event_payload(hits: DataFrame, requests: DataFrame, documents: DataFrame | None = None,
                         items: DataFrame | None = None) -> DataFrame:
    """One analytics event per search request: message ``Found {n} options for {q}``
    and a JSON payload ``{request: {query, limit, sort_by, filters}, options: [{id,
    snippet, document: {id, connectorId, documentId, title}, distance}]}`` in rank
    order. At most ``limit`` options per request, so the collected list is bounded.
    ``documents``/``items`` (optional) supply the option payload."""
    h = hits
    if items is not None and "snippet" in items.columns:
        h = h.join(items.select(F.col("id").alias("item_id"), "snippet"), "item_id", "left")
    else:
        h = h.withColumn("snippet", F.lit(None).cast("string"))
    if documents is not None:
        d = documents.select(F.col("id").alias("document_id"),
                             F.struct(F.col("id").alias("id"), F.col("connector_id").alias("connectorId"),
                                      F.col("document_id").alias("documentId"), F.col("title").alias("title"))
                             .alias("document"))
        h = h.join(d, "document_id", "left")
    else:
        h = h.withColumn("document", F.struct(F.col("document_id").alias("id")))
    option = F.struct(F.col("rank").alias("rank"), F.struct(
        F.col("item_id").alias("id"), F.col("snippet").alias("snippet"), F.col("document").alias("document"),
        F.col("distance").alias("distance")).alias("o"))
    opts = h.groupBy("request_id").agg(F.count(F.lit(1)).alias("n"),
                                       F.array_sort(F.collect_list(option)).alias("options"))
    r = requests.join(opts, "request_id", "left")
    n = F.coalesce(F.col("n"), F.lit(0))
    req_cols = [F.col(c).alias(c) for c in ("query", "limit", "sort_by", "filters") if c in requests.columns]
    return r.select(
        "request_id",
        F.concat(F.lit("Found "), n.cast("string"), F.lit(" options for "), F.col("query")).alias("message"),
        F.to_json(F.struct(F.struct(*req_cols).alias("request"),
                           F.coalesce(F.transform("options", lambda x: x["o"]), F.array()).alias("options"))
                  ).alias("data"),
        n.cast("long").alias("n_options"))


def new_sessions(requests: DataFrame, operation: str = "search") -> DataFrame:
    """One session per request (request_id, deployment_id, causer_id, causer_type,
    org_id, requested_at). The id is a deterministic UUID-shaped hash of the request,
    so a retried task creates the same row."""
    h = F.sha2(F.concat_ws("|", F.lit(operation), F.col("request_id").cast("string")), 256)
    uid = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4),
                      F.substring(h, 17, 4), F.substring(h, 21, 12))
    return requests.select(
        uid.alias("id"), F.lit(operation).alias("operation"), "deployment_id",
        F.lit(None).cast("string").alias("current_deployment_type"), F.lit(None).cast("string").alias("location"),
        F.lit(None).cast("string").alias("previous_session_id"), F.col("requested_at").alias("created_at"),
        "causer_id", "causer_type", "org_id")
