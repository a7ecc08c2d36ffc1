"""Registered usage-log and search-session queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import sessions as SS
from quarry.operators import usage as U
from quarry.plans.oracle import with_ctes
from quarry.sources.derived import AGENT, USER, session_events, sessions, usage_log
from quarry.sources.tables import table

SQL: dict[str, str] = {}
HEAD_COLS = ["position", "chain_id", "chain_operation", "user_id", "org_id", "project_id", "created_at", "n_links"]

PAGE = (2, 10)
SEARCH = U.UsageFilters(search="the", start_date="2024-01-02T00:00:00", end_date="2024-01-20T00:00:00",
                        prompts=["summarize", "translate", "fix-grammar"], org_id=2)


def _heads(f: U.UsageFilters, page: int, per: int):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        h, _, _ = U.usage_page(usage_log(spark, sf_dir), f, page, per)
        return h.select(F.col("position").cast("long"), *HEAD_COLS[1:])
    return run


def _heads_sql(where: str, page: int, per: int, extra: str = "") -> str:
    return with_ctes(["usage_log"], f"""
, r AS (SELECT * FROM usage_log WHERE {where} {extra})
, keys AS (SELECT chain_id, min(created_at) AS sort_column FROM r GROUP BY chain_id)
, page AS (SELECT chain_id FROM keys ORDER BY sort_column, chain_id LIMIT {per} OFFSET {(page - 1) * per})
, cr AS (SELECT * FROM usage_log WHERE chain_id IN (SELECT chain_id FROM page))
, heads AS (
  SELECT chain_id, arg_min(chain_operation, id) AS chain_operation, arg_min(user_id, id) AS user_id,
         arg_min(org_id, id) AS org_id, arg_min(project_id, id) AS project_id,
         min(strftime(created_at, '%Y-%m-%d %H:%M:%S')) AS created_at, count(*) AS n_links
  FROM cr GROUP BY chain_id)
SELECT CAST(row_number() OVER (ORDER BY created_at, chain_id) AS BIGINT) AS position, * FROM heads""")


ALL_OPS = "chain_operation IN ('fix-grammar','summarize','summarize-into-steps','change-tone','translate'," \
          "'improve-writing','reduce-reading-complexity','reduce-reading-time','expand-writing')"
FAILED = ("AND chain_id IN (SELECT chain_id FROM usage_log WHERE operation = 'moderation' "
          "AND output = '\"true\"')")
SEARCH_SQL = ("(input ILIKE '%the%' OR output ILIKE '%the%') AND created_at >= TIMESTAMP '2024-01-02 00:00:00'"
              " AND created_at <= TIMESTAMP '2024-01-20 00:00:00'"
              " AND chain_operation IN ('summarize','translate','fix-grammar') AND org_id = 2")

SQL["usage_page"] = _heads_sql(ALL_OPS, *PAGE)
SQL["usage_failed"] = _heads_sql(ALL_OPS, 1, 20, FAILED)
SQL["usage_search"] = _heads_sql(SEARCH_SQL, 1, 25)


def usage_page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, links, _ = U.usage_page(usage_log(spark, sf_dir), U.UsageFilters(), *PAGE)
    return links.select("chain_id", "id", "operation", "created_at", F.length("input").cast("long").alias("input_len"))


SQL["usage_page_links"] = with_ctes(["usage_log"], f"""
, keys AS (SELECT chain_id, min(created_at) AS sort_column FROM usage_log WHERE {ALL_OPS} GROUP BY chain_id)
, page AS (SELECT chain_id FROM keys ORDER BY sort_column, chain_id LIMIT {PAGE[1]} OFFSET {(PAGE[0] - 1) * PAGE[1]})
SELECT chain_id, id, operation, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at,
       CAST(length(input) AS BIGINT) AS input_len
FROM usage_log WHERE chain_id IN (SELECT chain_id FROM page)""")


def usage_page_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, meta = U.usage_page(usage_log(spark, sf_dir), U.UsageFilters(), *PAGE)
    return meta


SQL["usage_page_meta"] = with_ctes(["usage_log"], f"""
, keys AS (SELECT chain_id FROM usage_log WHERE {ALL_OPS} GROUP BY chain_id)
, t AS (SELECT count(*) AS total FROM keys)
SELECT CAST({PAGE[0]} AS BIGINT) AS current_page, CAST({PAGE[1] * (PAGE[0] - 1) + 1} AS BIGINT) AS "from",
       CAST({PAGE[1] * (PAGE[0] - 1)} + greatest(least(total - {PAGE[1] * (PAGE[0] - 1)}, {PAGE[1]}), 0) AS BIGINT) AS "to",
       CAST({PAGE[1]} AS BIGINT) AS per_page, CAST(total AS BIGINT) AS total,
       CAST(ceil(total / {PAGE[1]}) AS BIGINT) AS last_page FROM t""")


# ------------------------------------------------------------------ sessions
def session_events_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = SS.session_activity(sessions(spark, sf_dir), session_events(spark, sf_dir))
    fmt = "yyyy-MM-dd HH:mm:ss"
    return a.select("id", "causer_id", "n_events", "n_errors",
                    F.date_format("first_event_at", fmt).alias("first_event_at"),
                    F.date_format("last_event_at", fmt).alias("last_event_at"))


SQL["session_events_join"] = with_ctes(["sessions", "session_events"], """
SELECT s.id, s.causer_id, count(*) AS n_events, count(*) FILTER (WHERE e.operation = 'error') AS n_errors,
       strftime(min(e.created_at), '%Y-%m-%d %H:%M:%S') AS first_event_at,
       strftime(max(e.created_at), '%Y-%m-%d %H:%M:%S') AS last_event_at
FROM sessions s JOIN session_events e ON e.semantic_search_sessions_id = s.id GROUP BY s.id, s.causer_id""")


def _session_id(user, ts):
    return F.concat(F.lit("s-"), user.cast("string"), F.lit("-"), F.date_format(ts, "yyyyMMdd"))


def event_requests(spark: SparkSession, sf_dir: str, event_type: str) -> DataFrame:
    """Requests against sessions derived from events; some carry a wrong causer type or
    a session id of the previous day, so both accepted and rejected paths are exercised."""
    ev = table(spark, sf_dir, "events").where(F.col("event_type") == event_type)
    u, eid = F.col("user_id"), F.col("event_id")
    sid = F.when(eid % 11 == 0, _session_id(u, F.col("ts") - F.expr("INTERVAL 1 DAY"))).otherwise(
        _session_id(u, F.col("ts")))
    ctype = F.when(eid % 7 == 0, F.lit("App\\Models\\Other")).when(u % 5 == 0, F.lit(AGENT)).otherwise(F.lit(USER))
    return ev.select(
        eid.alias("request_id"), sid.alias("session_id"), u.alias("causer_id"), ctype.alias("causer_type"),
        F.col("event_type").alias("operation"), F.col("props").alias("data"),
        F.col("ts").cast("timestamp").alias("requested_at"),
        F.when(F.col("value") > 100, F.lit("web")).otherwise(F.lit("chat")).alias("current_deployment_type"),
        F.concat(F.lit("loc-"), (eid % 13).cast("string")).alias("location"),
        F.when(eid % 3 == 0, F.lit(None).cast("string")).otherwise(F.lit("s-prev")).alias("previous_session_id"))


_REQ_SQL = """
, req AS (
  SELECT event_id AS request_id,
         's-' || CAST(user_id AS VARCHAR) || '-' ||
           strftime(CASE WHEN event_id % 11 = 0 THEN ts - INTERVAL 1 DAY ELSE ts END, '%Y%m%d') AS session_id,
         user_id AS causer_id,
         CASE WHEN event_id % 7 = 0 THEN 'App\\Models\\Other' WHEN user_id % 5 = 0 THEN 'App\\Models\\Agent'
              ELSE 'App\\Models\\User' END AS causer_type,
         ts AS requested_at,
         CASE WHEN value > 100 THEN 'web' ELSE 'chat' END AS current_deployment_type,
         'loc-' || CAST(event_id % 13 AS VARCHAR) AS location,
         CASE WHEN event_id % 3 = 0 THEN NULL ELSE 's-prev' END AS previous_session_id
  FROM events WHERE event_type = '{et}')"""


def append_session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = SS.append_events(sessions(spark, sf_dir), event_requests(spark, sf_dir, "click"))
    return r.select("request_id", "session_id", "accepted")


SQL["append_session_events"] = with_ctes(["sessions"], _REQ_SQL.format(et="click") + """
SELECT request_id, session_id, EXISTS (SELECT 1 FROM sessions s WHERE s.id = req.session_id
   AND s.causer_id = req.causer_id AND s.causer_type = req.causer_type) AS accepted FROM req""")


def update_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = SS.update_sessions(sessions(spark, sf_dir), event_requests(spark, sf_dir, "purchase"))
    return s.select("id", "current_deployment_type", "location", "previous_session_id")


SQL["update_sessions"] = with_ctes(["sessions"], _REQ_SQL.format(et="purchase") + """
, acc AS (SELECT req.*, row_number() OVER (PARTITION BY session_id ORDER BY requested_at DESC, request_id DESC) AS rn
          FROM req JOIN sessions s ON s.id = req.session_id AND s.causer_id = req.causer_id
                                  AND s.causer_type = req.causer_type)
SELECT s.id, a.current_deployment_type, a.location, a.previous_session_id
FROM sessions s LEFT JOIN acc a ON a.session_id = s.id AND a.rn = 1""")


QUERIES = {
    "usage_page": _heads(U.UsageFilters(), *PAGE),
    "usage_failed": _heads(U.UsageFilters(failed=True), 1, 20),
    "usage_search": _heads(SEARCH, 1, 25),
    "usage_page_links": usage_page_links,
    "usage_page_meta": usage_page_meta,
    "session_events_join": session_events_join,
    "append_session_events": append_session_events,
    "update_sessions": update_sessions,
}
