"""Service-style entry points named after the reference's operations.

Each method composes the DataFrame operators; results are lazy DataFrames. A
single request's filters are resolved with the same batch resolver used for
many requests (one request row in, one resolved row out — the only value
brought to the driver, to parameterise the search predicate).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from quarry.functions.tags import decode_py
from quarry.operators import catalog as C
from quarry.operators import resolve as R
from quarry.operators import search as S
from quarry.operators.filters import ScopeSource, SearchFilters
from quarry.sources.derived import USER

REQUEST_SCHEMA = ("request_id long, org_id int, deployment_id string, connectors array<int>, "
                  "scope_params array<struct<name:string,value:string>>, causer_id long, causer_type string")


@dataclass
class Request:
    org_id: int
    deployment_id: str
    connectors: list[int] | None = None
    scope_params: list[dict] | None = None
    tags: dict[str, list[str]] | None = None
    data: dict | None = None
    languages: list[str] | None = None
    causer_id: int = 0
    causer_type: str = USER


class SearchService:
    def __init__(self, spark: SparkSession, documents: DataFrame, items: DataFrame, widgets: DataFrame,
                 connectors: DataFrame, agent_tags: DataFrame):
        self.spark, self.documents, self.items = spark, documents, items
        self.widgets, self.connectors, self.agent_tags = widgets, connectors, agent_tags

    # ------------------------------------------------------------------ filters
    def resolve(self, req: Request) -> SearchFilters | None:
        """None when the widget is missing/inactive (the reference's 404)."""
        row = (self.spark.createDataFrame(
            [(0, req.org_id, req.deployment_id, req.connectors,
              None if req.scope_params is None else [(p["name"], p["value"]) for p in req.scope_params],
              req.causer_id, req.causer_type)], REQUEST_SCHEMA))
        r = R.resolve_filters(row, self.widgets, self.connectors, self.agent_tags).first()  # one row
        if r is None or r["status"] != "ok":
            return None
        scope = None
        if r["scope_sources"]:
            scope = [ScopeSource(s["connectorId"], s["action"], list(s["tags"] or [])) for s in r["scope_sources"]]
        return SearchFilters(org_id=req.org_id, connectors=list(r["connectors"] or []), tags=req.tags,
                             zt_connector_id=r["zt_connector_id"],
                             zt_tree_ids=None if r["zt_tree_ids"] is None else list(r["zt_tree_ids"]),
                             zt_tags=None if r["zt_tags"] is None else list(r["zt_tags"]),
                             data=req.data, languages=req.languages, content_scope=scope)

    # ------------------------------------------------------------------ L1, L2
    def search(self, req: Request, query_vector, limit: int | None = None, sort_by: str | None = None,
               threshold: float = S.DEFAULT_THRESHOLD, method: str = "arrow"):
        """L1: (options, meta) — options carry the API document payload; ``sort_by =
        'alphabetical'`` pins the best option and orders the rest by title."""
        f = self.resolve(req)
        if f is None:
            raise LookupError(f"Widget {req.deployment_id} not found")
        hits = S.search(self.items, self.documents, query_vector, f, threshold=threshold,
                        limit=limit, method=method)
        if sort_by == "alphabetical" and limit is None:
            hits = S.alphabetical_order(hits, self.documents)
        elif sort_by == "alphabetical":
            pos = S.alphabetical(hits, self.documents).select("item_id", "position")
            hits = hits.join(pos, "item_id")
        return C.search_response(hits, self.documents)

    def search_best(self, req: Request, query_vector, n: int | None = S.DEFAULT_BEST_N):
        """L2: closest chunks, no dedup, no threshold."""
        f = self.resolve(req)
        if f is None:
            raise LookupError(f"Widget {req.deployment_id} not found")
        return S.search_best(self.items, self.documents, query_vector, f, n=n)

    # ------------------------------------------------------------------ L3-L8
    def suggestions(self, req: Request, search: str, limit: int | None = 10) -> DataFrame:
        f = self.resolve(req)
        if f is None:
            raise LookupError(f"Widget {req.deployment_id} not found")
        return C.suggestions(self.documents, search, f, limit)

    def tags(self, org_id: int, with_meta: bool = False):
        grouped = C.distinct_tags(self.documents, org_id)
        return (grouped, C.tag_connector_counts(self.documents, org_id)) if with_meta else (grouped, None)

    def documents_list(self, org_id: int | None, connector_id: int | None, limit: int | None = None,
                       offset: int | None = None) -> DataFrame:
        return C.document_payload(C.documents_page(self.documents, org_id, connector_id, limit, offset))

    def languages(self, org_id: int) -> DataFrame:
        return C.languages(self.documents, org_id)

    def org_connectors(self, org_id: int) -> DataFrame:
        return R.org_connectors(self.connectors, org_id)

    def deployment_connectors(self) -> DataFrame:
        return R.deployment_connectors(self.widgets, self.connectors)

    def deployments_with_documents(self) -> DataFrame:
        return R.deployments_with_documents(self.widgets, self.connectors, self.documents)


def decode_tags(tags: list[str]) -> dict[str, list[str]]:
    """Driver-side helper for a single response object (H3)."""
    return decode_py(tags)
