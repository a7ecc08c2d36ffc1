"""Usage-log pagination over operation chains (L10: B15-B19, E5-E8, G4, D4-D5).

Plan: filtered rows -> per-chain sort key (partial aggregate) -> one page of
chain ids (TakeOrderedAndProject bounded by offset+limit) -> broadcast
left-semi join of *all* rows of those chains (the page is at most
``MAX_PER_PAGE`` ids, a proven bound) -> per-chain header by ``min_by``
(partial aggregate, so a chain holding a third of all rows is combined
map-side) and links as rows ordered by id.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.sources.derived import AUTHORING_OPERATIONS

MAX_PER_PAGE = 100
TS_FMT = "yyyy-MM-dd HH:mm:ss"


@dataclass
class UsageFilters:
    search: str | None = None
    start_date: str | None = None  # ISO, inclusive
    end_date: str | None = None    # ISO, inclusive
    prompts: list[str] = field(default_factory=list)  # empty = all nine operations
    org_id: int | None = None
    failed: bool | None = None


def filtered_rows(log: DataFrame, f: UsageFilters) -> DataFrame:
    rows = log
    if f.search:
        pat = f"%{f.search}%"
        rows = rows.where(F.col("input").ilike(pat) | F.col("output").ilike(pat))
    if f.start_date:
        rows = rows.where(F.col("created_at") >= F.to_timestamp(F.lit(f.start_date)))
    if f.end_date:
        rows = rows.where(F.col("created_at") <= F.to_timestamp(F.lit(f.end_date)))
    rows = rows.where(F.col("chain_operation").isin(f.prompts or AUTHORING_OPERATIONS))
    if f.org_id:
        rows = rows.where(F.col("org_id") == f.org_id)
    if f.failed is not None:
        expect = '"true"' if f.failed else '"false"'
        flagged = log.where((F.col("operation") == "moderation") & (F.col("output") == expect)).select("chain_id")
        rows = rows.join(flagged, "chain_id", "left_semi")
    return rows


def chain_keys(rows: DataFrame, sort_by: str = "created_at") -> DataFrame:
    """E5: (chain_id, sort_column = min(sort_by)) — the reference always takes MIN."""
    return rows.groupBy("chain_id").agg(F.min(sort_by).alias("sort_column"))


def page_of_chains(keys: DataFrame, page: int, per_page: int, sort_dir: str = "asc") -> DataFrame:
    """One page of chain ids; ties by chain id."""
    if not 1 <= per_page <= MAX_PER_PAGE:
        raise ValueError(f"per_page must be in 1..{MAX_PER_PAGE}")
    order = F.col("sort_column").asc() if sort_dir == "asc" else F.col("sort_column").desc()
    return keys.orderBy(order, F.col("chain_id").asc()).offset((page - 1) * per_page).limit(per_page)


def chain_rows(log: DataFrame, page_ids: DataFrame) -> DataFrame:
    """All rows of the page's chains (the page is bounded, so it is broadcast)."""
    return log.join(F.broadcast(page_ids.select("chain_id")), "chain_id", "left_semi")


def chain_headers(rows: DataFrame, sort_by: str = "created_at", sort_dir: str = "asc") -> DataFrame:
    """E7 head: first-row columns (lowest id), link count and min formatted created_at;
    ``position`` orders the page by the sort column (desc when requested)."""
    fmt = F.date_format("created_at", TS_FMT)
    heads = rows.groupBy("chain_id").agg(
        F.min_by("chain_operation", "id").alias("chain_operation"),
        F.min_by("user_id", "id").alias("user_id"),
        F.min_by("org_id", "id").alias("org_id"),
        F.min_by("project_id", "id").alias("project_id"),
        F.min(fmt).alias("created_at"),
        F.count(F.lit(1)).alias("n_links"),
    )
    if sort_by not in heads.columns:
        raise ValueError(f"chains have no column {sort_by} to sort by")
    key = F.col(sort_by)
    order = key.desc() if sort_dir == "desc" else key.asc()
    # at most one page of rows
    return heads.withColumn("position", F.row_number().over(Window.orderBy(order, F.col("chain_id").asc())))


def chain_links(rows: DataFrame) -> DataFrame:
    """E7 links: one row per link, ordered by id within the chain."""
    return rows.select("chain_id", "id", "operation", "prompt", "input", "response", "output",
                       F.date_format("created_at", TS_FMT).alias("created_at"))


def page_meta(keys: DataFrame, page: int, per_page: int) -> DataFrame:
    """E6 + E8: one-row page metadata; the rows on the page are
    ``clamp(total - offset, 0, per_page)``, so one aggregate suffices."""
    off = per_page * (page - 1)
    total = F.col("total")
    n = F.greatest(F.least(total - F.lit(off), F.lit(per_page)), F.lit(0))
    return keys.agg(F.count(F.lit(1)).alias("total")).select(
        F.lit(page).cast("long").alias("current_page"),
        F.lit(off + 1).cast("long").alias("from"),
        (F.lit(off) + n).cast("long").alias("to"),
        F.lit(per_page).cast("long").alias("per_page"),
        total.cast("long").alias("total"),
        F.ceil(total / F.lit(per_page)).cast("long").alias("last_page"),
    )


def usage_page(log: DataFrame, f: UsageFilters, page: int = 1, per_page: int = 10,
               sort_by: str = "created_at", sort_dir: str = "asc"):
    """Returns (headers, links, meta) DataFrames."""
    keys = chain_keys(filtered_rows(log, f), sort_by)
    ids = page_of_chains(keys, page, per_page, sort_dir)
    rows = chain_rows(log, ids)
    return chain_headers(rows, sort_by, sort_dir), chain_links(rows), page_meta(keys, page, per_page)


def last_page(total: int, per_page: int) -> int:
    return math.ceil(total / per_page)
