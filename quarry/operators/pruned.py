"""Exact vector search that reads only what can be near enough.

Items lie in clusters of unit vectors. A cluster's rows know their angle to its centre, and by the
triangle inequality on the sphere a vector at angle a from a centre is at least |t - a| from a
query at angle t from it. A search reads the clusters that can hold the nearest rows first; the
k-th distance found there is a radius that the true k-th distance does not exceed. Then it reads,
of every cluster, the rows whose angle leaves them within the radius: whole clusters fall out by
their bounds (folders), others are cut by row-group statistics (rows are sorted by angle). The
rows are those of a full scan; only how much is read depends on the data.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import search as S
from quarry.operators.filters import SearchFilters, filter_predicate

#: Clusters of a table (its centres are collected), and clusters that a search reads first.
CLUSTERS, FIRST = 64, 4
ITEMS = ("id long, document_id long, embeddings array<float>, connector_id int, tags array<string>, language string, data string, "
         "angle double, org_id int, cluster int")
#: Cluster of vectors without a direction; their distance is NaN.
NOWHERE = -1
#: Radians by which angles may be off (arccos loses half of a double's digits near zero).
SLACK = 1e-6


def _assigned(vectors: Column, centres: np.ndarray) -> Column:
    """struct(cluster, angle): the nearest centre of every vector."""
    def run(batch: pa.Array) -> pa.Array:
        cluster, angle = np.full(len(batch), NOWHERE, dtype=np.int32), np.zeros(len(batch))
        ok = pc.fill_null(pc.equal(pc.list_value_length(batch), centres.shape[1]), False).to_numpy(zero_copy_only=False) if centres.size else np.zeros(len(batch), dtype=bool)
        if ok.any():
            m = batch.filter(pa.array(ok)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, centres.shape[1])
            length = np.linalg.norm(m, axis=1)
            some = length > 0
            cos = (m[some] / length[some][:, None]) @ centres.T
            rows = np.flatnonzero(ok)[some]
            cluster[rows] = cos.argmax(axis=1)
            angle[rows] = np.arccos(np.clip(cos.max(axis=1), -1, 1))
        return pa.StructArray.from_arrays([pa.array(cluster), pa.array(angle)], ["cluster", "angle"])

    return F.arrow_udf(run, "cluster int, angle double").asNondeterministic()(vectors)


def write_clusters(items: DataFrame, documents: DataFrame, path: str, clusters: int = CLUSTERS) -> None:
    """Items with the filter columns of their documents, by org and cluster, sorted by angle. Centres
    are the vectors with the smallest hashes of their ids."""
    spark = items.sparkSession
    picked = items.where(F.size("embeddings") > 0).orderBy(F.xxhash64("id"), "id").limit(clusters).select("id", "embeddings").collect()  # ``clusters`` vectors
    found = [np.asarray(r.embeddings, dtype=np.float64) for r in picked]
    units = [v / np.linalg.norm(v) for v in found if np.linalg.norm(v) > 0 and len(v) == len(found[0])]
    centres = np.array(units) if units else np.zeros((0, 0))
    spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centres)], "cluster int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
    docs = documents.select(F.col("id").alias("document_id"), *S.FILTER_COLUMNS)
    rows = items.select("id", "document_id", "embeddings", _assigned(F.col("embeddings"), centres).alias("_c")).join(docs, "document_id")
    kinds = [c.split() for c in ITEMS.split(", ")]
    rows = rows.select("id", "document_id", "embeddings", *S.FILTER_COLUMNS, "_c.cluster", "_c.angle").select(*[F.col(c).cast(k) for c, k in kinds])
    rows = rows.hint("rebalance", "org_id", "cluster")
    rows.sortWithinPartitions("org_id", "cluster", "angle").write.mode("overwrite").partitionBy("org_id", "cluster").parquet(f"{path}/items")
    table = spark.read.schema(ITEMS).parquet(f"{path}/items")
    (table.groupBy("org_id", "cluster").agg(F.count("*").alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high"))
     .coalesce(1).write.mode("overwrite").parquet(f"{path}/bounds"))


@dataclass
class Plan:
    """What a search reads: cluster to (least, greatest) angle, and the rows of these clusters."""
    radius: float
    bands: dict[int, tuple[float, float]]
    rows: int
    total: int


class Clusters:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        rows = spark.read.schema("cluster int, centre array<double>").parquet(f"{path}/centres").collect()
        self.centres = np.array([r.centre for r in sorted(rows, key=lambda r: r.cluster)], dtype=np.float64)

    def _angles(self, query) -> np.ndarray:
        q = np.asarray(query, dtype=np.float64)
        return np.arccos(np.clip(self.centres @ (q / np.linalg.norm(q)), -1, 1)) if len(self.centres) else np.zeros(0)

    def _bounds(self, org: int | None) -> dict[int, tuple[int, float, float]]:
        b = self.spark.read.schema("org_id int, cluster int, n long, low double, high double").parquet(f"{self.path}/bounds")
        if org is not None:
            b = b.where(F.col("org_id") == org)
        return {r.cluster: (r.n, r.low, r.high) for r in b.groupBy("cluster").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).collect()}

    def _plan(self, angles: np.ndarray, bounds: dict, radius: float) -> Plan:
        bands, rows = {}, 0
        for c, (n, low, high) in bounds.items():
            if c == NOWHERE:
                if radius < math.pi:
                    continue
                band = (0.0, 0.0)
            else:
                band = (angles[c] - radius - SLACK, angles[c] + radius + SLACK)
                if band[0] > high or band[1] < low:
                    continue
            bands[c] = band
            rows += n
        return Plan(radius, bands, rows, sum(n for n, _, _ in bounds.values()))

    def _rows(self, plan: Plan, filters: SearchFilters) -> DataFrame:
        table = self.spark.read.schema(ITEMS).parquet(f"{self.path}/items").where(filter_predicate(filters))
        if not plan.bands:
            return table.where(F.lit(False))
        near = reduce(lambda a, b: a | b, [(F.col("cluster") == c) & F.col("angle").between(float(lo), float(hi)) for c, (lo, hi) in plan.bands.items()])
        return table.where(F.col("cluster").isin(list(plan.bands))).where(near)

    def plan(self, query, filters: SearchFilters, threshold: float | None, limit: int | None, dedup: bool = True, first: int = FIRST) -> Plan:
        """The radius from the clusters that can be nearest, and what lies within it."""
        angles, bounds = self._angles(query), self._bounds(filters.org_id)
        # the distance is 1 - cos, and the threshold one on the halved distance
        radius = math.pi if threshold is None or threshold >= 1 else math.acos(1 - 2 * threshold)
        if limit is not None and limit > 0:
            floor = {c: max(0.0, angles[c] - high, low - angles[c]) for c, (_, low, high) in bounds.items() if c != NOWHERE}
            chosen = sorted(floor, key=lambda c: (floor[c], angles[c]))[:first]
            wave = self._plan(angles, {c: bounds[c] for c in chosen}, radius)
            near = self._near(self._rows(wave, filters), query)
            near = S.best_per_document(near) if dedup else near
            got = near.where(~F.isnan("distance")).orderBy("distance", "item_id").limit(limit).agg(F.count("*").alias("n"), F.max("distance").alias("d")).first()  # two numbers
            if got.n == limit:
                radius = min(radius, math.acos(max(-1.0, 1 - got.d)))
        return self._plan(angles, bounds, radius)

    @staticmethod
    def _near(rows: DataFrame, query) -> DataFrame:
        return rows.select(F.col("id").alias("item_id"), "document_id", S.cosine_distance_arrow("embeddings", query).alias("distance"))

    def search(self, query, filters: SearchFilters, threshold: float = S.DEFAULT_THRESHOLD, limit: int | None = None, first: int = FIRST) -> DataFrame:
        """G1: as ``operators.search.search``."""
        if not np.linalg.norm(query) > 0:
            return self._near(self._rows(Plan(0, {}, 0, 0), filters), query)  # no row has a distance
        near = self._near(self._rows(self.plan(query, filters, threshold, limit, True, first), filters), query)
        best = S.best_per_document(near).where(F.col("distance") < F.lit(2.0 * threshold))
        return best if limit is None else S._ranked_top(best, limit)

    def search_best(self, query, filters: SearchFilters, n: int | None = S.DEFAULT_BEST_N, first: int = FIRST) -> DataFrame:
        """As ``operators.search.search_best``."""
        if np.linalg.norm(query) > 0:
            rows = self._rows(self.plan(query, filters, None, n, False, first), filters)
        else:  # every distance is NaN: no row is nearer than another
            rows = self.spark.read.schema(ITEMS).parquet(f"{self.path}/items").where(filter_predicate(filters))
        near = self._near(rows, query)
        return near if n is None else S._ranked_top(near, n)
