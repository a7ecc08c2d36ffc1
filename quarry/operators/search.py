"""Vector search over the gold tables.

Plan shape for one query vector:

    items(id, document_id, embeddings) -> distance (computed once, where the vectors are read)
      -> row_number() over (document_id order by distance, item_id) = 1   (F1;
         Spark plans a partial WindowGroupLimit before the shuffle, so at most one
         row per document per task is shuffled)
      -> left-semi documents --filter(B1..B8)--> ids, on the same key
      -> distance < 2t (B9), applied after the dedup like the reference
      -> top-k (TakeOrderedAndProject) -> late join of the document payload (D3).

Only (item_id, document_id, distance) travel through shuffles, whether the ids fit a broadcast
or not: the distance comes before the join, so the vector column never leaves the scan stage.
The price is a distance for every item read. A search table (``write_search_table``) carries
the documents' filter columns on its items, by org: there the filters prune the scan itself and
nothing is joined before the top-k.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.tags import encode_py
from quarry.functions.vector import cosine_distance, cosine_distance_arrow
from quarry.operators.filters import TREE_TAG_KEY, SearchFilters, data_literals, filter_predicate, scope_parts

DEFAULT_THRESHOLD = 0.70  # distance cut-off is threshold * 2
DEFAULT_BEST_N = 5


def _distance(method: str):
    return cosine_distance_arrow if method == "arrow" else cosine_distance


#: Columns of documents that filters read.
FILTER_COLUMNS = ["org_id", "connector_id", "tags", "language", "data"]


def write_search_table(items: DataFrame, documents: DataFrame, path: str) -> None:
    """Items with the filter columns of their documents, in one folder per org: the one time that
    vectors are joined, when gold is written. Items without a document are left out."""
    docs = documents.select(F.col("id").alias("document_id"), *FILTER_COLUMNS)
    items.select("id", "document_id", "embeddings").join(docs, "document_id").write.mode("overwrite").partitionBy("org_id").parquet(path)


def candidates(items: DataFrame, documents: DataFrame, query, filters: SearchFilters,
               method: str = "arrow") -> DataFrame:
    """(item_id, document_id, distance) of the items of documents passing the filters. Items that
    carry the filter columns are filtered where they are read; others meet the documents' ids
    after their distance is known."""
    near = [F.col("id").alias("item_id"), "document_id", _distance(method)("embeddings", query).alias("distance")]
    if set(FILTER_COLUMNS) <= set(items.columns):
        return items.where(filter_predicate(filters)).select(*near)
    doc_ids = documents.where(filter_predicate(filters)).select(F.col("id").alias("document_id"))
    return items.select(*near).join(doc_ids, "document_id", "left_semi")


def best_per_document(cand: DataFrame, key: str = "document_id", extra_keys: tuple = ()) -> DataFrame:
    """one best (lowest distance, then lowest item id) chunk per document."""
    w = Window.partitionBy(*extra_keys, key).orderBy(F.col("distance").asc(), F.col("item_id").asc())
    return cand.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def search(items: DataFrame, documents: DataFrame, query, filters: SearchFilters,
           threshold: float = DEFAULT_THRESHOLD, limit: int | None = None,
           method: str = "arrow") -> DataFrame:
    """G1: best chunk per document under the threshold, by distance, top ``limit``.

    Returns (item_id, document_id, distance[, rank]); ``rank`` (1-based, ties by
    item id) only when ``limit`` is given, since ranking an unbounded result
    would need a single global ordering task.
    """
    cand = candidates(items, documents, query, filters, method)
    best = best_per_document(cand).where(F.col("distance") < F.lit(2.0 * threshold))
    if limit is None:
        return best
    return _ranked_top(best, limit)


def _ranked_top(df: DataFrame, limit: int) -> DataFrame:
    top = df.orderBy(F.col("distance").asc(), F.col("item_id").asc()).limit(limit)
    # `top` is at most `limit` rows, so this unpartitioned window is bounded.
    return top.withColumn("rank", F.row_number().over(Window.orderBy("distance", "item_id")))


def search_best(items: DataFrame, documents: DataFrame, query, filters: SearchFilters,
                n: int | None = DEFAULT_BEST_N, method: str = "arrow") -> DataFrame:
    """The n closest chunks, no per-document dedup, no threshold."""
    cand = candidates(items, documents, query, filters, method)
    if n is None:
        return cand
    return _ranked_top(cand, n)


def with_payload(hits: DataFrame, documents: DataFrame, cols=("title",)) -> DataFrame:
    """D3: late materialisation of document columns for the (small) hit list."""
    payload = documents.select(F.col("id").alias("document_id"), *cols)
    return hits.join(payload, "document_id", "inner")


def alphabetical(hits: DataFrame, documents: DataFrame) -> DataFrame:
    """keep the most relevant hit first, order the rest by (title, node_id),
    ties by relevance. Adds ``position`` (1-based); each row keeps its own distance."""
    node_id = F.get_json_object(F.col("data"), "$.node_id")
    h = with_payload(hits, documents, ("title", "data")).withColumn("node_id", node_id)
    w = Window.orderBy(F.when(F.col("rank") == 1, 0).otherwise(1), F.col("title").asc(),
                       F.col("node_id").asc_nulls_first(), F.col("rank").asc())
    return h.withColumn("position", F.row_number().over(w)).drop("data")


def alphabetical_order(hits: DataFrame, documents: DataFrame) -> DataFrame:
    """F2 for a result without a limit: the closest hit first, the rest by (title, node_id),
    ties by distance. A distributed sort; ``position`` grows in its order, with gaps."""
    best = hits.agg(F.min(F.struct("distance", "item_id")).alias("b")).first()["b"]  # one row
    first = F.lit(False) if best is None else F.col("item_id") == best["item_id"]
    node_id = F.get_json_object(F.col("data"), "$.node_id")
    h = with_payload(hits, documents, ("title", "data")).withColumn("node_id", node_id)
    h = h.orderBy(F.when(first, 0).otherwise(1), F.col("title").asc(), F.col("node_id").asc_nulls_first(), "distance", "item_id")
    return h.withColumn("position", F.monotonically_increasing_id()).drop("data", "title", "node_id")


# ------------------------------------------------------------------ K3: many queries
#: Bytes of vectors in one block of items, and queries in one block at most.
BLOCK_BYTES = 2 << 20
BLOCK_QUERIES = 2048
#: Distances in one matrix, and masks of single conditions that a block of items keeps.
CELLS = 1 << 21
KEPT_MASKS = 2048
#: Request columns that filter, and the item columns they read.
REQUEST_FILTERS = {
    "connectors": "array<int>", "zt_connector_id": "int", "zt_tree_ids": "array<int>", "zt_tags": "array<string>",
    "tags": "array<string>", "languages": "array<string>", "data": "string",
    "scope_sources": "array<struct<connectorId:int,action:string,tags:array<string>>>"}


def _grouped(values: list, rows: list) -> dict:
    out: dict = {}
    for v, r in zip(values, rows):
        out.setdefault(v, []).append(r)
    return {v: np.array(r) for v, r in out.items()}


class _Items:
    """One block of items in a task: vectors and filter columns, with the masks already made."""

    def __init__(self, batch: pa.RecordBatch):
        order = np.lexsort((batch["id"].to_numpy(), batch["document_id"].to_numpy()))
        batch = batch.take(pa.array(order))  # by document, then by item id
        self.batch, self.n = batch, batch.num_rows
        self.ids, self.docs = batch["id"].to_numpy(), batch["document_id"].to_numpy()
        v = batch["embeddings"]
        self.vectors = np.asarray(v.flatten(), dtype=np.float64).reshape(self.n, -1)
        self.norms = np.linalg.norm(self.vectors, axis=1)
        self.made: dict = {}

    def once(self, key, build):
        """A mask or an index of the block that requests share."""
        if key not in self.made:
            if len(self.made) >= KEPT_MASKS:
                self.made.clear()
            self.made[key] = build()
        return self.made[key]

    def connector(self, c) -> np.ndarray:
        return self.once(("c", c), lambda: self.batch["connector_id"].to_numpy(zero_copy_only=False) == c)

    def connectors(self, ids) -> np.ndarray:
        return self.once(("cs", tuple(ids)), lambda: np.isin(self.batch["connector_id"].to_numpy(zero_copy_only=False), ids))

    def _rows(self, by_value: dict, values) -> np.ndarray:
        hit = np.zeros(self.n, dtype=bool)
        for v in values:
            hit[by_value.get(v, [])] = True
        return hit

    def tagged(self, tags) -> np.ndarray:
        def rows_by_tag():
            tags_col = self.batch["tags"]
            row = np.repeat(np.arange(self.n), pc.fill_null(pc.list_value_length(tags_col), 0).to_numpy())
            return _grouped(tags_col.flatten().to_pylist(), row.tolist())

        return self.once(("t", tuple(tags)), lambda: self._rows(self.once("tags", rows_by_tag), [t for t in tags if t is not None]))

    def json_in(self, key, texts) -> np.ndarray:
        def parsed():
            out = []
            for d in self.batch["data"].to_pylist():
                try:
                    out.append(json.loads(d) if d else None)
                except ValueError:
                    out.append(None)
            return out

        def text(v):  # 4.0 and 4 are one number
            return json.dumps(int(v) if isinstance(v, float) and v.is_integer() else v, ensure_ascii=False)

        def rows_by_text():
            have = [(r, text(d[key])) for r, d in enumerate(self.once("data", parsed)) if isinstance(d, dict) and key in d]
            return _grouped([t for _, t in have], [r for r, _ in have])

        return self.once(("j", key, frozenset(texts)), lambda: self._rows(self.once(("json", key), rows_by_text), texts))

    def language(self, prefixes) -> np.ndarray:
        def build():
            langs = self.batch["language"].to_pylist()
            return np.array([x is not None and x.startswith(tuple(prefixes)) for x in langs], dtype=bool)

        return self.once(("l", tuple(prefixes)), build)

    def mask(self, f: dict) -> np.ndarray:
        """Rows that a request's filters keep: the rules of ``filter_predicate`` on arrays."""
        ok = np.ones(self.n, dtype=bool)
        if "connectors" in f:
            ok &= self.connectors(f["connectors"] or [])
        tree = f.get("zt_connector_id")
        if tree and f.get("zt_tree_ids"):
            ok &= ~self.connector(tree) | self.json_in("tree_id", {json.dumps(str(t * 1000)) for t in f["zt_tree_ids"]})
        if tree and f.get("zt_tags"):
            ok &= ~self.connector(tree) | self.tagged(encode_py({TREE_TAG_KEY: list(f["zt_tags"])}))
        if f.get("tags"):
            ok &= self.tagged(f["tags"])
        if f.get("data"):
            for key, texts in data_literals(json.loads(f["data"])).items():
                ok &= self.json_in(key, set(texts))
        if f.get("languages"):
            ok &= self.language(f["languages"])
        if f.get("scope_sources"):
            some, every = scope_parts([(s["connectorId"], s["action"], s["tags"]) for s in f["scope_sources"]], self.connector, self.tagged)
            if some:
                ok &= np.logical_or.reduce(some)
            for e in every:
                ok &= e
        return ok


def _nearest(items: _Items, masks: np.ndarray, which: np.ndarray, queries: np.ndarray, k: int, cutoff: float, dedup: bool):
    """(query number, row, distance) of the k nearest rows of every query among those its mask
    (``masks[which]``) keeps, ties kept; one row per document if ``dedup``."""
    norms = np.linalg.norm(queries, axis=1)
    step = max(1, CELLS // max(1, items.n))
    for s in range(0, len(queries), step):
        w = which[s:s + step]
        rows = np.flatnonzero(masks[np.unique(w)].any(axis=0))
        if not len(rows):
            continue
        with np.errstate(divide="ignore", invalid="ignore"):
            d = 1.0 - (queries[s:s + step] @ items.vectors[rows].T) / (norms[s:s + step, None] * items.norms[rows][None])
            d[~(masks[w][:, rows] & (d < cutoff))] = np.inf
        best = d
        if dedup:  # rows are sorted by document and item id
            doc = items.docs[rows]
            first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
            best = np.minimum.reduceat(d, first, axis=1)
        keep = np.isfinite(best)
        if best.shape[1] > k:
            keep &= best <= np.partition(best, k - 1, axis=1)[:, k - 1:k]
        q, g = np.nonzero(keep)
        if not len(q):
            continue
        near = best[q, g]
        if dedup:  # the first of a document's nearest rows stays
            n = np.diff(np.r_[first, len(doc)])[g]
            begin = np.cumsum(n) - n
            at = np.repeat(first[g] - begin, n) + np.arange(n.sum())
            same = d[np.repeat(q, n), at] == np.repeat(near, n)
            g = np.minimum.reduceat(np.where(same, at, len(rows)), begin)
        yield q + s, rows[g], near


def _item_blocks(batches):
    for b in batches:
        orgs = b["org_id"].to_numpy(zero_copy_only=False)
        for org in np.unique(orgs):
            part = b.take(pa.array(np.flatnonzero(orgs == org)))
            dims = max(1, len(part["embeddings"][0]))
            step = max(1, BLOCK_BYTES // (4 * dims))
            for s in range(0, part.num_rows, step):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema) as w:
                    w.write_batch(part.slice(s, step))
                yield pa.RecordBatch.from_arrays([pa.array([int(org)], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["org_id", "items"])


def _match_blocks(k: int, cutoff: float, dedup: bool):
    def run(batches):
        held, items = None, None
        for b in batches:
            for raw, asked in zip(b["items"], b["queries"]):
                raw = raw.as_buffer()
                if held is None or not raw.equals(held):  # a block meets all its requests one after the other
                    held = pa.py_buffer(raw.to_pybytes())
                    items = _Items(pa.ipc.open_stream(held).read_next_batch())
                queries = asked.values
                ids = queries.field("query_id").to_numpy(zero_copy_only=False)
                filters = queries.field("filters").dictionary_encode()  # requests with equal filters share a mask
                which = filters.indices.to_numpy(zero_copy_only=False)
                masks = np.array([items.mask(json.loads(f)) for f in filters.dictionary.to_pylist()])
                dims = items.vectors.shape[1]
                vectors = np.asarray(queries.field("embedding").flatten(), dtype=np.float64).reshape(-1, dims)
                order = np.argsort(which, kind="stable")
                for n, row, d in _nearest(items, masks, which[order], vectors[order], k, cutoff, dedup):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[order][n], items.ids[row], items.docs[row], d)],
                                                     ["query_id", "item_id", "document_id", "distance"])

    return run


def batch_search(items: DataFrame, documents: DataFrame, queries: DataFrame, filters: SearchFilters,
                 threshold: float | None = DEFAULT_THRESHOLD, k: int = 10, dedup: bool = True) -> DataFrame:
    """K3/L1: exact top-k documents (best chunk each, under the threshold) for many query
    vectors at once. ``queries`` = (query_id, org_id, embedding) and any of the columns in
    ``REQUEST_FILTERS``, which hold each request's own filters (B2-B8; connectors apply
    whenever the column is there); ``filters`` holds what all requests have in common.

    Items are read once and packed into blocks of one org, queries into blocks of one org;
    blocks meet in an equality join on the org and on a part of its queries, so no vector
    passes the driver, neither side has to fit in memory, and one org is not one task. A pair of blocks gives at most the k nearest documents of each
    query, which two windows merge: a document among the k nearest overall is among those of
    the block that holds its nearest chunk. ``dedup=False, threshold=None`` gives G2 per query."""
    asked = [c for c in REQUEST_FILTERS if c in queries.columns]
    doc_cols = [F.col("id").alias("document_id"), "org_id"]
    if asked:
        doc_cols += [F.col("connector_id").cast("int").alias("connector_id"), "tags", "language", "data"]
    docs = documents.where(filter_predicate(filters)).select(*doc_cols)
    rows = (items.select(F.col("id").cast("long").alias("id"), "document_id", "embeddings").where(F.size("embeddings") > 0)
            .join(docs, "document_id", "inner"))
    item_blocks = rows.mapInArrow(_item_blocks, "org_id long, items binary")
    n = queries.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dims")).first()  # two numbers
    per_block = max(1, min(BLOCK_QUERIES, BLOCK_BYTES // (8 * max(1, n["dims"] or 1))))
    n_blocks = max(1, -(-n["n"] // per_block))
    filters_of = F.to_json(F.struct(*[F.col(c).cast(REQUEST_FILTERS[c]).alias(c) for c in asked]), {"ignoreNullFields": "false"}) if asked else F.lit("{}")
    wanted = F.struct(F.col("query_id").cast("long").alias("query_id"), "embedding", filters_of.alias("filters"))
    block = F.pmod(F.xxhash64("query_id"), F.lit(n_blocks))
    parts = min(n_blocks, queries.sparkSession.sparkContext.defaultParallelism)  # an org's blocks of queries are dealt to so many tasks
    blocks = (queries.where(F.size("embedding") > 0).groupBy(F.col("org_id").cast("long").alias("q_org"), block.alias("block"))
              .agg(F.collect_list(wanted).alias("queries")).select("q_org", F.pmod("block", F.lit(parts)).alias("q_part"), "queries"))  # about per_block queries each
    dealt = item_blocks.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"), F.lit(1).cast("long"))))
    pairs = (dealt.hint("merge").join(blocks, (F.col("org_id") == F.col("q_org")) & (F.col("part") == F.col("q_part")))
             .select("items", "queries"))
    cutoff = np.inf if threshold is None else 2.0 * threshold
    cands = pairs.mapInArrow(_match_blocks(k, cutoff, dedup), "query_id long, item_id long, document_id long, distance double").repartition("query_id")
    best = best_per_document(cands, extra_keys=("query_id",)) if dedup else cands
    w = Window.partitionBy("query_id").orderBy(F.col("distance").asc(), F.col("item_id").asc())
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
