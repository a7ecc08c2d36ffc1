"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked at a few differing bits.

Links within 2 bits are found by deletion-variant signatures. The fingerprint is cut into two
32-bit segments; of two fingerprints that differ by at most 2 bits, one segment differs by at
most 1. So each segment is indexed 32 times, every time with another bit taken out, and two
fingerprints within reach agree in at least one of these 64 signatures. Fingerprints that
share a signature are joined by equality and verified on all 64 bits.

A signature that many fingerprints share (more than ``BUCKET``, as large groups of near
copies do) would give all pairs of them. Its fingerprints are linked without pairs: each one
names its 65 centres, itself and the fingerprints one bit away. Two fingerprints have a
centre in common exactly if they differ by at most 2 bits, so each centre links its
fingerprints to their smallest and no link is lost. Exact copies are one fingerprint
throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.slices import giving_back
from quarry.llm.common import documents, materialize, prepare
from quarry.llm.components import components

SHINGLE, MAX_BITS = 3, 2
#: Fingerprints of one signature that are compared pair by pair; more are linked by centres.
BUCKET = 16


def fingerprint_of(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned fingerprint: A-Z lower-cased, ASCII white space between words; no word gives 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    norm = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(norm, 42)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = [0, *ends[: len(words) - shingle].tolist()]
    stops = (ends[shingle - 1:] - 1).tolist()
    counts, n = np.zeros(64, dtype=np.int64), len(starts)
    for at in range(0, n, 1 << 16):
        h = np.array([digest(norm[s:e], 42) for s, e in zip(starts[at:at + (1 << 16)], stops[at:at + (1 << 16)])], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprint(text: Column, shingle: int = SHINGLE) -> Column:
    """The fingerprint as a long (two's complement)."""
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(np.array([fingerprint_of(t.as_py(), shingle) for t in texts], dtype=np.uint64).view(np.int64))

    return F.arrow_udf(giving_back(run), "long").asNondeterministic()(text)


def _signatures(fps: DataFrame) -> DataFrame:
    """(fp, sig): sig holds segment and wildcard (6 bits) and the segment without that bit (32)."""
    i = F.col("i")
    segment = F.when(i < 32, F.col("fp")).otherwise(F.shiftrightunsigned("fp", 32)).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    wild = F.expr("~shiftleft(1L, i % 32)")
    sig = F.expr("shiftleft(cast(i as long), 32)").bitwiseOR(segment.bitwiseAND(wild))
    return fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i")).select("fp", sig.alias("sig"))


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs within 2 bits. ``fps``: distinct ``fp``."""
    found = _signatures(fps).withColumn("n", F.count("*").over(Window.partitionBy("sig"))).where("n > 1")
    found = materialize(found)
    few = found.where(F.col("n") <= bucket)
    x, y = few.select(F.col("fp").alias("a"), "sig"), few.select(F.col("fp").alias("b"), F.col("sig").alias("sig_b"))
    pairs = x.join(y, (F.col("sig") == F.col("sig_b")) & (F.col("a") < F.col("b")))
    near = pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS).select("a", "b")

    many = found.where(F.col("n") > bucket).select("fp").distinct()
    centre = F.expr("CASE WHEN i = 64 THEN fp ELSE fp ^ shiftleft(1L, i) END")
    around = many.select("fp", F.explode(F.sequence(F.lit(0), F.lit(64))).alias("i")).select("fp", centre.alias("centre"))
    hubs = around.withColumn("least", F.min("fp").over(Window.partitionBy("centre"))).where("fp <> least")
    return near.union(hubs.select(F.col("fp").alias("a"), F.col("least").alias("b")))


def classes(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(fp, root): the smallest fingerprint that links reach, itself included."""
    under = components(links(fps, bucket))
    return fps.join(under, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    bucket: int = BUCKET) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id (smallest id reachable).

    Null or empty texts have fingerprint zero and are linked like any other. A null id gets a
    row; component_id is null only if no document of the component has an id. Repeated rows
    stay repeated. Other columns are not read."""
    fps = materialize(docs.select(F.col(id_col).alias("doc_id"), fingerprint(F.col(text_col), shingle).alias("fp")))
    per = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = materialize(classes(per.select("fp"), bucket))
    groups = per.join(roots, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    named = roots.join(groups, "root").select(F.col("fp").alias("fp_"), "component_id")
    return (fps.join(named, F.col("fp") == F.col("fp_"), "left")
            .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with one document of each component: the smallest id (null last), then by the
    row's hash; of rows alike in every column one stays."""
    names = [f"`{c}`" for c in docs.columns]
    row = F.struct(*[F.col(c) for c in names])
    rank = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(F.to_json(row) if _nested(docs) else row).alias("h"))
    fps = materialize(docs.select(rank.alias("rank"), fingerprint(F.col(text_col), shingle).alias("fp")).groupBy("fp").agg(F.min("rank").alias("rank")))
    first = fps.join(classes(fps.select("fp")).withColumnRenamed("fp", "fp_"), F.col("fp") == F.col("fp_")).groupBy("root").agg(F.min("rank").alias("rank"))
    stay = materialize(first.select(F.col("rank.id").alias("_id"), F.col("rank.h").alias("_h")).distinct())
    # one plain key, so that the join and the numbering share a shuffle
    keyed = docs.select(row.alias("_row"), F.concat_ws(":", rank["id"].cast("string"), rank["h"].cast("string")).alias("_key"))
    stay = stay.select(F.concat_ws(":", F.col("_id").cast("string"), F.col("_h").cast("string")).alias("_stay"))
    kept = keyed.join(stay, F.col("_key") == F.col("_stay"), "left_semi")
    one = F.row_number().over(Window.partitionBy("_key").orderBy("_key"))
    return kept.withColumn("_n", one).where("_n = 1").select("_row.*")


def _nested(docs: DataFrame) -> bool:
    """Hashing maps is not allowed; their rows are hashed as JSON."""
    return any("map<" in kind for _, kind in docs.dtypes)


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return near_duplicates(documents(spark, sf_dir))


QUERIES = {"op2_simhash_dedup": op2_simhash_dedup}
