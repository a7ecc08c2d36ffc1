"""Token counts as delta-maintained rollups.

A rollup is a folder in shared storage. Every batch of changes is committed as two Parquet
folders named by its number: ``ledger/batch=<n>`` has the signed per-document rows (+ what
came in, - what it replaces) and ``deltas/batch=<n>`` their sums by source, language and
tokenizer version. Totals are sums over the deltas, so nothing is ever recounted. A batch
looks only at batches before it and overwrites its own folders, so a batch that runs again,
after a crash or by mistake, leaves what it left before.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import documents, materialize, prepare, table
from quarry.session import ensure_checkpoint_dir

LEDGER = "doc_id long, source string, lang string, version string, sign int, n_tokens long"
DELTAS = "source string, lang string, version string, n_docs long, n_tokens long"
KEY = ["source", "lang", "version"]


def versions(text: Column) -> dict[str, Column]:
    """Token counts by tokenizer version: words between ASCII white space; four bytes a token."""
    return {
        "space-1": F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long"),
        "bytes-4": F.ceil(F.coalesce(F.octet_length(text), F.lit(0)) / 4).cast("long"),
    }


def counted(docs: DataFrame) -> DataFrame:
    """(doc_id, source, lang, version, n_tokens): one row per document and version; a null text has 0."""
    each = F.array(*[F.struct(F.lit(v).alias("version"), n.alias("n_tokens")) for v, n in versions(F.col("text")).items()])
    return docs.select("doc_id", "source", "lang", F.explode(each).alias("c")).select("doc_id", "source", "lang", "c.*")


def create(spark: SparkSession, path: str) -> None:
    """An empty rollup: batch 0 of ledger and deltas."""
    spark.createDataFrame([], LEDGER).write.mode("overwrite").parquet(f"{path}/ledger/batch=0")
    spark.createDataFrame([], DELTAS).write.mode("overwrite").parquet(f"{path}/deltas/batch=0")


def _ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LEDGER + ", batch int").option("basePath", f"{path}/ledger").parquet(f"{path}/ledger")


def current(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """What counts now (or before a batch), per document and version."""
    rows = _ledger(spark, path)
    rows = rows if before is None else rows.where(F.col("batch") < before)
    live = rows.groupBy("doc_id", *KEY).agg(F.sum("sign").alias("live"), F.sum(F.col("sign") * F.col("n_tokens")).alias("n_tokens"))
    return live.where("live > 0").drop("live")


def commit(spark: SparkSession, path: str, batch: int, changes: DataFrame) -> None:
    """Applies ``changes``: op (insert, revise, delete), doc_id, source, lang, text and seq.

    Of several changes to a document the one with the greatest seq holds (ties: delete before
    revise before insert, then the greatest text). An insert of a document that is there counts
    as a revision; a delete or revision of one that is not there takes nothing away. Revised rows
    bring their source and language anew. Rows without an id or with another op are not changes.
    Null source and language are groups of their own."""
    if batch < 1:
        raise ValueError("batches count from 1")
    known = changes.where(F.col("doc_id").isNotNull() & F.col("op").isin("insert", "revise", "delete"))
    prio = F.when(F.col("op") == "delete", 2).when(F.col("op") == "revise", 1).otherwise(0)
    n = F.struct(*[c.alias(v) for v, c in versions(F.col("text")).items()])  # counts go on, texts don't
    one = known.select("doc_id", "op", "source", "lang", "seq", prio.alias("prio"), F.xxhash64("text", "source", "lang").alias("h"), n.alias("n"))
    last = one.groupBy("doc_id").agg(F.max(F.struct("seq", "prio", "h", "op", "source", "lang", "n")).alias("c")).select("doc_id", "c.*")
    last = materialize(last)
    each = F.array(*[F.struct(F.lit(v).alias("version"), F.col("n")[v].alias("n_tokens")) for v in versions(F.lit(""))])
    new = (last.where("op <> 'delete'").select("doc_id", "source", "lang", F.explode(each).alias("e"))
           .select("doc_id", "source", "lang", "e.version", F.lit(1).alias("sign"), "e.n_tokens"))
    gone = current(spark, path, batch).join(last.select("doc_id"), "doc_id", "left_semi")
    old = gone.select("doc_id", "source", "lang", "version", F.lit(-1).alias("sign"), "n_tokens")
    new.unionByName(old).write.mode("overwrite").parquet(f"{path}/ledger/batch={batch}")
    signed = spark.read.schema(LEDGER).parquet(f"{path}/ledger/batch={batch}")
    delta = signed.groupBy(*KEY).agg(F.sum("sign").cast("long").alias("n_docs"), F.sum(F.col("sign") * F.col("n_tokens")).alias("n_tokens"))
    delta.where("n_docs <> 0 OR n_tokens <> 0").write.mode("overwrite").parquet(f"{path}/deltas/batch={batch}")


def totals(spark: SparkSession, path: str) -> DataFrame:
    """source, lang, version, n_docs, n_tokens of everything committed; groups without a document are left out."""
    deltas = spark.read.schema(DELTAS + ", batch int").option("basePath", f"{path}/deltas").parquet(f"{path}/deltas")
    return deltas.groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0")


def op6_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after three batches over ``documents``: all of them come in; those whose text a
    smaller id has go; those labelled low quality are revised to their first line. The last
    batch is committed twice, which changes nothing."""
    prepare(spark)
    docs = documents(spark, sf_dir).select("doc_id", "source", "lang", "text")
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/rollup/{uuid.uuid4().hex}"
    create(spark, path)
    change = lambda df, op: df.select("doc_id", F.lit(op).alias("op"), "source", "lang", "text", F.lit(1).alias("seq"))
    commit(spark, path, 1, change(docs, "insert"))

    hashed = docs.select("doc_id", "source", "lang", F.md5(F.col("text").cast("binary")).alias("h")).where("h IS NOT NULL")
    first = hashed.groupBy("h").agg(F.min("doc_id").alias("least"))
    copies = hashed.join(first, "h").where("doc_id > least").withColumn("text", F.lit(None).cast("string"))
    commit(spark, path, 2, change(copies, "delete"))

    low = table(spark, sf_dir, "labels").where("quality = 0").select("doc_id").distinct()
    there = current(spark, path).select("doc_id").distinct()
    cut = docs.withColumn("text", F.substring_index("text", "\n", 1))
    revised = change(cut.join(low, "doc_id", "left_semi").join(there, "doc_id", "left_semi"), "revise")
    commit(spark, path, 3, revised)
    return totals(spark, path)


QUERIES = {"op6_token_rollup": op6_token_rollup}
SQL = {"op6_token_rollup": r"""
WITH kept AS (
  SELECT * FROM (SELECT *, min(doc_id) OVER (PARTITION BY text) AS least FROM documents) WHERE text IS NULL OR doc_id = least),
low AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 0),
last AS (
  SELECT k.source, k.lang, CASE WHEN low.doc_id IS NULL THEN k.text ELSE split_part(k.text, chr(10), 1) END AS text
  FROM kept k LEFT JOIN low ON k.doc_id = low.doc_id),
each AS (
  SELECT source, lang, 'space-1' AS version, coalesce(len(regexp_extract_all(text, '[^ \t-\r]+')), 0) AS n FROM last
  UNION ALL SELECT source, lang, 'bytes-4', ceil(coalesce(strlen(text), 0) / 4.0)::BIGINT FROM last)
SELECT source, lang, version, count(*) AS n_docs, sum(n)::BIGINT AS n_tokens FROM each GROUP BY ALL"""}
