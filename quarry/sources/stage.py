"""Stage storage helpers (A1-A7): JSON stage scans/sinks, listing, location rules.

Stage objects are rows of a table (one row per document), read with an explicit
schema; locations are rewritten and parsed with column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_stage_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A1: multi-line JSON objects with a fixed schema; malformed objects are kept in
    ``_corrupt_record`` (PERMISSIVE) and each row carries its source file."""
    s = T.StructType(schema.fields + [T.StructField("_corrupt_record", T.StringType())])
    return (spark.read.schema(s).option("multiLine", True).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
            .withColumn("source_file", F.col("_metadata.file_path")))


def write_stage(df: DataFrame, path: str, partition_by: str = "org_id", fmt: str = "parquet") -> None:
    """A2: overwrite by key — dynamic partition overwrite of the touched partitions."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(partition_by).format(fmt).save(path))


def list_objects(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """A3: every object under a prefix (all pages, not only the first)."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob)
            .load(path).select("path", "modificationTime", "length"))


def rewrite_key(key: Column, from_stage: str, to_stage: str) -> Column:
    """A5: ``^bronze/`` -> ``silver/`` (anchored)."""
    return F.regexp_replace(key, "^" + from_stage + "/", to_stage + "/")


def rewrite_bucket(bucket: Column, from_stage: str, to_stage: str) -> Column:
    """A5: ``-bronze$`` -> ``-silver`` (anchored)."""
    return F.regexp_replace(bucket, "-" + from_stage + "$", "-" + to_stage)


def org_of(path: Column) -> Column:
    """Second-to-last path segment."""
    return F.element_at(F.split(path, "/"), -2)


def id_of(path: Column) -> Column:
    """Last segment without its final extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), "\\.[^.]*$", "")


def split_url(url: Column) -> tuple[Column, Column]:
    """``s3://bucket/path`` -> (bucket, path)."""
    pat = "^(?:s3://)?([^/]+)/(.*)$"
    return F.regexp_extract(url, pat, 1), F.regexp_extract(url, pat, 2)
