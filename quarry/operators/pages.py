"""Deep pages from an order-statistics index.

Documents lie in ranges of their id, each sorted by id, and an index counts every range's rows by
org and connector. A page's place follows from sums of the index (one row per range), so a page
reads the range or ranges it lies in and nothing before them, however deep it is.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.filters import documents_by_org_connector

#: Ranges of a table; the index has at most this many rows for one org and connector.
RANGES = 256


def write_ranges(documents: DataFrame, path: str, ranges: int = RANGES) -> None:
    """Writes documents by ranges of about equal size and their index. Equal ids share a range."""
    dealt = documents.repartitionByRange(ranges, "id").sortWithinPartitions("id").withColumn("range", F.spark_partition_id())
    dealt.write.mode("overwrite").partitionBy("range").parquet(f"{path}/documents")
    rows = documents.sparkSession.read.schema(f"{_ddl(documents)}, range int").parquet(f"{path}/documents")
    (rows.groupBy("range", "org_id", "connector_id").agg(F.count("*").alias("n"), F.min("id").alias("low"))
     .coalesce(1).write.mode("overwrite").parquet(f"{path}/index"))


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


class Pages:
    def __init__(self, spark: SparkSession, path: str, like: DataFrame):
        self.spark, self.path, self.ddl, self.columns = spark, path, _ddl(like), like.columns

    def locate(self, org_id: int | None, connector_id: int | None, limit: int, offset: int) -> tuple[list[int], int, int]:
        """(ranges of the page, rows to skip within them, rows that pass the filter in all ranges)."""
        index = self.spark.read.schema("range int, org_id int, connector_id int, n long, low long").parquet(f"{self.path}/index")
        counts = index.where(documents_by_org_connector(org_id, connector_id)).groupBy("range").agg(F.sum("n").alias("n")).collect()  # RANGES rows
        before, held, skip = 0, [], 0
        for r in sorted(counts, key=lambda r: r.range):
            if before < offset + limit and before + r.n > offset:
                if not held:
                    skip = offset - before if offset > before else 0
                held.append(r.range)
            before += r.n
        return held, skip, before

    def page(self, org_id: int | None, connector_id: int | None, limit: int, offset: int) -> DataFrame:
        """As ``catalog.documents_page`` with a limit and an offset."""
        held, skip, _ = self.locate(org_id, connector_id, limit, offset)
        rows = self.spark.read.schema(f"{self.ddl}, range int").parquet(f"{self.path}/documents")
        rows = rows.where(F.col("range").isin(held) if held else F.lit(False)).where(documents_by_org_connector(org_id, connector_id))
        return rows.select(*self.columns).orderBy("id").offset(skip).limit(limit)


def fresh(documents: DataFrame, root: str, ranges: int = RANGES) -> Pages:
    """Writes the documents to a new folder below ``root``."""
    path = f"{root.rstrip('/')}/pages-{uuid.uuid4().hex}"
    write_ranges(documents, path, ranges)
    return Pages(documents.sparkSession, path, documents)
