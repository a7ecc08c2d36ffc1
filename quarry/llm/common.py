"""Helpers shared by the training-data operators: scans, hold-out split, Arrow text slices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import slices
from quarry.session import materialize, prepare
from quarry.sources.tables import table

__all__ = ["discard", "documents", "held_out", "materialize", "prepare", "release", "store", "text_slices", "codepoints", "table"]

#: Text bytes handled at once inside a task; a longer single text is handled alone.
SLICE_BYTES = 2 << 20
#: Rows handled at once, however short.
SLICE_ROWS = 1 << 17


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def held_out(doc_id: str, modulus: int, remainder: int) -> Column:
    """True where crc32 of the id as text leaves ``remainder``; a null id is not held out."""
    crc = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    return F.coalesce(crc % modulus == remainder, F.lit(False))


def text_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes of text and ``SLICE_ROWS`` rows each, in order."""
    yield from slices.text_slices(texts, limit, SLICE_ROWS)


def codepoints(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points (uint32) of all texts, one after the other, and the row bounds (n + 1)."""
    texts = pc.fill_null(texts, "")
    bounds = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False), out=bounds[1:])
    joined = "".join(texts.to_pylist())
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), bounds


def store(df: DataFrame) -> DataFrame:
    """``materialize`` for a table that its maker ``discard``s: the shuffles behind it go as soon as
    it is written, as nothing reads them again."""
    spark, key = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        return materialize(df)
    finally:
        spark.conf.set(key, before)


def discard(stored: DataFrame) -> None:
    """Removes the files of a table that ``store`` wrote and nothing reads any more."""
    spark = stored.sparkSession
    files = stored.inputFiles()
    if files:
        folder = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


release = slices.trim

_LOWER: list[np.ndarray] = []
#: Code points from here on (no letters are assigned there) count as no letters.
LETTERS_TO = 0x32400


def lower_letters(cps: np.ndarray) -> np.ndarray:
    """Every code point in lower case if it is a letter, else 0."""
    if not _LOWER:
        t = np.zeros(LETTERS_TO + 1, dtype=np.uint32)
        for c in range(LETTERS_TO):
            s = chr(c)
            if s.isalpha():
                low = s.lower()
                t[c] = ord(low) if len(low) == 1 else c
        _LOWER.append(t)
    return _LOWER[0][np.minimum(cps, LETTERS_TO)]
