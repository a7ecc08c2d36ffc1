"""Secret scans by regular expressions behind a trigram inverted index.

Each Arrow slice of texts is indexed by the trigrams that the rules' Boolean queries name; a
rule's postings are intersected and only the texts left are searched. A rule without a
mandatory trigram scans every text. Indexes live as long as their slice, so nothing is
shuffled and memory is bounded by the slice.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import trigrams
from quarry.llm.common import documents, prepare, text_slices

# Kinds, patterns (ASCII letters only where case is ignored), group and least length that count.
BASE = [
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    # runs below 32 never count, so the pattern starts at that length and finds the same spans
    ("hex", r"[0-9a-f]{32,}", 0, 32),
]
MORE = [
    ("private_key", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----", 0, 1),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 1),
    ("google", r"AIza[0-9A-Za-z_-]{35}", 0, 1),
    ("stripe", r"[sr]k_live_[0-9A-Za-z]{16,}", 0, 1),
    ("bearer", r"(?i:bearer) [A-Za-z0-9._~+/-]{20,}=*", 0, 1),
    ("url_login", r"://[^\s/:@]+:[^\s/@]+@", 0, 1),
]
RULES = BASE + MORE
KIND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))


class Scanner:
    def __init__(self, rules=RULES):
        self.rules = [(kind, re.compile(pattern, re.ASCII), group, least) for kind, pattern, group, least in rules]
        self.queries = [trigrams.query_of(pattern) for _, pattern, _, _ in rules]
        names = sorted(set().union(*map(trigrams.trigrams_of, self.queries)))
        self.index = trigrams.Index({t: k for k, t in enumerate(names)})

    def spans(self, texts: pa.Array) -> list[list[dict]]:
        """For every text its spans by start, then by the rules' order (code points, end exclusive)."""
        out: list[list] = [[] for _ in range(len(texts))]
        for a, b in text_slices(texts):
            self.index.build(texts[a:b])
            rows = texts[a:b].to_pylist()
            for no, ((kind, find, group, least), query) in enumerate(zip(self.rules, self.queries)):
                for r in self.index.rows(query).tolist():
                    for m in find.finditer(rows[r] or ""):
                        if m.end(group) - m.start(group) >= least:
                            out[a + r].append((m.start(), no, m.end(), kind))
        return [[{"kind": k, "start": s, "stop": e} for s, _, e, k in sorted(x)] for x in out]


def secrets(text: Column, rules=RULES) -> Column:
    """array<struct(kind, start, stop)> of the text; empty for a null or empty one."""
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scanner = Scanner(rules)
        for texts in batches:
            yield pa.array(scanner.spans(texts), KIND)

    return F.arrow_udf(run, "array<struct<kind:string,start:bigint,stop:bigint>>").asNondeterministic()(text)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """One row per document: doc_id and its spans. Null ids and repeated rows are carried; other columns are not read."""
    return docs.select(F.col(id_col).alias("doc_id"), secrets(F.col(text_col), rules).alias("spans"))


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    found = find_secrets(documents(spark, sf_dir))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(*[k for k, *_ in BASE]))
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k, *_ in BASE],
                        F.sha2(_written(base).cast("binary"), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"))


QUERIES = {"op8_secrets": op8_secrets}
