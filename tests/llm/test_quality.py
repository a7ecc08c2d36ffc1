"""Base counts against plain Python; the model on rows it did not see."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa

from quarry.llm import quality
from quarry.llm.common import documents, table
from tests.conftest import SF_ORACLE
from pyspark.sql import functions as F


def slow_counts(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    tri = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    n = Counter(tri)
    hit = {i + j for i, x in enumerate(tri) if n[x] > 1 for j in range(3)}
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(hit)]


TEXTS = [None, "", " \n\t", "a", "a b", "a b c", "a b c a b c", "x\nx\n \n \nx y\nx y\r\nx y", "é ü b # * $", "a " * 70, "p q r s p q r\nz\n\nz", "<|>&%$*#", "w%d " * 3000]


def test_counts():
    got = quality.Slice(pa.array(TEXTS)).counts()
    for k, t in enumerate(TEXTS):
        assert [int(v[k]) for v in got.values()] == slow_counts(t), t


def test_logits_are_the_products_of_the_features():
    rnd = np.random.default_rng(1)
    w = rnd.normal(size=1 << quality.BITS)
    s = quality.Slice(pa.array(TEXTS))
    for z, (at, value) in zip(s.logits(w), s.features()):
        assert abs(z - (w[at] * value).sum()) < 1e-3


def test_query(spark):
    got = {r.doc_id: r for r in quality.op7_quality(spark, SF_ORACLE).collect()}
    rows = documents(spark, SF_ORACLE).select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        g = got[r.doc_id]
        want = slow_counts(r.text)
        assert [g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words] == want
        assert g.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (g.base_failed and g.kept) and g.kept == (not g.base_failed and g.score >= 0.5)


def test_model_on_rows_it_did_not_see(spark):
    docs, labels = documents(spark, SF_ORACLE).select("doc_id", "text"), table(spark, SF_ORACLE, "labels")
    model = quality.train(docs, labels.where("doc_id % 3 <> 0"))
    seen = quality.judge(docs.join(labels.where("doc_id % 3 = 0").select("doc_id"), "doc_id"), model).toPandas().merge(labels.toPandas(), on="doc_id")
    right = ((seen.score >= 0.5) == (seen.quality == 1)).mean()
    assert right > 0.9
    assert abs(seen.score.mean() - seen.quality.mean()) < 0.1


def test_edge_rows(spark):
    df = spark.createDataFrame([(1, "w " * 60, "x"), (1, "w " * 60, "x"), (None, None, None)], "doc_id long, text string, kept string")
    labels = spark.createDataFrame([(1, 1), (None, 0)], "doc_id long, quality int")
    assert quality.train(df, labels) is None
    got = quality.judge(df, None).collect()
    assert len(got) == 3 and all(r.base_failed and not r.kept for r in got)
    assert quality.judge(df.limit(0), None).count() == 0
    assert quality.judge(df.withColumn("text", F.concat_ws(" ", *[F.lit(f"w{i}") for i in range(60)])), None).where("kept").count() == 3


def test_a_repeated_id_teaches_once(spark):
    rows = [(k, f"good words here number {k} " * 20) for k in range(20)] + [(k + 20, "bad bad bad " * 30) for k in range(20)]
    labels = spark.createDataFrame([(k, int(k < 20)) for k in range(40)], "doc_id long, quality int")
    kind = "doc_id long, text string"
    once = quality.train(spark.createDataFrame(rows, kind), labels)
    many = quality.train(spark.createDataFrame(rows + [rows[3]] * 500 + [(None, "x")], kind), labels)
    assert abs(once[1] - many[1]) < 1e-9 and abs(once[0] - many[0]).max() < 1e-9
