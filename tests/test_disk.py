"""What the gold store and change processing leave on disk, and that doing it in passes changes no row."""

import glob
import os
import tempfile

from pyspark.sql import functions as F

from quarry.functions import pairs
from quarry.functions.text import html_to_printable_ascii, html_to_stripped, html_to_text, printable_ascii, strip_control
from quarry.plans import change_queries as CQ
from quarry.plans import changes as CH
from quarry.session import ensure_checkpoint_dir, hold, scratch
from quarry.sources.derived import article_landing, change_events, tree_landing
from quarry.streaming import changes as STREAM
from quarry.streaming import store as ST

DOCS = "org_id int, document_id string, title string"
ITEMS = "org_id int, source_id string, embeddings array<float>, chunk string, snippet string"


def held(spark):
    return set(glob.glob(f"{ensure_checkpoint_dir(spark)}/quarry-tables/{spark.sparkContext.applicationId}/*"))


def own_tables(spark):
    """documents.parquet of 40 rows (four trees), in a folder of its own."""
    d = tempfile.mkdtemp(prefix="quarry-own-")
    spark.createDataFrame([(i, f"text {i} " * (90 * (i % 4)), "en", f"src{i % 3}") for i in range(40)],
                          "doc_id long, text string, lang string, source string").write.parquet(f"{d}/documents.parquet")
    return d


def make(spark):
    like = [spark.createDataFrame([], ddl).schema for ddl in (DOCS, ITEMS)]
    return ST.GoldStore(spark, tempfile.mkdtemp(prefix="quarry-store-"), *like, limit=500)


def gold(spark, keys, text):
    docs = spark.createDataFrame([(1, k, text) for k in keys], DOCS)
    return docs, spark.createDataFrame([(1, k, [1.0], None if k == "a1" else f"{text} {k} +", f"{text} {k}") for k in keys], ITEMS)


def items(store):
    return sorted((r.source_id, str(r.chunk), r.snippet) for r in store.read("items").collect())


def test_a_new_store_keeps_its_rows_once_and_reads_texts_of_their_own_columns(spark):
    store, keys = make(spark), [f"a{k}" for k in range(9)]
    docs, its = gold(spark, keys, "old")
    store.create(docs, its)
    assert glob.glob(f"{store.root}/delta/items/*") == []
    assert pairs.STORED in spark.read.parquet(f"{store.root}/base/items/version=1").columns
    want = sorted((k, "None" if k == "a1" else f"old {k} +", f"old {k}") for k in keys)
    assert items(store) == want
    for f in glob.glob(f"{store.root}/base/items/version=1/*/*"):  # as files were written before: a column for each text
        cols = [c for c in its.columns if c != "org_id"]
        rows = pairs.unpaired(spark.read.parquet(f)).select(*cols).collect()
        spark.createDataFrame(rows, ", ".join(x for x in ITEMS.split(", ") if "org_id" not in x)).write.mode("overwrite").parquet(f)
    assert items(store) == want


def test_compaction_in_passes_merges_as_one_does(spark, monkeypatch):
    monkeypatch.setattr(ST, "PASS_BYTES", 1)
    store, keys = make(spark), [f"a{k}" for k in range(12)] + [f"t1::{k}" for k in range(4)]
    store.create(*gold(spark, keys, "old"))
    gone = spark.createDataFrame([(1, "a3", False), (1, "a4", False), (1, "t1", True)], ST.REPLACED)
    applied = spark.createDataFrame([(1, 1, 1, "s", k, 2, "e2") for k in ("a3", "a4", "t1")], ST.APPLIED)
    store.append(2, *gold(spark, ["a3", "t1::9"], "new"), gone, applied, spark.createDataFrame([], ST.REJECTED))
    before, tables = items(store), held(spark)
    store.compact(3)
    assert items(store) == before and len(before) == 12
    assert held(spark) == tables  # what it kept for itself is gone
    files = [os.path.dirname(f) for f in glob.glob(f"{store.root}/base/items/version=3/**/*.parquet", recursive=True)]
    assert files and len(files) == len(set(files))  # a bucket is written by one task


def test_a_batch_leaves_no_tables_behind(spark):
    d = own_tables(spark)
    docs, its = CQ.initial_gold(spark, d, CQ.PLAIN)
    root = tempfile.mkdtemp(prefix="quarry-store-")
    STREAM.create_gold(f"{root}/gold", docs, its)
    before = held(spark)
    STREAM.process_batch(spark, change_events(spark, d), 0, f"{root}/gold", f"{root}/status", article_landing(spark, d),
                         tree_landing(spark, d), docs, its, CQ.PLAIN)
    assert held(spark) == before


def test_changes_in_passes_are_those_of_one_pass(spark, monkeypatch):
    d = own_tables(spark)

    def rows(n):
        monkeypatch.setattr(CH, "passes", lambda *landing: n)
        got = CH.change_set(change_events(spark, d), article_landing(spark, d), tree_landing(spark, d), CQ.PLAIN)
        return sorted(map(str, got.items.collect())), sorted(map(str, got.documents.collect())), sorted(map(str, got.statuses.collect()))

    assert rows(3) == rows(1)
    monkeypatch.undo()
    monkeypatch.setattr(CH, "PASS_BYTES", 1)
    assert CH.passes(article_landing(spark, d), tree_landing(spark, d)) == CH.MOST_PASSES
    assert CH.passes(spark.createDataFrame([(1,)], "a int")) == 1


def test_a_replay_keeps_the_rows_of_one_batch_only(spark):
    d, sizes = own_tables(spark), []
    before = held(spark)
    docs, its = CQ.initial_gold(spark, d)
    sizes.append(len(held(spark) - before))
    CH.apply_changes(change_events(spark, d), article_landing(spark, d), tree_landing(spark, d), docs, its, CQ.CFG)
    sizes.append(len(held(spark) - before))
    before = held(spark)
    assert CQ.apply_changes_replay(spark, d).count() == 31 + 27  # articles (one of 32 is empty), and nodes of three trees
    assert len(held(spark) - before) == sizes[1] + 1  # a batch's, and the swapped documents


def test_scratch_removes_what_it_held_but_what_is_kept(spark):
    before = held(spark)
    with scratch(spark):
        hold(spark.range(3))
        kept = hold(spark.range(5), keep=True)
        assert len(held(spark) - before) == 2
    assert len(held(spark) - before) == 1 and kept.count() == 5


def test_html_and_characters_in_one_step(spark):
    texts = [None, "", "<p>a\x00b\x85 é &eacute;&#1;\U0001f600</p>", "plain\ttext\r\n\x0b\x0c\x7f"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(html_to_printable_ascii("t"), html_to_stripped("t")).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in df.select(printable_ascii(html_to_text("t")), strip_control(html_to_text("t"))).collect()]
