"""Medallion pipeline goldens (tree, article, HTML)."""

import json

from pyspark.sql import functions as F

from quarry.plans import ingest as I
from quarry.schemas import ARTICLE_BRONZE, TREE_RAW

NONE_CFG = I.ChunkConfig("characters", 1000, None)


def test_tree_gold_golden(spark):
    node = ("Content", "test title", "<p>test content of a node</p>", "Is this a question?", "k1,k2", "t1")
    skip = ("Question", "q", "x", "", "", "")
    raw = [("125365649", "<h1>Test Tree</h1>", "this is a description", "en", "tree,tag", "530566", "1", "0",
            "2023-04-14T19:04:11.000000Z", "2023-04-14T19:04:11.000000Z", "2023-04-15T19:04:11.000000Z",
            {"1": node, "2": skip})]
    df = spark.createDataFrame(raw, TREE_RAW)
    bronze = I.tree_bronze(df)
    meta = bronze.first().meta
    assert meta.tags == ["tree", "tag"] and meta.active is True and meta.is_private is False
    assert meta.create_date == "2023-04-14T19:04:11+00:00"
    silver = I.tree_silver(bronze)
    assert silver.first().meta.tags == ['"zt_trees_trees"."tree"', '"zt_trees_trees"."tag"']
    rows = I.tree_chunks(silver, F.lit(1), NONE_CFG).orderBy("chunk_no").collect()
    assert [r.document_id for r in rows] == ["125365649::1"] * 2
    assert [r.chunk for r in rows] == ["test content of a node Is this a question?", "Test Tree test title"]
    assert rows[0].title == "Test Tree test title" and rows[0].description == "this is a description"
    data = json.loads(rows[0].data)
    assert sorted(data) == sorted(["node_keywords", "node_tags", "tree_active", "tree_last_opened",
                                   "tree_is_private", "tree_id", "display"])
    assert data["display"] == {"title": "Test Tree", "subtitle": "test title"}


def test_article_silver_and_gold(spark):
    b = [("101", "en", "KB1", "article", "Title", "faq", "/p", 1,
          [("a", "A", "<p>this is a question?</p>"), ("b", "B", "this is an answer")],
          [("Support_Options", ["Support Options"]), ("nothing", None)],
          "2023-09-11T08:59:52Z", None, "0001-01-01T00:00:00Z")]
    df = spark.createDataFrame(b, ARTICLE_BRONZE).withColumn("org_id", F.lit(530566)).withColumn("connector_id", F.lit(7))
    s = I.article_silver(df).first()
    assert s.content == "this is a question?\nthis is an answer"
    assert s.tags == ['"Support_Options"."Support Options"']
    assert (s.createdAt, s.updatedAt, s.publishedAt) == ("2023-09-11T08:59:52+00:00", None, "0001-01-01T00:00:00+00:00")
    rows = I.article_chunks(I.article_silver(df), NONE_CFG).orderBy("chunk_no").collect()
    assert [r.chunk for r in rows] == ["this is a question?\nthis is an answer", "Title"]
    assert rows[0].updated_at == rows[0].created_at  # H20 fallback
    assert json.loads(rows[0].data)["publishedAt"] == "0001-01-01T00:00:00+00:00"


def test_html_gold_golden(spark):
    silver = spark.createDataFrame([("h1", "this is a test content", "http://x", "page", "en", "awesome title", 1)],
                                   "id string, content string, url string, type string, lang string, title string, org_id int")
    rows = I.html_chunks(silver, F.lit(3), I.ChunkConfig("characters", 1000, "prefix")).orderBy("chunk_no").collect()
    assert [r.chunk for r in rows] == ["awesome title this is a test content", "awesome title"]
    assert [r.snippet for r in rows] == ["this is a test content", "awesome title"]
    assert rows[0].tags == [] and rows[0].created_at is None
    assert json.loads(rows[0].data) == {"content": "this is a test content", "url": "http://x", "type": "page",
                                        "description": None}


def test_split_gold_ids_are_deterministic(spark):
    silver = spark.createDataFrame([("h1", "abc " * 400, "u", "page", "en", "t", 1)],
                                   "id string, content string, url string, type string, lang string, title string, org_id int")
    rows = I.embed_chunks(I.html_chunks(silver, F.lit(3), NONE_CFG), I.EmbedConfig(dims=16))
    d1, i1, _ = I.split_gold(rows)
    d2, i2, _ = I.split_gold(rows)
    assert sorted(r.id for r in i1.collect()) == sorted(r.id for r in i2.collect())
    assert all(len(r.embeddings) == 16 for r in i1.collect())
