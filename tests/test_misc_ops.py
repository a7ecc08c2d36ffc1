"""Lookups, response mapping, stage helpers, gold switch, CLS pooling."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from quarry.operators import catalog as C
from quarry.operators.models import cls_pool, moderation_gate
from quarry.plans import change_queries as CQ
from quarry.plans.changes import ChangeConfig, apply_changes
from quarry.schemas import ARTICLE_BRONZE
from quarry.sources import stage as ST
from quarry.sources.derived import article_landing, change_events, tree_landing
from tests.conftest import SF_SMALL

DOC_SCHEMA = ("id long, org_id int, language string, title string, description string, tags array<string>, "
              "data string, connector_id int, document_id string, created_at timestamp, updated_at timestamp")


def _docs(spark):
    return spark.createDataFrame([
        (1, 1, "en", "a", None, ['"k"."v"', '"k"."w"'], '{"x": 1}', 2, "t1::1", None, None),
        (2, 1, "en", "b", None, ["broken"], '{}', 2, "t1::2", None, None),
        (3, 2, "de", "c", None, [], '{}', 3, "t2::1", None, None)], DOC_SCHEMA)


def test_payload_decodes_and_flags_malformed(spark):
    rows = {r.id: r for r in C.document_payload(_docs(spark)).collect()}
    assert rows[1].payload.tags == {"k": ["v", "w"]} and rows[1].mapping_error is None
    assert rows[2].payload is None and rows[2].mapping_error == "malformed tag"
    hits = spark.createDataFrame([(1, 10, 1, 0.1), (2, 20, 2, 0.2)], "rank int, item_id long, document_id long, distance double")
    ok, meta = C.search_response(hits, _docs(spark))
    assert [r.item_id for r in ok.collect()] == [10]
    m = meta.first()
    assert (m.dropped, m.error_code) == (1, 2001)


def test_lookups_and_insert_if_absent(spark):
    d = _docs(spark)
    assert C.document_lookup(d, "t1::1", 2, 1).count() == 1
    assert C.document_lookup(d, "t1::1", 3, 1).count() == 0
    assert sorted(r.id for r in C.tree_documents(d, "t1", 1).collect()) == [1, 2]
    items = spark.createDataFrame([(10, 1), (11, 3)], "id long, document_id long")
    ids = spark.createDataFrame([(10,), (11,)], "id long")
    assert [r.id for r in C.items_by_ids(items, d, ids, org_id=1).collect()] == [10]  # no tenant leak
    new = spark.createDataFrame([("t1::1", 2, 1), ("t9::9", 2, 1)], "document_id string, connector_id int, org_id int")
    assert [r.document_id for r in C.insert_if_absent(d, new).collect()] == ["t9::9"]


def test_stage_json_roundtrip_and_listing(spark):
    root = tempfile.mkdtemp(prefix="quarry-stage-")
    os.makedirs(f"{root}/bronze/articles/530566")
    rec = {"id": "101", "lang": "en", "title": "T", "version": 1, "details": [{"name": "a", "label": "A", "value": "x"}],
           "tags": [{"name": "k", "values": ["v"]}], "createdAt": "2023-09-11T08:59:52Z"}
    with open(f"{root}/bronze/articles/530566/101.json", "w") as fh:
        json.dump(rec, fh, indent=2)
    with open(f"{root}/bronze/articles/530566/bad.json", "w") as fh:
        fh.write("{not json")
    df = ST.read_stage_json(spark, f"{root}/bronze/articles/530566", ARTICLE_BRONZE)
    rows = {r.id: r for r in df.collect()}
    assert rows["101"].details[0].value == "x"
    assert any(r._corrupt_record for r in rows.values() if r.id is None)
    listed = ST.list_objects(spark, f"{root}/bronze").collect()
    assert len(listed) == 2
    out = f"{root}/silver"
    ST.write_stage(df.where("id is not null").withColumn("org_id", F.lit(530566)).drop("_corrupt_record"), out)
    assert spark.read.parquet(out).count() == 1
    p = F.lit("bronze/articles/530566/101.json")
    r = spark.range(1).select(ST.rewrite_key(p, "bronze", "silver").alias("k"), ST.org_of(p).alias("o"),
                              ST.id_of(p).alias("i"), ST.rewrite_bucket(F.lit("x-bronze"), "bronze", "silver").alias("b")).first()
    assert (r.k, r.o, r.i, r.b) == ("silver/articles/530566/101.json", "530566", "101", "x-silver")


def test_silver_only_switch_leaves_article_gold(spark):
    docs, items = CQ.initial_gold(spark, SF_SMALL)
    cfg = ChangeConfig(article_chunk=CQ.CFG.article_chunk, tree_chunk=CQ.CFG.tree_chunk, embed=CQ.CFG.embed,
                       to_stage="silver")
    d, _, st = apply_changes(change_events(spark, SF_SMALL), article_landing(spark, SF_SMALL),
                             tree_landing(spark, SF_SMALL), docs, items, cfg)
    before = {r.document_id for r in docs.where(F.col("connector_id") == 2).collect()}
    after = {r.document_id for r in d.where(F.col("connector_id") == 2).collect()}
    assert before == after
    assert st.where((F.col("id") == "ev-a0")).select("state").collect()[0].state == 8


def test_cls_pool_and_moderation(spark):
    df = spark.createDataFrame([([[[1.0, 2.0], [3.0, 4.0]], [[5.0, 6.0]]],)], "t array<array<array<float>>>")
    assert df.select(cls_pool("t").alias("v")).first().v == [1.0, 2.0]
    texts = spark.createDataFrame([(1, "you idiot"), (2, "hello")], "id long, text string")
    passed, viol = moderation_gate(texts, "text")
    assert [r.id for r in passed.collect()] == [2]
    assert [(r.id, r.error_code) for r in viol.collect()] == [(1, 4019)]


def test_pluggable_models(spark):
    import numpy as np

    from quarry.operators.models import apply_text_model, embed, moderate

    class Upper:
        def __call__(self, prompts):
            return [p.upper() + "  " for p in prompts]

    class Shouty:
        def __call__(self, texts):
            return [t.isupper() for t in texts]

    class BadDims:
        def __call__(self, texts):
            return np.zeros((len(texts), 3))

    df = spark.createDataFrame([(1, "hello"), (2, "")], "id long, t string")
    out = {r.id: r for r in apply_text_model(df, "t", "answer", Upper).collect()}
    assert out[1].answer == "HELLO" and out[1].answer_error is None
    flagged = {r.id: r.flagged for r in moderate(apply_text_model(df, "t", "a", Upper), "a", Shouty).collect()}
    assert flagged[1] is True
    e = {r.id: r for r in embed(df, "t", 4, BadDims).collect()}
    assert e[1].embedding is None and e[1].embed_error == "invalid vector"
    assert e[2].embed_error == "empty text"
    ok = {r.id: r for r in embed(df, "t", 8).collect()}
    assert len(ok[1].embedding) == 8 and ok[1].embed_error is None


def test_model_retries_then_raises():
    from quarry.operators.models import RETRY_ATTEMPTS, with_retries
    calls, waits = [], []

    def flaky(x):
        calls.append(x)
        if len(calls) < 3:
            raise RuntimeError("transient")
        return x * 2

    assert with_retries(flaky, sleep=waits.append)(21) == 42
    assert len(calls) == 3 and len(waits) == 2 and all(1.0 <= w <= 20.0 for w in waits)

    def broken(x):
        raise RuntimeError("down")

    import pytest
    with pytest.raises(RuntimeError):
        with_retries(broken, sleep=lambda s: None)(1)
    assert RETRY_ATTEMPTS == 3


def test_a_failing_moderator_stops_its_text_only(spark):
    from quarry.operators.models import moderation_gate

    class Failing:
        def __call__(self, texts):
            if any(t and "bad" in t for t in texts):
                raise ValueError("refused")
            return ["shout" in t for t in texts]

    df = spark.createDataFrame([(1, "fine"), (2, "bad one"), (3, "shout"), (4, None)], "id long, t string")
    passed, stopped = moderation_gate(df, "t", Failing)
    assert sorted(r.id for r in passed.collect()) == [1, 4] and passed.columns == ["id", "t"]
    assert sorted((r.id, r.code, r.error_code, r.moderation_error) for r in stopped.collect()) == [(2, 500, None, "refused"), (3, 200, 4019, None)]


def test_embed_batches_are_bounded_in_bytes(spark):
    from quarry.operators.models import embed
    from quarry.session import BATCH_BYTES, prepare

    class Seen:
        """The first number of every vector tells how many characters came at once."""
        def __call__(self, texts):
            return [[float(sum(map(len, texts))), 1.0] for _ in texts]

    prepare(spark)
    df = spark.range(24).coalesce(1).selectExpr("id", "repeat('x', 1 << 20) AS t")
    rows = embed(df, "t", 2, Seen).select("embedding", "embed_error").collect()
    assert len(rows) == 24 and all(r.embed_error is None for r in rows)
    assert max(r.embedding[0] for r in rows) <= BATCH_BYTES + (1 << 20)
