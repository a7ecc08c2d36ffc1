"""Every stage against the operator it calls, on its own input; registered queries and their SQL."""

import duckdb
import pytest

import __spark_entry__ as E
import corpus_pipeline as P
from quarry.llm import decontamination, registry, simhash
from quarry.llm.common import documents, table
from quarry.sources.tables import TABLES
from tests.conftest import SF_SMALL
from tools.check_oracle import digest


def test_stages(spark, tmp_path):
    docs, columns = documents(spark, SF_SMALL), documents(spark, SF_SMALL).columns
    before = {r.doc_id: tuple(r) for r in docs.collect()}
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, SF_SMALL)
        out.write.parquet(f"file://{tmp_path}/{k}")
        kept = spark.read.parquet(f"file://{tmp_path}/{k}")
        rows = kept.collect()
        if name == "token_output":
            assert sorted(r.start for r in rows)[0] == 0 and len(rows) == docs.count()
            ordered = sorted(rows, key=lambda r: r.start)
            assert [r.doc_id for r in ordered] == sorted(r.doc_id for r in rows)
            assert all(a.start + a.n_tokens == b.start for a, b in zip(ordered, ordered[1:]))
            continue
        assert kept.columns == columns and all(tuple(r) == before[r.doc_id] for r in rows)
        ids = [r.doc_id for r in rows]
        if name == "simhash_near_dedup":
            groups = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
            assert sorted(ids) == sorted(set(groups.values()))
        elif name == "benchmark_decontamination":
            bad = {r.doc_id for r in decontamination.contamination(docs, table(spark, SF_SMALL, "benchmark")).collect()}
            assert sorted(ids) == sorted({r.doc_id for r in docs.collect()} - bad)
        elif name == "source_mixing":
            assert max(ids.count(i) for i in set(ids)) <= 2
        docs = kept


def test_toxic_rows_go_and_clean_ones_stay(spark):
    rows = [(1, "kind words only", "en", "s", 3), (2, None, None, None, None), (3, "", "en", "s", 0)]
    df = spark.createDataFrame(rows, documents(spark, SF_SMALL).schema)
    assert sorted(r.doc_id for r in P.drop_toxic(spark, df, SF_SMALL).collect()) == [1, 2, 3]


def test_stages_take_empty_tables_and_odd_columns(spark):
    df = documents(spark, SF_SMALL).selectExpr("*", "lang AS _row", "source AS fp", "1 AS u").limit(0)
    for name, stage in P.STAGES:
        out = stage(spark, df, SF_SMALL)
        assert out.count() == 0
        assert name == "token_output" or out.columns == df.columns


QUERIES, SQL = registry.load()


def test_registered():
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in QUERIES}
    assert QUERIES.keys() | {"pipeline"} <= E.queries().keys() and SQL.keys() <= E.oracle_sql().keys()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    df = QUERIES[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    cur = con.execute(SQL[name])
    want, cols = cur.fetchall(), [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols) and digest(rows, df.columns)[0] == digest(want, cols)[0]
