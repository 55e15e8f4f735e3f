"""The corpus pipeline, stage by stage, against plain versions; and the SQL of the queries that have one."""

import os
import sys
from collections import Counter

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(__file__))

import corpus_pipeline
import plain
from pyspark.sql import functions as F
from qsolake.llm import queries, toxicity
from test_line_dedup import expected as lines_left
from test_simhash import expected as groups

TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What goes into and comes out of each stage."""
    docs, out = spark.read.parquet(f"{plain.SF}/documents.parquet"), {}
    folder = tmp_path_factory.mktemp("stages")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, plain.SF).write.parquet(f"file://{folder}/{name}")
        made = spark.read.parquet(f"file://{folder}/{name}")
        out[name] = docs, made
        docs = made
    return out


def test_columns(stages):
    for name, (before, after) in stages.items():
        assert before.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert name == "packing" or after.columns == before.columns


def test_toxic_documents_go_and_the_rest_is_unchanged(spark, stages):
    before, after = stages["toxicity"]
    assert set(map(tuple, after.collect())) <= set(map(tuple, before.collect()))
    toxic = {r.doc_id for r in spark.read.parquet(f"{plain.SF}/labels.parquet").where("toxic = 1").collect()}
    gone = {r.doc_id for r in before.collect()} - {r.doc_id for r in after.collect()}
    assert len(gone & toxic) >= 0.8 * len(toxic)


def test_the_toxicity_stage_decides_as_the_operator_does(spark, stages):
    """By models that haven't learnt the labels of the held-out fold."""
    before, after = stages["toxicity"]
    scored = toxicity.toxicity(before, spark.read.parquet(f"{plain.SF}/labels.parquet"))
    assert Counter(map(tuple, after.collect())) == Counter(map(tuple, scored.where("predicted = 0").select(before.columns).collect()))


def test_lines(stages):
    before, after = stages["line_dedup"]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    assert Counter((r.doc_id, r.text) for r in after.collect()) == Counter(k[:2] for k in lines_left(rows).elements())
    assert after.where(F.length("text") != F.col("n_chars")).count() == 0


def test_one_document_of_each_group(stages):
    before, after = stages["simhash_dedup"]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    assert sorted(r.doc_id for r in after.collect()) == sorted({c for *_, c in groups(rows)})


def test_mixed_documents_are_packed(stages):
    before, mixed = stages["mixing"]
    assert set(map(tuple, mixed.collect())) <= set(map(tuple, before.collect()))
    _, packed = stages["packing"]
    whole = packed.groupBy("doc_id").agg(F.sum(F.col("length") / F.col("doc_tokens")).alias("copies")).collect()
    assert {r.doc_id: round(r.copies) for r in whole} == Counter(r.doc_id for r in mixed.collect())


def test_stages_take_awkward_rows(spark):
    """Nulls, empty and very long texts, repeated ids, copies, columns named like results; and an empty table."""
    docs = spark.createDataFrame(plain.awkward(), plain.DOCS).selectExpr("*", "'x' as score", "1 as _rank", "2 as n_dropped", "'y' as _hash")
    for given in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            made = stage(spark, given, plain.SF)
            assert made.columns == given.columns, name
            assert (made.count() > 0) == (given is docs), name
        assert (corpus_pipeline.pack_sequences(spark, given, plain.SF).count() > 0) == (given is docs)
    assert Counter(r.doc_id for r in corpus_pipeline.dedup_lines(spark, docs, plain.SF).collect()) == Counter(r[0] for r in plain.awkward())


def test_run_gives_the_last_stage(spark, stages):
    columns = ["doc_id", "start", "length", "doc_tokens", "ids_crc32"]
    assert Counter(corpus_pipeline.run(spark, plain.SF).select(columns).collect()) == Counter(stages["packing"][1].select(columns).collect())


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{plain.SF}/{t}.parquet'")
    made = queries.QUERIES[name](spark, plain.SF)
    sql = con.execute(f"SELECT {', '.join(made.columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert Counter(map(tuple, made.collect())) == Counter(sql)
