"""Catalogue queries against DuckDB on the smallest tables, and the streaming form."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from votegrid.plans import catalogue

TABLES = "events embeddings".split()


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(map(tuple, frame.astype(object).where(frame.notna(), None).values.tolist()), key=repr)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(catalogue.oracle_sql()))
def test_against_sql(spark, sf_dir, duck, name):
    got = catalogue.queries()[name](spark, sf_dir).toPandas()
    want = duck.execute(catalogue.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_stream_restarts_without_loss(spark, sf_dir, tmp_path):
    from pyspark.sql import functions as F

    from votegrid.streaming.score import score_stream

    src = tmp_path / "in"
    os.makedirs(src)
    schema = "query_id long, x long"
    plan = lambda q: q.select("query_id", (F.col("x") * 2).alias("y"))
    for k in range(2):
        spark.range(k * 5, k * 5 + 5).select(F.col("id").alias("query_id"), F.col("id").alias("x")).coalesce(1).write.mode("append").parquet(str(src))
        out = score_stream(spark.readStream.schema(schema).parquet(str(src)), plan, f"file://{tmp_path}/out", f"file://{tmp_path}/state")
    assert sorted((r.query_id, r.y) for r in out.select("query_id", "y").collect()) == [(i, 2 * i) for i in range(10)]


@pytest.mark.parametrize("files", [1, 3])
def test_stream_of_a_table_in_a_folder(spark, sf_dir, duck, tmp_path, files):
    spark.read.parquet(f"{sf_dir}/embeddings.parquet").repartition(files).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = catalogue.queries()["q33_stream_score"](spark, str(tmp_path)).toPandas()
    assert rows(got) == rows(duck.execute(catalogue.oracle_sql()["q33_stream_score"]).fetchdf())
