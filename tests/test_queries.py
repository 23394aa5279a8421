"""Every query against its DuckDB SQL, row by row."""

from __future__ import annotations

import pytest
from conftest import canonical, tables

from strandlog.functions.generators import ReplyStream, ask_stream
from strandlog.plans import all_oracles, all_queries

QUERIES, ORACLES = all_queries(), all_oracles()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf_dir, name):
    frame = QUERIES[name](spark, sf_dir)
    expected = tables(sf_dir).sql(ORACLES[name]).df()
    assert sorted(frame.columns) == sorted(expected.columns)
    got = canonical(frame.toPandas())
    assert got, "no rows"
    assert got == canonical(expected)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_store_takes_seqs_beyond_a_million(spark, sf_dir, tmp_path):
    """Actors whose seqs go on past a million append in order, in two batches."""
    from strandlog.model import read

    twice = read(spark, sf_dir, "events").crossJoin(spark.range(2).withColumnRenamed("id", "k"))
    twice.withColumn("event_id", twice["event_id"] + twice["k"] * 999_500).drop("k").write.parquet(f"{tmp_path}/events.parquet")
    got = QUERIES["ref_log_store"](spark, str(tmp_path)).toPandas()
    assert canonical(got) == canonical(tables(tmp_path).sql(ORACLES["ref_log_store"]).df())


def test_table_function_gives_the_same_stream(spark):
    """The reply stream from Python and the one from an expression."""
    requests = spark.range(8).selectExpr("id * 10 AS first", "id AS n")
    spark.udtf.register("reply_stream", ReplyStream)
    rows = spark.sql("SELECT r.*, s.* FROM {r} r, LATERAL reply_stream(r.first, r.n, CAST(4 AS BIGINT)) s", r=requests)
    assert canonical(rows.toPandas()) == canonical(ask_stream(requests, "first", "n", 4).toPandas())
