"""Every registered query of the engine against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from lumenframe import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 5) + 0.0
    if isinstance(value, list | tuple):
        return tuple(plain(x) for x in value)
    if hasattr(value, "asDict"):
        return tuple(plain(x) for x in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    out = duck.execute(SQL[name])
    columns = [c[0] for c in out.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, out.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns and df.count() >= 0


def test_alignments_of_all_vectors(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id < 20")
    rows.unionAll(rows.withColumn("vec_id", rows["vec_id"] + 1000)).write.parquet(f"{tmp_path}/embeddings.parquet")
    found = {r["vec_id"]: (r["similarity"], r["place"]) for r in QUERIES["alignments"](spark, str(tmp_path)).collect()}
    ids = [r["vec_id"] for r in rows.collect()]
    assert sorted(found) == sorted([*ids, *(i + 1000 for i in ids)]) and all(found[i] == found[i + 1000] for i in ids)


def test_stream_states_of_files_in_any_order(spark, tmp_path):
    """Users whose events lie in many files, later ones in files that are read first."""
    rows = spark.read.parquet(f"{SF}/events.parquet").toPandas().sort_values("ts", ascending=False)
    for i in range(6):
        spark.createDataFrame(rows.iloc[i * 170 : (i + 1) * 170]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    got = QUERIES["stream_states"](spark, str(tmp_path))
    want = con.execute(SQL["stream_states"]).fetchall()
    assert len(want) == 15 and sorted(map(tuple, got.select("user_id", "state", "n").collect())) == sorted(want)


def test_rights_overlaps_of_all_urgent_orders(spark, duck):
    """Links of every urgent order, counted pair by pair."""
    pairs = """with w as (select o_orderkey id, case when o_orderpriority = '1-URGENT' then '*' else o_custkey::varchar end scope, epoch_us(o_orderdate) // 86400000000 s from orders)
        select x.id, count(y.id) n from w x left join w y on x.id <> y.id and (x.scope = y.scope or '*' in (x.scope, y.scope)) and abs(x.s - y.s) < 30 group by 1"""
    assert {tuple(r) for r in QUERIES["rights_overlaps"](spark, SF).select("id", "n").collect()} == set(duck.execute(pairs).fetchall())
