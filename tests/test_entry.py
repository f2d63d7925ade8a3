"""Driver contract: entry() and a few registered queries against DuckDB."""

import duckdb

import __spark_entry__ as E
from tools.check import TABLES, digest

SF = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["time_point", "k", "cluster_id", "cluster_size", "mean_distance"]
    assert sum(r["cluster_size"] for r in rows) == (E.catalog.positions(spark, SF) - 14) * 10


def test_every_query_has_a_callable_and_sql_keys_are_known():
    qs, sql = E.queries(), E.oracle_sql()
    assert len(qs) >= 90
    assert set(sql) <= set(qs)


def test_some_queries_match_duckdb(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    qs, sql = E.queries(), E.oracle_sql()
    for name in ("flagship_cluster_profile", "d1_dtw", "e1_cluster_silhouette", "j1_w5_migration",
                 "k1_nearest_samples", "a2_w9_member_lists", "t2_decode_period_messages"):
        df = qs[name](spark, SF)
        cur = con.execute(sql[name])
        dcols = [d[0] for d in cur.description]
        assert sorted(df.columns) == sorted(dcols), name
        assert digest(df.columns, [tuple(r) for r in df.collect()]) == digest(dcols, cur.fetchall()), name
