"""Spark query against its SQL over the smallest tables."""

import duckdb

from tools_compare import TABLES, canon

SF = "/root/testdata/sf0.001"


def check(spark, name, queries, sqls):
    got = queries[name](spark, SF).toPandas()
    if name not in sqls:
        assert list(got.columns)
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    want = con.execute(sqls[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canon(got) == canon(want)
