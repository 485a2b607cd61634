"""Side-by-side runs of queries and their SQL."""

import os

import duckdb

SF = "/root/testdata/sf0.001"


def connect(sf: str = SF):
    con = duckdb.connect()
    for name in os.listdir(sf):
        con.sql(f"create view {name.split('.')[0]} as select * from '{sf}/{name}'")
    return con


def rows(frame) -> list:
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in frame.itertuples(index=False, name=None)), key=repr)


def same(spark, query, sql: str, sf: str = SF) -> None:
    got, want = query(spark, sf).toPandas(), connect(sf).sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
