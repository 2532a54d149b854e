"""Runs a registered query beside its SQL twin, as order-insensitive rows."""

import glob
import os

import duckdb

DATA = "/root/testdata"


def twin(sql, sf_dir):
    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(p).removesuffix(".parquet")
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    r = c.sql(sql)
    return r.columns, r.fetchall()


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return v


def same(spark_df, sql, sf_dir):
    cols, rows = twin(sql, sf_dir)
    assert sorted(cols) == sorted(spark_df.columns), (sorted(cols), sorted(spark_df.columns))
    order = sorted(cols)
    key = lambda row: tuple((v is None, str(v)) for v in row)
    want = sorted((tuple(plain(r[cols.index(c)]) for c in order) for r in rows), key=key)
    got = sorted((tuple(plain(r[c]) for c in order) for r in spark_df.collect()), key=key)
    assert len(got) == len(want), (len(got), len(want))
    for g, w in zip(got, want):
        assert g == w, (g, w)
    return len(got)
