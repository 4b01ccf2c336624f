"""Comparison of a query with its SQL in DuckDB."""

import os

import duckdb


def rows(names, data):
    order = [names.index(c) for c in sorted(names)]
    plain = lambda v: round(float(v), 9) if isinstance(v, float) or type(v).__name__ == "Decimal" else v
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def check(spark, sf_dir, query, sql):
    got = query(spark, sf_dir)
    with duckdb.connect() as con:
        for f in os.listdir(sf_dir):
            con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
        want = con.execute(sql)
        names = [d[0] for d in want.description]
        assert sorted(names) == sorted(got.columns)
        assert rows(got.columns, got.collect()) == rows(names, want.fetchall())
