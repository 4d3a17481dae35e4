"""Spark rows against DuckDB rows, in any order."""

import glob
import os
from decimal import Decimal


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    return round(v, 6) if isinstance(v, float) else v


def rows_of(df, columns):
    return sorted(str(tuple(plain(x) for x in r)) for r in df.select(*columns).collect())


def oracle_rows(sf_dir, sql, columns):
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    names = [c[0] for c in con.execute(f"describe {sql}").fetchall()]
    assert sorted(names) == sorted(columns)
    return sorted(str(tuple(plain(x) for x in r)) for r in con.execute(f"select {', '.join(columns)} from ({sql})").fetchall())
