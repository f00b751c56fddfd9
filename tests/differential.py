"""Rows of a Spark query against the rows of its SQL in DuckDB, compared as sets of text with rounded numbers."""

from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


def cell(v):
    if v is None:
        return None
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, bool) or not isinstance(v, (int, float, list, dict)):
        return str(v)
    if isinstance(v, list):
        return str([cell(x) for x in v])
    if isinstance(v, dict):
        return str({k: cell(x) for k, x in v.items()})
    return None if v != v else round(float(v), 5)


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(([cell(r[i]) for i in order] for r in values), key=str)


def check(spark, query, sql, folder):
    with duckdb.connect() as con:
        for t in TABLES:
            if (Path(folder) / f"{t}.parquet").exists():
                con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
        found = con.execute(sql)
        names, wanted = [d[0] for d in found.description], found.fetchall()
    df = query(spark, folder)
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, wanted)
