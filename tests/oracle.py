"""Runs a query's SQL in DuckDB over the same tables, and puts rows in a comparable form."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return None if value != value else round(value, 6)
    return str(value) if value is not None else None


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def expected(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    found = con.execute(sql)
    columns = [d[0] for d in found.description]
    return sorted(columns), rows_of(columns, found.fetchall())


def actual(df):
    return sorted(df.columns), rows_of(df.columns, df.collect())
