"""DuckDB beside Spark on the same tables."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def normal(rows, columns):
    order = [columns.index(c) for c in sorted(columns)]

    def text(x):
        if isinstance(x, (list, tuple)):
            return "[" + ",".join(map(text, x)) + "]"
        return "~" if x is None else repr(x) if isinstance(x, float) else str(x)

    return sorted("|".join(text(r[i]) for i in order) for r in rows)


def same(df, con, sql):
    found = con.execute(sql)
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert normal([tuple(r) for r in df.collect()], df.columns) == normal(found.fetchall(), columns)
