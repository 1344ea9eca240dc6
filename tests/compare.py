"""Run registered queries beside their SQL in DuckDB and compare the rows."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    connection = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            files = f"{path}/*.parquet" if os.path.isdir(path) else path
            connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{files}'")
    return connection


def rows(table):
    names = sorted(table.column_names)
    columns = [table.column(n).to_pylist() for n in names]
    fix = lambda v: round(v, 6) if isinstance(v, float) else v
    return names, sorted((tuple(map(fix, r)) for r in zip(*columns)), key=repr)


def difference(spark, sf_dir, name, function, sql):
    got = rows(function(spark, sf_dir).toArrow())
    want = rows(connect(sf_dir).execute(sql).to_arrow_table())
    if got == want:
        return None
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    return f"{len(got[1])} rows, {len(want[1])} expected; only here {[r for r in got[1] if r not in set(want[1])][:3]}; only there {[r for r in want[1] if r not in set(got[1])][:3]}"
