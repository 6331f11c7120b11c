"""Run a catalogue query in Spark and its SQL in DuckDB and compare all rows."""

import glob
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def comparable(rows, columns):
    """Rows with their values in column-name order, sorted."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(row[i] for i in order) for row in rows]
    return sorted(columns), sorted(plain, key=lambda r: tuple((v is None, str(v)) for v in r))


def spark_rows(df):
    return comparable([tuple(r) for r in df.collect()], df.columns)


def duckdb_rows(con, sql):
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    return comparable(result.fetchall(), columns)
