"""DuckDB over the same tables, and the comparison of results without regard to order."""

from __future__ import annotations

import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SMALL = "/root/testdata/sf0.001"


def duck(sf_dir: str, sql: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con.execute(sql).fetch_df()


def rows(pdf, columns=None) -> list[tuple]:
    columns = sorted(columns or pdf.columns)
    pdf = pdf[columns].astype(object)
    return sorted(map(tuple, pdf.where(pdf.notna(), None).values.tolist()), key=repr)
