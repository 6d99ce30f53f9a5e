"""Compares a registered query with its SQL, run by DuckDB on the same files."""

from collections import Counter

import duckdb

TABLAS = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

# DuckDB type names of the Spark types that queries return.
TIPOS = {
    "string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "date": "DATE",
    "boolean": "BOOLEAN", "double": "DOUBLE", "timestamp": "TIMESTAMP",
    "timestamp_ntz": "TIMESTAMP",
}


def conexion(carpeta):
    con = duckdb.connect()
    for t in TABLAS:
        con.execute(f"create view {t} as select * from '{carpeta}/{t}.parquet'")
    return con


def diferencias(df, con, sql):
    """Empty string when schema and rows agree, else what differs."""
    res = con.execute(sql)
    nombres = [d[0] for d in res.description]
    filas_sql = res.fetchall()
    tipos_sql = {
        r[0]: r[1] for r in con.execute(f"describe {sql.strip()}").fetchall()
    }
    tipos_spark = {c: TIPOS.get(t, t) for c, t in df.dtypes}
    if sorted(tipos_spark) != sorted(nombres):
        return f"columns {sorted(tipos_spark)} != {sorted(nombres)}"
    distintos = {c: (t, tipos_sql[c]) for c, t in tipos_spark.items() if t != tipos_sql[c]}
    orden = sorted(nombres)
    pos = [nombres.index(c) for c in orden]
    a = Counter(tuple(r) for r in df.select(*[df[c] for c in orden]).collect())
    b = Counter(tuple(r[p] for p in pos) for r in filas_sql)
    if a != b:
        return (
            f"rows {sum(a.values())} vs {sum(b.values())}; only spark {list((a - b).items())[:3]};"
            f" only sql {list((b - a).items())[:3]}"
        )
    if distintos:
        return f"types {distintos}"
    return "" if a else "no rows"
