"""Run one query in Spark and in DuckDB; compare column types and rows (as multisets) exactly."""

from __future__ import annotations

from collections import Counter

import duckdb

TABLE_NAMES = (
    "region nation customer supplier part orders lineitem documents embeddings pages benchmark labels conversations".split()
)
DUCKDB_TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN",
}


def duckdb_result(sf_dir: str, sql: str) -> tuple[dict[str, str], Counter]:
    con = duckdb.connect()
    for name in TABLE_NAMES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    result = con.execute(sql)
    kinds = {c[0]: str(c[1]) for c in result.description}
    return kinds, _bag(list(kinds), result.fetchall())


def spark_result(df) -> tuple[dict[str, str], Counter]:
    kinds = {name: DUCKDB_TYPES.get(kind, kind) for name, kind in df.dtypes}
    return kinds, _bag(list(kinds), [tuple(r) for r in df.collect()])


def _bag(names, rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(row[i] for i in order) for row in rows)
