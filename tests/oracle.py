"""Run a registered query in Spark and its SQL in DuckDB and compare schema and rows.

As a script: `python tests/oracle.py [sf dir] [name ...]`.
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb
import pyarrow as pa

from __spark_entry__ import oracle_sql, queries

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return con


def _kind(kind: pa.DataType) -> str:
    if pa.types.is_list(kind) or pa.types.is_large_list(kind):
        return f"list<{_kind(kind.value_type)}>"
    return str(kind).replace("large_", "").replace("string_view", "string")


def _rows(table: pa.Table) -> tuple[list[tuple[str, str]], list[tuple]]:
    names = sorted(table.column_names)
    table = table.select(names)
    schema = [(n, _kind(table.schema.field(n).type)) for n in names]
    columns = [table.column(n).to_pylist() for n in names]
    rows = sorted(zip(*columns), key=lambda r: tuple((v is None, str(v)) for v in r)) if columns else []
    return schema, rows


def compare(spark, con, name: str, sf_dir: str) -> str:
    """'' when both sides agree, else what differs."""
    left_schema, left = _rows(queries()[name](spark, sf_dir).toArrow())
    sql = oracle_sql().get(name)
    if sql is None:
        return ""
    right_schema, right = _rows(con.sql(sql).to_arrow_table())
    if left_schema != right_schema:
        return f"schema: {[p for p in zip(left_schema, right_schema) if p[0] != p[1]] or (left_schema, right_schema)}"
    if len(left) != len(right):
        return f"rows: {len(left)} != {len(right)}"
    if not left:
        return "no rows on either side"
    for a, b in zip(left, right):
        if a != b:
            return "values: " + str([(n, x, y) for (n, _), x, y in zip(left_schema, a, b) if x != y])
    return ""


if __name__ == "__main__":
    from stratawork import get_spark

    args = sys.argv[1:]
    folder = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    session = get_spark("oracle", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false")
    session.sparkContext.setLogLevel("ERROR")
    duck = connect(folder)
    bad = 0
    for query in args or queries():
        started = time.time()
        try:
            difference = compare(session, duck, query, folder)
        except Exception as error:  # noqa: BLE001
            difference = f"{type(error).__name__}: {str(error)[:600]}"
        bad += bool(difference)
        print(f"{'DIFF' if difference else 'ok  '} {query:32s} {time.time() - started:6.2f}s {difference}", flush=True)
    print(f"{bad} differ")
