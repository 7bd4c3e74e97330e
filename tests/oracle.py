"""Runs registered queries beside their SQL and compares the rows.

    python tests/oracle.py [folder] [name prefix ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DEFAULT_FOLDER = "/root/testdata/sf0.01"
spark_done = 0.0


def session(cores: str = "8"):
    from pyspark.sql import SparkSession

    return (
        SparkSession.builder.master(f"local[{cores}]").appName("rackpulse-check")
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )


def database(folder: str):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def normal(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, int):
        return float(f"{float(value):.15g}") if abs(value) < 2**53 else value
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(normal(r[i]) for i in order) for r in rows], key=repr)


def kind(name: str) -> str:
    name = name.lower()
    if name.startswith(("int", "bigint", "long", "smallint", "tinyint", "hugeint", "uint", "ubig")):
        return "int"
    if name.startswith(("double", "float", "decimal")):
        return "float"
    return "text" if name.startswith(("string", "varchar")) else name


def compare(df, con, sql: str) -> str | None:
    """Difference between a query and its SQL, or None."""
    actual = rows_of(df.columns, df.collect())
    global spark_done
    spark_done = time.monotonic()
    result = con.execute(sql)
    sql_columns, sql_types = [c[0] for c in result.description], [str(c[1]) for c in result.description]
    expected = rows_of(sql_columns, result.fetchall())
    if sorted(df.columns) != sorted(sql_columns):
        return f"columns {sorted(df.columns)} != {sorted(sql_columns)}"
    types = dict(df.dtypes)
    odd = [c for c, k in zip(sql_columns, sql_types) if kind(types[c]) != kind(k)]
    if odd:
        return f"types differ: {[(c, types[c], k) for c, k in zip(sql_columns, sql_types) if c in odd]}"
    if len(actual) != len(expected):
        return f"{len(actual)} rows, SQL has {len(expected)}"
    wrong = [(a, e) for a, e in zip(actual, expected) if a != e]
    return f"{len(wrong)} of {len(actual)} rows differ, first {wrong[0]} ({sorted(df.columns)})" if wrong else None


def main(folder: str, prefixes: list[str]) -> int:
    import __spark_entry__ as entry

    spark, con, bad = session(), database(folder), 0
    spark.sparkContext.setLogLevel("ERROR")
    sqls = entry.oracle_sql()
    for name, run in entry.queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        begin = time.monotonic()
        try:
            df = run(spark, folder)
            verdict = compare(df, con, sqls[name]) if name in sqls else f"rows only: {len(df.collect())}"
        except Exception as error:  # noqa: BLE001
            verdict = f"FAILED {type(error).__name__}: {str(error)[:1500]}"
        took = (spark_done if spark_done > begin else time.monotonic()) - begin
        if verdict is not None and not verdict.startswith("rows only"):
            bad += 1
        print(f"{'ok ' if verdict is None else '-- '} {name} {took:.1f}s {verdict or ''}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    args = sys.argv[1:]
    where = args.pop(0) if args and os.path.isdir(args[0]) else DEFAULT_FOLDER
    sys.exit(1 if main(where, args) else 0)
