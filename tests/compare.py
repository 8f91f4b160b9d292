"""Run a query and its SQL side by side and compare the rows as multisets.

``python tests/compare.py FOLDER [NAME ...]`` prints one line per query.
"""

import math
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(folder):
    connection = duckdb.connect()
    for name in sorted(os.listdir(folder)):
        table = name.removesuffix(".parquet")
        connection.execute(f"create view {table} as select * from '{folder}/{name}'")
    return connection


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    return value


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


def differences(frame, connection, sql):
    """Readable list of differences; empty when both sides agree."""
    relation = connection.sql(sql)
    want_columns, got_columns = list(relation.columns), frame.columns
    if sorted(want_columns) != sorted(got_columns):
        return [f"columns {sorted(got_columns)} instead of {sorted(want_columns)}"], 0
    families = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
                "boolean": "BOOLEAN"}
    want_types = dict(zip(relation.columns, map(str, relation.types), strict=True))
    problems = [
        f"{name}: {kind} instead of {want_types[name]}"
        for name, kind in frame.dtypes
        if families.get(kind, "TIMESTAMP") != want_types[name]
    ]
    want = bag(want_columns, relation.fetchall())
    got = bag(got_columns, [tuple(row) for row in frame.collect()])
    if want != got:
        problems.append(f"missing {list((want - got).items())[:3]} extra {list((got - want).items())[:3]}")
    return problems, sum(got.values())


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    folder, names = sys.argv[1], sys.argv[2:]
    session = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    connection = connect(folder)
    failed = 0
    for name, query in entry.queries().items():
        if names and name not in names:
            continue
        started = time.time()
        try:
            frame = query(session, folder)
            problems, rows = differences(frame, connection, entry.oracle_sql()[name])
        except Exception as error:
            problems, rows = [repr(error)[:600]], 0
        failed += bool(problems)
        print(f"{'FAIL' if problems else 'ok':5}{name:25}{rows:9} rows {time.time()-started:6.1f}s",
              *problems, flush=True)
    print("failed:", failed)
