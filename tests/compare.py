"""Runs the registered queries and their SQL side by side.

``python tests/compare.py SF_DIR [QUERY ...]``
"""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def value(x):
    if isinstance(x, float):
        return repr(x + 0.0)
    if isinstance(x, bool) or x is None:
        return str(x)
    return str(x)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(value(row[i]) for i in order) for row in rows)


def differences(spark, connection, query, sql, sf_dir):
    """Columns and rows in which the two answers differ, with the two run times."""
    start = time.time()
    frame = query(spark, sf_dir)
    ours = rows_of(frame.columns, [tuple(row) for row in frame.collect()])
    middle = time.time()
    relation = connection.sql(sql)
    theirs = rows_of(relation.columns, relation.fetchall())
    end = time.time()
    columns = set(frame.columns) ^ set(relation.columns)
    return columns, ours - theirs, theirs - ours, sum(ours.values()), middle - start, end - middle


def main():
    from __spark_entry__ import oracle_sql, queries
    from helpgrid.session import local_session

    sf_dir = sys.argv[1]
    wanted = sys.argv[2:] or list(queries())
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(sf_dir)
    sql = oracle_sql()
    bad = 0
    for name in wanted:
        try:
            columns, extra, lacking, n, ours, theirs = differences(
                spark, connection, queries()[name], sql[name], sf_dir
            )
        except Exception as error:
            bad += 1
            print(f"ERROR {name}: {str(error)[:1500]}", flush=True)
            continue
        state = "ok  " if not (columns or extra or lacking) else "DIFF"
        bad += state == "DIFF"
        print(f"{state} {name} rows={n} spark={ours:.1f}s sql={theirs:.1f}s", flush=True)
        if state == "DIFF":
            print("   columns", columns)
            print("   only ours", sum(extra.values()), str(list(extra)[:2])[:600])
            print("   only sql ", sum(lacking.values()), str(list(lacking)[:2])[:600])
    print("bad:", bad)


if __name__ == "__main__":
    main()
