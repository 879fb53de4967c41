"""Run registered queries and their SQL side by side: python tests/compare.py DIR [name ...]."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(directory: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{directory}/{name}.parquet'")
    return con


def cell(value):
    if value is None:
        return None
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else value + 0.0
    return value


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def spark_side(spark, name, directory):
    from discern.plans.catalog import QUERIES

    df = QUERIES[name](spark, directory)
    return canonical(df.columns, [tuple(r) for r in df.collect()]) + (dict(df.dtypes),)


def sql_side(con, name):
    from discern.plans.oracle import ORACLE

    relation = con.sql(ORACLE[name])
    return canonical(relation.columns, relation.fetchall()) + (
        dict(zip(relation.columns, [str(t) for t in relation.types])),
    )


def main():
    from discern.plans.catalog import QUERIES
    from discern.plans.oracle import ORACLE
    from discern.session import build_session

    directory, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark = build_session(
        "compare", "local[8]", spark__sql__shuffle__partitions=8, spark__driver__memory="8g", spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(directory)
    bad = []
    for name in names:
        start = time.time()
        try:
            columns, rows, types = spark_side(spark, name, directory)
            took = time.time() - start
            if name not in ORACLE:
                print(f"rows  {name:32s} {len(rows):6d} {took:6.1f}s", flush=True)
                continue
            columns2, rows2, types2 = sql_side(con, name)
            good = columns == columns2 and rows == rows2
            print(f"{'ok' if good else 'DIFF':5s} {name:32s} {len(rows):6d} {took:6.1f}s", flush=True)
            if not good:
                bad.append(name)
                print("   spark", columns, types, [r for r in rows if r not in rows2][:3])
                print("   sql  ", columns2, types2, [r for r in rows2 if r not in rows][:3])
            else:
                pairs = {c: (types[c], types2[c]) for c in types}
                same = {("bigint", "BIGINT"), ("int", "INTEGER"), ("double", "DOUBLE"), ("string", "VARCHAR"), ("boolean", "BOOLEAN")}
                odd = {c: p for c, p in pairs.items() if p not in same}
                if odd:
                    print("   types", odd)
        except Exception as error:  # report and go on with the next query
            bad.append(name)
            print(f"FAIL  {name}: {type(error).__name__} {str(error)[:600]}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
