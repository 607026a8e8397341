"""Runs queries against their DuckDB SQL: python -m tests.oracle SF_DIR [NAME...]."""

import datetime
import math
import sys
import time

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def cell(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.10g}")
    if isinstance(x, (datetime.date, datetime.datetime)):
        return str(x)
    return x


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, run, sql, sf):
    """None if equal, else what differs."""
    df = run(spark, sf)
    a = table(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    b = table([d[0] for d in cur.description], cur.fetchall())
    if a[0] != b[0]:
        return f"columns {a[0]} / {b[0]}"
    if a[1] == b[1]:
        return None if a[1] else "no rows"
    in_a, in_b = set(a[1]), set(b[1])
    left, right = [r for r in a[1] if r not in in_b][:3], [r for r in b[1] if r not in in_a][:3]
    return f"rows {len(a[1])} / {len(b[1])}: {left} / {right}"


def main(sf, *names):
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    con, sqls, bad = duck(sf), e.oracle_sql(), 0
    for name, run in e.queries().items():
        if names and name not in names:
            continue
        t = time.time()
        try:
            said = compare(spark, con, run, sqls[name], sf) if name in sqls else f"(no SQL) {run(spark, sf).count()} rows"
        except Exception as x:  # noqa: BLE001
            said = f"{type(x).__name__}: {str(x)[:400]}"
        bad += bool(said) and not said.startswith("(no")
        print(f"{name}: {'ok' if said is None else said} {time.time() - t:.1f}s", flush=True)
    print("wrong:", bad)


if __name__ == "__main__":
    main(*sys.argv[1:])
