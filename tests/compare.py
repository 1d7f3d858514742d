"""Run registered queries and their SQL side by side: python tests/compare.py [folder] [name part...]."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str):
    import duckdb

    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def cell(v) -> str:
    if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) in ("NaT", "<NA>"):
        return "null"
    if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
        return "[" + ",".join(cell(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{cell(x)}" for k, x in sorted(v.items())) + "}"
    if hasattr(v, "asDict"):
        return cell(v.asDict())
    if hasattr(v, "isoformat"):
        return v.isoformat().replace("T00:00:00", "")
    if type(v).__name__ in ("bool", "bool_"):
        return str(bool(v))
    if isinstance(v, (int, float)) or type(v).__name__.startswith(("int", "float", "uint", "Decimal")):
        return f"{float(v):.9g}"
    return str(v)


def rows(columns, data) -> tuple[list[str], list[tuple[str, ...]]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in data)


def spark_rows(df):
    return rows(df.columns, [tuple(r) for r in df.collect()])


def sql_rows(con, sql: str):
    got = con.execute(sql)
    return rows([c[0] for c in got.description], got.fetchall())


def main(argv: list[str]) -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    folder = argv[0] if argv else "/root/testdata/sf0.01"
    cores = os.environ.get("CORES", "8")
    spark = SparkSession.builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    con, queries, sql, bad = connect(folder), entry.queries(), entry.oracle_sql(), 0
    for name, run in queries.items():
        if argv[1:] and not any(x in name for x in argv[1:]):
            continue
        began = time.time()
        try:
            got = spark_rows(run(spark, folder))
        except Exception as e:
            print("FAIL", name, "spark:", str(e).replace("\n", " ")[:400], flush=True)
            bad += 1
            continue
        took = time.time() - began
        if name not in sql:
            print("only", name, len(got[1]), f"{took:.1f} s", flush=True)
            continue
        try:
            want = sql_rows(con, sql[name])
        except Exception as e:
            print("FAIL", name, "duckdb:", str(e).replace("\n", " ")[:400], flush=True)
            bad += 1
            continue
        if got == want:
            print("ok", name, len(got[1]), f"{took:.1f} s" + (" EMPTY" if not got[1] else ""), flush=True)
        else:
            bad += 1
            differ = next(((a, b) for a, b in zip(got[1], want[1]) if a != b), None)
            print("DIFF", name, got[0], want[0] if want[0] != got[0] else "", len(got[1]), len(want[1]), differ, flush=True)
    print("bad", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
