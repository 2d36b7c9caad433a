"""Runs a query of __spark_entry__ and its SQL over the same tables and compares the rows."""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}") + 0.0
    if hasattr(x, "isoformat"):
        return x.isoformat()
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if isinstance(x, dict):
        return tuple(sorted((k, plain(v)) for k, v in x.items()))
    if type(x).__name__ == "Decimal":
        return float(x)
    return x


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def differences(df, sql: str, con) -> tuple[int, str]:
    """Rows of the query, and what differs ('' if nothing)."""
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    theirs = rows_of(names, rel.fetchall())
    n = sum(mine.values())
    if sorted(names) != sorted(df.columns):
        return n, f"columns {sorted(df.columns)} against {sorted(names)}"
    if mine != theirs:
        return n, f"{n} against {sum(theirs.values())} rows; only here {list((mine - theirs).items())[:3]}; only there {list((theirs - mine).items())[:3]}"
    return n, ""


def main(names: list[str]) -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    con, sql, bad = connect(sf), entry.oracle_sql(), 0
    for name, f in entry.queries().items():
        if names and not any(name.startswith(x) for x in names):
            continue
        t = time.time()
        try:
            if name in sql:
                n, diff = differences(f(spark, sf), sql[name], con)
            else:
                n, diff = len(f(spark, sf).collect()), ""
        except Exception as e:
            n, diff = -1, f"{type(e).__name__}: {str(e)[:1500]}"
        bad += bool(diff)
        print(f"{'BAD' if diff else 'ok ' if name in sql else 'run'} {name}: {n} rows, {time.time() - t:.1f} s {diff}", flush=True)
    return bad


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    sys.exit(main(sys.argv[1:]))
