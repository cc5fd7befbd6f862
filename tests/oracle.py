"""Holds registered queries against their SQL: python tests/oracle.py [sf_dir] [name ...]"""

import math
import os
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, int):
        return v
    if hasattr(v, "is_finite"):
        return float(f"{float(v):.9g}")
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def differences(spark, query, sql, sf_dir, con=None):
    df = query(spark, sf_dir)
    mine = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = (con or connect(sf_dir)).execute(sql)
    theirs = rows([d[0] for d in cur.description], cur.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} and {theirs[0]}"
    if len(mine[1]) != len(theirs[1]):
        return f"{len(mine[1])} and {len(theirs[1])} rows"
    bad = [(a, b) for a, b in zip(mine[1], theirs[1]) if a != b]
    return f"{len(bad)} of {len(mine[1])} rows differ, first {bad[0]}" if bad else ""


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    sf = sys.argv[1]
    session = SparkSession.builder.master("local[6]").config("spark.sql.shuffle.partitions", "6").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g").config("spark.ui.showConsoleProgress", "false").config("spark.sql.warehouse.dir", "/tmp/terralith-warehouse").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    queries, oracles = entry.queries(), entry.oracle_sql()
    con = connect(sf)
    for name in sys.argv[2:] or queries:
        t = time.time()
        try:
            if name in oracles:
                print(name, differences(session, queries[name], oracles[name], sf, con) or "equal", f"{time.time() - t:.1f}", flush=True)
            else:
                print(name, queries[name](session, sf).toPandas().shape, "no SQL", f"{time.time() - t:.1f}", flush=True)
        except Exception as e:
            print(name, "FAILED", str(e).strip()[-1500:], flush=True)
