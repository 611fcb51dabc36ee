"""Runs registered queries against their DuckDB forms: python tests/compare.py SF_DIR [NAME...]."""

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    db = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return db


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    cell = lambda x: ("nan" if math.isnan(x) else f"{x:.6g}") if isinstance(x, float) else str(x)
    return sorted(tuple(cell(r[i]) for i in order) for r in rows), sorted(names)


def compare(spark, db, name, f, sql, sf_dir):
    df = f(spark, sf_dir)
    got, want = normal([tuple(r) for r in df.collect()], df.columns), db.sql(sql)
    want = normal(want.fetchall(), want.columns)
    if got == want:
        return None
    diff = next(((a, b) for a, b in zip(got[0], want[0], strict=False) if a != b), None)
    return f"{name}: columns {got[1]} {want[1]}, rows {len(got[0])} {len(want[0])}, first {str(diff)[:600]}"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from pagemill.session import local_session

    spark = local_session(cores=4, memory="4g")
    spark.sparkContext.setLogLevel("OFF")
    queries, oracles, db = entry.queries(), entry.oracle_sql(), connect(sys.argv[1])
    for name in sys.argv[2:] or [n for n in queries if not n.startswith(("op", "pipeline"))]:
        t = time.time()
        try:
            said = compare(spark, db, name, queries[name], oracles[name], sys.argv[1]) if name in oracles else f"{name}: {queries[name](spark, sys.argv[1]).count()} rows, no SQL"
        except Exception as e:  # noqa: BLE001
            said = f"{name}: FAILED {type(e).__name__} {str(e)[:500]}"
        print(f"{time.time() - t:.1f} s", said or f"{name}: equal", flush=True)
