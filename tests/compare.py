"""Run registered queries against their oracles on one data set: python tests/compare.py SF [name …]"""

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if hasattr(v, "to_pydatetime"):
        v = v.to_pydatetime()
    if hasattr(v, "isoformat"):
        return v.isoformat()
    try:
        import decimal
        if isinstance(v, decimal.Decimal):
            return round(float(v), 6)
    except ImportError:
        pass
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name, fn, sql, sf):
    start = time.time()
    df = fn(spark, sf)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    spent = time.time() - start
    if sql is None:
        return "rows", f"{len(got[1])} rows", spent
    start = time.time()
    cur = con.execute(sql)
    want = rows_of([c[0] for c in cur.description], cur.fetchall())
    spent_sql = time.time() - start
    if got == want:
        return "ok", f"{len(got[1])} rows, sql {spent_sql:.1f}s", spent
    a, b = set(map(repr, got[1])), set(map(repr, want[1]))
    return "DIFF", f"cols {got[0] == want[0]} {got[0]} {want[0]} rows {len(got[1])}/{len(want[1])}\n   spark-only {sorted(a - b)[:3]}\n   sql-only   {sorted(b - a)[:3]}", spent


def main():
    import duckdb
    import __spark_entry__ as entry
    from terralith.config import build_session

    sf, wanted = sys.argv[1], sys.argv[2:]
    spark = build_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                                    "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("OFF")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries), set(oracles) - set(queries)
    for name in wanted or queries:
        try:
            status, note, spent = compare(spark, con, name, queries[name], oracles.get(name), sf)
        except Exception as error:  # noqa: BLE001 - report and go on
            status, note, spent = "ERROR", f"{type(error).__name__}: {str(error)[:600]}", 0.0
        print(f"{status:6} {name:24} {spent:6.1f}s {note}", flush=True)


if __name__ == "__main__":
    main()
