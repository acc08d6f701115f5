"""Run registered queries next to their SQL in DuckDB and compare values.

    python tests/compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def oracle(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if value is None:
        return None
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    if isinstance(value, bool) or isinstance(value, (int, str)):
        return value
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    if hasattr(value, "asDict"):
        return plain(value.asDict())
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple((type(plain(r[i])).__name__, plain(r[i])) for i in order) for r in rows)


def compare(spark, con, name, query, sql, sf_dir) -> str:
    """Empty when equal, else what differs."""
    found = query(spark, sf_dir)
    got = rows_of(found.columns, [tuple(r) for r in found.collect()])
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    want = rows_of(columns, cursor.fetchall())
    if sorted(found.columns) != sorted(columns):
        return f"columns {sorted(found.columns)} != {sorted(columns)}"
    if got != want:
        only_got, only_want = got - want, want - got
        return (
            f"rows {sum(got.values())} vs {sum(want.values())}; "
            f"spark only {list(only_got.items())[:2]}; sql only {list(only_want.items())[:2]}"
        )
    if not sum(want.values()):
        return "no rows"
    return ""


def main(argv):
    from sparkqual.session import build_session
    from __spark_entry__ import oracle_sql, queries

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = build_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8",
                          "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false", "sparkqual.aggWidth": "30"})
    spark.sparkContext.setLogLevel("ERROR")
    con, sql = oracle(sf_dir), oracle_sql()
    names = argv[1:] or list(queries())
    bad = 0
    for name, query in queries().items():
        if not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        start = time.time()
        try:
            if name in sql:
                problem = compare(spark, con, name, query, sql[name], sf_dir)
            else:
                problem = "" if query(spark, sf_dir).count() >= 0 else "?"
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += bool(problem)
        print(f"RESULT {'FAIL' if problem else 'ok'} {name} {time.time() - start:.1f}s"
              f"{'' if name in sql else ' (rows only)'} {problem[:900]}", flush=True)
    print("RESULT failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]) > 0)
