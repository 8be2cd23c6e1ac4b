"""Run registered queries beside their SQL twins: ``python tests/oracle.py FOLDER [name ...]``."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(v, exact: bool):
    if v is None:
        return "∅"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "∅"
        if v.is_integer():
            return str(int(v))
        return repr(v) if exact else f"{v:.6g}"
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)[:26]
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(plain(x, exact) for x in v) + "]"
    return str(v)


def rows_of(columns, rows, exact=True):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted("|".join(plain(r[i], exact) for i in order) for r in rows)


def compare(spark, con, folder: str, fn, sql: str):
    df = fn(spark, folder)
    got = [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(cols):
        return "FAIL", f"columns {sorted(df.columns)} != {sorted(cols)}"
    a, b = rows_of(df.columns, got), rows_of(cols, want)
    if a == b:
        return "EXACT", f"{len(a)} rows"
    if len(a) != len(b):
        extra = [x for x in a if x not in set(b)][:2], [x for x in b if x not in set(a)][:2]
        return "FAIL", f"{len(a)} rows != {len(b)}; spark-only {extra[0]}; sql-only {extra[1]}"
    if rows_of(df.columns, got, False) == rows_of(cols, want, False):
        return "APPROX", f"{len(a)} rows"
    bad = [(x, y) for x, y in zip(a, b) if x != y][:2]
    return "FAIL", str(bad)[:900]


def main() -> None:
    from factloom.session import local_session
    import __spark_entry__ as entry

    folder, names = sys.argv[1], sys.argv[2:]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, sql = entry.queries(), entry.oracle_sql()
    tally: dict[str, int] = {}
    for name, fn in queries.items():
        if names and not any(n in name for n in names):
            continue
        start = time.perf_counter()
        try:
            if name in sql:
                state, detail = compare(spark, con, folder, fn, sql[name])
            else:
                state, detail = "ROWS", f"{fn(spark, folder).count()} rows"
        except Exception as exc:  # noqa: BLE001
            state, detail = "ERROR", str(exc).split("JVM stacktrace")[0][:700]
        tally[state] = tally.get(state, 0) + 1
        print(f"{state:7}{name:32}{time.perf_counter() - start:7.2f}s  {detail}", flush=True)
    print(tally)


if __name__ == "__main__":
    main()
