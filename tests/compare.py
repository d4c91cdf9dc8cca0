"""Run registered queries and their SQL side by side and compare whole results."""

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if hasattr(v, "item"):
        return _cell(v.item())
    return repr(v)


def table_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def spark_result(df):
    return table_of(df.columns, [tuple(r) for r in df.collect()])


def duck_result(con, sql):
    cur = con.execute(sql)
    return table_of([d[0] for d in cur.description], cur.fetchall())


def difference(a, b):
    if a[0] != b[0]:
        return f"columns {a[0]} <> {b[0]}"
    if len(a[1]) != len(b[1]):
        return f"rows {len(a[1])} <> {len(b[1])}; spark {a[1][:2]} sql {b[1][:2]}"
    bad = [(x, y) for x, y in zip(a[1], b[1]) if x != y]
    return f"{len(bad)} of {len(a[1])} rows differ, {a[0]}: {bad[:2]}" if bad else None


def main(argv):
    import __spark_entry__
    from pulsegrid.session import local_session

    sf = argv[1]
    wanted = argv[2:]
    queries, sqls = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    spark = local_session(8)
    con = connect(sf)
    failed = 0
    for name, fn in queries.items():
        if wanted and not any(w == name or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        t0 = time.time()
        try:
            got = spark_result(fn(spark, sf))
            t1 = time.time()
            bad = difference(got, duck_result(con, sqls[name])) if name in sqls else None
            state = ("DIFF " + bad[:700]) if bad else ("ok" if name in sqls else "rows-only")
        except Exception as e:  # noqa: BLE001
            t1, state, got = time.time(), "ERROR " + str(e)[:700], ([], [])
        failed += state[:2] not in ("ok", "ro")
        print(f"{name:28s} {t1 - t0:6.2f}s {len(got[1]):7d} {state}", flush=True)
    print("failed", failed)


if __name__ == "__main__":
    main(sys.argv)
