"""Run a query and its checking SQL over the same tables and compare the rows."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET threads=8")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(v):
    if v is None:
        return ""
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 6) + 0.0)
    if isinstance(v, bool):
        return str(v)
    return str(v)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows), sorted(columns)


def compare(spark, con, sf_dir, fn, sql):
    t0 = time.time()
    df = fn(spark, sf_dir)
    got, got_cols = _rows(df.columns, [tuple(r) for r in df.collect()])
    spent = time.time() - t0
    if sql is None:
        return True, f"rows={len(got)} {spent:.1f}s (rows only)", got, None
    cur = con.execute(sql)
    want, want_cols = _rows([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return False, f"columns {got_cols} != {want_cols}", got, want
    if got != want:
        return False, f"rows {len(got)} vs {len(want)}", got, want
    return True, f"rows={len(got)} {spent:.1f}s", got, want


def main(argv):
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as entry
    from folioworks.session import local_session

    sf = argv[0]
    names = argv[1:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = []
    for name in names or sorted(queries):
        try:
            ok, note, got, want = compare(spark, con, sf, queries[name], oracles.get(name))
        except Exception as e:  # report and go on with the next query
            ok, note, got, want = False, f"{type(e).__name__}: {str(e)[:1500]}", None, None
        print(("ok  " if ok else "BAD ") + name, note, flush=True)
        if not ok:
            bad.append(name)
            if got is not None and want is not None:
                g, w = set(got), set(want)
                for r in sorted(g - w)[:2]:
                    print("   spark :", str(r)[:700])
                for r in sorted(w - g)[:2]:
                    print("   oracle:", str(r)[:700])
    print("BAD:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
