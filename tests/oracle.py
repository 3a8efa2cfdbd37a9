"""Compare registered queries with their SQL on the given tables.

    python tests/oracle.py /root/testdata/sf0.001 [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=lambda r: tuple(map(str, r)))


def compare(spark, con, name, query, sql, sf_dir):
    t0 = time.time()
    df = query(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    t1 = time.time()
    if sql is None:
        return f"{name}: rows={len(got)} (no SQL) {t1 - t0:.1f}s", len(got) > 0
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows(names, cur.fetchall())
    t2 = time.time()
    if sorted(names) != sorted(df.columns):
        return f"{name}: COLUMNS differ {sorted(df.columns)} vs {sorted(names)}", False
    note = f"rows={len(got)} spark {t1 - t0:.1f}s sql {t2 - t1:.1f}s"
    if got == want:
        types = {type(v).__name__ for r in got[:50] for v in r}
        return f"{name}: ok {note} {sorted(types)}", True
    bad = [(g, w) for g, w in zip(got, want) if g != w][:3]
    return f"{name}: MISMATCH {note} want={len(want)}\n   " + "\n   ".join(map(str, bad)), False


def main(argv):
    from eventcal.session import local_session
    from eventcal.plans import oracles, registry

    sf_dir, picked = argv[0], argv[1:]
    spark = local_session(8, memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = duck(sf_dir), []
    sqls = oracles.oracle_sql()
    for name, query in registry.queries().items():
        if picked and not any(name == p or (p.endswith("*") and name.startswith(p[:-1])) for p in picked):
            continue
        try:
            text, ok = compare(spark, con, name, query, sqls.get(name), sf_dir)
        except Exception as e:  # keep going: one report over all queries
            text, ok = f"{name}: ERROR {str(e)[:600]}", False
        print(text, flush=True)
        failed += [] if ok else [name]
    print("FAILED:", failed)


if __name__ == "__main__":
    main(sys.argv[1:])
