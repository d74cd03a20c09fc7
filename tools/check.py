"""Run registered queries next to their SQL twins in DuckDB and compare whole results.

python tools/check.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import importlib.util
import os
import sys
import time
import traceback

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(v):
        if v is None:
            return "~"
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, float):
            return "~" if v != v else repr(round(v, 6) + 0.0)
        if isinstance(v, (list, tuple)):
            return "[" + ",".join(cell(x) for x in v) + "]"
        return str(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    import duckdb

    from airframe.session import build_session

    spec = importlib.util.spec_from_file_location("entry_module", os.path.join(ROOT, "__spark_entry__.py"))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    spark = build_session(
        master="local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
            "spark.log.level": "ERROR",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{args.sf}/{t}.parquet')")
    qs, oracles = mod.queries(), mod.oracle_sql()
    bad = []
    for name in args.names or qs:
        t0 = time.time()
        try:
            df = qs[name](spark, args.sf)
            got = [tuple(r) for r in df.collect()]
            names = df.columns
            t1 = time.time()
            if name not in oracles:
                print(f"rows  {name:28s} {len(got):8d} rows  spark {t1 - t0:6.2f}s", flush=True)
                continue
            cur = con.execute(oracles[name])
            want_names = [d[0] for d in cur.description]
            want = cur.fetchall()
            t2 = time.time()
            a, b = canonical(got, names), canonical(want, want_names)
            ok = sorted(names) == sorted(want_names) and a == b
            print(f"{'ok   ' if ok else 'DIFF '} {name:28s} {len(got):8d} rows  spark {t1 - t0:6.2f}s  duckdb {t2 - t1:6.2f}s", flush=True)
            if not ok:
                bad.append(name)
                print("   columns", sorted(names), sorted(want_names), len(got), len(want))
                sa, sb = set(a), set(b)
                for r in sorted(sa - sb)[:4]:
                    print("   spark ", str(r)[:600])
                for r in sorted(sb - sa)[:4]:
                    print("   duckdb", str(r)[:600])
        except Exception as e:
            bad.append(name)
            print(f"FAIL  {name}: {type(e).__name__}: {str(e)[:1500]}", flush=True)
            if os.environ.get("TRACE"):
                traceback.print_exc()
    print("failed:", bad)
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
