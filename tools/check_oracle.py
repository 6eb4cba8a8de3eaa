"""Run registered queries next to their SQL text and compare whole results.

usage: python tools/check_oracle.py [folder] [name-prefix ...]
"""

from __future__ import annotations

import datetime
import math
import pathlib
import sys
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def norm(v):
    if isinstance(v, bool) or v is None or isinstance(v, (int, str)):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else (round(v, 9) + 0.0)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return repr(v)


def main() -> int:
    import duckdb

    from feedlake.plans import registry
    from feedlake.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:])
    jobs, texts = registry.jobs(), registry.sql_texts()
    spark = build_session(master="local[8]", shuffle_partitions=8, driver_memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    bad = []
    for name, fn in jobs.items():
        if prefixes and not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            df = fn(spark, folder)
            cols = sorted(df.columns)
            got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
        except Exception as exc:  # report and go on with the next query
            bad.append(name)
            print(f"FAIL {name}: {str(exc)[:1200]}", flush=True)
            continue
        took = time.time() - start
        if name not in texts:
            print(f"ROWS {name}: {len(got)} rows {took:.1f}s", flush=True)
            continue
        try:
            start = time.time()
            rel = con.sql(texts[name])
            names = rel.columns
            rows = rel.fetchall()
            sql_took = time.time() - start
        except Exception as exc:
            bad.append(name)
            print(f"SQLFAIL {name}: {str(exc)[:800]}", flush=True)
            continue
        idx = [names.index(c) if c in names else -1 for c in cols]
        if sorted(names) != cols:
            bad.append(name)
            print(f"COLS {name}: {cols} vs {sorted(names)}", flush=True)
            continue
        want = sorted((tuple(norm(r[i]) for i in idx) for r in rows), key=repr)
        types = [type(v).__name__ for v in (rows[0] if rows else ())]
        if got == want:
            print(f"ok   {name}: {len(got)} rows spark {took:.1f}s duckdb {sql_took:.1f}s"
                  + (" DECIMAL" if "Decimal" in types else "") + (" EMPTY" if not got else ""), flush=True)
        else:
            bad.append(name)
            left = [r for r in got if r not in set(want)][:3]
            right = [r for r in want if r not in set(got)][:3]
            print(f"DIFF {name}: {len(got)} vs {len(want)} rows\n  cols {cols}\n  spark {left}\n  sql   {right}", flush=True)
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
