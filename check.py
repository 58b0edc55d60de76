"""Compare every query with its SQL cross-check: python check.py SF_DIR [query ...]"""

from __future__ import annotations

import sys
import time

import duckdb

from inkveil.queries.oracle import oracle
from inkveil.queries.registry import QUERIES
from inkveil.session import local_session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(round(v, 9) if isinstance(v, float) else v for v in (r[i] for i in order)) for r in rows), key=repr
    )


def main() -> int:
    sf, only = sys.argv[1], sys.argv[2:]
    spark = local_session()
    spark.sparkContext.setLogLevel("OFF")
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    bad = 0
    sql = oracle()
    for name, query in QUERIES.items():
        if only and name not in only:
            continue
        try:
            start = time.time()
            df = query(spark, sf)
            got = rows_of(df.columns, [tuple(r) for r in df.collect()])
            mid = time.time()
            if name not in sql:
                print(f"ROWS {name} {len(got[1])} {mid - start:.1f}s", flush=True)
                continue
            rel = con.execute(sql[name])
            want = rows_of([d[0] for d in rel.description], rel.fetchall())
            took = f"{mid - start:.1f}s / {time.time() - mid:.1f}s"
            if got == want:
                print(f"ok   {name} {len(got[1])} {took}", flush=True)
            else:
                bad += 1
                g, w = set(map(repr, got[1])), set(map(repr, want[1]))
                print(f"DIFF {name} {got[0]} {want[0]} {len(got[1])} {len(want[1])} {took}", flush=True)
                print("   spark only:", [x[:300] for x in sorted(g - w)[:3]], flush=True)
                print("   sql only:  ", [x[:300] for x in sorted(w - g)[:3]], flush=True)
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"FAIL {name} {str(e)[:600]}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
