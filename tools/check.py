"""Compare every query with its SQL check on DuckDB: rows, columns, values.

usage: python tools/check.py [--sf DIR] [name-prefix ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

from crestline import catalog  # noqa: E402
from crestline.session import build_session  # noqa: E402


def plain(value):
    if isinstance(value, float):
        return 0.0 if value == 0 else value
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float) and math.isnan(a) and math.isnan(b):
        return True
    return a == b


def key(row):
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = build_session("local[8]", "check")
    db = duckdb.connect()
    for path in Path(args.sf).glob("*.parquet"):
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    queries, oracle = catalog.queries(), catalog.oracle_sql()
    bad = []
    for name, query in queries.items():
        if args.names and not any(name.startswith(n) for n in args.names):
            continue
        try:
            t0 = time.time()
            df = query(spark, args.sf)
            rows = df.collect()
            t1 = time.time()
            if name not in oracle:
                print(f"ROWS  {name:28s} {len(rows):8d} rows  spark {t1 - t0:5.1f}s", flush=True)
                continue
            result = db.execute(oracle[name])
            columns = [c[0] for c in result.description]
            expected = result.fetchall()
            t2 = time.time()
        except Exception as error:  # report and go on with the next query
            bad.append(name)
            print(f"ERROR {name}: {str(error)[:1500]}", flush=True)
            continue
        order = sorted(df.columns)
        problem = ""
        if sorted(columns) != order:
            problem = f"columns {order} vs {sorted(columns)}"
        else:
            left = sorted((tuple(plain(r[c]) for c in order) for r in rows), key=key)
            index = [columns.index(c) for c in order]
            right = sorted((tuple(plain(r[i]) for i in index) for r in expected), key=key)
            if len(left) != len(right):
                problem = f"{len(left)} rows vs {len(right)}"
            else:
                differing = [(a, b) for a, b in zip(left, right) if not all(map(same, a, b))]
                if differing:
                    problem = f"{len(differing)} of {len(left)} rows differ, e.g. {differing[0]}"
            if problem and len(left) and len(right):
                ls, rs = set(left), set(right)
                problem += f"\n   only spark {sorted(ls - rs, key=key)[:3]}\n   only sql   {sorted(rs - ls, key=key)[:3]}"
            types = {c: str(t) for c, t in zip(columns, [d[1] for d in result.description])}
        if problem:
            bad.append(name)
        print(f"{'BAD ' if problem else 'ok  '}  {name:28s} {len(rows):8d} rows  spark {t1 - t0:5.1f}s sql {t2 - t1:5.1f}s {problem}", flush=True)
    print("failed:", bad or "none")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
