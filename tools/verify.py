"""Run every query and compare it with its SQL: python tools/verify.py [sf_dir] [name ...]"""

from __future__ import annotations

import math
import os
import sys
import time
import traceback
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tidewright.catalog import ORACLES, QUERIES  # noqa: E402
from tidewright.session import build_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()

SPARK_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
               "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "~"
    if isinstance(value, float):
        return repr(value + 0.0)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows), [columns[i] for i in order]


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = build_session("verify", f"local[{os.environ.get('BENCH_CPUS', '8')}]",
                          spark__sql__shuffle__partitions="8", spark__driver__memory="16g")
    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    bad = 0
    for name in names:
        began = time.time()
        try:
            df = QUERIES[name](spark, sf)
            got, columns = rows_of(df.columns, df.collect())
            took = time.time() - began
            if name not in ORACLES:
                print(f"rows  {name:28s} {len(got):8d} rows {took:6.1f}s", flush=True)
                continue
            cursor_types = duck.execute(f"DESCRIBE {ORACLES[name]}").fetchall()
            cursor = duck.execute(ORACLES[name])
            want, expected = rows_of([d[0] for d in cursor.description], cursor.fetchall())
            kinds = {d[0]: str(d[1]) for d in cursor_types}
            odd = {c: (t, kinds.get(c)) for c, t in df.dtypes if SPARK_TYPES.get(t) != kinds.get(c)}
            same = got == want and columns == expected and not odd
            bad += not same
            print(f"{'ok   ' if same else 'DIFF '} {name:28s} {len(got):8d} rows {took:6.1f}s", flush=True)
            if not same:
                print("   columns", columns, expected, len(got), len(want), "types", odd)
                for a, b in [(a, b) for a, b in zip(got, want) if a != b][:4]:
                    print("   got ", a, "\n   want", b)
        except Exception:
            bad += 1
            print(f"FAIL  {name}", flush=True)
            traceback.print_exc(limit=-4)
    print("not matching:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
