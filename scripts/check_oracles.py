"""Run registered queries on Spark and their SQL oracles on DuckDB; compare the results.

Usage: python scripts/check_oracles.py [--sf DIR] [name ...]
Compares row count, column names, column types (mapped) and the order-insensitive
multiset of rows (doubles rounded to 6 places, -0.0 folded to 0.0).
"""

from __future__ import annotations

import argparse
import math
import sys
import time
import traceback

import duckdb

sys.path.insert(0, __file__.rsplit("/scripts/", 1)[0])

from tricolor.plans.registry import oracle_sql, queries  # noqa: E402
from tricolor.session import get_spark  # noqa: E402
from tricolor.sources.readers import DRIVER_TABLES  # noqa: E402

SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN", "float": "FLOAT", "timestamp": "TIMESTAMP"}


STRICT = False


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        if STRICT:
            return repr(v)
        v = round(v, 6)
        return 0.0 if v == 0 else v
    if hasattr(v, "item"):
        return norm(v.item())
    return v


def rows_key(rows):
    return sorted((tuple(norm(x) for x in r) for r in rows), key=lambda t: tuple(str(x) for x in t))


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--strict", action="store_true", help="exact floats, signed zeros kept")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    global STRICT
    STRICT = a.strict
    spark = get_spark()
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{a.sf}/{t}.parquet')")
    qs, sqls = queries(), oracle_sql()
    names = a.names or list(qs)
    bad = 0
    for name in names:
        t0 = time.time()
        try:
            sdf = qs[name](spark, a.sf)
            s_cols = sdf.columns
            s_types = [SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString())
                       for f in sdf.schema.fields]
            s_rows = [tuple(r) for r in sdf.collect()]
        except Exception:  # noqa: BLE001
            print(f"FAIL {name}: spark error\n{traceback.format_exc()[-1500:]}")
            bad += 1
            continue
        dt = time.time() - t0
        if name not in sqls:
            print(f"ROWS {name}: {len(s_rows)} rows ({dt:.1f}s) [no oracle]")
            continue
        try:
            rel = con.sql(sqls[name])
            d_cols = rel.columns
            d_types = [str(t) for t in rel.types]
            d_rows = rel.fetchall()
        except Exception:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error\n{traceback.format_exc()[-1500:]}")
            bad += 1
            continue
        problems = []
        if sorted(s_cols) != sorted(d_cols):
            problems.append(f"columns spark={s_cols} duck={d_cols}")
        else:
            st = dict(zip(s_cols, s_types))
            dtm = dict(zip(d_cols, d_types))
            tdiff = {c: (st[c], dtm[c]) for c in s_cols if st[c] != dtm[c]}
            if tdiff:
                problems.append(f"types {tdiff}")
            if len(s_rows) != len(d_rows):
                problems.append(f"rows spark={len(s_rows)} duck={len(d_rows)}")
            order = sorted(s_cols)
            si = [s_cols.index(c) for c in order]
            di = [d_cols.index(c) for c in order]
            sk = rows_key([tuple(r[i] for i in si) for r in s_rows])
            dk = rows_key([tuple(r[i] for i in di) for r in d_rows])
            if sk != dk:
                diff = [(x, y) for x, y in zip(sk, dk) if x != y][:3]
                problems.append(f"values differ, e.g. {diff}")
        if problems:
            bad += 1
            print(f"FAIL {name} ({dt:.1f}s): " + "; ".join(problems)[:1500])
        else:
            print(f"OK   {name}: {len(s_rows)} rows ({dt:.1f}s)")
    print(f"{len(names) - bad}/{len(names)} ok")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
