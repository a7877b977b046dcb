"""Run registered Spark queries and their DuckDB oracles side by side.

Usage: python tests/oracle_check.py [sf_dir] [name-prefix ...]

Compares row count, column names and an order-insensitive value multiset
(doubles rounded to 6 places), the way the driver's correctness gate does.
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


EXACT = os.environ.get("ORACLE_EXACT") == "1"  # compare raw values, no rounding


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        r = v if EXACT else round(v, 6)
        return 0.0 if r == 0 else r
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "item"):
        return norm(v.item())
    return v


def canon_spark(t: str) -> str:
    return {"bigint": "int64", "int": "int32", "smallint": "int16", "double": "float64", "float": "float32", "string": "string", "boolean": "bool"}.get(t, t)


def canon_duck(t: str) -> str:
    t = t.upper()
    return {"BIGINT": "int64", "INTEGER": "int32", "SMALLINT": "int16", "DOUBLE": "float64", "FLOAT": "float32", "VARCHAR": "string", "BOOLEAN": "bool", "STRING": "string", "NUMBER": "float64"}.get(t, t.lower())


def rows_of(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in records]
    return sorted(out, key=repr)


def main():
    import duckdb

    import __spark_entry__ as E
    from convlens.session import get_spark

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = sys.argv[2:]
    spark = get_spark(os.environ.get("ORACLE_MASTER", "local[8]"))
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf)
            cols = df.columns
            recs = [tuple(r) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {str(e)[:400]}")
            bad += 1
            continue
        dt = time.time() - t0
        if name not in sqls:
            print(f"rows {name}: {len(recs)} rows {dt:.1f}s (no oracle)")
            continue
        try:
            res = con.execute(sqls[name])
            dcols = [d[0] for d in res.description]
            drecs = res.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(e)[:400]}")
            bad += 1
            continue
        if sorted(cols) != sorted(dcols):
            print(f"FAIL {name}: columns {sorted(cols)} vs {sorted(dcols)}")
            bad += 1
            continue
        stypes = {f.name: canon_spark(f.dataType.simpleString()) for f in df.schema.fields}
        dtypes = {d[0]: canon_duck(str(d[1])) for d in res.description}
        type_diff = {c: (stypes[c], dtypes.get(c)) for c in stypes if stypes[c] != dtypes.get(c)}
        if type_diff:
            print(f"TYPE {name}: {type_diff}")
        a, b = rows_of(cols, recs), rows_of(dcols, drecs)
        if a != b:
            bad += 1
            sa, sb = set(a), set(b)
            print(f"FAIL {name}: rows {len(a)} vs {len(b)}; only spark {list(sa - sb)[:3]} only duck {list(sb - sa)[:3]}")
        else:
            print(f"ok   {name}: {len(a)} rows {dt:.1f}s")
    print(f"done, {bad} failing")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
