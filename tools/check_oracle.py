"""Run registered queries on Spark and their oracles on DuckDB; compare.

Usage: python tools/check_oracle.py [sf_dir] [name ...]

Comparison: same column names; same row count; rows equal as multisets
after sorting columns by name (doubles compared with a 1e-9 relative
tolerance, and reported separately if not bit-identical).
"""
from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

from cytotide.session import get_session  # noqa: E402
import workload  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return v
    if isinstance(v, pd.Timestamp):
        if v.tzinfo is not None:
            v = v.tz_convert("UTC").tz_localize(None)
        return v.to_pydatetime()
    if hasattr(v, "asDict"):
        return tuple(sorted((k, norm(x)) for k, x in v.asDict().items()))
    if hasattr(v, "tolist") and not isinstance(v, (str, bytes)):
        return norm(v.tolist())
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return tuple(sorted((k, norm(x)) for k, x in v.asDict().items()))
    return v


def spark_kind(dt) -> str:
    n = dt.typeName()
    if n in ("byte", "short", "integer", "long"):
        return "int"
    if n in ("float", "double", "decimal"):
        return "float"
    if n in ("timestamp", "timestamp_ntz", "date"):
        return "time"
    if n == "array":
        return "list"
    return {"string": "text", "boolean": "bool"}.get(n, n)


def duck_kind(t: str) -> str:
    t = str(t).upper()
    if t.endswith("[]"):
        return "list"
    if t in ("TINYINT", "SMALLINT", "INTEGER", "BIGINT", "HUGEINT", "UTINYINT", "USMALLINT", "UINTEGER", "UBIGINT"):
        return "int"
    if t in ("FLOAT", "DOUBLE") or t.startswith("DECIMAL"):
        return "float"
    if t.startswith("TIMESTAMP") or t == "DATE":
        return "time"
    return {"VARCHAR": "text", "BOOLEAN": "bool"}.get(t, t)


def key(row):
    return tuple((0, "") if x is None else (1, repr(x) if not isinstance(x, (int, float)) else x)
                 for x in row)


def close(a, b):
    if a is None or b is None:
        return a is None and b is None
    if isinstance(a, float) or isinstance(b, float):
        try:
            return math.isclose(float(a), float(b), rel_tol=1e-9, abs_tol=1e-9)
        except (TypeError, ValueError):
            return False
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(close(x, y) for x, y in zip(a, b))
    return a == b


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    extra = {}
    for kv in os.environ.get("CHECK_CONF", "").split(","):
        if "=" in kv:
            k, v = kv.split("=", 1)
            extra[k] = v
    spark = get_session("local[8]", shuffle_partitions=int(os.environ.get("CHECK_PARTITIONS", "8")), extra=extra)
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles = workload.load()
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    ok = bad = 0
    for name, fn in queries.items():
        if names and name not in names:
            continue
        t0 = time.time()
        try:
            sdf = fn(spark, sf)
            srows = [tuple(norm(r[c]) for c in sorted(sdf.columns)) for r in sdf.collect()]
            scols = sorted(sdf.columns)
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        dt = time.time() - t0
        if name not in oracles:
            print(f"ROWS {name}: {len(srows)} rows (no oracle) {dt:.1f}s")
            continue
        try:
            rel = con.execute(oracles[name])
            ocols = [d[0] for d in rel.description]
            orows_raw = rel.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(e)[:400]}")
            bad += 1
            continue
        okinds = {d[0]: duck_kind(d[1]) for d in rel.description}
        skinds = {f.name: spark_kind(f.dataType) for f in sdf.schema.fields}
        bad_types = {c: (skinds.get(c), okinds[c]) for c in okinds if skinds.get(c) != okinds[c]}
        if bad_types:
            print(f"TYPE {name}: {bad_types}")
        widths = {"integer": "INTEGER", "long": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
                  "boolean": "BOOLEAN", "short": "SMALLINT", "byte": "TINYINT", "float": "FLOAT"}
        fine = {d[0]: (sdf.schema[d[0]].dataType.typeName(), str(d[1])) for d in rel.description
                if d[0] in sdf.columns and sdf.schema[d[0]].dataType.typeName() in widths
                and widths[sdf.schema[d[0]].dataType.typeName()] != str(d[1])}
        if fine:
            print(f"WIDTH {name}: {fine}")
        order = sorted(range(len(ocols)), key=lambda i: ocols[i])
        orows = [tuple(norm(r[i]) for i in order) for r in orows_raw]
        if sorted(ocols) != scols:
            print(f"FAIL {name}: columns spark={scols} oracle={sorted(ocols)}")
            bad += 1
            continue
        if len(srows) != len(orows):
            print(f"FAIL {name}: rows spark={len(srows)} oracle={len(orows)}")
            bad += 1
            continue
        a, b = sorted(srows, key=key), sorted(orows, key=key)
        exact = a == b
        if exact or all(close(x, y) for x, y in zip(a, b)):
            print(f"OK   {name}: {len(srows)} rows{'' if exact else ' (close, not bit-identical)'} {dt:.1f}s")
            ok += 1
        else:
            diff = [(x, y) for x, y in zip(a, b) if not close(x, y)][:3]
            print(f"FAIL {name}: values differ, e.g. {diff} cols={scols}")
            bad += 1
    print(f"summary: ok={ok} fail={bad}")
    spark.stop()


if __name__ == "__main__":
    main()
