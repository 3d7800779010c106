"""Runs registered queries beside their SQL checks: ``python -m tests.oracle_check [sf] [key ...]``."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    import datetime
    import decimal

    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def compare(spark, con, sf_dir: str, fn, oracle: str | None) -> tuple[str, dict]:
    t0 = time.time()
    df = fn(spark, sf_dir)
    cols = sorted(df.columns)
    got = [tuple(norm(x) for x in r) for r in df.select(*[f"`{c}`" for c in cols]).collect()]
    took = {"spark": round(time.time() - t0, 2), "rows": len(got)}
    if oracle is None:
        return ("rows-only" if got else "EMPTY"), took
    t0 = time.time()
    rel = con.sql(oracle)
    if sorted(rel.columns) != cols:
        return f"COLUMNS spark={cols} duck={sorted(rel.columns)}", took
    order = [rel.columns.index(c) for c in cols]
    types = dict(zip(rel.columns, [str(t) for t in rel.types]))
    bad_types = {c: t for c, t in types.items() if t in ("HUGEINT", "UBIGINT") or t.startswith("DECIMAL")}
    want = [tuple(norm(r[i]) for i in order) for r in rel.fetchall()]
    took["duck"] = round(time.time() - t0, 2)
    key = lambda r: tuple(str(x) for x in r)
    a, b = sorted(got, key=key), sorted(want, key=key)
    if len(a) != len(b):
        return f"COUNT spark={len(a)} duck={len(b)}", took
    if not a:
        return "EMPTY", took
    if a != b:
        from collections import Counter

        ca, cb = Counter(a), Counter(b)
        only_a, only_b = sorted((ca - cb).elements(), key=key), sorted((cb - ca).elements(), key=key)
        return f"VALUES {len(only_a)} of {len(a)} differ; cols={cols}\n   spark {only_a[:2]}\n   duck  {only_b[:2]}", took
    st = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    warn = f" TYPES {bad_types}" if bad_types else ""
    ints = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "string": "VARCHAR", "date": "DATE"}
    off = {c: (st[c], types[c]) for c in cols if st[c] in ints and ints[st[c]] != types[c]}
    return "ok" + warn + (f" [{off}]" if off else ""), took


def main() -> None:
    from barflow.plans import registry
    from barflow.session import local

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    keys = sys.argv[2:]
    spark = local(8)
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{sf}"
    con = duck(sf_dir)
    q, o = registry.queries(), registry.oracles()
    wanted = [k for k in q if not keys or k in keys or any(x.endswith(":") and q[k].__module__.endswith("plans." + x[:-1]) for x in keys)]
    bad = 0
    for k in wanted:
        try:
            status, took = compare(spark, con, sf_dir, q[k], o.get(k))
        except Exception as e:  # noqa: BLE001
            status, took = "ERROR " + str(e).strip()[:600], {}
        good = status.startswith("ok") or status == "rows-only"
        bad += not good
        print(("   " if good else "!! ") + k, status, took, flush=True)
    print(f"{len(wanted)} queries, {bad} bad")


if __name__ == "__main__":
    main()
