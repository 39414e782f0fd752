"""Compare registered queries with their SQL in DuckDB: `python tests/oracle.py [sf] [name-prefix …]`."""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()
DATA = os.environ.get("GLEANER_TESTDATA", "/root/testdata")


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def canonical(value):
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, Decimal):
        value = float(value) if value % 1 else int(value)
    if isinstance(value, int):
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, (datetime, date)):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(canonical(v) for v in value)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(canonical(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir: str, name: str, fn, sql: str | None) -> dict:
    t0 = time.time()
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    t1 = time.time()
    out = {"name": name, "rows": sum(got.values()), "spark_s": round(t1 - t0, 2)}
    if sql is None:
        return {**out, "ok": True, "oracle": False}
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    out["duck_s"] = round(time.time() - t1, 2)
    out["ok"] = sorted(names) == sorted(df.columns) and got == want
    if not out["ok"]:
        out["columns"] = (sorted(df.columns), sorted(names))
        out["want_rows"] = sum(want.values())
        out["only_spark"] = list((got - want).keys())[:2]
        out["only_sql"] = list((want - got).keys())[:2]
    return out


def main(argv: list[str]) -> int:
    from gleaner import plans
    from gleaner.session import local_session

    sf = argv[0] if argv else "0.01"
    prefixes = tuple(argv[1:])
    sf_dir = f"{DATA}/sf{sf}"
    spark = local_session("oracle", cpus=8)
    con = duck(sf_dir)
    queries, oracles = plans.all_queries()
    bad = 0
    for name, fn in queries.items():
        if prefixes and not name.startswith(prefixes):
            continue
        try:
            r = compare(spark, con, sf_dir, name, fn, oracles.get(name))
        except Exception as exc:  # keep going so one run lists every problem
            r = {"name": name, "ok": False, "error": str(exc)[:1500]}
        bad += not r["ok"]
        print(("OK  " if r["ok"] else "BAD ") + str(r), flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
