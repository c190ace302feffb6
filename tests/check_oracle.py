"""Compare registered queries with their SQL in DuckDB: python tests/check_oracle.py [sf] [prefix ...]"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def norm(v):
    import datetime
    import decimal

    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return float(f"{v:.9g}") + 0.0
    if isinstance(v, int):
        return float(v)
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)
    if hasattr(v, "asDict"):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((norm(k), norm(x)) for k, x in v.items())) if not _struct(v) else tuple(
            norm(x) for x in v.values()
        )
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def _struct(v):
    return False


def compare(spark, con, name, fn, sql, folder):
    t = time.time()
    df = fn(spark, folder)
    cols = sorted(df.columns)
    got = Counter(tuple(norm(x) for x in r) for r in df.select(*cols).collect())
    secs = time.time() - t
    n = sum(got.values())
    if sql is None:
        return "rows", f"{n} rows", secs
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    if sorted(names) != cols:
        return "COLS", f"{cols} vs {sorted(names)}", secs
    idx = [names.index(c) for c in cols]
    want = Counter(tuple(norm(r[i]) for i in idx) for r in res.fetchall())
    if got == want:
        return ("ok" if n else "EMPTY"), f"{n} rows", secs
    extra, missing = list((got - want).items())[:2], list((want - got).items())[:2]
    bad = sum((got - want).values())
    return "DIFF", f"{n} vs {sum(want.values())} rows, {bad} differ\n  cols {cols}\n  spark {extra}\n  sql   {missing}", secs


def main(argv):
    import duckdb

    import __spark_entry__ as entry
    from lumatlas.session import local_session

    sf = argv[0] if argv else "0.01"
    folder = f"/root/testdata/sf{sf}"
    spark = local_session(8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    oracle = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if len(argv) > 1 and not any(name.startswith(p) for p in argv[1:]):
            continue
        try:
            state, msg, secs = compare(spark, con, name, fn, oracle.get(name), folder)
        except Exception as e:  # noqa: BLE001
            state, msg, secs = "ERROR", str(e)[:700], 0.0
        bad += state not in ("ok", "rows")
        print(f"{state:6} {secs:6.1f}s {name}: {msg}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
