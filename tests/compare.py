"""Run registered queries against DuckDB on the same files and compare the rows.

    python tests/compare.py [--sf DIR] [name-prefix ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


TIMES: dict[str, float] = {}


def _plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float) and math.isnan(v):
        return "NaN"
    if isinstance(v, float) and v == 0:
        return 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def _kind(v) -> str:
    if isinstance(v, bool):
        return "bool"
    return "float" if isinstance(v, (float, decimal.Decimal)) else type(v).__name__


def _canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(out, key=repr)


def compare(spark, con, name: str, fn, sql: str, sf: str) -> str | None:
    """None when equal, else what differs."""
    t = time.time()
    df = fn(spark, sf)
    got_names, got = _canonical(df.columns, [tuple(r) for r in df.collect()])
    TIMES[name] = time.time() - t
    cur = con.execute(sql)
    want_names, want = _canonical([d[0] for d in cur.description], cur.fetchall())
    if got_names != want_names:
        return f"columns {got_names} != {want_names}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}; e.g. {got[:2]} / {want[:2]}"
    if not got:
        return "both empty"
    for g, w in zip(got, want, strict=True):
        if g != w:
            return f"values {g} != {w}"
        kinds = [(n, _kind(a), _kind(b)) for n, a, b in zip(got_names, g, w, strict=True) if _kind(a) != _kind(b)]
        if kinds:
            return f"types {kinds}"
    return None


def main() -> int:
    args = sys.argv[1:]
    sf = "/root/testdata/sf0.01"
    if args[:1] == ["--sf"]:
        sf, args = args[1], args[2:]
    import __spark_entry__ as entry
    from refracta.session import get_session

    spark = get_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    oracles, bad = entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if args and not any(name.startswith(a) for a in args):
            continue
        t = time.time()
        try:
            if name in oracles:
                problem = compare(spark, con, name, fn, oracles[name], sf)
            else:
                n = fn(spark, sf).count()
                problem = None if n else "no rows"
        except Exception as e:  # noqa: BLE001 - report and go on
            problem = f"{type(e).__name__}: {str(e)[:900]}"
        if problem:
            bad += 1
        print(f"{'FAIL' if problem else 'ok  '} {TIMES.get(name, 0):6.2f}s of {time.time() - t:6.2f}s {name} {'' if name in oracles else '(rows only)'} {problem or ''}"[:1500], flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
