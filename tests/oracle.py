"""Compare registered queries with their SQL in DuckDB: python -m tests.oracle <sf> [name part ...]."""

from __future__ import annotations

import sys
import time
from datetime import datetime
from decimal import Decimal
from pathlib import Path

import duckdb

ROOT = "/root/testdata"


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def cell(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, Decimal):
        return ("decimal", str(x))
    if isinstance(x, float):
        return "nan" if x != x else float(f"{x + 0.0:.10g}") + 0.0
    if isinstance(x, datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, (list, tuple)):
        return tuple(cell(i) for i in x)
    return x


def ordered(names: list[str], rows) -> tuple[list[str], list[tuple]]:
    idx = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(cell(r[i]) for i in idx) for r in rows]
    return [names[i] for i in idx], sorted(out, key=repr)


def compare(spark, con, fn, sql: str, sf_dir: str) -> tuple[bool, str]:
    df = fn(spark, sf_dir)
    a_names, a = ordered(df.columns, df.collect())
    res = con.execute(sql)
    b_names, b = ordered([d[0] for d in res.description], res.fetchall())
    if a_names != b_names:
        return False, f"columns {a_names} / {b_names}"
    if len(a) != len(b):
        return False, f"rows {len(a)} / {len(b)}; {a[:2]} / {b[:2]}"
    for x, y in zip(a, b):
        if repr(x) != repr(y):
            return False, f"first difference {str(x)[:300]} / {str(y)[:300]}"
    return True, f"{len(a)} rows"


def main(sf: str, parts: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries
    from scholarium.session import local_session

    spark = local_session()
    sf_dir = f"{ROOT}/{sf}"
    con = connection(sf_dir)
    sqls = oracle_sql()
    bad = 0
    for name, fn in queries().items():
        if parts and not any(name.startswith(p) for p in parts):
            continue
        start = time.time()
        try:
            if name in sqls:
                ok, note = compare(spark, con, fn, sqls[name], sf_dir)
            else:
                ok, note = True, f"{fn(spark, sf_dir).count()} rows, no SQL"
        except Exception as e:  # noqa: BLE001 - the tool lists every failure
            ok, note = False, f"{type(e).__name__}: {str(e)[:700]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {note}", flush=True)
    print(f"{bad} failed")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
