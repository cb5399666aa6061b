"""Compare queries with their SQL in DuckDB: columns by name, rows as a bag, values exactly."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    return v


def bag(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_value(r[i]) for i in order) for r in rows)


def compare(spark, con, fn, sql: str, sf_dir: str) -> tuple[bool, str]:
    frame = fn(spark, sf_dir)
    ours = bag(frame.columns, [tuple(r) for r in frame.collect()])
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    theirs = bag(names, result.fetchall())
    if sorted(frame.columns) != sorted(names):
        return False, f"columns {sorted(frame.columns)} / {sorted(names)}"
    if ours != theirs:
        extra, lost = ours - theirs, theirs - ours
        return False, f"{sum(ours.values())}/{sum(theirs.values())} rows; ours {list(extra)[:3]} theirs {list(lost)[:3]}"
    return True, f"{sum(ours.values())} rows"


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).parents[1]))
    import __spark_entry__ as entry_module
    from seriesloom.session import local_session

    sf_dir = sys.argv[1]
    wanted = sys.argv[2:]
    spark, con = local_session(8), connection(sf_dir)
    registered, texts = entry_module.queries(), entry_module.oracle_sql()
    bad = []
    for name, fn in registered.items():
        if wanted and name not in wanted:
            continue
        began = time.time()
        try:
            if name in texts:
                ok, note = compare(spark, con, fn, texts[name], sf_dir)
            else:
                ok, note = True, f"{fn(spark, sf_dir).count()} rows, no SQL"
        except Exception as error:  # noqa: BLE001
            ok, note = False, f"{type(error).__name__}: {str(error)[:600]}"
        print(f"{'ok  ' if ok else 'FAIL'} {name:24s} {time.time() - began:6.2f}s {note}", flush=True)
        if not ok:
            bad.append(name)
    print(len(bad), "failed:", bad)
