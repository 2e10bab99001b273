"""Run queries on Spark and their SQL on DuckDB, and compare the rows.

    python tools/check.py [sf or folder] [key ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tallybook.catalog import ORACLE, QUERIES  # noqa: E402
from tallybook.session import build_session  # noqa: E402
from tallybook.testviews import BASE_TABLES  # noqa: E402

TYPES = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in BASE_TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _sortable(row):
    return tuple((x is None, "" if x is None else (repr(x) if not isinstance(x, float) else format(x, ".12g"))) for x in row)


def _same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == b or math.isclose(a, b, rel_tol=1e-12) or (math.isnan(a) and math.isnan(b))
    return a == b and type(a) is type(b)


def compare(spark, con, key: str, sf_dir: str) -> tuple[str, int]:
    """Problem text ('' when equal) and row count."""
    df = QUERIES[key](spark, sf_dir)
    names = sorted(df.columns)
    rows = [tuple(r) for r in df.select(*[f"`{n}`" for n in names]).collect()]
    if key not in ORACLE:
        return "", len(rows)
    cur = con.execute(ORACLE[key])
    found = [(d[0], str(d[1])) for d in cur.description]
    expected = cur.fetchall()
    if sorted(n for n, _ in found) != names:
        return f"columns {names} != {sorted(n for n, _ in found)}", len(rows)
    order = [[n for n, _ in found].index(n) for n in names]
    kinds = {n: t for n, t in df.dtypes}
    problems = [f"{n}: {kinds[n]} != {t}" for n, t in found if TYPES.get(kinds[n]) != t]
    expected = [tuple(r[i] for i in order) for r in expected]
    rows.sort(key=_sortable)
    expected.sort(key=_sortable)
    if len(rows) != len(expected):
        extra = set(map(repr, rows)) ^ set(map(repr, expected))
        problems.append(f"rows {len(rows)} != {len(expected)} e.g. {sorted(extra)[:4]}")
    else:
        bad = [(a, b) for a, b in zip(rows, expected) if not all(map(_same, a, b))]
        if bad:
            problems.append(f"{len(bad)} rows differ {names} e.g. spark {bad[0][0]} sql {bad[0][1]}")
    return "; ".join(problems), len(rows)


def main() -> int:
    args = sys.argv[1:]
    at = args.pop(0) if args and (args[0][0].isdigit() or args[0].startswith("/")) else "0.001"
    sf_dir = at if at.startswith("/") else f"/root/testdata/sf{at}"
    spark = build_session("8")
    con = duck(sf_dir)
    failed = 0
    for key in args or list(QUERIES):
        start = time.time()
        try:
            problem, n = compare(spark, con, key, sf_dir)
        except Exception as e:  # noqa: BLE001
            problem, n = f"{type(e).__name__}: {str(e)[:900]}", -1
        failed += bool(problem)
        state = "ok  " if not problem else "FAIL"
        if not problem and key not in ORACLE:
            state = "rows"
        print(f"{state} {key} rows={n} {time.time() - start:.1f}s {problem}", flush=True)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
