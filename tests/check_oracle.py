"""Compare every named query with its SQL twin: python tests/check_oracle.py [sf_dir] [name ...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if v != v else f"{v:.9g}"
    return "∅" if v is None else str(v)


def rows(columns: list[str], data) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_plain(r[i]) for i in order) for r in data)


def compare(spark, con, sf_dir: str, name: str) -> str | None:
    """None when equal, else a short account of the difference."""
    from __spark_entry__ import oracle_sql, queries

    df = queries()[name](spark, sf_dir)
    ours = rows(df.columns, [tuple(r) for r in df.collect()])
    sql = oracle_sql().get(name)
    if sql is None:
        return None if ours[1] else "no rows"
    res = con.execute(sql)
    theirs = rows([c[0] for c in res.description], res.fetchall())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} vs {theirs[0]}"
    if ours[1] == theirs[1]:
        return None if ours[1] else "no rows"
    a, b = set(ours[1]), set(theirs[1])
    return f"{len(ours[1])} vs {len(theirs[1])} rows; only ours {sorted(a - b)[:2]}; only theirs {sorted(b - a)[:2]}"


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from tallygrain.session import get_session

    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    names = args[1:] or list(queries())
    spark, con, bad = get_session("local[8]"), connect(sf_dir), 0
    for name in names:
        t = time.time()
        try:
            problem = compare(spark, con, sf_dir, name)
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:700]}"
        mark = "ok  " if problem is None else "FAIL"
        bad += problem is not None
        print(f"@@ {mark} {'sql ' if name in oracle_sql() else 'rows'} {name} {time.time() - t:.1f}s {problem or ''}", flush=True)
    print(f"@@ {len(names) - bad}/{len(names)} ok")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
