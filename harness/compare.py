"""Run registered queries in Spark and DuckDB and compare the results.

    python -m harness.compare <data folder> [query ...]
"""

from __future__ import annotations

import sys
import time

import duckdb

from harness.oracles import ORACLES
from harness.registry import QUERIES
from labelloom.session import local_session

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return db


def plain_rows(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    picked = [tuple(row[i] for i in order) for row in rows]
    return sorted(picked, key=lambda row: [(v is None, str(v)) for v in row])


def compare(spark, db, sf_dir: str, name: str) -> str:
    """Empty when both sides agree, else what differs."""
    df = QUERIES[name](spark, sf_dir)
    got = plain_rows(df.columns, [tuple(r) for r in df.collect()])
    result = db.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    want = plain_rows(columns, result.fetchall())
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} against {sorted(columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    wrong = [(g, w) for g, w in zip(got, want) if g != w or
             [type(x) for x in g] != [type(x) for x in w]]
    if wrong:
        return f"{len(wrong)} of {len(got)} rows differ, first {str(wrong[0])[:1500]}"
    return ""


def main(sf_dir: str, names: list[str]) -> int:
    spark, db, bad = local_session("compare"), connect(sf_dir), 0
    for name in names or list(QUERIES):
        started = time.time()
        try:
            if name in ORACLES:
                problem = compare(spark, db, sf_dir, name)
                size = ""
            else:
                problem, size = "", f"rows only: {QUERIES[name](spark, sf_dir).count()}"
        except Exception as error:  # report every query, then fail at the end
            problem, size = f"{type(error).__name__}: {str(error)[:300]}", ""
        bad += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - started:.1f}s {size}{problem}",
              flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
