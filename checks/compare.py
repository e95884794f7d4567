"""Run registered queries beside their SQL: python -m checks.compare SF_DIR [names...]"""

from __future__ import annotations

import sys
import time

import duckdb

TABLES = """region nation customer supplier part orders lineitem events documents embeddings pages
benchmark labels conversations""".split()


def _plain(value):
    if isinstance(value, float):
        return None if value != value else round(value, 6)
    return None if value is None else value if isinstance(value, (int, str, bool)) else str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([_plain(r[i]) for i in order]) for r in rows)


def compare(spark, folder: str, names=None, out=print) -> list[str]:
    from checks import QUERIES, SQL

    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    bad = []
    for name in names or QUERIES:
        start = time.time()
        try:
            df = QUERIES[name](spark, folder)
            mine = rows_of(df.columns, df.collect())
            spent = time.time() - start
            if name not in SQL:
                out(f"rows  {name} {len(mine)} {spent:.1f}s")
                continue
            cursor = db.execute(SQL[name])
            columns = [c[0] for c in cursor.description]
            theirs = rows_of(columns, cursor.fetchall())
            same = mine == theirs and sorted(columns) == sorted(df.columns)
            out(f"{'same ' if same else 'DIFF '} {name} {len(mine)}/{len(theirs)} {spent:.1f}s")
            if not same:
                bad.append(name)
                out(f"   columns {sorted(df.columns)} / {sorted(columns)}")
                out(f"   only here {[r for r in mine if r not in set(theirs)][:3]}"[:900])
                out(f"   only SQL  {[r for r in theirs if r not in set(mine)][:3]}"[:900])
        except Exception as problem:  # noqa: BLE001
            bad.append(name)
            out(f"FAIL  {name} {type(problem).__name__}: {str(problem)[:700]}")
    return bad


if __name__ == "__main__":
    from harvest.session import local_session

    session = local_session("8")
    failed = compare(session, sys.argv[1], sys.argv[2:])
    print("differences:", failed)
