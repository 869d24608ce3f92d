"""Run registered queries against their SQL counterparts in DuckDB: python tests/compare.py SF_DIR [name ...]."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def compare(spark, con, fn, sql: str, sf: str) -> str | None:
    """None when equal, else the first difference."""
    got = fn(spark, sf)
    rel = con.sql(sql)
    if sorted(got.columns) != sorted(rel.columns):
        return f"columns {sorted(got.columns)} != {sorted(rel.columns)}"
    cols = sorted(got.columns)
    kinds = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    simple = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    for c, t in got.dtypes:
        if simple.get(t) != kinds[c]:
            return f"type of {c}: {t} != {kinds[c]}"
    key = lambda r: tuple((v is None, v) for v in r)
    a = sorted((tuple(r) for r in got.select(*cols).collect()), key=key)
    b = sorted(rel.select(", ".join(f'"{c}"' for c in cols)).fetchall(), key=key)
    if len(a) != len(b):
        return f"{len(a)} rows != {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} of {len(a)} rows differ, e.g. {bad[0]}" if bad else None


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from kinfold.session import local_session

    sf, names = sys.argv[1], sys.argv[2:]
    spark, con = local_session(8), connect(sf)
    sqls = oracle_sql()
    for name, fn in queries().items():
        if names and name not in names:
            continue
        t = time.time()
        try:
            if name in sqls:
                diff = compare(spark, con, fn, sqls[name], sf)
                note = "ok" if diff is None else f"DIFF {diff}"
            else:
                note = f"rows {fn(spark, sf).count()}"
        except Exception as e:  # report and go on
            note = "ERROR " + str(e).split("JVM stacktrace")[0][:600].replace("\n", " ")
        print(f"{name:30s} {time.time() - t:6.2f}s {note}", flush=True)


if __name__ == "__main__":
    main()
