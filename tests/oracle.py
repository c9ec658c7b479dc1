"""Compares queries with their SQL twins: python tests/oracle.py SF_DIR [NAME...]."""

from __future__ import annotations

import math
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

KINDS = {"INTEGER": "int", "BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "TIMESTAMP": "timestamp_ntz", "BOOLEAN": "boolean", "DATE": "date"}


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return repr(round(v, 9) + 0.0)
    if hasattr(v, "isoformat"):
        return v.isoformat()[:26]
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, name, query, sql, sf_dir) -> str:
    """"" if they agree, else what differs first."""
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if Path(path).is_dir() else ''}')")
    got = query(spark, sf_dir)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != sorted(got.columns):
        return f"columns {sorted(got.columns)} and {sorted(names)}"
    kinds = dict(got.dtypes)
    unlike = [f"{d[0]} {kinds[d[0]]}/{d[1]}" for d in cur.description if KINDS.get(str(d[1]), "?") != kinds[d[0]]]
    if unlike:
        return f"types {', '.join(unlike)}"
    a, b = rows_of(got.columns, [tuple(r) for r in got.collect()]), rows_of(names, cur.fetchall())
    if a == b:
        return ""
    return f"{len(a)} and {len(b)} rows; first difference: {next(((x, y) for x, y in zip(a, b, strict=False) if x != y), None)}"


if __name__ == "__main__":
    from tests.conftest import session

    import __spark_entry__ as e

    spark, sf_dir = session(), sys.argv[1]
    for name, sql in e.oracle_sql().items():
        if len(sys.argv) < 3 or any(n in name for n in sys.argv[2:]):
            try:
                said = compare(spark, name, e.queries()[name], sql, sf_dir)
            except Exception as x:  # noqa: BLE001
                said = f"{type(x).__name__}: {str(x)[:300]}"
            print(name, said or "ok", flush=True)
