"""Compare every registered query with its checking SQL: python tests/oracle.py [sf] [name ...]"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ROOT = os.environ.get("TESTDATA", "/root/testdata")


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v if isinstance(v, (int, str)) else str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


FAMILY = {"bigint": "int", "int": "int", "smallint": "int", "tinyint": "int", "string": "str", "boolean": "bool", "double": "float", "float": "float"}
DUCK = {"BIGINT": "int", "INTEGER": "int", "HUGEINT": "huge", "SMALLINT": "int", "VARCHAR": "str", "BOOLEAN": "bool", "DOUBLE": "float", "FLOAT": "float"}


def compare(spark, con, name, fn, sql, sf_dir):
    """None when equal, else what differs."""
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    if sql is None:
        return None, len(got)
    cur = con.execute(sql)
    want_names = [d[0] for d in cur.description]
    want_types = {d[0]: str(d[1]) for d in cur.description}
    want = cur.fetchall()
    if sorted(df.columns) != sorted(want_names):
        return f"columns {sorted(df.columns)} != {sorted(want_names)}", len(got)
    bad = [(c, t, want_types[c]) for c, t in df.dtypes if FAMILY.get(t, t) != DUCK.get(want_types[c], want_types[c].lower())]
    if bad:
        return f"types {bad}", len(got)
    a, b = rows_of(df.columns, got), rows_of(want_names, want)
    if len(a) != len(b):
        sa, sb = set(map(repr, a)), set(map(repr, b))
        return f"rows {len(a)} != {len(b)}; only spark {list(sa - sb)[:3]}; only sql {list(sb - sa)[:3]}", len(got)
    diff = [(x, y) for x, y in zip(a, b) if x != y]
    if diff:
        sa, sb = set(map(repr, a)), set(map(repr, b))
        return f"{len(diff)} rows differ ({sorted(df.columns)}); only spark {sorted(sa - sb)[:3]}; only sql {sorted(sb - sa)[:3]}", len(got)
    return None, len(got)


def main() -> int:
    import __spark_entry__ as entry
    from creditloom.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    only = sys.argv[2:]
    sf_dir = f"{ROOT}/sf{sf}"
    spark = local_session(8)
    con = connect(sf_dir)
    queries, sqls = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, fn in queries.items():
        if only and not any(name.startswith(o) for o in only):
            continue
        t = time.time()
        try:
            why, n = compare(spark, con, name, fn, sqls.get(name), sf_dir)
        except Exception as e:  # report and go on
            why, n = f"{type(e).__name__}: {str(e)[:1500]}", -1
        took = time.time() - t
        tag = "OK  " if why is None else "FAIL"
        failed += why is not None
        print(f"{tag} {name} rows={n} {took:.1f}s{'' if name in sqls else ' (no sql)'}" + (f"\n     {why}" if why else ""), flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
