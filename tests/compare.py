"""Runs queries and their SQL side by side: python tests/compare.py SF_DIR [NAME...]"""

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(rows):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows)


def key(row):
    return tuple((v is None, str(type(v)), v) for v in row)


def differences(spark, name, query, sql, sf_dir):
    """None, or what differs."""
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*cols).collect()), key=key)
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    if sorted(names) != cols:
        return f"columns {cols} and {sorted(names)}"
    at = [names.index(c) for c in cols]
    want = sorted((tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in at) for r in res.fetchall()), key=key)
    if got != want:
        in_got, in_want = set(got), set(want)
        only_g, only_w = [r for r in got if r not in in_want][:3], [r for r in want if r not in in_got][:3]
        return f"{len(got)} and {len(want)} rows; {only_g} {only_w}"
    return None


if __name__ == "__main__":
    from lautwerk import workload
    from lautwerk.session import local_session

    spark = local_session()
    q, sql = workload.queries(), workload.oracle_sql()
    for name in sys.argv[2:] or q:
        began = time.time()
        try:
            out = differences(spark, name, q[name], sql[name], sys.argv[1]) if name in sql else f"rows only: {q[name](spark, sys.argv[1]).count()}"
        except Exception as e:  # noqa: BLE001  a report of all
            out = f"{type(e).__name__}: {str(e)[:300]}"
        print(name, round(time.time() - began, 1), "ok" if out is None else out, flush=True)
