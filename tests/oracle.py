"""Compare registered queries with their SQL in DuckDB."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    return con


def normal(v):
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v
    if v is None or isinstance(v, (int, str)):
        return v
    if isinstance(v, (list, tuple)):
        return tuple(normal(x) for x in v)
    return str(v)


def sort_key(row):
    return tuple((v is None, type(v).__name__ if not isinstance(v, (int, float)) else "n", v if v is not None else 0) for v in row)


def compare(spark_df, con, sql):
    cols = sorted(spark_df.columns)
    mine = [tuple(normal(r[c]) for c in cols) for r in spark_df.collect()]
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return f"columns differ: {cols} vs {sorted(names)}"
    at = [names.index(c) for c in cols]
    theirs = [tuple(normal(r[i]) for i in at) for r in cur.fetchall()]
    if len(mine) != len(theirs):
        return f"row counts differ: {len(mine)} vs {len(theirs)}"
    a, b = sorted(mine, key=sort_key), sorted(theirs, key=sort_key)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, first {cols}: {bad[0]}"
    types = [{type(v) for r in rows for v in [r[i]] if v is not None} for rows in (a, b) for i in range(len(cols))]
    for i, c in enumerate(cols):
        if types[i] != types[i + len(cols)]:
            return f"types differ in {c}: {types[i]} vs {types[i + len(cols)]}"
    return None


def main(argv):
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry
    from episodia.session import local_session

    folder = argv[0]
    wanted = argv[1:]
    spark = local_session("oracle")
    con = connect(folder)
    sqls, failed = entry.oracle_sql(), []
    for name, run in entry.queries().items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        t = time.time()
        try:
            df = run(spark, folder)
            if name in sqls:
                problem = compare(df, con, sqls[name])
                rows = "" if problem else f"{df.count() if len(wanted) == 1 else ''}"
            else:
                n = len(df.collect())
                problem, rows = (None if n else "no rows"), f"rows only: {n}"
        except Exception as error:  # report and go on
            problem, rows = f"{type(error).__name__}: {str(error)[:600]}", ""
        print(f"{'ok  ' if not problem else 'FAIL'} {name} {time.time() - t:.1f}s {rows} {problem or ''}", flush=True)
        if problem:
            failed.append(name)
    print("failed:", failed)


if __name__ == "__main__":
    main(sys.argv[1:])
