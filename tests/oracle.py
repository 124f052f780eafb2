"""Compare registered queries with their SQL: python -m tests.oracle SF_DIR [NAME...]"""

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def canon(v):
    if v is None:
        return "~"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(canon(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{canon(x)}" for k, x in v.items()) + "}"
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted("|".join(canon(r[i]) for i in order) for r in rows)


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def compare(spark, con, sf_dir, name, query, sql):
    began = time.time()
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - began
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    want = rows_of(columns, cur.fetchall())
    same = sorted(df.columns) == sorted(columns) and got == want
    return same, len(got), len(want), took, [x for x in got if x not in set(want)][:3], [x for x in want if x not in set(got)][:3]


if __name__ == "__main__":
    import __spark_entry__ as e
    from verdigris.runtime import build_session

    spark = build_session("oracle", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="8g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir, names = sys.argv[1], sys.argv[2:]
    con, sqls = duck(sf_dir), e.oracle_sql()
    for name, f in e.queries().items():
        if names and name not in names:
            continue
        if name not in sqls:
            began = time.time()
            df = f(spark, sf_dir)
            print(f"{name:28} rows only {df.count()} {time.time() - began:.1f}s {df.dtypes}", flush=True)
            continue
        same, n, m, took, a, b = compare(spark, con, sf_dir, name, f, sqls[name])
        print(f"{name:28} {'ok  ' if same else 'DIFF'} {n} {m} {took:.1f}s", *([] if same else [a, b]), flush=True)
