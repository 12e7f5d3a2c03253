"""Compare a Spark result with the rows that DuckDB gives for the oracle SQL."""

import glob
import os

import duckdb

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "float": "FLOAT"}


def connect(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def canonical(rows, order):
    def cell(v):
        if isinstance(v, float):
            return "nan" if v != v else f"{v + 0.0:.9g}"
        return repr(v)
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def differences(df, con, sql, show=3):
    """Empty list if columns, types and rows agree."""
    got = [tuple(r) for r in df.collect()]
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    types = {d[0]: str(d[1]) for d in cursor.description}
    want = cursor.fetchall()
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    problems = [f"type of {n}: {t} != {types[n]}" for n, t in df.dtypes if TYPES.get(t, t) != types[n]]
    a = canonical(got, [df.columns.index(n) for n in sorted(names)])
    b = canonical(want, [names.index(n) for n in sorted(names)])
    if len(a) != len(b):
        problems.append(f"rows {len(a)} != {len(b)}")
    if a != b:
        left, right = set(a) - set(b), set(b) - set(a)
        problems.append(f"{len(left)} rows only in Spark, {len(right)} only in SQL; columns {sorted(names)}")
        problems += [f"  spark {r}"[:600] for r in sorted(left)[:show]] + [f"  sql   {r}"[:600] for r in sorted(right)[:show]]
    return problems
