"""Run registered queries and compare with their SQL in DuckDB (also a command line)."""

from __future__ import annotations

import math
import sys
import time

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _key(row):
    return tuple((v is None, str(type(v)), repr(v)) for v in row)


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=_key)


SIMPLE = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def compare(spark, con, name, build, sql, folder):
    """Return (problem or '', rows, spark seconds)."""
    start = time.time()
    df = build(spark, folder)
    got = df.collect()
    spent = time.time() - start
    if sql is None:
        return ("" if got else "no rows"), len(got), spent
    cursor = con.execute(sql)
    want = cursor.fetchall()
    names = [d[0] for d in cursor.description]
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    cols_got, rows_got = rows_of(df.columns, [tuple(r) for r in got])
    cols_want, rows_want = rows_of(names, want)
    if cols_got != cols_want:
        return f"columns {cols_got} != {cols_want}", len(got), spent
    mixed = [f"{c}:{t}/{kinds[c]}" for c, t in df.dtypes if SIMPLE.get(t, t) != kinds[c]]
    note = f"types {mixed}" if mixed else ""
    if len(rows_got) != len(rows_want):
        return f"{len(rows_got)} rows != {len(rows_want)}", len(got), spent
    bad = [(g, w) for g, w in zip(rows_got, rows_want) if g != w]
    if bad:
        return f"{len(bad)} differ {cols_got}; e.g. {bad[0][0]} != {bad[0][1]}"[:700], len(got), spent
    if not got:
        return "empty", 0, spent
    return note, len(got), spent


def main(argv):
    from plumbline.plans import QUERIES, SQL, load_all
    from plumbline.session import local_session

    folder = f"/root/testdata/sf{argv[0]}"
    large = "--large" in argv  # take the paths meant for inputs that are not small
    argv = [a for a in argv if a != "--large"]
    load_all()
    picked = [n for n in QUERIES if len(argv) < 2 or any(n.startswith(a) for a in argv[1:])]
    spark = local_session(8)
    if large:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    con = duck(folder)
    failed = 0
    for name in picked:
        try:
            problem, count, spent = compare(spark, con, name, QUERIES[name], SQL.get(name), folder)
        except Exception as error:  # noqa: BLE001
            problem, count, spent = f"{type(error).__name__}: {str(error)[:600]}", -1, 0.0
        failed += bool(problem)
        kind = "sql" if name in SQL else "rows"
        print(f"{'BAD ' if problem else 'ok  '}{name} [{kind}] {count} rows {spent:.2f}s {problem}", flush=True)
    print(f"{len(picked) - failed} of {len(picked)} ok")


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    main(sys.argv[1:])
