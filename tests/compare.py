"""Run registered queries beside their SQL and compare names, types and values."""

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
# DuckDB type names per Spark type name.
TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE",
         "date": "DATE", "boolean": "BOOLEAN"}


def connect(sf_dir: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _key(value):
    if value is None:
        return (0, "")
    if isinstance(value, float) and math.isnan(value):
        return (1, "")
    return (2, repr(value))


def _normal(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: [_key(v) for v in r])


def compare(spark, con, sf_dir, run, sql) -> str:
    """Empty if equal, else what differs."""
    df = run(spark, sf_dir)
    names = sorted(df.columns)
    df = df.select(*[f"`{n}`" for n in names])
    ours = _normal(df.collect())
    if sql is None:
        return "" if ours else "no rows"
    relation = con.sql(sql)
    if sorted(relation.columns) != names:
        return f"columns {names} <> {sorted(relation.columns)}"
    kinds = dict(zip(relation.columns, (str(t) for t in relation.types)))
    wrong = [f"{n}: {t} <> {kinds[n]}" for n, t in df.dtypes if TYPES.get(t, t) != kinds[n]]
    position = [relation.columns.index(n) for n in names]
    theirs = _normal([[row[i] for i in position] for row in relation.fetchall()])
    if len(ours) != len(theirs):
        return f"rows {len(ours)} <> {len(theirs)} {wrong}"
    different = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if different:
        return f"{len(different)} of {len(ours)} rows differ, e.g. {different[:2]} {wrong}"
    if not ours:
        return "no rows"
    return f"types {wrong}" if wrong else ""


def main():
    import os
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from tests.conftest import make_session
    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark, con = make_session(), connect(sf_dir)
    sql, bad = entry.oracle_sql(), 0
    for name, run in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            found = compare(spark, con, sf_dir, run, sql.get(name))
        except Exception as error:  # noqa: BLE001 - report and go on
            found = f"{type(error).__name__}: {str(error)[:600]}"
        bad += bool(found)
        print(f"{name:28} {time.time() - start:6.2f}s {found or 'ok'}"
              f"{'' if name in sql else ' (rows only)'}", flush=True)
    print("different:", bad)


if __name__ == "__main__":
    main()
