"""Run every registered query next to its SQL twin: python tests/oracle_check.py [names...]"""

import numbers
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from paracorpus.session import build_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def as_rows(df: pd.DataFrame) -> list[str]:
    def cell(x):
        if x is None or (isinstance(x, float) and x != x) or x is pd.NA:
            return "null"
        # A whole number may come as a float if its column has nulls.
        if isinstance(x, numbers.Number) and not isinstance(x, bool):
            return f"{float(x):.6f}"
        return str(x)

    columns = sorted(df.columns)
    return sorted("|".join(cell(v) for v in row) for row in df[columns].itertuples(index=False))


def compare(spark, con, folder, name, run, sql):
    started = time.time()
    result = run(spark, folder)
    got = result.toPandas()
    spark_time = time.time() - started
    if sql is None:
        return f"rows {len(got)} {spark_time:.1f}s", True
    started = time.time()
    want = con.execute(sql).df()
    sql_time = time.time() - started
    types = dict(zip([d[0] for d in con.execute(f"describe {sql}").fetchall()],
                     [d[1] for d in con.execute(f"describe {sql}").fetchall()]))
    detail = f"spark {spark_time:.1f}s sql {sql_time:.1f}s rows {len(got)}/{len(want)}"
    if sorted(got.columns) != sorted(want.columns):
        return f"{detail} COLUMNS {sorted(got.columns)} {sorted(want.columns)}", False
    names = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
    for column, kind in result.dtypes:
        if names.get(kind) != types[column]:
            detail += f" TYPE {column} {kind}/{types[column]}"
    a, b = as_rows(got), as_rows(want)
    if a != b:
        wrong = [(x, y) for x, y in zip(a, b) if x != y][:3]
        return f"{detail} VALUES {str(wrong)[:600]}", False
    return detail, "TYPE" not in detail


def connect(folder):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    return con


if __name__ == "__main__":
    import __spark_entry__ as entry

    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session("oracle-check", os.environ.get("SPARK_MASTER", "local[8]"), **{"spark.sql.shuffle.partitions": 8, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = connect(folder), []
    queries, oracle = entry.queries(), entry.oracle_sql()
    for name in sys.argv[1:] or queries:
        try:
            detail, ok = compare(spark, con, folder, name, queries[name], oracle.get(name))
        except Exception as problem:  # keep going, report at the end
            detail, ok = f"{type(problem).__name__}: {str(problem)[:700]}", False
        print("ok  " if ok else "FAIL", name, detail, flush=True)
        if not ok:
            failed.append(name)
    print("failed:", failed, "sql without query:", set(oracle) - set(queries))
