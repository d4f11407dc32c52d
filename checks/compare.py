"""Run registered queries beside their SQL twins: ``python -m checks.compare [folder] [name…]``."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import pandas as pd

from checks.catalog import QUERIES
from checks.oracles import ORACLES
from gaugework.session import local_session


def database(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def canonical(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)].astype(object)
    frame = frame.where(frame.notna(), None)
    for name in frame.columns:
        frame[name] = [
            None if value is None else (f"{value:.10g}" if isinstance(value, float) else str(value))
            for value in frame[name]
        ]
    return frame.sort_values(list(frame.columns), na_position="first").reset_index(drop=True)


def difference(spark_rows: pd.DataFrame, sql_rows: pd.DataFrame) -> str | None:
    if sorted(spark_rows.columns) != sorted(sql_rows.columns):
        return f"columns {sorted(spark_rows.columns)} / {sorted(sql_rows.columns)}"
    if len(spark_rows) != len(sql_rows):
        return f"rows {len(spark_rows)} / {len(sql_rows)}"
    a, b = canonical(spark_rows), canonical(sql_rows)
    differing = ((a != b) & ~(a.isna() & b.isna())).any(axis=1)
    if differing.any():
        at = differing.idxmax()
        return f"{differing.sum()} rows differ, first {a.loc[at].to_dict()} / {b.loc[at].to_dict()}"
    return None


def main() -> None:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    names = sys.argv[2:] or list(QUERIES)
    spark, con = local_session(8), database(folder)
    bad = 0
    for name in names:
        started = time.time()
        try:
            rows = QUERIES[name](spark, folder).toPandas()
            took = time.time() - started
            problem = difference(rows, con.execute(ORACLES[name]).df())
        except Exception as error:  # report and go on with the next query
            problem, took, rows = f"{type(error).__name__}: {str(error)[:1500]}", 0.0, []
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name} {len(rows)} rows {took:.2f}s {problem or ''}", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")


if __name__ == "__main__":
    main()
