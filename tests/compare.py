"""A Spark result against a DuckDB statement on the same Parquet tables, without regard to row order."""

import glob
import os

import duckdb


def _plain(v):
    if v is None or v != v:
        return None
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, list | tuple):
        return str([_plain(x) for x in v])
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return float(v) if isinstance(v, int) and not isinstance(v, bool) and abs(v) < 2**53 else v


def rows_of(frame):
    columns = sorted(frame.columns)
    return columns, sorted((tuple(_plain(v) for v in r) for r in frame[columns].itertuples(index=False)), key=repr)


def duck(sf_dir, sql):
    db = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        db.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return db.execute(sql).df()
