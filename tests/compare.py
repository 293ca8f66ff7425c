"""A query beside its SQL: the same columns, and the same rows in any order."""

from __future__ import annotations

import os

import duckdb
import pandas as pd


def tables(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for f in sorted(os.listdir(sf_dir)):
        p = f"{sf_dir}/{f}"
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return c


def canonical(df: pd.DataFrame) -> list[tuple]:
    rows = [tuple(None if x is None or x is pd.NA or x != x else round(float(x), 6) if isinstance(x, float) else x.item() if hasattr(x, "item") else x for x in r) for r in df[sorted(df.columns)].itertuples(index=False)]
    return sorted(rows, key=repr)


def same(got: pd.DataFrame, want: pd.DataFrame) -> None:
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    a, b = canonical(got), canonical(want)
    wrong = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    assert not wrong, f"{len(wrong)} rows differ, first {wrong[0]}"
