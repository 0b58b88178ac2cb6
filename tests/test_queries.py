"""Every registered query with SQL equals it on the smallest tables."""

import glob
import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from lexora import registry

DATA = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(column):
    """Numbers as floats, all else as texts; null as NaN or an empty text with a mark."""
    if pd.api.types.is_numeric_dtype(column) or pd.api.types.is_bool_dtype(column):
        return column.astype(float)
    kept = column.dropna()
    if len(kept) and kept.map(lambda v: isinstance(v, (int, float)) or type(v).__name__ == "Decimal").all():
        return pd.to_numeric(column.map(lambda v: None if v is None else float(v)))
    return column.map(lambda v: "\0null" if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)) else str(v.tolist() if hasattr(v, "tolist") else v))


def rows(df):
    """Columns by name, rows in order of all of them, floats rounded for the order alone."""
    out = pd.DataFrame({c: plain(df[c]) for c in sorted(df.columns)})
    order = out.assign(**{c: out[c].round(5) for c in out if out[c].dtype == float})
    texts = [c for c in out if out[c].dtype != float]
    return out.loc[order.sort_values([*texts, *[c for c in out if c not in texts]]).index].reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, con, name):
    a, b = rows(registry.queries()[name](spark, DATA).toPandas()), rows(con.sql(SQL[name]).df())
    assert list(a) == list(b) and len(a) == len(b)
    for c in a if len(a) else ():
        if a[c].dtype == float:
            assert np.allclose(a[c], b[c].astype(float), rtol=1e-9, atol=2e-6, equal_nan=True), c
        else:
            assert (a[c] == b[c]).all(), c


def test_names():
    assert set(SQL) <= set(registry.queries()) and len(registry.queries()) > 150
