"""Every registered query of the network engine against its SQL twin, on the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from conftest import DATA

from netloom.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events".split()
SF = DATA / "sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def frame(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith(("float", "Float")):
            df[c] = df[c].astype(float).round(5) + 0.0
        elif "date" in str(df[c].dtype) or str(df[c].dtype) == "object":
            df[c] = df[c].map(str).str.slice(0, 10)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_twin(spark, duck, name):
    ours, theirs = frame(catalog.queries()[name](spark, str(SF)).toPandas()), frame(duck.execute(catalog.oracle_sql()[name]).df())
    assert len(ours) == len(theirs) > 0
    pd.testing.assert_frame_equal(ours, theirs, check_dtype=False, atol=2e-5)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_rows(spark, name):
    assert catalog.queries()[name](spark, str(SF)).count() > 0


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_rows_are_evaluated(spark, name):
    """Every column of every row is computed; no number is infinite, and none is missing but those of actors with themselves."""
    df = catalog.queries()[name](spark, str(SF)).toPandas()
    numbers = df.select_dtypes("number")
    if {"i", "j", "y"} <= set(df.columns):
        numbers = numbers[df["i"] != df["j"]]
    assert len(numbers) > 0 and bool((numbers.notna() & (numbers.abs() < float("inf"))).all().all())


@pytest.mark.parametrize(("which", "component"), [("a", 1), ("b", 2)])
def test_role_trajectory(spark, which, component):
    """Each time's scores are a unit singular vector of its mean operator."""
    op = catalog.fx.op(spark).toPandas()
    out = catalog.posterior.role_trajectory(catalog.fx.op(spark), which, component).toPandas()
    for t, rows in op.groupby("t"):
        m = rows.pivot_table(index="i", columns="k", values=which, aggfunc="mean").to_numpy()
        x = out[out["t"] == t].sort_values("id")["score"].to_numpy()
        s = np.linalg.svd(m, compute_uv=False)[component - 1]
        assert np.allclose((m @ m.T if which == "a" else m.T @ m) @ x, s**2 * x) and np.isclose(x @ x, 1) and x[np.abs(x).argmax()] > 0
