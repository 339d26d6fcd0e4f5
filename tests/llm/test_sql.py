"""Queries of the operators against their SQL twins, on the smallest tables and on rows with nulls, ties and repeats."""

import duckdb
import pandas as pd
import pytest
from conftest import DATA

from netloom.llm import queries


def same(spark, name, folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet{'/*.parquet' if (folder / 'documents.parquet').is_dir() else ''}'")
    ours, theirs = queries.QUERIES[name](spark, str(folder)).toPandas(), con.execute(queries.ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns) and len(ours) == len(theirs)
    plain = lambda df: df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None).map(lambda v: round(v, 6) if isinstance(v, float) and v != int(v) else int(v) if isinstance(v, float) else v).map(str)
    a, b = (plain(df).sort_values(sorted(df.columns)).reset_index(drop=True) for df in (ours, theirs))
    pd.testing.assert_frame_equal(a, b)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_twin(spark, name):
    same(spark, name, DATA / "sf0.001")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_twin_on_odd_rows(spark, name, tmp_path):
    long = " ".join(f"w{n % 53}" for n in range(300))
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (2, None, None), (3, "", "y"), (None, "É A\tb", "x"), (4, long, "y"), (5, long + " end", None), (6, long.upper(), "y"), (7, " \n", "z"), (8, "one", "z")]
    rows += [(10 + n, f"text {n % 7} of some words", "bcd"[n % 3]) for n in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    same(spark, name, tmp_path)
