"""Edge lists to tensors (i, j, rel, t, y): long rows, NULL for missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def to_tensor(edges: DataFrame, sender: str | Column, receiver: str | Column, value: Column, rel: str | Column | None = None, time: str | Column | None = None) -> DataFrame:
    """One row for each cell that edges name; value is an aggregate. A tensor without relations or times gets one of each."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    keys = [col(sender).alias("i"), col(receiver).alias("j"), (F.lit("1") if rel is None else col(rel)).alias("rel"), (F.lit(1) if time is None else col(time)).alias("t")]
    return edges.groupBy(*keys).agg(value.alias("y"))


def read_tensor(spark: SparkSession, path: str, source: str = "parquet", **options) -> DataFrame:
    """Any Spark source with columns i, j, y and perhaps rel and t; NaN becomes NULL."""
    df = spark.read.format(source).options(**options).load(path)
    missing = {"i", "j", "y"} - set(df.columns)
    if missing:
        raise ValueError(f"data must be a 3D array (i, j, t) or a 4D array (i, j, rel, t); missing columns {sorted(missing)}")
    rel = F.col("rel").cast("string") if "rel" in df.columns else F.lit("1")
    t = F.col("t").cast("int") if "t" in df.columns else F.lit(1)
    y = F.col("y").cast("double")
    return df.select(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), rel.alias("rel"), t.alias("t"), F.when(~F.isnan(y), y).alias("y"))


def dense(tensor: DataFrame, actors: DataFrame, fill: float | None = 0.0) -> DataFrame:
    """Every (i, j, rel, t): absent cells get `fill`, the diagonal NULL. actors has one column, id; dimension tables are small."""
    i, j = actors.select(F.col("id").alias("i")), actors.select(F.col("id").alias("j"))
    cells = tensor.select("rel").distinct().crossJoin(tensor.select("t").distinct()).crossJoin(i).crossJoin(j)
    y = F.when(F.col("i") != F.col("j"), F.coalesce("y", F.lit(fill)))
    return cells.join(tensor, ["i", "j", "rel", "t"], "left").select("i", "j", "rel", "t", y.alias("y"))


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity by supplier's nation, customer's nation, return flag and ship year."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    edges = read("lineitem").join(read("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    edges = edges.join(read("customer"), F.col("o_custkey") == F.col("c_custkey")).join(read("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return to_tensor(edges, "s_nationkey", "c_nationkey", F.sum("l_quantity"), "l_returnflag", F.year("l_shipdate"))


def network(spark: SparkSession, sf_dir: str) -> DataFrame:
    actors = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("id"))
    return dense(trade(spark, sf_dir), actors)


def edge_report(tensor: DataFrame) -> DataFrame:
    """Missing, infinite and constant flags, variance over finite cells, number of cells."""
    gone, endless = F.col("y").isNull() | F.isnan("y"), F.abs(F.col("y")) == float("inf")
    fine = F.when(~gone & ~endless, F.col("y"))
    return tensor.agg(F.count_if(gone).alias("n_missing"), F.count_if(F.coalesce(endless, F.lit(False))).alias("n_infinite"), (F.min(fine) == F.max(fine)).cast("int").alias("constant"), F.var_samp(fine).alias("variance"), F.count("*").alias("n_obs"))
