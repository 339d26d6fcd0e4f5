"""Network statistics of slices; keys name the slices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def density(net: DataFrame, keys: Sequence[str] = ("rel", "t"), value: str = "y") -> DataFrame:
    """Mean off the diagonal."""
    return net.where("i <> j").groupBy(*keys).agg(F.avg(value).alias("density"))


def out_degree(net: DataFrame, keys: Sequence[str] = ("rel", "t"), value: str = "y") -> DataFrame:
    return net.groupBy(*keys, "i").agg(F.sum(value).alias("out_degree"))


def in_degree(net: DataFrame, keys: Sequence[str] = ("rel", "t"), value: str = "y") -> DataFrame:
    return net.groupBy(*keys, "j").agg(F.sum(value).alias("in_degree"))


def reciprocity(net: DataFrame, keys: Sequence[str] = ("rel", "t"), value: str = "y") -> DataFrame:
    """Correlation of y_ij and y_ji over i < j, by moments; 0 where one side is constant."""
    a = net.where("i < j").select(*keys, "i", "j", F.col(value).alias("x"))
    b = net.where("i > j").select(*keys, F.col("j").alias("i"), F.col("i").alias("j"), F.col(value).alias("y_"))
    x, y = F.col("x"), F.col("y_")
    r = (F.avg(x * y) - F.avg(x) * F.avg(y)) / F.nullif(F.sqrt(F.var_pop(x) * F.var_pop(y)), F.lit(0.0))
    return a.join(b, [*keys, "i", "j"]).groupBy(*keys).agg(F.coalesce(r, F.lit(0.0)).alias("reciprocity"))


def transitivity(net: DataFrame, keys: Sequence[str] = ("rel", "t"), value: str = "y") -> DataFrame:
    """(tr(X^3) / 6) / sum d (d - 1) / 2 of the binarised slice, d its row sums; 0 without triples."""
    x = net.where(F.col(value) > 0).select(*keys, "i", "j")
    d = x.groupBy(*keys, "i").agg(F.count("*").alias("d")).groupBy(*keys).agg((F.sum(F.col("d") * (F.col("d") - 1)) / 2.0).alias("triples"))
    two = x.join(x.select(*keys, F.col("i").alias("j"), F.col("j").alias("k")), [*keys, "j"]).groupBy(*keys, "i", "k").agg(F.count("*").alias("n"))
    closed = two.join(x.select(*keys, F.col("i").alias("k"), F.col("j").alias("i")), [*keys, "k", "i"]).groupBy(*keys).agg((F.sum("n") / 6.0).alias("closed"))
    slices = net.select(*keys).distinct()
    return slices.join(d, list(keys), "left").join(closed, list(keys), "left").select(*keys, F.coalesce(F.col("closed") / F.nullif(F.col("triples"), F.lit(0.0)), F.lit(0.0)).alias("transitivity"))


def summary(net: DataFrame, keys: Sequence[str] = ("rel", "t"), value: str = "y") -> DataFrame:
    return density(net, keys, value).join(reciprocity(net, keys, value), list(keys)).join(transitivity(net, keys, value), list(keys))
