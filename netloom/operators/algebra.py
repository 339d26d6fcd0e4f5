"""Tensor algebra as joins and sums; matrices are (i, k, v) rows, tensors (i, j, rel, t, y). Absent rows are zeros."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matmul(left: DataFrame, right: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(i, k, v) times (i, k, v), for each of the keys."""
    a = left.select(*keys, "i", F.col("k").alias("m"), F.col("v").alias("a"))
    b = right.select(*keys, F.col("i").alias("m"), "k", F.col("v").alias("b"))
    return a.join(b, [*keys, "m"]).groupBy(*keys, "i", "k").agg(F.sum(F.col("a") * F.col("b")).alias("v"))


def transpose(matrix: DataFrame) -> DataFrame:
    return matrix.select(*[F.col({"i": "k", "k": "i"}.get(c, c)).alias(c) for c in matrix.columns])


def mode_product(tensor: DataFrame, matrix: DataFrame, mode: str, value: str = "y", keys: Sequence[str] = ()) -> DataFrame:
    """Product of a tensor with a matrix (i, k, v) along the column `mode`; keys are matched on both sides."""
    m = matrix.select(*keys, F.col("i").alias("__to"), F.col("k").alias(mode), F.col("v").alias("__v"))
    rest = [c for c in tensor.columns if c not in (mode, value)]
    out = tensor.join(m, [*keys, mode]).groupBy(*rest, "__to").agg(F.sum(F.col(value) * F.col("__v")).alias(value))
    return out.withColumnRenamed("__to", mode).select(*tensor.columns)


def bilinear(tensor: DataFrame, a: DataFrame, b: DataFrame, value: str = "y", keys: Sequence[str] = ()) -> DataFrame:
    """A T B' for each slice: two mode products, the first along the senders."""
    return mode_product(mode_product(tensor, a, "i", value, keys), b, "j", value, keys)


def unfold(tensor: DataFrame, mode: str, sizes: dict[str, int]) -> DataFrame:
    """Mode unfolding (row, col, y) of 1-based integer indices; columns run through the other modes, the first fastest."""
    col, step = F.lit(1).cast("long"), 1
    for name, size in sizes.items():
        if name != mode:
            if size < 1:
                raise ValueError(f"mode {name} has no entries")
            col, step = col + (F.col(name) - 1) * step, step * size
    return tensor.select(F.col(mode).alias("row"), col.alias("col"), "y")


def kronecker(left: DataFrame, right: DataFrame, rows: int, cols: int) -> DataFrame:
    """left (x) right, 1-based; rows and cols are those of right. Every pair of entries is part of the result."""
    b = right.select(F.col("i").alias("p"), F.col("k").alias("q"), F.col("v").alias("w"))
    return left.join(b).select(((F.col("i") - 1) * rows + F.col("p")).alias("i"), ((F.col("k") - 1) * cols + F.col("q")).alias("k"), (F.col("v") * F.col("w")).alias("v"))


def quadratic(a: DataFrame, b: DataFrame) -> DataFrame:
    """A' B A."""
    return matmul(matmul(transpose(a), b), a)


def drop_diagonal(matrix: DataFrame, other: str = "k") -> DataFrame:
    return matrix.where(F.col("i") != F.col(other))


def diagonal(ids: DataFrame, value: Column) -> DataFrame:
    """ids has one column, i."""
    return ids.select("i", F.col("i").alias("k"), value.alias("v"))


def lowrank(u: DataFrame, alpha: DataFrame) -> DataFrame:
    """A_t = sum_r alpha_rt u_r u_r' from u (i, r, u) and alpha (r, t, a)."""
    left, right = u.select("i", "r", F.col("u").alias("x")), u.select(F.col("i").alias("k"), "r", F.col("u").alias("y"))
    return left.join(right, "r").join(alpha, "r").groupBy("t", "i", "k").agg(F.sum(F.col("a") * F.col("x") * F.col("y")).alias("v"))


def lag_pair(tensor: DataFrame, value: str = "y", keys: Sequence[str] = ("rel",)) -> DataFrame:
    """Each cell with its value one step before; the first time drops out."""
    before = tensor.select(*keys, "i", "j", (F.col("t") + 1).alias("t"), F.col(value).alias("before"))
    return tensor.join(before, [*keys, "i", "j", "t"])


def log_sum_exp(table: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Stable log of summed exponentials by key."""
    top = table.groupBy(*keys).agg(F.max(value).alias("__top"))
    return table.join(top, list(keys)).groupBy(*keys, "__top").agg(F.sum(F.exp(F.col(value) - F.col("__top"))).alias("__s")).select(*keys, (F.col("__top") + F.log("__s")).alias("lse"))
