"""Impulse responses: shocks, constant and time-varying recursions, summaries over draws."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .algebra import bilinear


def shock(spark: SparkSession, m: int, kind: str = "unit_edge", i: int = 1, j: int = 2, magnitude: float = 1.0) -> DataFrame:
    """Rows (i, j, y) of an m x m shock: unit_edge, node_out, node_in or density."""
    if kind not in ("unit_edge", "node_out", "node_in", "density"):
        raise ValueError("kind should be one of unit_edge, node_out, node_in, density")
    if kind in ("unit_edge", "node_out") and not 1 <= i <= m or kind in ("unit_edge", "node_in") and not 1 <= j <= m:
        raise ValueError(f"index out of range 1..{m}")
    ids = spark.range(1, m + 1).select(F.col("id").cast("int").alias("i"))
    grid = ids.join(ids.withColumnRenamed("i", "j"))
    a, b = F.col("i") == i, F.col("j") == j
    hit = {"unit_edge": a & b, "node_out": a, "node_in": b, "density": F.col("i") != F.col("j")}[kind]
    size = magnitude / (m * (m - 1)) if kind == "density" else magnitude
    return grid.where(hit).select("i", "j", F.lit(float(size)).alias("y"))


def respond(op: DataFrame, start: DataFrame, horizon: int, t0: int | None = None) -> DataFrame:
    """Responses (draw, h, i, j, y), h = 0..horizon, of every draw; op is (draw, [t,] i, k, a, b).

    Without t0 the operators are constant; with t0 (zero-based) step h uses the operators of the 1-based time t0 + h + 1.
    The recursion starts from the sparse shock, and every draw runs apart.
    """
    now = op.select("draw").distinct().join(start)
    steps = [now.select("draw", F.lit(0).alias("h"), "i", "j", "y")]
    for h in range(1, horizon + 1):
        used = op if t0 is None else op.where(F.col("t") == t0 + h + 1)
        a, b = used.select("draw", "i", "k", F.col("a").alias("v")), used.select("draw", "i", "k", F.col("b").alias("v"))
        now = bilinear(now, a, b, "y", ["draw"])
        steps.append(now.select("draw", F.lit(h).alias("h"), "i", "j", "y"))
    return reduce(DataFrame.unionByName, steps)


def responses_of(response: DataFrame, m: int) -> DataFrame:
    """Density response: mean off the diagonal; absent cells are zeros."""
    return response.groupBy("draw", "h").agg((F.sum(F.when(F.col("i") != F.col("j"), F.col("y")).otherwise(0.0)) / (m * (m - 1))).alias("value"))


def statistic(response: DataFrame, base: DataFrame, stat: Callable[[DataFrame, list[str]], DataFrame], name: str) -> DataFrame:
    """stat(M + response) - stat(M) for each (draw, h); base is (i, j, mu)."""
    full = response.join(base, ["i", "j"]).select("draw", "h", "i", "j", (F.col("y") + F.col("mu")).alias("y"))
    calm = response.join(base, ["i", "j"]).select("draw", "h", "i", "j", F.col("mu").alias("y"))
    return stat(full, ["draw", "h"]).join(stat(calm, ["draw", "h"]).withColumnRenamed(name, "calm"), ["draw", "h"]).select("draw", "h", (F.col(name) - F.col("calm")).alias("value"))


def summarise(values: DataFrame) -> DataFrame:
    """Mean, median, sd and quantiles over draws by horizon."""
    q = lambda p: F.percentile("value", F.lit(p))
    return values.groupBy(F.col("h").alias("horizon")).agg(F.avg("value").alias("mean"), q(0.5).alias("median"), F.stddev_samp("value").alias("sd"), q(0.025).alias("q025"), q(0.975).alias("q975"), q(0.1).alias("q10"), q(0.9).alias("q90"))
