"""Sufficient statistics: sums, counts, Grams and transitions, all with partial aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rng import gamma
from .algebra import bilinear, lag_pair


def baseline(tensor: DataFrame, value: str = "z") -> DataFrame:
    """Mean over time of each cell."""
    return tensor.groupBy("i", "j", "rel").agg(F.avg(value).alias("mu"))


def baseline_posterior(tensor: DataFrame, g2: float, value: str = "z") -> DataFrame:
    """Mean sum / (n + 1 / g2) and variance of each cell's baseline; cells without data keep the prior."""
    n = F.count(value)
    return tensor.groupBy("i", "j", "rel").agg(n.alias("n"), (F.coalesce(F.sum(value), F.lit(0.0)) / (n + 1 / g2)).alias("mean"), (1.0 / (n + 1 / g2)).alias("var"))


def residual_squares(tensor: DataFrame, base: DataFrame, value: str = "z", state: str | None = None) -> DataFrame:
    """Sum of squares of value - (state + mu) over finite cells, and their number."""
    r = F.col(value) - F.col("mu") - (F.coalesce(F.col(state), F.lit(0.0)) if state else F.lit(0.0))
    return tensor.join(base, ["i", "j", "rel"]).agg(F.sum(r * r).alias("rss"), F.count(r).alias("n"))


def identity_deviation(op: DataFrame, keys: Sequence[str] = (), value: str = "v") -> DataFrame:
    """Squared distance of each matrix from the identity."""
    d = F.col(value) - (F.col("i") == F.col("k")).cast("double")
    return op.groupBy(*keys).agg(F.sum(d * d).alias("ss")) if keys else op.agg(F.sum(d * d).alias("ss"))


def innovation_squares(op: DataFrame, rho: float = 1.0, value: str = "v", keys: Sequence[str] = ()) -> DataFrame:
    """Sum of (x_t - rho x_(t-1))^2; with rho below 1 the process returns to the identity."""
    w = Window.partitionBy(*keys, "i", "k").orderBy("t")
    eye = (F.col("i") == F.col("k")).cast("double") * (1 - rho)
    e = F.col(value) - rho * F.lag(value).over(w) - eye
    return op.select(e.alias("e")).agg(F.sum(F.col("e") * F.col("e")).alias("ss"))


def bilinear_squares(theta: DataFrame, a: DataFrame, b: DataFrame, value: str = "y", keys: Sequence[str] = ("t",)) -> DataFrame:
    """Sum over relations and t >= 2 of |theta_t - A_t theta_(t-1) B_t'|^2."""
    before = theta.withColumn("t", F.col("t") + 1)
    told = bilinear(before, a, b, value, keys).withColumnRenamed(value, "told")
    e = F.col(value) - F.col("told")
    return theta.join(told, [c for c in theta.columns if c != value]).agg(F.sum(e * e).alias("rss"), F.count("*").alias("n"))


def inverse_gamma(shape: Column, rate: Column, seed: str, *keys: str | Column) -> Column:
    """rate / Gamma(shape), clamped to [1e-8, 1e8]."""
    return F.least(F.greatest(rate / gamma(shape, seed, *keys), F.lit(1e-8)), F.lit(1e8))


def transitions(states: DataFrame, regimes: int, keys: Sequence[str] = ("draw",)) -> DataFrame:
    """Counts of regime pairs (from, to) at successive times, zeros included."""
    spark = states.sparkSession
    grid = spark.range(1, regimes + 1).select(F.col("id").cast("int").alias("from")).join(spark.range(1, regimes + 1).select(F.col("id").cast("int").alias("to")))
    w = Window.partitionBy(*keys).orderBy("t")
    pairs = states.withColumn("from", F.lag("regime").over(w)).where(F.col("from").isNotNull()).groupBy("from", F.col("regime").alias("to")).agg(F.count("*").alias("n"))
    return grid.join(pairs, ["from", "to"], "left").select("from", "to", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def gram(theta: DataFrame, keys: Sequence[str] = ("t",), along: str = "j", value: str = "y") -> DataFrame:
    """X X' of each slice, summed over relations: the shared design of all rows in the operator updates."""
    other = "i" if along == "j" else "j"
    left = theta.select(*keys, "rel", along, F.col(other).alias("p"), F.col(value).alias("x"))
    right = theta.select(*keys, "rel", along, F.col(other).alias("q"), F.col(value).alias("y_"))
    return left.join(right, [*keys, "rel", along]).groupBy(*keys, "p", "q").agg(F.sum(F.col("x") * F.col("y_")).alias("g"))


def autocorrelation(traces: DataFrame, lag: int = 1) -> DataFrame:
    """Lag autocorrelation of each parameter's trace, by moments; 0 for a constant one."""
    w = Window.partitionBy("parameter").orderBy("draw")
    pair = traces.select("parameter", F.col("value").alias("x"), F.lag("value", lag).over(w).alias("y")).where(F.col("y").isNotNull())
    m = lambda e: F.avg(e)
    x, y = F.col("x"), F.col("y")
    return pair.groupBy("parameter").agg(F.coalesce((m(x * y) - m(x) * m(y)) / F.nullif(F.sqrt(F.var_pop(x) * F.var_pop(y)), F.lit(0.0)), F.lit(0.0)).alias("acf"))


def lag_cells(tensor: DataFrame, value: str = "y") -> DataFrame:
    return lag_pair(tensor, value)


def response_vector(theta: DataFrame, base: DataFrame, relations: int, actors: int) -> DataFrame:
    """(place, y): states (i, j, rel, t, y) from the second time on less their baseline (i, j, rel, mu), by place in the stacked columns of all matrices."""
    matrix = (F.col("t") - 2) * relations + F.col("rel") - 1
    place = (matrix * actors + F.col("j") - 1) * actors + F.col("i")
    return theta.where("t > 1").join(base, ["i", "j", "rel"]).select(place.alias("place"), (F.col("y") - F.col("mu")).alias("y"))
