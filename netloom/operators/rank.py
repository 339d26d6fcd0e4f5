"""Rank transforms, level bounds and discretisation of ordinal tensors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normal import qnorm
from ..functions.rng import normal, uniform


def rank_table(tensor: DataFrame, keys: Sequence[str] = ("rel",)) -> DataFrame:
    """Average rank of each level, from counts of levels: no window over cells, so no partition holds a whole relation."""
    levels = tensor.where(F.col("y").isNotNull()).groupBy(*keys, "y").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys).orderBy("y")
    upto = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return levels.select(*keys, "y", "n", (upto - (F.col("n") - 1) / F.lit(2.0)).alias("rank"), F.sum("n").over(Window.partitionBy(*keys)).alias("total"))


def zscores(tensor: DataFrame, keys: Sequence[str] = ("rel",)) -> DataFrame:
    """Normal scores qnorm(rank / (n + 1)) with average ties; NULL stays NULL."""
    table = rank_table(tensor, keys).select(*keys, "y", qnorm(F.col("rank") / (F.col("total") + 1)).alias("z"))
    return tensor.join(table, [*keys, "y"], "left")


def standardised(tensor: DataFrame, keys: Sequence[str] = ("rel",)) -> DataFrame:
    """(y - mean) / sd by relation, the diagonal NULL."""
    moments = tensor.groupBy(*keys).agg(F.avg("y").alias("mean"), F.stddev_samp("y").alias("sd"))
    z = F.when(F.col("i") != F.col("j"), (F.col("y") - F.col("mean")) / F.nullif(F.col("sd"), F.lit(0.0)))
    return tensor.join(moments, list(keys)).withColumn("z", z).drop("mean", "sd")


def discretise(tensor: DataFrame, levels: int = 5) -> DataFrame:
    """Ordinal levels 1..levels by quantile cuts of each relation: 1 + the number of cuts below the value."""
    shares = [k / levels for k in range(1, levels)]
    cuts = tensor.groupBy("rel").agg(F.percentile("y", F.array(*[F.lit(s) for s in shares])).alias("cuts"))
    level = F.when(F.col("y").isNotNull(), 1 + F.size(F.filter("cuts", lambda c: c < F.col("y"))))
    return tensor.join(cuts, "rel").withColumn("y", level.cast("double")).drop("cuts")


def level_index(tensor: DataFrame, keys: Sequence[str] = ("rel",)) -> DataFrame:
    """Cells of each level; NULL is a level of its own."""
    return tensor.groupBy(*keys, "y").agg(F.count("*").alias("n"))


def level_bounds(tensor: DataFrame, keys: Sequence[str] = ("rel",), value: str = "z") -> DataFrame:
    """For each level, the latent maximum of the level present below and minimum of the one above."""
    ends = tensor.where(F.col("y").isNotNull()).groupBy(*keys, "y").agg(F.max(value).alias("top"), F.min(value).alias("low"))
    w = Window.partitionBy(*keys).orderBy("y")
    return ends.select(*keys, "y", F.lag("top").over(w).alias("lower_bound"), F.lead("low").over(w).alias("upper_bound"))


def many_levels(tensor: DataFrame, limit: int = 10) -> DataFrame:
    """Whether a relation's levels ask for the Gaussian approximation."""
    return tensor.groupBy("rel").agg(F.count_distinct("y").alias("levels")).withColumn("approximate", (F.col("levels") > limit).cast("int"))


def approximate_latent(tensor: DataFrame, ez: str = "ez", sigma: float = 1.0, seed: str = "approx", keys: Sequence[str] = ("rel", "t")) -> DataFrame:
    """Draws N(ez + 0.1 (scaled level - 0.5), sigma); NULL cells draw around ez."""
    span = tensor.groupBy(*keys).agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
    scaled = F.coalesce((F.col("y") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)), F.lit(0.5))
    return tensor.join(span, list(keys)).withColumn("z", F.col(ez) + 0.1 * (scaled - 0.5) + sigma * normal(seed, "i", "j", "rel", "t")).drop("lo", "hi")


def truncated_normal(mean, sd, lower, upper, seed: str, *keys: str):
    """Inverse-CDF draw from N(mean, sd) on (lower, upper); NULL bounds are open."""
    from ..functions.normal import pnorm

    a = F.when(lower.isNull(), F.lit(0.0)).otherwise(pnorm((lower - mean) / sd))
    b = F.when(upper.isNull(), F.lit(1.0)).otherwise(pnorm((upper - mean) / sd))
    return mean + sd * qnorm(a + uniform(seed, *keys) * (b - a))
