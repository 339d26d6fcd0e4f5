"""Families, posterior predictive draws and forecasts, with counter-based noise."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normal import pnorm
from ..functions.rng import normal, uniform
from .algebra import bilinear

CELL = ("draw", "i", "j", "rel", "t")


@dataclass(frozen=True)
class Family:
    """Mean and generator of observations from a latent value, as Column expressions."""

    name: str
    mean: Callable[..., Column]
    draw: Callable[..., Column]


def category(z: Column, cuts: Column, u: Column) -> Column:
    """1 + the number of cumulative probabilities pnorm(cut - z) below u."""
    return 1 + F.size(F.filter(cuts, lambda c: pnorm(c - z) < u))


def expected_category(z: Column, cuts: Column) -> Column:
    """Sum of k P(k): 1 + the sum of the probabilities to be above each cut."""
    return 1.0 + F.aggregate(cuts, F.lit(0.0), lambda s, c: s + 1.0 - pnorm(c - z))


ORDINAL = Family("ordinal", expected_category, lambda z, cuts, seed, *k: category(z, cuts, uniform(seed, *k)).cast("double"))
GAUSSIAN = Family("gaussian", lambda z: z, lambda z, sd, seed, *k: z + sd * normal(seed, *k))
BINARY = Family("binary", lambda z: pnorm(z), lambda z, seed, *k: (uniform(seed, *k) < pnorm(z)).cast("double"))
FAMILIES = {f.name: f for f in (ORDINAL, GAUSSIAN, BINARY)}


def posterior_predict(theta: DataFrame, family: str, *, cuts: DataFrame | None = None, sd: Column | None = None, seed: str = "ppd") -> DataFrame:
    """Replicated tensors (draw, i, j, rel, t, y) from latent draws theta; cuts is (rel, cuts array) for ordinal data."""
    if family not in FAMILIES:
        raise ValueError("family should be one of ordinal, gaussian, binary")
    z = F.col("theta")
    if family == "ordinal":
        rows = theta.join(F.broadcast(cuts), "rel")
        y = ORDINAL.draw(z, F.col("cuts"), seed, *CELL)
    elif family == "gaussian":
        rows, y = theta, GAUSSIAN.draw(z, sd if sd is not None else F.lit(1.0), seed, *CELL)
    else:
        rows, y = theta, BINARY.draw(z, seed, *CELL)
    return rows.select(*CELL, y.alias("y"))


def cuts_of(tensor: DataFrame, levels: int = 5) -> DataFrame:
    """Latent cuts of each relation at equal shares of its values."""
    shares = F.array(*[F.lit(k / levels) for k in range(1, levels)])
    return tensor.groupBy("rel").agg(F.percentile("y", shares).alias("cuts"))


def forecast(op: DataFrame, start: DataFrame, horizon: int, sd: float | DataFrame, seed: str = "forecast") -> DataFrame:
    """Theta_h = A Theta_(h-1) B' + sd noise for h = 1..horizon, each draw with its own operators (draw, i, k, a, b); sd is one for all draws or a table (draw, sd)."""
    a, b = op.select("draw", "i", "k", F.col("a").alias("v")), op.select("draw", "i", "k", F.col("b").alias("v"))
    now, steps = start.select("draw", "i", "j", "y"), []
    for h in range(1, horizon + 1):
        now = bilinear(now, a, b, "y", ["draw"])
        now = now.join(sd, "draw") if isinstance(sd, DataFrame) else now.withColumn("sd", F.lit(sd))
        now = now.select("draw", "i", "j", (F.col("y") + F.col("sd") * normal(seed, "draw", "i", "j", F.lit(h))).alias("y"))
        steps.append(now.select("draw", F.lit(h).alias("h"), "i", "j", "y"))
    return reduce(DataFrame.unionByName, steps)


def regime_path(trans: DataFrame, horizon: int, start: int = 1, seed: str = "regime") -> DataFrame:
    """Regimes of horizon steps for each draw, by inverse CDF over trans (draw, from, to, p)."""
    rows = trans.groupBy("draw").agg(F.array_sort(F.collect_list(F.struct("from", "to", "p"))).alias("rows"))
    state = F.lit(start)
    path = []
    for h in range(1, horizon + 1):
        u = uniform(seed, "draw", F.lit(h))
        own = F.filter("rows", (lambda s: lambda r: r["from"] == s)(state))
        upto = F.aggregate(own, F.struct(F.lit(0.0).cast("double").alias("sum"), F.lit(0).alias("n")), (lambda u: lambda a, r: F.struct((a["sum"] + r["p"]).alias("sum"), (a["n"] + (a["sum"] + r["p"] < u).cast("int")).alias("n")))(u))
        state = F.least(F.size(own), upto["n"] + 1)
        path.append(F.struct(F.lit(h).alias("h"), state.alias("regime")))
    return rows.select("draw", F.explode(F.array(*path)).alias("x")).select("draw", "x.h", "x.regime")
