"""Queries over posterior draws: slices, summaries, dyads, snapshots, influence, regimes, traces, checks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .kernels import effective_size, filter_dlm


def quantiles(value: str, probs: Sequence[float]) -> list[Column]:
    return [F.percentile(value, F.lit(float(p))).alias(f"q{round(100 * p, 1):g}".replace(".", "_")) for p in probs]


def theta_slice(theta: DataFrame, **wanted: Sequence) -> DataFrame:
    """Rows whose draw, i, j, rel or t is among the given; unnamed keys are free."""
    for name, values in wanted.items():
        theta = theta.where(F.col(name).isin(list(values)))
    return theta


def theta_summary(theta: DataFrame, fun: Callable[[str], Column] = F.avg, keys: Sequence[str] = ("i", "j", "rel", "t"), value: str = "theta") -> DataFrame:
    return theta.groupBy(*keys).agg(fun(value).alias("value"))


def param_summary(pars: DataFrame, probs: Sequence[float] = (0.05, 0.5, 0.95)) -> DataFrame:
    return pars.groupBy("parameter").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), *quantiles("value", probs))


def derive_draws(table: DataFrame, fun: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A user's function applied to each draw's rows."""
    return table.groupBy("draw").applyInPandas(fun, schema)


def dyad_operator(op: DataFrame) -> DataFrame:
    """(A_t B_t')[i, j] for each draw and time."""
    a = op.select("draw", "t", "i", "k", "a")
    b = op.select("draw", "t", F.col("i").alias("j"), "k", "b")
    return a.join(b, ["draw", "t", "k"]).groupBy("draw", "t", "i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("value"))


def dyad_path(op: DataFrame, i: int, j: int, probs: Sequence[float] = (0.025, 0.975)) -> DataFrame:
    """Mean and quantiles of one dyad's value over draws; only row i of A and row j of B are read."""
    a = op.where(F.col("i") == i).select("draw", "t", "k", "a")
    b = op.where(F.col("i") == j).select("draw", "t", "k", "b")
    value = a.join(b, ["draw", "t", "k"]).groupBy("draw", "t").agg(F.sum(F.col("a") * F.col("b")).alias("value"))
    return value.groupBy("t").agg(F.avg("value").alias("mean"), *quantiles("value", probs))


def net_snapshot(op: DataFrame, t: int, level: float = 0.95, significant: bool = False, eps: float | None = None) -> DataFrame:
    """Posterior mean network at t; `significant` blanks dyads whose interval holds 0, eps drops small ones."""
    tail = (1 - level) / 2
    out = dyad_operator(op.where(F.col("t") == t)).groupBy("i", "j").agg(F.avg("value").alias("mean"), F.percentile("value", F.lit(tail)).alias("lo"), F.percentile("value", F.lit(1 - tail)).alias("hi"))
    mean = F.when((F.col("lo") > 0) | (F.col("hi") < 0), F.col("mean")) if significant else F.col("mean")
    out = out.select("i", "j", mean.alias("value"))
    return out.where(F.abs(F.col("value")) > eps) if eps is not None else out


def tidy_operators(op: DataFrame) -> DataFrame:
    return op.groupBy("t", "i", "k").agg(F.avg("a").alias("a"), F.avg("b").alias("b"))


def group_influence(op: DataFrame, groups: DataFrame, kind: str = "sender", measure: str = "rowsum", fun: str = "mean", probs: Sequence[float] = (0.025, 0.5, 0.975)) -> DataFrame:
    """Influence of groups (name, id) over time: senders are rows of A, targets columns of B."""
    if kind not in ("sender", "target") or measure not in ("rowsum", "rowmean", "l2") or fun not in ("mean", "sum"):
        raise ValueError("kind should be one of sender, target; measure of rowsum, rowmean, l2; fun of mean, sum")
    own, value = ("i", F.col("a")) if kind == "sender" else ("k", F.col("b"))
    each = {"rowsum": F.sum(value), "rowmean": F.avg(value), "l2": F.sqrt(F.sum(value * value))}[measure]
    actors = op.groupBy("draw", "t", F.col(own).alias("id")).agg(each.alias("x"))
    total = actors.join(groups, "id").groupBy("name", "draw", "t").agg((F.avg("x") if fun == "mean" else F.sum("x")).alias("value"))
    return total.groupBy("name", "t").agg(F.avg("value").alias("mean"), *quantiles("value", probs))


def regime_probs(states: DataFrame, regimes: int) -> DataFrame:
    """Share of draws in each regime at each time, zeros included."""
    n = states.groupBy("t").agg(F.count_distinct("draw").alias("draws"))
    grid = n.join(states.sparkSession.range(1, regimes + 1).select(F.col("id").cast("int").alias("regime")))
    hits = states.groupBy("t", "regime").agg(F.count("*").alias("n"))
    return grid.join(hits, ["t", "regime"], "left").select("t", "regime", (F.coalesce("n", F.lit(0)) / F.col("draws")).alias("prob"))


def running_mean(pars: DataFrame) -> DataFrame:
    w = Window.partitionBy("parameter").orderBy("draw").rowsBetween(Window.unboundedPreceding, 0)
    return pars.select("parameter", "draw", "value", F.avg("value").over(w).alias("running"))


def histogram(pars: DataFrame, bins: int = 10) -> DataFrame:
    """Counts of equal-width bins between each parameter's ends."""
    ends = pars.groupBy("parameter").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    bin_ = F.least(F.lit(bins), 1 + F.floor((F.col("value") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * bins)).cast("int")
    return pars.join(ends, "parameter").groupBy("parameter", bin_.alias("bin")).agg(F.count("*").alias("n"))


def geweke(pars: DataFrame, first: float = 0.1, last: float = 0.5) -> DataFrame:
    """Difference of the means of a trace's first and last shares, by their plain standard errors."""
    n = pars.groupBy("parameter").agg(F.max("draw").alias("n"))
    x = pars.join(n, "parameter")
    head, tail = F.when(F.col("draw") <= first * F.col("n"), F.col("value")), F.when(F.col("draw") > (1 - last) * F.col("n"), F.col("value"))
    se = F.sqrt(F.var_samp(head) / F.count(head) + F.var_samp(tail) / F.count(tail))
    return x.groupBy("parameter").agg(((F.avg(head) - F.avg(tail)) / F.nullif(se, F.lit(0.0))).alias("z"))


def compare_traces(parameter: str, **fits: DataFrame) -> DataFrame:
    """Traces of one parameter of several fits below each other."""
    if len(fits) < 2:
        raise ValueError("at least two fits are needed")
    parts = [pars.where(F.col("parameter") == parameter).select(F.lit(name).alias("fit"), "draw", "value") for name, pars in fits.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def significant_edges(op: DataFrame, alpha: float = 0.01) -> DataFrame:
    """Off-diagonal mean effects beyond the 1 - alpha quantile of their sizes."""
    e = op.where("i <> k").groupBy("i", "k").agg(F.avg("a").alias("effect"))
    cut = e.agg(F.percentile(F.abs(F.col("effect")), F.lit(1 - alpha)).alias("cut"))
    return e.join(F.broadcast(cut)).where(F.abs(F.col("effect")) > F.col("cut")).select("i", "k", "effect")


def ecdf(table: DataFrame, keys: Sequence[str] = ("rel",), value: str = "y") -> DataFrame:
    """Share of values up to each distinct value, from counts."""
    n = table.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys)
    upto = w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return n.select(*keys, value, (F.sum("n").over(upto) / F.sum("n").over(w)).alias("ecdf"))


def ppc_bars(observed: DataFrame, replicated: DataFrame) -> DataFrame:
    """Observed category counts beside mean and 5 and 95 % of the replicates', zeros included."""
    obs = observed.where("y is not null").groupBy("rel", "y").agg(F.count("*").alias("observed"))
    n = replicated.where("y is not null").groupBy("draw", "rel", "y").agg(F.count("*").alias("n"))
    grid = replicated.select("draw").distinct().join(obs)
    full = grid.join(n, ["draw", "rel", "y"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return full.groupBy("rel", "y").agg(F.max("observed").alias("observed"), F.avg("n").alias("mean"), F.percentile("n", F.lit(0.05)).alias("q5"), F.percentile("n", F.lit(0.95)).alias("q95"))


def nearest_time(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """The stored time nearest to each wanted t; ties go to the earlier."""
    s = stored.select(F.col("t").alias("stored"))
    return wanted.join(F.broadcast(s)).groupBy("t").agg(F.min_by("stored", F.abs(F.col("t") - F.col("stored")) * 1000 + F.col("stored")).alias("stored"))


def role_trajectory(op: DataFrame, which: str = "a", component: int = 1) -> DataFrame:
    """Rows (t, id, score): a singular vector of each time's mean operator (draw, t, i, k, a, b), left for a and right for b.

    Its sign is such that the coordinate of largest size is positive. A time's operator is one group: actors squared.
    """
    mean = op.groupBy("t", "i", "k").agg(F.avg(which).alias("v"))

    def scores(rows: pd.DataFrame) -> pd.DataFrame:
        m = rows.pivot(index="i", columns="k", values="v").fillna(0.0)
        u, _, vt = np.linalg.svd(m.to_numpy())
        x, names = (u[:, component - 1], m.index) if which == "a" else (vt[component - 1], m.columns)
        x = x * (1.0 if x[np.abs(x).argmax()] > 0 else -1.0)
        return pd.DataFrame({"t": rows["t"].iloc[0], "id": names.to_numpy(), "score": x})

    return mean.groupBy("t").applyInPandas(scores, "t int, id int, score double")


def split_rhat(draws: DataFrame, split: int) -> DataFrame:
    """Rows (parameter, rhat) of draws (draw, parameter, value): the two halves, up to draw `split` and after it, as chains of one length."""
    half = draws.groupBy("parameter", (F.col("draw") > split).alias("late")).agg(F.avg("value").alias("m"), F.var_samp("value").alias("v"), F.count("*").alias("n"))
    both = half.groupBy("parameter").agg(F.avg("v").alias("w"), F.var_samp("m").alias("b"), F.min("n").alias("n"))
    return both.select("parameter", F.sqrt((F.col("n") - 1) / F.col("n") + F.col("b") / F.col("w")).alias("rhat"))


def effective_sizes(draws: DataFrame) -> DataFrame:
    """Rows (parameter, ess) of draws (draw, parameter, value) of one chain, which is one group's size."""

    def size(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"parameter": rows["parameter"].iloc[:1], "ess": [effective_size(rows.sort_values("draw")["value"].to_numpy())]})

    return draws.groupBy("parameter").applyInPandas(size, "parameter string, ess double")


def dlm_states(series: DataFrame, variance: float, step: float, rho: float = 1.0, seed: int = 1) -> DataFrame:
    """One draw of the level of each series (id long, t, y): y = x + noise, x = rho x before + step; rows (id, t, x), each series by itself.

    Times without a value are left out, their step is one like any other; a series without values gives no rows.
    """

    def draw(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("t")
        rng = np.random.Generator(np.random.Philox(key=[seed, int(rows["id"].iloc[0]) & (2**63 - 1)]))
        one = np.eye(1)
        x = filter_dlm(rng, [np.array([v]) for v in rows["y"]], [one] * len(rows), variance * one, step * one, np.zeros(1), one, rho)
        return pd.DataFrame({"id": rows["id"], "t": rows["t"], "x": x[:, 0]})

    return series.where("y is not null").select("id", "t", "y").groupBy("id").applyInPandas(draw, "id long, t int, x double")
