"""Bayesian fits: chains are groups, each runs in one Python worker and gives long rows of draws.

A tensor of one fit (m * m * p * T cells) is read into each chain's task; chains, and fits of many tensors by a group key,
run side by side. Draw tables: (chain, draw, part, name, t, i, k, value) with parts a, b, mu, theta, u, alpha, state, trans, par;
i and k count the actors of `actors(tensor)`, theta's name is the relation's number. A chain hands on its draws in blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from . import kernels as K
from . import posterior
from . import predict as forecasts

DRAWS = "chain int, draw int, part string, name string, t int, i int, k int, value double"
SCALARS = {"sigma2_proc": "s2", "sigma2_obs": "s2obs", "tau_A2": "ta", "tau_B2": "tb", "g2": "g2"}
MODELS, FAMILIES = ("static", "dynamic", "lowrank", "hmm"), ("ordinal", "gaussian", "binary")


class Chain:
    """State shared by the models: data y (p, T, m, m) with NaN for missing, latent z, baseline mu, state theta."""

    def __init__(self, y: np.ndarray, family: str, rng: np.random.Generator, init: dict | None = None):
        self.y, self.family, self.rng, self.init = y, family, rng, init or {}
        self.p, self.T, self.m, _ = y.shape
        self.seen, self.eye = np.isfinite(y), np.eye(self.m)
        self.z = np.where(self.seen, y, 0.0)
        if family == "ordinal":
            for r in range(self.p):
                v = y[r][self.seen[r]]
                sd = v.std(ddof=1) if len(v) > 1 else 1.0
                self.z[r] = np.where(self.seen[r], (y[r] - (v.mean() if len(v) else 0.0)) / (sd or 1.0), 0.0)
        self.mu = np.array(self.init.get("mu", self.z.mean(1)))
        if self.mu.shape != (self.p, self.m, self.m) or any(np.shape(self.init[x])[1:] != (self.m, self.m) for x in "ab" if x in self.init):
            raise ValueError("the previous fit has other actors or relations")
        self.theta = self.z - self.mu[:, None] + 0.1 * rng.standard_normal(self.z.shape)
        self.s2 = self.s2obs = self.ta = self.tb = self.g2 = 1.0
        self.a = np.repeat(self.eye[None], self.T, 0)
        self.b = self.a.copy()
        for name in ("s2", "s2obs", "ta", "tb", "g2", "a", "b"):
            if name in self.init and (name not in ("a", "b") or np.shape(self.init[name]) == self.a.shape):
                setattr(self, name, np.array(self.init[name]) if name in ("a", "b") else float(self.init[name]))

    def latent(self, ez: np.ndarray, by_slice: bool = False) -> None:
        if self.family == "gaussian":
            return
        if self.family == "binary":
            draw = K.truncated(self.rng, ez, np.where(self.y > 0, 0.0, -np.inf), np.where(self.y > 0, np.inf, 0.0))
            self.z = np.where(self.seen, draw, self.z)
            return
        free = ez + self.rng.standard_normal(ez.shape)
        cells = [(r, t) for r in range(self.p) for t in range(self.T)] if by_slice else [(r, slice(None)) for r in range(self.p)]
        for at in cells:
            y, z, e, seen = self.y[at], self.z[at], ez[at], self.seen[at]
            levels = np.unique(y[seen])
            z[~seen] = free[at][~seen]
            if len(levels) > 10:
                lo, hi = levels[0], levels[-1]
                z[seen] = (e + 0.1 * ((y - lo) / (hi - lo) - 0.5))[seen] + self.rng.standard_normal(int(seen.sum()))
                continue
            top, low = [z[seen & (y == v)].max() for v in levels], [z[seen & (y == v)].min() for v in levels]
            for n, v in enumerate(levels):
                own = seen & (y == v)
                lower, upper = top[n - 1] if n else -np.inf, low[n + 1] if n + 1 < len(levels) else np.inf
                if lower >= upper:
                    continue  # crossed bounds: these cells keep their values for this sweep
                z[own] = K.truncated(self.rng, e[own], np.full(int(own.sum()), lower), np.full(int(own.sum()), upper))
                top[n], low[n] = z[own].max(), z[own].min()

    def level(self) -> None:
        v = 1 / (self.T + 1 / self.g2)
        self.mu = v * (self.z - self.theta).sum(1) + np.sqrt(v) * self.rng.standard_normal(self.mu.shape)
        self.g2 = K.inverse_gamma(self.rng, (2 + self.mu.size) / 2, (2 + (self.mu**2).sum()) / 2)

    def states(self) -> None:
        dev = self.z - self.mu[:, None]
        self.theta = np.stack([K.simulate_states(self.rng, x, self.a, self.b, self.s2, self.s2obs) for x in dev])

    def noise(self) -> None:
        if self.family == "gaussian":
            e = (self.z - self.mu[:, None] - self.theta)[self.seen]
            self.s2obs = K.inverse_gamma(self.rng, (1 + e.size) / 2, 1 + (e**2).sum() / 2)

    def operators(self) -> list[tuple]:
        return [("a", self.a), ("b", self.b)]

    def latent_states(self) -> np.ndarray:
        """(p, T, m, m), or no relation where the model has no states."""
        return self.theta

    def scalars(self) -> dict[str, float]:
        return {"sigma2_proc": self.s2, "sigma2_obs": self.s2obs, "tau_A2": self.ta, "tau_B2": self.tb, "g2": self.g2}


class Static(Chain):
    def sweep(self) -> None:
        ez = np.repeat(self.mu[:, None], self.T, 1)
        self.latent(ez)
        g = sum(self.T * x.T @ x for x in self.mu)
        rhs = sum(z @ x.T for x, zs in zip(self.mu, self.z) for z in zs)
        low = K.factor(g / self.s2 + self.eye / self.ta)
        mean = np.linalg.solve(low.T, np.linalg.solve(low, (rhs / self.s2 + self.eye / self.ta).T)).T
        self.b1 = mean + np.linalg.solve(low.T, self.rng.standard_normal((self.m, self.m))).T
        self.ta = K.inverse_gamma(self.rng, (2 * self.m + self.p + 1) / 2, (((np.diag(self.b1) - 1) ** 2).sum() + 1) / 2)
        self.mu = self.z.mean(1)
        self.g2 = K.inverse_gamma(self.rng, (1 + self.mu.size) / 2, (1 + (self.mu**2).sum()) / 2)
        if self.family == "gaussian":
            e = self.z - self.mu[:, None]
            self.s2 = K.inverse_gamma(self.rng, 1 + e.size / 2, 1 + (e**2).sum() / 2)

    def operators(self) -> list[tuple]:
        return [("a", self.eye[None]), ("b", self.b1[None])]

    def latent_states(self) -> np.ndarray:
        return self.theta[:0]


class Dynamic(Chain):
    def __init__(self, *args, ar1: bool = False, update_rho: bool = False, **kw):
        super().__init__(*args, **kw)
        self.rho, self.ar1, self.update_rho = [0.0, 0.0], ar1, update_rho

    def sweep(self) -> None:
        self.latent(self.theta + self.mu[:, None], by_slice=True)
        self.level()
        self.states()
        self.a, self.b = K.operator_draws(self.rng, self.theta, self.a, self.b, self.s2, self.ta, self.tb, tuple(self.rho) if self.ar1 else None)
        n = self.m**2 * (self.T - 1)
        for x, name, at in ((self.a, "ta", 0), (self.b, "tb", 1)):
            d = x - self.eye
            e = d[1:] - self.rho[at] * d[:-1] if self.ar1 else d[1:]
            setattr(self, name, K.inverse_gamma(self.rng, (1 + n) / 2, (1 + (e**2).sum()) / 2))
            if self.ar1 and self.update_rho and (s := float((d[:-1] ** 2).sum())) > 0:
                mean, sd = float((d[1:] * d[:-1]).sum()) / s, np.sqrt(getattr(self, name) / s)
                self.rho[at] = mean + sd * float(K.truncated(self.rng, np.zeros(1), np.array([(-0.99 - mean) / sd]), np.array([(0.99 - mean) / sd]))[0])
        self.s2 = K.inverse_gamma(self.rng, (2 + n * self.p) / 2, 2 + K.bilinear_rss(self.theta, self.a, self.b) / 2)
        self.noise()

    def scalars(self) -> dict[str, float]:
        return super().scalars() | ({"rho_A": self.rho[0], "rho_B": self.rho[1]} if self.ar1 else {})


class LowRank(Chain):
    def __init__(self, *args, r: int = 2, ar1: bool = True, **kw):
        super().__init__(*args, **kw)
        self.u = np.linalg.svd(np.where(self.seen, self.y, 0.0).mean((0, 1)))[0][:, :r]
        self.r, self.rho, self.alpha, self.step, self.count, self.tries, self.wins = r, 0.9 if ar1 else 1.0, np.zeros((self.T, r)), 0.005, 0, 0, 0
        self.s2 = 0.5

    def assemble(self) -> None:
        self.a = np.einsum("ir,tr,jr->tij", self.u, self.alpha, self.u)

    def sweep(self) -> None:
        self.count += 1
        self.latent(self.theta + self.mu[:, None])
        self.level()
        self.states()
        self.alpha = K.factor_paths(self.rng, self.theta, self.u, self.b, self.s2, self.ta, self.rho)
        self.assemble()
        _, self.b = K.operator_draws(self.rng, self.theta, self.a, self.b, self.s2, 1.0, self.tb, None)
        self.assemble()
        e = self.alpha[1:] - self.rho * self.alpha[:-1]
        self.ta = K.inverse_gamma(self.rng, 10 + e.size / 2, 10 + (e**2).sum() / 2)
        d = self.b[1:] - self.eye
        self.tb = K.inverse_gamma(self.rng, 10 + d.size / 2, 10 + (d**2).sum() / 2)
        if self.count % max(5, self.m // 10) == 0:
            old, was = self.u, K.bilinear_rss(self.theta, self.a, self.b)
            self.u = K.cayley(old, K.skew(self.rng, self.m, np.sqrt(self.m)), self.step)
            self.assemble()
            self.tries += 1
            if np.log(self.rng.random()) < (was - K.bilinear_rss(self.theta, self.a, self.b)) / (2 * self.s2):
                self.wins += 1
            else:
                self.u = old
                self.assemble()
            if self.tries == 20:
                self.step = float(np.clip(self.step * (0.9 if self.wins < 4 else 1.1 if self.wins > 6 else 1.0), 1e-4, 0.1))
                self.tries = self.wins = 0
        self.s2 = K.inverse_gamma(self.rng, 10 + self.m**2 * self.p * (self.T - 1) / 2, 10 + K.bilinear_rss(self.theta, self.a, self.b) / 2)
        self.noise()

    def operators(self) -> list[tuple]:
        return [("a", self.a), ("b", self.b), ("u", self.u[None]), ("alpha", self.alpha[:, :, None])]


class Hmm(Chain):
    def __init__(self, *args, R: int = 3, **kw):
        super().__init__(*args, **kw)
        self.R, self.path = R, self.rng.integers(0, R, self.T)
        sd = float(np.nanstd(self.y)) if self.seen.any() else 1.0
        spread = min(0.1, sd / (5 * np.sqrt(self.m))) if sd > 0 else 0.1
        self.ar = np.stack([K.capped(self.eye + spread * self.rng.standard_normal((self.m, self.m)), 0.95) for _ in range(R)])
        self.br, self.pi0 = self.ar.copy(), np.full(R, 1 / R)
        self.trans = np.eye(R) * 0.8 + 0.2 / R
        self.s2 = max(0.01, sd * sd / 100)

    def sweep(self) -> None:
        self.a, self.b = self.ar[self.path], self.br[self.path]
        self.level()
        self.latent(self.theta + self.mu[:, None])
        self.states()
        beam = min(self.R, max(3, self.R // 2)) if self.T > 200 and self.R > 5 else 0
        self.path = K.backward(self.rng, K.forward(K.emissions(self.theta.mean(0), self.ar, self.br, self.s2), self.trans, self.pi0, beam), self.trans)
        n = np.zeros((self.R, self.R))
        np.add.at(n, (self.path[:-1], self.path[1:]), 1)
        g = self.rng.gamma(1 + n + np.eye(self.R))
        self.trans = g / g.sum(1, keepdims=True)
        wide = lambda x: np.concatenate(list(x.reshape(-1, self.m, self.m)), axis=1)
        active = 0
        for r in range(self.R):
            at = np.flatnonzero(self.path[1:] == r) + 1
            if len(at):
                active += 1
                past, now = self.theta[:, at - 1], self.theta[:, at]
                self.ar[r] = K.capped(K.regress_rows(self.rng, wide(now), wide(past @ self.br[r].T), self.eye, self.s2, self.ta))
                self.br[r] = K.capped(K.regress_rows(self.rng, wide(now.transpose(0, 1, 3, 2)), wide((self.ar[r] @ past).transpose(0, 1, 3, 2)), self.eye, self.s2, self.tb))
            else:
                self.ar[r] = self.eye + np.sqrt(self.ta / 10) * self.rng.standard_normal((self.m, self.m))
                self.br[r] = self.eye + np.sqrt(self.tb / 10) * self.rng.standard_normal((self.m, self.m))
        self.a, self.b = self.ar[self.path], self.br[self.path]
        m2 = self.m**2
        self.ta = K.inverse_gamma(self.rng, 10 + m2 + m2 * active / 2, 10 + ((self.ar - self.eye) ** 2).sum() / 2)
        self.tb = K.inverse_gamma(self.rng, 10 + m2 + m2 * active / 2, 10 + ((self.br - self.eye) ** 2).sum() / 2)
        self.s2 = K.inverse_gamma(self.rng, 10 + m2 + m2 * self.p * (self.T - 1) / 2, 10 + K.bilinear_rss(self.theta, self.a, self.b) / 2)
        self.noise()

    def operators(self) -> list[tuple]:
        order = np.argsort(-np.trace(self.ar, axis1=1, axis2=2))  # regimes by falling trace of A
        rank = np.argsort(order)
        return [("a", self.ar[order]), ("b", self.br[order]), ("trans", self.trans[np.ix_(order, order)][None]), ("state", (rank[self.path] + 1.0)[:, None, None])]


SAMPLERS: dict[str, Callable] = {"static": Static, "dynamic": Dynamic, "lowrank": LowRank, "hmm": Hmm}


def register_sampler(name: str, sampler: Callable) -> None:
    """A sampler class of the user's own; fit(model=name) finds it."""
    SAMPLERS[name] = sampler


def long_rows(draw: int, part: str, x: np.ndarray, name: str | None = None) -> pd.DataFrame:
    t, i, k = np.indices(x.shape).reshape(3, -1) + 1
    return pd.DataFrame({"draw": draw, "part": part, "name": name, "t": t, "i": i, "k": k, "value": x.reshape(-1)})


def chain_blocks(y: np.ndarray, model: str, family: str, nscan: int, burn: int, odens: int, seed: int, chain: int, init: dict | None = None, block: int = 200_000, **options) -> Iterator[pd.DataFrame]:
    """Draws of one chain in frames of about `block` rows, so that a long chain never stands in memory as a whole."""
    rng = np.random.Generator(np.random.Philox(key=[seed, chain]))
    sampler = SAMPLERS[model](y, family, rng, init=init, **options)
    rows, size, draw = [], 0, 0
    for it in range(1, burn + nscan + 1):
        sampler.sweep()
        if it <= burn or (it - burn - 1) % odens:
            continue
        draw += 1
        pars = sampler.scalars()
        new = [long_rows(draw, part, x) for part, x in [*sampler.operators(), ("mu", sampler.mu)]]
        new += [long_rows(draw, "theta", x, str(r)) for r, x in enumerate(sampler.latent_states(), 1)]
        new.append(pd.DataFrame({"draw": draw, "part": "par", "name": list(pars), "t": 0, "i": 0, "k": 0, "value": list(pars.values())}))
        rows, size = rows + new, size + sum(map(len, new))
        if size >= block:
            yield pd.concat(rows, ignore_index=True).assign(chain=chain)
            rows, size = [], 0
    if rows:
        yield pd.concat(rows, ignore_index=True).assign(chain=chain)


def cube(cells: pd.DataFrame) -> tuple[np.ndarray, list]:
    """(p, T, m, m) from long rows; actors are the union of senders and receivers, in order."""
    actors = sorted(set(cells["i"]) | set(cells["j"]))
    rels, times = sorted(set(cells["rel"])), sorted(set(cells["t"]))
    at = {a: n for n, a in enumerate(actors)}
    y = np.full((len(rels), len(times), len(actors), len(actors)), np.nan)
    y[cells["rel"].map({r: n for n, r in enumerate(rels)}), cells["t"].map({t: n for n, t in enumerate(times)}), cells["i"].map(at), cells["j"].map(at)] = cells["y"]
    return y, actors


def fit(tensor: DataFrame, family: str = "ordinal", model: str = "static", nscan: int = 5000, burn: int = 1000, odens: int = 1, seed: int = 6886, chains: int = 1, previous: dict | DataFrame | None = None, **options) -> DataFrame:
    """Draws of a model fitted to (i, j, rel, t, y); chains run in parallel, sweeps of a chain in one task.

    `previous` is a warm start: the draws of an earlier fit, whose last draw is taken, or values by name (s2, ta, a, b, mu, ...).
    Operators of a fit over other times are not taken over; other actors or relations are an error.
    """
    if family not in FAMILIES:
        raise ValueError(f"family should be one of {', '.join(FAMILIES)}")
    if model not in SAMPLERS:
        raise ValueError(f"model should be one of {', '.join(SAMPLERS)}")
    if nscan < 1 or burn < 0 or odens < 1:
        raise ValueError("nscan and odens must be positive, burn not negative")
    spark = ship(tensor.sparkSession)
    if model != "static" and tensor.select("t").distinct().count() < 2:
        raise ValueError("the model needs at least 2 time points")
    if tensor.agg(F.min("y") == F.max("y")).first()[0]:
        raise ValueError("data have zero variance")
    start = last_draw(previous) if isinstance(previous, DataFrame) else previous
    cells = tensor.select("i", "j", F.col("rel").cast("string").alias("rel"), "t", F.col("y").cast("double").alias("y"))
    # Every chain's group is the whole tensor: m * m * p * T cells times `chains`.
    grouped = cells.join(spark.range(chains).select(F.col("id").cast("int").alias("chain"))).groupBy("chain")

    def run(key: tuple[Any, ...], frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        y, _ = cube(pd.concat(list(frames), ignore_index=True))
        for rows in chain_blocks(y, model, family, nscan, burn, odens, seed, int(key[0]), start, **options):
            yield rows[["chain", "draw", "part", "name", "t", "i", "k", "value"]]

    return grouped.applyInPandas(run, DRAWS)


def last_draw(draws: DataFrame) -> dict:
    """Values by name of the last draw of the first chain; that one draw goes to the driver."""
    last = draws.select("chain", "draw").orderBy("chain", F.desc("draw")).first()
    if last is None:
        raise ValueError("the previous fit has no draws")
    rows = draws.where((F.col("chain") == last["chain"]) & (F.col("draw") == last["draw"]) & F.col("part").isin("a", "b", "mu", "par")).toPandas()
    out = {short: float(v) for name, short in SCALARS.items() for v in rows.loc[(rows["part"] == "par") & (rows["name"] == name), "value"]}
    for part, cells in rows[rows["part"] != "par"].groupby("part"):
        x = np.zeros(tuple(int(cells[c].max()) for c in ("t", "i", "k")))
        x[cells["t"] - 1, cells["i"] - 1, cells["k"] - 1] = cells["value"]
        out[part] = x
    return out


def actors(tensor: DataFrame) -> DataFrame:
    """(i, actor): the number by which draws name each actor of a tensor."""
    names = tensor.select(F.explode(F.array("i", "j")).alias("actor")).agg(F.array_sort(F.collect_set("actor")).alias("all"))
    return names.select(F.posexplode("all").alias("at", "actor")).select((F.col("at") + 1).alias("i"), "actor")


def states(draws: DataFrame) -> DataFrame:
    """Latent states (chain, draw, i, j, rel, t, theta) as the posterior queries take them; rel is the relation's number."""
    return draws.where("part = 'theta'").select("chain", "draw", "i", F.col("k").alias("j"), F.col("name").cast("int").alias("rel"), "t", F.col("value").alias("theta"))


def pooled(rows: DataFrame) -> DataFrame:
    """Rows of all chains under one number of draws, which differs between chains."""
    return rows.withColumn("draw", F.col("chain") * F.lit(10**9) + F.col("draw")).drop("chain")


def summary(draws: DataFrame) -> DataFrame:
    """Mean, deviation and quantiles of each parameter over all chains."""
    return posterior.param_summary(parameters(draws).drop("chain"))


def predict(draws: DataFrame, horizon: int = 1, rel: int = 1) -> DataFrame:
    """Forecasts (draw, h, i, j, y) of a dynamic or low-rank fit: last operators, last states, each draw's own noise."""
    late = lambda df: df.join(F.broadcast(df.agg(F.max("t").alias("t"))), "t")  # noqa: E731  # one row
    start = late(pooled(states(draws)).where(F.col("rel") == rel)).select("draw", "i", "j", F.col("theta").alias("y"))
    noise = pooled(parameters(draws).where("parameter = 'sigma2_proc'")).select("draw", F.sqrt("value").alias("sd"))
    return forecasts.forecast(late(pooled(operators(draws))), start, horizon, noise)


def parameters(draws: DataFrame) -> DataFrame:
    return draws.where("part = 'par'").select("chain", "draw", F.col("name").alias("parameter"), "value")


def operators(draws: DataFrame) -> DataFrame:
    """(chain, draw, t, i, k, a, b)."""
    return draws.where("part in ('a', 'b')").groupBy("chain", "draw", "t", "i", "k").agg(F.max(F.when(F.col("part") == "a", F.col("value"))).alias("a"), F.max(F.when(F.col("part") == "b", F.col("value"))).alias("b"))
