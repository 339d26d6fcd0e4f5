"""What fits hand on: states, warm starts, forecasts, names of actors, blocks of draws."""

import numpy as np
import pandas as pd
import pytest

from netloom.operators import fit as fits
from netloom.operators import kernels, posterior


def cells(m: int = 3, p: int = 2, times: int = 4, seed: int = 1) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    at = np.indices((p, times, m, m)).reshape(4, -1)
    rows = pd.DataFrame(at.T, columns=["rel", "t", "i", "j"]).assign(y=rng.standard_normal(at.shape[1]))
    return rows.assign(i="n" + rows["i"].astype(str), j="n" + rows["j"].astype(str))


@pytest.fixture(scope="module")
def draws(spark):
    out = fits.fit(spark.createDataFrame(cells()), "gaussian", "dynamic", nscan=6, burn=2, odens=2, chains=2).toPandas()
    return spark.createDataFrame(out, fits.DRAWS)


def test_states_feed_posterior_queries(draws):
    x = fits.states(draws).toPandas()
    assert len(x) == 2 * 3 * 2 * 4 * 9 and set(x["rel"]) == {1, 2} and set(x["t"]) == {1, 2, 3, 4}
    mean = posterior.theta_summary(fits.pooled(fits.states(draws))).toPandas().set_index(["i", "j", "rel", "t"])["value"].sort_index()
    pd.testing.assert_series_equal(mean, x.groupby(["i", "j", "rel", "t"])["theta"].mean().sort_index(), check_names=False, check_dtype=False, check_index_type=False)
    assert fits.summary(draws).count() == 5


def test_blocks_hold_the_whole_chain():
    y, names = fits.cube(cells())
    whole, parts = (list(fits.chain_blocks(y, "lowrank", "gaussian", 8, 2, 2, 5, 0, block=n, r=2)) for n in (10**9, 1))
    assert names == ["n0", "n1", "n2"] and len(whole) == 1 and len(parts) == 4
    pd.testing.assert_frame_equal(whole[0], pd.concat(parts, ignore_index=True))
    assert set(whole[0]["part"]) == {"a", "b", "u", "alpha", "mu", "theta", "par"}


def test_warm_start(spark, draws):
    rows = draws.where("chain = 0 and draw = 3").toPandas()
    last = fits.last_draw(draws)
    assert last["a"].shape == (4, 3, 3) and last["mu"].shape == (2, 3, 3)
    assert last["s2"] == rows.loc[rows["name"] == "sigma2_proc", "value"].item()
    assert last["a"][1, 2, 0] == rows.query("part == 'a' and t == 2 and i == 3 and k == 1")["value"].item()
    again = fits.fit(spark.createDataFrame(cells()), "gaussian", "dynamic", nscan=1, burn=0, previous=draws)
    assert again.where("part = 'a'").count() == 4 * 9
    y, _ = fits.cube(cells(m=4))
    with pytest.raises(ValueError, match="other actors"):
        next(fits.chain_blocks(y, "dynamic", "gaussian", 1, 0, 1, 1, 0, last))
    y, _ = fits.cube(cells(times=3))  # other times: operators begin anew
    assert len(next(fits.chain_blocks(y, "dynamic", "gaussian", 1, 0, 1, 1, 0, last))) > 0
    with pytest.raises(ValueError, match="no draws"):
        fits.last_draw(draws.where("false"))


def test_forecast_of_a_fit(draws):
    """Without noise the forecast is A theta B' of each draw's last time."""
    quiet = draws.selectExpr("chain", "draw", "part", "name", "t", "i", "k", "if(name = 'sigma2_proc', 0D, value) AS value")
    out = fits.predict(quiet, 1, rel=2).toPandas()
    assert len(out) == 2 * 3 * 9
    rows = draws.where("chain = 1 and draw = 2 and t = 4").toPandas()
    square = lambda x: x.sort_values(["i", "k"])["value"].to_numpy().reshape(3, 3)
    a, b, th = (square(rows[at]) for at in (rows["part"] == "a", rows["part"] == "b", (rows["part"] == "theta") & (rows["name"] == "2")))
    mine = out[out["draw"] == 10**9 + 2].sort_values(["i", "j"])["y"].to_numpy().reshape(3, 3)
    assert np.allclose(mine, a @ th @ b.T)


def test_actors(spark):
    out = fits.actors(spark.createDataFrame(cells())).toPandas()
    assert sorted(zip(out["i"], out["actor"])) == [(1, "n0"), (2, "n1"), (3, "n2")]


def test_dlm_states(spark):
    """Each series' draw is the kernel's; rows without a value are left out."""
    rows = pd.DataFrame({"id": [7, 7, 7, 9, 9], "t": [3, 1, 2, 1, 2], "y": [1.0, 2.0, None, 4.0, 5.0]})
    series = spark.createDataFrame(rows.astype({"t": "int32"})).replace(float("nan"), None)
    out = posterior.dlm_states(series, 0.5, 0.1, seed=3).toPandas().sort_values(["id", "t"])
    assert list(zip(out["id"], out["t"])) == [(7, 1), (7, 3), (9, 1), (9, 2)]
    one = np.eye(1)
    for key, y in ((7, [2.0, 1.0]), (9, [4.0, 5.0])):
        rng = np.random.Generator(np.random.Philox(key=[3, key]))
        told = kernels.filter_dlm(rng, [np.array([v]) for v in y], [one, one], 0.5 * one, 0.1 * one, np.zeros(1), one)
        assert np.allclose(out.loc[out["id"] == key, "x"], told[:, 0])
    assert posterior.dlm_states(series.where("false"), 0.5, 0.1).count() == 0
