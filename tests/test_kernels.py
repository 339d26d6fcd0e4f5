"""The samplers' kernels against closed forms and dense Gaussian algebra."""

import math

import numpy as np
import pytest

from netloom.operators import kernels


def test_numerics():
    rng = np.random.default_rng(1)
    a = rng.standard_normal((6, 6))
    assert np.isclose(kernels.radius(kernels.capped(a, 0.9)), 0.9) and np.array_equal(kernels.capped(a / 100, 0.9), a / 100)
    assert kernels.stationary(a * 0.1, a * 0.1) and not kernels.stationary(np.eye(2), np.eye(2))
    assert np.linalg.eigvalsh(kernels.positive(a)).min() >= 1e-6 * (1 - 1e-6)
    good = a @ a.T + np.eye(6)
    assert np.allclose(kernels.factor(good) @ kernels.factor(good).T, good)
    bad = kernels.factor(np.diag([1.0, 0.0, -1e-3]))
    assert np.isfinite(bad).all() and (np.diag(bad) > 0).all()


def test_normal_functions_and_truncation():
    x = np.linspace(-5, 5, 101)
    assert np.allclose(kernels.pnorm(x), [0.5 * (1 + math.erf(v / math.sqrt(2))) for v in x], atol=2e-7)
    p = np.linspace(0.001, 0.999, 99)
    assert np.allclose(kernels.pnorm(kernels.qnorm(p)), p, atol=1e-6)
    z = kernels.truncated(np.random.default_rng(2), np.zeros(20000), np.full(20000, 0.5), np.full(20000, 2.0))
    phi = lambda v: math.exp(-v * v / 2) / math.sqrt(2 * math.pi)
    mean = (phi(0.5) - phi(2.0)) / float(kernels.pnorm(np.array(2.0)) - kernels.pnorm(np.array(0.5)))
    assert z.min() >= 0.5 and z.max() <= 2.0 and abs(z.mean() - mean) < 0.02


def test_inverse_wishart():
    rng = np.random.default_rng(3)
    s = np.array([[2.0, 0.5], [0.5, 1.0]])
    mean = np.mean([kernels.inverse_wishart(rng, 12, s) for _ in range(4000)], axis=0)
    assert np.allclose(mean, s / (12 - 2 - 1), atol=0.02)
    with pytest.raises(ValueError, match="degrees of freedom"):
        kernels.inverse_wishart(rng, 3, s)


def test_cayley_keeps_columns_orthonormal():
    rng = np.random.default_rng(4)
    u = np.linalg.qr(rng.standard_normal((7, 3)))[0]
    new = kernels.cayley(u, kernels.skew(rng, 7, 1.0), 0.3)
    assert np.allclose(new.T @ new, np.eye(3)) and not np.allclose(new, u)


def dense_posterior(y, f, v, w, m0, c0, rho):
    """Mean and covariance of all states given all observations, in one Gaussian."""
    d, n = len(m0), len(y)
    mean, cov = np.zeros(n * d), np.zeros((n * d, n * d))
    m, c = m0, c0
    marginal = []
    for t in range(n):
        m, c = rho * m, rho * rho * c + w
        mean[t * d : t * d + d] = m
        marginal.append(c)
    for s in range(n):
        for t in range(s, n):
            block = rho ** (t - s) * marginal[s]
            cov[s * d : s * d + d, t * d : t * d + d] = block
            cov[t * d : t * d + d, s * d : s * d + d] = block.T
    k = len(y[0])
    big = np.zeros((n * k, n * d))
    for t in range(n):
        big[t * k : t * k + k, t * d : t * d + d] = f[t]
    q = big @ cov @ big.T + np.kron(np.eye(n), v)
    gain = np.linalg.solve(q, big @ cov).T
    return mean + gain @ (np.concatenate(y) - big @ mean), cov - gain @ big @ cov


def test_filter_dlm_draws_from_the_exact_posterior():
    rng = np.random.default_rng(5)
    n, d, k, rho = 4, 2, 3, 0.8
    f, y = [rng.standard_normal((k, d)) for _ in range(n)], [rng.standard_normal(k) for _ in range(n)]
    v, w = np.diag([0.5, 0.7, 0.9]), np.array([[0.4, 0.1], [0.1, 0.3]])
    draws = np.array([kernels.filter_dlm(rng, y, f, v, w, np.zeros(d), np.eye(d), rho).ravel() for _ in range(6000)])
    mean, cov = dense_posterior(y, f, v, w, np.zeros(d), np.eye(d), rho)
    assert np.allclose(draws.mean(0), mean, atol=0.04) and np.allclose(np.cov(draws.T), cov, atol=0.04)


def test_simulate_states_with_rotations_is_exact():
    """Under rotations all variances stay multiples of the identity, which is what the recursion assumes; for other operators it approximates."""
    rng = np.random.default_rng(6)
    n, m, s2, s2obs = 3, 2, 0.5, 0.8
    turn = lambda: np.linalg.qr(rng.standard_normal((m, m)))[0]
    a, b, z = (np.array([g() for _ in range(n)]) for g in (turn, turn, lambda: rng.standard_normal((m, m))))
    draws = np.array([kernels.simulate_states(rng, z, a, b, s2, s2obs).ravel() for _ in range(6000)])
    d = m * m
    cov = np.zeros((n * d, n * d))
    step = [np.kron(a[t], b[t]) for t in range(n)]  # of rows after rows
    for t in range(n):
        at = slice(t * d, t * d + d)
        if t:
            cov[at, : t * d] = step[t] @ cov[(t - 1) * d : t * d, : t * d]
            cov[: t * d, at] = cov[at, : t * d].T
            cov[at, at] = step[t] @ cov[(t - 1) * d : t * d, (t - 1) * d : t * d] @ step[t].T
        cov[at, at] += s2 * np.eye(d)
    gain = np.linalg.solve(cov + s2obs * np.eye(n * d), cov).T
    assert np.allclose(draws.mean(0), gain @ z.ravel(), atol=0.04) and np.allclose(np.cov(draws.T), cov - gain @ cov, atol=0.05)


def test_effective_size():
    rng = np.random.default_rng(7)
    x = rng.standard_normal(4000)
    assert 0.8 * 4000 < kernels.effective_size(x) < 1.2 * 4000
    y = np.zeros(20000)
    for t in range(1, len(y)):
        y[t] = 0.8 * y[t - 1] + rng.standard_normal()
    assert 0.7 < kernels.effective_size(y) / (len(y) * 0.2 / 1.8) < 1.4 and kernels.effective_size(np.ones(10)) == 10


def test_transitions_and_proposals():
    rng = np.random.default_rng(8)
    a, b = 0.5 * np.eye(3), 0.5 * np.eye(2)
    assert kernels.transition_ok(a, b, 3, 2) and not kernels.transition_ok(a, b, 2, 2)
    assert not kernels.transition_ok(a * np.nan, b, 3, 2) and not kernels.transition_ok(2 * a, b, 3, 2)
    new_a, new_b, valid, n = kernels.propose_transition(rng, a, b)
    assert valid and n == 1 and kernels.transition_ok(new_a, new_b, 3, 2) and not np.allclose(new_a, a)
    kept = kernels.propose_transition(rng, a, b, tries=0)
    assert kept[0] is a and kept[1] is b and kept[2:] == (False, 0)


def test_innovation_covariance():
    assert kernels.covariance_ok(np.diag([1.0, 2.0])) and not kernels.covariance_ok(np.diag([1e-7, 1.0])) and not kernels.covariance_ok(np.diag([1.0, 1e7]))
    rng = np.random.default_rng(9)
    true, a, b = np.array([[1.0, 0.4], [0.4, 0.5]]), 0.5 * np.eye(4), 0.6 * np.eye(2)
    x = [np.zeros((4, 2))]
    for _ in range(3000):
        x.append(a @ x[-1] @ b.T + rng.multivariate_normal(np.zeros(2), true, 4))
    draw, taken = kernels.innovation_covariance(rng, np.eye(2), 5, np.eye(2), np.array(x), a, b)
    assert taken and np.allclose(draw, true, atol=0.06)
    kept, taken = kernels.innovation_covariance(rng, true, 5, 1e-9 * np.eye(2), np.zeros((1, 4, 2)), a, b)
    assert not taken and kept is true  # no innovations, and a scale too small to be usable


def test_orthonormal_factors():
    u, v = kernels.orthonormal_factors(np.random.default_rng(10), 6, 2)
    assert np.allclose(u.T @ u, np.eye(2)) and np.allclose(v.T @ v, np.eye(2)) and not np.allclose(u, v)
    with pytest.raises(ValueError, match="rank"):
        kernels.orthonormal_factors(np.random.default_rng(1), 2, 3)
