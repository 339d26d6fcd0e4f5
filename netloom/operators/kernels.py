"""NumPy kernels of the samplers: numerics, state space, operators, regimes. A stack is an array (p, T, m, m)."""

from __future__ import annotations

import numpy as np

CAP = 0.995


def radius(a: np.ndarray) -> float:
    return float(np.abs(np.linalg.eigvals(a)).max()) if a.size else 0.0


def capped(a: np.ndarray, cap: float = CAP) -> np.ndarray:
    r = radius(a)
    return a * (cap / r) if r > cap else a


def positive(a: np.ndarray, floor: float = 1e-6) -> np.ndarray:
    w, v = np.linalg.eigh((a + a.T) / 2)
    return (v * np.maximum(w, floor)) @ v.T


def factor(a: np.ndarray, jitter: float = 1e-8) -> np.ndarray:
    """Cholesky factor; jitter grows tenfold for four more attempts, then the spectrum is clamped."""
    eye = np.eye(len(a))
    for k in range(5):
        try:
            return np.linalg.cholesky(a + (jitter * 10.0 ** (k - 1) if k else 0.0) * eye)
        except np.linalg.LinAlgError:
            continue
    return np.linalg.cholesky(positive(a, max(1e-8, 1e-10 * float(np.abs(np.diag(a)).max()))))


def stationary(a: np.ndarray, b: np.ndarray) -> bool:
    return radius(a) * radius(b) < CAP


def transition_ok(a: np.ndarray, b: np.ndarray, m: int, n: int, both: bool = True) -> bool:
    """Whether a (m x m) and b (n x n) are finite and their radii below the cap; both: the product of the radii, too."""
    if a.shape != (m, m) or b.shape != (n, n) or not (np.isfinite(a).all() and np.isfinite(b).all()):
        return False
    return max(radius(a), radius(b)) < CAP and (not both or stationary(a, b))


def propose_transition(rng: np.random.Generator, a: np.ndarray, b: np.ndarray, step_a: float = 0.1, step_b: float = 0.1, tries: int = 10) -> tuple[np.ndarray, np.ndarray, bool, int]:
    """A random-walk proposal (a, b, valid, attempts); steps shrink to 0.8 of their size after each that is not valid, and the old pair is the answer if none is."""
    shrink = 0.8 ** np.arange(tries)
    for n, s in enumerate(shrink, 1):
        walk = [capped(x + step * s * rng.standard_normal(x.shape)) for x, step in ((a, step_a), (b, step_b))]
        if transition_ok(*walk, len(a), len(b)):
            return *walk, True, n
    return a, b, False, tries


def covariance_ok(s: np.ndarray, least: float = 1e-6, condition: float = 1e6) -> bool:
    """Whether the least eigenvalue and the condition number are within their bounds."""
    w = np.linalg.eigvalsh(s)
    return bool(w[0] >= least and w[-1] <= condition * w[0])


def innovation_covariance(rng: np.random.Generator, now: np.ndarray, nu: int, scale: np.ndarray, x: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, bool]:
    """A draw of the columns' covariance of the innovations of x (T, m, n) under x_t = a x_(t-1) b' + e; `now` stays if the draw is not usable."""
    e = np.concatenate(x[1:] - a @ x[:-1] @ b.T) if len(x) > 1 else np.zeros((0, x.shape[2]))
    draw = inverse_wishart(rng, nu + len(e), positive(scale + e.T @ e))
    return (draw, True) if covariance_ok(draw) else (now, False)


def orthonormal_factors(rng: np.random.Generator, m: int, r: int) -> tuple[np.ndarray, np.ndarray]:
    """Two m x r matrices with orthonormal columns."""
    if r > m:
        raise ValueError("rank cannot exceed dimension")
    return tuple(np.linalg.qr(rng.standard_normal((m, r)))[0] for _ in "uv")


def inverse_gamma(rng: np.random.Generator, shape: float, rate: float) -> float:
    return float(np.clip(max(rate, 1e-10) / rng.gamma(max(shape, 1e-10)), 1e-8, 1e8))


def inverse_wishart(rng: np.random.Generator, nu: int, s: np.ndarray) -> np.ndarray:
    """By Bartlett's decomposition."""
    p = len(s)
    if nu <= p + 1:
        raise ValueError("degrees of freedom must exceed dimension + 1")
    t = np.tril(rng.standard_normal((p, p)), -1) + np.diag(np.sqrt(rng.chisquare(nu - np.arange(p))))
    x = np.linalg.solve(t, factor(s).T)
    return x.T @ x


def truncated(rng: np.random.Generator, mean: np.ndarray, lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Unit-variance normal draws inside (lower, upper), by inverse CDF."""
    a, b = pnorm(lower - mean), pnorm(upper - mean)
    z = mean + qnorm(np.clip(a + rng.random(mean.shape) * (b - a), 1e-12, 1 - 1e-12))
    return np.clip(z, lower, upper)


def pnorm(x: np.ndarray) -> np.ndarray:
    from ..functions.normal import ERF, ERF_P

    z = np.minimum(np.abs(x), 38.0) / np.sqrt(2.0)
    t = 1.0 / (1.0 + ERF_P * z)
    tail = 0.5 * t * np.polyval(ERF[::-1], t) * np.exp(-z * z)
    return np.where(x >= 0, 1.0 - tail, tail)


def qnorm(p: np.ndarray) -> np.ndarray:
    from ..functions.normal import QA, QB, QC, QD, TAIL

    q = np.sqrt(-2.0 * np.log(np.minimum(p, 1 - p)))
    tail = np.polyval(QC, q) / (np.polyval(QD, q) * q + 1.0)
    r = p - 0.5
    middle = np.polyval(QA, r * r) * r / (np.polyval(QB, r * r) * r * r + 1.0)
    return np.where(p < TAIL, tail, np.where(p > 1 - TAIL, -tail, middle))


def simulate_states(rng: np.random.Generator, z: np.ndarray, a: np.ndarray, b: np.ndarray, s2: float, s2obs: float, sample: bool = True) -> np.ndarray:
    """Forward filter, backward sampler of theta_t = A_t theta_(t-1) B_t' + N(0, s2), z_t = theta_t + N(0, s2obs).

    z, a, b are (T, m, m). Prior mean 0 and variance s2; the variances stay multiples of the identity.
    """
    n = len(z)
    mean, var = np.zeros_like(z), np.zeros(n)
    for t in range(n):
        told = a[t] @ mean[t - 1] @ b[t].T if t else np.zeros_like(z[0])
        spread = s2 + (var[t - 1] * (np.sum(a[t] ** 2) * np.sum(b[t] ** 2)) / a[t].size if t else 0.0)
        gain = spread / (spread + s2obs)
        mean[t] = told + gain * (z[t] - told)
        var[t] = (1 - gain) * spread
    if not sample:
        return mean
    out = np.empty_like(z)
    out[-1] = mean[-1] + np.sqrt(var[-1]) * rng.standard_normal(z[0].shape)
    for t in range(n - 2, -1, -1):
        back = var[t] / (var[t] + s2)
        m = mean[t] + back * (a[t + 1].T @ (out[t + 1] - a[t + 1] @ mean[t] @ b[t + 1].T) @ b[t + 1])
        out[t] = m + np.sqrt(var[t] * (1 - back)) * rng.standard_normal(m.shape)
    return out


def filter_dlm(rng: np.random.Generator, y: list[np.ndarray], f: list[np.ndarray], v: np.ndarray, w: np.ndarray, m0: np.ndarray, c0: np.ndarray, rho: float = 1.0) -> np.ndarray:
    """General dynamic linear model, one draw of its states: y_t = F_t x_t + v, x_t = rho x_(t-1) + w."""
    m, c, ms, cs, rs = m0, c0, [], [], []
    for yt, ft in zip(y, f):
        r = rho * rho * c + w
        q = ft @ r @ ft.T + v
        k = np.linalg.solve(q, ft @ r).T
        m = rho * m + k @ (yt - ft @ (rho * m))
        j = np.eye(len(m)) - k @ ft
        c = j @ r @ j.T + k @ v @ k.T
        ms.append(m), cs.append(c), rs.append(r)
    x = ms[-1] + factor(cs[-1]) @ rng.standard_normal(len(m0))
    out = [x]
    for t in range(len(y) - 2, -1, -1):
        g = rho * np.linalg.solve(rs[t + 1], cs[t]).T
        x = ms[t] + g @ (x - rho * ms[t]) + factor(cs[t] - g @ rs[t + 1] @ g.T) @ rng.standard_normal(len(m0))
        out.append(x)
    return np.array(out[::-1])


def regress_rows(rng: np.random.Generator | None, response: np.ndarray, design: np.ndarray, prior: np.ndarray, s2: float, tau2: float) -> np.ndarray:
    """Rows of an operator M with response = M design + noise: normal posterior around prior, one Gram for all rows."""
    m = len(prior)
    precision = design @ design.T / s2 + np.eye(m) / tau2
    rhs = response @ design.T / s2 + prior / tau2
    low = factor(precision)
    mean = np.linalg.solve(low.T, np.linalg.solve(low, rhs.T)).T
    return mean if rng is None else mean + np.linalg.solve(low.T, rng.standard_normal((m, m))).T


def operator_draws(rng: np.random.Generator, theta: np.ndarray, a: np.ndarray, b: np.ndarray, s2: float, ta: float, tb: float, rho: tuple[float, float] | None) -> tuple[np.ndarray, np.ndarray]:
    """A_t and B_t for t >= 2 given theta (p, T, m, m); prior mean I, or rho M_(t-1) + (1 - rho) I. A_1 = B_1 = I."""
    eye = np.eye(theta.shape[2])
    a, b = a.copy(), b.copy()
    a[0] = b[0] = eye
    wide = lambda x: np.concatenate(list(x), axis=1)
    for t in range(1, theta.shape[1]):
        past, now = theta[:, t - 1], theta[:, t]
        pa = eye if rho is None else rho[0] * a[t - 1] + (1 - rho[0]) * eye
        a[t] = capped(regress_rows(rng, wide(now), wide(past @ b[t].T), pa, s2, ta))
        pb = eye if rho is None else rho[1] * b[t - 1] + (1 - rho[1]) * eye
        # Row k of B answers column k of theta_t, with design (A theta_(t-1))'.
        b[t] = capped(regress_rows(rng, wide(now.transpose(0, 2, 1)), wide((a[t] @ past).transpose(0, 2, 1)), pb, s2, tb))
    return a, b


def bilinear_rss(theta: np.ndarray, a: np.ndarray, b: np.ndarray) -> float:
    told = a[1:] @ theta[:, :-1] @ b[1:].transpose(0, 2, 1)
    return float(((theta[:, 1:] - told) ** 2).sum())


def emissions(theta: np.ndarray, a: np.ndarray, b: np.ndarray, s2: float) -> np.ndarray:
    """Log densities (R, T) of theta (T, m, m), already averaged over relations, under each regime's operators."""
    past = np.concatenate([theta[:1], theta[:-1]])
    ss = np.array([((theta - x @ past @ y.T) ** 2).sum((1, 2)) for x, y in zip(a, b)])
    return -0.5 * ss / s2 - 0.5 * theta[0].size * np.log(2 * np.pi * s2)


def forward(log_em: np.ndarray, trans: np.ndarray, start: np.ndarray, beam: int = 0) -> np.ndarray:
    """Normalised log forward probabilities (R, T); a beam keeps only the best states of each step."""
    out, lt = np.empty_like(log_em), np.log(trans + 1e-300)
    for t in range(log_em.shape[1]):
        x = np.log(start + 1e-300) if t == 0 else np.logaddexp.reduce(out[:, t - 1][:, None] + lt, axis=0)
        x = x + log_em[:, t]
        if 0 < beam < len(x):
            x[np.argsort(x)[:-beam]] = -np.inf
        out[:, t] = x - np.logaddexp.reduce(x)
    return out


def backward(rng: np.random.Generator, log_alpha: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """A path of states by Gumbel maxima."""
    lt, out = np.log(trans + 1e-300), np.empty(log_alpha.shape[1], int)
    for t in range(log_alpha.shape[1] - 1, -1, -1):
        logp = log_alpha[:, t] + (lt[:, out[t + 1]] if t + 1 < len(out) else 0)
        out[t] = int(np.argmax(logp - np.log(-np.log(rng.random(len(logp))))))
    return out


def cayley(u: np.ndarray, w: np.ndarray, eps: float) -> np.ndarray:
    """A step on the Stiefel manifold along a skew matrix, by the exact solve."""
    eye = np.eye(len(u))
    return np.linalg.solve(eye - eps / 2 * w, (eye + eps / 2 * w) @ u)


def skew(rng: np.random.Generator, m: int, cap: float) -> np.ndarray:
    n = rng.standard_normal((m, m))
    w = n - n.T
    return w * min(1.0, cap / max(np.linalg.norm(w), 1e-12))


def factor_paths(rng: np.random.Generator, theta: np.ndarray, u: np.ndarray, b: np.ndarray, s2: float, tau2: float, rho: float) -> np.ndarray:
    """alpha (T, r) of A_t = U diag(alpha_t) U', filtered in information form: only r x r matrices are solved."""
    n, r = theta.shape[1], u.shape[1]
    m, c = np.zeros(r), np.eye(r) * tau2
    ms, cs, rs = [m], [c], [c]
    for t in range(1, n):
        pred = rho * rho * c + tau2 * np.eye(r)
        left, right = u.T @ theta[:, t], None
        right = (u.T @ theta[:, t - 1] @ b[t].T).transpose(0, 2, 1)  # (p, m, r): rows of U' theta B'
        g = np.einsum("pjr,pjs->rs", right, right) * (u.T @ u)
        h = np.einsum("prj,pjr->r", left, right)
        info = np.linalg.inv(pred)
        c = np.linalg.inv(info + g / s2)
        m = c @ (info @ (rho * m) + h / s2)
        ms.append(m), cs.append(c), rs.append(pred)
    x = ms[-1] + factor(cs[-1]) @ rng.standard_normal(r)
    out = [x]
    for t in range(n - 2, -1, -1):
        k = rho * cs[t] @ np.linalg.inv(rs[t + 1])
        x = ms[t] + k @ (x - rho * ms[t]) + factor(positive(cs[t] - k @ rs[t + 1] @ k.T, 1e-10)) @ rng.standard_normal(r)
        out.append(x)
    return np.array(out[::-1])


def effective_size(x: np.ndarray) -> float:
    """Effective sample size from the initial positive sequence of autocorrelations."""
    n, y = len(x), x - x.mean()
    v = y @ y / n
    if v <= 0:
        return float(n)
    total = 0.0
    for lag in range(1, n // 2, 2):
        pair = sum((y[k:] @ y[:-k]) / n / v for k in (lag, lag + 1))
        if pair <= 0:
            break
        total += pair
    return float(n / (1 + 2 * total))
