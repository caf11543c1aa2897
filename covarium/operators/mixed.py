"""Linear mixed models for a few hundred result rows: fixed effects, random effects by group, REML, on the driver."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from covarium.functions.distributions import NORMAL


@dataclass(frozen=True)
class MixedModel:
    names: tuple[str, ...]
    beta: np.ndarray
    se: np.ndarray
    random: np.ndarray
    residual: float
    log_likelihood: float
    converged: bool

    def table(self) -> list[dict]:
        z = self.beta / self.se
        return [{"term": n, "estimate": float(b), "se": float(s), "z": float(v), "p": 2 * (1 - NORMAL.cdf(abs(float(v))))} for n, b, s, v in zip(self.names, self.beta, self.se, z)]


def _profile(theta: np.ndarray, blocks, p: int, q: int):
    """REML criterion at a relative random-effect factor: fixed effects and the residual variance are profiled out."""
    factor = np.zeros((q, q))
    factor[np.tril_indices(q)] = theta
    psi = factor @ factor.T
    xtx, xty, yty, logdet, n = np.zeros((p, p)), np.zeros(p), 0.0, 0.0, 0
    for x, z, y in blocks:
        v = np.eye(len(y)) + z @ psi @ z.T
        low = np.linalg.cholesky(v)
        a, b = np.linalg.solve(low, x), np.linalg.solve(low, y)
        xtx, xty, yty, logdet, n = xtx + a.T @ a, xty + a.T @ b, yty + b @ b, logdet + 2 * np.log(np.diag(low)).sum(), n + len(y)
    beta = np.linalg.solve(xtx, xty)
    sigma2 = max((yty - xty @ beta) / (n - p), 1e-300)
    loss = (n - p) * (np.log(2 * np.pi * sigma2) + 1) + logdet + np.linalg.slogdet(xtx)[1]
    return loss, beta, sigma2, xtx, psi


def _simplex(f, start: np.ndarray, steps: int = 600, tol: float = 1e-9) -> tuple[np.ndarray, float, bool]:
    """Nelder and Mead's downhill simplex."""
    points = [start, *(start + 0.25 * e for e in np.eye(len(start)))]
    values = [f(x) for x in points]
    for _ in range(steps):
        order = np.argsort(values)
        points, values = [points[i] for i in order], [values[i] for i in order]
        if values[-1] - values[0] < tol:
            return points[0], values[0], True
        centre = np.mean(points[:-1], axis=0)
        tries = {k: centre + k * (centre - points[-1]) for k in (1.0, 2.0, 0.5, -0.5)}
        reflected = f(tries[1.0])
        if reflected < values[0]:
            far = f(tries[2.0])
            points[-1], values[-1] = (tries[2.0], far) if far < reflected else (tries[1.0], reflected)
        elif reflected < values[-2]:
            points[-1], values[-1] = tries[1.0], reflected
        else:
            k = 0.5 if reflected < values[-1] else -0.5
            near = f(tries[k])
            if near < min(reflected, values[-1]):
                points[-1], values[-1] = tries[k], near
            else:
                points = [points[0], *((x + points[0]) / 2 for x in points[1:])]
                values = [values[0], *(f(x) for x in points[1:])]
    best = int(np.argmin(values))
    return points[best], values[best], False


def fit(x: np.ndarray, y: np.ndarray, groups: np.ndarray, z: np.ndarray | None = None, names: tuple[str, ...] | None = None) -> MixedModel:
    """REML fit of ``y ~ x`` with random ``z`` (an intercept) for each group."""
    x, y, groups = np.asarray(x, float), np.asarray(y, float), np.asarray(groups)
    z = np.ones((len(y), 1)) if z is None else np.asarray(z, float)
    blocks = [(x[groups == g], z[groups == g], y[groups == g]) for g in np.unique(groups)]
    p, q = x.shape[1], z.shape[1]
    start = np.eye(q)[np.tril_indices(q)]
    theta, loss, done = _simplex(lambda t: _profile(t, blocks, p, q)[0], start)
    _, beta, sigma2, xtx, psi = _profile(theta, blocks, p, q)
    return MixedModel(names or tuple(f"x{i}" for i in range(p)), beta, np.sqrt(sigma2 * np.diag(np.linalg.inv(xtx))), sigma2 * psi, sigma2, -loss / 2, done)


def interaction_model(value, predictor, second, groups) -> MixedModel:
    """``value ~ predictor * second`` with random intercept and slope, or the intercept alone if that doesn't settle."""
    d, k = np.asarray(predictor, float), np.asarray(second, float)
    x = np.c_[np.ones(len(d)), d, k, d * k]
    names = ("intercept", "predictor", "second", "interaction")
    both = fit(x, value, groups, np.c_[np.ones(len(d)), d], names)
    return both if both.converged else fit(x, value, groups, None, names)
