"""Recursions over one series that SQL can't express; NumPy only, used inside grouped functions."""

from __future__ import annotations

from dataclasses import dataclass
from math import lgamma

import numpy as np


_log_gamma = np.frompyfunc(lgamma, 1, 1)


def log_gamma(x: np.ndarray) -> np.ndarray:
    return np.asarray(_log_gamma(np.asarray(x, dtype=float)), dtype=float)


TINY = 1e-300


def _fraction(first: np.ndarray, term, rounds: int = 10_000) -> np.ndarray:
    """A continued fraction first + a1 / (b1 + a2 / (b2 + ...)) by the modified Lentz rule, for all rows until the last has settled."""
    value = np.where(first == 0, TINY, first)
    c, d = value.copy(), np.zeros_like(value)
    for i in range(1, rounds):
        a, b = term(i)
        d = b + a * d
        d = 1 / np.where(d == 0, TINY, d)
        c = b + a / c
        c = np.where(c == 0, TINY, c)
        step = c * d
        value = value * step
        if (np.abs(step - 1) < 1e-15).all():
            break
    return value


def lower_gamma(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised lower incomplete gamma function: a series where x < a + 1, one less the upper function's fraction elsewhere."""
    a, x = np.broadcast_arrays(np.asarray(a, dtype=float), np.asarray(x, dtype=float))
    out = np.zeros(a.shape)
    with np.errstate(divide="ignore", under="ignore"):
        scale = np.exp(-x + a * np.log(np.maximum(x, TINY)) - log_gamma(a))
    low = (x < a + 1) & (x > 0)
    if low.any():
        p, q, total, term = a[low], x[low], 1 / a[low], 1 / a[low]
        while True:
            p = p + 1
            term = term * q / p
            total = total + term
            if (term <= 1e-16 * total).all():
                break
        out[low] = total * scale[low]
    high = x >= a + 1
    if high.any():
        p, q = a[high], x[high]
        out[high] = 1 - scale[high] / _fraction(q + 1 - p, lambda i: (-i * (i - p), q + 2 * i + 1 - p))
    return out


def incomplete_beta(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function by its continued fraction, on the side where that settles fast."""
    x, a, b = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (x, a, b)))
    swap = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)

    def term(i: int) -> tuple[np.ndarray, np.ndarray]:
        m = i // 2
        if i % 2:
            return -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1)), np.ones_like(y)
        return m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), np.ones_like(y)

    with np.errstate(divide="ignore", under="ignore"):
        scale = np.exp(log_gamma(p + q) - log_gamma(p) - log_gamma(q) + p * np.log(np.maximum(y, TINY)) + q * np.log(np.maximum(1 - y, TINY))) / p
    part = np.where(y <= 0, 0.0, scale / _fraction(np.ones_like(y), term))
    return np.where(swap, 1 - part, part)


def poisson_tail(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """P(X >= x), row by row of arrays; 1 for x up to 0."""
    x, mean = np.broadcast_arrays(np.asarray(x, dtype=float), np.asarray(mean, dtype=float))
    return np.where(x <= 0, 1.0, np.clip(lower_gamma(np.maximum(x, 1), mean), 0, 1))


def negative_binomial_tail(x: np.ndarray, mean: np.ndarray, k: np.ndarray) -> np.ndarray:
    """P(X >= x) of mean and dispersion k (variance mean + mean^2 / k), row by row of arrays."""
    x, mean, k = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (x, mean, k)))
    return np.where(x <= 0, 1.0, np.clip(incomplete_beta(mean / (k + mean), np.maximum(x, 1), k), 0, 1))


@dataclass
class RunLengths:
    """The state of Bayesian online changepoints of Poisson counts with a gamma prior: mass, shape and rate of each run length."""

    mass: np.ndarray
    shape: np.ndarray
    rate: np.ndarray

    @classmethod
    def start(cls, shape: float = 1.0, rate: float = 0.1) -> RunLengths:
        return cls(np.array([1.0]), np.array([shape]), np.array([rate]))

    def step(self, x: float, hazard: float = 1 / 50, longest: int = 40, shape: float = 1.0, rate: float = 0.1) -> RunLengths:
        """After one more count; mass beyond `longest` is dropped and the rest renormalised."""
        p = self.rate / (self.rate + 1)
        predictive = np.exp(log_gamma(x + self.shape) - log_gamma(self.shape) - lgamma(x + 1) + self.shape * np.log(p) + x * np.log(1 - p))
        grown, changed = self.mass * predictive * (1 - hazard), (self.mass * predictive * hazard).sum()
        mass = np.concatenate([[changed], grown])[: longest + 1]
        mass = mass / mass.sum() if mass.sum() > 0 else np.full(len(mass), 1 / len(mass))
        return RunLengths(mass, np.concatenate([[shape], self.shape + x])[: longest + 1], np.concatenate([[rate], self.rate + 1])[: longest + 1])


def run_length_filter(counts: np.ndarray, hazard: float = 1 / 50, longest: int = 40, window: int = 3, shape: float = 1.0, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """P(run length <= window) and the likeliest run length after each count; the first `window` steps always have probability 1."""
    state = RunLengths.start(shape, rate)
    recent, likeliest = np.zeros(len(counts)), np.zeros(len(counts), dtype=int)
    for t, x in enumerate(counts):
        state = state.step(x, hazard, longest, shape, rate)
        recent[t], likeliest[t] = state.mass[: window + 1].sum(), int(np.argmax(state.mass))
    return recent, likeliest


def burst_states(counts: np.ndarray, ratio: float = 2.0, gamma: float = 1.0, states: int = 3) -> np.ndarray:
    """The cheapest state sequence of Poisson rates mean * ratio^i; a step up or down costs gamma for each state."""
    mean = max(float(np.mean(counts)), 1e-9)
    rates = mean * ratio ** np.arange(states)
    emit = rates[None, :] - counts[:, None] * np.log(rates)[None, :]
    move = np.abs(np.arange(states)[:, None] - np.arange(states)[None, :]) * gamma
    cost, back = emit[0] + np.arange(states) * gamma, []
    for row in emit[1:]:
        through = cost[:, None] + move
        back.append(np.argmin(through, axis=0))
        cost = through.min(axis=0) + row
    path = [int(np.argmin(cost))]
    for step in reversed(back):
        path.append(int(step[path[-1]]))
    return np.array(path[::-1])


def kernel_changepoints(x: np.ndarray, penalty: float = 1.0, least: int = 2) -> list[int]:
    """Starts of the segments (but the first) of least kernel cost plus penalty, Gaussian kernel of median bandwidth; exact dynamic programme."""
    n = len(x)
    if n < 2 * least:
        return []
    square = ((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)
    width = np.median(square[np.triu_indices(n, 1)]) or 1.0
    total = np.zeros((n + 1, n + 1))
    total[1:, 1:] = np.exp(-square / width).cumsum(0).cumsum(1)
    best, start = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=int)
    best[0] = -penalty
    for end in range(least, n + 1):
        for s in range(0, end - least + 1):
            inner = total[end, end] - total[s, end] - total[end, s] + total[s, s]
            cost = best[s] + (end - s) - inner / (end - s) + penalty
            if cost < best[end] - 1e-12:
                best[end], start[end] = cost, s
    cuts, end = [], n
    while end > 0:
        end = int(start[end])
        if end:
            cuts.append(end)
    return cuts[::-1]


def logistic_fit(y: np.ndarray, rounds: int = 200) -> tuple[float, float, float, float]:
    """(level, rate, midpoint, r2) of level / (1 + exp(-rate * (t - midpoint))): damped least squares inside bounds, from (max, 1, n / 2)."""
    t, n = np.arange(len(y), dtype=float), len(y)
    low, high = np.array([1e-9, 1e-3, -float(n)]), np.array([10 * max(y.max(), 1e-9), 10.0, 2.0 * n])
    p = np.array([max(y.max(), 1e-9), 1.0, n / 2])
    curve = lambda p: p[0] / (1 + np.exp(-np.clip(p[1] * (t - p[2]), -50, 50)))
    damping, error = 1e-2, ((y - curve(p)) ** 2).sum()
    for _ in range(rounds):
        f = curve(p)
        s = f / p[0]
        jacobian = np.stack([s, f * (1 - s) * (t - p[2]), -f * (1 - s) * p[1]], axis=1)
        normal = jacobian.T @ jacobian
        step = np.linalg.solve(normal + damping * np.diag(np.diag(normal) + 1e-12), jacobian.T @ (y - f))
        trial = np.clip(p + step, low, high)
        new = ((y - curve(trial)) ** 2).sum()
        if new < error:
            small = error - new < 1e-12 * (1 + error)
            p, error, damping = trial, new, damping / 3
            if small:
                break
        else:
            damping *= 4
            if damping > 1e12:
                break
    spread = ((y - y.mean()) ** 2).sum()
    return float(p[0]), float(p[1]), float(p[2]), float(1 - error / spread) if spread > 0 else 0.0
