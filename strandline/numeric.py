"""Small dense numerics for the driver and for pandas kernels (numpy only)."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np


def expm(m: np.ndarray) -> np.ndarray:
    """Matrix exponential by scaling and squaring of a Taylor sum."""
    m = np.asarray(m, float)
    k = max(0, math.ceil(math.log2(max(np.abs(m).sum(axis=1).max(initial=0), 1e-300))) + 3)
    x = m / 2**k
    out, term = np.eye(len(m)), np.eye(len(m))
    for i in range(1, 16):
        term = term @ x / i
        out = out + term
    for _ in range(k):
        out = out @ out
    return out


def stationary(t: np.ndarray) -> np.ndarray:
    """Stationary distribution of a stochastic matrix, as the limit of its powers."""
    p = np.asarray(t, float)
    for _ in range(20):
        p = p @ p
        p /= p.sum(axis=1, keepdims=True)
    return p[0]


def maximise_1d(f: Callable[[float], float], lo: float, hi: float, rounds: int = 80) -> float:
    """Golden-section maximum of a unimodal function on [lo, hi]."""
    r = (math.sqrt(5) - 1) / 2
    a, b = lo, hi
    c, d = b - r * (b - a), a + r * (b - a)
    fc, fd = f(c), f(d)
    for _ in range(rounds):
        if fc >= fd:
            b, d, fd = d, c, fc
            c = b - r * (b - a)
            fc = f(c)
        else:
            a, c, fc = c, d, fd
            d = a + r * (b - a)
            fd = f(d)
    return (a + b) / 2


def maximise_bounded(f: Callable[[np.ndarray], float], start: Sequence[float], bounds: Sequence[tuple[float, float]], rounds: int = 12) -> np.ndarray:
    """Coordinate-wise golden-section maximum inside a box."""
    x = np.array(start, float)
    for _ in range(rounds):
        old = x.copy()
        for i, (lo, hi) in enumerate(bounds):

            def g(v: float, i: int = i) -> float:
                y = x.copy()
                y[i] = v
                return f(y)

            v = maximise_1d(g, lo, hi, 50)
            if g(v) > f(x):
                x[i] = v
        if np.abs(x - old).max() < 1e-8:
            break
    return x


def chi2_tail_1(x: float) -> float:
    """Upper tail of chi-square with one degree of freedom."""
    return math.erfc(math.sqrt(max(x, 0.0) / 2))


def fisher_exact(a: int, b: int, c: int, d: int) -> float:
    """Two-sided p-value of a 2×2 table."""
    lg = math.lgamma
    r1, r2, k, n = a + b, c + d, a + c, a + b + c + d
    lc = lambda m, j: lg(m + 1) - lg(j + 1) - lg(m - j + 1)
    p = lambda x: lc(r1, x) + lc(r2, k - x) - lc(n, k)
    at = p(a)
    return min(1.0, sum(math.exp(p(x)) for x in range(max(0, k - r2), min(k, r1) + 1) if p(x) <= at + 1e-7))


def squarem_step(x0: np.ndarray, x1: np.ndarray, x2: np.ndarray) -> np.ndarray:
    """Squared extrapolation of two successive EM steps; equals x2 where no acceleration shows."""
    r, v = x1 - x0, (x2 - x1) - (x1 - x0)
    nv = float(np.sqrt(v @ v))
    if nv < 1e-300:
        return x2
    alpha = min(-float(np.sqrt(r @ r)) / nv, -1.0)
    return x0 - 2 * alpha * r + alpha * alpha * v
