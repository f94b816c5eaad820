"""Tails of distributions over whole arrays, in log space where they get small."""

from __future__ import annotations

import math

import numpy as np

_TINY = 1e-300


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function, x > 0: Stirling's series at x + 8, brought back by the recurrence."""
    x = np.asarray(x, float)
    z = x + 8
    series = 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    steps = np.prod([x + i for i in range(8)], axis=0)
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + series - np.log(steps)


def log_choose(n: np.ndarray, k: np.ndarray) -> np.ndarray:
    return log_gamma(n + 1.0) - log_gamma(k + 1.0) - log_gamma(n - k + 1.0)


def normal_tail(z: np.ndarray) -> np.ndarray:
    """P(Z > z): a series of positive terms up to |z| = 2.8, beyond it a continued fraction; nan for nan."""
    x = np.abs(np.asarray(z, float)) / math.sqrt(2)
    near = np.minimum(x, 2.0)
    term, total = near.copy(), near.copy()
    for n in range(1, 60):
        term = term * 2 * near**2 / (2 * n + 1)
        total = total + term
    small = 0.5 - total * np.exp(-(near**2)) / math.sqrt(math.pi)
    far = np.maximum(x, 2.0)
    fraction = far
    for n in range(120, 0, -1):
        fraction = far + n / 2 / fraction
    large = np.exp(-(far**2)) / fraction / (2 * math.sqrt(math.pi))
    upper = np.where(x <= 2.0, small, large)
    return np.where(np.isnan(x), np.nan, np.where(np.asarray(z) < 0, 1 - upper, upper))


def _log_beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """ln of the regularised incomplete beta function for x <= (a + 1) / (a + b + 2), by its continued fraction after Lentz."""
    front = a * np.log(np.maximum(x, _TINY)) + b * np.log1p(-np.minimum(x, 1 - 1e-16)) - np.log(a) + log_gamma(a + b) - log_gamma(a) - log_gamma(b)
    nonzero = lambda v: np.where(np.abs(v) < _TINY, _TINY, v)
    c, d = np.ones_like(x), 1 / nonzero(1 - (a + b) * x / (a + 1))
    h = d.copy()
    for m in range(1, 3000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d, c = 1 / nonzero(1 + even * d), nonzero(1 + even / c)
        h = h * d * c
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d, c = 1 / nonzero(1 + odd * d), nonzero(1 + odd / c)
        h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    return front + np.log(h)


def log_binomial_tail(k: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """ln P(X >= k) for X binomial of n trials of chance p."""
    k, n, p = np.broadcast_arrays(*(np.asarray(v, float) for v in (k, n, p)))
    sure, never = (k <= 0) | (p >= 1), (k > n) | (p <= 0)
    a, b, x = np.where(sure | never, 1.0, k), np.where(sure | never, 1.0, n - k + 1), np.where(sure | never, 0.5, p)
    direct = x <= (a + 1) / (a + b + 2)
    one = _log_beta_fraction(np.where(direct, a, b), np.where(direct, b, a), np.where(direct, x, 1 - x))
    out = np.where(direct, one, np.log1p(-np.exp(np.minimum(one, -1e-16))))
    return np.where(sure, 0.0, np.where(never, -np.inf, out))


def log_hypergeometric_tail(k: np.ndarray, population: np.ndarray, marked: np.ndarray, drawn: np.ndarray) -> np.ndarray:
    """ln P(X >= k) for X the marked ones among drawn of a population."""
    k, population, marked, drawn = (np.asarray(v, float).copy() for v in np.broadcast_arrays(k, population, marked, drawn))
    least, most = np.maximum(0, drawn + marked - population), np.minimum(marked, drawn)
    start = np.maximum(k, least)
    never = k > most
    i = np.where(never, least, start)
    first = log_choose(marked, i) + log_choose(population - marked, drawn - i) - log_choose(population, drawn)
    term, total = np.ones_like(i), np.ones_like(i)
    scale = first
    while True:
        go = i < most
        if not go.any():
            break
        term = np.where(go, term * (marked - i) * (drawn - i) / np.maximum((i + 1) * (population - marked - drawn + i + 1), 1), 0)
        total, i = total + term, i + 1
        if np.all(term <= total * 1e-17):
            break
        big = total > 1e200  # the sum climbs to its mode first
        scale, term, total = np.where(big, scale + np.log(total), scale), np.where(big, term / total, term), np.where(big, 1.0, total)
    out = np.minimum(scale + np.log(total), 0.0)
    return np.where(never, -np.inf, np.where(k <= least, 0.0, out))


def log_poisson_tail(k: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """ln P(X >= k) for X Poisson: from k on, terms fall from the first by mean / (k + i); where they rise first, one less the sum below k."""
    k, mean = (np.asarray(v, float) for v in np.broadcast_arrays(k, mean))
    first = lambda i: i * np.log(np.maximum(mean, _TINY)) - mean - log_gamma(i + 1.0)
    term, total = np.ones_like(k), np.ones_like(k)
    for i in range(1, 100_000):
        term = np.where(k + i > mean, term * mean / (k + i), 0)
        total = total + term
        if np.all(term <= total * 1e-17):
            break
    upper = first(k) + np.log(total)
    small = np.where(k <= mean, k, 1)  # the other way is taken for these only
    below, term = np.zeros_like(k), np.ones_like(k)  # the sum below by its last term
    for i in range(1, 100_000):
        below = below + np.where(small - i >= 0, term, 0)
        term = np.where(small - i > 0, term * (small - i) / np.maximum(mean, _TINY), 0)
        if np.all(term <= below * 1e-17):
            break
    lower = np.log1p(-np.minimum(np.exp(first(np.maximum(small - 1, 0))) * below, 1 - 1e-16))
    return np.where(k <= 0, 0.0, np.where(mean <= 0, -np.inf, np.where(k > mean, upper, lower)))
