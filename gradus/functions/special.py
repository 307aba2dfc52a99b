"""Numerical helpers for the one Arrow-batch UDF (Spearman p-value); numpy only."""

from __future__ import annotations

import math

import numpy as np


def _betacf(a: np.ndarray, b: np.ndarray, x: np.ndarray, iters: int = 300, eps: float = 3e-16) -> np.ndarray:
    """Continued fraction of the incomplete beta function (modified Lentz), vectorised."""
    tiny = 1e-300
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c = np.ones_like(x)
    d = 1.0 - qab * x / qap
    d = np.where(np.abs(d) < tiny, tiny, d)
    d = 1.0 / d
    h = d.copy()
    for m in range(1, iters + 1):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = np.where(np.abs(d) < tiny, tiny, d)
        c = 1.0 + aa / c
        c = np.where(np.abs(c) < tiny, tiny, c)
        d = 1.0 / d
        h = h * d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = np.where(np.abs(d) < tiny, tiny, d)
        c = 1.0 + aa / c
        c = np.where(np.abs(c) < tiny, tiny, c)
        d = 1.0 / d
        delta = d * c
        h = h * delta
        if np.all(np.abs(delta - 1.0) < eps):
            break
    return h


def betainc(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta I_x(a, b) for arrays (0 <= x <= 1)."""
    a, b, x = (np.asarray(v, dtype="float64") for v in np.broadcast_arrays(a, b, x))
    out = np.zeros_like(x)
    out[x >= 1.0] = 1.0
    mid = (x > 0.0) & (x < 1.0)
    if not mid.any():
        return out
    am, bm, xm = a[mid], b[mid], x[mid]
    lg = np.vectorize(math.lgamma)
    lbt = lg(am + bm) - lg(am) - lg(bm) + am * np.log(xm) + bm * np.log1p(-xm)
    front = np.exp(lbt)
    direct = xm < (am + 1.0) / (am + bm + 2.0)
    res = np.empty_like(xm)
    if direct.any():
        res[direct] = front[direct] * _betacf(am[direct], bm[direct], xm[direct]) / am[direct]
    inv = ~direct
    if inv.any():
        res[inv] = 1.0 - front[inv] * _betacf(bm[inv], am[inv], 1.0 - xm[inv]) / bm[inv]
    out[mid] = res
    return out


def t_two_sided_p(r: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Two-sided p of a correlation r on n samples (t with n-2 degrees of freedom).
    NaN r -> NaN (caller maps to 1.0); |r| = 1 -> 0; n = 2 -> 1."""
    r = np.asarray(r, dtype="float64")
    df = np.asarray(n, dtype="float64") - 2.0
    out = np.full(r.shape, np.nan)
    one = np.isfinite(r) & (np.abs(r) >= 1.0) & (df > 0)
    out[one] = 0.0
    out[np.isfinite(r) & (df <= 0)] = 1.0
    ok = np.isfinite(r) & (np.abs(r) < 1.0) & (df > 0)
    if ok.any():
        rr, dd = r[ok], df[ok]
        t2 = rr * rr * dd / (1.0 - rr * rr)
        out[ok] = betainc(dd / 2.0, np.full_like(dd, 0.5), dd / (dd + t2))
    return out
