"""Special functions, distribution families and a simplex minimiser in numpy, for use per series.

The environment has no scientific library beyond numpy, so the incomplete gamma function, its
inverse, tails of chi-square and Kolmogorov-Smirnov, Shapiro-Wilk's test and a derivative-free
minimiser are written out here from their textbook series.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from statistics import NormalDist

import numpy as np

NORMAL = NormalDist()
lgamma = np.vectorize(math.lgamma, otypes=[float])
erf = np.vectorize(math.erf, otypes=[float])
_ppf = np.vectorize(lambda p: -math.inf if p <= 0 else math.inf if p >= 1 else NORMAL.inv_cdf(p), otypes=[float])


def norm_cdf(x) -> np.ndarray:
    return 0.5 * (1 + erf(np.asarray(x, float) / math.sqrt(2)))


def norm_ppf(p) -> np.ndarray:
    return _ppf(np.asarray(p, float))


def gammainc(a: float, x) -> np.ndarray:
    """Regularised lower incomplete gamma function, by series below a + 1 and continued fraction above."""
    x = np.asarray(x, float)
    out = np.zeros_like(x)
    flat, res = x.ravel(), out.ravel()
    head = math.lgamma(a)
    for i, v in enumerate(flat):
        if not v > 0:
            res[i] = 0.0 if v <= 0 else math.nan
        elif math.isinf(v):
            res[i] = 1.0
        elif v < a + 1:
            term = total = 1 / a
            n = a
            for _ in range(10_000):
                n += 1
                term *= v / n
                total += term
                if term < total * 1e-16:
                    break
            res[i] = total * math.exp(-v + a * math.log(v) - head)
        else:
            tiny = 1e-300
            b = v + 1 - a
            c, d = 1 / tiny, 1 / b
            h = d
            for k in range(1, 10_000):
                an = -k * (k - a)
                b += 2
                d = an * d + b
                d = 1 / (d if abs(d) > tiny else tiny)
                c = b + an / c
                c = c if abs(c) > tiny else tiny
                h *= d * c
                if abs(d * c - 1) < 1e-16:
                    break
            res[i] = 1 - h * math.exp(-v + a * math.log(v) - head)
    return np.clip(res.reshape(x.shape), 0, 1)


def gamma_ppf(p, a: float, scale: float = 1.0) -> np.ndarray:
    """Inverse of the gamma distribution function, by bisection on a bracket in logs."""
    p = np.atleast_1d(np.asarray(p, float))
    out = np.empty_like(p)
    for i, q in enumerate(p):
        if q <= 0 or q >= 1:
            out[i] = 0.0 if q <= 0 else math.inf
            continue
        lo, hi = -700.0, math.log(a + 10 * math.sqrt(a) + 50)
        for _ in range(200):
            mid = (lo + hi) / 2
            if gammainc(a, math.exp(mid)) < q:
                lo = mid
            else:
                hi = mid
            if hi - lo < 1e-14 * max(1, abs(mid)):
                break
        out[i] = math.exp((lo + hi) / 2)
    return out * scale


def chi2_sf(x: float, k: float) -> float:
    return float(1 - gammainc(k / 2, x / 2))


def ks_p_value(d: float, n: float, m: float) -> float:
    """Asymptotic two-sample Kolmogorov-Smirnov tail."""
    en = math.sqrt(n * m / (n + m))
    lam = (en + 0.12 + 0.11 / en) * d
    if lam < 0.2:
        return 1.0
    return float(min(1.0, max(0.0, 2 * sum((-1) ** (j - 1) * math.exp(-2 * j * j * lam * lam) for j in range(1, 101)))))


def ks_two_sample(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    a, b = np.sort(a), np.sort(b)
    every = np.concatenate([a, b])
    d = float(np.max(np.abs(np.searchsorted(a, every, "right") / len(a) - np.searchsorted(b, every, "right") / len(b))))
    return d, ks_p_value(d, len(a), len(b))


def shapiro_wilk(x: np.ndarray, counts: np.ndarray | None = None) -> tuple[float, float]:
    """Royston's approximation of W and its p-value for 3 values or more; ``counts``: rows that each entry stands for.

    The approximation of the p-value was fitted up to 5,000 values and is carried on beyond. Scores are
    made a million ranks at a time.
    """
    x, at = np.unique(np.asarray(x, float), return_inverse=True)
    last = np.cumsum(np.bincount(at, counts, len(x)).astype(np.int64))
    n = int(last[-1]) if len(x) else 0
    if n < 3 or len(x) == 1:
        return math.nan, math.nan
    rows = np.diff(last, prepend=0)
    x = x - float(x @ rows) / n
    x1, x2, x3, x4 = x[np.searchsorted(last, [0, 1, n - 2, n - 1], "right")]
    mm = mx = 0.0
    for k in range(0, n, 1_000_000):
        i = np.arange(k, min(n, k + 1_000_000))
        m = norm_ppf((i + 0.625) / (n + 0.25))
        mm, mx = mm + float(m @ m), mx + float(m @ x[np.searchsorted(last, i, "right")])
    m1, m2 = (float(v) for v in norm_ppf((np.array([n, n - 1]) - 0.375) / (n + 0.25)))
    u, c1, c2 = 1 / math.sqrt(n), m1 / math.sqrt(mm), m2 / math.sqrt(mm)
    an = np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, c1], u)
    if n == 3:
        dot = math.sqrt(0.5) * (x4 - x1)
    elif n <= 5:
        phi = (mm - 2 * m1**2) / (1 - 2 * an**2)
        dot = (mx - m1 * (x4 - x1)) / math.sqrt(phi) + an * (x4 - x1)
    else:
        an1 = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, c2], u)
        phi = (mm - 2 * m1**2 - 2 * m2**2) / (1 - 2 * an**2 - 2 * an1**2)
        dot = (mx - m1 * (x4 - x1) - m2 * (x3 - x2)) / math.sqrt(phi) + an * (x4 - x1) + an1 * (x3 - x2)
    stat = min(1.0, float(dot**2 / (rows @ (x * x))))
    if n == 3:
        return stat, max(0.0, 6 / math.pi * (math.asin(math.sqrt(stat)) - math.asin(math.sqrt(0.75))))
    y = math.log(max(1 - stat, 1e-300))
    if n <= 11:
        g = -2.273 + 0.459 * n
        if y >= g:
            return stat, 0.0
        y = -math.log(g - y)
        mu, sd = np.polyval([-0.0006714, 0.025054, -0.39978, 0.5440], n), math.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
    else:
        ln = math.log(n)
        mu, sd = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], ln), math.exp(np.polyval([0.0030302, -0.082676, -0.4803], ln))
    return stat, 1 - NORMAL.cdf((y - mu) / sd)


def nelder_mead(f: Callable[[np.ndarray], float], x0: Sequence[float], step: float = 0.25, max_iter: int = 2000, tol: float = 1e-10) -> tuple[np.ndarray, float]:
    """Minimum of ``f`` from ``x0`` by the downhill simplex."""
    n = len(x0)
    pts = [np.asarray(x0, float)]
    for i in range(n):
        p = pts[0].copy()
        p[i] += step if p[i] == 0 else step * abs(p[i])
        pts.append(p)
    val = [f(p) for p in pts]
    for _ in range(max_iter):
        order = np.argsort(val)
        pts, val = [pts[i] for i in order], [val[i] for i in order]
        if abs(val[-1] - val[0]) <= tol * (abs(val[0]) + tol) and max(np.abs(p - pts[0]).max() for p in pts[1:]) < 1e-8:
            break
        mid = np.mean(pts[:-1], axis=0)
        r = mid + (mid - pts[-1])
        fr = f(r)
        if fr < val[0]:
            e = mid + 2 * (mid - pts[-1])
            fe = f(e)
            pts[-1], val[-1] = (e, fe) if fe < fr else (r, fr)
        elif fr < val[-2]:
            pts[-1], val[-1] = r, fr
        else:
            c = mid + 0.5 * ((r if fr < val[-1] else pts[-1]) - mid)
            fc = f(c)
            if fc < min(fr, val[-1]):
                pts[-1], val[-1] = c, fc
            else:
                pts = [pts[0]] + [pts[0] + 0.5 * (p - pts[0]) for p in pts[1:]]
                val = [val[0]] + [f(p) for p in pts[1:]]
    i = int(np.argmin(val))
    return pts[i], float(val[i])


def golden_section(f: Callable[[float], float], lo: float, hi: float, rounds: int = 80) -> tuple[float, float]:
    """Minimum of a unimodal ``f`` between lo and hi."""
    g = (math.sqrt(5) - 1) / 2
    a, b = hi - g * (hi - lo), lo + g * (hi - lo)
    fa, fb = f(a), f(b)
    for _ in range(rounds):
        if fa < fb:
            hi, b, fb = b, a, fa
            a = hi - g * (hi - lo)
            fa = f(a)
        else:
            lo, a, fa = a, b, fb
            b = lo + g * (hi - lo)
            fb = f(b)
    x = (lo + hi) / 2
    return x, f(x)
