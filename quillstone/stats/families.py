"""Distribution families: distribution function, quantile, mean, deviation, sampling, fitting.

A family is named and has shapes, a location and a scale. ``SHAPES`` gives the number of shapes.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np

from quillstone.functions.special import gamma_ppf, gammainc, golden_section, nelder_mead, norm_cdf, norm_ppf

SHAPES = {
    "expon": 0, "gamma": 1, "lognorm": 1, "weibull_min": 1, "pareto": 1, "norm": 0, "uniform": 0, "logistic": 0, "gumbel_r": 0, "genextreme": 1, "fisk": 1, "rayleigh": 0, "invgauss": 1,
    "fatiguelife": 1, "genpareto": 1, "chi": 1, "chi2": 1, "invgamma": 1, "invweibull": 1, "loglaplace": 1, "lomax": 1, "powerlaw": 1, "maxwell": 0, "halfnorm": 0, "laplace": 0, "cauchy": 0, "gumbel_l": 0,
}
POSITIVE = {"expon", "gamma", "lognorm", "weibull_min", "pareto", "fisk", "rayleigh", "invgauss", "fatiguelife", "genpareto", "chi", "chi2", "invgamma", "invweibull", "loglaplace", "lomax", "powerlaw", "maxwell", "halfnorm"}


def cdf(name: str, x, shapes: Sequence[float] = (), scale: float = 1.0, loc: float = 0.0) -> np.ndarray:
    z = (np.asarray(x, float) - loc) / scale
    zp = np.maximum(z, 0)
    s = shapes[0] if shapes else 0.0
    with np.errstate(all="ignore"):
        if name == "expon":
            return -np.expm1(-zp)
        if name == "gamma":
            return gammainc(s, zp)
        if name == "lognorm":
            return np.where(z > 0, norm_cdf(np.log(np.where(z > 0, z, 1)) / s), 0.0)
        if name == "weibull_min":
            return -np.expm1(-(zp**s))
        if name == "pareto":
            return np.where(z >= 1, 1 - np.maximum(z, 1) ** -s, 0.0)
        if name == "norm":
            return norm_cdf(z)
        if name == "uniform":
            return np.clip(z, 0, 1)
        if name == "logistic":
            return 1 / (1 + np.exp(-z))
        if name == "gumbel_r":
            return np.exp(-np.exp(-z))
        if name == "genextreme":
            if abs(s) < 1e-12:
                return np.exp(-np.exp(-z))
            t = 1 - s * z
            return np.where(t > 0, np.exp(-np.maximum(t, 0) ** (1 / s)), 1.0 if s > 0 else 0.0)
        if name == "fisk":
            return np.where(z > 0, 1 / (1 + np.where(z > 0, z, 1) ** -s), 0.0)
        if name == "rayleigh":
            return -np.expm1(-zp * zp / 2)
        if name == "invgauss":
            y = np.where(z > 0, z, 1)
            return np.where(z > 0, norm_cdf((y / s - 1) / np.sqrt(y)) + np.exp(2 / s) * norm_cdf(-(y / s + 1) / np.sqrt(y)), 0.0)
        y = np.where(z > 0, z, 1.0)
        if name == "fatiguelife":
            return np.where(z > 0, norm_cdf((np.sqrt(y) - 1 / np.sqrt(y)) / s), 0.0)
        if name == "genpareto":
            return 1 - np.maximum(1 + s * zp, 0) ** (-1 / s) if abs(s) > 1e-12 else -np.expm1(-zp)
        if name == "chi":
            return gammainc(s / 2, zp * zp / 2)
        if name == "chi2":
            return gammainc(s / 2, zp / 2)
        if name == "maxwell":
            return gammainc(1.5, zp * zp / 2)
        if name == "invgamma":
            return np.where(z > 0, 1 - gammainc(s, 1 / y), 0.0)
        if name == "invweibull":
            return np.where(z > 0, np.exp(-(y**-s)), 0.0)
        if name == "loglaplace":
            return np.where(z <= 0, 0.0, np.where(z < 1, 0.5 * y**s, 1 - 0.5 * y**-s))
        if name == "lomax":
            return 1 - (1 + zp) ** -s
        if name == "powerlaw":
            return np.clip(zp, 0, 1) ** s
        if name == "halfnorm":
            return 2 * norm_cdf(zp) - 1
        if name == "laplace":
            return np.where(z < 0, 0.5 * np.exp(np.minimum(z, 0)), 1 - 0.5 * np.exp(-zp))
        if name == "cauchy":
            return 0.5 + np.arctan(z) / math.pi
        if name == "gumbel_l":
            return -np.expm1(-np.exp(z))
    raise ValueError(f"unknown family {name}")


def ppf(name: str, p, shapes: Sequence[float] = (), scale: float = 1.0, loc: float = 0.0) -> np.ndarray:
    p = np.asarray(p, float)
    s = shapes[0] if shapes else 0.0
    with np.errstate(all="ignore"):
        if name == "expon":
            z = -np.log1p(-p)
        elif name == "gamma":
            z = gamma_ppf(p, s).reshape(np.shape(p))
        elif name == "lognorm":
            z = np.exp(s * norm_ppf(p))
        elif name == "weibull_min":
            z = (-np.log1p(-p)) ** (1 / s)
        elif name == "pareto":
            z = (1 - p) ** (-1 / s)
        elif name == "norm":
            z = norm_ppf(p)
        elif name == "uniform":
            z = p
        elif name == "logistic":
            z = np.log(p / (1 - p))
        elif name == "gumbel_r":
            z = -np.log(-np.log(p))
        elif name == "genextreme":
            z = -np.log(-np.log(p)) if abs(s) < 1e-12 else (1 - (-np.log(p)) ** s) / s
        elif name == "fisk":
            z = (p / (1 - p)) ** (1 / s)
        elif name == "rayleigh":
            z = np.sqrt(-2 * np.log1p(-p))
        elif name == "invgauss":
            z = np.array([_bisect(lambda x, q=q: float(cdf(name, x, shapes)) - q) for q in np.atleast_1d(p)]).reshape(np.shape(p))
        elif name == "fatiguelife":
            t = s * norm_ppf(p)
            z = ((t + np.sqrt(t * t + 4)) / 2) ** 2
        elif name == "genpareto":
            z = ((1 - p) ** -s - 1) / s if abs(s) > 1e-12 else -np.log1p(-p)
        elif name == "chi":
            z = np.sqrt(2 * gamma_ppf(p, s / 2)).reshape(np.shape(p))
        elif name == "chi2":
            z = 2 * gamma_ppf(p, s / 2).reshape(np.shape(p))
        elif name == "maxwell":
            z = np.sqrt(2 * gamma_ppf(p, 1.5)).reshape(np.shape(p))
        elif name == "invgamma":
            z = 1 / gamma_ppf(1 - p, s).reshape(np.shape(p))
        elif name == "invweibull":
            z = (-np.log(p)) ** (-1 / s)
        elif name == "loglaplace":
            z = np.where(p < 0.5, (2 * p) ** (1 / s), (2 * (1 - p)) ** (-1 / s))
        elif name == "lomax":
            z = (1 - p) ** (-1 / s) - 1
        elif name == "powerlaw":
            z = p ** (1 / s)
        elif name == "halfnorm":
            z = norm_ppf((1 + p) / 2)
        elif name == "laplace":
            z = np.where(p < 0.5, np.log(2 * p), -np.log(2 * (1 - p)))
        elif name == "cauchy":
            z = np.tan(math.pi * (p - 0.5))
        elif name == "gumbel_l":
            z = np.log(-np.log1p(-p))
        else:
            raise ValueError(f"unknown family {name}")
    return loc + scale * z


def _bisect(f, lo: float = 0.0, hi: float = 1.0) -> float:
    while f(hi) < 0 and hi < 1e300:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return (lo + hi) / 2


def mean_std(name: str, shapes: Sequence[float] = (), scale: float = 1.0, loc: float = 0.0) -> tuple[float, float]:
    """Closed form where there is one, else from 4,000 even quantiles."""
    s = shapes[0] if shapes else 0.0
    if name == "expon":
        m, v = 1.0, 1.0
    elif name == "gamma":
        m, v = s, s
    elif name == "lognorm":
        m, v = math.exp(s * s / 2), math.expm1(s * s) * math.exp(s * s)
    elif name == "weibull_min":
        m = math.gamma(1 + 1 / s)
        v = math.gamma(1 + 2 / s) - m * m
    elif name == "norm":
        m, v = 0.0, 1.0
    elif name == "uniform":
        m, v = 0.5, 1 / 12
    elif name == "pareto":
        m = s / (s - 1) if s > 1 else math.inf
        v = s / ((s - 1) ** 2 * (s - 2)) if s > 2 else math.inf
    else:
        x = ppf(name, (np.arange(4000) + 0.5) / 4000, shapes)
        m, v = float(x.mean()), float(x.var())
    return loc + scale * m, scale * math.sqrt(v)


def rvs(name: str, n: int, rng: np.random.Generator, shapes: Sequence[float] = (), scale: float = 1.0, loc: float = 0.0) -> np.ndarray:
    """Seeded draws."""
    if name == "gamma":
        return loc + rng.gamma(shapes[0], scale, n)
    return ppf(name, rng.uniform(1e-12, 1 - 1e-12, n), shapes, scale, loc)


def logpdf(name: str, x: np.ndarray, shapes: Sequence[float], scale: float, loc: float = 0.0) -> np.ndarray:
    """For the families fitted by likelihood: expon, gamma, lognorm, weibull_min, norm."""
    z = (np.asarray(x, float) - loc) / scale
    s = shapes[0] if shapes else 0.0
    with np.errstate(all="ignore"):
        ok = z > 0
        y = np.where(ok, z, 1.0)
        if name == "expon":
            out = -y
        elif name == "gamma":
            out = (s - 1) * np.log(y) - y - math.lgamma(s)
        elif name == "lognorm":
            out = -np.log(y * s * math.sqrt(2 * math.pi)) - np.log(y) ** 2 / (2 * s * s)
        elif name == "weibull_min":
            out = math.log(s) + (s - 1) * np.log(y) - y**s
        elif name == "norm":
            return -z * z / 2 - 0.5 * math.log(2 * math.pi) - math.log(scale)
        else:
            raise ValueError(f"no density of {name}")
        return np.where(ok, out - math.log(scale), -np.inf)


def fit_mle(name: str, x: np.ndarray, w: np.ndarray | None = None) -> tuple[list[float], float]:
    """(shapes, scale) of the largest weighted likelihood, location 0."""
    x = np.asarray(x, float)
    w = np.ones_like(x) if w is None else np.asarray(w, float)
    total = w.sum()
    mean = float((w * x).sum() / total)
    if name == "expon":
        return [], mean
    if name == "lognorm":
        lx = np.log(x)
        mu = float((w * lx).sum() / total)
        return [max(1e-6, math.sqrt(max(0.0, float((w * (lx - mu) ** 2).sum() / total))))], math.exp(mu)
    if name == "gamma":
        gap = max(1e-12, math.log(mean) - float((w * np.log(x)).sum() / total))
        mean_log = math.log(mean) - gap
        f = lambda la: -((math.exp(la) - 1) * mean_log - math.exp(la) - math.lgamma(math.exp(la)) - math.exp(la) * (math.log(mean) - la))
        guess = math.log((3 - gap + math.sqrt((gap - 3) ** 2 + 24 * gap)) / (12 * gap))
        la, _ = golden_section(f, guess - 2, guess + 2)
        return [math.exp(la)], mean / math.exp(la)
    pars, _ = nelder_mead(lambda p: -float((w * logpdf(name, x, [math.exp(p[0])], math.exp(p[1]))).sum()), [0.0, math.log(mean)])
    return [math.exp(pars[0])], math.exp(pars[1])


def from_two_quantiles(name: str, q: dict[float, float], avg: float | None = None) -> tuple[list[float], float] | None:
    """(shapes, scale) of expon, gamma or lognorm through two quantiles; None if there is no such."""
    (p1, x1), (p2, x2) = sorted(q.items())[:2]
    if not (0 < x1 < x2):
        return None
    if name == "expon":
        return [], float(np.mean([x / float(ppf("expon", p)) for p, x in ((p1, x1), (p2, x2))]))
    if name == "lognorm":
        z1, z2 = float(norm_ppf(p1)), float(norm_ppf(p2))
        s = (math.log(x2) - math.log(x1)) / (z2 - z1)
        return [s], math.exp(math.log(x1) - s * z1)
    if name == "gamma":
        want = math.log(x2 / x1)
        lo, hi = math.log(1e-3), math.log(1e5)
        ratio = lambda a: math.log(float(gamma_ppf(p2, a)[0]) / max(float(gamma_ppf(p1, a)[0]), 1e-300))
        for _ in range(80):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if ratio(math.exp(mid)) > want else (lo, mid)
        a = math.exp((lo + hi) / 2)
        return [a], x1 / float(gamma_ppf(p1, a)[0])
    raise ValueError(f"no two-quantile fit of {name}")
