"""Mixture models per series: EM, hyper-exponential, quantile fits, Prony sums, merged components.

Models are fitted by numpy on one series each; ``fit_groups`` runs any of them per key by
``applyInPandas``, so series are fitted in parallel. Rows are counted by value beforehand, in each task
before the shuffle, and fits take the counts as weights: every row counts, at every size.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions.special import ks_two_sample, nelder_mead
from quillstone.operators.clean import no_nan
from quillstone.stats import families as fam


@dataclass
class Mixture:
    """Components of one family (or several) with weights, and point masses."""

    names: list[str]
    probs: list[float]
    shapes: list[list[float]]
    scales: list[float]
    locations: list[float] = field(default_factory=list)
    masses: dict[float, float] = field(default_factory=dict)
    llf: float = math.nan
    n: int = 0

    def __post_init__(self):
        self.locations = self.locations or [0.0] * len(self.names)
        total = sum(self.probs)
        self.probs = [p / total for p in self.probs] if total > 0 else list(self.probs)

    @property
    def mass(self) -> float:
        return min(1.0, sum(self.masses.values()))

    def cdf(self, x) -> np.ndarray:
        x = np.asarray(x, float)
        cont = sum(p * fam.cdf(n, x, s, c, loc) for n, p, s, c, loc in zip(self.names, self.probs, self.shapes, self.scales, self.locations)) if self.names else 0.0
        return (1 - self.mass) * cont + sum(m * (x >= v) for v, m in self.masses.items())

    def sf(self, x) -> np.ndarray:
        return 1 - self.cdf(x)

    def ppf(self, p) -> np.ndarray:
        """By bisection on the distribution function."""
        out = []
        for q in np.atleast_1d(np.asarray(p, float)):
            ends = [float(fam.ppf(n, np.clip(e, 1e-12, 1 - 1e-12), s, c, loc)) for n, s, c, loc in zip(self.names, self.shapes, self.scales, self.locations) for e in (q * 0.5, 1 - (1 - q) * 1e-3)] + list(self.masses)
            lo, hi = min(ends), max(ends)
            lo -= abs(lo) * 1e-6 + 1e-9
            for _ in range(200):
                mid = (lo + hi) / 2
                lo, hi = (mid, hi) if float(self.cdf(mid)) < q else (lo, mid)
            out.append(hi)
        return np.array(out)

    def mean(self) -> float:
        cont = sum(p * fam.mean_std(n, s, c, loc)[0] for n, p, s, c, loc in zip(self.names, self.probs, self.shapes, self.scales, self.locations))
        return (1 - self.mass) * cont + sum(v * m for v, m in self.masses.items())

    def weighted_std(self) -> float:
        """Sum of weights times deviations of the components (not the deviation of the mixture)."""
        return sum(p * fam.mean_std(n, s, c, loc)[1] for n, p, s, c, loc in zip(self.names, self.probs, self.shapes, self.scales, self.locations))

    def std(self) -> float:
        """Deviation of the mixture."""
        m = self.mean()
        second = 0.0
        for n, p, s, c, loc in zip(self.names, self.probs, self.shapes, self.scales, self.locations):
            mu, sd = fam.mean_std(n, s, c, loc)
            second += p * (sd * sd + mu * mu)
        second = (1 - self.mass) * second + sum(v * v * w for v, w in self.masses.items())
        return math.sqrt(max(0.0, second - m * m))

    def rvs(self, n: int, seed: int = 0) -> np.ndarray:
        rng = np.random.default_rng(seed)
        points = list(self.masses.items())
        weights = np.array([(1 - self.mass) * p for p in self.probs] + [m for _, m in points])
        counts = rng.multinomial(n, weights / weights.sum())
        parts = [fam.rvs(nm, k, rng, s, c, loc) for nm, k, s, c, loc in zip(self.names, counts, self.shapes, self.scales, self.locations)]
        parts += [np.full(k, v) for (v, _), k in zip(points, counts[len(self.names) :])]
        out = np.concatenate(parts) if parts else np.empty(0)
        rng.shuffle(out)
        return out

    def kstest(self, data: np.ndarray, n: int = 1000, seed: int = 0) -> tuple[float, float]:
        return ks_two_sample(np.asarray(data, float), self.rvs(n, seed))

    def aic_bic(self) -> tuple[float, float]:
        k = sum(len(s) + 1 for s in self.shapes) + len(self.probs) - 1
        return 2 * k - 2 * self.llf, k * math.log(max(self.n, 1)) - 2 * self.llf


def prior_penalty(kind: str | None, pars: tuple[float, float], scales: np.ndarray) -> np.ndarray:
    """Log-prior on the rates of exponential components ('gamma' (a, b) or 'laplace' (mu, b)), less its maximum, in scale terms."""
    rate = 1 / scales
    if kind == "gamma":
        a, b = pars
        log_f = (a - 1) * np.log(rate) - b * rate
        top = (a - 1) * math.log((a - 1) / b) - (a - 1) if a > 1 else 0.0
    elif kind == "laplace":
        mu, b = pars
        log_f, top = -np.abs(rate - mu) / b, 0.0
    else:
        return np.zeros_like(scales)
    return log_f - 2 * np.log(scales) - top


def value_counts(data: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order and how often each occurs; ``counts``: of each entry, 1 if not given."""
    x, at = np.unique(np.asarray(data, float), return_inverse=True)
    return x, np.bincount(at, counts, len(x)).astype(np.int64)


def row_range(x: np.ndarray, n: np.ndarray, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Values and counts of the sorted rows from ``start`` to before ``end``; a value's rows may be cut."""
    last = np.cumsum(n)
    kept = np.minimum(last, end) - np.maximum(last - n, start)
    return x[kept > 0], kept[kept > 0]


def quantiles(x: np.ndarray, n: np.ndarray, ps: Sequence[float]) -> np.ndarray:
    """``np.quantile`` of the rows, from distinct values in order and their counts."""
    last = np.cumsum(n)
    at = np.asarray(ps, float) * (last[-1] - 1)
    low = np.floor(at)
    a, b = (x[np.minimum(np.searchsorted(last, k, "right"), len(x) - 1)] for k in (low, low + 1))
    return a + (b - a) * (at - low)


def em(data: np.ndarray, w: int, dist: str = "expon", max_iter: int = 1500, tol: float = 1e-3, least: int = 100, reg: tuple[str, tuple[float, float], float] | None = None, counts: np.ndarray | None = None) -> Mixture | None:
    """Mixture of ``w`` components by expectation-maximization; None if it has not settled after ``max_iter`` steps.

    Starts from the likelihood fits of w equal chunks of the sorted data. Stops when no parameter
    changes by more than ``tol`` of itself, after ``least`` steps. ``reg``: (prior, parameters,
    weight) on the rates of exponential components. ``counts``: rows that each entry stands for.
    """
    x, n = value_counts(data, counts)
    x, n = x[x > 0], n[x > 0]
    rows = int(n.sum())
    if w < 1 or rows < 2 * w:
        return None
    ends = [k * (rows // w) + min(k, rows % w) for k in range(w + 1)]
    chunks = [row_range(x, n, a, b) for a, b in zip(ends, ends[1:])]
    pars = [fam.fit_mle(dist, c, m) if len(c) > 1 else fam.fit_mle(dist, np.append(c, c[0] * 1.01), np.append(m, 1)) for c, m in chunks]
    probs = np.full(w, 1 / w)
    for step in range(max_iter):
        logp = np.log(probs + 1e-300)[:, None] + np.array([fam.logpdf(dist, x, s, c) for s, c in pars])
        top = logp.max(axis=0)
        dens = np.exp(logp - top)
        total = dens.sum(axis=0)
        r = dens / total * n
        new_probs = r.sum(axis=1) / rows
        new = []
        for k in range(w):
            s, c = fam.fit_mle(dist, x, r[k] + 1e-300)
            if reg and dist == "expon":
                kind, pp, lam = reg
                nk, sx = r[k].sum(), float((r[k] * x).sum())
                best, _ = nelder_mead(lambda p: nk * p[0] + sx * math.exp(-p[0]) - lam * float(prior_penalty(kind, pp, np.array([math.exp(p[0])]))[0]), [math.log(c)])
                c = math.exp(best[0])
            new.append((s, c))
        change = max(abs(a - b) / max(abs(b), 1e-12) for (s1, c1), (s0, c0), p1, p0 in zip(new, pars, new_probs, probs) for a, b in [*zip(s1, s0), (c1, c0), (p1, p0)])
        pars, probs = new, new_probs
        if change < tol and step >= least:
            llf = float((n * (np.log(total) + top)).sum())
            return Mixture([dist] * w, list(probs), [list(s) for s, _ in pars], [c for _, c in pars], llf=llf, n=rows)
    return None


def merge_similar(m: Mixture, min_pval: float = 0.1) -> Mixture:
    """Merges components that a two-sample KS test on 1,000 even quantiles of each does not tell apart, closest pair first, until none is left."""
    even = (np.arange(1000) + 0.5) / 1000
    comps = [(n, p, list(s), c, loc) for n, p, s, c, loc in zip(m.names, m.probs, m.shapes, m.scales, m.locations)]
    while len(comps) > 1:
        draws = [fam.ppf(n, even, s, c, loc) for n, _, s, c, loc in comps]
        best = max(((ks_two_sample(draws[i], draws[j])[1], i, j) for i in range(len(comps)) for j in range(i) if comps[i][0] == comps[j][0]), default=(0, 0, 0))
        if best[0] <= min_pval:
            break
        _, i, j = best
        a, b = comps[i], comps[j]
        p = a[1] + b[1]
        mix = lambda u, v: (u * a[1] + v * b[1]) / p
        comps[j] = (a[0], p, [mix(u, v) for u, v in zip(a[2], b[2])], mix(a[3], b[3]), mix(a[4], b[4]))
        comps.pop(i)
    return Mixture([c[0] for c in comps], [c[1] for c in comps], [c[2] for c in comps], [c[3] for c in comps], [c[4] for c in comps], dict(m.masses), m.llf, m.n)


def divide(x: np.ndarray, n: np.ndarray, max_splits: int = 10, max_cv: float = 1.5, min_size: int | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Values in order with their counts in at most ``max_splits`` chunks of rows, each grown until its coefficient of variation reaches ``max_cv``."""
    rows = int(n.sum())
    least = max(int(min_size or 0), rows // max_splits, 2)
    grow = max(1, least // 10)

    def cv(a: int, b: int) -> float:
        c, m = row_range(x, n, a, b)
        mean = float(np.average(c, weights=m))
        return math.sqrt(float(np.average((c - mean) ** 2, weights=m))) / max(mean, 1e-300)

    ends = [0]
    while ends[-1] < rows:
        end = min(rows, ends[-1] + least)
        while end < rows and cv(ends[-1], end) < max_cv:
            end = min(rows, end + grow)
        ends.append(end)
    if len(ends) > 2 and ends[-1] - ends[-2] < least:
        ends.pop(-2)
    return [row_range(x, n, a, b) for a, b in zip(ends, ends[1:])]


def gamma_prior(rates: np.ndarray) -> tuple[float, float] | None:
    """(a, b) of a gamma distribution of rates by likelihood."""
    if len(rates) < 2 or np.ptp(rates) == 0:
        return None
    s, c = fam.fit_mle("gamma", rates)
    return s[0], 1 / c


def laplace_prior(rates: np.ndarray) -> tuple[float, float] | None:
    """(mu, b): median and mean absolute deviation, the likelihood's maximum."""
    if len(rates) < 2:
        return None
    mu = float(np.median(rates))
    b = float(np.mean(np.abs(rates - mu)))
    return (mu, b) if b > 0 else None


def hyper_exp(data: np.ndarray, phases: tuple[int, int] = (1, 4), prior: str | None = "gamma", max_splits: int = 5, max_cv: float = 1.5, counts: np.ndarray | None = None) -> Mixture | None:
    """Mixture of exponentials: EM per chunk, a refit regularised by a prior on the rates found, similar components merged.

    The order of a chunk is the first whose merged components are fewer than the order. Without a
    fit a single exponential of the mean. ``counts``: rows that each entry stands for.
    """
    x, n = value_counts(data, counts)
    x, n = x[x > 0], n[x > 0]
    if not len(x):
        return None
    rows = int(n.sum())
    names, probs, scales = [], [], []
    for chunk, m in divide(x, n, max_splits, max_cv):
        size = int(m.sum())
        best = None
        for w in range(phases[0], phases[1] + 1):
            fit = em(chunk, w, "expon", counts=m)
            if fit is None:
                break
            small = merge_similar(fit)
            best = small
            if len(small.names) < w:
                break
        if best is not None:
            rates = 1 / np.array(best.scales)
            pars = {"gamma": gamma_prior, "laplace": laplace_prior}[prior](rates) if prior and len(rates) > 1 else None
            if pars:
                lreg = float(np.abs(prior_penalty(prior, pars, np.array(best.scales))).sum())
                lam = 0.01 * size * abs(best.llf / (size * max(lreg, 1e-9)))
                best = em(chunk, len(best.names), "expon", reg=(prior, pars, min(lam, size)), counts=m) or best
        comps = zip(best.probs, best.scales) if best else [(1.0, float(np.average(chunk, weights=m)))]
        for p, c in comps:
            names.append("expon")
            probs.append(p * size / rows)
            scales.append(c)
    out = merge_similar(Mixture(names, probs, [[] for _ in names], scales, n=rows))
    with np.errstate(all="ignore"):
        dens = sum(p * np.exp(fam.logpdf("expon", x, [], c)) for p, c in zip(out.probs, out.scales))
        out.llf = float((n * np.log(np.maximum(dens, 1e-300))).sum())
    return out


def prony(t: np.ndarray, y: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and exponents of a sum of exponentials on an even grid, by linear prediction."""
    t, y = np.asarray(t, float), np.asarray(y, float)
    n, h = len(y), t[1] - t[0]
    a = np.column_stack([y[order - 1 - k : n - 1 - k] for k in range(order)])
    coef = np.linalg.lstsq(a, y[order:], rcond=None)[0]
    roots = np.roots(np.concatenate([[1.0], -coef]))
    exps = np.log(roots.astype(complex)) / h
    amp = np.linalg.lstsq(np.exp(np.outer(t - t[0], exps)), y.astype(complex), rcond=None)[0]
    return amp, exps


def quantile_mixture(q: dict[float, float], dist: str, order: int, pmin: float = 0.01) -> Mixture | None:
    """Mixture whose distribution function comes closest (least squares) to the probabilities at given quantiles.

    A failing order is lowered; components with weights of ``pmin`` or less are dropped. None for fewer
    than two distinct increasing quantiles, or when a positive family meets values not positive.
    """
    ps, xs = np.array(sorted(q)), np.array([q[p] for p in sorted(q)])
    if len(ps) < 2 or np.any(np.diff(xs) < 0) or xs[0] == xs[-1] or (dist in fam.POSITIVE and xs[0] <= 0):
        return None
    k = fam.SHAPES[dist]
    while order >= 1:
        parts = np.array_split(xs, order)
        x0 = []
        for part in parts:
            x0 += [0.0] + [0.0] * k + [math.log(max(abs(float(np.mean(part))), 1e-6))]

        def unpack(v: np.ndarray) -> Mixture:
            v = v.reshape(order, k + 2)
            w = np.exp(v[:, 0] - v[:, 0].max())
            return Mixture([dist] * order, list(w / w.sum()), [[float(np.exp(np.clip(s, -6, 6))) for s in row[1:-1]] for row in v], [float(np.exp(np.clip(row[-1], -30, 30))) for row in v])

        best, loss = nelder_mead(lambda v: float(np.mean((unpack(v).cdf(xs) - ps) ** 2)), x0, step=0.5, max_iter=600 * order)
        if np.isfinite(loss):
            m = unpack(best)
            keep = [i for i, p in enumerate(m.probs) if p > pmin]
            if len(keep) == order or order == 1:
                return m
            return Mixture([m.names[i] for i in keep], [m.probs[i] for i in keep], [m.shapes[i] for i in keep], [m.scales[i] for i in keep])
        order -= 1
    return None


def fit_groups(df: DataFrame, by: Sequence[str], col: str, fit: Callable[..., Mixture | None], max_rows: int | None = None, weighted: bool = False) -> DataFrame:
    """``by, n, family, probs, shapes, scales, locations, llf, mean, std`` of a model per group; null parts where none fits.

    Every group is fitted on all its rows; ``max_rows`` no longer changes anything. ``weighted``: ``fit``
    takes distinct values in order and their counts, so a worker holds the distinct values of a group;
    else it takes the rows.
    """
    x = no_nan(col).cast("double")
    rows = df.where(x.isNotNull()).groupBy(*by, (x + F.lit(0.0)).alias("x")).agg(F.count(F.lit(1)).alias("_n"))
    kinds = ", ".join(f"`{b}` {df.schema[b].dataType.simpleString()}" for b in by)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("x")
        v, c = pdf["x"].to_numpy(float), pdf["_n"].to_numpy()
        m = fit(v, c) if weighted else fit(np.repeat(v, c))
        head = [pdf[b].iloc[0] for b in by]
        n = int(c.sum())
        if m is None:
            row = [*head, n, None, None, None, None, None, None, None, None]
        else:
            row = [*head, n, m.names[0] if m.names else None, list(map(float, m.probs)), [list(map(float, s)) for s in m.shapes], list(map(float, m.scales)), list(map(float, m.locations)), m.llf, m.mean(), m.std()]
        return pd.DataFrame([row], columns=[*by, "n", "family", "probs", "shapes", "scales", "locations", "llf", "mean", "std"])

    return rows.groupBy(*by).applyInPandas(run, f"{kinds}, n long, family string, probs array<double>, shapes array<array<double>>, scales array<double>, locations array<double>, llf double, mean double, std double")
