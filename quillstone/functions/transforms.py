"""Variance-stabilising transforms with inverses and unbiased inverses: fit, transform, inverse.

Transforms are column expressions; what is fitted (bounds, lambda, quantile edges) comes from
aggregates. The unbiased inverse of a forecast with variance v in transformed space adds the
second-order term f''(mu) v / 2. Values outside a transform's domain give null.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.operators.clean import no_nan
from quillstone.operators.quantiles import column_quantiles

SQRT_3_2 = math.sqrt(1.5)


def anscombe(y: Column) -> Column:
    """2 sqrt(y + 3/8); null below -3/8."""
    return F.when(y >= -0.375, 2 * F.sqrt(F.greatest(y + 0.375, F.lit(0.0))))


def anscombe_inverse(z: Column) -> Column:
    """Closed-form unbiased inverse; null for negative z."""
    return F.when(z > 0, z * z / 4 - 0.125 + SQRT_3_2 / 4 / z - 11 / 8 / (z * z) + 5 / 8 * SQRT_3_2 / (z * z * z))


def log_transform(y: Column) -> Column:
    return F.when(y >= 0, F.log1p(y))


def log_inverse(z: Column, var: Column | None = None) -> Column:
    out = F.expm1(z)
    return out if var is None else out + var / 2 * F.exp(z)


def logit(y: Column, floor: float, ceiling: float) -> Column:
    """ln(x / (1 - x)) of the position between floor and ceiling; null at or beyond them."""
    x = (y - floor) / (ceiling - floor)
    return F.when((y > floor) & (y < ceiling), F.ln(x / (1 - x)))


def logit_inverse(z: Column, floor: float, ceiling: float, var: Column | None = None) -> Column:
    e = F.exp(-F.abs(z))
    up = F.when(z >= 0, 1 / (1 + e)).otherwise(e / (1 + e))
    out = floor + (ceiling - floor) * up
    return out if var is None else out + var / 2 * (ceiling - floor) * up * (1 - up) * (1 - 2 * up)


def box_cox(y: Column, lmbda: float) -> Column:
    """For y > 0."""
    z = F.ln(y) if abs(lmbda) < 1e-12 else (F.pow(y, F.lit(lmbda)) - 1) / lmbda
    return F.when(y > 0, z)


def box_cox_inverse(z: Column, lmbda: float, var: Column | None = None) -> Column:
    """With ``var`` the unbiased inverse; near lambda 0 by its logarithmic limit."""
    if abs(lmbda) < 1e-12:
        out = F.exp(z)
    else:
        b = lmbda * z + 1
        out = F.when(b > 0, F.pow(b, F.lit(1 / lmbda)))
    if var is None:
        return out
    if abs(lmbda) < 1e-2:
        return out + var / 2 * F.exp(z)
    b = lmbda * z + 1
    return out + F.when(b > 0, var / 2 * (1 - lmbda) * F.pow(b, F.lit(1 / lmbda - 2)))


def yeo_johnson(y: Column, lmbda: float) -> Column:
    pos = F.log1p(F.greatest(y, F.lit(0.0))) if abs(lmbda) < 1e-12 else (F.pow(F.greatest(y, F.lit(0.0)) + 1, F.lit(lmbda)) - 1) / lmbda
    m = 2 - lmbda
    neg = -F.log1p(F.greatest(-y, F.lit(0.0))) if abs(m) < 1e-12 else -(F.pow(F.greatest(-y, F.lit(0.0)) + 1, F.lit(m)) - 1) / m
    return F.when(y >= 0, pos).otherwise(neg)


def yeo_johnson_inverse(z: Column, lmbda: float, var: Column | None = None) -> Column:
    zp, zn = F.greatest(z, F.lit(0.0)), F.greatest(-z, F.lit(0.0))
    m = 2 - lmbda
    if abs(lmbda) < 1e-12:
        pos, pos2 = F.expm1(zp), F.exp(zp)
    else:
        b = F.greatest(lmbda * zp + 1, F.lit(0.0))
        pos = F.when(b > 0, F.pow(b, F.lit(1 / lmbda)) - 1)
        pos2 = F.exp(zp) if abs(lmbda) < 1e-2 else F.when(b > 0, (1 - lmbda) * F.pow(b, F.lit(1 / lmbda - 2)))
    if abs(m) < 1e-12:
        neg, neg2 = -F.expm1(zn), -F.exp(zn)
    else:
        b = F.greatest(m * zn + 1, F.lit(0.0))
        neg = F.when(b > 0, 1 - F.pow(b, F.lit(1 / m)))
        neg2 = -F.exp(zn) if abs(m) < 0.1 else F.when(b > 0, -(1 - m) * F.pow(b, F.lit(1 / m - 2)))
    out = F.when(z >= 0, pos).otherwise(neg)
    return out if var is None else out + var / 2 * F.when(z >= 0, pos2).otherwise(neg2)


def fcast_var(upr: Column, lwr: Column, w: float) -> Column:
    """Variance of a forecast from its interval of width ``w``."""
    q = NormalDist().inv_cdf(1 - (1 - w) / 2)
    return F.pow(F.abs(upr - lwr) / 2 / (q / 2), F.lit(2.0))


def fit_lambda(df: DataFrame, col: str, kind: str = "box-cox", lo: float = -2.0, hi: float = 2.0, rounds: int = 3, grid: int = 17) -> float:
    """The lambda of the largest profile log-likelihood: a grid in one aggregate per round, then narrower ones."""
    y = no_nan(col)
    f = box_cox if kind == "box-cox" else yeo_johnson
    jac = F.ln(y) if kind == "box-cox" else F.signum(y) * F.log1p(F.abs(y))
    rows = df.where(y > 0) if kind == "box-cox" else df.where(y.isNotNull())
    best = 1.0
    for _ in range(rounds):
        step = (hi - lo) / (grid - 1)
        lams = [lo + step * i for i in range(grid)]
        r = rows.agg(F.count(y).alias("n"), F.avg(jac).alias("j"), *[F.var_pop(f(y, lam)).alias(f"v{i}") for i, lam in enumerate(lams)]).first()
        if not r["n"]:
            return 1.0
        scores = [(-0.5 * math.log(r[f"v{i}"]) + (lam - 1) * r["j"], lam) for i, lam in enumerate(lams) if r[f"v{i}"] and r[f"v{i}"] > 0]
        if not scores:
            return 1.0
        best = max(scores)[1]
        lo, hi = best - step, best + step
    return best


@dataclass
class Transform:
    """A fitted transform: 'none', 'anscombe', 'log', 'logistic', 'box-cox', 'yeo-johnson' or 'quantile'.

    ``fit`` reads what it needs from the data; ``transform`` and ``inverse`` map a column. A constant
    or empty column cannot be fitted (ValueError). When the chosen power transform gives a constant,
    the quantile transform takes its place, as ``kind`` then says.
    """

    kind: str = "yeo-johnson"
    floor: float = 0.0
    ceiling: float = 1.0
    n_quantiles: int = 100
    lmbda: float | None = None
    edges: list[float] | None = None
    fitted: bool = False

    def fit(self, df: DataFrame, col: str) -> Transform:
        y = no_nan(col)
        r = df.agg(F.min(y).alias("lo"), F.max(y).alias("hi"), F.count(y).alias("n")).first()
        if not r["n"] or r["lo"] == r["hi"]:
            raise ValueError("a constant or empty column cannot be transformed")
        bad = {"anscombe": r["lo"] < -0.375, "log": r["lo"] < 0, "box-cox": r["lo"] <= 0, "logistic": r["lo"] <= self.floor or r["hi"] >= self.ceiling}
        if bad.get(self.kind):
            raise ValueError(f"values outside the domain of {self.kind}")
        if self.kind in ("box-cox", "yeo-johnson"):
            self.lmbda = fit_lambda(df, col, self.kind)
            f = box_cox if self.kind == "box-cox" else yeo_johnson
            v = df.agg(F.var_pop(f(y, self.lmbda)).alias("v")).first()["v"]
            if not v or v < 1e-300:
                self.kind = "quantile"
        if self.kind == "quantile":
            m = max(2, min(self.n_quantiles, r["n"]))
            self.edges = column_quantiles(df, [col], [i / (m - 1) for i in range(m)])[col]
        self.fitted = True
        return self

    def _check(self) -> None:
        if not self.fitted:
            raise ValueError("fit first")

    def transform(self, y: Column) -> Column:
        self._check()
        y = no_nan(y)
        if self.kind == "quantile":
            return _quantile_scores(self.edges)(y)
        return {"none": lambda: y, "anscombe": lambda: anscombe(y), "log": lambda: log_transform(y), "logistic": lambda: logit(y, self.floor, self.ceiling), "box-cox": lambda: box_cox(y, self.lmbda), "yeo-johnson": lambda: yeo_johnson(y, self.lmbda)}[self.kind]()

    def inverse(self, z: Column, var: Column | None = None) -> Column:
        """The inverse; with the variance in transformed space the unbiased one."""
        self._check()
        z = no_nan(z)
        if self.kind == "quantile":
            back = _quantile_values(self.edges)
            if var is None:
                return back(z)
            h = 0.05
            return back(z) + var / 2 * (back(z + h) - 2 * back(z) + back(z - h)) / (h * h)
        return {"none": lambda: z, "anscombe": lambda: anscombe_inverse(z), "log": lambda: log_inverse(z, var), "logistic": lambda: logit_inverse(z, self.floor, self.ceiling, var), "box-cox": lambda: box_cox_inverse(z, self.lmbda, var), "yeo-johnson": lambda: yeo_johnson_inverse(z, self.lmbda, var)}[self.kind]()


_EPS = 1e-7


def _quantile_scores(edges: Sequence[float]):

    q = np.asarray(edges, float)
    p = np.linspace(0, 1, len(q))

    @F.pandas_udf("double")
    def score(y: pd.Series) -> pd.Series:
        v = y.to_numpy(float)
        # ties take the middle of their probabilities
        u = (np.interp(v, q, p) + (1 - np.interp(-v, -q[::-1], 1 - p[::-1]))) / 2
        inv = NormalDist().inv_cdf
        return pd.Series([None if a != a else inv(min(max(b, _EPS), 1 - _EPS)) for a, b in zip(v, u)], dtype="float64")

    return score


def _quantile_values(edges: Sequence[float]):

    q = np.asarray(edges, float)
    p = np.linspace(0, 1, len(q))

    @F.pandas_udf("double")
    def value(z: pd.Series) -> pd.Series:
        cdf = NormalDist().cdf
        return pd.Series([None if a != a else float(np.interp(cdf(a), p, q)) for a in z.to_numpy(float)], dtype="float64")

    return value
