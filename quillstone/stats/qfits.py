"""One distribution per series from five quantiles and the mean: exponential, gamma, lognormal.

The mean is held; one shape is searched so that the model's quantiles come close to the given ones
(mean squared relative error), with a penalty on the shape. Several penalties are tried and the fit
of the smallest error without penalty is kept. A row with a quantile or mean that is not positive
and finite has no fit.

Exponential and lognormal quantiles are closed forms, so those fits are numpy over whole batches;
gamma quantiles come from a table of standard quantiles by shape, built once per worker. All fits
run in ``mapInPandas``, one narrow pass, no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions.special import gamma_ppf, norm_ppf
from quillstone.operators.clean import no_nan

QUANTILES = {"q10": 0.10, "q25": 0.25, "q50": 0.50, "q75": 0.75, "q90": 0.90}
# Weights of the penalty on the shape.
GAMMA_PENALTIES = (1.0, 0.1, 0.01, 0.001, 0.0001, 0.00001)
LOGNORM_PENALTIES = (*GAMMA_PENALTIES, 0.000001, 0.0)


def quantile_dict(hat: bool = False):
    """Map column {probability: quantile} of a row."""
    return F.create_map(*[x for c, p in QUANTILES.items() for x in (F.lit(p), F.col(f"{c}hat" if hat else c).cast("double"))])


def expon_qfit(df: DataFrame, avg: str = "y") -> DataFrame:
    """``df`` with ``dist_name, order, par_rate, mdl_std``: the rate 1 / mean, which also stands in ``mdl_std``."""
    rate = F.try_divide(F.lit(1.0), no_nan(avg))
    return df.withColumns({"dist_name": F.lit("expon"), "order": F.lit(1), "par_rate": rate, "mdl_std": rate})


@lru_cache(maxsize=1)
def _gamma_table() -> tuple[np.ndarray, np.ndarray]:
    """Log shapes and quantiles of gamma distributions of mean 1."""
    la = np.linspace(np.log(1e-2), np.log(2e4), 600)
    ps = list(QUANTILES.values())
    return la, np.array([gamma_ppf(ps, float(a)) / a for a in np.exp(la)])


def _best_shapes(target: np.ndarray, grid: np.ndarray, model: np.ndarray, penalties: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row of relative quantiles: grid value, error and penalty of the best fit."""
    err = ((1 - model[None, :, :] / target[:, None, :]) ** 2).mean(axis=2)
    best = np.full(len(target), np.inf)
    shape, reg = np.full(len(target), np.nan), np.full(len(target), np.nan)
    rows = np.arange(len(target))
    for r in penalties:
        i = (err + r * grid[None, :]).argmin(axis=1)
        # parabola through the neighbours, within the cell
        j = np.clip(i, 1, len(grid) - 2)
        cost = lambda k: err[rows, k] + r * grid[k]
        a, b, c = cost(j - 1), cost(j), cost(j + 1)
        bend = a - 2 * b + c
        off = np.clip(np.where(bend > 0, 0.5 * (a - c) / np.where(bend > 0, bend, 1), 0), -0.5, 0.5)
        near = np.exp(np.log(grid[j]) + off * (np.log(grid[j + 1]) - np.log(grid[j])))
        e = err[rows, j]
        won = e < best
        best, shape, reg = np.where(won, e, best), np.where(won, near, shape), np.where(won, r, reg)
    return shape, best, reg


def _fit(df: DataFrame, avg: str, hat: bool, name: str) -> DataFrame:
    cols = [f"{c}hat" if hat else c for c in QUANTILES]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        z = norm_ppf(list(QUANTILES.values()))
        for pdf in batches:
            q, m = pdf[cols].to_numpy(float), pdf[avg].to_numpy(float)
            ok = np.isfinite(q).all(axis=1) & (q > 0).all(axis=1) & np.isfinite(m) & (m > 0)
            out = pdf.assign(dist_name=name, par_shape=np.nan, par_scale=np.nan, err=np.nan, reg=np.nan, mdl_std=np.nan)
            idx = np.flatnonzero(ok)
            for lo in range(0, len(idx), 500):
                i = idx[lo : lo + 500]
                t = q[i] / m[i, None]
                if name == "gamma":
                    la, model = _gamma_table()
                    sh, err, reg = _best_shapes(t, np.exp(la), model, GAMMA_PENALTIES)
                    sc, sd = m[i] / sh, m[i] / np.sqrt(sh)
                else:
                    s = np.exp(np.linspace(np.log(1e-3), np.log(10), 600))
                    sh, err, reg = _best_shapes(t, s, np.exp(s[:, None] * z[None, :] - s[:, None] ** 2 / 2), LOGNORM_PENALTIES)
                    sc, sd = m[i] * np.exp(-sh * sh / 2), m[i] * np.sqrt(np.expm1(sh * sh))
                for c, v in (("par_shape", sh), ("par_scale", sc), ("err", err), ("reg", reg), ("mdl_std", sd)):
                    out.iloc[i, out.columns.get_loc(c)] = v
            yield out

    clean = df.select(*[c for c in df.columns if c not in [*cols, avg]], *[F.col(c).cast("double").alias(c) for c in [*cols, avg]])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in clean.schema.fields)
    out = clean.mapInPandas(run, f"{schema}, dist_name string, par_shape double, par_scale double, err double, reg double, mdl_std double")
    nums = ["par_shape", "par_scale", "err", "reg", "mdl_std"]
    return out.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in nums})


def gamma_qfit(df: DataFrame, avg: str = "y", hat: bool = False) -> DataFrame:
    """``df`` with ``dist_name, par_shape, par_scale, err, reg, mdl_std`` of the gamma fit, null without one."""
    return _fit(df, avg, hat, "gamma")


def lognorm_qfit(df: DataFrame, avg: str = "y", hat: bool = False) -> DataFrame:
    """As ``gamma_qfit`` for the lognormal."""
    return _fit(df, avg, hat, "lognorm")
