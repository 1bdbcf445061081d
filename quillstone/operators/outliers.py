"""Outliers of a time series against a baseline: trend and season by least squares, residual IQR band.

The baseline is pluggable: a column, or the built-in regression on a trend whose slope may change at
even points of the first four fifths of the span, on the weekday and on yearly Fourier terms; changes
of slope are shrunk, so a straight trend stays straight. Its normal equations are sums, so any series length is one partial aggregate per series; only
the solving of a small system per series is Python.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.operators.clean import iqr_bounds, no_nan


#: Weight per row that shrinks a change of slope, and the regressors that are not shrunk.
SHRINK, PLAIN = 1e-4, 8


def seasonal_terms(t: Column, start: Column, span: Column, fourier: int = 2, changes: int = 0) -> list[Column]:
    """Regressors: constant, position in the span, six weekdays, yearly waves, hinges at ``changes`` even points."""
    secs = F.unix_timestamp(t.cast("timestamp")).cast("double")
    pos = F.coalesce(F.try_divide(secs - start, span), F.lit(0.0))
    year = secs / (365.25 * 86400) * 6.283185307179586
    out = [F.lit(1.0), pos] + [(F.weekday(t) == d).cast("double") for d in range(6)]
    for k in range(1, fourier + 1):
        out += [F.cos(year * k), F.sin(year * k)]
    out += [F.greatest(pos - 0.8 * (k + 1) / (changes + 1), F.lit(0.0)) for k in range(changes)]
    return out


def linear_baseline(df: DataFrame, by: Sequence[str], tcol: str, ycol: str, fourier: int = 2, name: str = "yhat", changes: int = 6) -> DataFrame:
    """``df`` with the fitted value of ridge-stabilised least squares per series."""
    y = no_nan(ycol)
    secs = F.unix_timestamp(F.col(tcol).cast("timestamp")).cast("double")
    ends = df.groupBy(*by).agg(F.min(secs).alias("_t0"), (F.max(secs) - F.min(secs)).alias("_span"))
    rows = df.join(ends, list(by)) if by else df.crossJoin(F.broadcast(ends))  # without series one row
    x = seasonal_terms(F.col(tcol), F.col("_t0"), F.col("_span"), fourier, changes)
    k = len(x)
    shrink = np.array([1e-8] * (PLAIN + 2 * fourier) + [SHRINK] * changes)
    xs = rows.withColumn("_x", F.array(*x))
    get = lambda i: F.get("_x", F.lit(i))
    ok = y.isNotNull()
    sums = [F.coalesce(F.sum(F.when(ok, get(i) * get(j))), F.lit(0.0)) for i in range(k) for j in range(i, k)]
    cross = [F.coalesce(F.sum(F.when(ok, get(i) * y)), F.lit(0.0)) for i in range(k)]
    normal = xs.groupBy(*by).agg(F.array(*sums).alias("xx"), F.array(*cross).alias("xy"), F.count(y).alias("_n"))

    @F.pandas_udf("array<double>")
    def solve(xx: pd.Series, xy: pd.Series, n: pd.Series) -> pd.Series:
        out = []
        for a, b, m in zip(xx, xy, n):
            g = np.zeros((k, k))
            g[np.triu_indices(k)] = a
            g = g + np.triu(g, 1).T
            out.append(np.linalg.solve(g + np.diag(shrink) * max(m, 1), np.asarray(b)).tolist())
        return pd.Series(out)

    beta = normal.select(*by, solve("xx", "xy", "_n").alias("_beta"))
    fit = xs.join(beta, list(by)) if by else xs.crossJoin(F.broadcast(beta))  # without series one row
    pred = F.aggregate(F.zip_with("_x", "_beta", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return fit.withColumn(name, pred).select(*[c for c in df.columns if c != name], name)


def ts_outliers(df: DataFrame, by: Sequence[str], tcol: str, ycol: str, coef: float = 3.0, replace: bool = False, r_val: float = 1.0, ignore_dates: Sequence[str] = (), baseline: str | None = None, min_rows: int = 10) -> tuple[DataFrame, DataFrame]:
    """(``df`` with outliers removed or replaced and ``is_outlier``; per series ``n, pct_outliers``).

    An outlier lies outside the residual IQR band about the baseline. ``replace``: it becomes
    ``r_val`` times the bound plus the rest of the baseline; else it becomes null, other values stay.
    Dates in ``ignore_dates`` are never outliers. Series of ``min_rows`` rows or fewer are unchanged
    with a null share.
    """
    based = df if baseline else linear_baseline(df, by, tcol, ycol, name="_yhat")
    base = F.col(baseline or "_yhat")
    y = no_nan(ycol)
    bands = based.groupBy(*by).agg(iqr_bounds(y - base, coef).alias("_b"), F.count(F.lit(1)).alias("_n"))
    rows = based.join(bands, list(by)) if by else based.crossJoin(F.broadcast(bands))  # without series one row
    upr, lwr = base + F.col("_b.upr"), base + F.col("_b.lwr")
    out = F.coalesce((F.col("_n") > min_rows) & ((y > upr) | (y < lwr)), F.lit(False))
    if ignore_dates:
        out = out & ~F.date_format(F.col(tcol), "yyyy-MM-dd").isin(*ignore_dates)
    bound = F.when(y > upr, upr).otherwise(lwr)
    new = F.when(out, r_val * bound + (1 - r_val) * base if replace else F.lit(None).cast("double")).otherwise(y)
    res = rows.withColumns({"is_outlier": out, "_new": new})
    share = res.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.when(F.max("_n") > min_rows, F.round(100 * F.avg(F.col("is_outlier").cast("double")), 2)).alias("pct_outliers"))
    keep = [F.col("_new").alias(ycol) if c == ycol else F.col(c) for c in df.columns if c != "is_outlier"]
    return res.select(*keep, "is_outlier"), share
