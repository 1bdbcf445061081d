"""Forecast errors as aggregates of actual and forecast columns; residual tests.

All errors are mergeable aggregates (medians apart), so they run per group over any data. Shifted
errors need an order: give the columns of the next actual and forecast (``with_leads``). Rows with a
null or NaN on either side do not count. An undefined error is null.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.operators.clean import no_nan


def _pair(y, yhat, cond: Column | None = None) -> tuple[Column, Column]:
    a, b = no_nan(y), no_nan(yhat)
    ok = a.isNotNull() & b.isNotNull()
    if cond is not None:
        ok = ok & cond
    return F.when(ok, a), F.when(ok, b)


def smape(y, yhat) -> Column:
    """Mean of |y - yhat| / (|y + yhat| / 2), over rows where that is defined."""
    a, b = _pair(y, yhat)
    return F.avg(F.try_divide(F.abs(a - b), F.abs(a + b) / 2))


def smape_nonzero(y, yhat) -> Column:
    """As ``smape`` over rows where neither is zero."""
    a, b = _pair(y, yhat, (no_nan(y) * no_nan(yhat)) != 0)
    return 2 * F.avg(F.try_divide(F.abs(a - b), F.abs(a + b)))


def rmse(y, yhat) -> Column:
    a, b = _pair(y, yhat)
    return F.sqrt(F.avg((a - b) * (a - b)))


def rms(x) -> Column:
    """Root mean square of residuals; any null or NaN makes it infinite."""
    v = no_nan(x)
    return F.when(F.count_if(v.isNull()) > 0, F.lit(float("inf"))).otherwise(F.sqrt(F.avg(v * v)))


def mape(y, yhat) -> Column:
    """Mean of |1 - yhat / y| over rows with y other than 0."""
    a, b = _pair(y, yhat, no_nan(y) != 0)
    return F.avg(F.abs(a - b) / F.nullif(F.abs(a), F.lit(0.0)))


def median_ape(y, yhat) -> Column:
    a, b = _pair(y, yhat, no_nan(y) != 0)
    return F.median(F.abs(a - b) / F.nullif(F.abs(a), F.lit(0.0)))


def wmape(y, yhat, drop_zero: bool = True) -> Column:
    """Sum of |yhat - y| over sum of |y|; rows with y = 0 are left out unless told otherwise."""
    a, b = _pair(y, yhat, (no_nan(y) != 0) if drop_zero else None)
    return F.try_divide(F.sum(F.abs(a - b)), F.sum(F.abs(a)))


def lar(y, yhat) -> Column:
    """Mean of ln(yhat / y) over rows with both of one sign."""
    a, b = _pair(y, yhat, (no_nan(y) * no_nan(yhat)) > 0)
    return F.avg(F.ln(F.try_divide(b, a)))


def sqrt_mape(y, yhat) -> Column:
    """``mape`` of the square roots of non-negative values."""
    ok = (no_nan(y) >= 0) & (no_nan(yhat) >= 0)
    return mape(F.when(ok, F.sqrt(F.abs(no_nan(y)))), F.when(ok, F.sqrt(F.abs(no_nan(yhat)))))


def boxcox_mape(y, yhat, lmbda: float) -> Column:
    from quillstone.functions.transforms import box_cox

    return mape(box_cox(no_nan(y), lmbda), box_cox(no_nan(yhat), lmbda))


def yeo_johnson_mape(y, yhat, lmbda: float) -> Column:
    from quillstone.functions.transforms import yeo_johnson

    return mape(yeo_johnson(no_nan(y), lmbda), yeo_johnson(no_nan(yhat), lmbda))


def yeo_johnson_error(y, yhat, lmbda: float) -> Column:
    """Mean transformed error."""
    from quillstone.functions.transforms import yeo_johnson

    a, b = _pair(y, yhat)
    return F.avg(yeo_johnson(b - a, lmbda))


def group_mad(df: DataFrame, by: Sequence[str], col: str) -> DataFrame:
    """``by, mad``: unscaled median absolute deviation, by two aggregates."""
    v = no_nan(col)
    med = df.groupBy(*by).agg(F.median(v).alias("_m"))
    return df.join(med, list(by)).groupBy(*by).agg(F.median(F.abs(v - F.col("_m"))).alias("mad"))


def with_leads(df: DataFrame, by: Sequence[str], order: str, y: str, yhat: str, shift: int = 1) -> DataFrame:
    """``df`` without incomplete rows, with ``_y_next`` and ``_yhat_next``, ``shift`` rows ahead in each group."""
    ok = df.where(no_nan(y).isNotNull() & no_nan(yhat).isNotNull())
    w = Window.partitionBy(*by).orderBy(order)
    return ok.withColumns({"_y_next": F.lead(y, shift).over(w), "_yhat_next": F.lead(yhat, shift).over(w)})


def mase(y: str, yhat: str, shift: int = 1) -> Column:
    """Mean |yhat - y| over mean |next y - y|; with a constant series infinite, or NaN if exact; needs ``with_leads``."""
    num, den = F.avg(F.abs(F.col(yhat) - F.col(y))), F.avg(F.abs(F.col("_y_next") - F.col(y)))
    value = F.when(den == 0, F.when(num == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))).otherwise(F.try_divide(num, den))
    return F.when(F.count(F.lit(1)) > shift // 2, value)


def thiel_u(y: str, yhat: str, shift: int = 1) -> Column:
    """Square root of mean ((next yhat - next y) / y)² over mean ((next y - y) / y)²; needs ``with_leads``."""
    e = F.try_divide(F.col("_yhat_next") - F.col("_y_next"), F.col(y))
    d = F.try_divide(F.col("_y_next") - F.col(y), F.col(y))
    num, den = F.avg(e * e), F.avg(d * d)
    value = F.when(den == 0, F.when(num == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))).otherwise(F.sqrt(F.try_divide(num, den)))
    return F.when(F.count(F.lit(1)) > shift // 2, value)


ERRORS = {"sMAPE": smape_nonzero, "RMSE": rmse, "MAPE": mape, "mMAPE": median_ape, "wMAPE": lambda y, h: wmape(y, h, False), "LAR": lar, "SR": sqrt_mape}


def err_func(df: DataFrame, y: str, yhat: str, etype: str, by: Sequence[str] = (), order: str | None = None, lmbda: float = 0.5) -> DataFrame:
    """``by, error`` of the type named; null where all actuals are zero."""
    if etype == "MASE":
        if order is None:
            raise ValueError("MASE needs an order")
        kept = with_leads(df.where(no_nan(y) != 0), by, order, y, yhat)
        return kept.groupBy(*by).agg(F.when(F.count(F.lit(1)) > 1, mase(y, yhat)).alias("error"))
    special = {"BC": lambda a, b: boxcox_mape(a, b, lmbda), "YJ": lambda a, b: yeo_johnson_mape(a, b, lmbda), "YJd": lambda a, b: yeo_johnson_error(a, b, lmbda)}
    f = (ERRORS | special)[etype]
    return df.groupBy(*by).agg(F.when(F.max(F.abs(no_nan(y))) > 0, f(y, yhat)).alias("error"))


def k2_statistic(n: Column, skew: Column, kurt: Column) -> Column:
    """D'Agostino's K² from count, population skewness and excess kurtosis; needs n >= 8."""
    n = n.cast("double")
    y = skew * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta2 = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (beta2 - 1)) - 1
    delta, alpha = 1 / F.sqrt(0.5 * F.ln(w2)), F.sqrt(2 / (w2 - 1))
    z1 = delta * F.ln(y / alpha + F.sqrt((y / alpha) * (y / alpha) + 1))
    e = 3 * (n - 1) / (n + 1)
    var = 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (kurt + 3 - e) / F.sqrt(var)
    sqrt_b1 = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / sqrt_b1 * (2 / sqrt_b1 + F.sqrt(1 + 4 / (sqrt_b1 * sqrt_b1)))
    den = 1 + x * F.sqrt(2 / (a - 4))
    term = F.signum(den) * F.pow(F.abs((1 - 2 / a) / den), 1 / 3)
    z2 = (1 - 2 / (9 * a) - term) / F.sqrt(2 / (9 * a))
    return F.when(n >= 8, z1 * z1 + z2 * z2)


def ljung_box(df: DataFrame, by: Sequence[str], order: str, col: str, lags: int = 10) -> DataFrame:
    """``by, n, lb`` with the Ljung-Box statistic over lags 1 to ``lags``."""
    keyed = by or ["_all"]
    rows = df if by else df.withColumn("_all", F.lit(0))
    x = no_nan(col)
    mean = rows.groupBy(*keyed).agg(F.avg(x).alias("_m"))
    w = Window.partitionBy(*keyed).orderBy(order)
    r = rows.where(x.isNotNull()).join(mean, list(keyed)).withColumn("_d", x - F.col("_m"))
    r = r.withColumns({f"_p{k}": F.col("_d") * F.lag("_d", k).over(w) for k in range(1, lags + 1)})
    n, var = F.count(F.lit(1)).cast("double"), F.sum(F.col("_d") * F.col("_d"))
    q = F.lit(0.0)
    for k in range(1, lags + 1):
        rho = F.try_divide(F.coalesce(F.sum(f"_p{k}"), F.lit(0.0)), var)
        q = q + F.try_divide(rho * rho, n - k)
    out = r.groupBy(*keyed).agg(n.cast("long").alias("n"), (n * (n + 2) * q).alias("lb"))
    return out if by else out.drop("_all")


def white_noise_test(df: DataFrame, by: Sequence[str], order: str, col: str, p_thres: float = 0.05, lags: int = 10) -> DataFrame:
    """``by, n, k2, p_k2, shapiro_p, lb, p_lb, is_white``: normal by K² and Shapiro-Wilk, uncorrelated by Ljung-Box.

    All three tests judge every group, whatever its size. A test that can't be made (fewer than 3 values
    for Shapiro-Wilk, 8 for K², or all equal) is null, and so is ``is_white`` unless another test fails.
    """

    from quillstone.functions.special import chi2_sf, shapiro_wilk

    keyed = list(by) or ["_all"]
    rows = df if by else df.withColumn("_all", F.lit(0))
    x = no_nan(col)
    mom = rows.groupBy(*keyed).agg(F.count(x).alias("n"), F.skewness(x).alias("sk"), F.kurtosis(x).alias("ku"))
    mom = mom.withColumn("k2", k2_statistic(F.col("n"), F.col("sk"), F.col("ku"))).withColumn("p_k2", F.exp(-F.col("k2") / 2))
    lb = ljung_box(rows, keyed, order, col, lags).drop("n")
    fit = rows.where(x.isNotNull()).groupBy(*keyed, (x.cast("double") + F.lit(0.0)).alias("x")).agg(F.count(F.lit(1)).alias("_n"))

    def shapiro(pdf: pd.DataFrame) -> pd.DataFrame:
        p = shapiro_wilk(pdf["x"].to_numpy(), pdf["_n"].to_numpy())[1]
        return pd.DataFrame([[*pdf[keyed].iloc[0], None if math.isnan(p) else p]], columns=[*keyed, "shapiro_p"])

    schema = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keyed)
    sw = fit.groupBy(*keyed).applyInPandas(shapiro, f"{schema}, shapiro_p double")

    @F.pandas_udf("double")
    def tail(q: pd.Series) -> pd.Series:
        return q.map(lambda v: chi2_sf(v, lags) if v == v else math.nan)

    out = mom.join(lb, keyed).join(sw, keyed, "left").withColumn("p_lb", tail("lb"))
    white = (F.col("p_k2") > p_thres) & (F.col("shapiro_p") > p_thres) & (F.col("p_lb") > p_thres)
    return out.select(*([k for k in keyed if k != "_all"]), "n", "k2", "p_k2", "shapiro_p", "lb", "p_lb", white.alias("is_white"))
