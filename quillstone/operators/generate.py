"""Synthetic time series as column expressions: trend, level, seasons, events, power transforms, bounds.

Random numbers come from hashes of the position and a seed, so a series is the same whatever the
partitioning. Change points and the season's weights are few and drawn on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.functions.transforms import yeo_johnson
from quillstone.stats.density import hash_uniform

TWO_PI = 6.283185307179586


def normal(seed: int, *keys: Column) -> Column:
    """Standard normal draws by Box and Muller from two hashes."""
    u = F.greatest(hash_uniform(seed, *keys), F.lit(1e-300))
    return F.sqrt(-2 * F.ln(u)) * F.cos(TWO_PI * hash_uniform(seed + 1, *keys))


def fourier(t: Column, period: float, order: int, beta: Sequence[float] | None = None) -> Column:
    """Sum of ``order`` cosine and sine terms with weights ``beta`` (cosines first; default 1)."""
    beta = list(beta) if beta is not None else [1.0] * (2 * order)
    terms = [float(beta[k - 1]) * F.cos(t * (TWO_PI * k / period)) + float(beta[order + k - 1]) * F.sin(t * (TWO_PI * k / period)) for k in range(1, order + 1)]
    return reduce(lambda a, b: a + b, terms)


def seasonal(t: Column, n_pts: int, seasons: Sequence[tuple[str, float, int]], seed: int = 0) -> Column | None:
    """Sum of random seasons (name, period, order); None if there are fewer than two of the longest period."""
    if not seasons or n_pts < 2 * max(p for _, p, _ in seasons):
        return None
    rng = np.random.default_rng(seed)
    return reduce(lambda a, b: a + b, [fourier(t, p, k, rng.normal(size=2 * k)) for _, p, k in seasons])


def parameter(t: Column, breaks: Sequence[int], theta: Sequence[float], bleed: float = 0.0) -> Column:
    """A piecewise parameter: ``theta[i]`` from the i-th change point on, drifting geometrically after the first."""
    out = F.lit(float(theta[0]))
    for i, b in enumerate(breaks):
        out = F.when(t >= b, float(theta[i + 1]) * F.pow(F.lit(1 + bleed), (t - b).cast("double"))).otherwise(out)
    return out


def events(t: Column, periods: Sequence[int], seed: int = 0, window: int = 0) -> Column:
    """Spikes of |N(0, 1)| once per period from a random start, spread over ``window`` points to both sides."""
    rng = np.random.default_rng(seed)
    out = F.lit(0.0)
    for k, p in enumerate(periods):
        start = int(rng.integers(0, p))
        for off in range(-window, window + 1):
            at = t - off
            out = out + F.when((F.pmod(at - start, F.lit(p)) == 0) & (at >= start), F.abs(normal(seed + 17 * (k + 1), at))).otherwise(0.0)
    return out


def bounded(z: Column, floor: float, ceiling: float) -> Column:
    """Logistic squash into (floor, ceiling), stable for large z."""
    e = F.exp(-F.abs(z))
    return floor + (ceiling - floor) * F.when(z >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


#: Coefficients of Acklam's rational approximation of the normal quantile (relative error below 1.2e-9): centre, tail.
_CENTRE = ((-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239), (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0))
_TAIL = ((-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783), (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0))


def normal_quantile(u: Column) -> Column:
    """Standard normal quantile of u in (0, 1) as an expression."""
    horner = lambda cs, x: reduce(lambda a, c: a * x + c, cs[1:], F.lit(cs[0]))
    p = F.least(F.greatest(u, F.lit(1e-300)), F.lit(1 - 2.0**-53))
    near = F.least(p, 1 - p)
    q = F.sqrt(-2 * F.ln(near))
    tail = horner(_TAIL[0], q) / horner(_TAIL[1], q)
    d = p - 0.5
    centre = d * horner(_CENTRE[0], d * d) / horner(_CENTRE[1], d * d)
    return F.when(near >= 0.02425, centre).otherwise(F.when(p < 0.5, tail).otherwise(-tail))


def poisson(rate: Column, u: Column, most: int = 150) -> Column:
    """Poisson draws by inversion of the distribution at u: summed up to a rate of 50, above it by its Cornish-Fisher expansion.

    The expansion takes in skewness and kurtosis; above a rate of 50 it is within a hundredth of the
    quantile, so a draw differs from the exact inverse by one at most, and rarely.
    """
    small = F.aggregate(
        F.sequence(F.lit(1), F.lit(most)),
        F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("c"), F.lit(0.0).alias("k")),
        lambda a, i: F.struct((a["p"] * rate / i).alias("p"), (a["c"] + a["p"] * rate / i).alias("c"), F.when(a["c"] < u, i.cast("double")).otherwise(a["k"]).alias("k")),
    )["k"]
    z = normal_quantile(u)
    at = rate + F.sqrt(rate) * z + (z * z - 1) / 6 - (z * z * z - z) / (72 * F.sqrt(rate))
    return F.when(rate <= 50, small).otherwise(F.greatest(F.lit(0.0), F.ceil(at - 0.5).cast("double")))


def time_series(spark: SparkSession, n_pts: int, seasonalities: Sequence[tuple[str, float, int]] = (), event: Sequence[int] = (), t_size: int = 3, bounds: tuple[float, float] | None = None, trend_cpt: int = -1, level_cpt: int = -1, noise: float = 0.0, bleed: float = 0.0, seed: int = 0) -> DataFrame:
    """``t, season, event, trend, level, y``.

    ``trend_cpt``/``level_cpt``: number of change points, -1 for none (zero). The sum goes through
    |t_size| Yeo-Johnson transforms with random lambdas (-2..2, or 1.5..3 for a negative number; none
    for 0) and into ``bounds``.
    """
    rng = np.random.default_rng(seed)
    t = F.col("t")
    df = spark.range(n_pts).select(F.col("id").alias("t"))
    # one series of n points is one window: its length is the caller's
    whole = Window.partitionBy(F.lit(0))
    upto = whole.orderBy("t").rowsBetween(Window.unboundedPreceding, 0)

    def breaks(n: int) -> list[int]:
        return sorted(int(b) for b in rng.integers(10, max(11, n_pts - 10), n))

    season = seasonal(t, n_pts, seasonalities, seed) if seasonalities else None
    df = df.withColumn("season", season if season is not None else F.lit(0.0)).withColumn("season", F.col("season") - F.avg("season").over(whole))
    df = df.withColumn("event", events(t, [p for p in event if p <= n_pts], seed) if event else F.lit(0.0))
    for name, n, draw in (("trend", trend_cpt, lambda k: rng.normal(0, 0.5, k)), ("level", level_cpt, lambda k: rng.exponential(5, k))):
        if n < 0:
            df = df.withColumn(name, F.lit(0.0))
            continue
        b = breaks(n)
        th = parameter(t, b, draw(len(b) + 1), bleed)
        if noise > 0:
            e = normal(seed + (31 if name == "trend" else 37), t) * (5 * noise)
            th = th + (F.abs(e) if name == "level" else e)
        df = df.withColumn("_th", th)
        if name == "trend":
            df = df.withColumn("trend", F.sum("_th").over(upto))
        else:
            df = df.withColumn("level", poisson(F.greatest(F.col("_th"), F.lit(0.0)), hash_uniform(seed + 41, t))).withColumn("level", F.col("level") - F.avg("level").over(whole))
        df = df.drop("_th")
    y = F.col("season") + F.col("event") + F.col("trend") + F.col("level")
    lambdas = rng.uniform(-2, 2, t_size) if t_size > 0 else rng.uniform(1.5, 3, -t_size) if t_size < 0 else []
    df = df.withColumn("y", y)
    for lam in lambdas:
        df = df.withColumn("y", yeo_johnson(F.col("y"), float(lam)))
    return df.withColumn("y", bounded(F.col("y"), *bounds)) if bounds else df
