"""Densities, empirical distributions, bootstrap, survival curves, and two-sample tests."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.special import ks_p_value
from quillstone.operators.clean import no_nan
from quillstone.operators.quantiles import column_quantiles, running_sums

TWO_PI = 6.283185307179586


def to_probs(q: Column) -> Column:
    """Squares of an array's values scaled to sum 1; null if all are zero."""
    sq = F.transform(q, lambda x: x * x)
    total = F.aggregate(sq, F.lit(0.0), lambda a, x: a + x)
    return F.when(total > 0, F.transform(sq, lambda x: x / total))


def hash_uniform(seed: int, *keys: Column) -> Column:
    """In [0, 1), the same for a key whatever the partitioning."""
    return F.xxhash64(*keys, F.lit(seed)).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))


def sim_ecdf(df: DataFrame, x: str, q_vals: Sequence[float]) -> DataFrame:
    """``q, x``: quantiles of the listed points (each with the same weight), linearly interpolated."""
    got = column_quantiles(df, [x], [float(q) for q in q_vals])[x] or [None] * len(q_vals)
    return df.sparkSession.createDataFrame([(float(q), v) for q, v in zip(q_vals, got)], "q double, x double")


def sim_ecdf_draws(df: DataFrame, x: str, n: int, seed: int = 0) -> DataFrame:
    """``i, x``: n seeded draws from the points, by inversion on a fine quantile grid."""
    grid = df.sparkSession.createDataFrame([(column_quantiles(df, [x], [i / 1000 for i in range(1001)])[x],)], "v array<double>")
    u = hash_uniform(seed, F.col("id")) * 1000
    i = F.floor(u).cast("int")
    draws = df.sparkSession.range(n).crossJoin(F.broadcast(grid))  # one row
    return draws.select(F.col("id").alias("i"), (F.get("v", i) + (u - i) * (F.get("v", i + 1) - F.get("v", i))).alias("x"))


def bootstrap(df: DataFrame, cols: Sequence[str], key: str, sple_fraction: float = 0.5, n_iters: int = 1000, ci: float = 0.95, seed: int = 0) -> DataFrame:
    """Rows ``col, mean, std, l_ci, h_ci`` of the means of resamples with replacement.

    Poisson bootstrap: a row occurs in a resample a Poisson(``sple_fraction``) number of times, drawn
    from the hash of its key and the iteration. Draws are summed per iteration in each task, so only
    ``n_iters`` sums of a task are shuffled.
    """
    import math

    probs, p = [], math.exp(-sple_fraction)
    total = 0.0
    for k in range(12):
        total += p
        probs.append(total)
        p *= sple_fraction / (k + 1)
    u = hash_uniform(seed, F.col("_k"), F.col("_it"))
    times = F.lit(0)
    for c in probs:
        times = times + (u > c).cast("int")
    draws = df.select(F.col(key).alias("_k"), *[no_nan(c).alias(f"_x{i}") for i, c in enumerate(cols)], F.explode(F.sequence(F.lit(0), F.lit(n_iters - 1))).alias("_it")).withColumn("_n", times)
    sums = [F.try_divide(F.sum(F.when(F.col(f"_x{i}").isNotNull(), F.col(f"_x{i}") * F.col("_n"))), F.sum(F.when(F.col(f"_x{i}").isNotNull(), F.col("_n"))).cast("double")).alias(f"_m{i}") for i in range(len(cols))]
    means = draws.groupBy("_it").agg(*sums)
    e = (1 - ci) / 2
    parts = [means.select(F.lit(c).alias("col"), F.col(f"_m{i}").alias("m")) for i, c in enumerate(cols)]
    long = parts[0]
    for q in parts[1:]:
        long = long.unionByName(q)
    return long.groupBy("col").agg(F.avg("m").alias("mean"), F.stddev_samp("m").alias("std"), F.percentile("m", F.lit(e)).alias("l_ci"), F.percentile("m", F.lit(1 - e)).alias("h_ci"))


def kde(df: DataFrame, x: str, grid: Sequence[float], bandwidth: float | None = None, digits: int | None = None) -> DataFrame:
    """``x, pdf, cdf`` of a Gaussian kernel estimate on a grid; the cdf is the normalised running sum of pdf times spacing.

    Every row adds its kernel to one sum per grid point, so nothing is multiplied out. With
    ``digits`` equal rounded values are counted first. Without a bandwidth Silverman's rule is used.
    """
    v = no_nan(x)
    rows = df.select(v.alias("v")).where("v is not null")
    rows = rows.groupBy(F.round("v", digits).alias("v")).agg(F.count(F.lit(1)).alias("w")) if digits is not None else rows.withColumn("w", F.lit(1))
    if bandwidth is None:
        r = rows.agg(F.sum("w").alias("n"), F.sum(F.col("v") * F.col("w")).alias("s"), F.sum(F.col("v") * F.col("v") * F.col("w")).alias("q")).first()
        sd = max(r["q"] / r["n"] - (r["s"] / r["n"]) ** 2, 0.0) ** 0.5 if r["n"] else 1.0
        bandwidth = 1.06 * (sd or 1.0) * max(r["n"] or 1, 1) ** -0.2
    pts = [float(g) for g in grid]
    sums = [(F.sum(F.col("w") * F.exp(-((F.lit(g) - F.col("v")) * (F.lit(g) - F.col("v"))) / (2 * bandwidth * bandwidth))) / F.sum("w") / (bandwidth * TWO_PI**0.5)).alias(f"g{i}") for i, g in enumerate(pts)]
    one = rows.agg(*sums)
    long = one.select(F.posexplode(F.array(*[F.struct(F.lit(g).alias("x"), F.col(f"g{i}").alias("pdf")) for i, g in enumerate(pts)])).alias("i", "p")).select("i", "p.*")
    w = Window.orderBy("i")  # over the grid only
    step = long.withColumn("m", F.col("pdf") * (F.col("x") - F.lag("x").over(w)))
    run = F.sum(F.coalesce("m", F.lit(0.0))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    whole = F.sum(F.coalesce("m", F.lit(0.0))).over(Window.partitionBy(F.lit(1)))
    return step.withColumn("cdf", F.try_divide(run, whole)).select("x", "pdf", "cdf")


def kde_bandwidth(df: DataFrame, x: str, key: str, candidates: Sequence[float], folds: int = 5, bins: int = 2048) -> float:
    """The candidate of the largest held-out log-likelihood.

    Values are counted per fold in ``bins`` even cells between the smallest and the largest, whatever
    their number; candidates below a cell's width are not told apart well. Without values the first.
    """
    v = no_nan(x)
    rows = df.where(v.isNotNull()).select(v.alias("v"), F.pmod(F.xxhash64(key), F.lit(folds)).alias("f"))
    edges = rows.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    cell = F.when(width > 0, F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("lo")) / width))).otherwise(F.lit(0))
    counts = rows.crossJoin(F.broadcast(edges)).groupBy(cell.alias("c"), "f").agg(F.count(F.lit(1)).alias("n"), F.first("lo").alias("lo"), F.first(width).alias("w"))  # one row of edges
    got = counts.collect()  # at most bins * folds rows
    if not got:
        return candidates[0]
    per = np.zeros((folds, bins))
    for r in got:
        per[r["f"], r["c"]] = r["n"]
    at = got[0]["lo"] + (np.arange(bins) + 0.5) * (got[0]["w"] or 0.0)
    used = per.sum(axis=0) > 0
    per, at = per[:, used], at[used]
    apart = (at[:, None] - at[None, :]) ** 2
    best = (-np.inf, candidates[0])
    for h in candidates:
        kernel = np.exp(-apart / (2 * h * h)) / (h * TWO_PI**0.5)
        score = 0.0
        for k in range(folds):
            rest = per.sum(axis=0) - per[k]
            if per[k].any() and rest.any():
                score += float((per[k] * np.log(kernel @ rest / rest.sum() + 1e-300)).sum())
        best = max(best, (score, h))
    return best[1]


def cond_quantile(df: DataFrame, x: str, y: str, qtile: float, x_vals: Sequence[float], bandwidth: float, y_bins: int = 512) -> DataFrame:
    """``x, y``: the conditional quantile of y at each x, kernel-weighted in x; y is resolved to ``y_bins`` bins.

    Weights are summed per y bin for all grid points at once: one partial aggregate of bounded size.
    """
    vx, vy = no_nan(x), no_nan(y)
    rows = df.select(vx.alias("x"), vy.alias("y")).where("x is not null and y is not null")
    edges = rows.agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / y_bins
    b = F.when(width > 0, F.least(F.lit(y_bins - 1), F.floor((F.col("y") - F.col("lo")) / width))).otherwise(F.lit(0))
    pts = [float(g) for g in x_vals]
    w = [F.sum(F.exp(-((F.lit(g) - F.col("x")) * (F.lit(g) - F.col("x"))) / (2 * bandwidth * bandwidth))).alias(f"w{i}") for i, g in enumerate(pts)]
    per = rows.crossJoin(F.broadcast(edges)).groupBy(b.alias("b")).agg(F.max("y").alias("y"), *w)  # one row of edges
    long = per.select("b", "y", F.posexplode(F.array(*[F.col(f"w{i}") for i in range(len(pts))])).alias("i", "w"))
    win = Window.partitionBy("i")
    run = F.sum("w").over(win.orderBy("b").rowsBetween(Window.unboundedPreceding, 0))
    share = long.withColumn("c", F.try_divide(run, F.sum("w").over(win)))
    hit = share.where(F.col("c") >= qtile - 1e-12).groupBy("i").agg(F.min("y").alias("y"))
    return hit.select(F.get(F.array(*[F.lit(g) for g in pts]), F.col("i")).alias("x"), "y")


def grid_by(df: DataFrame, x: str, n: int, kind: str = "by_count") -> list[float]:
    """Grid of n points of x: at even quantiles ('by_count') or even spacing ('by_length')."""
    v = no_nan(x)
    if kind == "by_count":
        return column_quantiles(df, [x], [(i + 0.5) / n for i in range(n)])[x] or []
    r = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi")).first()
    return [] if r["lo"] is None else [r["lo"] + (r["hi"] - r["lo"]) * i / max(1, n - 1) for i in range(n)]


def dist_df(df: DataFrame, x: str, cdf: str, inc: float = 0.01, p0: float = 0.0) -> DataFrame:
    """``prob, x``: the inverse of a tabulated distribution at even probabilities; with a mass ``p0`` at 0.

    The first x whose cdf reaches the probability; the table is small (a curve), so it is one array.
    """
    curve = df.agg(F.sort_array(F.collect_list(F.struct(F.col(cdf).cast("double").alias("c"), F.col(x).cast("double").alias("x")))).alias("t"))
    n = round(1 / inc)
    probs = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: i.cast("double") / n)
    each = curve.select("t", F.explode(probs).alias("prob"))
    rest = F.try_divide(F.col("prob") - p0, F.lit(1 - p0))
    found = F.get(F.filter("t", lambda e: e["c"] >= rest - 1e-12), F.lit(0))["x"]
    return each.select("prob", F.when(F.col("prob") <= p0, F.lit(0.0)).otherwise(F.coalesce(found, F.element_at("t", -1)["x"])).alias("x"))


def kaplan_meier(df: DataFrame, duration: str, event: str, by: Sequence[str] = ()) -> DataFrame:
    """``by, t, at_risk, deaths, survival, cdf`` at each distinct duration; rows need a duration.

    Rows are first counted per duration; the curve is made of running sums over those counts, in ranges
    of durations where there are many.
    """
    t = no_nan(duration)
    counts = df.where(t.isNotNull()).groupBy(*by, t.alias("t")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(F.col(event).cast("boolean"), F.lit(False))).alias("deaths"))
    summed = running_sums(counts, list(by), "t", ["n"])
    c = summed.withColumn("at_risk", F.col("n_total") - F.col("n_upto") + F.col("n")).select(*by, "t", "at_risk", "deaths")
    # all at risk die at the last time only: the curve ends at 0 there
    live = F.when(F.col("deaths") < F.col("at_risk"), F.ln(1 - F.col("deaths") / F.col("at_risk"))).otherwise(F.lit(0.0))
    s = running_sums(c.withColumn("live", live), list(by), "t", ["live"])
    survival = F.when(F.col("deaths") >= F.col("at_risk"), F.lit(0.0)).otherwise(F.exp("live_upto"))
    return s.withColumn("survival", survival).select(*by, "t", "at_risk", "deaths", "survival", (1 - F.col("survival")).alias("cdf"))


def km_curve_increasing(curve: DataFrame, split_zero: bool = True) -> tuple[DataFrame, float]:
    """(``x, cdf`` strictly increasing, mass at 0) of one Kaplan-Meier curve: x is averaged per cdf value."""
    zero = curve.where("t <= 0").agg(F.max("cdf")).first()[0] if split_zero else None
    m0 = float(zero or 0.0)
    rest = curve.where("t > 0") if split_zero else curve
    cdf = F.when(F.lit(m0) < 1, (F.col("cdf") - m0) / (1 - m0)) if m0 else F.col("cdf")
    return rest.withColumn("c", cdf).groupBy("c").agg(F.avg("t").alias("x")).select("x", F.col("c").alias("cdf")), m0


def survival_draws(df: DataFrame, duration: str, event: str, n: int, seed: int = 0) -> tuple[DataFrame, float]:
    """(``i, x`` draws from the Kaplan-Meier distribution, mass at 0)."""
    curve, m0 = km_curve_increasing(kaplan_meier(df, duration, event))
    table = dist_df(curve, "x", "cdf", 0.001, m0).agg(F.sort_array(F.collect_list(F.struct("prob", "x"))).alias("t"))  # 1,000 entries
    at = F.least(F.lit(999), F.floor(hash_uniform(seed, F.col("id")) * 1000)).cast("int")
    return df.sparkSession.range(n).crossJoin(F.broadcast(table)).select(F.col("id").alias("i"), F.get("t", at)["x"].alias("x")), m0


def decensor(df: DataFrame, duration: str, event: str, n: int, seed: int = 0) -> DataFrame:
    """Positive draws from the survival curve, as an uncensored sample."""
    return survival_draws(df, duration, event, n, seed)[0].where("x > 0")


def ks_two_sample(df: DataFrame, col: str, is_first: Column, by: Sequence[str] = ()) -> DataFrame:
    """``by, d, n1, n2``: largest distance of the empirical distributions of two samples.

    Rows are counted per distinct value, then running sums are compared, in ranges of values where there are many.
    """
    x = no_nan(col)
    counts = df.where(x.isNotNull() & is_first.isNotNull()).groupBy(*by, x.alias("x")).agg(F.count_if(is_first).alias("a"), F.count_if(~is_first).alias("b"))
    c = running_sums(counts, list(by), "x", ["a", "b"])
    d = F.abs(F.try_divide("a_upto", "a_total") - F.try_divide("b_upto", "b_total"))
    return c.withColumn("d", d).groupBy(*by).agg(F.max("d").alias("d"), F.sum("a").alias("n1"), F.sum("b").alias("n2"))


def with_ks_p(df: DataFrame) -> DataFrame:
    """Adds the asymptotic ``p_value`` to ``ks_two_sample``'s rows."""

    @F.pandas_udf("double")
    def p(d: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([ks_p_value(x, n, m) if n and m else None for x, n, m in zip(d, a, b)], dtype="float64")

    return df.withColumn("p_value", p("d", "n1", "n2"))


def split_sample(df: DataFrame, col: str, key: str, event: str | None = None, samples: int | None = None, min_mass: float = 0.05, seed: int = 0) -> tuple[DataFrame, dict[float, float]]:
    """(positive values ``x`` without point masses, the masses {value: probability}) of a sample to be fitted.

    ``samples``: about so many rows, taken by the hash of ``key``, when there are more than twice as
    many. With ``event`` (false: censored) the values are drawn from the survival curve, whose mass at
    0 joins the masses.
    """
    from quillstone.operators.aggregate import point_masses, update_mass

    v = no_nan(col)
    rows = df.where(v.isNotNull())
    if samples is not None:
        n = rows.count()
        if n > 2 * samples:
            rows = rows.where(hash_uniform(seed, F.col(key)) < samples / n)
    masses = {r["value"]: r["mass"] for r in point_masses(rows, col, min_mass).collect()}  # fewer than 1 / min_mass rows
    rest = rows.where(~v.isin(*masses)) if masses else rows
    if event is None:
        return rest.select(v.alias("x")).where("x > 0"), masses
    draws, m0 = survival_draws(rest, col, event, rest.count(), seed)
    return draws.select("x").where("x > 0"), update_mass(masses, 0.0, m0) if m0 > 0 else masses
