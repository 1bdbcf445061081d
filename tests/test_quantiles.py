import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.operators import generate, quantiles, smooth
from quillstone.operators.quantiles import column_quantiles, running_sums
from quillstone.stats import density


def column(spark, values, name="x"):
    return spark.createDataFrame([(i, v, "k") for i, v in enumerate(values)], f"id long, {name} double, at string")


@pytest.mark.parametrize("parts", [8192, 4])
def test_quantiles_equal_sorting(spark, monkeypatch, parts):
    """Values of many orders, ties, both signs, ends of the doubles; few parts take more passes."""
    monkeypatch.setattr(quantiles, "PARTS", parts)
    rnd = random.Random(1)
    values = [rnd.choice([-1, 1]) * rnd.lognormvariate(0, 30) for _ in range(300)] + [2.5] * 80 + [0.0, -0.0, 5e-324, 1.7e308, -1.7e308]
    rnd.shuffle(values)
    probs = [0.0, 0.01, 0.25, 0.5, 0.77, 1.0]
    got = column_quantiles(column(spark, values + [None, float("nan")]), ["x"], probs)["x"]
    ordered = sorted(values)
    for p, g in zip(probs, got):
        at = p * (len(values) - 1)
        a, b = ordered[math.floor(at)], ordered[math.ceil(at)]
        assert g == pytest.approx(a if a == b else a + (b - a) * (at - math.floor(at)), rel=1e-12, abs=0)


def test_quantiles_of_nothing_one_and_several(spark):
    df = spark.createDataFrame([(None, 1.0, 3), (None, 2.0, 3)], "a double, b double, c int")
    assert column_quantiles(df, ["a", "b", "c"], [0.5]) == {"a": None, "b": [1.5], "c": [3.0]}
    assert column_quantiles(df.where("false"), ["b"], [0.5]) == {"b": None}


@pytest.mark.parametrize("cases", [100, 0])
def test_a_thousand_quantiles_equal_sorting(spark, monkeypatch, cases):
    """Of values of many orders, with ties, null and NaN, beside a column with few intervals; all looked up or only where many."""
    monkeypatch.setattr(quantiles, "CASES", cases)
    rnd = random.Random(4)
    values = [rnd.gauss(0, 1) for _ in range(4000)] + [rnd.choice([-1, 1]) * rnd.lognormvariate(0, 30) for _ in range(300)] + [0.5] * 500 + [5e-324, 1.7e308, -1.7e308]
    rnd.shuffle(values)
    df = column(spark, values + [None, float("nan")])
    got = column_quantiles(df.withColumn("y", F.col("id") % 50), ["x", "y"], [i / 1000 for i in range(1001)])
    ordered, other = sorted(values), sorted(i % 50 for i in range(len(values) + 2))
    for name, own in (("x", ordered), ("y", other)):
        for i, g in enumerate(got[name]):
            at = i / 1000 * (len(own) - 1)
            a, b, w = own[math.floor(at)], own[math.ceil(at)], at - math.floor(at)
            assert g == pytest.approx(a * (1 - w) + b * w, rel=1e-9, abs=1e-300)


def test_quantiles_with_infinite_values(spark):
    inf = math.inf
    df = column(spark, [1.0, inf, 3.0, -inf, 2.0])
    assert column_quantiles(df, ["x"], [0.0, 0.1, 0.25, 0.5, 0.625, 0.9, 1.0])["x"] == [-inf, -inf, 1.0, 2.0, 2.5, inf, inf]
    assert column_quantiles(column(spark, [inf, inf]), ["x"], [0.0, 0.5]) == {"x": [inf, inf]}


def test_draws_hold_no_column_in_one_task(spark):
    """The grid of 1,001 quantiles is found by bisection, and draws interpolate it as before; none from no values."""
    values = [math.exp(i / 3000) for i in range(20_000)]
    df = spark.range(20_000).select(F.exp(F.col("id") / 3000).alias("x"))
    draws = density.sim_ecdf_draws(df, "x", 500, 3)
    assert "percentile" not in draws._jdf.queryExecution().toString()
    grid = np.quantile(values, np.arange(1001) / 1000)
    u = np.array([r[0] for r in spark.range(500).select(density.hash_uniform(3, F.col("id"))).collect()])
    assert [r["x"] for r in draws.orderBy("i").collect()] == pytest.approx(list(np.interp(u, np.arange(1001) / 1000, grid)), rel=1e-9)
    assert [r["x"] for r in density.sim_ecdf_draws(df.where("x < 0"), "x", 2).collect()] == [None, None]


@pytest.mark.parametrize("rows", [10, 100_000])
def test_running_sums_in_ranges_or_not(spark, monkeypatch, rows):
    monkeypatch.setattr(quantiles, "WINDOW_ROWS", rows)
    rnd = random.Random(2)
    data = [(g, t, rnd.randrange(9)) for g in ("a", "b", None) for t in range(60)]
    df = spark.createDataFrame(data, "g string, t int, n int")
    got = {(r["g"], r["t"]): (r["n_upto"], r["n_total"]) for r in running_sums(df, ["g"], "t", ["n"]).collect()}
    for g in ("a", "b", None):
        own = [n for h, _, n in data if h == g]
        assert all(got[g, t] == (sum(own[: t + 1]), sum(own)) for t in range(60))
    whole = running_sums(df.where("g = 'a'").drop("g"), [], "t", ["n"])
    assert max(r["n_upto"] for r in whole.collect()) == sum(n for g, _, n in data if g == "a")
    ks = density.ks_two_sample(spark.createDataFrame([(float(i), i % 3 == 0) for i in range(90)], "x double, f boolean"), "x", F.col("f")).first()
    assert ks["d"] == pytest.approx(1 / 30) and (ks["n1"], ks["n2"]) == (30, 60)
    assert running_sums(df.where("false"), ["g"], "t", ["n"]).count() == 0


def test_criteria_equal_the_published_traces():
    """Against traces of matrices that are written out, and a straight line, whose traces are known."""
    rng = np.random.default_rng(0)
    x, y = np.arange(12.0), rng.normal(0, 1, 12)
    fit = smooth.loess_fit(x, y, 0.7, 1)
    left = np.eye(12) - fit.matrix
    r = left.T @ left
    d1, d2, p = np.trace(r), np.trace(r @ r), (fit.matrix**2).sum()
    s2 = (fit.resid**2).sum() / d1
    got = smooth.span_criteria(fit)
    assert got["aicc1"] == pytest.approx(12 * math.log(s2) + 12 * (d1 / d2) * (12 + p) / (d1**2 / d2 - 2))
    assert got["aicc"] == pytest.approx(1 + math.log(s2) + 2 * (p + 1) / (12 - p - 2))
    assert got["gcv"] == pytest.approx(12 * s2 / (12 - np.trace(fit.matrix)) ** 2) and got["npars"] == pytest.approx(p)
    design = np.vander(x, 2)
    hat = design @ np.linalg.inv(design.T @ design) @ design.T  # a projection: R is one too, all traces are n - 2
    line = smooth.LoessFit(hat @ y, hat, y - hat @ y)
    s2 = (line.resid**2).sum() / 10
    assert smooth.span_criteria(line)["aicc1"] == pytest.approx(12 * math.log(s2) + 12 * (12 + 2) / (10 - 2))
    flat = smooth.LoessFit(y, np.eye(12), np.zeros(12))
    assert math.isnan(smooth.span_criteria(flat)["aicc1"]) and math.isnan(smooth.span_criteria(flat)["gcv"])


@pytest.mark.parametrize("rate", [10.0, 60.0, 1000.0])
def test_poisson_moments_and_tails(spark, rate):
    k = np.array([r[0] for r in spark.range(20_000).select(generate.poisson(F.lit(rate), density.hash_uniform(7, F.col("id")))).collect()])
    z = (k - rate) / math.sqrt(rate)
    assert abs(z.mean()) < 0.03 and abs(z.var() - 1) < 0.05 and (k == np.round(k)).all() and k.min() >= 0
    assert abs((z**3).mean() - rate**-0.5) < 0.12 and abs((z**4).mean() - 3 - 1 / rate) < 0.25
    assert 0.0008 < (np.abs(z) > 3).mean() < 0.006 and np.abs(z).max() > 3.4


def test_poisson_inverts_the_distribution(spark):
    """Above the limit of summing, draws are those of the exact inverse but for a few of a thousand, off by one."""
    rate, u = 80.0, [(i + 0.5) / 2000 for i in range(2000)]
    k = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(u)], "i int, u double").select("i", generate.poisson(F.lit(rate), F.col("u")).alias("k")).orderBy("i").select("k").collect()]
    cdf, p, exact, j = 0.0, math.exp(-rate), [], 0
    cdf = p
    for v in u:
        while cdf < v:
            j += 1
            p *= rate / j
            cdf += p
        exact.append(j)
    off = np.abs(np.array(k) - np.array(exact))
    assert off.max() <= 1 and (off > 0).mean() < 0.005


def test_week_starts_with_many_gaps(spark):
    """The share of the commonest gap is taken of all gaps, however many different ones there are."""
    import datetime as dt

    from quillstone.operators.windows import set_week_start

    days, d = [], dt.date(2020, 1, 4)
    for i in range(130):
        days.append(d)
        d += dt.timedelta(days=7 if i < 60 else 8 + i)
    with pytest.raises(ValueError):
        set_week_start(spark.createDataFrame([(x,) for x in days], "ds date"))


def test_bandwidth_does_not_depend_on_the_number_of_rows(spark):
    df = spark.range(60_000).select("id", generate.normal(3, F.col("id")).alias("x"))
    assert density.kde_bandwidth(df, "x", "id", [0.01, 0.2, 5.0]) == 0.2
    assert density.kde_bandwidth(df.where("id < 2000"), "x", "id", [0.001, 0.25, 5.0]) == 0.25
    assert density.kde_bandwidth(df.where("false"), "x", "id", [0.3, 1.0]) == 0.3
