"""Published values, round trips, and simulate-and-recover with seeds."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.functions import metrics, special, transforms
from quillstone.stats import density, families, mixtures, qfits


def test_special_functions_against_tables():
    assert special.gammainc(1.0, 1.0) == pytest.approx(1 - math.exp(-1), abs=1e-14)
    assert special.gammainc(5.0, 5.0) == pytest.approx(0.5595067149347876, abs=1e-12)
    assert special.gammainc(0.5, 0.5) == pytest.approx(math.erf(math.sqrt(0.5)), abs=1e-13)
    assert special.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-10)
    assert special.chi2_sf(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-10)
    for a in (0.05, 0.7, 3, 250):
        p = np.array([1e-4, 0.1, 0.5, 0.99])
        assert special.gammainc(a, special.gamma_ppf(p, a)) == pytest.approx(p, rel=1e-9)


def test_shapiro_wilk_published_example():
    """Eleven weights of men, W = 0.79 (Shapiro and Wilk, 1965)."""
    w, p = special.shapiro_wilk(np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236.0]))
    assert w == pytest.approx(0.79, abs=0.005) and 0.003 < p < 0.01
    rng = np.random.default_rng(0)
    assert special.shapiro_wilk(rng.normal(size=300))[1] > 0.05 > special.shapiro_wilk(rng.exponential(size=300))[1]
    assert math.isnan(special.shapiro_wilk(np.ones(5))[0])


def test_minimiser():
    x, v = special.nelder_mead(lambda p: (1 - p[0]) ** 2 + 100 * (p[1] - p[0] ** 2) ** 2, [-1.2, 1.0])
    assert x == pytest.approx([1, 1], abs=1e-4) and v < 1e-8


@pytest.mark.parametrize("name", sorted(families.SHAPES))
def test_families_round_trip(name):
    sh = [0.7] if families.SHAPES[name] else []
    p = np.array([0.01, 0.3, 0.5, 0.9, 0.999])
    assert families.cdf(name, families.ppf(name, p, sh, 2.0, 0.5), sh, 2.0, 0.5) == pytest.approx(p, abs=1e-8)


def test_two_quantiles():
    for name, sh, sc in (("lognorm", [0.6], 3.0), ("gamma", [2.5], 4.0), ("expon", [], 7.0)):
        q = {p: float(np.ravel(families.ppf(name, p, sh, sc))[0]) for p in (0.25, 0.9)}
        s, c = families.from_two_quantiles(name, q)
        assert c == pytest.approx(sc, rel=1e-6) and s == pytest.approx(sh, rel=1e-6)
    assert families.from_two_quantiles("gamma", {0.1: -1.0, 0.9: 2.0}) is None


def test_em_recovers_two_exponentials():
    rng = np.random.default_rng(3)
    m = mixtures.em(np.concatenate([rng.exponential(1, 3000), rng.exponential(30, 2000)]), 2, "expon")
    order = np.argsort(m.scales)
    assert np.array(m.scales)[order] == pytest.approx([1, 30], rel=0.15) and np.array(m.probs)[order] == pytest.approx([0.6, 0.4], abs=0.05)
    assert m.aic_bic()[0] < m.aic_bic()[1] and m.mean() == pytest.approx(0.6 + 12, rel=0.1)


def test_hyper_exp_is_close_to_the_sample():
    x = families.rvs("lognorm", 1000, np.random.default_rng(5), [1.2], 1.0)
    m = mixtures.hyper_exp(x, (1, 3), max_splits=3)
    assert m.mean() == pytest.approx(x.mean(), rel=0.05) and sum(m.probs) == pytest.approx(1)
    assert mixtures.hyper_exp(np.array([-1.0, 0.0])) is None


def test_quantile_mixture():
    q = {p: float(np.ravel(families.ppf("gamma", p, [4.0], 1.0))[0]) for p in (0.1, 0.25, 0.5, 0.75, 0.9)}
    m = mixtures.quantile_mixture(q, "gamma", 1)
    assert m.shapes[0][0] == pytest.approx(4, rel=0.02) and m.scales[0] == pytest.approx(1, rel=0.02)
    assert mixtures.quantile_mixture({0.1: -1.0, 0.5: 2.0}, "gamma", 1) is None


def test_mixture_functions():
    m = mixtures.Mixture(["expon", "expon"], [0.5, 0.5], [[], []], [1.0, 10.0], masses={0.0: 0.2})
    p = np.array([0.3, 0.5, 0.9])
    assert m.cdf(m.ppf(p)) == pytest.approx(p, abs=1e-6) and m.sf(0.0) == pytest.approx(0.8)
    x = m.rvs(20_000, 1)
    assert (x == 0).mean() == pytest.approx(0.2, abs=0.01) and x.mean() == pytest.approx(m.mean(), rel=0.04) and x.std() == pytest.approx(m.std(), rel=0.05)
    same = mixtures.merge_similar(mixtures.Mixture(["expon"] * 3, [0.3, 0.3, 0.4], [[]] * 3, [1.0, 1.02, 50.0]))
    assert len(same.names) == 2


def test_prony():
    t = np.arange(60) * 0.1
    amp, exps = mixtures.prony(t, 3 * np.exp(-t) + 2 * np.exp(-4 * t), 2)
    o = np.argsort(exps.real)
    assert exps.real[o] == pytest.approx([-4, -1], abs=1e-6) and amp.real[o] == pytest.approx([2, 3], abs=1e-6)


def test_qfits_recover(spark):
    ps = [0.1, 0.25, 0.5, 0.75, 0.9]
    g = [float(x) for x in np.ravel(families.ppf("gamma", np.array(ps), [6.0], 2.0))]
    ln = [float(x) for x in families.ppf("lognorm", np.array(ps), [0.5], 3.0)]
    rows = [("g", 12.0, *g), ("l", 3 * math.exp(0.125), *ln), ("bad", 1.0, -1.0, 1.0, 2.0, 3.0, 4.0), ("null", None, *g), ("inf", float("inf"), *g)]
    df = spark.createDataFrame(rows, "id string, y double, q10 double, q25 double, q50 double, q75 double, q90 double")
    a = {r["id"]: r for r in qfits.gamma_qfit(df).collect()}
    assert a["g"]["par_shape"] == pytest.approx(6, rel=0.02) and a["g"]["par_scale"] == pytest.approx(2, rel=0.02)
    b = {r["id"]: r for r in qfits.lognorm_qfit(df).collect()}
    assert b["l"]["par_shape"] == pytest.approx(0.5, rel=0.01) and b["l"]["par_scale"] == pytest.approx(3, rel=0.01)
    assert all(x[k]["par_shape"] is None for x in (a, b) for k in ("bad", "null", "inf"))
    assert qfits.expon_qfit(df).where("id = 'g'").first()["par_rate"] == pytest.approx(1 / 12)


@pytest.mark.parametrize("kind", ["none", "anscombe", "log", "logistic", "box-cox", "yeo-johnson", "quantile"])
def test_transform_round_trip(spark, kind):
    rng = np.random.default_rng(7)
    df = spark.createDataFrame([(float(v),) for v in rng.gamma(2, 3, 400) + 0.1] + [(None,), (float("nan"),)], "y double")
    t = transforms.Transform(kind, floor=0.0, ceiling=100.0)
    with pytest.raises(ValueError):
        t.transform(F.col("y"))
    t.fit(df, "y")
    out = df.select("y", t.inverse(t.transform(F.col("y"))).alias("w")).where("y is not null and not isnan(y)").collect()
    tol = {"anscombe": 0.2, "quantile": 0.3}.get(kind, 1e-6)
    assert max(abs(r["y"] - r["w"]) for r in out) < tol if kind != "anscombe" else np.mean([abs(r["y"] + 0.25 - r["w"]) for r in out]) < 0.5


def test_transform_guards(spark):
    same = spark.createDataFrame([(2.0,), (2.0,)], "y double")
    with pytest.raises(ValueError):
        transforms.Transform().fit(same, "y")
    neg = spark.createDataFrame([(-1.0,), (2.0,)], "y double")
    for kind in ("log", "box-cox", "anscombe", "logistic"):
        with pytest.raises(ValueError):
            transforms.Transform(kind).fit(neg, "y")


def test_lambda_of_lognormal_is_zero(spark):
    x = np.exp(np.random.default_rng(2).normal(0, 1, 3000))
    df = spark.createDataFrame([(float(v),) for v in x], "y double")
    assert transforms.fit_lambda(df, "y", "box-cox") == pytest.approx(0, abs=0.06)


def test_unbiased_inverse_matches_simulation(spark):
    rng = np.random.default_rng(4)
    z = rng.normal(1.0, 0.1, 200_000)
    one = spark.range(1)
    for fwd, col in ((lambda v: (0.5 * v + 1) ** 2, transforms.box_cox_inverse(F.lit(1.0), 0.5, F.lit(0.01))), (np.expm1, transforms.log_inverse(F.lit(1.0), F.lit(0.01)))):
        assert one.select(col).first()[0] == pytest.approx(fwd(z).mean(), rel=2e-3)


def test_errors_with_zeros_nulls_and_order(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0), (2, 2.0, 1.0), (3, 4.0, 5.0), (4, None, 1.0), (5, float("nan"), 2.0), (6, 4.0, 4.0)], "i int, y double, h double")
    r = df.agg(metrics.mape("y", "h").alias("m"), metrics.wmape("y", "h").alias("w"), metrics.rmse("y", "h").alias("r"), metrics.smape("y", "h").alias("s")).first()
    assert r["m"] == pytest.approx((0.5 + 0.25 + 0) / 3) and r["w"] == pytest.approx(2 / 10) and r["r"] == pytest.approx(math.sqrt(3 / 4)) and r["s"] == pytest.approx((2 + 2 / 3 + 2 / 9 + 0) / 4)
    one = metrics.with_leads(df.withColumn("g", F.lit(0)), ["g"], "i", "y", "h").agg(metrics.mase("y", "h").alias("a")).first()["a"]
    assert one == pytest.approx((3 / 4) / ((2 + 2 + 0) / 3))
    flat = spark.createDataFrame([(1, 3.0, 3.0), (2, 3.0, 4.0)], "i int, y double, h double").withColumn("g", F.lit(0))
    assert metrics.with_leads(flat, ["g"], "i", "y", "h").agg(metrics.mase("y", "h")).first()[0] == float("inf")
    assert metrics.err_func(spark.createDataFrame([(0.0, 1.0)], "y double, h double"), "y", "h", "MAPE").first()["error"] is None
    for e in ("sMAPE", "RMSE", "MAPE", "mMAPE", "wMAPE", "LAR", "SR", "MASE", "BC", "YJ", "YJd"):
        assert metrics.err_func(df, "y", "h", e, order="i").first()["error"] is not None


def test_white_noise(spark):
    rng = np.random.default_rng(8)
    noise, walk = rng.normal(size=400), np.cumsum(rng.normal(size=400))
    df = spark.createDataFrame([("n", i, float(v)) for i, v in enumerate(noise)] + [("w", i, float(v)) for i, v in enumerate(walk)], "g string, i int, e double")
    got = {r["g"]: r for r in metrics.white_noise_test(df, ["g"], "i", "e").collect()}
    assert got["n"]["is_white"] and not got["w"]["is_white"] and got["w"]["p_lb"] < 1e-6


def test_white_noise_of_a_large_group_needs_shapiro(spark):
    rng = np.random.default_rng(11)
    three = rng.permutation(np.repeat([-math.sqrt(3), 0.0, math.sqrt(3)], [1000, 4000, 1000]))  # skewness and excess kurtosis 0
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(three)], "i int, e double")
    r = metrics.white_noise_test(df, [], "i", "e").first()
    assert r["n"] == 6000 and r["p_k2"] > 0.05 and r["p_lb"] > 0.05
    assert r["shapiro_p"] < 1e-6 and r["is_white"] is False
    v, n = np.unique(three, return_counts=True)
    assert special.shapiro_wilk(v, n) == pytest.approx(special.shapiro_wilk(three))


def test_kaplan_meier_by_hand(spark):
    df = spark.createDataFrame([(1.0, True), (2.0, True), (2.0, False), (3.0, False), (4.0, True), (None, True)], "t double, e boolean")
    got = [(r["t"], r["at_risk"], r["survival"]) for r in density.kaplan_meier(df, "t", "e").orderBy("t").collect()]
    assert got == [(1.0, 5, pytest.approx(0.8)), (2.0, 4, pytest.approx(0.6)), (3.0, 2, pytest.approx(0.6)), (4.0, 1, 0.0)]
    draws, m0 = density.survival_draws(df, "t", "e", 500)
    assert m0 == 0.0 and draws.count() == 500 and draws.agg(F.max("x")).first()[0] == 4.0


def test_density_and_bootstrap(spark):
    x = np.random.default_rng(9).normal(0, 1, 2000)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "id long, x double")
    k = density.kde(df, "x", [g / 10 for g in range(-40, 41)], 0.3).orderBy("x").toPandas()
    assert k.pdf.max() == pytest.approx(0.38, abs=0.03) and k.cdf.iloc[-1] == pytest.approx(1) and k.cdf.is_monotonic_increasing
    assert density.kde_bandwidth(df, "x", "id", [0.05, 0.3, 3.0]) == 0.3
    b = density.bootstrap(df, ["x"], "id", n_iters=200).first()
    assert b["mean"] == pytest.approx(x.mean(), abs=0.02) and b["l_ci"] < x.mean() < b["h_ci"] and b["std"] == pytest.approx(x.std() / math.sqrt(1000), rel=0.3)
    two = df.withColumn("y", 2 * F.col("x"))
    m = {r["x"]: r["y"] for r in density.cond_quantile(two, "x", "y", 0.5, [-1.0, 0.0, 1.0], 0.2).collect()}
    assert m[1.0] == pytest.approx(2, abs=0.3) and m[-1.0] == pytest.approx(-2, abs=0.3)


def test_ks_and_ecdf(spark):
    df = spark.createDataFrame([(float(i), i % 2 == 0) for i in range(100)] + [(None, True)], "x double, a boolean")
    r = density.with_ks_p(density.ks_two_sample(df, "x", F.col("a"))).first()
    assert r["d"] == pytest.approx(0.02) and r["p_value"] == pytest.approx(1)
    d = density.sim_ecdf_draws(df, "x", 5000, 3).agg(F.avg("x"), F.max("x")).first()
    assert d[0] == pytest.approx(49.5, abs=1.5) and d[1] <= 99


def test_fit_groups_of_any_size(spark):
    df = spark.range(6000).select((F.col("id") % 2).alias("g"), (-F.ln(density.hash_uniform(1, F.col("id")) + 1e-12) * 5).alias("x"))
    for most in (100, 100_000):
        got = mixtures.fit_groups(df, ["g"], "x", lambda v: mixtures.em(v, 1), max_rows=most).collect()
        assert len(got) == 2 and all(r["n"] == 3000 and r["mean"] == pytest.approx(5, rel=0.08) for r in got)


def test_fit_groups_uses_every_row_of_a_large_group(spark):
    df = spark.range(25_000).select(F.lit(1).alias("g"), F.round(-F.ln(density.hash_uniform(1, F.col("id")) + 1e-12) * 5, 2).alias("x"))
    x = df.toPandas().x.to_numpy()
    x = x[x > 0]
    fits = (lambda v: mixtures.em(v, 1), False), (lambda v, n: mixtures.em(v, 1, counts=n), True), (lambda v, n: mixtures.hyper_exp(v, (1, 2), max_splits=2, counts=n), True)
    for fit, weighted in fits:
        r = mixtures.fit_groups(df.where("x > 0"), ["g"], "x", fit, weighted=weighted).first()
        assert r["n"] == len(x) and r["mean"] == pytest.approx(x.mean(), rel=1e-9)
        assert r["llf"] == pytest.approx(-len(x) * (math.log(x.mean()) + 1), rel=1e-9)


def test_counts_stand_for_rows():
    x = np.round(np.random.default_rng(4).exponential([1.0, 30.0], (2500, 2)).ravel(), 1)
    x = x[x > 0]
    v, n = np.unique(x, return_counts=True)
    for f in (lambda *a, **k: mixtures.em(*a, 2, "expon", **k), lambda *a, **k: mixtures.hyper_exp(*a, (1, 3), max_splits=3, **k)):
        rows, counted = f(x), f(v, counts=n)
        assert counted.n == rows.n == len(x) and counted.llf == pytest.approx(rows.llf, rel=1e-12)
        assert counted.scales == pytest.approx(rows.scales) and counted.probs == pytest.approx(rows.probs)
    ps = [0.0, 0.013, 0.1, 0.5, 0.9, 1.0]
    assert mixtures.quantiles(v, n, ps) == pytest.approx(np.quantile(x, ps))


def test_split_sample(spark):
    rows = [(i, 0.0 if i < 300 else float(1 + i % 700), i % 5 != 0) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, x double, ev boolean")
    cont, masses = density.split_sample(df, "x", "id")
    assert masses == {0.0: 0.15} and cont.count() == 1700
    few, _ = density.split_sample(df, "x", "id", samples=200)
    assert 100 < few.count() < 260
    drawn, m = density.split_sample(df, "x", "id", event="ev")
    assert drawn.count() > 1000 and m[0.0] >= 0.15


def test_queries_use_the_operators_defaults(spark, monkeypatch):
    import os

    from quillstone.operators import impute, smooth
    from quillstone.plans.reference_queries import QUERIES

    calls = {}
    for module, name in ((mixtures, "em"), (mixtures, "hyper_exp"), (smooth, "opt_loess"), (impute, "impute"), (density, "bootstrap")):
        monkeypatch.setattr(module, name, lambda *a, _name=name, **k: calls.setdefault(_name, (a, k)))
    monkeypatch.setattr(mixtures, "fit_groups", lambda df, by, col, fit, **k: fit("x", "n"))
    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("no test tables")
    for q in ("em_expon", "hyper_exp", "loess_best_span", "impute_events", "bootstrap_prices"):
        QUERIES[q](spark, data)
    assert calls["em"] == (("x", 2, "expon"), {"counts": "n"}) and calls["hyper_exp"] == (("x",), {"counts": "n"})
    assert calls["opt_loess"][0][1:] == (["event_type"], "d", "y") and not calls["opt_loess"][1]
    assert calls["impute"][1] == {"ex_cols": ["event_id"]} and not calls["bootstrap"][1]
