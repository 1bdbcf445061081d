import math
import random

import pytest
from pyspark.sql import functions as F

from quillstone.llm import percentiles as P

PS = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
SCHEMA = "id long, grp string, day int, a double, b double, n string, total string, at string, rank string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", "w") for r in rows], SCHEMA)


def exact(values, p):
    v = sorted(x + 0.0 for x in values)
    return v[max(1, math.ceil(p * len(v) - 1e-9)) - 1]


def brute(rows, record=True):
    out, seen = {}, set()
    for i, g, _, a, b in rows:
        if record and i in seen:
            continue
        seen.add(i)
        for c, x in (("a", a), ("b", b)):
            if x is not None and math.isfinite(x):
                out.setdefault((g, c), []).append(x)
    return {(g, c, p): (exact(v, p), len(v)) for (g, c), v in out.items() for p in PS}


def got(df):
    return {(r["grp"], r["column_name"], r["p"]): (r["value"], r["n"]) for r in df.collect()}


def sample(n=3000, seed=4):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        g = rnd.choice(["hot"] * 6 + ["cold", "tied", None])
        a = {"hot": rnd.gauss(0, 1e6), "cold": rnd.lognormvariate(0, 5), "tied": float(rnd.randrange(3))}.get(g, rnd.uniform(-1e-9, 1e-9))
        b = rnd.choice([None, float("nan"), float("inf"), -float("inf"), -0.0, 0.0, 1e300, -1e300, 5e-324])
        rows.append((i, g, rnd.randrange(5), a, b))
    return rows + [rows[3], rows[7]]


def test_exact_equals_sorting(spark):
    rows = sample()
    assert got(P.group_percentiles(frame(spark, rows), "grp", ["a", "b"], PS, "id")) == brute(rows)


def test_cells_keep_order_and_bound_the_error(spark):
    rnd = random.Random(2)
    vals = [-1e308, -1.5, -5e-324, -0.0, 0.0, 5e-324, 1.0, 1.0000000000000002, 1e308, 1.7976931348623157e308, 2.2250738585072014e-308]
    vals += [s * m * 2.0**e for e in range(-1060, 1020, 37) for m in (1.0, 1 + 2**-52, 2 - 2**-52, 1.25) for s in (1, -1)] + [rnd.lognormvariate(0, 40) for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in vals], "v double").select("v", P.cell_of(F.col("v")).alias("k")).withColumn("w", P.cell_value(F.col("k")))
    out = df.collect()
    ks = [r["k"] for r in sorted(out, key=lambda r: r["v"])]
    assert ks == sorted(ks)
    assert all(abs(r["w"]) <= abs(r["v"]) and abs(r["v"] - r["w"]) <= abs(r["v"]) * 2**-P.CELL_BITS for r in out if abs(r["v"]) >= 2.2250738585072014e-308 or r["v"] == 0)


def test_parts_combine_into_the_whole(spark):
    rows = sample(1500)
    df = frame(spark, rows[:1500])
    whole = P.combine_counts(P.cell_counts(df.withColumn("one", F.lit(0)), "grp", ["a", "b"], ["one"]), "grp", ["a", "b"])
    parts = P.cell_counts(df, "grp", ["a", "b"], ["day"])
    assert parts.count() <= 5 * 4
    together = P.combine_counts(parts.where("day < 2").unionByName(parts.where("day >= 2")), "grp", ["a", "b"])
    key = lambda d: {(r["g"], r["c"], r["cell"]): r["n"] for r in d.collect()}
    assert key(together) == key(whole)
    want = brute(rows[:1500])
    got_ = {(r["g"], r["c"], r["p"]): (r["value"], r["n"]) for r in P.cell_percentiles(together, PS).collect()}
    assert got_.keys() == want.keys()
    assert all(n == want[k][1] and abs(v - want[k][0]) <= abs(want[k][0]) * 2**-P.CELL_BITS + 5e-324 for k, (v, n) in got_.items())


def test_intervals_narrow_in_passes(spark, monkeypatch):
    """Few halvings a pass: many passes, the same result; values close together take the most."""
    monkeypatch.setattr(P, "BITS", 2)
    rnd = random.Random(3)
    rows = [(i, rnd.choice("ab"), 0, 1 + rnd.randrange(1 << 40) * 2.0**-52, rnd.choice([1.0, 1.003, 1.0030000001])) for i in range(400)]
    assert got(P.group_percentiles(frame(spark, rows), "grp", ["a", "b"], [0.3, 0.9])) == {k: v for k, v in brute_ps(rows, [0.3, 0.9]).items()}


def brute_ps(rows, ps):
    out = {}
    for _, g, _, a, b in rows:
        for c, x in (("a", a), ("b", b)):
            out.setdefault((g, c), []).append(x)
    return {(g, c, p): (exact(v, p), len(v)) for (g, c), v in out.items() for p in ps}


@pytest.mark.parametrize("rows", [[], [(1, "g", 0, None, float("nan"))]])
def test_nothing_usable(spark, rows):
    assert got(P.group_percentiles(frame(spark, rows), "grp", ["a", "b"], PS)) == {}


def test_one_value_and_ties(spark):
    rows = [(i, "g", 0, 2.5, None) for i in range(7)]
    assert {v for v, _ in got(P.group_percentiles(frame(spark, rows), "grp", ["a"], PS)).values()} == {2.5}


def test_shuffled_intervals_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(P, "broadcast_if_small", lambda df, rows: df)
    rows = sample(500)
    assert got(P.group_percentiles(frame(spark, rows), "grp", ["a", "b"], PS, "id")) == brute(rows)
