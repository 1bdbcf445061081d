import math

import pytest

from quillstone.llm import mixing as M

SIZES = "key long, source string, size long"
TARGETS = "source string, target_share double, max_repeats int"


def sizes(spark, spec):
    rows, k = [], 0
    for src, n, size in spec:
        for i in range(n):
            rows.append((k, src, size + i % 7))
            k += 1
    return spark.createDataFrame(rows, SIZES)


def report(spark, spec, targets, total=None):
    s = sizes(spark, spec)
    plan = M.plan_mix(s, spark.createDataFrame(targets, TARGETS), total)
    return s, plan, {r["source"]: r for r in M.mix_report(s, plan).collect()}


SPEC = [("big", 4000, 50), ("mid", 1500, 80), ("tiny", 40, 30), (None, 50, 10), ("unlisted", 300, 10)]
GOAL = [("Big", 0.5, 1), (" mid ", 0.3, 2), ("tiny", 0.1, 4), ("absent", 0.1, 3)]


def test_shares_hold_and_caps_are_kept(spark):
    s, plan, rep = report(spark, SPEC, GOAL)
    drawn = M.draw_mix(s, plan).collect()
    total = sum(r["size"] for r in drawn)
    for src, share in (("big", 0.5), ("mid", 0.3), ("tiny", 0.1)):
        mine = sum(r["size"] for r in drawn if r["source"] == src)
        assert mine == rep[src]["size"]
        assert mine / total == pytest.approx(share / 0.9, rel=0.02)
        assert max(r["copy"] for r in drawn if r["source"] == src) <= dict((a.strip().lower(), c) for a, _, c in GOAL)[src]
    assert rep["absent"]["size"] == 0 and rep["absent"]["short"] and not rep["big"]["short"]
    assert {r["source"] for r in drawn} == {"big", "mid", "tiny"}
    assert len({(r["key"], r["copy"]) for r in drawn}) == len(drawn)


def test_given_size_reports_who_falls_short(spark):
    _, _, rep = report(spark, SPEC, GOAL, total=300_000.0)
    assert rep["tiny"]["short"] and rep["tiny"]["mean_repeats"] == 4.0 and rep["tiny"]["at_cap"]
    assert rep["mid"]["mean_repeats"] > 0.5


def test_same_draw_whatever_the_partitioning(spark):
    s, plan, _ = report(spark, SPEC, GOAL)
    key = lambda d: {(r["key"], r["copy"]) for r in d.collect()}
    assert key(M.draw_mix(s.repartition(1), plan)) == key(M.draw_mix(s.repartition(9), plan))


def test_order_is_mixed(spark):
    s, plan, _ = report(spark, SPEC, GOAL)
    order = [r["key"] for r in M.draw_mix(s, plan).collect()]
    ups = sum(a < b for a, b in zip(order, order[1:])) / len(order)
    assert 0.4 < ups < 0.6


def test_poisson_counts(spark):
    """Replication follows the inverted Poisson distribution with the rate that was solved."""
    s, plan, _ = report(spark, [("a", 20_000, 10), ("b", 20_000, 10)], [("a", 0.8, 12), ("b", 0.2, 12)])
    rate = next(p["rate"] for p in plan if p["source"] == "b")
    from collections import Counter

    per = Counter(r["key"] for r in M.draw_mix(s, plan).collect() if r["source"] == "b")
    counts = Counter(per.values())
    for k in (1, 2, 3):
        assert counts[k] / 20_000 == pytest.approx(math.exp(-rate) * rate**k / math.factorial(k), abs=0.012)


def test_empty_tables_and_odd_targets(spark):
    s = spark.createDataFrame([], SIZES)
    plan = M.plan_mix(s, spark.createDataFrame(GOAL, TARGETS))
    assert M.draw_mix(s, plan).count() == 0
    assert {r["size"] for r in M.mix_report(s, plan).collect()} == {0}
    s = sizes(spark, SPEC)
    plan = M.plan_mix(s, spark.createDataFrame([], TARGETS))
    assert M.draw_mix(s, plan).count() == 0 and M.mix_report(s, plan).count() == 0
    plan = M.plan_mix(s, spark.createDataFrame([("big", None, 2), ("mid", 0.5, None), ("tiny", 0.5, 1), (None, 0.2, 1)], TARGETS))
    assert {r["source"] for r in M.draw_mix(s, plan).collect()} == {"tiny"}


def test_token_sizes(spark):
    pytest.importorskip("public_tokenizers")
    df = spark.createDataFrame([(1, "hello there", " Shop "), (2, None, "SHOP"), (3, "", None)], "doc_id long, text string, source string")
    assert {(r["key"], r["source"], r["size"]) for r in M.token_sizes(df, "doc_id", "text", "source").collect()} == {(1, "shop", 2), (2, "shop", 0), (3, None, 0)}


def test_rows_of_the_full_size_mix_are_those_reported(spark):
    pytest.importorskip("public_tokenizers")
    import os

    from quillstone.llm.queries import QUERIES

    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("no test tables")
    rep = {r["source"]: (r["size"], r["records"]) for r in QUERIES["p7_report_full_size"](spark, data).collect() if r["records"]}
    got = QUERIES["p7_mix_full_size"](spark, data).groupBy("source").agg({"n_tokens": "sum", "copy": "count"}).collect()
    assert rep and {r["source"]: (r["sum(n_tokens)"], r["count(copy)"]) for r in got} == rep
