import random

import pytest

from quillstone.llm import setsim as S

CELLS = "id long, field string, entry string, item string, similarity string, key string, toks string"


def jac(a, b):
    x, y = set(S.tokens(a)), set(S.tokens(b))
    return len(x & y) / len(x | y)


def brute(field, entry, items, others, t):
    """Every item compared with the entry."""
    best = None
    if entry is None or not S.fold(entry):
        return None
    for f, i, name in items:
        if f == field and name and S.fold(name):
            s = jac(entry, name)
            if s >= t - 1e-9 and (best is None or (-s, i) < best):
                best = (-s, i)
    for f, i, name in others:
        if f == field and name and S.fold(name) == S.fold(entry) and (best is None or (-1.0, i) < best):
            best = (-1.0, i)
    return best and best[1]


def run(spark, cells, items, others=(), t=S.THRESHOLD):
    c = spark.createDataFrame([(i, f, e, "x", "y", "z", "w") for i, (f, e) in enumerate(cells)], CELLS)
    it = spark.createDataFrame(list(items), "field string, item long, name string")
    ot = spark.createDataFrame(list(others), "field string, item long, name string")
    return {r["id"]: r["item"] for r in S.map_to_list(c, it, ot, t).collect()}


ITEMS = [("city", 1, "Northmere Valley"), ("city", 2, "Östervik Coast"), ("city", 3, "Grenzau Süd"), ("city", 4, "Grenzau Nord"), ("job", 5, "Guest Safety"), ("job", 6, "Web Form"), ("city", 7, None), ("city", 8, "?!")]
OTHERS = [("city", 1, "SR-96A00"), ("city", 2, "SR-91B01"), ("city", 3, None)]


def mangle(rnd, s):
    for _ in range(rnd.randrange(4)):
        i = rnd.randrange(len(s) or 1)
        s = rnd.choice([s[:i] + s[i + 1 :], s[:i] + s[i : i + 1] * 2 + s[i + 1 :], s.upper(), s.swapcase(), s + " (new)", " ".join(reversed(s.split())), s.replace("e", "е"), s[: max(1, i)], s.replace(" ", "_")])
    return s


@pytest.mark.parametrize("t", [0.22, 0.5, 0.8])
def test_equals_comparing_all(spark, t):
    rnd = random.Random(9)
    cells = [("city", mangle(rnd, rnd.choice([n for _, _, n in ITEMS[:4]]))) for _ in range(150)] + [("job", mangle(rnd, rnd.choice(["Guest Safety", "Web Form", "Payroll"]))) for _ in range(80)]
    cells += [("city", None), ("city", ""), ("city", "   "), ("city", "sr 96a00"), ("city", "SR-96A01"), (None, "Web Form"), ("job", "Northmere Valley"), ("none", "Web Form"), ("city", "x" * 100_000), ("city", "Ｇｒｅｎｚａｕ　Ｎｏｒｄ")]
    cells += cells[:5]
    got = run(spark, cells, ITEMS, OTHERS, t)
    assert got == {i: brute(f, e, ITEMS, OTHERS, t) for i, (f, e) in enumerate(cells)}


def test_codes_must_be_equal(spark):
    got = run(spark, [("city", "SR96A00"), ("city", "sr-96a00 "), ("city", "SR-96A02")], [ITEMS[0]], OTHERS)
    assert (got[0], got[1], got[2]) == (1, 1, None)


def test_ties_take_the_smallest_item(spark):
    items = [("f", 9, "alpha beta"), ("f", 4, "Alpha-Beta"), ("f", 6, "alphabeta")]
    assert run(spark, [("f", "alpha beta")], items)[0] == 4


def test_empty_sides(spark):
    assert run(spark, [], ITEMS) == {}
    assert run(spark, [("city", "Northmere")], []) == {0: None}


def test_folding():
    assert S.fold("  Ö-stеrvіk\u200b ") == "ostervik"
    assert S.fold("\u200b ?!") == ""
    assert len(set(S.tokens("aaaa"))) == len(S.tokens("aaaa"))
