import datetime as dt

import numpy as np
import pytest

from quillstone.operators import spikes
from quillstone.operators.spikes import implausible_readings, judge_series, phase_space

BOUNDS = {"secs": (0.0, None, False), "count": (0.0, None, True), "share": (0.0, 1.0, False)}
SCHEMA = "obs long, sid string, unit string, ds timestamp_ntz, y double, yhat double, b string, t string, own string"
T0 = dt.datetime(2023, 1, 2)


def series(n=400, seed=1, level=100.0, noise=2.0):
    rng = np.random.default_rng(seed)
    exp = level * (1 + 0.3 * np.sin(np.arange(n) / 24 * 2 * np.pi))
    return exp, exp + rng.normal(0, noise, n)


def judge(y, yhat, bad=None, **kw):
    bad = np.zeros(len(y), bool) if bad is None else bad
    with np.errstate(all="ignore"):
        return judge_series(np.arange(len(y)) * 3600.0, y, yhat, bad, **kw)[0]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)


def rows_of(y, yhat, sid="s", unit="secs", first=0):
    return [(first + i, sid, unit, T0 + dt.timedelta(hours=i), None if v is None else float(v), None if h is None else float(h)) for i, (v, h) in enumerate(zip(y, yhat))]


def run(spark, rows, **kw):
    return {r["obs"]: r["fault"] for r in implausible_readings(frame(spark, rows), "obs", "sid", "ds", "y", "yhat", "unit", BOUNDS, **kw).collect()}


def test_clean_series_has_none():
    exp, y = series()
    assert not judge(y, exp).astype(bool).any()


def test_spikes_alone_and_in_bursts():
    exp, y = series()
    y[[50, 51, 52, 200]] += [40, -45, 50, -60]
    assert set(np.flatnonzero(judge(y, exp) == "spike")) == {50, 51, 52, 200}


def wandering(n=1000, seed=0):
    """Deviations that wander slowly, far more than they change from one reading to the next."""
    rng = np.random.default_rng(seed)
    return np.convolve(rng.normal(0, 1, n + 59), np.ones(60) / 60**0.5, "valid") * 3


def planes_that_find(monkeypatch, u, at):
    found = []
    for plane in (("value", "first"), ("value", "second"), ("first", "second")):
        monkeypatch.setattr(spikes, "PLANES", (plane,))
        if phase_space(u)[0][at].any():
            found.append(plane)
    monkeypatch.undo()
    assert phase_space(u)[0][at].any() == bool(found)
    return found


@pytest.mark.parametrize("bump, plane", [((-2.0, 4.2, 4.19), ("value", "first")), ((4.0, 4.4, 4.0), ("value", "second"))])
def test_what_one_plane_alone_finds_in_noise(monkeypatch, bump, plane):
    """A jump between two high readings; three high readings in a row: none is beyond the threshold by its value."""
    u = np.random.default_rng(0).normal(0, 1, 1000)
    assert not phase_space(u)[0].any()
    u[299:302] = bump
    assert planes_that_find(monkeypatch, u, slice(298, 304)) == [plane]


def test_what_the_plane_of_differences_alone_finds(monkeypatch):
    """In a wandering series a small step is far outside by its differences and ordinary by its value."""
    u = wandering()
    assert not phase_space(u)[0].any()
    at = 100 + int(np.argmin(np.abs(u[100:900])))
    u[at : at + 2] += 3.2
    assert np.abs(u[at : at + 2]).max() < 2 * u.std()
    assert planes_that_find(monkeypatch, u, slice(at - 1, at + 3)) == [("first", "second")]


def test_spikes_in_phase_space_leave_their_neighbours():
    rng = np.random.default_rng(0)
    u = rng.normal(0, 1, 1000)
    u[[300, 500, 501, 502, 700, 702]] = [9, 8, 9, 8, -12, 11]
    u[0], u[999], u[650] = 10, -10, np.nan
    found, radius = phase_space(u)
    assert np.flatnonzero(found).tolist() == [0, 300, 500, 501, 502, 700, 702, 999]
    assert (radius[found] > 1).all() and np.nanmax(radius[~found]) <= 1 and np.isnan(radius[650])


def test_threshold_follows_size_and_tail():
    """Normal and heavy-tailed noise of any length gives few false alarms."""
    rng = np.random.default_rng(3)
    for n in (20, 200, 5000):
        assert np.mean([phase_space(rng.normal(0, 1, n))[0].sum() for _ in range(100)]) < 0.1
    assert phase_space(rng.standard_t(5, 5000))[0].sum() < 25
    assert not phase_space(np.zeros(50))[0].any() and not phase_space(np.empty(0))[0].any() and not phase_space(np.full(20, np.nan))[0].any()


def test_stuck_run_counts_whole_and_with_rounding_noise():
    exp, y = series()
    y[100:115] = y[100] * (1 + 1e-7 * np.arange(15))
    assert set(np.flatnonzero(judge(y, exp) == "stuck")) == set(range(100, 115))


def test_low_counts_repeat_by_nature():
    rng = np.random.default_rng(2)
    y = rng.poisson(0.4, 600).astype(float) + 1
    assert not (judge(y, np.full(600, 1.4)) == "stuck").any()


def test_closing_hours_are_no_fault():
    exp, y = series()
    shut = (np.arange(400) % 24) < 10
    exp, y = np.where(shut, 0, exp), np.where(shut, 0, y)
    assert not judge(y, exp).astype(bool).any()
    assert not judge(y, np.full(400, np.nan)).astype(bool).any()
    y[24 * 3 + 10 : 24 * 3 + 24] = 0  # a whole open day at zero
    assert set(np.flatnonzero(judge(y, exp))) == set(range(82, 96))


def test_shared_level_change_and_busy_day_are_no_fault():
    exp, y = series()
    exp[200:] += 300
    y[200:] += 300
    exp[100:110] += 150
    y[100:110] += 150
    assert not judge(y, exp).astype(bool).any()


def test_missing_forecasts():
    exp, y = series()
    y[77] += 60
    h = exp.copy()
    h[::13] = np.nan
    h[77] = np.nan
    assert set(np.flatnonzero(judge(y, h))) == {77}
    assert set(np.flatnonzero(judge(y, np.full(400, np.nan)))) == {77}


def test_short_and_empty_series():
    assert not judge(np.array([1.0, 500.0]), np.array([1.0, 1.0])).astype(bool).any()
    assert len(judge(np.empty(0), np.empty(0))) == 0
    nothing = np.full(30, np.nan)
    assert not judge(nothing, nothing).astype(bool).any()
    same = np.full(30, 5.0)
    assert (judge(same, same) == "stuck").all()


def test_bounds_nulls_repeats_and_clashing_columns(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (1, "s", "secs", T0, -1.0, 5.0), (2, "s", "count", T0, 1.5, 1.0), (3, "s", "share", T0, 1.2, 0.5), (4, "s", "secs", T0, inf, 5.0), (5, "s", "secs", T0, -inf, 5.0),
        (6, "s", "secs", T0, nan, 5.0), (7, "s", "secs", T0, None, 5.0), (8, None, "secs", T0, -2.0, None), (9, "s", "secs", None, -2.0, None), (10, None, "secs", None, 3.0, None),
        (1, "s", "secs", T0, -1.0, 5.0), (8, None, "secs", T0, -2.0, None), (11, "s", None, T0, -5.0, 1.0), (12, "s", "other", T0, -5.0, 1.0),
    ]
    assert run(spark, rows) == dict.fromkeys([1, 2, 3, 4, 5, 8, 9], "impossible")


def test_empty_table(spark):
    assert run(spark, []) == {}


def test_repeated_deliveries_make_no_run(spark):
    exp, y = series(60)
    rows = rows_of(y, exp)
    assert run(spark, rows * 7) == {}


@pytest.mark.parametrize("block_rows", [300, 100_000])
def test_blocks_of_a_long_series(spark, block_rows):
    """A hot series is judged in blocks; spikes and runs at borders come out once, as without blocks."""
    exp, y = series(2000, seed=5)
    y[[5, 666, 1333, 1999]] += 60
    y[990:1012] = y[990]
    other_exp, other = series(80, seed=6)
    rows = rows_of(y, exp) + rows_of(other, other_exp, "t", first=10_000)
    got = implausible_readings(frame(spark, rows), "obs", "sid", "ds", "y", "yhat", "unit", BOUNDS, block_rows=block_rows).collect()
    assert len(got) == len({r["obs"] for r in got})
    assert {r["obs"]: r["fault"] for r in got} == dict.fromkeys([5, 666, 1333, 1999], "spike") | dict.fromkeys(range(990, 1012), "stuck")


def test_blocks_of_a_long_series_hold_equal_rows(spark):
    """Sparse readings at the end of a long series are judged too."""
    exp, y = series(2000, seed=5)
    y[[5, 1996]] += 60
    rows = [(i, s, u, T0 + dt.timedelta(hours=i if i < 1990 else 1990 + 2000 * (i - 1989)), v, h) for i, s, u, _, v, h in rows_of(y, exp)]
    assert run(spark, rows, block_rows=300) == {5: "spike", 1996: "spike"}
