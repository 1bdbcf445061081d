"""Implausible readings per series: impossible values, spikes and stuck runs.

Method: phase-space thresholding. A reading's deviation from its expected value, in units of the
series' usual deviation at that level, and its first and second differences span three planes; in
each, a robust ellipse whose radius is a universal threshold, scaled to the series' size and tail,
bounds what its readings normally do. Readings outside any of them are taken out, scales are
estimated again, and so on until none is left: those are the spikes, by nothing but the ellipses.
Zero-difference runs longer than the series' own rate of repetition explains are stuck; bounds of
the unit catch impossible readings.

Expected value: the forecast, taken from its neighbours where single values lack, its lasting bias removed; for
series without a forecast the profile of the hour of day (of the weekday, for daily series) on a
running median. Regular closing hours (a reading of zero where about zero is expected) are no faults.

Scale: a series is judged by one vectorised numpy call per block of consecutive readings. Series of
more than ``block_rows`` readings are cut into blocks of about that many by a histogram of their
minutes, each seen together with a tenth of its neighbours, so a series with a third of all rows is
spread over many tasks and every reading is judged exactly once. Readings of one minute stay together.
Scales, profile, closing hours and repetition of a long series are those of the block. Which series
are cut and the histogram are partial aggregates, joined by broadcast only if proven small.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.session import broadcast_if_small, cut

#: Unit → lowest, highest value, whole numbers only.
Bounds = dict[str, tuple[float | None, float | None, bool]]


def impossible(y: Column, unit: Column, bounds: Bounds) -> Column:
    """True for infinite readings and those outside their unit's bounds; false for null and NaN."""
    bad = F.abs(y) == float("inf")
    for u, (low, high, whole) in bounds.items():
        off = F.lit(False)
        if low is not None:
            off = off | (y < low)
        if high is not None:
            off = off | (y > high)
        if whole:
            off = off | (y != F.round(y))
        bad = bad | ((unit == u) & off)
    return F.coalesce(bad & ~F.isnan(y), F.lit(False))


def _mad(x: np.ndarray) -> float:
    x = x[np.isfinite(x)]
    return 1.4826 * float(np.median(np.abs(x - np.median(x)))) if x.size else 0.0


def _rolling_median(x: np.ndarray, width: int, least: int) -> np.ndarray:
    return pd.Series(x).rolling(width, center=True, min_periods=least).median().to_numpy()


def _expected(t: np.ndarray, v: np.ndarray, yhat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expected values and the extra uncertainty of those whose forecast lacks."""
    known = np.isfinite(yhat)
    extra = np.zeros(len(v))
    if known.mean() >= 0.5:
        out = yhat.copy()
        if not known.all():
            line = np.interp(t, t[known], yhat[known])
            at = np.arange(len(v))
            before = np.maximum.accumulate(np.where(known, at, -1))
            after = np.minimum.accumulate(np.where(known, at, len(v))[::-1])[::-1]
            a, b = yhat[np.where(before < 0, after, before)], yhat[np.where(after == len(v), before, after)]
            # anything between the neighbouring forecasts may be expected, as where opening hours begin
            between = np.clip(v, np.minimum(a, b), np.maximum(a, b))
            out[~known] = np.where(np.isfinite(between), between, line)[~known]
            inner = known[1:-1] & known[:-2] & known[2:]
            bend = yhat[1:-1] - (yhat[:-2] + yhat[2:]) / 2
            extra[~known] = _mad(bend[inner]) if inner.any() else 0.0
        return out, extra
    step = np.median(np.diff(t)) if len(t) > 1 else 3600
    slot = (t // 86400) % 7 if step >= 43200 else (t % 86400) // 3600
    base = np.zeros(len(v))
    for _ in range(3):
        profile = pd.Series(v - base).groupby(slot).transform("median").to_numpy()
        rest = v - profile
        base = _rolling_median(rest, 49, 5)
        base = np.where(np.isfinite(base), base, np.nanmedian(rest) if np.isfinite(rest).any() else 0.0)
    out = base + profile
    return np.where(pd.Series(np.where(np.isfinite(v), v, np.nan)).groupby(slot).transform("median").to_numpy() == 0, 0.0, out), extra


#: Planes of phase space by their axes: value, first and second difference.
PLANES = (("value", "first"), ("value", "second"), ("first", "second"))
#: Readings of a series without faults that may be expected outside each plane's ellipse.
FALSE_ALARMS = 0.01


def _tail(z: np.ndarray) -> float:
    """How much farther than a normal sample the outer twentieth of standardised values reaches, 1 at least."""
    at = int(0.95 * (z.size - 1))
    return max(1.0, float(np.partition(np.abs(z), at)[at]) / 1.96) if z.size else 1.0


def phase_space(u: np.ndarray, false_alarms: float = FALSE_ALARMS) -> tuple[np.ndarray, np.ndarray]:
    """(readings outside an ellipse, largest distance in radii per reading) of standardised deviations in order of time.

    Of n normal readings ``n exp(-k² / 2)`` lie outside an ellipse of radius k, so the universal threshold
    at which ``false_alarms`` are expected is ``k = sqrt(2 ln(n / false_alarms))``; it grows with the
    uncertainty of a scale from n readings and with the series' own tail. Axes are MADs, their
    correlation is that of robust scales of sum and difference. In each round the readings outside that
    deviate most among their neighbours are taken out, as a spike puts its neighbours' differences
    outside as well, and the rest is measured again, until none is outside. Null deviations take no part.
    """
    found, radius = np.zeros(len(u), bool), np.full(len(u), np.nan)
    left = np.flatnonzero(np.isfinite(u))
    while left.size >= 8:
        x = u[left] - np.median(u[left])
        n = left.size
        wide = np.concatenate([x[:1], x, x[-1:]])
        axes = {"value": x, "first": (wide[2:] - wide[:-2]) / 2, "second": x - (wide[2:] + wide[:-2]) / 2}
        unit, tail = {}, {}
        for name, z in axes.items():
            z = z - np.median(z)
            size = np.abs(z)
            scale = 1.4826 * float(np.median(size)) or 1.2533 * float(size.mean())
            unit[name] = z / scale if scale > 0 else np.zeros(n)
            tail[name] = _tail(unit[name])
        far = np.zeros(n)
        for a, b in PLANES:
            p, q = unit[a], unit[b]
            # both are centred, and so nearly are their sum and difference
            plus, minus = float(np.median(np.abs(p + q))) ** 2, float(np.median(np.abs(p - q))) ** 2
            r = np.clip((plus - minus) / (plus + minus), -0.95, 0.95) if plus + minus > 0 else 0.0
            dist = np.sqrt(np.maximum((p * p - 2 * r * p * q + q * q) / (1 - r * r), 0.0))
            far = np.maximum(far, dist / max(tail[a], tail[b]))
        far /= np.sqrt(2 * np.log(n / false_alarms)) * (1 + 2.32 / np.sqrt(n))
        radius[left] = far
        size = np.concatenate([[-1.0], np.abs(x), [-1.0]])
        out = (far > 1) & (size[1:-1] >= size[2:]) & (size[1:-1] >= size[:-2])
        if not out.any():
            break
        found[left[out]] = True
        left = left[~out]
    return found, radius


def judge_series(t: np.ndarray, y: np.ndarray, yhat: np.ndarray, bad: np.ndarray, false_alarms: float = FALSE_ALARMS, min_run: int = 6, rounding: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Kind ('' | 'impossible' | 'spike' | 'stuck') and score of readings in order of time (seconds).

    ``bad``: impossible by unit. A reading that is stuck and far off is called stuck.
    """
    n = len(y)
    kind, score = np.full(n, "", object), np.full(n, np.nan)
    read = np.isfinite(y) & ~bad
    if read.sum() >= 8:
        v = np.where(read, y, np.nan)
        exp, extra = _expected(t, v, yhat)
        level = np.abs(exp)
        pos = level[read & (level > 0)]
        usual = float(np.median(pos)) if pos.size else 0.0
        closed = read & (y == 0) & (level <= 0.02 * usual)

        # stuck: runs of equal readings; nulls in between do not end a run
        at = np.flatnonzero(read)
        same = np.abs(np.diff(y[at])) <= rounding * np.abs(y[at][1:])
        run = np.concatenate([[0], np.cumsum(~same)])
        first = np.searchsorted(run, np.arange(run[-1] + 1))
        length = np.bincount(run, weights=~closed[at]).astype(int)
        zero = y[at][first] == 0
        short = length[(length > 0) & (length < min_run)]
        repeats = (short - 1).sum() / max(short.sum(), 1)
        longest = 2 + np.ceil(np.log(len(at) / 1e-3) / -np.log(min(max(repeats, 1e-6), 0.9)))
        stuck_runs = length >= max(min_run, longest)
        stuck = np.zeros(n, bool)
        for r in np.flatnonzero(stuck_runs):
            members = at[first[r] : (first[r + 1] if r + 1 < len(first) else len(at))]
            if zero[r]:  # from the first to the last zero outside closing hours
                open_ = np.flatnonzero(~closed[members])
                members = members[open_[0] : open_[-1] + 1]
            stuck[members] = True

        # deviation in units of what is usual at that level
        e = v - exp
        ok = read & ~stuck & ~closed & np.isfinite(e)
        if ok.sum() >= 8:
            low, high = ok & (level <= np.median(level[ok])), ok & (level > np.median(level[ok]))
            best = None
            for p in (0.0, 0.5, 1.0):
                w = np.maximum(level, 0.05 * usual + 1e-300) ** p
                u = e / w
                c = np.median(u[ok])
                ratio = abs(np.log((np.median(np.abs(u[low] - c)) + 1e-12) / (np.median(np.abs(u[high] - c)) + 1e-12))) if low.any() and high.any() else 0.0
                if best is None or ratio < best[0]:
                    best = (ratio, w, u - c)
            _, w, u = best
            s = max(_mad(u[ok]), 1e-9 * max(usual, 1e-9))
            u = u / s
            drift = _rolling_median(np.where(ok, u, np.nan), 25, 13)
            u = np.where(np.abs(drift) > 3, u - drift, u)
            u = u / np.sqrt(1 + (extra / (w * s)) ** 2)
            u = np.where(ok, u, np.nan)
            spike, score = phase_space(u, false_alarms)
            kind[spike] = "spike"
        kind[stuck] = "stuck"
    kind[bad] = "impossible"
    return kind, score


def implausible_readings(df: DataFrame, key: str, series: str, time: str, value: str, expected: str, unit: str, bounds: Bounds, false_alarms: float = FALSE_ALARMS, block_rows: int = 20_000) -> DataFrame:
    """Faulty readings: rows ``<key>, fault ('impossible' | 'spike' | 'stuck'), score``.

    Null and NaN readings are no faults. Repeated deliveries (equal ``key``) count once. Readings
    without series or time are only held against the bounds. Series with under eight readings too.
    ``score``: distance in radii of the ellipses, over 1 for a spike, null where there is none.
    """
    kind = df.schema[key].dataType.simpleString()
    c = lambda n: F.col(n)
    rows = df.select(
        c(key).alias("k"), c(series).cast("string").alias("s"), F.unix_timestamp(c(time).cast("timestamp")).cast("long").alias("t"),
        c(value).cast("double").alias("y"), c(expected).cast("double").alias("e"), impossible(c(value).cast("double"), c(unit), bounds).alias("bad"),
    )
    placed = F.col("s").isNotNull() & F.col("t").isNotNull()
    # one aggregate: which series are long, and whether any faulty reading has no series or time
    stray = F.count_if(~placed & F.col("bad"))
    known = F.when(placed, F.col("t"))
    sizes = rows.groupBy("s").agg(F.count(known).alias("n"), stray.alias("stray"))
    noted = cut(sizes.where((F.col("n") > block_rows) | (F.col("stray") > 0)))
    large = noted.where((F.col("n") > block_rows) & F.col("s").isNotNull()).drop("stray")
    strays = rows.where(~placed & F.col("bad")) if not noted.where("stray > 0").isEmpty() else None
    rows = rows.where(placed)
    if large.isEmpty():
        blocked = rows.withColumn("b", F.lit(0).cast("long")).withColumn("own", F.lit(True))
    else:
        # readings before a minute's middle, in blocks of the series
        minute = F.floor(F.col("t") / 60)
        counts = rows.join(broadcast_if_small(large), "s").groupBy("s", minute.alias("m"), "n").agg(F.count(F.lit(1)).alias("c"))
        before = F.sum("c").over(Window.partitionBy("s").orderBy("m").rowsBetween(Window.unboundedPreceding, 0)) - F.col("c") / 2
        blocks = F.ceil(F.col("n") / block_rows)
        places = cut(counts.select("s", "m", blocks.alias("blocks"), (before * blocks / F.col("n")).alias("x")))
        joined = rows.withColumn("m", minute).join(broadcast_if_small(places), ["s", "m"], "left").withColumn("x", F.coalesce("x", F.lit(0.5)))
        home = F.floor("x")
        off = F.col("x") - home
        copies = F.array_compact(F.array(home, F.when((off < 0.1) & (home > 0), home - 1), F.when((off > 0.9) & (home + 1 < F.col("blocks")), home + 1)))
        blocked = joined.withColumn("home", home).withColumn("b", F.explode(copies)).withColumn("own", F.col("b") == F.col("home"))

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("k").sort_values(["t", "k"])
        with np.errstate(all="ignore"):
            fault, score = judge_series(pdf.t.to_numpy(float), pdf.y.to_numpy(float), pdf.e.to_numpy(float), pdf.bad.to_numpy(bool), false_alarms)
        out = pd.DataFrame({"k": pdf.k.to_numpy(), "fault": fault, "score": score})
        return out[(fault != "") & pdf.own.to_numpy(bool)]

    found = blocked.select("k", "s", "b", "t", "y", "e", "bad", "own").groupBy("s", "b").applyInPandas(judge, f"k {kind}, fault string, score double")
    found = found.withColumn("score", F.nanvl("score", F.lit(None).cast("double")))
    if strays is not None:
        found = found.unionByName(strays.select("k").distinct().select("k", F.lit("impossible").alias("fault"), F.lit(None).cast("double").alias("score")))
    return found.withColumnRenamed("k", key)
