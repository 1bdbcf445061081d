"""Exact interpolated quantiles of whole numeric columns without holding a column's values in one task.

Bisection: for every rank that is asked for, the interval of values that holds it is kept. A pass counts
the values of each interval in ``PARTS`` even parts by one partial aggregate (at most ``PARTS`` rows per
interval and column reach the driver, with the smallest and largest value of each part) and keeps the
parts with a rank, until those hold one value only. Values may be spread over many orders: a part shrinks
to the values in it, so passes are few. ``percentile`` per group remains for groups that fit a task.
Few intervals are told apart by an expression; many, as of a thousand ranks, are searched by numpy.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.session import broadcast_if_small, cut, small

#: Parts that the intervals of a column are split into in one pass, all together.
PARTS = 8192

#: Intervals of a column that one expression tells apart; with more, it would be too deep and try each of them on every row.
CASES = 100


def _value(c: str | Column) -> Column:
    return F.nanvl(F.col(c).cast("double") if isinstance(c, str) else c.cast("double"), F.lit(None).cast("double"))


def _counts_of_many(df: DataFrame, x: Column, spans: Sequence[tuple], parts: int) -> list[dict]:
    """``at, n, lo, hi`` of the parts of many disjoint ascending intervals: the interval of a value is found by binary search, parts are merged in each task."""
    lows, highs = (np.array(ends) for ends in zip(*[s[:2] for s in spans]))
    # by halves where the width of an interval is beyond the doubles
    scale = np.array([1.0 if math.isfinite(hi - lo) else 0.5 for lo, hi in zip(lows.tolist(), highs.tolist())])
    width = highs * scale - lows * scale

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(lows) * parts, np.int64)
        lo, hi = np.full(len(n), np.inf), np.full(len(n), -np.inf)
        for b in batches:
            v = b.column(0).to_numpy(zero_copy_only=False)
            i = np.searchsorted(lows, v, "right") - 1
            inside = (i >= 0) & (v <= highs[i])
            v, i = v[inside], i[inside]
            at = i * parts + np.minimum(parts - 1, ((v * scale[i] - lows[i] * scale[i]) / width[i] * parts).astype(np.int64))
            n += np.bincount(at, minlength=len(n))
            np.minimum.at(lo, at, v)
            np.maximum.at(hi, at, v)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (at, n[at], lo[at], hi[at])], ["at", "n", "lo", "hi"])

    values = df.select(x.alias("x")).where(F.col("x").between(float(lows[0]), float(highs[-1])))
    each = values.mapInArrow(run, "at long, n long, lo double, hi double")
    return each.groupBy("at").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).toArrow().to_pylist()


def order_statistics(df: DataFrame, ranks: dict[str, Sequence[int]], ends: dict[str, tuple[float, float]]) -> dict[str, dict[int, float]]:
    """The values of 0-based ``ranks`` of each column among its finite values; ``ends``: smallest and largest."""
    out: dict[str, dict[int, float]] = {c: {} for c in ranks}
    # per column (lo, hi, values below, ranks inside)
    open_: dict[str, list[tuple[float, float, int, list[int]]]] = {c: [(*ends[c], 0, sorted(set(r)))] for c, r in ranks.items() if len(r)}
    while True:
        todo = {}
        for c, spans in open_.items():
            for lo, hi, _, inside in spans:
                if lo == hi:
                    out[c].update(dict.fromkeys(inside, lo))
            left = [s for s in spans if s[0] < s[1]]
            if left:
                todo[c] = left
        if not todo:
            return out
        names = list(todo)
        items, got = [], []
        for k, c in enumerate(names):
            x, parts = _value(c), max(16, PARTS // len(todo[c]))
            if len(todo[c]) > CASES:
                got += [r | {"k": k} for r in _counts_of_many(df, x, todo[c], parts)]
                continue
            place = F.lit(None).cast("int")
            for i, (lo, hi, _, _) in reversed(list(enumerate(todo[c]))):
                # by halves where the width of an interval is beyond the doubles
                at = (x - lo) / (hi - lo) * parts if math.isfinite(hi - lo) else (x / 2 - lo / 2) / (hi / 2 - lo / 2) * parts
                place = F.when(x.between(lo, hi), F.least(F.lit(parts - 1), F.floor(at)).cast("int") + i * parts).otherwise(place)
            items.append(F.when(place.isNotNull(), F.struct(F.lit(k).alias("k"), place.alias("at"), x.alias("x"))))
        if items:
            each = df.select(F.explode(F.array_compact(F.array(*items))).alias("v")).select("v.*")
            got += each.groupBy("k", "at").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).toArrow().to_pylist()
        found: dict[tuple[int, int], list[dict]] = {}
        for r in got:
            parts = max(16, PARTS // len(todo[names[r["k"]]]))
            found.setdefault((r["k"], r["at"] // parts), []).append(r)
        open_ = {}
        for k, c in enumerate(names):
            spans = []
            for i, (_, _, below, inside) in enumerate(todo[c]):
                for r in sorted(found.get((k, i), []), key=lambda r: r["at"]):
                    held = inside[bisect_left(inside, below) : bisect_left(inside, below + r["n"])]
                    if held:
                        spans.append((r["lo"], r["hi"], below, held))
                    below += r["n"]
            open_[c] = spans


def column_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> dict[str, list[float] | None]:
    """Linearly interpolated quantiles of each column (null and NaN do not count); None for a column without values."""
    finite = {c: F.when(F.abs(_value(c)) < math.inf, _value(c)) for c in cols}
    head = df.agg(*[f(v).alias(f"{n}{i}") for i, c in enumerate(cols) for n, f, v in (("n", F.count, _value(c)), ("low", F.count_if, _value(c) == -math.inf), ("high", F.count_if, _value(c) == math.inf), ("lo", F.min, finite[c]), ("hi", F.max, finite[c]))]).first()
    sizes = {c: head[f"n{i}"] for i, c in enumerate(cols)}
    # ranks of infinite values are known; those of the others count from the first finite one
    below = {c: head[f"low{i}"] for i, c in enumerate(cols)}
    upto = {c: sizes[c] - head[f"high{i}"] for i, c in enumerate(cols)}
    at = {c: [p * (n - 1) for p in probs] for c, n in sizes.items() if n}
    ranks = {c: [k - below[c] for p in ps for k in (math.floor(p), math.ceil(p)) if below[c] <= k < upto[c]] for c, ps in at.items()}
    ends = {c: (head[f"lo{i}"], head[f"hi{i}"]) for i, c in enumerate(cols)}
    got = order_statistics(df, ranks, ends)

    def value(c: str, k: int) -> float:
        return -math.inf if k < below[c] else math.inf if k >= upto[c] else got[c][k - below[c]]

    def between(c: str, p: float) -> float:
        a, b, w = value(c, math.floor(p)), value(c, math.ceil(p)), p - math.floor(p)
        return a if a == b else a + (b - a) * w if math.isfinite(b - a) else a * (1 - w) + b * w

    return {c: [between(c, p) for p in at[c]] if sizes[c] else None for c in cols}


#: Rows of one window that a single task sorts without harm; more are summed in ranges.
WINDOW_ROWS = 1_000_000


def running_sums(df: DataFrame, by: Sequence[str], order: str, cols: Sequence[str]) -> DataFrame:
    """``df`` with ``<c>_upto`` (sum up to and with the row in ``order``) and ``<c>_total`` of each column, per group.

    Rows must be unique by (``by``, ``order``). A table of more than ``WINDOW_ROWS`` rows is parted by
    ranges of the order: each range is summed, the sums of the ranges before are added, so no group has
    to fit one task. The result is the same either way.
    """
    kept = cut(df)
    names = [f"{c}_{k}" for c in cols for k in ("upto", "total")]
    if small(kept, WINDOW_ROWS):
        w = Window.partitionBy(*(by or [F.lit(0)]))
        return kept.withColumns({n: F.sum(c).over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, 0) if n.endswith("upto") else w) for c in cols for n in names if n.startswith(f"{c}_")})
    ranged = cut(kept.repartitionByRange(*by, order).withColumn("_range", F.spark_partition_id()))
    sums = ranged.groupBy("_range", *by).agg(*[F.sum(c).alias(c) for c in cols])
    # one row per range and group in it
    w = Window.partitionBy(*(by or [F.lit(0)]))
    before = sums.select(F.col("_range").alias("_r"), *[F.col(b).alias(f"_by{i}") for i, b in enumerate(by)], *[x for c in cols for x in (F.coalesce(F.sum(c).over(w.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"_{c}_before"), F.sum(c).over(w).alias(f"{c}_total"))])
    match = F.col("_range") == F.col("_r")
    for i, b in enumerate(by):
        match = match & F.col(b).eqNullSafe(F.col(f"_by{i}"))
    inner = Window.partitionBy("_range", *by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    both = ranged.join(broadcast_if_small(before), match)
    return both.withColumns({f"{c}_upto": F.sum(c).over(inner) + F.col(f"_{c}_before") for c in cols}).select(*df.columns, *names)
