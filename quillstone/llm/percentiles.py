"""Percentiles per group of very large numeric columns, exact or with bounded relative error.

Method: exact bisection. For every group and percentile an interval of values is kept that holds the
target rank. Each pass counts the rows below the midpoints inside the intervals and keeps the part with
the rank, until the smallest and the largest value of a part are the same: the exact percentile. The
first pass halves by magnitude: its parts are the cells of ``cell_of``, 2**``CELL_BITS`` an octave. Each
further pass halves an interval between its smallest and its largest value ``BITS`` times at once: rows
are counted per part of 1 / 2**``BITS``, so the counts below all midpoints of those halvings come from
one scan. Intervals shrink to values that occur, so few passes are left after the cells.

Bounded error and combination: ``cell_counts`` keeps how many values lie in each cell, one row per part
(a day, say) and group; such tables are added up by ``combine_counts``, and ``cell_percentiles`` gives
the cell of each percentile. As counts are whole numbers, the result does not depend on the split, and
the value given differs from the exact percentile by less than 2**-``CELL_BITS`` (0.8 %) of it.

Scale: the only shuffles of rows are partial counts (at most the cells of a group and column per map
task); no group is collected, a group with a third of all rows is counted on all tasks first. After the
first pass only rows inside intervals that are not resolved are looked at: they are counted by value and
kept. Tables of intervals are broadcast behind a check of their size, else joined by a shuffle.

The percentile p of n values is the one of rank ``ceil(p * n)`` (1 at least) in ascending order,
as ``percentile_disc``/``quantile_disc`` in SQL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.session import broadcast_if_small, cut

#: Halvings of an interval in a pass.
BITS = 16
#: Halvings of an octave that make a cell.
CELL_BITS = 7
#: Added to exponents so that those of all doubles are positive.
_SHIFT = 1075
#: A table of intervals is broadcast up to so many rows.
BROADCAST_INTERVALS = 20_000


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def cell_of(x: Column) -> Column:
    """The cell of a finite double as an int in the order of the values; 0 for zero.

    Exponent and leading bits are found by arithmetic that is exact: the logarithm only proposes the exponent.
    """
    a = F.abs(x)
    e = F.least(F.floor(F.log2(a)).cast("int"), F.lit(1023))
    r = a / F.pow(F.lit(2.0), e)
    over, under = (r >= 2).cast("int"), (r < 1).cast("int")
    lead = F.floor((r * (1 - over * 0.5 + under) - 1) * (1 << CELL_BITS)).cast("int")
    cell = (e + over - under + _SHIFT) * (1 << CELL_BITS) + lead + 1
    return F.coalesce(F.signum(x).cast("int") * cell, F.lit(0))


def cell_value(c: Column) -> Column:
    """The end of a cell that is nearer to zero."""
    k = F.abs(c) - 1
    value = F.pow(F.lit(2.0), F.floor(k / (1 << CELL_BITS)) - _SHIFT) * (1 + F.pmod(k, F.lit(1 << CELL_BITS)) / (1 << CELL_BITS))
    return F.when(c == 0, F.lit(0.0)).otherwise(F.signum(c) * value)


def _each(df: DataFrame, columns: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Rows ``*keep, c, x``: one for each finite value of each column."""
    found = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.when(finite(F.col(c)), F.col(c) + F.lit(0.0)).alias("x")) for c in columns]))
    return df.select(*keep, found.alias("v")).select(*keep, "v.c", "v.x").where(F.col("x").isNotNull())


def _ranked(counts: DataFrame, by: Sequence[str], order: str, percentiles: Sequence[float]) -> DataFrame:
    """Of counts per ordered part: a row for each percentile with the part that holds it, its rank there and the total."""
    w = Window.partitionBy(*by)
    upto = counts.withColumns({"upto": F.sum("n").over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("n").over(w)})
    ranks = F.array(*[F.struct(F.lit(float(p)).alias("p"), F.greatest(F.ceil(F.lit(float(p)) * F.col("total") - 1e-9), F.lit(1)).alias("rank")) for p in percentiles])
    inside = upto.withColumn("t", F.explode(F.filter(ranks, lambda t: (t["rank"] > F.col("upto") - F.col("n")) & (t["rank"] <= F.col("upto")))))
    return inside.withColumns({"p": F.col("t.p"), "rank": F.col("t.rank") - F.col("upto") + F.col("n")}).drop("t", "upto", "n")


def cell_counts(df: DataFrame, group: str, columns: Sequence[str], parts: Sequence[str]) -> DataFrame:
    """What is kept of a part: rows ``*parts, <group>`` with an array of ``(cell, n)`` in order per column, to be combined."""
    rows = df.select(*parts, F.col(group).alias("_g"), *[F.col(c).cast("double").alias(c) for c in columns])
    counts = _each(rows, columns, [*parts, "_g"]).groupBy(*parts, "_g", "c", cell_of(F.col("x")).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    # at most as many entries as the doubles have cells
    return counts.groupBy(*parts, "_g").agg(*[F.sort_array(F.collect_list(F.when(F.col("c") == c, F.struct("cell", "n")))).alias(c) for c in columns]).withColumnRenamed("_g", group)


def combine_counts(kept: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """Kept counts of any parts, put together, as rows ``g, c, cell, n`` of the whole."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("cells")) for c in columns]))
    cells = kept.select(F.col(group).alias("g"), each.alias("v")).select("g", "v.c", F.explode("v.cells").alias("e"))
    return cells.groupBy("g", "c", F.col("e.cell").alias("cell")).agg(F.sum("e.n").alias("n"))


def cell_percentiles(counts: DataFrame, percentiles: Sequence[float]) -> DataFrame:
    """Rows ``g, c, p, value, n`` from ``combine_counts``; the value is the end of its cell that is nearer to zero."""
    hits = _ranked(counts, ["g", "c"], "cell", percentiles)
    return hits.select("g", "c", "p", cell_value(F.col("cell")).alias("value"), F.col("total").alias("n"))


def bisect_percentiles(rows: DataFrame, columns: Sequence[str], percentiles: Sequence[float]) -> DataFrame:
    """Rows ``g, c, p, value, n`` of the exact percentiles of ``columns`` per ``g``; null groups are a group of their own.

    ``rows`` is scanned twice, so pass something materialised. Groups without a value do not occur.
    """
    each = _each(rows, columns, ["g"]).withColumn("cell", cell_of(F.col("x")))
    counts = each.groupBy("g", "c", "cell").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    found = cut(_ranked(counts, ["g", "c"], "cell", percentiles))
    done = found.where("lo = hi").select("g", "c", "p", F.col("lo").alias("value"), F.col("total").alias("n"))
    # the values inside the intervals that hold a rank and more than one value, counted
    spans = cut(found.where("lo < hi").select("g", "c", "cell").distinct().withColumn("span", F.monotonically_increasing_id()))
    if spans.isEmpty():
        return done
    marked = broadcast_if_small(spans, BROADCAST_INTERVALS).alias("s")
    a, s = each.alias("a"), marked
    inside = cut(a.join(s, F.col("a.g").eqNullSafe(F.col("s.g")) & (F.col("a.c") == F.col("s.c")) & (F.col("a.cell") == F.col("s.cell"))).groupBy("s.span", "a.x").agg(F.count(F.lit(1)).alias("n")))
    f = found.where("lo < hi").alias("f")
    wanted = cut(f.join(spans.alias("s"), F.col("f.g").eqNullSafe(F.col("s.g")) & (F.col("f.c") == F.col("s.c")) & (F.col("f.cell") == F.col("s.cell"))).select("f.g", "f.c", "f.p", "f.rank", "f.total", "f.lo", "f.hi", "s.span"))
    while True:
        edges = wanted.select("span", "lo", "hi").distinct()
        place = F.least(F.lit((1 << BITS) - 1), F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * (1 << BITS)))
        placed = inside.join(broadcast_if_small(edges, BROADCAST_INTERVALS), "span").withColumn("part", place)
        counts = placed.groupBy("span", "part").agg(F.sum("n").alias("n"), F.min("x").alias("new_lo"), F.max("x").alias("new_hi"))
        upto = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("span").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)))
        near = upto.join(wanted, "span").where((F.col("rank") > F.col("upto") - F.col("n")) & (F.col("rank") <= F.col("upto")))
        near = cut(near.select("g", "c", "p", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"), "total", F.col("new_lo").alias("lo"), F.col("new_hi").alias("hi"), "span", "part"))
        done = done.unionByName(near.where("lo = hi").select("g", "c", "p", F.col("lo").alias("value"), F.col("total").alias("n")))
        rest = near.where("lo < hi")
        if rest.isEmpty():
            return done
        spans = cut(rest.select("span", "part").distinct().withColumn("next", F.monotonically_increasing_id()))
        inside = cut(placed.join(broadcast_if_small(spans, BROADCAST_INTERVALS), ["span", "part"]).select(F.col("next").alias("span"), "x", "n"))
        wanted = cut(rest.join(spans, ["span", "part"]).drop("span", "part").withColumnRenamed("next", "span"))


def group_percentiles(df: DataFrame, group: str, columns: Sequence[str], percentiles: Sequence[float], record_key: str | None = None) -> DataFrame:
    """Rows ``<group>, column_name, p, value, n`` of the finite values of ``columns``.

    Nulls, NaN and infinite values are left out; a null group counts as a group; a group without a
    usable value does not occur; an empty table gives an empty result. With ``record_key``, equal
    deliveries of a record count once.
    """
    rows = df.select(*([F.col(record_key).alias("_id")] if record_key else []), F.col(group).alias("g"), *[F.col(c).cast("double").alias(c) for c in columns])
    if record_key:
        rows = cut(rows.distinct().drop("_id"))
    out = bisect_percentiles(rows, columns, percentiles)
    return out.select(F.col("g").alias(group), F.col("c").alias("column_name"), "p", "value", "n")
