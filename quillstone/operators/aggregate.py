"""Aggregations: ordered lists, weighted means, weighted histograms, frequencies, frame inspection, joins."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.operators.clean import no_nan


def ordered_list(col: str, order: Sequence[str]) -> Column:
    """Aggregate: values of a group as an array in the order given, nulls kept."""
    item = F.struct(*[F.col(o).alias(f"o{i}") for i, o in enumerate(order)], F.col(col).alias("v"))
    return F.transform(F.sort_array(F.collect_list(item)), lambda x: x["v"])


def list_gb(df: DataFrame, gb_cols: Sequence[str], from_col: str, order: Sequence[str]) -> DataFrame:
    """Group → list. A group's list is one row: use it where groups are bounded."""
    return df.groupBy(*gb_cols).agg(ordered_list(from_col, order).alias(from_col))


def col_list_gb(df: DataFrame, gb_cols: Sequence[str], cols: Sequence[str], order: Sequence[str]) -> DataFrame:
    return df.groupBy(*gb_cols).agg(*[ordered_list(c, order).alias(c) for c in cols])


def w_mean(m: str, w: str) -> Column:
    """Aggregate: weighted mean over rows with both values; null without weight."""
    both = no_nan(m).isNotNull() & no_nan(w).isNotNull()
    return F.try_divide(F.sum(F.when(both, no_nan(m) * no_nan(w))), F.sum(F.when(both, no_nan(w))))


def df_hist(df: DataFrame, v_col: str, w_col: str, g_col: str, values: Sequence[str]) -> DataFrame:
    """Share of the weight of each value per group: ``g_col, <v_col>:<value>..., w_col`` (total of the listed values)."""
    kept = df.where(F.col(v_col).isin(*values))
    sums = [F.coalesce(F.sum(F.when(F.col(v_col) == v, F.col(w_col))), F.lit(0.0)).alias(f"_s{i}") for i, v in enumerate(values)]
    out = kept.groupBy(g_col).agg(F.sum(w_col).alias(w_col), *sums)
    return out.select(g_col, *[F.try_divide(F.col(f"_s{i}"), F.col(w_col)).alias(f"{v_col}:{v}") for i, v in enumerate(values)], w_col)


def value_counts(df: DataFrame, cols: Sequence[str], normalize: bool = False) -> DataFrame:
    """Frequency of each combination, ``n`` or ``share``."""
    out = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
    if not normalize:
        return out
    total = df.agg(F.count(F.lit(1)).alias("_t"))
    return out.crossJoin(F.broadcast(total)).select(*cols, (F.col("n") / F.col("_t")).alias("share"))  # one row


def top_k(df: DataFrame, cols: Sequence[str], k: int) -> DataFrame:
    """The k most frequent combinations; ties by value."""
    return value_counts(df, cols).orderBy(F.desc("n"), *cols).limit(k)


def point_masses(df: DataFrame, col: str, min_mass: float = 0.05) -> DataFrame:
    """Values that make up more than ``min_mass`` of the non-null values: ``value, mass``."""
    x = no_nan(col)
    counts = df.where(x.isNotNull()).groupBy(x.alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(x).alias("_t"))
    return counts.crossJoin(F.broadcast(total)).select("value", (F.col("n") / F.col("_t")).alias("mass")).where(F.col("mass") > min_mass)  # one row


def update_mass(masses: dict[float, float], pt: float, mass: float, tol: float = 1e-4) -> dict[float, float]:
    """Adds mass at the nearest point within ``tol``, else as a new point."""
    near = min(masses, key=lambda v: abs(v - pt), default=None)
    at = near if near is not None and abs(near - pt) <= tol else pt
    return masses | {at: masses.get(at, 0.0) + mass}


def df_inspect(df: DataFrame, approx: bool = True) -> DataFrame:
    """Rows ``column, dtype, n_rows, nulls, distinct, min, max, mean, std`` from one aggregate."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, f in enumerate(df.schema.fields):
        c = F.col(f"`{f.name}`")
        num = isinstance(f.dataType, T.NumericType)
        simple = isinstance(f.dataType, (T.AtomicType,))
        null = c.isNull() | F.isnan(c) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else c.isNull()
        distinct = (F.approx_count_distinct(c) if approx else F.count_distinct(c)) if simple else F.lit(None).cast("long")
        x = no_nan(c) if num else F.lit(None).cast("double")
        aggs += [F.count_if(null).alias(f"nulls{i}"), distinct.alias(f"distinct{i}"), (F.min(c).cast("string") if simple else F.lit(None).cast("string")).alias(f"min{i}"), (F.max(c).cast("string") if simple else F.lit(None).cast("string")).alias(f"max{i}"), F.avg(x).alias(f"mean{i}"), F.stddev_samp(x).alias(f"std{i}")]
    one = df.agg(*aggs)
    rows = [F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("dtype"), F.col("n").alias("n_rows"), *[F.col(f"{k}{i}").alias(k) for k in ("nulls", "distinct", "min", "max", "mean", "std")]) for i, f in enumerate(df.schema.fields)]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def df_size_mb(df: DataFrame) -> float:
    """The optimizer's size estimate in MB."""
    return float(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString()) / 1e6


def suffix_join(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner", suffixes: tuple[str, str] = ("_1", "_2")) -> DataFrame:
    """Equi-join in which all other columns get suffixes."""
    named = lambda d, s: d.select(*keys, *[F.col(f"`{c}`").alias(c + s) for c in d.columns if c not in keys])
    return named(a, suffixes[0]).join(named(b, suffixes[1]), list(keys), how)


def multi_merge(dfs: Sequence[DataFrame], keys: Sequence[str], how: str = "outer") -> DataFrame:
    """Joins several frames on the same keys."""
    return reduce(lambda x, y: x.join(y, list(keys), how), dfs)


def pair_counts(df: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    """``df`` with the number of rows of each key; hot keys are counted by partial aggregation, then joined."""
    return df.join(df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)), list(keys), "left")


def stack(*dfs: DataFrame) -> DataFrame:
    """Rows of all frames by column name; missing columns are null."""
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), dfs)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in the order given: a mergeable minimum, not a window."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min(F.struct(*[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)], *rest)).alias("_r")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)


def running(df: DataFrame, by: Sequence[str], order: Sequence[str], col: str) -> DataFrame:
    """``df`` with previous and next value, difference, running sum, maximum and minimum of ``col``."""
    w = Window.partitionBy(*by).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    c = F.col(col)
    return df.withColumns({f"{col}_lag": F.lag(c).over(w), f"{col}_lead": F.lead(c).over(w), f"{col}_diff": c - F.lag(c).over(w), f"{col}_cumsum": F.sum(c).over(upto), f"{col}_cummax": F.max(c).over(upto), f"{col}_cummin": F.min(c).over(upto)})


def regression(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """``by, slope, intercept, r2, n, x_min, x_max``: the line of a scatter plot, from one mergeable aggregate."""
    a, b = no_nan(x), no_nan(y)
    return df.groupBy(*by).agg(F.regr_slope(b, a).alias("slope"), F.regr_intercept(b, a).alias("intercept"), F.regr_r2(b, a).alias("r2"), F.regr_count(b, a).alias("n"), F.min(a).alias("x_min"), F.max(a).alias("x_max"))


def column_changes(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows only in new, rows only in old, distinct rows in both), with repeats counted in the first two."""
    cols = [c for c in old.columns if c in new.columns]
    a, b = old.select(*cols), new.select(*cols)
    return b.exceptAll(a), a.exceptAll(b), a.intersect(b)


def scatter_cells(df: DataFrame, x: str, y: str, z: str, nx: int = 50, ny: int = 50) -> DataFrame:
    """``xb, yb, n, z, shade``: rows per cell of an even grid, mean of ``z`` and its place between the smallest and largest mean.

    The data of a scatter plot shaded by a third column, for any number of rows: at most ``nx * ny``.
    Rows without x, y or z are left out.
    """
    a, b, c = no_nan(x), no_nan(y), no_nan(z)
    rows = df.select(a.alias("x"), b.alias("y"), c.alias("z")).where("x is not null and y is not null and z is not null")
    ends = rows.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    place = lambda v, n: F.when(F.col(f"{v}1") > F.col(f"{v}0"), F.least(F.lit(n - 1), F.floor((F.col(v) - F.col(f"{v}0")) / (F.col(f"{v}1") - F.col(f"{v}0")) * n))).otherwise(F.lit(0)).cast("int")
    cells = rows.crossJoin(F.broadcast(ends)).groupBy(place("x", nx).alias("xb"), place("y", ny).alias("yb")).agg(F.count(F.lit(1)).alias("n"), F.avg("z").alias("z"))  # one row of ends
    tone = cells.agg(F.min("z").alias("z0"), F.max("z").alias("z1"))
    shade = F.coalesce(F.try_divide(F.col("z") - F.col("z0"), F.col("z1") - F.col("z0")), F.lit(0.0))
    return cells.crossJoin(F.broadcast(tone)).select("xb", "yb", "n", "z", shade.alias("shade"))  # one row
