"""Filters and cleaning: trimming, bands, recoding, de-duplication, gap filling, flattening.

NaN is turned into null before thresholds are taken; a null is never outside a band, so its row
stays. Order-sensitive operators take the order column.
"""

from __future__ import annotations

import json
import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.operators.quantiles import column_quantiles
from quillstone.session import broadcast_if_small


def no_nan(c: str | Column) -> Column:
    """A double column with NaN as null."""
    return F.nanvl(F.col(c).cast("double") if isinstance(c, str) else c.cast("double"), F.lit(None).cast("double"))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def iqr_bounds(c: str | Column, coef: float = 3.0, q_lwr: float = 0.25, q_upr: float = 0.75, accuracy: int | None = None) -> Column:
    """Aggregate: struct(upr, lwr) at ``coef`` interquartile ranges beyond the quartiles.

    Exact and interpolated; this holds the distinct values of a group in memory. For columns with
    very many of them in one group give ``accuracy``: mergeable approximate quantiles of rank error
    1 / accuracy.
    """
    at = sorted((q_lwr, q_upr))
    q = F.percentile_approx(no_nan(c), at, accuracy) if accuracy else F.percentile(no_nan(c), F.array(*[F.lit(p) for p in at]))
    iqr = q[1] - q[0]
    return F.struct((q[1] + coef * iqr).alias("upr"), (q[0] - coef * iqr).alias("lwr"))


def median_band(c: str | Column, coef: float = 3.0) -> Column:
    """Aggregate: struct(upr, lwr) at ``coef`` sample deviations about the median."""
    x = no_nan(c)
    m, s = F.median(x), F.stddev_samp(x)
    return F.struct((m + coef * s).alias("upr"), (m - coef * s).alias("lwr"))


def trim_df(df: DataFrame, cols: Sequence[str] | None = None, rge: float = 1.5, qtiles: tuple[float, float] = (0.25, 0.75), upr: bool = True, lwr: bool = True, by: Sequence[str] = (), accuracy: int | None = None) -> DataFrame:
    """``df`` without rows that lie outside the IQR band in any chosen column.

    Bounds are kept; null and NaN never trim; a column without a range (all null) trims nothing.
    Without ``by`` the bounds are exact, found by bisection (``column_quantiles``) whatever the size; with
    ``by`` they come from one aggregate per group, see ``iqr_bounds`` for ``accuracy``.
    """
    cols = list(cols) if cols is not None else numeric_columns(df)
    if not cols:
        return df
    names = {c: f"_b{i}" for i, c in enumerate(cols)}
    lo, hi = min(qtiles), max(qtiles)
    if not by and not accuracy:
        out = F.lit(False)
        for c, q in column_quantiles(df, cols, [lo, hi]).items():
            if q is None or not all(map(math.isfinite, q)):
                continue
            reach, x = rge * (q[1] - q[0]), no_nan(c)
            if upr:
                out = out | F.coalesce(x > q[1] + reach, F.lit(False))
            if lwr:
                out = out | F.coalesce(x < q[0] - reach, F.lit(False))
        return df.where(~out)
    bounds = df.groupBy(*by).agg(*[iqr_bounds(c, rge, lo, hi, accuracy).alias(n) for c, n in names.items()])
    both = df.join(broadcast_if_small(bounds), list(by)) if by else df.crossJoin(F.broadcast(bounds))  # without groups one row
    out = F.lit(False)
    for c, n in names.items():
        x = no_nan(c)
        if upr:
            out = out | F.coalesce(x > F.col(n)["upr"], F.lit(False))
        if lwr:
            out = out | F.coalesce(x < F.col(n)["lwr"], F.lit(False))
    return both.where(~out).select(*df.columns)


def varying_columns(df: DataFrame) -> list[str]:
    """Columns with more than one distinct non-null value, from one min/max aggregate."""
    if not df.columns:
        return []
    agg = df.agg(*[F.coalesce(F.min(F.col(f"`{c}`")) != F.max(F.col(f"`{c}`")), F.lit(False)).alias(f"c{i}") if not isinstance(df.schema[c].dataType, (T.MapType, T.VariantType)) else F.lit(True).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
    return [c for i, c in enumerate(df.columns) if agg[i]]


def drop_cols(df: DataFrame) -> DataFrame:
    """``df`` without columns that are all null or hold one value only (with or without nulls)."""
    return df.select(*varying_columns(df))


def flip_values(good_bad: Mapping[str, Sequence[str]]) -> dict[str, str]:
    """{good: [bad, ...]} as {bad: good}; a later duplicate wins."""
    return {b: g for g, bads in good_bad.items() for b in bads}


#: Entries that stand for no value.
DROP_VALUES = ("_drop", "nan", "other")


def clean_cols(df: DataFrame, col_values: Mapping[str, Mapping[str, Sequence[str]]], do_nan: bool = False, renames: Mapping[str, str] | None = None) -> DataFrame:
    """Recodes listed values; other values stay. ``do_nan``: entries without value become null in all string columns.

    ``renames`` maps present column names to canonical ones first; two columns with one canonical
    name, or a canonical name that another column bears, raise ValueError.
    """
    if renames:
        out_names = [renames.get(c, c) for c in df.columns]
        if len(set(out_names)) != len(out_names):
            raise ValueError("renaming does not give unique columns")
        df = df.toDF(*out_names)
    made = {}
    for c, values in col_values.items():
        flat = flip_values(values)
        if c in df.columns and flat:
            m = F.create_map(*[F.lit(x) for kv in flat.items() for x in kv])
            made[c] = F.coalesce(F.try_element_at(m, F.col(c)), F.col(c))
    df = df.withColumns(made) if made else df
    if do_nan:
        texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
        df = df.withColumns({c: F.when(~F.col(c).isin(*DROP_VALUES), F.col(c)) for c in texts})
    return df


def new_values(df: DataFrame, col_values: Mapping[str, Mapping[str, Sequence[str]]]) -> DataFrame:
    """Rows ``col_name, value``: non-null values that are neither a good nor a bad one of their column."""
    parts = []
    for c, values in col_values.items():
        if c in df.columns:
            known = list(values) + [b for bads in values.values() for b in bads]
            v = F.col(c).cast("string")
            parts.append(df.where(v.isNotNull() & ~v.isin(*known)).select(F.lit(c).alias("col_name"), v.alias("value")).distinct())
    if not parts:
        return df.sparkSession.createDataFrame([], "col_name string, value string")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def nested_update(c: Column, kind: T.DataType, old, new) -> Column:
    """Replaces a value wherever it occurs in nested maps, arrays and structs; ``old`` None matches null."""
    if isinstance(old, (dict, list, set)):
        raise TypeError("old must be immutable")
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda k, v: nested_update(v, kind.valueType, old, new))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: nested_update(x, kind.elementType, old, new))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[nested_update(c[f.name], f.dataType, old, new).alias(f.name) for f in kind.fields]))
    return F.when(c.eqNullSafe(F.lit(old).try_cast(kind)), F.lit(new).cast(kind)).otherwise(c)


def flatten_json(df: DataFrame, key: str | None, json_col: str, col_names: Sequence[str] | None = None, key_depth: int | None = None) -> DataFrame:
    """One row per leaf path of nested JSON objects: ``[key,] *col_names`` (the leaf last), strings.

    Paths of another depth than ``key_depth`` (default: the most frequent one, the deeper of equals)
    are dropped. ``col_names`` must have one name more than the depth; default ``k1 .. kd, value``.
    """

    def walk(batches):
        import pandas as pd

        for pdf in batches:
            rows = []

            def go(x, path, k):
                if isinstance(x, dict):
                    for name, y in x.items():
                        go(y, [*path, str(name)], k)
                else:
                    rows.append((k, path, None if x is None else (x if isinstance(x, str) else json.dumps(x))))

            for k, text in zip(pdf["k"], pdf["j"]):
                if isinstance(text, str):
                    try:
                        go(json.loads(text), [], k)
                    except ValueError:
                        continue
            yield pd.DataFrame(rows, columns=["k", "path", "leaf"])

    kind = df.schema[key].dataType.simpleString() if key else "int"
    leaves = df.select((F.col(key) if key else F.lit(0)).alias("k"), F.col(json_col).cast("string").alias("j")).mapInPandas(walk, f"k {kind}, path array<string>, leaf string")
    if key_depth is None:
        top = leaves.groupBy(F.size("path").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
        key_depth = top["d"] if top else (len(col_names) - 1 if col_names else 0)
    names = list(col_names) if col_names else [f"k{i + 1}" for i in range(key_depth)] + ["value"]
    if len(names) != key_depth + 1:
        raise ValueError(f"{key_depth + 1} column names are needed")
    cols = [F.get("path", F.lit(i)).alias(n) for i, n in enumerate(names[:-1])] + [F.col("leaf").alias(names[-1])]
    out = leaves.where(F.size("path") == key_depth)
    return out.select(*([F.col("k").alias(key)] if key else []), *cols)


def relative_gap(a: Column, b: Column) -> Column:
    """|a - b| / (2 |a + b|), 0 for equal values."""
    return F.when(a == b, F.lit(0.0)).otherwise(F.coalesce(F.try_divide(F.abs(a - b), 2 * F.abs(a + b)), F.lit(float("inf"))))


def num_dedup(df: DataFrame, idx_cols: Sequence[str], ycol: str, tol: float = 0.01) -> tuple[DataFrame, DataFrame]:
    """(dedups, dups): groups whose values all lie within ``tol`` of each other become their mean; others stay whole.

    Rows with a null key are in neither. For values of one sign the widest pair is the largest and
    the smallest, so two mergeable aggregates decide; groups of mixed sign compare the smallest
    negative and the largest positive, and the values nearest zero, which bound every pair as well.
    """
    y = no_nan(ycol)
    keyed = df.where(F.coalesce(F.lit(True), *[]) if not idx_cols else F.expr(" and ".join(f"`{c}` is not null" for c in idx_cols)))
    stats = keyed.groupBy(*idx_cols).agg(F.min(y).alias("_lo"), F.max(y).alias("_hi"), F.avg(y).alias("_avg"))
    # |a - b| / |a + b| of mixed signs is at least 1, so its gap is at least one half
    gap = F.when(F.col("_lo") * F.col("_hi") < 0, F.greatest(F.lit(0.5), relative_gap(F.col("_lo"), F.col("_hi")))).otherwise(relative_gap(F.col("_lo"), F.col("_hi")))
    stats = stats.withColumn("_dup", F.col("_lo").isNotNull() & F.coalesce(gap > tol, F.lit(False)))
    dedups = stats.where(~F.col("_dup")).select(*idx_cols, F.col("_avg").alias(ycol))
    dups = keyed.join(stats.where("_dup").select(*idx_cols), list(idx_cols), "left_semi")
    return dedups, dups


def set_nans(df: DataFrame, source: str, onehot: Sequence[str]) -> DataFrame:
    """Indicator columns are null where the source is."""
    return df.withColumns({c: F.when(F.col(source).isNotNull(), F.col(c)) for c in onehot})


def get_dummies(df: DataFrame, col: str, values: Sequence[str] | None = None, sep: str = "::") -> DataFrame:
    """``df`` with one 0/1 double column ``<col><sep><value>`` per value; null rows have zeros."""
    if values is None:
        rows = df.where(F.col(col).isNotNull()).select(col).distinct().limit(10_001).collect()
        if len(rows) > 10_000:
            raise ValueError(f"{col} has more than 10,000 values")
        values = sorted(r[0] for r in rows)
    return df.withColumns({f"{col}{sep}{v}": F.coalesce((F.col(col) == v).cast("double"), F.lit(0.0)) for v in values})


def interpolate(df: DataFrame, order: str, col: str, by: Sequence[str], nan_pct: float = 0.2) -> DataFrame:
    """``df`` with gaps of ``col`` filled linearly by position in each group; ends take the nearest value.

    A group with a larger share of nulls than ``nan_pct`` gets null throughout.
    """
    w = Window.partitionBy(*by).orderBy(order)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    x, rn = no_nan(col), F.row_number().over(w)
    step1 = df.withColumns({"_x": x, "_rn": rn})
    at = F.when(F.col("_x").isNotNull(), F.struct("_rn", "_x"))
    step2 = step1.withColumns({"_p": F.last(at, True).over(back), "_n": F.first(at, True).over(ahead), "_nulls": F.avg(F.col("_x").isNull().cast("double")).over(Window.partitionBy(*by))})
    slope = F.try_divide(F.col("_n._x") - F.col("_p._x"), (F.col("_n._rn") - F.col("_p._rn")).cast("double"))
    line = F.col("_p._x") + F.coalesce(slope, F.lit(0.0)) * (F.col("_rn") - F.col("_p._rn"))
    value = F.coalesce(F.col("_x"), line, F.col("_p._x"), F.col("_n._x"))
    return step2.withColumn(col, F.when(F.col("_nulls") <= nan_pct, value)).select(*df.columns)


def keep_in(df: DataFrame, col: str, values: Sequence, invert: bool = False) -> DataFrame:
    """Rows whose value is (not) listed; null is in no list."""
    hit = F.coalesce(F.col(col).isin(*values), F.lit(False)) if values else F.lit(False)
    return df.where(~hit if invert else hit)


def column_diff(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Differences of neighbouring columns, ``<col>_diff``; the first has none."""
    return df.withColumns({f"{b}_diff": F.col(b) - F.col(a) for a, b in zip(cols, cols[1:])})
