"""Binning on a numeric column: equal width or equal count, with per-bin summaries and shares.

Bins are right-closed, the lowest edge included. A value that alone fills one bin or more gets a
bin of its own after the others, and the number of the others shrinks in proportion.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.operators.clean import no_nan, numeric_columns
from quillstone.operators.quantiles import column_quantiles

AGGREGATES = {"median": F.median, "avg": F.avg, "min": F.min, "max": F.max, "sum": F.sum}


def size_bin(x: Column, lo: Column, hi: Column, n: int) -> Column:
    """0-based bin of n equal widths; 0 when there is no width."""
    w = (hi - lo) / n
    return F.when(x.isNotNull() & (w > 0), F.least(F.lit(n - 1), F.greatest(F.lit(0), F.ceil((x - lo) / w) - 1))).otherwise(F.when(x.isNotNull(), F.lit(0))).cast("int")


def count_bin(x: Column, edges: Column) -> Column:
    """0-based bin by sorted inner edges: the number of edges below x."""
    return F.when(x.isNotNull(), F.size(F.filter(edges, lambda e: e < x))).cast("int")


def with_size_bins(df: DataFrame, col: str, n: int, name: str = "bin") -> DataFrame:
    """``df`` with the equal-width bin of ``col``; null and NaN have none."""
    x = no_nan(col)
    edges = df.agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    return df.crossJoin(F.broadcast(edges)).withColumn(name, size_bin(x, F.col("_lo"), F.col("_hi"), n)).drop("_lo", "_hi")  # one row


def count_edges(df: DataFrame, col: str, n: int, digits: int = 9, accuracy: int | None = None) -> list[float]:
    """Distinct inner edges of n equal-count bins (exact interpolated quantiles, or approximate ones with ``accuracy``)."""
    at = [i / n for i in range(1, n)]
    got = (df.agg(F.percentile_approx(no_nan(col), at, accuracy).alias("q")).first()["q"] if accuracy else column_quantiles(df, [col], at)[col]) if at else []
    return sorted({round(e, digits) for e in got or []})


def with_count_bins(df: DataFrame, col: str, n: int, name: str = "bin", accuracy: int | None = None, edges: list[float] | None = None) -> DataFrame:
    """``df`` with the equal-count bin of ``col``; equal values share a bin. ``edges``: inner edges, if known."""
    edges = count_edges(df, col, n, accuracy=accuracy) if edges is None else edges
    x = F.round(no_nan(col), 9)
    return df.withColumn(name, count_bin(x, F.array(*[F.lit(e) for e in edges])) if edges else F.when(x.isNotNull(), F.lit(0)))


def _heavy(df: DataFrame, col: str, n: int) -> tuple[list[float], list[float]]:
    """(values that fill at least one of n bins alone, at most n of them; distinct inner edges of n equal-count bins of all)."""
    x = no_nan(col)
    # such a value lies at one of n even ranks at least: few candidates, counted in one aggregate
    grid = column_quantiles(df, [col], [i / (4 * n) for i in range(4 * n + 1)])[col]
    if grid is None:
        return [], []
    edges = sorted({round(e, 9) for e in grid[4:-1:4]})
    held = sorted({a for a, b in zip(grid, grid[1:]) if a == b} | ({grid[0]} if n == 1 else set()))
    if not held:
        return [], edges
    got = df.agg(F.count(x).alias("total"), *[F.count_if(x == v).alias(f"k{i}") for i, v in enumerate(held)]).first()
    return [v for i, v in enumerate(held) if got[f"k{i}"] >= got["total"] / n], edges


def bin_values(df: DataFrame, col: str, n: int, kind: str = "count", qfunc: str = "median", discrete: Sequence[str] | None = None, thres: float | None = None) -> DataFrame:
    """Per bin of ``col``: ``bin, bin_prob``, ``qfunc`` of every numeric column, and the shares of each category.

    ``kind``: 'size' or 'count'. Shares are columns ``<col>::<value>``; with ``thres`` categories that
    never exceed it are dropped, their rest in ``<col>::other`` (see ``thres_bins``).
    """
    agg = AGGREGATES[qfunc]
    rows = df.where(no_nan(col).isNotNull())
    heavy, edges = _heavy(rows, col, n)
    x = no_nan(col)
    light = rows.where(~x.isin(*heavy)) if heavy else rows
    share_light = 1.0
    if heavy:
        total, kept = rows.count(), light.count()
        share_light = kept / total if total else 0.0
    m = max(1, round(n * share_light)) if share_light > 0 else 0
    parts = []
    if m:
        parts.append(with_size_bins(light, col, m) if kind == "size" else with_count_bins(light, col, m, edges=None if heavy else edges))
    if heavy:
        own = F.array_position(F.array(*[F.lit(h) for h in heavy]), x).cast("int") - 1 + m
        parts.append(rows.where(x.isin(*heavy)).withColumn("bin", own))
    if not parts:
        binned = rows.withColumn("bin", F.lit(None).cast("int"))
    else:
        binned = parts[0]
        for p in parts[1:]:
            binned = binned.unionByName(p)
    numbers = [c for c in numeric_columns(df)]
    texts = list(discrete) if discrete is not None else [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    shares, families = [], {}
    for t in texts:
        vals = sorted(r[0] for r in df.where(F.col(t).isNotNull()).select(t).distinct().limit(1001).collect())
        if len(vals) > 1000:
            raise ValueError(f"{t} has more than 1,000 values")
        families[t] = [f"{t}::{v}" for v in vals]
        shares += [F.avg(F.coalesce((F.col(t) == v).cast("double"), F.lit(0.0))).alias(f"{t}::{v}") for v in vals]
    out = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("_n"), *[agg(no_nan(c)).alias(c) for c in numbers], *shares)
    total = binned.agg(F.count(F.lit(1)).alias("_total"))
    out = out.crossJoin(F.broadcast(total)).withColumn("bin_prob", F.col("_n") / F.col("_total")).drop("_n", "_total")  # one row
    return thres_bins(out, families, thres) if thres is not None else out


def thres_bins(bins: DataFrame, families: dict[str, list[str]], thres: float) -> DataFrame:
    """Drops share columns that exceed ``thres`` in no bin; ``<family>::other`` is the rest of a family that keeps any."""
    cols = [c for cs in families.values() for c in cs]
    if not cols:
        return bins
    top = bins.agg(*[F.max(F.col(f"`{c}`")).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    kept = {c for i, c in enumerate(cols) if top[i] is not None and top[i] > thres}
    out = bins.drop(*[c for c in cols if c not in kept])
    for fam, cs in families.items():
        own = [c for c in cs if c in kept]
        if own:
            rest = F.lit(1.0)
            for c in own:
                rest = rest - F.col(f"`{c}`")
            out = out.withColumn(f"{fam}::other", rest)
    return out


def get_sz_bins(df: DataFrame, col: str, n: int, qfunc: str = "median", thres: float | None = None) -> DataFrame:
    return bin_values(df, col, n, "size", qfunc, thres=thres)


def get_cnt_bins(df: DataFrame, col: str, n: int, qfunc: str = "median", thres: float | None = None) -> DataFrame:
    return bin_values(df, col, n, "count", qfunc, thres=thres)
