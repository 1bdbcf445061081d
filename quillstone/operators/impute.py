"""Iterative imputation of numeric and categorical columns by regression on the most correlated others.

Categories become indicators, numbers are scaled to [0, 1]; missing cells start at the mean. In each
round every incomplete column is regressed on its few most correlated columns by ridge normal
equations and its missing cells take the clipped prediction. Correlations and normal equations are
sums: each round is two aggregates and a projection, nothing is collected but those sums, and
lineage is cut by a reliable checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.session import cut

MAX_CATEGORIES = 200


def impute(df: DataFrame, sentinels: Sequence[str] = (), ex_cols: Sequence[str] = (), rounds: int = 10, features: int = 3, ridge: float = 1e-3) -> DataFrame:
    """``df`` with missing cells filled: columns ``ex_cols``, categorical, numeric.

    ``sentinels``: entries that count as missing. Nothing missing: the columns come back as they are.
    A column without any value stays null. Strings, booleans and numbers are imputed, others and
    ``ex_cols`` are carried along.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    free = [c for c in df.columns if c not in ex_cols]
    texts = [c for c in free if isinstance(kinds[c], T.StringType)]
    nums = [c for c in free if isinstance(kinds[c], (T.NumericType, T.BooleanType))]
    carried = [c for c in df.columns if c in ex_cols or (c not in texts and c not in nums)]
    clean = {c: F.when(~F.col(f"`{c}`").isin(*sentinels), F.col(f"`{c}`")) if sentinels else F.col(f"`{c}`") for c in texts}
    plain = {c: F.col(f"`{c}`").cast("double") for c in nums}
    plain = {c: F.when(~F.isnan(v), v) for c, v in plain.items()}
    base = cut(df.select(*[F.col(f"`{c}`") for c in carried], *[v.alias(c) for c, v in clean.items()], *[v.alias(c) for c, v in plain.items()]))
    stat = base.agg(*[F.count(F.col(f"`{c}`")).alias(f"k{i}") for i, c in enumerate(texts + nums)], *[f(F.col(f"`{c}`")).alias(f"{n}{i}") for i, c in enumerate(nums) for n, f in (("lo", F.min), ("hi", F.max))], F.count(F.lit(1)).alias("n")).first()
    filled = [stat[f"k{i}"] for i in range(len(texts + nums))]
    if all(k == stat["n"] for k in filled):
        return _shaped(base, carried, texts, nums, kinds)
    usable = [c for i, c in enumerate(texts + nums) if filled[i] > 0]
    cats = {}
    for c in texts:
        if c in usable:
            vals = [r[0] for r in base.where(F.col(f"`{c}`").isNotNull()).select(F.col(f"`{c}`").alias("v")).distinct().limit(MAX_CATEGORIES + 1).collect()]
            if len(vals) > MAX_CATEGORIES:
                raise ValueError(f"{c} has more than {MAX_CATEGORIES} categories")
            cats[c] = sorted(vals)
    # one column per feature: (source, expression in [0, 1])
    feats: list[tuple[str, object]] = []
    for c, vals in cats.items():
        feats += [(c, F.when(F.col(f"`{c}`").isNotNull(), (F.col(f"`{c}`") == v).cast("double"))) for v in vals]
    for i, c in enumerate(nums):
        if c in usable:
            lo, hi = stat[f"lo{i}"], stat[f"hi{i}"]
            feats.append((c, (F.col(f"`{c}`") - lo) / (hi - lo) if hi > lo else F.when(F.col(f"`{c}`").isNotNull(), F.lit(0.0))))
    m = len(feats)
    work = base.withColumn("_f", F.array(*[e for _, e in feats]))
    means = work.agg(*[F.avg(F.get("_f", F.lit(i))).alias(f"m{i}") for i in range(m)]).first()
    work = cut(work.withColumn("_x", F.array(*[F.coalesce(F.get("_f", F.lit(i)), F.lit(float(means[i] or 0.0))) for i in range(m)])))
    open_ = [i for i in range(m) if filled[(texts + nums).index(feats[i][0])] < stat["n"]]
    x = lambda i: F.get("_x", F.lit(i))
    for _ in range(rounds):
        mu, products = _moments(work, m)
        cov = products - np.outer(mu, mu)
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
        corr = np.abs(cov / sd[:, None] / sd[None, :])
        new = [x(i) for i in range(m)]
        for i in open_:
            other = [j for j in np.argsort(-corr[i]) if feats[j][0] != feats[i][0] and corr[i, j] > 1e-6][:features]
            if not other:
                continue
            beta = np.linalg.solve(cov[np.ix_(other, other)] + ridge * np.eye(len(other)) * cov[other, other].mean(), cov[other, i])
            pred = F.lit(float(mu[i]))
            for b, j in zip(beta, other):
                pred = pred + float(b) * (x(int(j)) - float(mu[j]))
            new[i] = F.coalesce(F.get("_f", F.lit(i)), F.least(F.lit(1.0), F.greatest(F.lit(0.0), pred)))
        work = cut(work.withColumn("_x", F.array(*new)))
    out = {}
    for c, vals in cats.items():
        at = [i for i, (src, _) in enumerate(feats) if src == c]
        arr = F.array(*[x(i) for i in at])
        out[c] = F.coalesce(F.col(f"`{c}`"), F.get(F.array(*[F.lit(v) for v in vals]), (F.array_position(arr, F.array_max(arr)) - 1).cast("int")))
    for i, c in enumerate(nums):
        if c in usable:
            at = next(k for k, (src, _) in enumerate(feats) if src == c)
            lo, hi = stat[f"lo{i}"], stat[f"hi{i}"]
            out[c] = F.coalesce(F.col(f"`{c}`"), x(at) * (hi - lo) + lo)
    return _shaped(work.withColumns(out), carried, texts, nums, kinds)


def _moments(work: DataFrame, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Means of the ``m`` features in ``_x`` and of their products: outer products are summed per task, then over tasks."""
    upper = np.triu_indices(m)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, g = 0, np.zeros(m), np.zeros((m, m))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, m)
            n, s, g = n + len(x), s + x.sum(axis=0), g + x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([[n], s, g[upper]]).tolist()], pa.list_(pa.float64()))], names=["v"])

    parts = work.select("_x").mapInArrow(add, "v array<double>").select(F.posexplode("v").alias("i", "v"))
    got = {r["i"]: r["v"] for r in parts.groupBy("i").agg(F.sum("v").alias("v")).collect()}  # one row per sum, m (m + 3) / 2 + 1
    v = np.array([got[i] for i in range(len(got))])
    n, s = max(v[0], 1.0), v[1 : m + 1]
    g = np.zeros((m, m))
    g[upper] = v[m + 1 :]
    return s / n, (g + np.triu(g, 1).T) / n


def _shaped(df: DataFrame, carried, texts, nums, kinds) -> DataFrame:
    back = lambda c: (F.round(F.col(f"`{c}`")) if isinstance(kinds[c], (T.IntegralType, T.BooleanType)) else F.col(f"`{c}`")).cast(kinds[c]).alias(c)
    return df.select(*[F.col(f"`{c}`") for c in carried], *[F.col(f"`{c}`") for c in texts], *[back(c) for c in nums])
