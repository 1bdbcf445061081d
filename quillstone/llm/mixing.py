"""A mix of several sources to target weights with capped repetition.

Method: Poisson replication. Every record has a uniform number seeded by the hash of its key; the
Poisson distribution with the source's rate is inverted at it, which gives the record's number of
copies, at most the cap. Records are exploded by that number and shuffled globally by another hash.

The rate of a source is not its target repetition itself, as the cap and the few large records of
a source would pull the mix off its target: it is solved so that the copies really drawn have the
wanted size. For fixed uniform numbers the drawn size rises with the rate, and it depends on them
only through the size of the source above each uniform number; that function is one aggregate of
``BINS`` rows per source, in which the rate is bisected by a grouped function; one row per source reaches
the driver. A source that needs its cap gets every
record that many times.

Size of the mix: ``total`` when given. Otherwise the largest at which no listed source that has
records needs more than its cap, so the shares hold as nearly as the caps allow; the share of
listed sources without records is spread over the others in proportion.

Scale: sizes are counted in one narrow pass and kept in the shared checkpoint folder; drawing is a
narrow map with a broadcast of one row per listed source (checked to be at most ``MAX_SOURCES``);
one shuffle, of keys only, puts the copies in random order. A source with a third of all rows is
no special case.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.tokenizing import count_tokens
from quillstone.session import cut

BINS = 4096
MAX_SOURCES = 2_000


def tidy_source(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"[\s ]+", " ")))


def uniform(seed: int, *keys: Column) -> Column:
    """In (0, 1), the same for a key whatever the partitioning."""
    return (F.xxhash64(*keys, F.lit(seed)).bitwiseAND(F.lit((1 << 53) - 1)) + F.lit(0.5)) / F.lit(float(1 << 53))


def poisson_cdf(rate: float, upto: int) -> list[float]:
    """P(N <= k) for k = 0 .. upto - 1."""
    out, log_p, total = [], -rate, 0.0
    for k in range(upto):
        total += math.exp(log_p)
        out.append(min(total, 1.0))
        log_p += math.log(rate) - math.log(k + 1) if rate > 0 else -math.inf
    return out


def solve_rate(above: Callable[[float], float], want: float, cap: int) -> float:
    """The Poisson rate at which the size drawn is ``want``; ``above(x)``: size of records with uniform number over x."""
    drawn = lambda rate: sum(above(c) for c in poisson_cdf(rate, cap))
    lo, hi = 0.0, 1.0
    while drawn(hi) < want and hi < 1e6:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if drawn(mid) < want else (lo, mid)
    return hi


def _solved(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """The rate of one source from its sizes per bin."""
    upper = np.zeros(BINS + 1)
    upper[pdf["bin"].to_numpy()] = pdf["size"].to_numpy()
    upper = upper[::-1].cumsum()[::-1]

    def above(x: float) -> float:
        at = min(max(x, 0.0), 1.0) * BINS
        i = min(int(at), BINS - 1)
        return float(upper[i] + (upper[i + 1] - upper[i]) * (at - i))

    return pd.DataFrame({"source": [key[0]], "rate": [solve_rate(above, float(pdf["want"].iloc[0]), int(pdf["cap"].iloc[0]))]})


def plan_mix(sizes: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 7) -> list[dict]:
    """One entry per listed source: available size, wanted size, cap, and the inverted distribution ``cdf``.

    ``sizes``: rows ``key, source, size`` with tidy sources; ``targets``: ``source, target_share,
    max_repeats``. Sources not listed take no part.
    """
    spark = sizes.sparkSession
    listed = targets.select(tidy_source(F.col("source")).alias("source"), F.col("target_share").cast("double"), F.col("max_repeats").cast("int")).where("source is not null")
    listed = listed.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    rows = listed.limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources are listed")
    names = [r["source"] for r in rows]
    bins = cut(sizes.where(F.col("source").isin(names) & (F.col("size") > 0)).groupBy("source", F.floor(uniform(seed, F.col("key")) * BINS).cast("int").alias("bin")).agg(F.sum("size").cast("double").alias("size")))
    available = {r["source"]: r["size"] for r in bins.groupBy("source").agg(F.sum("size").alias("size")).collect()}  # one row per listed source
    plan = [{"source": r["source"], "target_share": r["target_share"] or 0.0, "max_repeats": max(0, r["max_repeats"] or 0), "available": available.get(r["source"], 0.0)} for r in sorted(rows, key=lambda r: r["source"])]
    usable = [p for p in plan if p["available"] > 0 and p["max_repeats"] > 0 and p["target_share"] > 0]
    whole = sum(p["target_share"] for p in usable)
    if total is None:
        total = min((p["max_repeats"] * p["available"] * whole / p["target_share"] for p in usable), default=0.0)
    for p in plan:
        cap = p["max_repeats"]
        p["wanted"] = min(total * p["target_share"] / whole, cap * p["available"]) if p in usable else 0.0
        p["full"] = p["wanted"] > 0 and p["wanted"] >= cap * p["available"] * (1 - 1e-9)
    ask = [(p["source"], p["wanted"], p["max_repeats"]) for p in plan if p["wanted"] > 0 and not p["full"]]
    rates: dict[str, float] = {}
    if ask:
        wants = spark.createDataFrame(ask, "source string, want double, cap int")
        solved = bins.join(F.broadcast(wants), "source").groupBy("source").applyInPandas(_solved, "source string, rate double")  # at most MAX_SOURCES rows
        rates = {r["source"]: r["rate"] for r in solved.collect()}  # one row per listed source
    for p in plan:
        if p["wanted"] <= 0:
            p |= {"rate": 0.0, "cdf": []}
        elif p["full"]:
            p |= {"rate": math.inf, "cdf": [0.0] * p["max_repeats"]}
        else:
            rate = rates[p["source"]]
            p |= {"rate": rate, "cdf": poisson_cdf(rate, p["max_repeats"])}
    return plan


_CDF = "source string, cdf array<double>"


def draw_mix(sizes: DataFrame, plan: list[dict], seed: int = 7) -> DataFrame:
    """Rows ``key, source, size, copy`` in random order; copies of a record count from 1."""
    cdfs = sizes.sparkSession.createDataFrame([(p["source"], p["cdf"]) for p in plan if p["cdf"]], _CDF)
    u = uniform(seed, F.col("key"))
    copies = sizes.where(F.col("size") > 0).join(F.broadcast(cdfs), "source").withColumn("u", u).withColumn("copies", F.size(F.filter("cdf", lambda c: c < F.col("u")))).where("copies > 0")
    each = copies.select("key", "source", "size", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    each = each.withColumn("at", F.xxhash64("key", "copy", F.lit(seed + 1)))
    return each.repartition("at").sortWithinPartitions("at").drop("at")


def mix_report(sizes: DataFrame, plan: list[dict], seed: int = 7) -> DataFrame:
    """Per listed source: target share, share reached, sizes, mean repetition, and whether it fell short.

    ``short``: the source's caps (or its having no records) keep it below the target share.
    """
    spark = sizes.sparkSession
    # of the drawn copies, without exploding them
    cdfs = spark.createDataFrame([(p["source"], p["cdf"]) for p in plan if p["cdf"]], _CDF)
    copies = sizes.where(F.col("size") > 0).join(F.broadcast(cdfs), "source").withColumn("u", uniform(seed, F.col("key"))).withColumn("copies", F.size(F.filter("cdf", lambda c: c < F.col("u"))).cast("long"))
    got = copies.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("size"), F.sum("copies").alias("records"), F.max("copies").alias("most_copies"))
    heads = spark.createDataFrame(
        [(p["source"], p["target_share"], p["max_repeats"], int(p["available"]), bool(p["target_share"] > 0 and (p["available"] <= 0 or p["rate"] == math.inf))) for p in plan],
        "source string, target_share double, max_repeats int, available_size long, at_cap boolean",
    )
    out = heads.join(F.broadcast(got), "source", "left").na.fill(0, ["size", "records", "most_copies"])  # one row per listed source
    total = F.sum("size").over(Window.partitionBy(F.lit(0)))  # over the listed sources
    share = F.coalesce(F.try_divide(F.col("size").cast("double"), total.cast("double")), F.lit(0.0))
    return out.select(
        "source", "target_share", share.alias("share"), "max_repeats", "available_size", "size", "records", F.coalesce(F.try_divide(F.col("size").cast("double"), F.col("available_size").cast("double")), F.lit(0.0)).alias("mean_repeats"), "most_copies", "at_cap", (share < F.col("target_share") * 0.995).alias("short")
    )


def token_sizes(docs: DataFrame, key: str, text: str, source: str, path: str | None = None) -> DataFrame:
    """``key, source, size`` of documents in tokens, counted in one pass and kept in the shared folder."""
    counted = count_tokens(docs, [key, source], text, path)
    return cut(counted.select(F.col(key).alias("key"), tidy_source(F.col(source)).alias("source"), F.col("n_tokens").alias("size")))
