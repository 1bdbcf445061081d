"""Filling missing values from records of the same group or time, with flags.

Method: hierarchical group statistics. For each field there is a list of groupings from fine to
coarse. A missing cell takes the mode (or median) of the finest group with enough support, else
of the next coarser one, at last of the whole table; the level that was used is stored. A group
supports its mode with at least ``min_support`` votes of which more than ``min_share`` are for the
mode, so a tie backs off to what is known beyond the group; the whole table needs neither.

Scale: what the fields ask of a record is read off once and kept in the shared checkpoint folder. Votes are counted per finest group with map-side combine before any shuffle by group, and
coarser levels add up those counts, so a group with a third of all rows is a few rows by then.
Only missing cells are joined to the statistics; the join is left to AQE (broadcast when the
statistics prove small at run time, split when a key is skewed). The whole-table level has one
row per field and is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.session import cut


@dataclass
class FillSpec:
    """How one field is filled.

    ``missing``: boolean column. ``vote``: what a record says about the value (string; null for no
    vote), e.g. the value itself or a quantity that is constant in the group. ``levels``: groupings
    from fine to coarse, each a list of columns; a null in one of them skips the level. ``restore``:
    turns the winning vote and the record's ``context`` (long) into the fill value.
    """

    name: str
    missing: Column
    vote: Column
    levels: Sequence[Sequence[Column]]
    context: Column = field(default_factory=lambda: F.lit(None).cast("long"))
    restore: Callable[[Column, Column], Column] | None = None
    stat: str = "mode"


def missing_fills(df: DataFrame, key: str, specs: Sequence[FillSpec], min_support: int = 2, min_share: float = 0.5) -> DataFrame:
    """One row per missing cell: ``key, field_name, fill_value, fill_level, fill_support``.

    ``fill_level`` is the index of the grouping used, for the whole table the largest number of groupings of a field;
    without any vote ``fill_value`` is null and ``fill_level`` is -1. Ties of the mode of the whole
    table go to the largest value; those of a group back off. The median needs ``min_support`` only. Rows must be unique by ``key``. Empty input gives an empty result.
    """
    depth = max((len(s.levels) for s in specs), default=0)
    parts_of = {repr(c): c for s in specs for level in s.levels for c in level}
    name_of = {r: f"g{i}" for i, r in enumerate(parts_of)}

    def keys(s: FillSpec) -> Column:
        out = []
        for i in range(depth):
            cols = [F.col(name_of[repr(c)]) for c in s.levels[i]] if i < len(s.levels) else None
            if cols is None:
                out.append(F.lit(None).cast("string"))
            else:  # concat is null if any part is
                parts = [F.lit(s.name)]
                for c in cols:
                    parts += [F.lit("\u0001"), c]
                out.append(F.concat(*parts))
        return F.array(*out)

    # what a spec asks is a column first: its expressions are evaluated once per record
    asked = cut(df.select(
        F.col(key).alias("rid"), *[s.missing.alias(f"m{i}") for i, s in enumerate(specs)], *[F.when(~s.missing, s.vote.cast("string")).alias(f"v{i}") for i, s in enumerate(specs)],
        *[c.cast("string").alias(name_of[r]) for r, c in parts_of.items()], *[s.context.cast("long").alias(f"c{i}") for i, s in enumerate(specs)],
    ))
    vote = [F.when(F.col(f"v{i}").isNotNull(), F.struct(F.lit(s.name).alias("f"), F.col(f"v{i}").alias("v"), keys(s).alias("ks"))) for i, s in enumerate(specs)]
    votes = asked.select(F.explode(F.array_compact(F.array(*vote))).alias("c")).select("c.*")
    votes = cut(votes.groupBy("f", "ks", "v").agg(F.count(F.lit(1)).alias("n")))  # read for every level
    gap = [F.when(F.col(f"m{i}"), F.struct(F.lit(s.name).alias("f"), keys(s).alias("ks"), F.col(f"c{i}").alias("ctx"))) for i, s in enumerate(specs)]
    missing = asked.select("rid", F.explode(F.array_compact(F.array(*gap))).alias("c")).select("rid", "c.*")
    medians = [s.name for s in specs if s.stat == "median"]

    def winner(grouped: DataFrame, by: str, least: int, share: float) -> DataFrame:
        """Of counted votes (by, f, v, n): the winning vote and the votes of the group."""
        top = F.max(F.struct("n", "v"))
        best, enough = top["v"], top["n"] > share * F.sum("n")
        if medians:
            med = F.percentile(F.expr("try_cast(v as double)"), 0.5, F.col("n"))
            numeric = F.first("f").isin(*medians)
            best = F.when(numeric, F.when(med == F.floor(med), med.cast("long").cast("string")).otherwise(med.cast("string"))).otherwise(best)
            enough = numeric | enough
        return grouped.groupBy(by).agg(best.alias("val"), F.sum("n").alias("sup"), enough.alias("enough")).where((F.col("sup") >= least) & F.col("enough")).drop("enough")

    out = missing
    level, value, support = F.lit(-1), F.lit(None).cast("string"), F.lit(0).cast("long")
    picks = []
    for i in range(depth):
        k = F.get("ks", F.lit(i))
        counts = votes.where(k.isNotNull()).groupBy(k.alias(f"k{i}"), "f", "v").agg(F.sum("n").alias("n"))
        stat = winner(counts, f"k{i}", min_support, min_share).select(f"k{i}", F.col("val").alias(f"val{i}"), F.col("sup").alias(f"sup{i}"))
        # a null key matches nothing; it is spread over the partitions instead of meeting in one
        out = out.withColumn(f"k{i}", F.coalesce(F.get("ks", F.lit(i)), F.concat(F.lit("\u0000"), F.col("rid").cast("string"))))
        out = out.join(stat, f"k{i}", "left")
        picks.append((i, F.col(f"val{i}"), F.col(f"sup{i}")))
    whole = winner(votes.groupBy("f", "v").agg(F.sum("n").alias("n")).withColumn("g", F.col("f")), "g", 1, 0.0).select(F.col("g").alias("f"), F.col("val").alias("val_all"), F.col("sup").alias("sup_all"))
    out = out.join(F.broadcast(whole), "f", "left")  # one row per field
    picks.append((depth, F.col("val_all"), F.col("sup_all")))
    for i, v, n in reversed(picks):
        level, value, support = F.when(v.isNotNull(), F.lit(i)).otherwise(level), F.when(v.isNotNull(), v).otherwise(value), F.when(v.isNotNull(), n).otherwise(support)
    out = out.select("rid", "f", "ctx", value.alias("val"), level.alias("fill_level"), support.alias("fill_support"))
    fill = F.col("val")
    for s in specs:
        if s.restore is not None:
            fill = F.when(F.col("f") == s.name, s.restore(F.col("val"), F.col("ctx"))).otherwise(fill)
    return out.select(F.col("rid").alias(key), F.col("f").alias("field_name"), fill.alias("fill_value"), "fill_level", "fill_support")


def apply_fills(df: DataFrame, key: str, fills: DataFrame, fields: Sequence[str]) -> DataFrame:
    """``df`` with the fills put in and a boolean ``<field>_filled`` for each field."""
    per = fills.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("field_name", "fill_value"))).alias("_fills"))  # at most one entry per field
    out = df.join(per, key, "left")
    for f in fields:
        got = F.try_element_at("_fills", F.lit(f))
        hit = F.coalesce(F.array_contains(F.map_keys("_fills"), f), F.lit(False))
        out = out.withColumn(f"{f}_filled", hit).withColumn(f, F.when(hit, got.try_cast(df.schema[f].dataType)).otherwise(F.col(f)))
    return out.drop("_fills")
