"""Continuous periods and gaps from overlapping, nested and gapped intervals per entity.

Method: an ordered map of disjoint intervals per entity is kept in keyed state. Each insertion
locates the overlapped intervals by binary search, replaces them by their union and so changes
the gaps between neighbours. ``IntervalMap`` is that state; the batch operator below and the
streaming operator in ``quillstone.streaming.intervals`` both feed it.

So that one entity with a third of all rows does not land in one task, state is keyed by
(entity, time block): an interval is cut at the block borders it crosses, every block keeps its
own map, and only the first and last piece of a block is looked at again when blocks are joined.
Before the shuffle every task merges what it has read into such maps (a union of unions is the
union), so however often a hot entity covers a time, few rows of it move. The number of rows of the
second step per entity is bounded by the number of blocks, not by the number of its intervals.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class IntervalMap:
    """Disjoint intervals in order; touching ones are one interval."""

    __slots__ = ("starts", "ends")

    def __init__(self, starts: Iterable[int] = (), ends: Iterable[int] = ()):
        self.starts, self.ends = list(starts), list(ends)

    def insert(self, start: int, end: int) -> None:
        starts, ends = self.starts, self.ends
        if not ends or start > ends[-1]:  # the usual case of ordered input
            starts.append(start)
            ends.append(end)
            return
        lo = bisect_left(ends, start)  # first interval that ends at or after the new start
        hi = bisect_right(starts, end)  # first interval that starts after the new end
        if lo < hi:
            start, end = min(start, starts[lo]), max(end, ends[hi - 1])
        starts[lo:hi] = [start]
        ends[lo:hi] = [end]

    def periods(self) -> list[tuple[int, int]]:
        return list(zip(self.starts, self.ends))

    def gaps(self) -> list[tuple[int, int]]:
        return list(zip(self.ends[:-1], self.starts[1:]))


def _block_maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (k, b, s, e) ordered by (k, b, s) → the disjoint pieces of each (k, b); in that order an insertion is at the end."""
    out: tuple[list, list, list, list] = ([], [], [], [])
    key, state = None, IntervalMap()

    def close() -> None:
        out[0].extend([key[0]] * len(state.starts))
        out[1].extend([key[1]] * len(state.starts))
        out[2].extend(state.starts)
        out[3].extend(state.ends)

    schema = None
    for batch in batches:
        schema = batch.schema
        for k, b, s, e in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if (k, b) != key:
                if key is not None:
                    close()
                key, state = (k, b), IntervalMap()
                if len(out[0]) >= 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(out, schema)], schema=schema)
                    for c in out:
                        c.clear()
            state.insert(s, e)
    if key is not None:
        close()
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(out, schema)], schema=schema)


#: Intervals that a task holds before it hands its maps on.
HELD = 200_000


def _partial_maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (k, b, s, e) in any order → disjoint pieces of each (k, b) of this task, for less to shuffle."""
    held: dict[tuple, IntervalMap] = {}
    rows, schema = 0, None

    def out() -> pa.RecordBatch:
        cols: tuple[list, list, list, list] = ([], [], [], [])
        for (k, b), m in held.items():
            cols[0].extend([k] * len(m.starts))
            cols[1].extend([b] * len(m.starts))
            cols[2].extend(m.starts)
            cols[3].extend(m.ends)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, schema)], schema=schema)

    for batch in batches:
        schema = batch.schema
        for k, b, s, e in zip(*(batch.column(i).to_pylist() for i in range(4))):
            m = held.get((k, b))
            if m is None:
                m = held[k, b] = IntervalMap()
            m.insert(s, e)
        rows += batch.num_rows
        if rows >= HELD:
            yield out()
            rows = 0
    if held:
        yield out()


def periods_and_gaps(df: DataFrame, entity: str, start: str, end: str, block_days: int = 64) -> DataFrame:
    """Rows ``entity, seg_kind ('period' | 'gap'), ds_from, ds_to`` (timestamps to the second).

    Times are truncated to the second; an interval needs an entity, both times and end > start,
    others are ignored. Repeated rows change nothing. An interval that begins when another ends
    continues it. No valid row: empty result. Other columns of ``df`` are not read, so any name
    may occur among them.
    """
    kind = df.schema[entity].dataType.simpleString()
    schema = f"k {kind}, b long, s long, e long"
    pieces = block_pieces(df, entity, start, end, block_days).mapInArrow(_partial_maps, schema).repartition("k", "b").sortWithinPartitions("k", "b", "s").mapInArrow(_block_maps, schema)
    return join_blocks(pieces, entity)


def block_pieces(df: DataFrame, entity: str, start: str, end: str, block_days: int) -> DataFrame:
    """Valid intervals cut at the borders of time blocks: rows ``k, b, s, e`` in epoch seconds."""
    width = block_days * 86400
    sec = lambda c: F.unix_timestamp(F.date_trunc("second", F.col(c).cast("timestamp"))).cast("long")
    return (
        df.select(F.col(entity).alias("k"), sec(start).alias("s"), sec(end).alias("e"))
        .where(F.col("k").isNotNull() & (F.col("e") > F.col("s")))
        .withColumn("b", F.explode(F.sequence(F.expr(f"s div {width} - if(s < 0 and s % {width} != 0, 1, 0)"), F.expr(f"(e - 1) div {width} - if(e - 1 < 0 and (e - 1) % {width} != 0, 1, 0)"))))
        .select("k", "b", F.greatest("s", F.col("b") * width).alias("s"), F.least("e", (F.col("b") + 1) * width).alias("e"))
    )


def join_blocks(pieces: DataFrame, entity: str) -> DataFrame:
    """Rows ``entity, seg_kind, ds_from, ds_to`` from the disjoint pieces ``k, b, s, e`` of every block of an entity."""
    # A block's pieces are folded into one row: inner pieces are final, the outer two are joined over blocks.
    # The list of a block is bounded by its seconds; it has as many entries as the block has periods.
    blocks = pieces.groupBy("k", "b").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("p"))
    blocks = blocks.select("k", "b", "p", F.element_at("p", 1)["s"].alias("s0"), F.element_at("p", -1)["e"].alias("e1"), F.element_at("p", 1)["e"].alias("e0"), F.size("p").alias("n"))
    by = Window.partitionBy("k").orderBy("b")
    prev_end = F.lag("e1").over(by)
    next_start = F.lead("s0").over(by)
    # a chain: blocks whose border is covered on both sides; a block of several pieces ends one chain and begins another
    linked = F.coalesce(prev_end == F.col("s0"), F.lit(False))
    w = blocks.withColumn("prev_end", prev_end).withColumn("next_start", next_start).withColumn("linked", linked)
    # start of the chain that reaches this block's first piece
    opens = F.when(F.col("n") > 1, F.element_at("p", -1)["s"]).when(~F.col("linked"), F.col("s0"))
    w = w.withColumn("chain", F.last(opens, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1)))
    w = w.withColumn("first_start", F.when(F.col("linked"), F.col("chain")).otherwise(F.col("s0")))
    goes_on = F.coalesce(F.col("next_start") == F.col("e1"), F.lit(False))
    # pieces that end in this block, each with the start of its whole period
    whole = F.transform(F.col("p"), lambda x, i: F.struct(F.when(i == 0, F.col("first_start")).otherwise(x["s"]).alias("a"), x["e"].alias("z")))
    ended = F.when(goes_on, F.slice(whole, F.lit(1), F.col("n") - 1)).otherwise(whole)
    inner = F.transform(F.sequence(F.lit(1), F.greatest(F.col("n") - 1, F.lit(1))), lambda i: F.struct(F.get("p", i - 1)["e"].alias("a"), F.get("p", i)["s"].alias("z")))
    gaps = F.when(F.col("n") > 1, inner).otherwise(F.expr("array()").cast("array<struct<a:bigint,z:bigint>>"))
    between = F.when(F.col("prev_end") < F.col("s0"), F.array(F.struct(F.col("prev_end").alias("a"), F.col("s0").alias("z")))).otherwise(F.expr("array()").cast("array<struct<a:bigint,z:bigint>>"))
    tag = lambda arr, kind: F.transform(arr, lambda x: F.struct(F.lit(kind).alias("seg_kind"), x["a"].alias("a"), x["z"].alias("z")))
    rows = w.select("k", F.explode(F.concat(tag(ended, "period"), tag(F.concat(between, gaps), "gap"))).alias("r"))
    ts = lambda c: F.timestamp_seconds(c).cast("timestamp_ntz")
    return rows.select(F.col("k").alias(entity), F.col("r.seg_kind").alias("seg_kind"), ts(F.col("r.a")).alias("ds_from"), ts(F.col("r.z")).alias("ds_to"))
