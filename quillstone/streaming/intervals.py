"""Streaming: continuous periods per entity in keyed state, and windowed views of event streams."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillstone.operators.intervals import IntervalMap, block_pieces, join_blocks

STATE = "starts array<long>, ends array<long>"


def _update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, idle_ms: int = 0) -> Iterator[pd.DataFrame]:
    """Inserts the new intervals; puts out the pieces of the entity's block as they now are."""
    if state.hasTimedOut:
        state.remove()
        return
    m = IntervalMap(*state.get) if state.exists else IntervalMap()
    for pdf in batches:
        for s, e in zip(pdf["s"], pdf["e"]):
            m.insert(int(s), int(e))
    state.update((m.starts, m.ends))
    if idle_ms:
        state.setTimeoutDuration(idle_ms)
    n = len(m.starts)
    yield pd.DataFrame({"k": [key[0]] * n, "b": [key[1]] * n, "place": range(n), "n_pieces": [n] * n, "s": m.starts, "e": m.ends})


def stream_pieces(df: DataFrame, entity: str, start: str, end: str, block_days: int = 64, idle: str | None = None) -> DataFrame:
    """A streaming frame of ``k, b, place, n_pieces, s, e`` (epoch seconds), to be written in update mode.

    State is one ordered interval map per (entity, time block), so a hot entity is spread over its
    blocks and a map never holds more than a block. A trigger puts out the blocks it touched; a sink
    keeps the last rows of a block (``n_pieces`` tells how many). With ``idle`` (as '30 days') the state
    of a block that nothing has touched for so long is dropped; later intervals of it start anew.
    ``periods_of_pieces`` makes periods and gaps. Incomplete and empty intervals are ignored.
    """
    rows = block_pieces(df.withColumn(entity, F.col(entity).cast("string")), entity, start, end, block_days)
    ms = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else 0
    timeout = GroupStateTimeout.ProcessingTimeTimeout if ms else GroupStateTimeout.NoTimeout
    return rows.groupBy("k", "b").applyInPandasWithState(partial(_update, idle_ms=ms), "k string, b long, place long, n_pieces long, s long, e long", STATE, "update", timeout)


def periods_of_pieces(pieces: DataFrame, entity: str) -> DataFrame:
    """Periods and gaps of the blocks' last pieces, as ``periods_and_gaps`` gives them."""
    return join_blocks(pieces.select("k", "b", "s", "e"), entity)


def tumbling(df: DataFrame, ts: str, width: str, by: list[str], value: str, watermark: str = "1 hour") -> DataFrame:
    """Counts and sums per event-time window; rows later than the watermark are dropped in a stream."""
    rows = df.withColumn("_ts", F.col(ts).cast("timestamp"))
    if df.isStreaming:
        rows = rows.withWatermark("_ts", watermark)
    out = rows.groupBy(F.window("_ts", width).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("win_start"), *by, "n", "total")


def sessions(df: DataFrame, ts: str, gap: str, by: list[str], watermark: str = "1 hour") -> DataFrame:
    """Sessions of events with less than ``gap`` between them: start, end of the last event's gap, count."""
    rows = df.withColumn("_ts", F.col(ts).cast("timestamp"))
    if df.isStreaming:
        rows = rows.withWatermark("_ts", watermark)
    out = rows.groupBy(F.session_window("_ts", gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
    return out.select(*by, F.col("w.start").alias("sess_start"), F.col("w.end").alias("sess_end"), "n")
