"""A Python function over many arguments, spread over the cluster; results that are None are dropped."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def map_args(spark: SparkSession, func: Callable[..., dict | None], args: Sequence[Sequence[Any]], schema: str, partitions: int | None = None) -> DataFrame:
    """Rows ``func(*a)`` (dicts by ``schema``) for each argument list of ``args``.

    Arguments travel pickled, as a bounded driver-side list; a failing call fails its task, which
    Spark retries. For work per key of a table use ``groupBy().applyInPandas``.
    """
    rows = [(i, bytearray(pickle.dumps(tuple(a)))) for i, a in enumerate(args)]
    df = spark.createDataFrame(rows, "i long, a binary")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [func(*pickle.loads(bytes(a))) for a in pdf["a"]]
            yield pd.DataFrame([o for o in out if o is not None], columns=names)

    names = spark.createDataFrame([], schema).columns
    return df.repartition(partitions or min(max(len(rows), 1), spark.sparkContext.defaultParallelism), "i").mapInPandas(run, schema)
