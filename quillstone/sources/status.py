"""A status table of tasks: one appended row per change of state; the latest row of a run is its state."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "run_id string, task string, ds string, status string, message string, ts timestamp"


@dataclass
class TaskTracker:
    """Appends status rows to a Parquet folder; values are data, never formatted into SQL."""

    spark: SparkSession
    path: str
    task: str
    ds: str
    run_id: str = field(default_factory=lambda: uuid.uuid4().hex)

    def _append(self, status: str, message: str | None = None) -> None:
        row = self.spark.createDataFrame([(self.run_id, self.task, self.ds, status, message, None)], SCHEMA).withColumn("ts", F.current_timestamp())
        row.write.mode("append").parquet(self.path)

    def set_started(self) -> None:
        self._append("started")

    def set_success(self) -> None:
        self._append("success")

    def set_failure(self, message: str | None = None) -> None:
        self._append("failure", message)

    def finish(self, code: int, message: str | None = None) -> None:
        """Success for code 0, else failure and RuntimeError."""
        if code == 0:
            self.set_success()
        else:
            self.set_failure(message)
            raise RuntimeError(message or f"task {self.task} ended with {code}")


def latest_status(spark: SparkSession, path: str) -> DataFrame:
    """The last row of every run, as a mergeable maximum."""
    df = spark.read.schema(SCHEMA).parquet(path)
    return df.groupBy("run_id", "task", "ds").agg(F.max_by(F.struct("status", "message", "ts"), F.struct("ts", "status")).alias("r")).select("run_id", "task", "ds", "r.*")
