"""Session helpers: defaults, the shared checkpoint folder, size-checked broadcasts.

Nothing here caches or checkpoints on one executor only: lineage is cut with a reliable
``checkpoint()`` into the folder that the cluster names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side joined by broadcast has at most this many (narrow) rows; beyond it the join shuffles.
BROADCAST_ROWS = 200_000


def get_spark(app: str = "quillstone", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library is written for (UTC, AQE, Arrow)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
    }
    return b.config(map=base | {k.replace("__", "."): v for k, v in conf.items()}).getOrCreate()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives this package to the Python workers of the session's application, once.

    Needed where workers do not find it by themselves (not installed, not on their path).
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="quillstone-")) / "quillstone.zip"  # on the driver; Spark hands it out
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder: the one set, else that of ``spark.checkpoint.dir``.

    Where neither is set, a local session (tests) gets a folder of its own, removed at exit; a cluster
    gets a ValueError, as a folder of one machine is of no use there.
    """
    sc = spark.sparkContext
    has = sc._jsc.sc().getCheckpointDir()
    if has.isDefined():
        return has.get()
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="quillstone-ckpt-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
    sc.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder, with no lineage before it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than one row beyond that."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast when its size is proven small, else left to a shuffled join.

    ``df`` is evaluated for the check, so pass something cheap or checkpointed.
    """
    return F.broadcast(df) if small(df, rows) else df


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as the cluster has cores, for costly narrow work.

    Moves rows only if a scan comes in fewer partitions, so never where there is much of it. A plan
    with a shuffle is left to AQE; nothing is run to count partitions.
    """
    plan = df._jdf.queryExecution()
    if "Exchange" in plan.executedPlan().toString():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if plan.toRdd().getNumPartitions() < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
