"""Session set-up and the helpers every operator shares."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only after counting it and only up to this many rows.
# The rows passed in are narrow (grid geometry, lookups: under 200 bytes).
BROADCAST_ROWS = 200_000


def session(app: str = "moundlake", master: str | None = None, **conf: str) -> SparkSession:
    """Build a session with adaptive execution and UTC time."""
    builder = SparkSession.builder.appName(app)
    if master is not None:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, so that workers can import it wherever they run."""
    if any(name.endswith("moundlake.zip") for name in spark.sparkContext.listFiles):
        return
    home = Path(__file__).resolve().parent
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='moundlake-')}/moundlake", "zip", home.parent, home.name)
    spark.sparkContext.addPyFile(archive)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``; make one only in local mode."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        context.setCheckpointDir(configured)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="moundlake-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there.

    Used where a result feeds several branches or a loop: the work before it
    runs once, and a lost executor re-reads the files instead of recomputing.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def bounded_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast when ``df`` is counted to hold at most ``max_rows`` rows.

    A larger side is returned as it is, so that the join shuffles both sides and
    adaptive execution splits the skewed partitions.
    """
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df


def broadcast_aggregate(df: DataFrame) -> DataFrame:
    """``bounded_broadcast`` of an aggregate over a big input: written out once, then counted and joined from there."""
    return bounded_broadcast(cut_lineage(df))


def spread(df: DataFrame) -> DataFrame:
    """Deal rows evenly over the shuffle partitions before heavy per-row work.

    A fixed partition number keeps adaptive execution from packing a small but
    slow-to-process table into one task.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
