"""Session helpers: table access and durable lineage cuts."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows that are broadcast on purpose.
MOST_BROADCAST = 100_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make reliable checkpoints possible.

    The folder comes from ``spark.checkpoint.dir`` (shared storage on a cluster). Only a local
    session without that setting gets a temporary folder; on a cluster its absence is an error,
    as a machine-local folder would lose data with the executor.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not (sc.master or "").startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = "file://" + os.path.join(tempfile.gettempdir(), "tracewell-checkpoints")
    sc.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage.

    The result keeps the partitioning and row order of ``df`` and survives the loss of executors.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def bounded(df: DataFrame, rows: int = MOST_BROADCAST) -> DataFrame:
    """A small result, materialised and, if it has at most ``rows`` rows, marked for broadcast.

    The size is checked by counting; a larger result is joined as the planner sees fit, by a shuffle.
    """
    kept = cut(df)
    return F.broadcast(kept) if kept.limit(rows + 1).count() <= rows else kept
