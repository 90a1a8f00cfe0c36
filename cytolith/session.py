"""Session defaults for local work; on a cluster, pass the cluster's own settings."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession

#: Rows that a task gets where they are dealt by their number; small tables are dealt no finer than FEW rows to a task.
ROWS, FEW = 1 << 20, 1 << 15


def local_session(cores: int = 8, memory: str = "8g", **settings: str) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName("cytolith")
    defaults = {
        "spark.sql.shuffle.partitions": str(cores),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": memory,
        "spark.ui.enabled": "false",
    }
    for key, value in (defaults | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which the driver and all executors share.

    A temporary folder is set only where there is none and the master is local; elsewhere that is an error.
    """
    context, named = spark.sparkContext, spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="cytolith-checkpoint-"))
    return context.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and cut from its past."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame, *keys: str | Column, rows: int | None = None, each: int = ROWS) -> DataFrame:
    """``df`` hashed by ``keys`` over as many tasks as it needs, ``each`` rows to a task, so that what a task holds does not grow with the table.

    Groups, windows and joins by these keys stay where they are. ``rows`` is how many there are at most; without it they are counted, which runs a job.
    """
    n = df.count() if rows is None else rows
    fewest = min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // FEW))
    return df.repartition(max(1, fewest, -(-n // each)), *keys)
