"""Small helpers that the corpus operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cytolith.session import kept, shared_folder

#: Rows, and bytes of rows without a fixed size, up to which a side that was counted may be broadcast; larger sides are shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20
#: Narrow rows that a task takes at least where many partitions hold few of them.
NARROW = 1 << 14


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder."""
    return kept(df)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read again."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def sized(df: DataFrame, width: Column | None = None) -> DataFrame:
    """``df`` with a broadcast hint if it is small; otherwise as it is, for a shuffled join.

    Rows are counted, and their bytes summed where ``width`` tells those of a row that has no fixed size.
    """
    rows, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.lit(0) if width is None else width), F.lit(0))).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES else df


def gathered(df: DataFrame, rows: int, each: int = NARROW) -> DataFrame:
    """``df``, of ``rows`` narrow rows at most, in no more partitions than ``each`` rows to one make; many of few rows are read by one task.

    Every task of a shuffle leaves files, so a small table in hundreds of partitions costs disk by its tasks and not by its rows.
    Nothing is moved, and a table with more rows than that to a partition stays as it is.
    """
    return df.coalesce(max(1, -(-rows // each)))


def whole_text(column: str = "text") -> Column:
    """A text in which null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def hex64(column: Column) -> Column:
    """16 lowercase hex digits of a 64-bit value."""
    return F.lower(F.lpad(F.hex(column), 16, "0"))
