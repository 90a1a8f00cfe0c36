"""Incremental site counts: files that arrive are read once and added to tables that are kept.

Sites are summed per batch and appended; readers sum over batches, for sums of sums are
sums. A checkpoint remembers the files, so a run that is repeated takes only new ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cytolith.sources.tables import SITE


def read_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    rows = spark.readStream.schema(SITE).option("sep", "\t").option("maxFilesPerTrigger", files_per_batch).csv(folder)
    return rows.withColumn("file", F.col("_metadata.file_path"))


def append_levels(sites: DataFrame, output: str, checkpoint: str) -> StreamingQuery:
    """Take all files that are new, append sums per file as Parquet, and end."""

    def keep(batch: DataFrame, number: int) -> None:
        sums = batch.where("mc + uc > 0").groupBy("file").agg(
            F.count(F.lit(1)).alias("n_sites"), F.sum("mc").alias("mc"), F.sum("uc").alias("uc"), F.sum(F.col("mc") / (F.col("mc") + F.col("uc"))).alias("ratios")
        )
        # a batch that is run again after a failure replaces its own folder
        sums.write.mode("overwrite").parquet(f"{output}/batch={number}")

    return sites.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_levels(spark: SparkSession, output: str) -> DataFrame:
    sums = spark.read.parquet(output).groupBy("file").agg(*[F.sum(c).alias(c) for c in ("n_sites", "mc", "uc", "ratios")])
    return sums.select("file", "n_sites", (F.col("mc") + F.col("uc")).alias("total_coverage"), (F.col("ratios") / F.col("n_sites")).alias("mean_site_level"), (F.col("mc") / (F.col("mc") + F.col("uc"))).alias("overall_level"))
