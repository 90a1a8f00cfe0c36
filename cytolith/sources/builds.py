"""Counts per cell and region, built cell by cell, so that a build can be taken up again."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytolith.operators.intervals import points_in_regions
from cytolith.operators.ordered import running
from cytolith.session import kept

PARTS, MARKS, MANIFEST = "parts", "marks", "manifest"
_PART = "cell_no string, chrom string, region_start long, region_end long, mc long, cov long"
_MARK = "cell_no string, n_rows long, digest string"


def _folded(text) -> list:
    """Four aggregates of 60 bits each of the digest of a text; the order of rows does not matter, so it has to be in the text."""
    digest = F.sha2(text, 256)
    return [F.lower(F.lpad(F.hex(F.bit_xor(F.conv(F.substring(digest, 15 * i + 1, 15), 16, 10).cast("long"))), 15, "0")) for i in range(4)]


def ordered_digest(df: DataFrame, columns: list[str]) -> tuple[int, str]:
    """Number of distinct rows and a digest of them with their places in the order of ``columns``.

    Places are counted over ranges of the order, so no task sees all rows. Runs a job.
    """
    rows = df.select(F.struct(*columns).alias("row")).distinct().withColumn("one", F.lit(1))
    placed = running(rows, "row", ["one"])
    n, *parts = placed.agg(F.count(F.lit(1)), *_folded(F.concat_ws(":", F.col("sum_one").cast("string"), F.to_json("row")))).first()
    return n, "".join(parts) if n else ""


def manifest(cells: DataFrame, regions: DataFrame, settings: dict) -> dict:
    """What a build depends on: cells and regions in their order, and settings."""
    n_cells, cell_digest = ordered_digest(cells, ["cell_no"])
    n_regions, region_digest = ordered_digest(regions, ["chrom", "start_pos", "end_pos"])
    return {"n_cells": n_cells, "cells": cell_digest, "n_regions": n_regions, "regions": region_digest, "settings": json.loads(json.dumps(settings, sort_keys=True))}


def region_counts(sites: DataFrame, regions: DataFrame) -> DataFrame:
    """Summed counts (cell_no, chrom, region_start, region_end, mc, cov) of sites (cell_no, chrom, pos, mc, uc) in regions."""
    inside = points_in_regions(sites, regions.select("chrom", "start_pos", "end_pos").distinct())
    return inside.groupBy("cell_no", "chrom", "region_start", "region_end").agg(F.sum("mc").cast("long").alias("mc"), F.sum(F.col("mc") + F.col("uc")).cast("long").alias("cov"))


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _compare(spark: SparkSession, path: str, wanted: dict) -> None:
    """Write the manifest where none is; another one is an error that names what differs."""
    try:
        found = json.loads(spark.read.text(path, wholetext=True).first()[0])
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        spark.createDataFrame([(json.dumps(wanted),)], "value string").coalesce(1).write.text(path)
        return
    differ = sorted(k for k in wanted if found.get(k) != wanted[k])
    if differ:
        raise ValueError(f"{path} belongs to another build: {', '.join(differ)} differ")


def _marks(parts: DataFrame) -> DataFrame:
    parts = parts.groupBy("cell_no").agg(F.count(F.lit(1)).alias("n_rows"), F.concat(*_folded(F.to_json(F.struct("chrom", "region_start", "region_end", "mc", "cov")))).alias("digest"))
    return parts.select("cell_no", "n_rows", "digest")


def unfinished(cells: DataFrame, folder: str) -> DataFrame:
    """Cells without a part, or whose part is not as it was when it was marked as done."""
    spark = cells.sparkSession
    marked = _read(spark, f"{folder}/{MARKS}", _MARK)
    good = marked.join(_marks(_read(spark, f"{folder}/{PARTS}", _PART)), ["cell_no", "n_rows", "digest"], "left_semi")
    return cells.select(F.col("cell_no").cast("string").alias("cell_no")).where("cell_no is not null").distinct().join(good, "cell_no", "left_anti")


def build_counts(cells: DataFrame, regions: DataFrame, read: Callable[[DataFrame], DataFrame], folder: str, settings: dict | None = None) -> tuple[DataFrame, int]:
    """(counts per cell and region, number of cells built now) of a folder that keeps one part per cell.

    The manifest is compared before anything is read; another manifest is an error. Parts
    are held against the digest they were marked with when they were done, and only cells
    without a whole part are passed to ``read``, which returns their sites (cell_no, chrom,
    pos, mc, uc), and overwritten, each its own partition. A cell without sites has a part
    of one empty row, which is not returned. Marks are written after parts, so a build that
    was broken off is taken up at the cells it had not marked. cell_no is text in the folder.
    """
    spark = cells.sparkSession
    _compare(spark, f"{folder}/{MANIFEST}", manifest(cells, regions, settings or {}))
    open_ = kept(unfinished(cells, folder))
    n = open_.count()
    if n:
        counts = region_counts(read(open_), regions).withColumn("cell_no", F.col("cell_no").cast("string")).join(open_, "cell_no", "left_semi")
        empty = open_.select("cell_no", *[F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in _PART.split(", ")[1:])])
        built = kept(counts.unionByName(empty))
        built.repartition("cell_no").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cell_no").parquet(f"{folder}/{PARTS}")
        _marks(built).repartition("cell_no").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cell_no").parquet(f"{folder}/{MARKS}")
    columns = [c.split()[0] for c in _PART.split(", ")]
    return _read(spark, f"{folder}/{PARTS}", _PART).where("region_start is not null").select(*columns), n
