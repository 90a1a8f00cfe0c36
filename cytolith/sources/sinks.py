"""Writers: interval and table files, region matrices, summaries. Existing output is an error unless said otherwise."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cytolith.functions.labels import chrom_key, number_or_na

ORDER = ["chrom", "start_pos", "end_pos"]


def write_table(df: DataFrame, path: str, order: list[str] | None = None, header: bool = True, mode: str = "errorifexists") -> None:
    """Gzipped tab-separated parts, each in order; parts follow each other if an order is given."""
    rows = df if not order else df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows.write.mode(mode).csv(path, sep="\t", header=header, compression="gzip", nullValue="NA")


def write_intervals(df: DataFrame, path: str, names: list[str] | None = None, mode: str = "errorifexists") -> None:
    write_table(df.select(*ORDER, *(names or [])), path, ORDER, False, mode)


def write_lines(df: DataFrame, path: str, line: str = "line", mode: str = "errorifexists") -> None:
    """Records as the text they were read from, in order of place."""
    df.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER, line).select(line).write.mode(mode).text(path)


def named_regions(df: DataFrame, by: list[str], kind: str) -> DataFrame:
    """Regions with the name ``<by>__<kind>__<n>``, n from 1 in order of place; a group has at most as many regions as a genome has room for."""
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(chrom_key(F.col("chrom")), *ORDER))
    return df.withColumn("name", F.concat_ws("__", *by, F.lit(kind), nth))


def write_named_regions(df: DataFrame, path: str, by: list[str], columns: list[str], mode: str = "errorifexists") -> None:
    """A folder per group with its regions under a header that begins with #, in order of place."""
    rows = df.select(*by, F.col("chrom").alias("#chrom"), F.col("start_pos").alias("start"), F.col("end_pos").alias("end"), *columns)
    ordered = rows.repartition(*by).sortWithinPartitions(*by, chrom_key(F.col("#chrom")), "#chrom", "start", "end")
    ordered.write.partitionBy(*by).mode(mode).option("comment", "\x01").csv(path, sep="\t", header=True)


def write_groups(membership: DataFrame, path: str, by: list[str], mode: str = "errorifexists") -> None:
    """A folder per comparison with lines of cell, group_A or group_B, without a header; cells of neither are left out."""
    rows = membership.where("membership <> '-'").select(*by, "cell_no", "membership").repartition(*by).sortWithinPartitions(*by, "membership", "cell_no")
    rows.write.partitionBy(*by).mode(mode).csv(path, header=False)


def region_matrix(df: DataFrame, cells: list[str], digits: int = 8) -> DataFrame:
    """One row per region and one text column per cell, NA where there is no value; ``cells`` bounds the width."""
    wide = df.groupBy(*ORDER).pivot("cell", cells).agg(F.first("value"))
    return wide.select(*ORDER, *[number_or_na(F.col(f"`{c}`"), digits).alias(c) for c in cells])


def write_region_matrix(df: DataFrame, path: str, cells: list[str], digits: int = 8, mode: str = "errorifexists") -> None:
    write_table(region_matrix(df, cells, digits), path, ORDER, True, mode)


def write_summary(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object per row, for manifests and summaries."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode(mode).text(path)


def fingerprint(df: DataFrame, *columns: str) -> DataFrame:
    """Rows and an order-free digest of columns, to tell whether a kept result still fits its input."""
    digest = F.sha2(F.concat_ws("\x1f", *columns), 256)
    return df.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(digest)).alias("digest"))
