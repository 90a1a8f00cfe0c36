"""Readers of site, context, interval and region files, and of annotation tables.

Files are tab-separated text, gzipped or not; a folder or pattern reads many. The file of
a row is kept; gzipped files are read by one task each, in line order.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cytolith.functions.ids import base_name
from cytolith.sources.files import RECORD_FILE

SITE = "chrom string, start_pos long, end_pos long, prob double, mc long, uc long"
CONTEXT = "chrom string, pos long, strand string, context string, mc long, cov long, flag int"
#: The twelve columns of a region record; the adjusted p stays text, for it may be NA.
RECORD = (
    "chrom string, start_pos long, end_pos long, t_statistic double, n_sites long, n_cells_a long, n_cells_b long, meth_a double, meth_b double,"
    " lower_group string, raw_p double, adjusted_p string"
)


def _read(spark: SparkSession, path: str, schema: str, least: int, keep_line: bool = False) -> DataFrame:
    """Lines of at least ``least`` tab-separated columns by schema, with their file; further columns are not read.

    A line that is shorter, or has a value that does not parse, keeps its text in
    ``bad_line``. Empty values are null. Empty lines and those that begin with # are skipped.
    """
    lines = spark.read.text(path).where((F.col("value") != "") & ~F.col("value").startswith("#")).withColumn("file", F.col("_metadata.file_path"))
    parts = F.split("value", "\t", -1)
    fields = [x.split() for x in schema.split(", ")]
    texts = {name: F.nullif(F.get(parts, i), F.lit("")) for i, (name, _) in enumerate(fields)}
    wrong = F.size(parts) < least
    for name, kind in fields:
        wrong = wrong | (texts[name].isNotNull() & texts[name].try_cast(kind).isNull())
    return lines.select(*[texts[name].try_cast(kind).alias(name) for name, kind in fields], F.when(wrong, F.col("value")).alias("bad_line"), "file", *([F.col("value").alias("line")] if keep_line else []))


def _checked(df: DataFrame, good: Column, what: str) -> DataFrame:
    """``df`` without bad_line; a row that is not good is an error."""
    bad = F.col("bad_line").isNotNull() | ~F.coalesce(good, F.lit(False))
    message = F.concat(F.lit(f"not a {what}: "), F.coalesce("bad_line", F.lit("a value is missing or out of range")), F.lit(" in "), F.col("file"))
    return df.withColumn("file", F.when(bad, F.raise_error(message).cast("string")).otherwise(F.col("file"))).drop("bad_line")


def _good_site() -> Column:
    return (F.col("mc") >= 0) & (F.col("uc") >= 0) & (F.col("start_pos") >= 0) & F.col("end_pos").isNotNull() & (F.col("prob") >= 0)


def read_sites(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Sites of cells, lines of six columns or more; bad lines are an error, or are left out if not ``strict``.

    Without coverage a site is kept if ``strict``, and left out otherwise; ``left_out`` counts.
    """
    rows = _read(spark, path, SITE, 6)
    if strict:
        return _checked(rows, _good_site(), "site")
    return rows.where(F.col("bad_line").isNull() & _good_site() & (F.col("mc") + F.col("uc") > 0)).drop("bad_line")


def left_out(spark: SparkSession, path: str) -> DataFrame:
    """(file, n_lines, n_bad, n_uncovered): what ``read_sites`` leaves out of each file when it is not strict."""
    rows = _read(spark, path, SITE, 6)
    bad = F.col("bad_line").isNotNull() | ~F.coalesce(_good_site(), F.lit(False))
    return rows.groupBy("file").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(bad).alias("n_bad"), F.count_if(~bad & (F.col("mc") + F.col("uc") == 0)).alias("n_uncovered"))


def read_context_sites(spark: SparkSession, path: str, context: str = "CGN") -> DataFrame:
    """1-based context rows, of six columns or more, of one context, with ``pos0`` 0-based; the context is chosen before values are checked."""
    from cytolith.operators.sites import in_context

    rows = _read(spark, path, CONTEXT, 6).where(in_context(F.col("context"), context))
    good = (F.col("mc") >= 0) & (F.col("cov") >= F.col("mc")) & (F.col("pos") >= 1)
    return _checked(rows, good, "context row").withColumn("pos0", F.col("pos") - 1)


def read_intervals(spark: SparkSession, path: str) -> DataFrame:
    """chrom, start, end of an interval file; further columns are not read."""
    return _checked(_read(spark, path, "chrom string, start_pos long, end_pos long", 3), F.col("end_pos") > F.col("start_pos"), "interval").drop("file")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Region records with sample and compared types from ``<sample>__<left>_vs_<right>_DMRs.bed``, and their line as it stands; other names are an error."""
    good = (F.col("start_pos") >= 0) & (F.col("end_pos") > F.col("start_pos")) & F.col("lower_group").isin("group_A", "group_B")
    rows = _checked(_read(spark, path, RECORD, 12, keep_line=True), good & base_name(F.col("file")).rlike(RECORD_FILE), "region record")
    return rows.withColumns({c: F.regexp_extract(base_name(F.col("file")), RECORD_FILE, i) for i, c in ((1, "sample"), (2, "left_type"), (3, "right_type"))})


def first_present(df: DataFrame, *names: str) -> str:
    """The first of the names that is a column; none is an error."""
    for name in names:
        if name in df.columns:
            return name
    raise ValueError(f"none of {', '.join(names)} is a column")


def read_annotation(spark: SparkSession, path: str) -> DataFrame:
    """A cell table with header, by suffix comma- or tab-separated, all text; common names are unified."""
    rows = spark.read.csv(path, header=True, inferSchema=False, sep="\t" if ".tsv" in path or ".txt" in path else ",")
    wanted = {
        "cell": ("cell", "cell_id"),
        "cell_type": ("cell_type", "cell_type_integrated"),
        "sample": ("sample", "sample_id"),
        "excluded": ("exclude_from_main_analysis", "exclude"),
        "status": ("analysis_status", "status"),
    }
    found = {new: next((old for old in olds if old in rows.columns), None) for new, olds in wanted.items()}
    return rows.select(*[F.col(f"`{old}`").alias(new) if old else F.lit(None).cast("string").alias(new) for new, old in found.items()])


def read_matrix(spark: SparkSession, path: str, ids: list[str]) -> DataFrame:
    """A wide matrix with header as long rows (ids, cell, value); NA is left out."""
    rows = spark.read.csv(path, header=True, inferSchema=False, sep="\t")
    values = [c for c in rows.columns if c not in ids]
    typed = rows.select(*ids, *[F.col(f"`{c}`").try_cast("double").alias(c) for c in values])
    return typed.unpivot(ids, values, "cell", "value").where("value is not null")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of text files, for rules that depend on the order of lines.

    Each file is one record of a task and is streamed from there; files are as many as cells.
    """

    def work(frames: Iterator) -> Iterator:
        import gzip
        import io

        import pandas as pd

        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                raw = io.BytesIO(content)
                text = io.TextIOWrapper(gzip.GzipFile(fileobj=raw) if name.endswith(".gz") else raw, encoding="utf-8")
                while lines := text.readlines(1 << 24):
                    start = frame.attrs.get(name, 0)
                    yield pd.DataFrame({"file": name, "line_no": range(start, start + len(lines)), "line": [x.rstrip("\r\n") for x in lines]})
                    frame.attrs[name] = start + len(lines)

    schema = T.StructType([T.StructField("file", T.StringType()), T.StructField("line_no", T.LongType()), T.StructField("line", T.StringType())])
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(work, schema)
