"""Tables of input files: which cell, sample or comparison each path holds.

Every function takes a DataFrame with a column ``path``, as ``listing`` makes it, so that
a table of millions of paths is grouped like any other. A name that two files claim is an
error when the table is read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cytolith.functions.ids import base_name, canonical_cell_id

# Names of files and folders.
RECORD_FILE = r"^([A-Za-z]+[0-9]+)__(.+)_vs_(.+)_DMRs\.bed$"
SAMPLE_FOLDER = r"^([A-Za-z]+[0-9]+)_sample_celltype$"
FLAT_FOLDER = "sample_celltype"
RUN_FOLDER = r"^[0-9]+_((?:IR|NR)[0-9]{2})_Met$"
ANY_RUN_FOLDER = r"^[0-9]+_.*_Met$"
COVERAGE_FOLDER = "cov_dedup_probability"
CONTEXT_SUFFIXES = (".allc.tsv.gz", ".allc.tsv")
COVERAGE_SUFFIXES = (".cov.gz", ".cov")
STANDARD, FALLBACK = "standard", "rawp_fallback_no_null_dmrs"


def listing(spark: SparkSession, *patterns: str) -> DataFrame:
    """(path) of all files that match; contents are not read."""
    return spark.read.format("binaryFile").load(list(patterns)).select("path")


def _unique(files: DataFrame, by: list[str], what: str) -> DataFrame:
    """One row per name with its path; two paths are an error that states both."""
    rest = [c for c in files.columns if c not in (*by, "path")]
    grouped = files.groupBy(*by).agg(F.min_by(F.struct("path", *rest), "path").alias("first"), F.min("path").alias("low"), F.max("path").alias("high"))
    message = F.concat(F.lit(f"two files of one {what}: "), F.concat_ws(" ", *by), F.lit(": "), F.col("low"), F.lit(" and "), F.col("high"))
    path = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.raise_error(message).cast("string"))
    return grouped.select(*by, path.alias("path"), *[F.col(f"first.{c}").alias(c) for c in rest])


def _without(name: Column, suffixes: Sequence[str]) -> Column:
    return F.regexp_replace(name, "(?:" + "|".join(x.replace(".", r"\.") for x in suffixes) + ")$", "")


def context_index(paths: DataFrame) -> DataFrame:
    """(cell, path) of context files; the unpacked ones count only if there is no packed one at all."""
    name = base_name(F.col("path"))
    packed, plain = name.endswith(CONTEXT_SUFFIXES[0]), name.endswith(CONTEXT_SUFFIXES[1])
    files = paths.select("path", packed.alias("packed"), canonical_cell_id(_without(name, CONTEXT_SUFFIXES)).alias("cell")).where(packed | plain).distinct()
    any_packed = files.agg(F.coalesce(F.bool_or("packed"), F.lit(False)).alias("any_packed"))
    return _unique(files.join(F.broadcast(any_packed)).where("packed or not any_packed").select("cell", "path"), ["cell"], "cell")


def coverage_index(paths: DataFrame) -> DataFrame:
    """(cell, path) of ``<run>_<sample>_Met/cov_dedup_probability/<name>.cov[.gz]``; the name's own sample goes before the folder's.

    Other paths are left out; a run folder of another form than number, sample, Met is an error.
    """
    parts = F.split("path", "/")
    name, folder, run = F.element_at(parts, -1), F.get(parts, F.size(parts) - 2), F.get(parts, F.size(parts) - 3)
    ends = name.endswith(COVERAGE_SUFFIXES[0]) | name.endswith(COVERAGE_SUFFIXES[1])
    files = paths.where(ends & (folder == COVERAGE_FOLDER) & run.rlike(ANY_RUN_FOLDER)).distinct()
    sample = F.nullif(F.regexp_extract(run, RUN_FOLDER, 1), F.lit(""))
    sample = F.coalesce(sample, F.raise_error(F.concat(F.lit("no sample in "), F.col("path"))).cast("string"))
    own = canonical_cell_id(_without(name, COVERAGE_SUFFIXES))
    cell = F.when(own.rlike("^(?:IR|NR)[0-9]{2}__"), own).otherwise(canonical_cell_id(F.concat_ws("__", sample, own)))
    return _unique(files.select(F.when(sample.isNotNull(), cell).alias("cell"), "path"), ["cell"], "cell")


def record_files(paths: DataFrame, root: str, fallbacks: Sequence[str] = (), samples: Sequence[str] = ()) -> DataFrame:
    """(sample, left_type, right_type, path, source) of record files in any of the layouts.

    Below ``root``: ``<sample>_sample_celltype/``, no folder, or ``sample_celltype/``; and
    directly in a fallback folder. Files of other names or places are left out, as are
    samples that are not asked for. A file whose sample is not its folder's, and two files
    of one comparison, are errors.
    """
    name = F.substring_index("path", "/", -1)
    place = F.substr("path", F.lit(1), F.length("path") - F.length(name) - 1)
    last = F.substring_index(place, "/", -1)
    base = root.rstrip("/")
    in_sample_folder = (place == F.concat(F.lit(base + "/"), last)) & last.rlike(SAMPLE_FOLDER)
    standard = (place == base) | (place == f"{base}/{FLAT_FOLDER}") | in_sample_folder
    source = F.when(standard, F.concat(F.lit(f"{STANDARD}:"), F.substr("path", F.lit(len(base) + 2))))
    for fallback in (x.rstrip("/") for x in fallbacks):
        source = source.when(place == fallback, F.concat(F.lit(f"{FALLBACK}:"), name))
    parsed = [F.regexp_extract(name, RECORD_FILE, i).alias(c) for i, c in enumerate(("sample", "left_type", "right_type"), 1)]
    found = paths.select("path", source.alias("source"), F.when(in_sample_folder, last).alias("folder"), *parsed)
    found = found.where(F.col("source").isNotNull() & (F.col("sample") != ""))
    expected = F.nullif(F.regexp_extract("folder", SAMPLE_FOLDER, 1), F.lit(""))
    wrong = expected.isNotNull() & (expected != F.col("sample"))
    found = found.withColumn("path", F.when(wrong, F.raise_error(F.concat(F.lit("not a file of its folder's sample: "), F.col("path"))).cast("string")).otherwise(F.col("path")))
    if samples:
        found = found.where(F.col("sample").isin(*samples))
    return _unique(found.drop("folder"), ["sample", "left_type", "right_type"], "comparison")
