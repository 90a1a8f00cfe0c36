"""Identifier rules as column expressions; each rule is its own, they differ on purpose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes of the input files.
SUFFIXES = (".cov.gz", ".cov", ".allc.gz")
# Patterns of sample and cell names.
NAMED_CELL = r"^(?:25110891_)?((?:IR|NR)[0-9]{2})(?:_Met)?(?:__|_|-)(.+)$"
UNNAMED_CELL = r"^([^-_]+)-"


def canonical_cell_id(cell: Column) -> Column:
    """``sample__barcode``; names without a sample have their first dash replaced if it follows something without an underscore.

    White space around the name does not count.
    """
    cell = F.trim(cell)
    joined = F.concat(F.regexp_extract(cell, NAMED_CELL, 1), F.lit("__"), F.regexp_extract(cell, NAMED_CELL, 2))
    return F.when(cell.rlike(NAMED_CELL), joined).otherwise(F.regexp_replace(cell, UNNAMED_CELL, "$1_"))


def infer_sample_id(cell: Column, pattern: str = r"^((?:IR|NR)[0-9]{2})__") -> Column:
    """The sample in a canonical identifier, else ``Unknown``."""
    found = F.regexp_extract(canonical_cell_id(cell), pattern, 1)
    return F.when(found == "", "Unknown").otherwise(found)


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def normalize_cell(cell: Column, sample: Column, short: Column, repeated: bool = True) -> Column:
    """Base name without one suffix and without sample names and underscores in front, stripped again and again or once."""
    ends = "|".join(x.replace(".", r"\.") for x in SUFFIXES)
    name = F.regexp_replace(base_name(F.trim(cell)), f"(?:{ends})$", "")
    quoted = [F.concat(F.lit("\\Q"), x, F.lit("\\E"), F.lit(line)) for x in (sample, short) for line in ("__", "_")]
    prefix = F.concat(F.lit("^(?:"), F.concat_ws("|", *quoted), F.lit(")++" if repeated else ")"))
    return F.regexp_replace(name, prefix, F.lit(""))


def short_sample(name: Column) -> Column:
    """``IR`` or ``NR`` and two digits, between underscores or at the start; anything else is an error."""
    name = F.trim(name)
    inside = F.regexp_extract(name, r"(?:^|_)((?:IR|NR)[0-9]{2})(?:_|$)", 1)
    start = F.regexp_extract(name, r"^((?:IR|NR)[0-9]{2})", 1)
    return F.when(inside != "", inside).when(start != "", start).otherwise(F.raise_error(F.concat(F.lit("no sample in "), name)).cast("string"))


def response_of(sample: Column) -> Column:
    return F.regexp_replace(sample, "[0-9]+$", "")


def sanitize_label(label: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(label, "[^A-Za-z0-9._-]+", "_"), "^_+|_+$", "")
