"""Checks that end a job with an error which names what is wrong. Each runs a job of its own unless its docstring says otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHOWN = 5


def in_range(name: str, value: float | None, low: float | None = None, high: float | None = None) -> None:
    """A setting within its bounds, both included; None is no setting. Runs nothing."""
    if value is not None and ((low is not None and value < low) or (high is not None and value > high)):
        raise ValueError(f"{name} = {value} is not within {'-inf' if low is None else low} and {'inf' if high is None else high}")


def ordered(name_low: str, low: float | None, name_high: str, high: float | None) -> None:
    """Two settings, the first not above the second. Runs nothing."""
    if low is not None and high is not None and low > high:
        raise ValueError(f"{name_low} = {low} is above {name_high} = {high}")


def _fail(bad: DataFrame, message: str) -> None:
    found = bad.limit(SHOWN).collect()
    if found:
        raise ValueError(f"{message}: " + "; ".join(", ".join(f"{k}={v}" for k, v in row.asDict().items()) for row in found))


def valid_counts(sites: DataFrame, at: list[str]) -> DataFrame:
    """``sites`` whose counts stop the job that reads them if they are missing, negative or both zero; ``at`` names the row in the error. Lazy."""
    place = F.concat_ws(", ", *[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in at])
    good = F.coalesce((F.col("mc") >= 0) & (F.col("uc") >= 0) & (F.col("mc") + F.col("uc") > 0), F.lit(False))

    def checked(column: str) -> Column:
        kind = sites.schema[column].dataType
        return F.when(good, F.col(column)).otherwise(F.raise_error(F.concat(F.lit("no valid counts at "), place)).cast(kind))

    return sites.withColumns({"mc": checked("mc"), "uc": checked("uc")})


def whole_numbers(lines: DataFrame, columns: list[str], at: list[str]) -> DataFrame:
    """``lines`` with text columns as whole numbers; any other text stops the job that reads it. Lazy."""
    place = F.concat_ws(", ", *[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in at])

    def number(column: str) -> Column:
        text = F.trim(F.col(column).cast("string"))
        good = F.coalesce(text.rlike("^[+-]?[0-9]{1,18}$"), F.lit(False))
        return F.when(good, text.try_cast("long")).otherwise(F.raise_error(F.concat(F.lit(f"{column} is no whole number at "), place)).cast("long"))

    return lines.withColumns({c: number(c) for c in columns})


def covered_cells(levels: DataFrame, cells: DataFrame, key: list[str]) -> None:
    """Every cell of ``cells`` has a row in ``levels`` with a site and coverage."""
    there = levels.where("n_sites > 0 and total_coverage > 0").select(*key)
    _fail(cells.select(*key).distinct().join(there, key, "left_anti"), "no usable site in")


def unique(df: DataFrame, key: list[str]) -> None:
    repeated = df.groupBy(*key).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    _fail(repeated, f"{', '.join(key)} is not unique")


def expected_counts(df: DataFrame, label: str, expected: dict[str, int], total: int | None = None) -> None:
    """Rows per label, and of all labels, as expected; labels that are not named may have any number."""
    named = df.select(F.col(label).cast("string").alias("label")).where(F.col("label").isin(list(expected)))
    found = {r["label"]: r["n"] for r in named.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    wrong = [f"{k}: {found.get(k, 0)} instead of {n}" for k, n in expected.items() if found.get(k, 0) != n]
    if total is not None and (n := df.count()) != total:
        wrong.append(f"all: {n} instead of {total}")
    if wrong:
        raise ValueError(f"{label} counts differ: {'; '.join(wrong)}")


def same_cells(source: DataFrame, table: DataFrame, key: str, expected: int | None = None) -> int:
    """Source, table and the distinct keys of both are equally many, not none, the same, and as many as expected; the number is returned."""
    n_source, n_table, n_unique = source.count(), table.count(), table.select(key).distinct().count()
    if n_source == 0 or n_source != n_table or n_table != n_unique:
        raise ValueError(f"source={n_source} table={n_table} unique={n_unique} do not agree")
    _fail(source.select(key).distinct().join(table.select(key), key, "left_anti"), "not in the table")
    if expected is not None and n_table != expected:
        raise ValueError(f"{n_table} cells instead of {expected}")
    return n_table
