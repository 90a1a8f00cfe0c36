"""Cell metadata: overlays, exclusion, status, sets, checks, contingency tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def annotate_left(cells: DataFrame, annotation: DataFrame, on: list[str]) -> DataFrame:
    """All cells with their annotation; missing_annotation marks those without."""
    marked = annotation.withColumn("__there", F.lit(True))
    joined = cells.join(marked, on, "left")
    return joined.withColumn("missing_annotation", F.col("__there").isNull()).drop("__there")


def overlay(default: Column, *updates: Column) -> Column:
    """The last update that is neither null nor empty, else the default."""
    return F.coalesce(*[F.nullif(F.trim(u), F.lit("")) for u in reversed(updates)], default)


def exclusion_reason(missing: Column, annotation: Column, celltype: Column) -> Column:
    reasons = (F.when(flag, word) for flag, word in ((missing, "missing"), (annotation, "annotation"), (celltype, "celltype")))
    return F.concat_ws(";", *reasons)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def conflicting_values(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Keys with several values of a column; null is a value."""
    values = F.count_distinct(F.struct(F.col(column).isNull(), F.col(column)))
    return df.groupBy(*keys).agg(values.alias("n_values")).where("n_values > 1")


def cell_status(reference: DataFrame, current: DataFrame, clean: DataFrame, key: str) -> DataFrame:
    """Each reference cell is retained, removed by the clean list, or removed by quality control."""
    flags = reference.select(key).join(current.select(key, F.lit(True).alias("in_current")), key, "left").join(clean.select(key, F.lit(True).alias("in_clean")), key, "left")
    status = F.when(F.col("in_current"), "retained").when(F.col("in_clean").isNull(), "clean_list_removed").otherwise("qc_removed")
    wrong = F.col("in_current") & F.col("in_clean").isNull()
    return flags.select(key, F.when(wrong, F.raise_error(F.lit("a current cell is not in the clean list")).cast("string")).otherwise(status).alias("status"))


def set_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of one side only, with the side."""
    return (
        left.select(key).distinct().join(right.select(key), key, "left_anti").withColumn("side", F.lit("left"))
        .unionByName(right.select(key).distinct().join(left.select(key), key, "left_anti").withColumn("side", F.lit("right")))
    )


def cardinality(df: DataFrame, key: str, expected: int, sample: str) -> DataFrame:
    """Rows, distinct keys and samples against what is expected."""
    out = df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(key).alias("n_keys"), F.count_distinct(sample).alias("n_samples"))
    return out.withColumn("holds", (F.col("n_rows") == F.col("n_keys")) & (F.col("n_rows") == expected))


def qc_bin(value: Column, low: float, high: float) -> Column:
    return F.when(value < low, "below").when(value <= high, "within").otherwise("above")


BIN_LEVELS = ("below", "within", "above")


def contingency(df: DataFrame, row: str, rows: tuple[str, ...], column: str, columns: tuple[str, ...], by: list[str] | None = None) -> DataFrame:
    """Counts of all levels, zeros included, with row totals and row percentages (0 for empty rows)."""
    by = by or []
    counts = df.groupBy(*by, row).pivot(column, list(columns)).agg(F.count(F.lit(1)))
    levels = df.sparkSession.createDataFrame([(r,) for r in rows], f"{row} string")  # a row per level
    grid = levels if not by else df.select(*by).distinct().withColumn(row, F.explode(F.array(*[F.lit(r) for r in rows])))
    filled = grid.join(counts, [*by, row], "left").na.fill(0, list(columns))
    total = sum((F.col(c) for c in columns), F.lit(0))
    percents = [F.when(F.col("total") > 0, F.col(c) * 100 / F.col("total")).otherwise(0.0).alias(f"{c}_percent") for c in columns]
    return filled.withColumn("total", total).select(*by, row, *columns, "total", *percents)


def crosstab(df: DataFrame, row: str, column: str, columns: list[str]) -> DataFrame:
    return df.groupBy(row).pivot(column, columns).agg(F.count(F.lit(1))).na.fill(0)


def shares(df: DataFrame, group: str, label: str) -> DataFrame:
    """Counts of labels within groups and their share of the group."""
    counts = df.groupBy(group, label).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(group)))


def value_counts(df: DataFrame, label: str) -> DataFrame:
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))


def quantile_summary(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """n, mean, sample deviation and exact quartiles per group."""
    q = {"q25": 0.25, "median": 0.5, "q75": 0.75}
    return df.groupBy(*by).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("low"), F.max(value).alias("high"),
        *[F.percentile(value, p).alias(name) for name, p in q.items()],
    )


def before_after(df: DataFrame, keys: list[str], stage: str, metrics: list[str]) -> DataFrame:
    """Change of each metric between the stages before and after; a missing side is an error."""
    sides = df.groupBy(*keys).agg(*[F.max(F.when(F.col(stage) == s, F.col(m))).alias(f"{m}_{s}") for m in metrics for s in ("before", "after")], F.count_distinct(stage).alias("__n"))
    checked = F.when(F.col("__n") < 2, F.raise_error(F.lit("a pair lacks a stage")).cast("double"))
    return sides.select(*keys, *[F.coalesce(checked, F.col(f"{m}_after") - F.col(f"{m}_before")).alias(f"{m}_delta") for m in metrics])


def target_codes(df: DataFrame, label: str, unlabeled: tuple[str, ...] = ("", "unknown", "unannotated", "nan")) -> DataFrame:
    """Labels as 0..k-1 in sorted order, -1 where there is none; the label table is small and joined back."""
    known = F.when(~F.lower(F.trim(F.col(label))).isin(*unlabeled), F.trim(F.col(label)))
    names = df.select(known.alias("__label")).where("__label is not null").distinct()
    codes = names.withColumn("code", F.row_number().over(Window.orderBy("__label")) - 1)
    return df.withColumn("__label", known).join(codes, "__label", "left").withColumn("code", F.coalesce("code", F.lit(-1))).drop("__label")


def derive_group(sample: Column, groups: tuple[str, ...] = ("IR", "NR")) -> Column:
    """The group a sample name starts with; other names are an error."""
    found = F.lit(None).cast("string")
    for group in groups:
        found = F.when(sample.startswith(group), group).otherwise(found)
    return F.coalesce(found, F.raise_error(F.concat(F.lit("no group for "), sample)).cast("string"))


def validate_metadata(df: DataFrame, sample: str, group: str, groups: tuple[str, ...]) -> DataFrame:
    """Trimmed, upper-cased samples and groups, with a flag for rows that are empty, repeated or of an unknown group."""
    clean = df.select(F.trim(sample).alias("sample_id"), F.upper(F.trim(group)).alias("condition"))
    n = clean.groupBy("sample_id").agg(F.count(F.lit(1)).alias("__n"))
    valid = (F.col("sample_id") != "") & F.col("condition").isin(*groups) & (F.col("__n") == 1)
    return clean.join(n, "sample_id", "left").select("sample_id", "condition", F.coalesce(valid, F.lit(False)).alias("valid"))


def json_value(text: Column, path: str, default: str) -> Column:
    """A value of a JSON text, or the default where it is missing."""
    return F.coalesce(F.get_json_object(text, path), F.lit(default))


def full_outer(left: DataFrame, right: DataFrame, keys: list[str], defaults: dict[str, str]) -> DataFrame:
    """Rows of either side, with defaults for columns that a side lacks."""
    return left.join(right, keys, "full").withColumns({c: F.coalesce(c, F.lit(value)) for c, value in defaults.items()})


def plot_order(df: DataFrame, label: str, index: str) -> DataFrame:
    """Places of rows by label, whatever its case, then by their own order.

    Rows are numbered within labels; only the table of labels is ordered as a whole.
    """
    name = F.coalesce(F.lower(label), F.lit(""))
    sizes = df.groupBy(name.alias("__name")).agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(F.lit(1)).orderBy("__name").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("__name", F.coalesce(before, F.lit(0)).alias("__start"))
    own = F.row_number().over(Window.partitionBy("__name").orderBy(index)) - 1
    numbered = df.withColumn("__name", name).withColumn("__own", own).join(starts, "__name", "left")
    return numbered.withColumn("place", F.coalesce("__start", F.lit(0)) + F.col("__own")).drop("__name", "__own", "__start")


def keep_features(df: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Values of the wanted features; a wanted feature without any value is an error."""
    missing = wanted.select(key).distinct().join(df.select(key), key, "left_anti")
    checked = missing.select(F.raise_error(F.concat(F.lit("no feature "), F.col(key))).cast("string").alias(key))
    return df.join(wanted.select(key).distinct(), key, "left_semi").unionByName(checked, allowMissingColumns=True)


def count_kind(largest: Column) -> Column:
    """The narrowest unsigned kind that holds the largest count; counts are never clipped."""
    return F.when(largest <= 65_535, "uint16").when(largest <= 4_294_967_295, "uint32").otherwise("uint64")


def match_statistics(cells: DataFrame, annotation: DataFrame, key: str, label: str, excluded: str) -> DataFrame:
    """One row: how many selected cells an annotation knows, by count and share, how many have a label, are excluded, are retained.

    Repeated rows of a key in the annotation count as one match; an excluded flag that is null is false.
    """
    known = annotation.groupBy(key).agg(F.max(label).alias("__label"), F.max(F.coalesce(excluded, F.lit(False))).alias("__out")).withColumn("__there", F.lit(True))
    joined = cells.select(key).join(known, key, "left")
    there, out = F.coalesce("__there", F.lit(False)), F.coalesce("__out", F.lit(False))
    found = joined.agg(
        F.count(F.lit(1)).alias("n_cells"),
        F.count_if(there).alias("n_matched"),
        F.count_if(~there).alias("n_unmatched"),
        F.avg(there.cast("double")).alias("match_rate"),
        F.count_if(there & F.col("__label").isNotNull()).alias("n_labelled"),
        F.count_if(out).alias("n_excluded"),
        F.count_if(there & ~out).alias("n_retained"),
    )
    rows = annotation.agg(F.count(F.lit(1)).alias("annotation_rows"))
    return found.join(F.broadcast(rows))


def annotation_counts(cells: DataFrame, annotation: DataFrame, metadata: DataFrame, key: str = "cell_no", label: str = "cell_type", sample: str = "sample", condition: str = "condition") -> DataFrame:
    """(kind, name, n): selected cells per label and per condition, and how many have an unknown sample or condition, distinct samples and metadata rows.

    The label comes from ``annotation`` (one per key, the largest), the condition of a sample from
    ``metadata``. Fixed words stand where nothing is known: Unannotated for the label, Unknown for sample and condition.
    """
    known = annotation.groupBy(key).agg(F.max(label).alias("__label"))
    conditions = metadata.groupBy(sample).agg(F.max(condition).alias("__condition"))
    joined = cells.select(key, F.coalesce(F.col(sample), F.lit("Unknown")).alias(sample)).join(known, key, "left").join(conditions, sample, "left")
    rows = joined.select(sample, F.coalesce("__label", F.lit("Unannotated")).alias("label"), F.coalesce("__condition", F.lit("Unknown")).alias("condition"))
    n = F.count(F.lit(1)).alias("n")
    per = [rows.groupBy(F.col(c).alias("name")).agg(n).select(F.lit(kind).alias("kind"), "name", "n") for kind, c in (("cell_type", "label"), ("condition", "condition"))]
    totals = rows.agg(
        F.count_if(F.col(sample) == "Unknown").alias("unknown_sample"), F.count_if(F.col("condition") == "Unknown").alias("unknown_condition"), F.count_distinct(sample).alias("samples")
    ).unpivot([], ["unknown_sample", "unknown_condition", "samples"], "name", "n")
    listed = metadata.agg(F.count(F.lit(1)).alias("n")).select(F.lit("total").alias("kind"), F.lit("metadata_rows").alias("name"), "n")
    return per[0].unionByName(per[1]).unionByName(totals.select(F.lit("total").alias("kind"), "name", "n")).unionByName(listed)


def complete_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join in which every row of ``left`` has exactly one partner; rows without one, or with several, are an error."""
    counted = right.join(right.groupBy(key).agg(F.count(F.lit(1)).alias("__n")), key)
    joined = left.join(counted, key, "left")
    n = F.coalesce("__n", F.lit(0))
    wrong = F.raise_error(F.concat(F.lit(f"{key} "), F.col(key).cast("string"), F.lit(" has "), n.cast("string"), F.lit(" partners")))
    # the check is in the key itself, so no plan can do without it
    return joined.withColumn(key, F.when(n == 1, F.col(key)).otherwise(wrong.cast(left.schema[key].dataType))).drop("__n")


def relabel_status(flag: Column) -> Column:
    """Exclude where the flag holds, else Keep; null is false."""
    return F.when(F.coalesce(flag, F.lit(False)), "Exclude").otherwise("Keep")


def annotate_clusters(cells: DataFrame, names: dict[str, str], cluster: str, excluded: tuple[str, ...]) -> DataFrame:
    """Cells with the name of their cluster (``Unknown`` if it has none), whether the main analysis leaves it out, and the status in words."""
    pairs = [F.lit(x) for pair in names.items() for x in pair]
    name = F.coalesce(F.element_at(F.create_map(*pairs), F.col(cluster).cast("string")), F.lit("Unknown"))
    named = cells.withColumn("cell_type", name).withColumn("excluded", F.col("cell_type").isin(*excluded))
    return named.withColumn("status", relabel_status(F.col("excluded")))


def stage_counts(df: DataFrame, by: list[str], status: str, kinds: tuple[str, ...]) -> DataFrame:
    """Rows per group and status, and whether all are done; a status that is none of ``kinds`` is counted as other."""
    counts = [F.count_if(F.col(status) == kind).alias(kind) for kind in kinds]
    other = F.count_if(F.col(status).isNull() | ~F.col(status).isin(*kinds)).alias("other")
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *counts, other).withColumn("all_done", F.col("n") == F.col(kinds[0]))


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Rows in an order that depends on the seed and the key alone, whatever the partitions; ``place`` is what they are ordered by."""
    return df.withColumn("place", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))).orderBy("place", key)


def dense_size(n_rows: Column, n_columns: Column, bytes_each: int = 4) -> Column:
    """GiB of a dense matrix, to two digits."""
    return F.round(n_rows.cast("double") * n_columns.cast("double") * bytes_each / 2**30, 2)
