"""Half-open intervals: merge, join, subtract, consensus, bins.

Coordinates are 0-based, [start, end). Columns are chrom, start_pos, end_pos and any
grouping columns. Joins deal intervals out over fixed bins of the genome, so they are
hash joins on (chrom, bin) of any size, and a chromosome is many tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cytolith.session import spread

BIN = 1000
#: Genome block in which intervals are merged first, before what is left is merged per chromosome.
BLOCK = 1_000_000


def distinct_rows(tables: list[DataFrame], rows: int | None = None) -> DataFrame:
    """Distinct rows of tables of the same columns, dealt over as many tasks as they need; ``rows`` as in ``spread``."""
    both = reduce(DataFrame.unionByName, tables)
    return spread(both, *both.columns, rows=rows).distinct()


def _merge_once(df: DataFrame, keys: list[str], touching: bool, block: Column | None, sums: list[str], sets: list[str]) -> DataFrame:
    by = keys if block is None else [*keys, "__block"]
    df = df if block is None else df.withColumn("__block", block)
    order = Window.partitionBy(*by).orderBy("start_pos", "end_pos")
    reach = F.max("end_pos").over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.col("start_pos") > reach if touching else F.col("start_pos") >= reach
    island = F.sum(F.when(reach.isNull() | apart, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    aggregates = [F.sum(c).alias(c) for c in sums] + [F.array_distinct(F.flatten(F.collect_set(c))).alias(c) for c in sets]
    return (
        df.withColumn("__island", island)
        .groupBy(*by, "__island")
        .agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"), *aggregates)
        .drop("__island", "__block")
    )


def merge_intervals(df: DataFrame, by: list[str] | None = None, touching: bool = True, labels: list[str] | None = None) -> DataFrame:
    """Unions of overlapping intervals per group and chromosome: n_records and sorted label sets are kept.

    ``touching`` merges intervals that only meet; without it they stay apart. Blocks of
    the genome are merged first, so what is ordered per chromosome is already merged.
    """
    keys = [*(by or []), "chrom"]
    labels = labels or []
    rows = df.select(*keys, "start_pos", "end_pos", F.lit(1).cast("long").alias("n_records"), *[F.array(c).alias(c) for c in labels])
    local = _merge_once(rows, keys, touching, F.floor(F.col("start_pos") / BLOCK), ["n_records"], labels)
    merged = _merge_once(local, keys, touching, None, ["n_records"], labels)
    return merged.select(*keys, "start_pos", "end_pos", "n_records", *[F.array_sort(F.array_compact(c)).alias(c) for c in labels])


def _binned(df: DataFrame, size: int) -> DataFrame:
    last = F.greatest(F.col("end_pos") - 1, F.col("start_pos"))
    return df.withColumn("__bin", F.explode(F.sequence(F.floor(F.col("start_pos") / size), F.floor(last / size))))


def points_in_regions(points: DataFrame, regions: DataFrame, by: list[str] | None = None, size: int = BIN, position: str = "pos") -> DataFrame:
    """Points with the regions they lie in (start <= pos < end); a point is one row per region."""
    keys = [*(by or []), "chrom"]
    named = _binned(regions.withColumnsRenamed({"start_pos": "region_start", "end_pos": "region_end"}).withColumns({"start_pos": F.col("region_start"), "end_pos": F.col("region_end")}), size)
    named = named.drop("start_pos", "end_pos")
    located = points.withColumn("__bin", F.floor(F.col(position) / size))
    inside = (F.col(position) >= F.col("region_start")) & (F.col(position) < F.col("region_end"))
    return located.join(named, [*keys, "__bin"]).where(inside).drop("__bin")


def overlaps(left: DataFrame, right: DataFrame, by: list[str] | None = None, least_fraction: float | None = None, size: int = BIN) -> DataFrame:
    """Distinct intervals of ``left`` that some interval of ``right`` overlaps, by a fraction of the left one if given."""
    keys = [*(by or []), "chrom"]
    a = _binned(left.select(*keys, "start_pos", "end_pos").distinct(), size)
    b = _binned(right.select(*keys, "start_pos", "end_pos").distinct(), size).withColumnsRenamed({"start_pos": "other_start", "end_pos": "other_end"})
    shared = F.least("end_pos", "other_end") - F.greatest("start_pos", "other_start")
    enough = shared > 0 if least_fraction is None else (shared > 0) & (shared >= least_fraction * (F.col("end_pos") - F.col("start_pos")))
    once = F.floor(F.greatest("start_pos", "other_start") / size) == F.col("__bin")  # a pair counts in the bin where the later one starts
    return a.join(b, [*keys, "__bin"]).where(enough & once).select(*keys, "start_pos", "end_pos").distinct()


def keep_overlapping(left: DataFrame, right: DataFrame, by: list[str] | None = None, **options) -> DataFrame:
    """Rows of ``left`` that overlap (semi join)."""
    return left.join(overlaps(left, right, by, **options), [*(by or []), "chrom", "start_pos", "end_pos"], "left_semi")


def drop_overlapping(left: DataFrame, right: DataFrame, by: list[str] | None = None, **options) -> DataFrame:
    """Rows of ``left`` without overlap (anti join); with ``by``, only masks of the same group count."""
    return left.join(overlaps(left, right, by, **options), [*(by or []), "chrom", "start_pos", "end_pos"], "left_anti")


def consensus(df: DataFrame, label: str, required: list[str], by: list[str] | None = None) -> DataFrame:
    """Segments where every required label has an active interval, adjoining ones united.

    A label without intervals leaves nothing. Each label is merged first, so at most one
    of its intervals is active and a sweep over starts and ends counts active labels.
    """
    keys = [*(by or []), "chrom"]
    single = merge_intervals(df.where(F.col(label).isin(*required)), [*(by or []), label], True)
    events = single.select(*keys, F.col("start_pos").alias("at"), F.lit(1).alias("step")).unionByName(
        single.select(*keys, F.col("end_pos").alias("at"), F.lit(-1).alias("step"))
    )
    events = events.groupBy(*keys, "at").agg(F.sum("step").alias("step"))
    swept = _swept(events.withColumn("__block", F.floor(F.col("at") / BLOCK)), keys)
    return merge_intervals(swept.where((F.col("active") == len(set(required))) & F.col("end_pos").isNotNull()), by, True).drop("n_records")


def _swept(events: DataFrame, keys: list[str]) -> DataFrame:
    """Segments between neighbouring places (keys, at, step, __block) with what is active there.

    Blocks are swept side by side: each gets the sum of the blocks before it and the first place of the next one, and only blocks are ordered per chromosome.
    """
    blocks = events.groupBy(*keys, "__block").agg(F.sum("step").alias("__total"), F.min("at").alias("__first"))
    along = Window.partitionBy(*keys).orderBy("__block")
    before = F.coalesce(F.sum("__total").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select(*keys, "__block", before.alias("__before"), F.lead("__first").over(along).alias("__next"))
    order = Window.partitionBy(*keys, "__block").orderBy("at")
    end = F.coalesce(F.lead("at").over(order), F.col("__next"))
    return events.join(blocks, [*keys, "__block"]).select(*keys, F.col("at").alias("start_pos"), end.alias("end_pos"), (F.col("__before") + F.sum("step").over(order)).alias("active"))


def overlapping_pairs(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Intervals that start before the one before them ends; none in a table that may be searched by start.

    Intervals are ordered within blocks of the genome; the last one of a block stands before the first of the next.
    """
    keys = [*(by or []), "chrom"]
    rows = df.withColumn("__block", F.floor(F.col("start_pos") / BLOCK))
    last = rows.groupBy(*keys, "__block").agg(F.max(F.struct("start_pos", "end_pos")).alias("__last"))
    along = Window.partitionBy(*keys).orderBy("__block")
    last = last.select(*keys, "__block", F.lag("__last").over(along)["end_pos"].alias("__before"))
    order = Window.partitionBy(*keys, "__block").orderBy("start_pos", "end_pos")
    out = rows.join(last, [*keys, "__block"]).withColumn("previous_end", F.coalesce(F.lag("end_pos").over(order), F.col("__before")))
    return out.where("previous_end > start_pos").select(*df.columns, "previous_end")


def make_bins(sizes: DataFrame, size: int) -> DataFrame:
    """Whole bins of chromosomes (chrom, length); what is left at the end is no bin."""
    n = F.floor(F.col("length") / size)
    bins = sizes.where(n > 0).select("chrom", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("bin"))
    return bins.select("chrom", "bin", (F.col("bin") * size).alias("start_pos"), ((F.col("bin") + 1) * size).alias("end_pos"))
