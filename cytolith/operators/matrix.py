"""Cell-by-feature values in long form, nulls left out: scores, types, display bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def zscore(df: DataFrame, by: list[str], value: str = "value", least: int = 30, clip: float | None = None) -> DataFrame:
    """Population z-score per group; null in groups of fewer values than ``least`` or without spread.

    Moments are aggregated first and joined back, so a large group is not one task.
    """
    moments = df.groupBy(*by).agg(F.count(value).alias("__n"), F.avg(value).alias("__mean"), F.stddev_pop(value).alias("__sd"), F.min(value).alias("__low"), F.max(value).alias("__high"))
    spread = (F.col("__n") >= least) & (F.col("__sd") > 0) & (F.col("__high") > F.col("__low"))
    z = F.when(spread, (F.col(value) - F.col("__mean")) / F.col("__sd"))
    if clip is not None:
        z = F.when(z.isNotNull(), F.greatest(F.least(z, F.lit(clip)), F.lit(-clip)))
    return df.join(moments, by).withColumn("z", z).drop("__n", "__mean", "__sd", "__low", "__high")


def maxabs_scale(df: DataFrame, by: list[str], value: str = "z") -> DataFrame:
    """Values over the largest absolute value of their group; unchanged where that is 0 or null."""
    scale = df.groupBy(*by).agg(F.max(F.abs(value)).alias("__scale"))
    return df.join(scale, by).withColumn("scaled", F.when(F.col("__scale") > 0, F.col(value) / F.col("__scale")).otherwise(F.col(value))).drop("__scale")


def group_means(df: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    return df.groupBy(*by).agg(F.avg(value).alias("mean_value"), F.count(value).alias("n_values"))


def feature_qc(df: DataFrame, feature: list[str], value: str = "value") -> DataFrame:
    """Values, and whether a feature is all null, without variance, or retained."""
    out = df.groupBy(*feature).agg(F.count(value).alias("n_values"), F.min(value).alias("__low"), F.max(value).alias("__high"))
    flat = (F.col("n_values") < 2) | (F.col("__low") == F.col("__high"))
    flat = F.coalesce(flat, F.lit(True))
    return out.select(*feature, "n_values", (F.col("n_values") == 0).alias("all_null"), flat.alias("zero_variance"), (~flat).alias("retained"))


def assign_region_type(means: DataFrame, supporters: DataFrame, region: list[str], tolerance: float = 1e-12, known: list[str] | None = None) -> DataFrame:
    """The type of each region among those that support it.

    A single supporter wins even without a value; of several, the one with the lowest
    observed mean does, unless another is as low within the tolerance. A region without
    supporters, or with none of the ``known`` types among them, is there as well, without a
    type. The hypo difference is the lowest mean of all other types less that of the winner.
    """
    listed = (supporters if known is None else supporters.where(F.col("cell_type").isin(known))).groupBy(*region).agg(F.array_sort(F.collect_set("cell_type")).alias("types"))
    seen = means.groupBy(*region).agg(F.collect_list(F.struct(F.col("mean_value").alias("m"), F.col("cell_type").alias("t"))).alias("means"))  # a row per type
    every = means.select(*region).unionByName(supporters.select(*region)).distinct()
    both = every.join(listed, region, "left").join(seen, region, "left").withColumn("types", F.coalesce("types", F.array().cast("array<string>")))
    observed = F.filter(F.coalesce("means", F.array().cast("array<struct<m:double,t:string>>")), lambda x: x["m"].isNotNull())
    own = F.array_sort(F.filter(observed, lambda x: F.array_contains("types", x["t"])))
    low = F.get(own, F.lit(0))["m"]
    ties = F.size(F.filter(own, lambda x: x["m"] <= low + tolerance))
    n = F.size("types")
    winner = F.when(n == 1, F.get("types", F.lit(0))).when(ties == 1, F.get(own, F.lit(0))["t"])
    rule = F.when(n == 0, "unsupported").when(n == 1, "single").when(F.size(own) == 0, "unobserved").when(ties > 1, "tie").otherwise("lowest")
    picked = both.select(*region, F.coalesce(winner, F.lit("Unresolved")).alias("cell_type"), rule.alias("rule"), observed.alias("seen"))
    mine = F.get(F.filter("seen", lambda x: x["t"] == F.col("cell_type")), F.lit(0))["m"]
    others = F.array_min(F.transform(F.filter("seen", lambda x: x["t"] != F.col("cell_type")), lambda x: x["m"]))
    return picked.select(*region, "cell_type", "rule", (others - mine).alias("hypo_difference"))


def allocate_bins(counts: DataFrame, bins: int, by: list[str] | None = None) -> DataFrame:
    """Display bins per group (group, n, nth): its size if all fit, else at least one and shares by largest remainder.

    ``nth`` is the order in which equal remainders are served. Too few bins for the
    nonempty groups are an error.
    """
    whole = Window.partitionBy(*(by or [F.lit(1)]))
    total = F.sum("n").over(whole)
    filled = F.count_if(F.col("n") > 0).over(whole)
    spare = F.lit(bins) - filled
    weighed = counts.withColumns({"total": total, "filled": filled, "spare": spare})
    exact = F.when(F.col("n") > 0, F.col("spare") * F.col("n") / F.col("total")).otherwise(0.0)
    shared = weighed.withColumn("exact", exact).withColumn("base", F.floor("exact"))
    shared = shared.withColumn("left", F.col("spare") - F.sum("base").over(whole))
    order = Window.partitionBy(*(by or [F.lit(1)])).orderBy(F.desc(F.round(F.col("exact") - F.col("base"), 9)), "nth")
    shared = shared.withColumn("served", F.row_number().over(order))
    some = F.when(F.col("n") == 0, 0).otherwise(1 + F.col("base") + F.when(F.col("served") <= F.col("left"), 1).otherwise(0))
    n_bins = F.when(F.col("total") <= bins, F.col("n")).when(F.col("filled") > bins, F.raise_error(F.lit("fewer bins than groups")).cast("long")).otherwise(some)
    return shared.select(*(by or []), "group", "n", n_bins.cast("long").alias("n_bins"))


def display_bin(index: Column, n_bins: Column, n: Column) -> Column:
    """The bin of the index-th of n rows: index * bins div n, the last bin at most."""
    return F.least(n_bins - 1, F.floor(index * n_bins / n))


def label_runs(df: DataFrame, by: list[str], order: str, label: str, block: int = 1 << 20) -> DataFrame:
    """First and last place of each run of equal labels, in order of a whole number that is unique within ``by``.

    Runs are found within blocks of that number, and joined where they meet; only one row per block is ordered as a whole.
    """
    keys = [*by, "__block"]
    rows = Window.partitionBy(*keys).orderBy(order)
    new = F.coalesce(~F.lag(label).over(rows).eqNullSafe(F.col(label)) | (F.row_number().over(rows) == 1), F.lit(True)).cast("int")
    marked = df.withColumn("__block", F.floor(F.col(order) / block)).withColumn("new", new).withColumn("run", F.sum("new").over(rows))
    runs = marked.groupBy(*keys, "run", label).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n"))
    blocks = runs.groupBy(*keys).agg(F.max("run").alias("runs"), F.min_by(F.struct(label), "run").alias("opens"), F.max_by(F.struct(label), "run").alias("ends"))
    in_order = Window.partitionBy(*by).orderBy("__block")
    joins = F.coalesce(F.lag("ends").over(in_order).eqNullSafe(F.col("opens")), F.lit(False)).cast("int")
    blocks = blocks.withColumn("joins", joins).withColumn("before", F.sum(F.col("runs") - F.col("joins")).over(in_order) - F.col("runs"))
    placed = runs.join(blocks.select(*keys, "before"), keys).withColumn("run", F.col("run") + F.col("before"))
    return placed.groupBy(*by, "run", label).agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"))


def to_long(df: DataFrame, ids: list[str]) -> DataFrame:
    """A wide matrix as (ids, cell, value), without nulls."""
    return df.unpivot(ids, [c for c in df.columns if c not in ids], "cell", "value").where("value is not null")
