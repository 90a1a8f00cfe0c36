"""Order statistics and running totals over whole tables, without a task that sees all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cytolith.session import kept


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def running(df: DataFrame, order: str, sums: Sequence[str] = (), least: Sequence[str] = (), descending: bool = False) -> DataFrame:
    """``df`` with ``sum_<c>`` and ``least_<c>`` over all rows up to each one in the order of a column without repeats.

    Ranges of the order are dealt over tasks; each adds up its own rows and the totals of
    the ranges before it, of which there is one row per task. Runs a job.
    """
    spark = df.sparkSession
    part = unused(df, "part")
    by = F.col(order).desc() if descending else F.col(order).asc()
    dealt = kept(df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), by).withColumn(part, F.spark_partition_id()))
    totals = dealt.groupBy(part).agg(F.count(F.lit(1)).alias("__n"), *[F.sum(c).alias(f"__sum_{c}") for c in sums], *[F.min(c).alias(f"__least_{c}") for c in least])
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(part, *[F.sum(f"__sum_{c}").over(before).alias(f"__sum_{c}") for c in sums], *[F.min(f"__least_{c}").over(before).alias(f"__least_{c}") for c in least])
    within = Window.partitionBy(part).orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    found = [(F.coalesce(F.sum(c).over(within), F.lit(0)) + F.coalesce(F.col(f"__sum_{c}"), F.lit(0))).alias(f"sum_{c}") for c in sums]
    found += [F.least(F.min(c).over(within), F.col(f"__least_{c}")).alias(f"least_{c}") for c in least]
    return dealt.join(F.broadcast(carried), part).select(*df.columns, *found)


def kth_largest(df: DataFrame, column: str, k: int, bins: int = 4096, small: int = 10_000) -> float:
    """The kth largest value of a column (nulls and NaN left out), exactly.

    Values are counted in ``bins`` of equal width; the one bin that holds the kth is cut
    again until no more than ``small`` values are left, or they are all alike. Runs jobs.
    """
    values = kept(df.select(F.col(column).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v")))
    n, low, high = values.agg(F.count("v"), F.min("v"), F.max("v")).first()
    if not 1 <= k <= n:
        raise ValueError(f"there is no {k}th of {n} values")
    while n > small and low < high:
        width = high / bins - low / bins
        if not width > 0:
            break
        number = F.least(F.floor((F.col("v") - low) / width), F.lit(bins - 1))
        counts = sorted(((r[0], r[1]) for r in values.groupBy(number).count().collect()), reverse=True)
        for found, held in counts:
            if k <= held:
                break
            k -= held
        values = values.where(number == found)
        before, (n, low, high) = n, values.agg(F.count("v"), F.min("v"), F.max("v")).first()
        if n == before:
            break
    if low == high:
        return float(low)
    for value, held in values.groupBy("v").count().orderBy(F.desc("v")).toLocalIterator():
        if k <= held:
            return float(value)
        k -= held
    raise AssertionError("the values changed while they were counted")
