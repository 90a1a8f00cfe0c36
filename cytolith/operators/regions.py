"""Differential regions: standard form, filters, best and top records, summaries, comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cytolith.functions.labels import is_primary
from cytolith.operators.checks import in_range

PLACE = ["chrom", "start_pos", "end_pos"]
# Status words of a subtraction.
NOT_READ, NONE_PASSED = "no_pairwise_input", "input_present_no_DMR_passed"


def difference() -> Column:
    return F.abs(F.col("meth_a") - F.col("meth_b"))


def valid_record() -> Column:
    """Coordinates in order, finite fractions and p, a known lower group."""
    return F.coalesce(
        (F.col("start_pos") >= 0) & (F.col("end_pos") > F.col("start_pos")) & ~F.isnan("meth_a") & ~F.isnan("meth_b") & (F.col("raw_p") >= 0) & F.col("lower_group").isin("group_A", "group_B"),
        F.lit(False),
    )


def validate_records(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), F.bool_and(valid_record()).alias("valid"))


def standardize(df: DataFrame) -> DataFrame:
    """Name the lower side of each record first: hypo_type, other_type and their fractions."""
    b_lower = F.col("lower_group") == "group_B"
    hypo, other = F.when(b_lower, F.col("meth_b")).otherwise(F.col("meth_a")), F.when(b_lower, F.col("meth_a")).otherwise(F.col("meth_b"))
    return df.select(
        "sample",
        F.when(b_lower, F.col("right_type")).otherwise(F.col("left_type")).alias("hypo_type"),
        F.when(b_lower, F.col("left_type")).otherwise(F.col("right_type")).alias("other_type"),
        *PLACE,
        hypo.alias("hypo_mean"),
        other.alias("other_mean"),
        F.abs(hypo - other).alias("diff"),
        (hypo < other).alias("consistent"),
        "raw_p",
        "line_no",
    )


def select_hypo(df: DataFrame, raw_p: float = 0.01, least: float = 0.25) -> DataFrame:
    """p below the limit (strictly), difference at least ``least``, on a primary chromosome."""
    in_range("raw_p", raw_p, 0, 1)
    in_range("least", least, 0, 1)
    return df.where((F.col("raw_p") < raw_p) & (difference() >= least) & is_primary(F.col("chrom")))


def select_response(df: DataFrame, p: float = 0.05, above: float = 0.3) -> DataFrame:
    """p and difference both strictly beyond their limits."""
    in_range("p", p, 0, 1)
    in_range("above", above, 0, 1)
    return df.where((F.col("raw_p") < p) & (difference() > above))


def response_summary(df: DataFrame, by: list[str], p: float = 0.05, above: float = 0.3) -> DataFrame:
    passes = F.col("raw_p") < p
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.count_if(passes).alias("p_pass"), F.count_if(passes & (difference() > above)).alias("selected"))


def select_q(df: DataFrame, column: str, q: float = 0.05) -> DataFrame:
    """q below the limit on primary chromosomes; a q that is no number counts as 0."""
    in_range("q", q, 0, 1)
    return df.where((F.coalesce(F.col(column).try_cast("double"), F.lit(0.0)) < q) & is_primary(F.col("chrom")))


def best_per_interval(standard: DataFrame) -> DataFrame:
    """The best record of each sample, type and interval: difference, p, other type, line."""
    keys = ["sample", "hypo_type", *PLACE]
    rest = [c for c in standard.columns if c not in keys]
    order = [F.col("diff").isNull(), -F.col("diff"), F.col("raw_p"), F.lower("other_type"), F.col("line_no")]
    first = F.min(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.struct(*rest).alias("row")))
    return standard.groupBy(*keys).agg(first.alias("first")).select(*keys, "first.row.*").select(*standard.columns)


def top_intervals(standard: DataFrame, n: int) -> DataFrame:
    """All records of the n best intervals of each sample and type.

    Intervals rank by their best difference and the p of it. Ranks are taken over
    intervals, after records are reduced to one per interval by a partial aggregate.
    """
    in_range("n", n, 1)
    best = standard.groupBy("sample", "hypo_type", *PLACE).agg(F.min(F.struct((-F.col("diff")).alias("d"), F.col("raw_p").alias("p"))).alias("best"))
    order = Window.partitionBy("sample", "hypo_type").orderBy("best.d", "best.p", "chrom", "start_pos", "end_pos")
    kept = best.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= n).drop("nth", "best")
    return standard.join(kept, ["sample", "hypo_type", *PLACE], "left_semi")


def hypo_summary(standard: DataFrame) -> DataFrame:
    return standard.groupBy("sample", "hypo_type").agg(
        F.count(F.lit(1)).alias("n_records"),
        F.count_distinct(*PLACE).alias("n_intervals"),
        F.count_distinct("other_type").alias("n_opponents"),
        F.count_if(~F.col("consistent")).alias("n_mismatches"),
        F.max("diff").alias("max_diff"),
        F.min("raw_p").alias("min_p"),
    )


def region_sources(standard: DataFrame, sample: str = "sample") -> DataFrame:
    """One row per exact interval: supporting types and samples, rows, least p, largest difference."""
    return standard.groupBy(*PLACE).agg(
        F.array_join(F.array_sort(F.collect_set("hypo_type")), ",").alias("types"),
        F.array_join(F.array_sort(F.collect_set(sample)), ",").alias("samples"),
        F.count(F.lit(1)).alias("n_rows"),
        F.min("raw_p").alias("min_p"),
        F.max("diff").alias("max_diff"),
    )


def type_summary(standard: DataFrame, compared: DataFrame, united: DataFrame, shared: DataFrame) -> DataFrame:
    """Per sample and type that was compared: its opponents, those with lower records, records, intervals, mismatches, united and shared regions.

    ``compared`` is what ``opponents`` gives; ``united`` and ``shared`` have rows of
    (sample, cell_type). A type without records has zeros.
    """
    own = standard.groupBy("sample", F.col("hypo_type").alias("cell_type")).agg(
        F.count_distinct("other_type").alias("n_with_hypo"), F.count(F.lit(1)).alias("n_records"),
        F.count_distinct(*PLACE).alias("n_intervals"), F.count_if(~F.col("consistent")).alias("n_mismatches"),
    )
    out = compared.withColumn("n_opponents", F.size(F.split("opponents", ",")).cast("long")).join(own, ["sample", "cell_type"], "left")
    for name, df in (("n_united", united), ("n_shared", shared)):
        out = out.join(df.groupBy("sample", "cell_type").agg(F.count(F.lit(1)).alias(name)), ["sample", "cell_type"], "left")
    counts = ["n_with_hypo", "n_records", "n_intervals", "n_mismatches", "n_united", "n_shared"]
    return out.na.fill(0, counts).select("sample", "cell_type", "n_opponents", *counts, "opponents")


def input_summary(records: DataFrame, passing: DataFrame, selected: DataFrame) -> DataFrame:
    """Per sample: comparisons read, their rows, rows that pass, rows and distinct intervals that are selected."""
    out = records.groupBy("sample").agg(F.count_distinct("left_type", "right_type").alias("n_files"), F.count(F.lit(1)).alias("n_rows"))
    out = out.join(passing.groupBy("sample").agg(F.count(F.lit(1)).alias("n_passing")), "sample", "left")
    out = out.join(selected.groupBy("sample").agg(F.count(F.lit(1)).alias("n_selected"), F.count_distinct(*PLACE).alias("n_selected_intervals")), "sample", "left")
    return out.na.fill(0)


def subtraction_summary(response: DataFrame, clean: DataFrame, pairwise: DataFrame, selected: DataFrame, by: str) -> DataFrame:
    """Per type of ``response``: rows before and after, the fraction removed, and whether there was something to subtract."""
    out = response.groupBy(by).agg(F.count(F.lit(1)).alias("n_rows"))
    for name, df in (("n_clean", clean), ("__read", pairwise), ("__selected", selected)):
        out = out.join(df.groupBy(by).agg(F.count(F.lit(1)).alias(name)), by, "left")
    out = out.na.fill(0, ["n_clean", "__read", "__selected"])
    status = F.when(F.col("__read") == 0, NOT_READ).when(F.col("__selected") == 0, NONE_PASSED).otherwise("complete")
    removed = F.col("n_rows") - F.col("n_clean")
    return out.select(by, "n_rows", "n_clean", removed.alias("n_removed"), (removed / F.col("n_rows")).alias("removed_fraction"), status.alias("status"))


def opponents(df: DataFrame) -> DataFrame:
    """Types each type was compared with, both ways round."""
    both = df.select("sample", F.col("left_type").alias("cell_type"), F.col("right_type").alias("other")).unionByName(
        df.select("sample", F.col("right_type").alias("cell_type"), F.col("left_type").alias("other"))
    )
    return both.groupBy("sample", "cell_type").agg(F.array_join(F.array_sort(F.collect_set("other")), ",").alias("opponents"))


def pairwise_comparisons(cells: DataFrame, by: str, label: str, least: int = 10) -> DataFrame:
    """All unordered pairs of labels within a group, with sizes and eligibility."""
    in_range("least", least, 1)
    counts = cells.where(F.col(label).isNotNull()).groupBy(by, label).agg(F.count(F.lit(1)).alias("n"))
    a = counts.select(by, F.col(label).alias("label_a"), F.col("n").alias("n_a"))
    b = counts.select(by, F.col(label).alias("label_b"), F.col("n").alias("n_b"))
    pairs = a.join(b, by).where("label_a < label_b")
    enough = (F.col("n_a") >= least) & (F.col("n_b") >= least)
    return pairs.withColumn("eligible", F.when(enough, "yes").otherwise("no"))


def comparison_families(cells: DataFrame, families: dict[str, tuple[list[str], str]], least: int = 10) -> DataFrame:
    """(family, within, label_a, label_b, n_a, n_b, eligible): pairs of labels in every family, a name with the columns that both sides share and the label.

    Cells with a null in any of these columns take no part in that family; ``within`` joins what both share by a colon.
    """
    out = []
    for name, (shared, label) in families.items():
        rows = cells.where(F.col(label).isNotNull())
        for c in shared:
            rows = rows.where(F.col(c).isNotNull())
        within = F.concat_ws(":", *shared) if shared else F.lit("")
        pairs = pairwise_comparisons(rows.select(within.alias("within"), F.col(label).cast("string").alias("label")), "within", "label", least)
        out.append(pairs.select(F.lit(name).alias("family"), "within", "label_a", "label_b", "n_a", "n_b", "eligible"))
    if not out:
        raise ValueError("no family of comparisons is named")
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found


def group_membership(cells: DataFrame, comparisons: DataFrame, by: str, label: str) -> DataFrame:
    """group_A, group_B or ``-`` for each cell of a group, in each comparison."""
    side = F.when(F.col(label) == F.col("label_a"), "group_A").when(F.col(label) == F.col("label_b"), "group_B").otherwise("-")
    return cells.join(comparisons.select(by, "label_a", "label_b"), by).select(by, "cell_no", "label_a", "label_b", side.alias("membership"))


def comparison_summary(comparisons: DataFrame, records: DataFrame) -> DataFrame:
    """Records and hits of each comparison, and its status: ineligible, pending without records, partial while records lack a p, complete."""
    hits = records.groupBy("sample", F.col("left_type").alias("label_a"), F.col("right_type").alias("label_b")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("raw_p") < 0.05).alias("n_p05"), F.count_if(F.col("raw_p").isNull()).alias("n_open")
    )
    joined = comparisons.join(hits, ["sample", "label_a", "label_b"], "left")
    status = F.when(F.col("eligible") == "no", "ineligible").when(F.col("total").isNull(), "pending").when(F.col("n_open") > 0, "partial").otherwise("complete")
    return joined.select("sample", "label_a", "label_b", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("n_p05", F.lit(0)).alias("n_p05"), status.alias("status"))


def without_null_fdr(df: DataFrame, permuted: Column, by: list[str]) -> DataFrame:
    """Adjusted p is null in groups without permuted rows."""
    n = df.groupBy(*by).agg(F.count_if(permuted).alias("__n")).select(*[F.col(c).alias(f"__{c}") for c in by], "__n")
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]
    return df.join(n, same).withColumn("adjusted_p", F.when(F.col("__n") > 0, F.col("adjusted_p"))).select(*df.columns)


def windows(sites: DataFrame, width: int, step: int) -> DataFrame:
    """Sites with each sliding window (start_pos) that holds them; a site is in width / step windows."""
    if width <= 0 or step <= 0:
        raise ValueError(f"a width of {width} and a step of {step} are no windows")
    last = F.floor(F.col("pos") / step)
    first = F.greatest(F.lit(0), F.floor((F.col("pos") - width) / step) + 1)
    return sites.withColumn("start_pos", F.explode(F.transform(F.sequence(first, last), lambda i: i * step)))


def window_variance(values: DataFrame, width: int, step: int, least_cells: int) -> DataFrame:
    """Variance over cells of their mean residual per window, residuals shrunk by one: sum of (ratio - site mean) / (n + 1)."""
    site = values.groupBy("chrom", "pos").agg(F.avg("ratio").alias("site_mean"))
    residuals = values.join(site, ["chrom", "pos"])
    cells = windows(residuals, width, step).groupBy("chrom", "start_pos", "cell_no").agg((F.sum(F.col("ratio") - F.col("site_mean")) / (F.count(F.lit(1)) + 1)).alias("r"))
    out = cells.groupBy("chrom", "start_pos").agg(F.count(F.lit(1)).alias("n_cells"), F.var_samp("r").alias("variance"))
    return out.where(F.col("n_cells") >= least_cells)


def welch_t(values: DataFrame, group: str, sides: tuple[str, str], by: list[str], value: str = "value") -> DataFrame:
    """Welch's t of two groups from their moments; null without two values and spread on either side."""
    moments = []
    for name, side in zip(("a", "b"), sides, strict=True):
        x = F.when(F.col(group) == side, F.col(value))
        moments += [F.count(x).alias(f"n_{name}"), F.avg(x).alias(f"mean_{name}"), F.var_samp(x).alias(f"var_{name}")]
    out = values.where(F.col(group).isin(*sides)).groupBy(*by).agg(*moments)
    error = F.sqrt(F.col("var_a") / F.col("n_a") + F.col("var_b") / F.col("n_b"))
    return out.select(*by, "n_a", "n_b", F.when((F.col("n_a") > 1) & (F.col("n_b") > 1) & (error > 0), (F.col("mean_a") - F.col("mean_b")) / error).alias("t"))


# The text of a p that was written without an adjusted one.
FALLBACK_P, FALLBACK_ADJUSTED = r"^[0-9]+([.][0-9]*)?([eE][+-]?[0-9]+)?$", "NA"


def fallback_validity(records: DataFrame, by: list[str], raw: str = "raw_p", adjusted: str = "adjusted_p") -> DataFrame:
    """Whether all records of a file are as a run without permuted rows leaves them: adjusted p NA, raw p an unsigned number in text."""
    good = (F.col(adjusted) == FALLBACK_ADJUSTED) & F.col(raw).rlike(FALLBACK_P)
    out = records.groupBy(*by).agg(F.count(F.lit(1)).alias("n_records"), F.count_if(~F.coalesce(good, F.lit(False))).alias("n_bad"))
    return out.withColumn("valid", F.col("n_bad") == 0)
