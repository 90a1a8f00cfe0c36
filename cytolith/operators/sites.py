"""Site tables (sample, cell_no, chrom, pos, mc, uc, line_no): audits, duplicates, counts per cell, bin and region."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cytolith.functions.labels import is_primary
from cytolith.operators.checks import in_range, ordered
from cytolith.operators.intervals import points_in_regions
from cytolith.session import ROWS, spread

FILE = ["sample", "cell_no"]
LOCUS = [*FILE, "chrom", "pos"]
#: A line of a site file: its locus with the end, and the columns that are compared.
PLACE, PROBABILITY = [*LOCUS, "end_pos"], "prob"
#: Lines of a file that are ordered in one task; tables of more are cut into ranges of the order.
LINES = 1 << 22
#: Sites that a task sums by bin, at least; nearly each of them can be a group of its own there. Up to FILES tasks, those
#: before write a file for each and hold no rows.
BINNED, FILES = 1 << 17, 200


def ratio() -> Column:
    """Methylated share of the counts of a site; null without coverage, so means are over covered sites."""
    return F.try_divide(F.col("mc").cast("double"), F.col("mc") + F.col("uc"))


def valid_site() -> Column:
    """Counts are there, not negative and not both zero, positions not negative."""
    return F.coalesce((F.col("mc") >= 0) & (F.col("uc") >= 0) & (F.col("mc") + F.col("uc") > 0) & (F.col("pos") >= 0), F.lit(False))


def validate_sites(sites: DataFrame) -> DataFrame:
    return sites.groupBy(*FILE).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(~valid_site()).alias("n_bad"))


def _with_part(df: DataFrame, few: DataFrame, *columns: str) -> DataFrame:
    """``df`` with columns of ``few``, which has one row per file and part."""
    keys = [*FILE, "part"]
    named = few.select(*[F.col(c).alias(f"__{c}") for c in keys], *columns)
    return df.join(named, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys]).drop(*[f"__{c}" for c in keys])


def _in_order(sites: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """Lines with part, a range of the order, and before, the struct of these columns in the line before it in its file.

    A part is ordered by itself; the last lines of parts, one row per file and part, are carried over to the next. Counts the lines.
    """
    parts = -(-sites.count() // LINES)
    ends = sites.select(F.percentile_approx(order, [i / parts for i in range(1, parts)], 10_000)).first()[0] if parts > 1 else []
    part = F.size(F.filter(F.array(*[F.lit(x) for x in sorted(set(ends or []))]), lambda x: x <= F.col(order))) if ends else F.lit(0)
    dealt = sites.withColumn("part", F.coalesce(part, F.lit(0)))
    line = F.struct(*columns)
    last = dealt.groupBy(*FILE, "part").agg(F.max_by(line, F.struct(order)).alias("last"))
    last = last.withColumn("carried", F.lag("last").over(Window.partitionBy(*FILE).orderBy("part")))
    here = Window.partitionBy(*FILE, "part").orderBy(order)
    lagged = dealt.withColumns({"nth": F.row_number().over(here), "before": F.lag(line).over(here)})
    return _with_part(lagged, last, "carried").withColumn("before", F.when(F.col("nth") == 1, F.col("carried")).otherwise(F.col("before"))).drop("nth", "carried")


def audit_duplicates(sites: DataFrame, order: str = "line_no") -> DataFrame:
    """Per file, runs of one place (chrom, pos, end_pos) in file order: duplicates, their kind, and breaks of the order.

    Lines of a run are exact if they agree in prob, mc and uc as they stand. A file is ordered by ranges, so none is one task. Runs jobs.
    """
    marked = _in_order(sites, order, ["chrom", "pos", "end_pos"])
    before = {c: F.col(f"before.{c}") for c in ("chrom", "pos", "end_pos")}
    new_run = before["chrom"].isNull() | (before["chrom"] != F.col("chrom")) | (before["pos"] != F.col("pos")) | (before["end_pos"] != F.col("end_pos"))
    new_chrom = before["chrom"].isNull() | (before["chrom"] != F.col("chrom"))
    descends = F.coalesce((before["chrom"] == F.col("chrom")) & (before["pos"] > F.col("pos")), F.lit(False))
    marked = marked.select(*FILE, "part", order, "chrom", PROBABILITY, "mc", "uc", new_run.cast("int").alias("new_run"), new_chrom.cast("int").alias("new_chrom"), descends.cast("int").alias("descends"))
    begun = Window.partitionBy(*FILE).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs_before = marked.groupBy(*FILE, "part").agg(F.sum("new_run").alias("n")).withColumn("runs_before", F.coalesce(F.sum("n").over(begun), F.lit(0)))
    run = F.coalesce(F.sum("new_run").over(Window.partitionBy(*FILE, "part").orderBy(order)), F.lit(0)) + F.col("runs_before")
    marked = _with_part(marked, runs_before, "runs_before").withColumn("run", run)
    runs = marked.groupBy(*FILE, "run", "chrom").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct(F.struct(PROBABILITY, "mc", "uc")).alias("kinds"),
        F.sum("new_chrom").alias("new_chrom"),
        F.sum("descends").alias("descends"),
    )
    twice = F.col("n") > 1
    out = runs.groupBy(*FILE).agg(
        F.sum("n").alias("n_rows"),
        F.count_if(twice).alias("duplicate_loci"),
        F.sum(F.when(twice, F.col("n") - 1).otherwise(0)).alias("extra_rows"),
        F.count_if(twice & (F.col("kinds") == 1)).alias("exact_loci"),
        F.count_if(twice & (F.col("kinds") > 1)).alias("conflicting_loci"),
        F.count_if(twice & is_primary(F.col("chrom"), True)).alias("primary_loci"),
        F.sum("descends").alias("descents"),
        (F.sum("new_chrom") - F.count_distinct("chrom")).alias("reentries"),
    )
    return out.withColumn("ordering_ok", (F.col("descents") == 0) & (F.col("reentries") == 0))


AUDIT_SUMS = ["n_rows", "duplicate_loci", "extra_rows", "exact_loci", "conflicting_loci", "primary_loci", "descents", "reentries"]


def audit_totals(audit: DataFrame) -> DataFrame:
    """(metric, value) rows over all files."""
    sums = audit.agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if(F.col("duplicate_loci") > 0).alias("files_with_duplicates"),
        F.count_if(~F.col("ordering_ok")).alias("unordered_files"),
        *[F.sum(c).alias(c) for c in AUDIT_SUMS],
    )
    return sums.unpivot([], sums.columns, "metric", "value")


def _by_locus(sites: DataFrame) -> DataFrame:
    first = F.min(F.struct("line_no", "mc", "uc"))
    counts = [F.count(F.lit(1)).alias("n"), F.min(PROBABILITY).alias("low"), F.max(PROBABILITY).alias("high"), first.alias("first")]
    return sites.groupBy(*PLACE).agg(*counts)


def dedup_by_probability(sites: DataFrame) -> DataFrame:
    """The first row of each place whose rows agree in the number of their probability column.

    Places that disagree, or whose rows have no probability at all, go as a whole. Counts
    are not compared, and may be zero.
    """
    return _by_locus(sites).where("low = high").select(*PLACE, F.col("low").alias(PROBABILITY), "first.mc", "first.uc", "first.line_no")


def dedup_stats(sites: DataFrame) -> DataFrame:
    """Counts of the rule above per file, with its two invariants."""
    twice, agree = F.col("n") > 1, F.coalesce(F.col("low") == F.col("high"), F.lit(False))
    out = _by_locus(sites).groupBy(*FILE).agg(
        F.sum("n").alias("rows_in"),
        F.count_if(agree).alias("rows_out"),
        F.count_if(twice).alias("duplicate_loci"),
        F.count_if(twice & agree).alias("same_loci"),
        F.count_if(twice & ~agree).alias("different_loci"),
        F.sum(F.col("n") - agree.cast("int")).alias("removed"),
    )
    holds = (F.col("duplicate_loci") == F.col("same_loci") + F.col("different_loci")) & (F.col("rows_in") - F.col("rows_out") == F.col("removed"))
    return out.withColumn("holds", holds)


def order_audit(sites: DataFrame) -> DataFrame:
    """Per file, rows whose position falls below the one before on the same chromosome, in file order."""
    lines = _in_order(sites, "line_no", ["chrom", "pos"])
    falls = (F.col("before.chrom") == F.col("chrom")) & (F.col("before.pos") > F.col("pos"))
    turns = F.coalesce(F.col("before.chrom") != F.col("chrom"), F.lit(True))
    marked = lines.select(*FILE, "chrom", falls.alias("falls"), turns.alias("turns"))
    return marked.groupBy(*FILE).agg(
        F.count_if("falls").alias("descents"), (F.count_if("turns") - F.count_distinct("chrom")).alias("reentries")
    )


def merge_counts(sites: DataFrame) -> DataFrame:
    """One row per locus with summed counts; discordant if its rows' ratios differ. Without coverage the ratio is null."""
    out = sites.groupBy(*LOCUS).agg(
        F.sum("mc").alias("mc"), F.sum("uc").alias("uc"), F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.max(ratio()) - F.min(ratio()) > 1e-12, F.lit(False)).alias("discordant")
    )
    return out.withColumn("ratio", ratio())


def region_mean(sites: DataFrame, regions: DataFrame) -> DataFrame:
    """Unweighted mean over unique sites per cell and region; ``regions`` do not overlap each other."""
    inside = points_in_regions(merge_counts(sites), regions.select("chrom", "start_pos", "end_pos"))
    return inside.groupBy(*FILE, "chrom", "region_start", "region_end").agg(F.count(F.lit(1)).alias("n_sites"), F.avg("ratio").alias("mean_ratio"))


def region_mean_summary(means: DataFrame, regions: DataFrame) -> DataFrame:
    """Cells of the cell-by-region grid with and without a value, per sample."""
    total = regions.agg(F.count(F.lit(1)).alias("n_regions"))
    cells = means.groupBy("sample").agg(F.count_distinct("cell_no").alias("n_cells"), F.count(F.lit(1)).alias("covered_values"), F.sum("n_sites").alias("n_sites"))
    values = F.col("n_cells") * F.col("n_regions")
    return cells.join(F.broadcast(total)).select(
        "sample", values.alias("matrix_values"), "covered_values", (1 - F.col("covered_values") / values).alias("missing_fraction"), "n_sites"
    )


def cell_levels(sites: DataFrame) -> DataFrame:
    """Per cell: sites, coverage, mean of ratios and ratio of sums; both are null for a cell without coverage."""
    both = F.sum(F.col("mc") + F.col("uc"))
    return sites.groupBy(*FILE).agg(
        F.count(F.lit(1)).alias("n_sites"), both.alias("total_coverage"), F.avg(ratio()).alias("mean_site_level"), F.try_divide(F.sum("mc"), both).alias("overall_level")
    )


def cell_qc_filter(levels: DataFrame, min_sites: int = 300_000, max_sites: int = 1_200_000, min_level: float = 0.55, max_level: float | None = None) -> DataFrame:
    in_range("min_sites", min_sites, 0)
    in_range("min_level", min_level, 0, 1)
    in_range("max_level", max_level, 0, 1)
    ordered("min_sites", min_sites, "max_sites", max_sites)
    ordered("min_level", min_level, "max_level", max_level)
    keep = F.col("n_sites").between(min_sites, max_sites) & (F.col("overall_level") >= min_level)
    return levels.where(keep if max_level is None else keep & (F.col("overall_level") <= max_level))


def aggregate_bins(sites: DataFrame, bins: DataFrame, size: int, rows: int | None = None, each: int = ROWS) -> DataFrame:
    """Summed counts per cell and retained bin; bins without coverage have no row.

    Sites are dealt by bin over as many tasks as they need, and so are the bins: they are never broadcast, however few
    rows Spark takes an exploded range for. ``rows`` is how many sites there are at most; without it they are counted,
    which runs a job. ``each`` is how many a task gets.
    """
    if size <= 0:
        raise ValueError(f"{size} is no size of bins")
    dealt = spread(sites.withColumn("bin", F.floor(F.col("pos") / size)), "chrom", "bin", rows=rows, each=each)
    out = dealt.join(bins.select("chrom", "bin").hint("merge"), ["chrom", "bin"])
    return out.groupBy(*FILE, "chrom", "bin").agg(F.sum("mc").alias("mc"), F.sum(F.col("mc") + F.col("uc")).alias("cov")).where("cov > 0")


def sites_each(rows: int) -> int:
    """Sites to a task where ``rows`` are summed by bin: BINNED, more before there are over FILES tasks, ROWS at most."""
    return min(ROWS, max(BINNED, -(-rows // FILES)))


def cell_depth(binned: DataFrame) -> DataFrame:
    """Depth per cell over bins: total, covered bins, mean per covered bin (0 if none), log."""
    out = binned.groupBy(*FILE).agg(F.sum("cov").alias("total_coverage"), F.count_if(F.col("cov") > 0).alias("covered_bins"))
    mean = F.when(F.col("covered_bins") > 0, F.col("total_coverage") / F.col("covered_bins")).otherwise(0.0)
    return out.select(*FILE, "total_coverage", "covered_bins", mean.alias("mean_coverage"), F.log1p("total_coverage").alias("log1p_coverage"))


def bin_support(binned: DataFrame, cutoff: float = 0.95) -> DataFrame:
    """Cells per bin whose score (unmethylated share) exceeds the cutoff."""
    in_range("cutoff", cutoff, 0, 1)
    score = 1 - F.col("mc") / F.col("cov")
    return binned.groupBy("chrom", "bin").agg(F.count_if(score > cutoff).alias("n_cells"), F.count(F.lit(1)).alias("n_covered"))


def threshold_for_target(support: DataFrame, n_cells: int, target: int) -> DataFrame:
    """The smallest observed count T with at most ``target`` bins above it.

    If the target is the number of supported bins, T is one less than the smallest count;
    a larger target is an error. The percentage keeps exactly the bins above T.
    """
    in_range("n_cells", n_cells, 1)
    in_range("target", target, 0)
    counts = support.where("n_cells > 0").groupBy("n_cells").agg(F.count(F.lit(1)).alias("n_bins"))
    above = F.coalesce(F.sum("n_bins").over(Window.orderBy(F.desc("n_cells")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = counts.select("n_cells", above.alias("above"), "n_bins")
    found = ranked.agg(F.sum("n_bins").alias("covered"), F.min("n_cells").alias("least"), F.min(F.when(F.col("above") <= target, F.col("n_cells"))).alias("t"))
    threshold = F.when(F.col("covered") == target, F.col("least") - 1).when(F.col("covered") > target, F.col("t"))
    threshold = F.coalesce(threshold, F.raise_error(F.lit("the target exceeds the supported bins")).cast("long"))
    return found.select("covered", threshold.alias("threshold"), (threshold * 100 / n_cells + 1e-6).alias("percent"))


def sites_to_context(sites: DataFrame) -> DataFrame:
    """Context rows (chrom, pos, strand, context, mc, cov, flag) of sites."""
    return sites.select(*FILE, "chrom", "pos", F.lit("+").alias("strand"), F.lit("CGN").alias("context"), "mc", (F.col("mc") + F.col("uc")).alias("cov"), F.lit(1).alias("flag"))


def in_context(context: Column, wanted: str) -> Column:
    """CGN means any CG, CHN means C and no G, others mean themselves; case does not matter."""
    text, name = F.upper(context), wanted.upper()
    if name == "CGN":
        return text.startswith("CG")
    return text.startswith("C") & (F.substring(text, 2, 1) != "G") if name == "CHN" else text == name
