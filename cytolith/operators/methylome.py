"""Published methods over single-cell methylation, written anew: smoothed means, variable regions, permuted differences, profiles around starts.

The methods are those of the literature on single-cell bisulfite data (tricube kernel
smoothing of site means, variance of shrunken residuals in sliding windows, differences of
two groups of cells held against permuted labels, stranded profiles). They follow the
descriptions, not the numbers, of any one tool. ``values`` are rows (chrom, pos, cell_no,
ratio); null ratios take no part.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cytolith.operators.intervals import merge_intervals, points_in_regions
from cytolith.operators.ordered import kth_largest, running
from cytolith.operators.regions import welch_t, windows
from cytolith.session import ROWS, kept, spread

#: Half bandwidths in a genome block of the smoother; a block also gets the sites half a bandwidth around it.
BLOCK = 128
#: Widths in a genome block of sliding windows; a site is sent to every block that has a window around it.
WINDOW_BLOCK = 16
#: Labels of all cells and permutations up to which they are broadcast; they are counted.
LABELS = 1_000_000


def _positive(**sizes: float) -> None:
    for name, size in sizes.items():
        if not size > 0:
            raise ValueError(f"{name} = {size} is not positive")


def _tricube(pos, mean, weight, half: float):
    """Means of sites in the order of their places, smoothed: pairs of neighbours are met by their distance in that order."""
    import numpy as np

    above, below = weight * mean, weight.copy()
    at, lag = np.arange(len(pos)), 1
    while len(at := at[at + lag < len(pos)]):
        away = (pos[at + lag] - pos[at]) / half
        at, away = at[away < 1], away[away < 1]
        kernel = 1 - away * away * away
        kernel = kernel * kernel * kernel
        for one, other in ((at, at + lag), (at + lag, at)):
            part = kernel * weight[other]
            above[one] += part * mean[other]
            below[one] += part
        lag += 1
    return above / below


def _in_blocks(values: DataFrame, half: float, rows: int | None) -> DataFrame:
    """Values with a ratio and a place, in their genome block and in those that they are near to."""
    size = BLOCK * half
    reach = F.sequence(F.floor((F.col("pos") - half) / size), F.floor((F.col("pos") + half) / size))
    rows = values.count() if rows is None else rows
    there = values.where("ratio is not null and chrom is not null and pos is not null")
    return spread(there.select("*", F.explode(reach).alias("block")), "chrom", "block", rows=rows)


def _own(block, half: float):
    """Rows of a block that lie in it, not near it."""
    import numpy as np
    import pyarrow as pa

    return pa.array(np.floor(block.column("pos").to_numpy() / (BLOCK * half)) == block.column("block").to_numpy())


def _types(df: DataFrame, *columns: str) -> str:
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in columns)


def smooth_means(values: DataFrame, bandwidth: int = 1000, weigh: bool = False, rows: int | None = None) -> DataFrame:
    """(chrom, pos, n_cells, site_mean, smoothed): means of sites, smoothed by a tricube kernel of this whole width.

    With ``weigh``, sites count by the log of one plus their cells. Values are dealt out by
    genome block, those near an edge to both sides of it, so each site meets all its
    neighbours in its own block, whose width bounds what a task holds, and one shuffle is all there is. ``rows``
    is how many values there are at most; without it they are counted, which runs a job.
    """
    _positive(bandwidth=bandwidth)
    half = bandwidth / 2
    site = _in_blocks(values, half, rows).groupBy("chrom", "block", "pos").agg(F.count("ratio").alias("n_cells"), F.avg("ratio").alias("site_mean"))

    def smooth(block):
        import numpy as np
        import pyarrow as pa

        block = block.sort_by("pos")
        pos, mean, cells = (block.column(c).to_numpy() for c in ("pos", "site_mean", "n_cells"))
        smoothed = _tricube(pos, mean, np.log1p(cells) if weigh else np.ones(len(pos)), half)
        return block.append_column("smoothed", pa.array(smoothed)).filter(_own(block, half)).drop_columns("block")

    return site.groupBy("chrom", "block").applyInArrow(smooth, f"{_types(site, 'chrom', 'pos')}, n_cells long, site_mean double, smoothed double")


def residuals(values: DataFrame, bandwidth: int = 1000, rows: int | None = None) -> DataFrame:
    """(chrom, pos, cell_no, residual): ratios less the smoothed mean of their site, by blocks as in ``smooth_means``."""
    _positive(bandwidth=bandwidth)
    half = bandwidth / 2
    near = _in_blocks(values.select("chrom", "pos", "cell_no", "ratio"), half, rows)

    def less(block):
        import numpy as np
        import pyarrow as pa

        ratio = block.column("ratio").to_numpy()
        pos, of = np.unique(block.column("pos").to_numpy(), return_inverse=True)
        smoothed = _tricube(pos, np.bincount(of, ratio) / np.bincount(of), np.ones(len(pos)), half)
        return block.append_column("residual", pa.array(ratio - smoothed[of])).filter(_own(block, half)).drop_columns(["ratio", "block"])

    return near.groupBy("chrom", "block").applyInArrow(less, f"{_types(near, 'chrom', 'pos', 'cell_no')}, residual double")


def _shrunken() -> Column:
    """The mean residual of a cell, shrunk to zero by one; twelve digits, so that the order of a sum decides no tie."""
    return F.round(F.sum("residual") / (F.count(F.lit(1)) + 1), 12)


def window_residuals(rests: DataFrame, width: int, step: int, rows: int | None = None) -> DataFrame:
    """(chrom, block, start_pos, cell_no, value): shrunken mean residual of each cell in each sliding window.

    Sites are dealt by the genome block of their windows before these are made; a group by chrom, block and what
    else stays in its task. ``rows`` is how many residuals there are at most; without it they are counted.
    """
    _positive(width=width, step=step)
    size = WINDOW_BLOCK * max(width, step)
    first = F.greatest(F.lit(0), F.floor((F.col("pos") - width) / step) + 1) * step
    blocks = F.sequence(F.floor(first / size), F.floor(F.floor(F.col("pos") / step) * step / size))
    # a residual is in so many windows, and each is a row of the task
    each = max(1, ROWS // max(1, width // step))
    placed = spread(rests.withColumn("block", F.explode(blocks)), "chrom", "block", rows=rests.count() if rows is None else rows, each=each)
    inside = windows(placed, width, step).where(F.floor(F.col("start_pos") / size) == F.col("block"))
    return inside.groupBy("chrom", "block", "start_pos", "cell_no").agg(_shrunken().alias("value"))


def variable_regions(values: DataFrame, width: int = 2000, step: int = 100, share: float = 0.02, least_cells: int = 6, bandwidth: int = 1000, rows: int | None = None) -> DataFrame:
    """(chrom, start_pos, end_pos, n_windows, n_cells, variance): the windows of largest variance over cells, united, and scored anew as regions.

    A window counts if it holds ``least_cells`` cells; the ``share`` of windows with the
    largest variance (and all that tie with the last of them) is taken. The limit is an
    exact order statistic. ``rows`` as in ``smooth_means``. Runs jobs.
    """
    _positive(width=width, step=step, least_cells=least_cells)
    if not 0 < share <= 1:
        raise ValueError(f"{share} is no share of the windows")
    rests = kept(residuals(values, bandwidth, rows))
    variance = F.round(F.var_samp("value"), 12).alias("variance")
    scored = window_residuals(rests, width, step).groupBy("chrom", "block", "start_pos").agg(F.count(F.lit(1)).alias("n_cells"), variance)
    scored = kept(scored.where((F.col("n_cells") >= least_cells) & F.col("variance").isNotNull()))
    n = scored.count()
    limit = kth_largest(scored, "variance", math.ceil(share * n)) if n else math.inf
    chosen = scored.where(F.col("variance") >= limit).select("chrom", "start_pos", (F.col("start_pos") + width).alias("end_pos"))
    regions = merge_intervals(chosen, touching=True)
    inside = points_in_regions(rests, regions.withColumnRenamed("n_records", "n_windows"))
    cells = inside.groupBy("chrom", "region_start", "region_end", "n_windows", "cell_no").agg(_shrunken().alias("value"))
    return cells.groupBy("chrom", F.col("region_start").alias("start_pos"), F.col("region_end").alias("end_pos"), "n_windows").agg(F.count(F.lit(1)).alias("n_cells"), F.var_samp("value").alias("variance"))


def permuted_labels(members: DataFrame, sides: tuple[str, str], permutations: int, seed: int, cell: str = "cell_no", side: str = "side") -> DataFrame:
    """(cell, permutation, side): the labels (permutation 0) and as many shuffles of them, group sizes kept.

    A shuffle orders the cells by the md5 of ``seed:permutation:cell``; the first get the
    first label. One row per cell and permutation is made, and each permutation is ordered by itself.
    """
    labelled = members.where(F.col(side).isin(*sides)).select(F.col(cell).alias("cell_no"), F.col(side).alias("side")).distinct()
    first = labelled.agg(F.count_if(F.col("side") == sides[0]).alias("n_first"))
    drawn = labelled.select("cell_no", F.explode(F.sequence(F.lit(0), F.lit(permutations))).alias("permutation"), "side")
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("permutation").cast("string"), F.col("cell_no").cast("string")).cast("binary"))
    order = Window.partitionBy("permutation").orderBy(digest, "cell_no")
    shuffled = drawn.where("permutation > 0").withColumn("nth", F.row_number().over(order)).join(F.broadcast(first))
    shuffled = shuffled.select("cell_no", "permutation", F.when(F.col("nth") <= F.col("n_first"), sides[0]).otherwise(sides[1]).alias("side"))
    return drawn.where("permutation = 0").unionByName(shuffled)


def permuted_statistics(values: DataFrame, labels: DataFrame, sides: tuple[str, str], by: list[str]) -> DataFrame:
    """(by, permutation, n_a, n_b, t): Welch's t of the two groups, for the labels and all their shuffles in one pass.

    Cells are few beside the values, so values are not dealt by cell: the labels of a cell are one row, and go to all tasks if
    they were counted to be few. Runs a job over the labels.
    """
    drawn = kept(labels.groupBy("cell_no").agg(F.collect_list(F.struct("permutation", "side")).alias("drawn")))
    if (drawn.agg(F.sum(F.size("drawn"))).first()[0] or 0) <= LABELS:
        drawn = F.broadcast(drawn)
    labelled = values.join(drawn, "cell_no").select(*by, "value", F.explode("drawn").alias("drawn")).select(*by, "value", "drawn.permutation", "drawn.side")
    return welch_t(labelled, "side", sides, [*by, "permutation"])


def permuted_fdr(statistics: DataFrame, by: list[str]) -> DataFrame:
    """Observed rows of ``permuted_statistics`` with p and adjusted_p.

    p is the share of permuted statistics as large in size, one added to both; adjusted_p
    follows Benjamini and Hochberg over all observed rows with a t. Both are null without a
    t, or where nothing was permuted. Counts of distinct sizes are added up over ranges, so no task sees all rows.
    """
    rows = kept(statistics.withColumn("size", F.round(F.abs("t"), 9)))
    counts = rows.where("size is not null").groupBy("size").agg(F.count_if(F.col("permutation") == 0).alias("seen"), F.count_if(F.col("permutation") > 0).alias("drawn"))
    above = running(counts, "size", ["seen", "drawn"], descending=True)
    totals = counts.agg(F.sum("seen").alias("n_seen"), F.sum("drawn").alias("n_drawn"))
    p = F.when(F.col("n_drawn") > 0, (1 + F.col("sum_drawn")) / (1 + F.col("n_drawn")))
    with_p = above.join(F.broadcast(totals)).select("size", p.alias("p"), F.when(F.col("seen") > 0, p * F.col("n_seen") / F.col("sum_seen")).alias("bound"))
    adjusted = running(with_p, "size", least=["bound"]).select("size", "p", F.least(F.lit(1.0), F.col("least_bound")).alias("adjusted_p"))
    adjusted = adjusted.withColumn("adjusted_p", F.when(F.col("p").isNotNull(), F.col("adjusted_p")))
    return rows.where("permutation = 0").join(adjusted, "size", "left").select(*by, "n_a", "n_b", "t", "p", "adjusted_p")


def start_profile(sites: DataFrame, starts: DataFrame, flank: int = 2000, bin_size: int = 50, by: tuple[str, ...] = ("cell_no",)) -> DataFrame:
    """(by, offset, mc, cov, n_sites, level): counts around the middles of ``starts`` (chrom, start_pos, end_pos, strand), per distance.

    A site counts for every start within ``flank`` bases, both ends left out; on the minus
    strand distances are turned round. ``offset`` is the first base of its bin. Starts are
    dealt out over bins of one flank, so that a site finds all starts around it in one bin.
    """
    _positive(flank=flank, bin_size=bin_size)
    middle = F.floor((F.col("start_pos") + F.col("end_pos")) / 2)
    reach = F.sequence(F.floor((middle - flank) / flank), F.floor((middle + flank) / flank))
    placed = starts.select("chrom", middle.alias("middle"), F.when(F.col("strand") == "-", -1).otherwise(1).alias("turn"), F.explode(reach).alias("bin"))
    found = sites.select(*by, "chrom", "pos", "mc", "uc", F.floor(F.col("pos") / flank).alias("bin")).join(placed, ["chrom", "bin"])
    away = (F.col("pos") - F.col("middle")) * F.col("turn")
    near = found.where(F.abs(F.col("pos") - F.col("middle")) < flank).withColumn("offset", (F.floor(away / bin_size) * bin_size).cast("long"))
    out = near.groupBy(*by, "offset").agg(F.sum("mc").alias("mc"), F.sum(F.col("mc") + F.col("uc")).alias("cov"), F.count(F.lit(1)).alias("n_sites"))
    return out.withColumn("level", F.try_divide(F.col("mc").cast("double"), F.col("cov")))
