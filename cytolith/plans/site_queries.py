"""Queries over sites and intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytolith.functions import ids, labels
from cytolith.operators import intervals, sites
from cytolith.plans.fixtures import Fixtures

RATIO = "(cast(mc as double) / nullif(mc + uc, 0))"
SIZES = "select chrom, max(end_pos) + 37 as length from fx_regions group by chrom"


def merged_sql(source: str, touching: bool, by: str = "chrom", name: str = "m", extra: str = "", out: str = "") -> str:
    """Common table expressions that merge intervals by a running maximum of ends."""
    compare = ">" if touching else ">="
    return f"""{name}_r as (select *, max(end_pos) over (partition by {by} order by start_pos, end_pos rows between unbounded preceding and 1 preceding) as reach from {source}),
{name}_i as (select *, sum(case when reach is null or start_pos {compare} reach then 1 else 0 end) over (partition by {by} order by start_pos, end_pos rows unbounded preceding) as island from {name}_r),
{name} as (select {by}, min(start_pos) as start_pos, max(end_pos) as end_pos, count(*) as n_records{extra} from {name}_i group by {by}, island)"""


MERGED_SITES = f"""u as (select sample, cell_no, chrom, pos, cast(sum(mc) as bigint) as mc, cast(sum(uc) as bigint) as uc, count(*) as n_rows,
coalesce(max({RATIO}) - min({RATIO}) > 1e-12, false) as discordant from fx_sites group by all)"""


def _merged(v: Fixtures) -> DataFrame:
    return intervals.merge_intervals(v.regions, touching=False)


def region_mean(v: Fixtures) -> DataFrame:
    out = sites.region_mean(v.sites, _merged(v))
    return _rounded(out, "mean_ratio")


def region_mean_summary(v: Fixtures) -> DataFrame:
    out = sites.region_mean_summary(sites.region_mean(v.sites, _merged(v)), _merged(v))
    return _rounded(out, "missing_fraction")


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Six digits, taken at twelve first: a mean on a tie of the sixth digit is not decided by the order of its sum."""
    return df.withColumns({c: F.round(F.round(c, 12), 6) for c in columns})


def _binned(v: Fixtures) -> DataFrame:
    rows = v.rows("fx_sites")
    return sites.aggregate_bins(v.sites, _bins(v), 50, rows, sites.sites_each(rows))


def _bins(v: Fixtures) -> DataFrame:
    return intervals.make_bins(v.regions.groupBy("chrom").agg((F.max("end_pos") + 37).alias("length")), 50)


BINS = f"sizes as ({SIZES}), bins as (select chrom, b as bin, b * 50 as start_pos, (b + 1) * 50 as end_pos from (select chrom, unnest(range(0, length // 50)) as b from sizes))"
BINNED = f"{BINS}, binned as (select sample, cell_no, chrom, pos // 50 as bin, cast(sum(mc) as bigint) as mc, cast(sum(mc + uc) as bigint) as cov from fx_sites where (chrom, pos // 50) in (select (chrom, bin) from bins) group by all having sum(mc + uc) > 0)"
OVERLAP = "a.chrom = b.chrom and a.start_pos < b.end_pos and b.start_pos < a.end_pos"
LEVELS = f"levels as (select sample, cell_no, count(*) as n_sites, cast(sum(mc + uc) as bigint) as total_coverage, avg({RATIO}) as mean_site_level, cast(sum(mc) as double) / nullif(sum(mc + uc), 0) as overall_level from fx_sites group by all)"
AUDIT = """l as (select *, lag(chrom) over w as pc, lag(pos) over w as pp, lag(end_pos) over w as pe from fx_sites window w as (partition by sample, cell_no order by line_no)),
r as (select *, sum(case when pc is null or pc <> chrom or pp <> pos or pe <> end_pos then 1 else 0 end) over (partition by sample, cell_no order by line_no rows unbounded preceding) as run,
  case when pc is null or pc <> chrom then 1 else 0 end as new_chrom, case when pc = chrom and pp > pos then 1 else 0 end as descends from l),
runs as (select sample, cell_no, run, chrom, count(*) as n, count(distinct (prob, mc, uc)) as kinds, sum(new_chrom) as new_chrom, sum(descends) as descends from r group by all),
audit as (select sample, cell_no, cast(sum(n) as bigint) as n_rows, count(*) filter (n > 1) as duplicate_loci, cast(sum(case when n > 1 then n - 1 else 0 end) as bigint) as extra_rows,
  count(*) filter (n > 1 and kinds = 1) as exact_loci, count(*) filter (n > 1 and kinds > 1) as conflicting_loci, count(*) filter (n > 1) as primary_loci,
  cast(sum(descends) as bigint) as descents, cast(sum(new_chrom) - count(distinct chrom) as bigint) as reentries from runs group by all),
checked as (select *, descents = 0 and reentries = 0 as ordering_ok from audit)"""
LOCUS = f"locus as (select sample, cell_no, chrom, pos, end_pos, count(*) as n, min(prob) as low, max(prob) as high, min((line_no, mc, uc)) as f, arg_min(mc, line_no) as mc, arg_min(uc, line_no) as uc, min(line_no) as line_no from fx_sites group by all)"

QUERIES = {
    "region_mean": region_mean,
    "region_mean_summary": region_mean_summary,
    "scan_sites": lambda v: v.sites.where(sites.valid_site()),
    "validate_sites": lambda v: sites.validate_sites(v.sites),
    "scan_context": lambda v: sites.sites_to_context(v.sites).where(sites.in_context(F.col("context"), "CGN")).groupBy("chrom").agg(F.sum("mc").alias("mc"), F.sum("cov").alias("cov")),
    "cov_to_allc": lambda v: sites.sites_to_context(v.sites),
    "cpg_merge": lambda v: _rounded(sites.merge_counts(v.sites), "ratio"),
    "dup_audit": lambda v: sites.audit_duplicates(v.sites),
    "dup_audit_total": lambda v: sites.audit_totals(sites.audit_duplicates(v.sites)),
    "dedup_prob": lambda v: sites.dedup_by_probability(v.sites),
    "dedup_stats": lambda v: sites.dedup_stats(v.sites),
    "order_audit": lambda v: sites.order_audit(v.sites),
    "cell_mcg_level": lambda v: _rounded(sites.cell_levels(v.sites), "mean_site_level", "overall_level"),
    "cell_qc_filter": lambda v: _rounded(sites.cell_qc_filter(sites.cell_levels(v.sites), 50, 20_000, 0.4), "mean_site_level", "overall_level"),
    "make_bins": _bins,
    "bin_aggregate": _binned,
    "cell_depth": lambda v: _rounded(sites.cell_depth(_binned(v)), "mean_coverage", "log1p_coverage"),
    "bin_support": lambda v: sites.bin_support(_binned(v), 0.5),
    "bin_filter": lambda v: sites.bin_support(_binned(v), 0.5).where(F.col("n_cells") > 6),
    "hypo_threshold": lambda v: _rounded(sites.threshold_for_target(sites.bin_support(_binned(v), 0.5), 50, 60), "percent"),
    "point_in_interval": lambda v: intervals.points_in_regions(v.sites, _merged(v).drop("n_records")).select("sample", "cell_no", "line_no", "region_start", "region_end"),
    "interval_merge_touch": lambda v: intervals.merge_intervals(v.regions, touching=True),
    "interval_merge_strict": _merged,
    "interval_merge_annot": lambda v: intervals.merge_intervals(
        v.dmr.select("sample", "left_type", "chrom", (F.col("start_pos") * 200).alias("start_pos"), (F.col("end_pos") * 200 - F.col("start_pos") * 100).alias("end_pos")), ["sample"], False, ["left_type"]
    ).select("sample", "chrom", "start_pos", "end_pos", "n_records", F.array_join("left_type", ",").alias("types")),
    "interval_anti": lambda v: intervals.drop_overlapping(v.regions, v.mask),
    "interval_semi": lambda v: intervals.keep_overlapping(v.regions, v.mask),
    "interval_blacklist": lambda v: intervals.drop_overlapping(v.regions, v.mask, least_fraction=0.2),
    "interval_partition": lambda v: v.regions.agg(F.count(F.lit(1)).alias("n_all")).join(intervals.drop_overlapping(v.regions, v.mask).agg(F.count(F.lit(1)).alias("n_clean"))).select(
        "n_all", "n_clean", (F.col("n_all") - F.col("n_clean")).alias("n_removed"), F.format_string("%.8f", 1 - F.col("n_clean") / F.col("n_all")).alias("removed_fraction")
    ),
    "interval_consensus": lambda v: intervals.consensus(v.dmr.where("raw_p < 0.05"), "left_type", ["T0", "T1", "T2"], ["sample"]),
    "mask_union": lambda v: intervals.merge_intervals(v.regions.unionByName(v.mask), touching=True),
    "mask_union_sources": lambda v: intervals.merge_intervals(
        v.regions.withColumn("source", F.lit("regions")).unionByName(v.mask.withColumn("source", F.lit("mask"))), touching=True, labels=["source"]
    ).select("chrom", "start_pos", "end_pos", "n_records", F.size("source").cast("long").alias("n_sources"), F.array_join("source", ",").alias("sources")),
    "matched_subtract": lambda v: intervals.drop_overlapping(
        v.dmr.where("raw_p < 0.01").select("left_type", "chrom", "start_pos", "end_pos").distinct(),
        v.dmr.where("raw_p > 0.195").select("left_type", "chrom", "start_pos", "end_pos").distinct(),
        ["left_type"],
    ),
    "overlap_guard": lambda v: intervals.overlapping_pairs(v.regions),
    "region_distinct": lambda v: intervals.distinct_rows([v.regions, v.mask], v.rows("fx_regions") + v.rows("fx_mask")),
    "chrom_sort": lambda v: v.regions.select("chrom", "start_pos", "end_pos", labels.chrom_key(F.col("chrom"))["number"].cast("long").alias("chrom_number")).orderBy("chrom_number", "start_pos", "end_pos"),
    "primary_filter": lambda v: v.regions.withColumn("chrom", F.concat("chrom", F.when(F.col("start_pos") % 3 == 0, "_alt").otherwise(""))).where(labels.is_primary(F.col("chrom"))),
    "parse_region": lambda v: v.regions.select(F.concat_ws("-", "chrom", "start_pos", "end_pos").alias("name")).select("name", *labels.parse_region(F.col("name"))),
    "normalize_cell": lambda v: v.sites.select(F.concat(F.lit("/data/"), "sample", F.lit("__"), "sample", F.lit("_"), "cell_no", F.lit(".cov.gz")).alias("raw"), "sample").distinct().select(
        "raw", ids.normalize_cell(F.col("raw"), F.lit("Cohort"), F.col("sample")).alias("barcode"), ids.normalize_cell(F.col("raw"), F.lit("Cohort"), F.col("sample"), False).alias("once"), ids.short_sample(F.col("sample")).alias("short")
    ),
    "canonical_ids": lambda v: v.sites.select(F.concat(F.lit("25110891_"), "sample", F.lit("_Met-"), "cell_no").alias("raw")).distinct().select(
        "raw", ids.canonical_cell_id(F.col("raw")).alias("cell_id"), ids.infer_sample_id(F.col("raw")).alias("sample_id"), ids.response_of(ids.infer_sample_id(F.col("raw"))).alias("response")
    ),
}

_SUBTRACT = "select distinct left_type, chrom, start_pos, end_pos from fx_dmr where raw_p"
ORACLES = {
    "region_mean": f"""with {MERGED_SITES}, {merged_sql("fx_regions", False)}
select sample, cell_no, u.chrom, start_pos as region_start, end_pos as region_end, count(*) as n_sites, round(avg({RATIO}), 6) as mean_ratio
from u join m on u.chrom = m.chrom and pos >= start_pos and pos < end_pos group by all""",
    "region_mean_summary": f"""with {MERGED_SITES}, {merged_sql("fx_regions", False)},
g as (select sample, cell_no, start_pos, u.chrom, count(*) as n from u join m on u.chrom = m.chrom and pos >= start_pos and pos < end_pos group by all),
s as (select sample, count(distinct cell_no) as n_cells, count(*) as covered_values, cast(sum(n) as bigint) as n_sites from g group by all)
select sample, n_cells * (select count(*) from m) as matrix_values, covered_values, round(1 - covered_values / (n_cells * (select count(*) from m)), 6) as missing_fraction, n_sites from s""",
    "scan_sites": "select * from fx_sites where mc >= 0 and uc >= 0 and mc + uc > 0 and pos >= 0",
    "validate_sites": "select sample, cell_no, count(*) as n_rows, count(*) filter (not (mc >= 0 and uc >= 0 and mc + uc > 0 and pos >= 0)) as n_bad from fx_sites group by all",
    "scan_context": "select chrom, cast(sum(mc) as bigint) as mc, cast(sum(mc + uc) as bigint) as cov from fx_sites group by all",
    "cov_to_allc": "select sample, cell_no, chrom, pos, '+' as strand, 'CGN' as context, mc, mc + uc as cov, 1 as flag from fx_sites",
    "cpg_merge": f"with {MERGED_SITES} select *, round({RATIO}, 6) as ratio from u",
    "dup_audit": f"with {AUDIT} select * from checked",
    "dup_audit_total": f"""with {AUDIT}, t as (select count(*) as files, count(*) filter (duplicate_loci > 0) as files_with_duplicates, count(*) filter (not ordering_ok) as unordered_files,
{", ".join(f"cast(sum({c}) as bigint) as {c}" for c in sites.AUDIT_SUMS)} from checked) select metric, value from (unpivot t on columns(*) into name metric value value)""",
    "dedup_prob": f"with {LOCUS} select sample, cell_no, chrom, pos, end_pos, low as prob, mc, uc, line_no from locus where low = high",
    "dedup_stats": f"""with {LOCUS} select sample, cell_no, cast(sum(n) as bigint) as rows_in, count(*) filter (low = high) as rows_out, count(*) filter (n > 1) as duplicate_loci,
count(*) filter (n > 1 and low = high) as same_loci, count(*) filter (n > 1 and low <> high) as different_loci, cast(sum(n - case when low = high then 1 else 0 end) as bigint) as removed, true as holds from locus group by all""",
    "order_audit": f"with {AUDIT} select sample, cell_no, descents, reentries from audit",
    "cell_mcg_level": f"with {LEVELS} select sample, cell_no, n_sites, total_coverage, round(mean_site_level, 6) as mean_site_level, round(overall_level, 6) as overall_level from levels",
    "cell_qc_filter": f"""with {LEVELS} select sample, cell_no, n_sites, total_coverage, round(mean_site_level, 6) as mean_site_level, round(overall_level, 6) as overall_level
from levels where n_sites between 50 and 20000 and overall_level >= 0.4""",
    "make_bins": f"with {BINS} select * from bins",
    "bin_aggregate": f"with {BINNED} select * from binned",
    "cell_depth": f"""with {BINNED} select sample, cell_no, cast(sum(cov) as bigint) as total_coverage, count(*) filter (cov > 0) as covered_bins,
round(sum(cov) / cast(count(*) as double), 6) as mean_coverage, round(ln(1 + sum(cov)), 6) as log1p_coverage from binned group by all""",
    "bin_support": f"with {BINNED} select chrom, bin, count(*) filter (1 - cast(mc as double) / cov > 0.5) as n_cells, count(*) as n_covered from binned group by all",
    "bin_filter": f"with {BINNED} select chrom, bin, count(*) filter (1 - cast(mc as double) / cov > 0.5) as n_cells, count(*) as n_covered from binned group by all having count(*) filter (1 - cast(mc as double) / cov > 0.5) > 6",
    "hypo_threshold": f"""with {BINNED}, s as (select chrom, bin, count(*) filter (1 - cast(mc as double) / cov > 0.5) as n from binned group by all),
t as (select min(a.n) as t from s a where a.n > 0 and (select count(*) from s b where b.n > a.n) <= 60)
select (select count(*) from s where n > 0) as covered, t as threshold, round(cast(t as double) * 100 / 50 + 1e-6, 6) as percent from t""",
    "point_in_interval": f"""with {merged_sql("fx_regions", False)} select sample, cell_no, line_no, m.start_pos as region_start, m.end_pos as region_end
from fx_sites s join m on s.chrom = m.chrom and pos >= start_pos and pos < m.end_pos""",
    "interval_merge_touch": f"with {merged_sql('fx_regions', True)} select * from m",
    "interval_merge_strict": f"with {merged_sql('fx_regions', False)} select * from m",
    "interval_merge_annot": f"""with d as (select sample, left_type, chrom, start_pos * 200 as start_pos, end_pos * 200 - start_pos * 100 as end_pos from fx_dmr),
{merged_sql("d", False, "sample, chrom", extra=", string_agg(distinct left_type, ',' order by left_type) as types")} select * from m""",
    "interval_anti": f"select * from fx_regions a where not exists (select 1 from fx_mask b where {OVERLAP})",
    "interval_semi": f"select * from fx_regions a where exists (select 1 from fx_mask b where {OVERLAP})",
    "interval_blacklist": f"""select * from fx_regions a where not exists (select 1 from fx_mask b where {OVERLAP}
and least(a.end_pos, b.end_pos) - greatest(a.start_pos, b.start_pos) >= cast(0.2 as double) * (a.end_pos - a.start_pos))""",
    "interval_partition": f"""with c as (select count(*) as n_clean from fx_regions a where not exists (select 1 from fx_mask b where {OVERLAP})), t as (select count(*) as n_all from fx_regions)
select n_all, n_clean, n_all - n_clean as n_removed, printf('%.8f', 1 - cast(n_clean as double) / n_all) as removed_fraction from c, t""",
    "interval_consensus": f"""with d as (select distinct sample, left_type, chrom, start_pos, end_pos from fx_dmr where raw_p < 0.05), e as (select sample, chrom, start_pos as place from d union select sample, chrom, end_pos from d),
s as (select sample, chrom, place as start_pos, lead(place) over (partition by sample, chrom order by place) as end_pos from e),
k as (select * from s where end_pos is not null and (select count(distinct left_type) from d where d.sample = s.sample and d.chrom = s.chrom and d.start_pos <= s.start_pos and d.end_pos >= s.end_pos) = 3),
{merged_sql("k", True, "sample, chrom")} select sample, chrom, start_pos, end_pos from m""",
    "mask_union": f"with d as (select * from fx_regions union all select * from fx_mask), {merged_sql('d', True)} select * from m",
    "mask_union_sources": f"""with d as (select *, 'regions' as source from fx_regions union all select *, 'mask' from fx_mask),
{merged_sql("d", True, extra=", count(distinct source) as n_sources, string_agg(distinct source, ',' order by source) as sources")} select * from m""",
    "matched_subtract": f"with x as ({_SUBTRACT} < 0.01), y as ({_SUBTRACT} > 0.195) select * from x a where not exists (select 1 from y b where a.left_type = b.left_type and {OVERLAP})",
    "overlap_guard": "select * from (select *, lag(end_pos) over (partition by chrom order by start_pos, end_pos) as previous_end from fx_regions) where previous_end > start_pos",
    "region_distinct": "select * from fx_regions union select * from fx_mask",
    "chrom_sort": "select *, cast(substr(chrom, 4) as bigint) as chrom_number from fx_regions order by 4, 2, 3",
    "primary_filter": "select * from fx_regions where start_pos % 3 <> 0",
    "parse_region": "select concat_ws('-', chrom, start_pos, end_pos) as name, chrom, start_pos, end_pos from fx_regions",
    "normalize_cell": "select distinct concat('/data/', sample, '__', sample, '_', cell_no, '.cov.gz') as raw, cast(cell_no as varchar) as barcode, concat(sample, '_', cell_no) as once, sample as short from fx_sites",
    "canonical_ids": """select distinct concat('25110891_', sample, '_Met-', cell_no) as raw, concat(sample, '__', cell_no) as cell_id, sample as sample_id, substr(sample, 1, 2) as response from fx_sites""",
}
