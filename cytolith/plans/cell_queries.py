"""Queries over regions, cells, matrices, clusters and expression."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cytolith.functions import labels
from cytolith.operators import annotation, clusters, decomposition, expression, intervals, matrix, neighbours, regions, sites
from cytolith.plans.fixtures import Fixtures
from cytolith.plans.site_queries import BINNED, LEVELS, RATIO, _binned, _rounded
from cytolith.sources import files, sinks

PLACE = "chrom, start_pos, end_pos"
STANDARD = f"""d as (select sample, case when lower_group = 'group_B' then right_type else left_type end as hypo_type,
case when lower_group = 'group_B' then left_type else right_type end as other_type, {PLACE},
case when lower_group = 'group_B' then meth_b else meth_a end as hypo_mean, case when lower_group = 'group_B' then meth_a else meth_b end as other_mean,
abs(meth_a - meth_b) as diff, case when lower_group = 'group_B' then meth_b < meth_a else meth_a < meth_b end as consistent, raw_p, line_no from fx_dmr)"""
HYPO = "raw_p < 0.01 and abs(meth_a - meth_b) >= 0.25"


def _standard(v: Fixtures) -> DataFrame:
    return regions.standardize(v.dmr)


def _standard_rounded(df: DataFrame) -> DataFrame:
    return _rounded(df, "hypo_mean", "other_mean", "diff")


STANDARD_OUT = f"sample, hypo_type, other_type, {PLACE}, round(hypo_mean, 6) as hypo_mean, round(other_mean, 6) as other_mean, round(diff, 6) as diff, consistent, raw_p, line_no"


def _dmr_rounded(df: DataFrame) -> DataFrame:
    return _rounded(df, "meth_a", "meth_b")


DMR_OUT = f"sample, left_type, right_type, {PLACE}, round(meth_a, 6) as meth_a, round(meth_b, 6) as meth_b, lower_group, raw_p, line_no"


def _comparisons(v: Fixtures) -> DataFrame:
    return regions.pairwise_comparisons(v.cells, "sample", "cell_type", 2)


PAIRS = """n as (select sample, cell_type, count(*) as n from fx_cells group by all),
p as (select a.sample, a.cell_type as label_a, a.n as n_a, b.cell_type as label_b, b.n as n_b, case when a.n >= 2 and b.n >= 2 then 'yes' else 'no' end as eligible
from n a join n b on a.sample = b.sample and a.cell_type < b.cell_type)"""


def _metadata(v: Fixtures) -> DataFrame:
    """Annotation of the cells that are no multiple of 7, with empty and missing labels among them."""
    label = F.when(F.col("cell_no") % 5 == 0, "NA").when(F.col("cell_no") % 11 == 0, "").otherwise(F.col("cell_type"))
    return v.cells.where("cell_no % 7 <> 0").select("cell_no", label.alias("label"), "excluded")


METADATA = "a as (select cell_no, case when cell_no % 5 = 0 then 'NA' when cell_no % 11 = 0 then '' else cell_type end as label, excluded from fx_cells where cell_no % 7 <> 0)"


def _annotated(v: Fixtures) -> DataFrame:
    return annotation.annotate_left(v.cells.select("cell_no", "sample", "cell_type"), _metadata(v), ["cell_no"])


ANNOTATED = f"{METADATA}, j as (select c.cell_no, c.sample, c.cell_type, label, a.excluded, a.cell_no is null as missing_annotation from fx_cells c left join a on c.cell_no = a.cell_no)"


def _statuses(v: Fixtures) -> DataFrame:
    ids = v.cells.select("cell_no")
    return annotation.cell_status(ids, ids.where("cell_no % 3 = 0 and cell_no % 7 <> 0"), ids.where("cell_no % 7 <> 0"), "cell_no")


STATUS = "st as (select cell_no, case when cell_no % 3 = 0 and cell_no % 7 <> 0 then 'retained' when cell_no % 7 = 0 then 'clean_list_removed' else 'qc_removed' end as status from fx_cells)"
STATUSES = ("retained", "clean_list_removed", "qc_removed")


def _levels(v: Fixtures) -> DataFrame:
    return sites.cell_levels(v.sites)


def _qc_table(v: Fixtures) -> DataFrame:
    status = F.when(F.col("cell_no") % 3 == 0, "retained").when(F.col("cell_no") % 7 == 0, "clean_list_removed").otherwise("qc_removed")
    return _levels(v).select("sample", annotation.qc_bin(F.col("n_sites"), 20, 60).alias("qc"), status.alias("status"))


QC = f"""{LEVELS}, q as (select sample, case when n_sites < 20 then 'below' when n_sites <= 60 then 'within' else 'above' end as qc,
case when cell_no % 3 = 0 then 'retained' when cell_no % 7 = 0 then 'clean_list_removed' else 'qc_removed' end as status from levels)"""
QC_COLUMNS = ", ".join(f"count(q.qc) filter (status = '{s}') as {s}" for s in STATUSES) + ", count(q.qc) as total"
QC_PERCENT = ", ".join(f"round(case when total > 0 then cast({s} as double) * 100 / total else 0 end, 6) as {s}_percent" for s in STATUSES)


def _contingency(v: Fixtures, by: list[str] | None) -> DataFrame:
    out = annotation.contingency(_qc_table(v), "qc", annotation.BIN_LEVELS, "status", STATUSES, by)
    return _rounded(out, *[f"{s}_percent" for s in STATUSES])


def _depth_by_type(v: Fixtures) -> DataFrame:
    typed = _levels(v).withColumn("cell_type", F.concat(F.lit("T"), F.col("cell_no") % 4))
    return _rounded(annotation.quantile_summary(typed, "total_coverage", ["cell_type"]), "mean", "std", "q25", "median", "q75")


def quantile_sql(value: str) -> str:
    return f"""count({value}) as n, round(avg({value}), 6) as mean, round(stddev_samp({value}), 6) as std, min({value}) as low, max({value}) as high,
round(quantile_cont({value}, 0.25), 6) as q25, round(quantile_cont({value}, 0.5), 6) as median, round(quantile_cont({value}, 0.75), 6) as q75"""


def _values(v: Fixtures) -> DataFrame:
    """Site ratios as a matrix of cells and regions of 100 bases."""
    place = F.concat_ws(":", "chrom", F.floor(F.col("pos") / 100))
    return v.sites.groupBy("sample", "cell_no", place.alias("region")).agg(F.avg(sites.ratio()).alias("value")).withColumn("cell_type", F.concat(F.lit("T"), F.col("cell_no") % 4))


VALUES = f"mx as (select sample, cell_no, concat_ws(':', chrom, pos // 100) as region, avg({RATIO}) as value, concat('T', cell_no % 4) as cell_type from fx_sites group by all)"
MOMENTS = "zm as (select region, count(value) as n, avg(value) as m, stddev_pop(value) as s from mx group by region), z as (select mx.*, case when n >= 10 and s > 0 then (value - m) / s end as z from mx join zm using (region))"


def _z(v: Fixtures) -> DataFrame:
    return matrix.zscore(_values(v), ["region"], least=10)


def _type_means(v: Fixtures) -> DataFrame:
    return matrix.group_means(_values(v), ["region", "cell_type"])


def _supporters(v: Fixtures) -> DataFrame:
    listed = _values(v).select("region", "cell_type").distinct()
    return listed.where(F.ascii(F.right("region", F.lit(1))) % 4 != F.right("cell_type", F.lit(1)).cast("int"))


SUPPORT = f"""{VALUES}, tm as (select region, cell_type, avg(value) as m from mx group by all),
sp as (select distinct region, cell_type from mx where ascii(right(region, 1)) % 4 <> cast(right(cell_type, 1) as int))"""


def _own_region(v: Fixtures) -> DataFrame:
    """Cells whose type has a region assigned to it."""
    assigned = matrix.assign_region_type(_type_means(v), _supporters(v), ["region"])
    return _values(v).select("cell_no", "cell_type").distinct().join(assigned.select("cell_type"), "cell_type", "left_semi")


def _type_sizes(v: Fixtures) -> DataFrame:
    sizes = _values(v).select("region", "cell_type").distinct().groupBy(F.col("cell_type").alias("group")).agg(F.count(F.lit(1)).alias("n"))
    return sizes.withColumn("nth", F.substring("group", 2, 3).cast("int"))


def _display(v: Fixtures) -> DataFrame:
    rows = _values(v).select("region", "cell_type").distinct()
    order = Window.partitionBy("cell_type").orderBy("region")
    indexed = rows.withColumn("index", F.row_number().over(order) - 1).join(matrix.allocate_bins(_type_sizes(v), 40), F.col("cell_type") == F.col("group"))
    bins = indexed.withColumn("bin", matrix.display_bin(F.col("index"), F.col("n_bins"), F.col("n")))
    return bins.groupBy("cell_type", "bin").agg(F.min("index").cast("long").alias("first"), F.max("index").cast("long").alias("last"), F.count(F.lit(1)).alias("n"))


ALLOCATED = f"""{VALUES}, sz as (select cell_type as grp, count(distinct region) as n, cast(substr(cell_type, 2) as int) as nth from mx group by cell_type),
t as (select sum(n) as total, count(*) filter (n > 0) as filled from sz), e as (select sz.*, total, filled, (40 - filled) * cast(n as double) / total as exact from sz, t),
b as (select *, floor(exact) as base from e), o as (select *, row_number() over (order by round(exact - base, 9) desc, nth) as served, 40 - filled - sum(base) over () as rest from b),
al as (select grp, n, cast(case when total <= 40 then n else 1 + base + case when served <= rest then 1 else 0 end end as bigint) as n_bins from o)"""


def _group_of(v: Fixtures) -> DataFrame:
    return v.counts.select("cell_no").distinct().select("cell_no", F.concat(F.lit("G"), F.col("cell_no") % 3).alias("group"))


def _normalized(v: Fixtures) -> DataFrame:
    return expression.normalize_log1p(v.counts, rows=v.rows("fx_counts")).withColumn("value", F.round("value", 9))


def _rank_sum(v: Fixtures) -> DataFrame:
    return _rounded(expression.rank_sum(_normalized(v), _group_of(v), v.rows("fx_counts")), "u", "z")


FILLED_COUNTS = "cl as (select distinct cell_no from fx_counts), ge as (select distinct gene_no from fx_counts), fc as (select cl.cell_no, ge.gene_no, coalesce(c.n, 0) as n from cl cross join ge left join fx_counts c on c.cell_no = cl.cell_no and c.gene_no = ge.gene_no)"
FILLED = "cl as (select distinct cell_no from fx_counts), ge as (select distinct gene_no from fx_counts), fu as (select cl.cell_no, ge.gene_no, coalesce(nm.value, 0) as value from cl cross join ge left join nm on nm.cell_no = cl.cell_no and nm.gene_no = ge.gene_no)"
NORMALIZED = "nt as (select cell_no, sum(n) as t from fx_counts group by cell_no), nm as (select c.cell_no, gene_no, ln(1 + c.n * cast(10000 as double) / t) as value from fx_counts c join nt using (cell_no))"
METRICS = "q as (select cell_no, count(*) filter (n > 0) as n_genes, cast(sum(n) as bigint) as total_counts, round(100 * cast(sum(case when is_mt then n else 0 end) as double) / sum(n), 6) as pct_mt from fx_counts group by cell_no)"


def _metrics(v: Fixtures) -> DataFrame:
    return _rounded(expression.rna_qc_metrics(v.counts), "pct_mt")


def _before_after(v: Fixtures) -> DataFrame:
    """Mean depth and sites per sample over all sites, and over those with more than one read."""

    def measured(stage: str, rows: DataFrame) -> DataFrame:
        means = [F.avg("total_coverage").alias("depth"), F.avg("n_sites").alias("sites")]
        return sites.cell_levels(rows).groupBy("sample").agg(*means).withColumn("stage", F.lit(stage))

    both = measured("before", v.sites).unionByName(measured("after", v.sites.where("mc + uc > 1")))
    return _rounded(annotation.before_after(both, ["sample"], "stage", ["depth", "sites"]), "depth_delta", "sites_delta")


def _knn(v: Fixtures) -> DataFrame:
    found = neighbours.knn(v.table("embeddings").where("vec_id is not null"), "vec_id", "embedding", 5)
    return _rounded(found, "distance").withColumn("rank", F.col("rank").cast("long"))


KNN_SQL = """with e as (select vec_id, cast(embedding as double[]) as v from embeddings),
p as (select a.vec_id as from_id, b.vec_id as to_id, sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda x: (x[1] - x[2]) * (x[1] - x[2])))) as distance from e a join e b on a.vec_id <> b.vec_id),
k as (select *, row_number() over (partition by from_id order by distance, to_id) as rank from p) """

QUERIES = {
    "dmr_standardize": lambda v: _standard_rounded(_standard(v)),
    "dmr_validate": lambda v: regions.validate_records(v.dmr, ["sample", "left_type"]),
    "hypo_filter": lambda v: _dmr_rounded(regions.select_hypo(v.dmr)),
    "response_filter": lambda v: _dmr_rounded(regions.select_response(v.dmr)),
    "response_filter_summary": lambda v: regions.response_summary(v.dmr, ["sample", "left_type"]),
    "q_filter": lambda v: regions.select_q(v.dmr.withColumn("q", F.when(F.col("start_pos") % 3 == 0, "NA").otherwise(F.col("raw_p").cast("string"))), "q").select("sample", "chrom", "start_pos", "line_no"),
    "best_per_interval": lambda v: _standard_rounded(regions.best_per_interval(_standard(v))),
    "topn_intervals": lambda v: _standard_rounded(regions.top_intervals(_standard(v), 20)),
    "hypo_summary": lambda v: _rounded(regions.hypo_summary(regions.standardize(regions.select_hypo(v.dmr))), "max_diff"),
    "region_sources": lambda v: _rounded(regions.region_sources(regions.standardize(regions.select_response(v.dmr))), "max_diff"),
    "opponents": lambda v: regions.opponents(v.dmr),
    "pairwise_comparisons": _comparisons,
    "group_membership": lambda v: regions.group_membership(v.cells, _comparisons(v), "sample", "cell_type"),
    "comparison_summary": lambda v: regions.comparison_summary(_comparisons(v), v.dmr),
    "fdr_fallback": lambda v: regions.without_null_fdr(v.dmr.withColumn("adjusted_p", F.col("raw_p") * 2), F.col("start_pos") > 298, ["sample", "left_type", "chrom"]).select("line_no", F.round("adjusted_p", 6).alias("adjusted_p")),
    "annotate_left": _annotated,
    "annotate_overlay": lambda v: _annotated(v).select("cell_no", annotation.overlay(F.lit("Unknown"), F.col("cell_type"), labels.clean_label(F.col("label"))).alias("cell_type")),
    "label_clean": lambda v: _metadata(v).select("cell_no", labels.clean_label(F.col("label")).alias("label")),
    "parse_bool": lambda v: v.cells.select("cell_no", labels.parse_bool(F.when(F.col("cell_no") % 3 == 0, " TRUE").when(F.col("cell_no") % 3 == 1, "n").otherwise("")).alias("flag")),
    "exclusion_reason": lambda v: _annotated(v).select("cell_no", annotation.exclusion_reason(F.col("missing_annotation"), F.coalesce("excluded", F.lit(False)), F.col("cell_type") == "T0").alias("reason")),
    "annotation_stats": lambda v: _annotated(v).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(~F.col("missing_annotation")).alias("matched"), F.count_if("missing_annotation").alias("unmatched"),
        F.count_if(F.coalesce("excluded", F.lit(False))).alias("n_excluded"), F.count_distinct("sample").alias("n_samples"),
    ),
    "dup_keys": lambda v: annotation.duplicate_keys(v.sites, ["sample", "cell_no", "chrom", "pos"]),
    "conflict_check": lambda v: annotation.conflicting_values(v.sites, ["sample", "cell_no", "chrom", "pos"], "mc"),
    "cell_status": _statuses,
    "cardinality_check": lambda v: annotation.cardinality(v.cells, "cell_no", v.table("customer").count(), "sample"),
    "keep_cells": lambda v: v.cells.join(v.clusters.select(F.col("vec_id").alias("cell_no")), "cell_no", "left_semi"),
    "set_diff": lambda v: annotation.set_difference(v.cells, v.counts, "cell_no"),
    "set_intersect": lambda v: v.cells.select("cell_no").intersect(v.counts.select("cell_no")),
    "union_all": lambda v: v.regions.unionByName(v.mask),
    "meta_summary": lambda v: v.cells.groupBy("sample", "cell_type", F.when(F.col("cell_no") % 5 != 0, F.col("excluded")).alias("excluded")).agg(F.count(F.lit(1)).alias("n")),
    "qc_bins": lambda v: _levels(v).select("sample", "cell_no", annotation.qc_bin(F.col("n_sites"), 20, 60).alias("qc")),
    "qc_contingency": lambda v: _contingency(v, None),
    "qc_contingency_sample": lambda v: _contingency(v, ["sample"]),
    "crosstab_counts": lambda v: annotation.crosstab(v.cells, "sample", "cell_type", ["T0", "T1", "T2", "T3"]),
    "crosstab_props": lambda v: _rounded(annotation.shares(v.cells, "sample", "cell_type"), "share"),
    "type_counts": lambda v: _rounded(annotation.value_counts(v.cells, "cell_type"), "share"),
    "cells_by_response": lambda v: v.cells.groupBy(F.substring("sample", 1, 2).alias("response"), "cell_type").agg(F.count(F.lit(1)).alias("n")),
    "depth_by_type": _depth_by_type,
    "depth_by_status": lambda v: _rounded(annotation.quantile_summary(_levels(v).join(_statuses(v), "cell_no"), "n_sites", ["status"]), "mean", "std", "q25", "median", "q75"),
    "metric_quantiles": lambda v: _rounded(annotation.quantile_summary(_levels(v), "overall_level", ["sample"]), "mean", "std", "low", "high", "q25", "median", "q75"),
    "before_after_delta": _before_after,
    "target_codes": lambda v: annotation.target_codes(_metadata(v), "label").select("cell_no", F.col("code").cast("long").alias("code")),
    "zscore": lambda v: _rounded(_z(v), "value", "z"),
    "zscore_maxabs": lambda v: _rounded(matrix.maxabs_scale(_z(v), ["sample"]), "scaled").select("sample", "cell_no", "region", "scaled"),
    "dmr_type_means": lambda v: _rounded(_type_means(v), "mean_value"),
    "type_mean_zscore": lambda v: _rounded(matrix.zscore(matrix.group_means(_values(v), ["sample", "cell_no", "cell_type"]), ["cell_type"], "mean_value", 2), "mean_value", "z"),
    "feature_qc": lambda v: matrix.feature_qc(_values(v), ["region"]),
    "dmr_assign": lambda v: _rounded(matrix.assign_region_type(_type_means(v), _supporters(v), ["region"]), "hypo_difference"),
    "own_dmr_filter": _own_region,
    "bin_allocation": lambda v: matrix.allocate_bins(_type_sizes(v), 40),
    "display_bins": _display,
    "label_runs": lambda v: matrix.label_runs(v.clusters, [], "vec_id", "cluster_a", 64).drop("run"),
    "unpivot_matrix": lambda v: matrix.to_long(annotation.crosstab(v.cells, "sample", "cell_type", ["T0", "T1", "T2", "T3"]), ["sample"]),
    "validate_counts": lambda v: _binned(v).agg(F.count_if(~((F.col("mc") >= 0) & (F.col("mc") <= F.col("cov")))).alias("n_bad"), F.max("cov").alias("max_cov")).withColumn("kind", F.when(F.col("max_cov") <= 65535, "uint16").otherwise("uint32")),
    "rna_qc_metrics": _metrics,
    "rna_qc_filter": lambda v: expression.rna_qc_filter(_metrics(v), 20, 6000, 5.0),
    "rna_qc_counts": lambda v: expression.rna_qc_counts(_metrics(v), 20, 6000, 5.0),
    "gene_filter": lambda v: expression.gene_filter(v.counts),
    "normalize_log1p": lambda v: _rounded(expression.normalize_log1p(v.counts), "value"),
    "scale_clip": lambda v: _rounded(expression.scale_clip(expression.normalize_log1p(v.counts)), "scaled", "scaled_zero"),
    "hvg_moments": lambda v: _rounded(expression.gene_moments(v.counts), "mean", "variance"),
    "hvg_top": lambda v: _rounded(expression.top_variable(v.counts, 200), "dispersion"),
    "wilcoxon_rank": _rank_sum,
    "topk_both_ends": lambda v: _rounded(expression.top_both_ends(_rank_sum(v).where("z is not null"), ["group"], "z", "gene_no", 5), "z").withColumn("nth", F.col("nth").cast("long")),
    "dotplot_stats": lambda v: _rounded(expression.dotplot(expression.normalize_log1p(v.counts), _group_of(v)), "mean_value", "fraction"),
    "cluster_purity": lambda v: _rounded(clusters.purity(v.clusters, "cluster_a", "cluster_b"), "purity"),
    "cluster_entropy": lambda v: _rounded(clusters.entropy(v.clusters, "cluster_a", "cluster_b"), "entropy"),
    "ari": lambda v: _rounded(clusters.adjusted_rand(v.clusters, "cluster_a", "cluster_b"), "ari"),
    "cluster_majority": lambda v: _rounded(clusters.majority(v.clusters, "cluster_a", "cluster_b"), "share"),
    "cluster_composition": lambda v: _rounded(annotation.shares(v.clusters, "cluster_a", "cluster_b"), "share"),
    "knn_exact": _knn,
    "knn_edges": lambda v: _rounded(clusters.knn_edges(_knn(v)), "weight"),
}

RESIDUALS = f"""sv as (select chrom, pos, cell_no, avg({RATIO}) as ratio from fx_sites group by all), sm as (select chrom, pos, avg(ratio) as site_mean from sv group by all),
sr as (select sv.*, ratio - site_mean as r from sv join sm using (chrom, pos)), wd as (select *, unnest(range(greatest(0, (pos - 100) // 50 + 1), pos // 50 + 1)) * 50 as start_pos from sr where pos >= 100
union all select *, unnest(range(0, pos // 50 + 1)) * 50 from sr where pos < 100),
wc as (select chrom, start_pos, cell_no, sum(r) / (count(*) + 1) as r from wd group by all)"""


def _site_values(v: Fixtures) -> DataFrame:
    return v.sites.groupBy("chrom", "pos", "cell_no").agg(F.avg(sites.ratio()).alias("ratio"))


def _sample_sizes(v: Fixtures) -> DataFrame:
    return v.cells.groupBy("sample").agg(F.count(F.lit(1)).alias("n_cells"))


def _overrides(v: Fixtures) -> DataFrame:
    return v.cells.where("sample = 'IR02'").select("sample", F.lit(0.07).alias("rate")).distinct()


QUERIES |= {
    "annotation_match": lambda v: _rounded(annotation.match_statistics(v.counts.select("cell_no").distinct(), v.cells.withColumns({"cell_no": F.col("cell_no") * 2, "cell_type": F.nullif("cell_type", F.lit("T2"))}), "cell_no", "cell_type", "excluded"), "match_rate"),
    "join_complete": lambda v: annotation.complete_join(v.clusters.select(F.col("vec_id").alias("cell_no"), "cluster_a"), v.clusters.select(F.col("vec_id").alias("cell_no"), "cluster_b"), "cell_no"),
    "cluster_status": lambda v: annotation.annotate_clusters(v.clusters, {str(i): f"T{i}" for i in range(6)}, "cluster_a", ("T1", "T4", "Unknown")),
    "stage_counts": lambda v: annotation.stage_counts(regions.comparison_summary(_comparisons(v), v.dmr), ["sample"], "status", ("complete", "partial", "pending", "ineligible")),
    "dmr_fallback": lambda v: regions.fallback_validity(
        v.dmr.withColumn("adjusted_p", F.when(F.col("line_no") % 3001 == 0, "0.5").otherwise("NA")).withColumn("raw_p", F.when(F.col("start_pos") == 299, "-1").otherwise(F.col("raw_p").cast("string"))), ["sample", "left_type"]
    ),
    "derive_group": lambda v: v.cells.select("cell_no", annotation.derive_group(F.col("sample")).alias("condition")),
    "meta_validate": lambda v: annotation.validate_metadata(
        v.cells.select(F.concat(F.lit(" S"), F.col("cell_no") - (F.col("cell_no") % 10 == 0).cast("int")).alias("s"), F.when(F.col("cell_no") % 7 == 0, "xx").otherwise(F.lower(F.substring("sample", 1, 2))).alias("g")), "s", "g", ("IR", "NR")
    ),
    "json_get": lambda v: v.cells.select("cell_no", annotation.json_value(F.when(F.col("cell_no") % 3 == 0, F.to_json(F.struct(F.col("cell_type").alias("t")))).otherwise("{}"), "$.t", "none").alias("value")),
    "response_split": lambda v: v.cells.groupBy(annotation.derive_group(F.col("sample")).alias("response")).agg(F.count(F.lit(1)).alias("n_cells"), F.count_distinct("sample").alias("n_samples")),
    "cluster_full_outer": lambda v: annotation.full_outer(
        v.clusters.select((F.col("vec_id") * 2).alias("cell_no"), F.concat(F.lit("C"), "cluster_b").alias("cluster")), v.cells.select("cell_no", "cell_type"), ["cell_no"], {"cluster": "none", "cell_type": "unknown"}
    ),
    "cell_plot_order": lambda v: annotation.plot_order(v.cells.select("cell_no", F.when(F.col("cell_no") % 2 == 0, F.lower("cell_type")).otherwise(F.col("cell_type")).alias("label")), "label", "cell_no").withColumn("place", F.col("place").cast("long")),
    "keep_features": lambda v: _rounded(annotation.keep_features(_values(v).select("cell_no", "region", "value"), _values(v).where("region like 'chr1:%'").select("region"), "region"), "value"),
    "dtype_choice": lambda v: v.counts.groupBy("is_mt").agg(F.max("n").alias("largest")).withColumn("kind", annotation.count_kind(F.col("largest"))),
    "doublet_rate": lambda v: _rounded(expression.doublet_rate(_sample_sizes(v), _overrides(v)), "rate"),
    "doublet_fill": lambda v: _rounded(
        expression.fill_doublets(_metrics(v), _metrics(v).where("cell_no % 4 <> 0").select("cell_no", (F.col("n_genes") / 1000).alias("score"), (F.col("n_genes") % 2 == 0).alias("predicted")), 20), "score"
    ),
    "concat_outer": lambda v: expression.concat_outer(v.counts.where("cell_no % 2 = 1"), v.counts.where("cell_no % 2 = 0")),
    "marker_available": lambda v: expression.available_markers(v.table("part").select(F.concat(F.lit("T"), F.col("p_partkey") % 6).alias("cell_type"), F.col("p_partkey").alias("gene_no")), v.counts, v.cells),
    "window_variance": lambda v: _rounded(regions.window_variance(_site_values(v), 100, 50, 6), "variance"),
    "welch_t": lambda v: _rounded(regions.welch_t(_values(v).withColumn("response", F.substring("sample", 1, 2)), "response", ("IR", "NR"), ["region"]), "t"),
}

_SHARE = "select {0}, {1}, count(*) as n, round(cast(count(*) as double) / sum(count(*)) over (partition by {0}), 6) as share from {2} group by {0}, {1}"
ORACLES = {
    "dmr_standardize": f"with {STANDARD} select {STANDARD_OUT} from d",
    "dmr_validate": "select sample, left_type, count(*) as n_rows, bool_and(start_pos >= 0 and end_pos > start_pos and raw_p >= 0) as valid from fx_dmr group by all",
    "hypo_filter": f"select {DMR_OUT} from fx_dmr where {HYPO}",
    "response_filter": f"select {DMR_OUT} from fx_dmr where raw_p < 0.05 and abs(meth_a - meth_b) > 0.3",
    "response_filter_summary": "select sample, left_type, count(*) as total, count(*) filter (raw_p < 0.05) as p_pass, count(*) filter (raw_p < 0.05 and abs(meth_a - meth_b) > 0.3) as selected from fx_dmr group by all",
    "q_filter": "select sample, chrom, start_pos, line_no from fx_dmr where start_pos % 3 = 0 or raw_p < 0.05",
    "best_per_interval": f"""with {STANDARD} select {STANDARD_OUT} from d
qualify row_number() over (partition by sample, hypo_type, {PLACE} order by d.diff desc, raw_p, lower(other_type), line_no) = 1""",
    "topn_intervals": f"""with {STANDARD}, b as (select sample, hypo_type, {PLACE}, min((-diff, raw_p)) as best from d group by all),
k as (select * from b qualify row_number() over (partition by sample, hypo_type order by best, chrom, start_pos, end_pos) <= 20)
select {STANDARD_OUT} from d where (sample, hypo_type, {PLACE}) in (select (sample, hypo_type, {PLACE}) from k)""",
    "hypo_summary": f"""with {STANDARD} select sample, hypo_type, count(*) as n_records, count(distinct ({PLACE})) as n_intervals, count(distinct other_type) as n_opponents,
count(*) filter (not consistent) as n_mismatches, round(max(diff), 6) as max_diff, min(raw_p) as min_p from d where raw_p < 0.01 and diff >= 0.25 group by all""",
    "region_sources": f"""with {STANDARD} select {PLACE}, string_agg(distinct hypo_type, ',' order by hypo_type) as types, string_agg(distinct sample, ',' order by sample) as samples,
count(*) as n_rows, min(raw_p) as min_p, round(max(diff), 6) as max_diff from d where raw_p < 0.05 and diff > 0.3 group by {PLACE}""",
    "opponents": """select sample, t as cell_type, string_agg(distinct o, ',' order by o) as opponents
from (select sample, left_type as t, right_type as o from fx_dmr union all select sample, right_type, left_type from fx_dmr) group by all""",
    "pairwise_comparisons": f"with {PAIRS} select * from p",
    "group_membership": f"""with {PAIRS} select c.sample, cell_no, label_a, label_b, case when cell_type = label_a then 'group_A' when cell_type = label_b then 'group_B' else '-' end as membership
from fx_cells c join p on c.sample = p.sample""",
    "comparison_summary": f"""with {PAIRS}, h as (select sample, left_type, right_type, count(*) as total, count(*) filter (raw_p < 0.05) as n_p05 from fx_dmr group by all)
select p.sample, label_a, label_b, coalesce(total, 0) as total, coalesce(n_p05, 0) as n_p05, case when eligible = 'no' then 'ineligible' when total is null then 'pending' else 'complete' end as status
from p left join h on p.sample = h.sample and label_a = left_type and label_b = right_type""",
    "fdr_fallback": "select line_no, round(case when count(*) filter (start_pos > 298) over (partition by sample, left_type, chrom) > 0 then raw_p * 2 end, 6) as adjusted_p from fx_dmr",
    "annotate_left": f"with {ANNOTATED} select * from j",
    "annotate_overlay": f"with {ANNOTATED} select cell_no, case when label is null or label in ('', 'NA') then cell_type else label end as cell_type from j",
    "label_clean": f"with {METADATA} select cell_no, case when label not in ('', 'NA') then label end as label from a",
    "parse_bool": "select cell_no, cell_no % 3 = 0 as flag from fx_cells",
    "exclusion_reason": f"""with {ANNOTATED} select cell_no, concat_ws(';', case when missing_annotation then 'missing' end, case when excluded then 'annotation' end, case when cell_type = 'T0' then 'celltype' end) as reason from j""",
    "annotation_stats": f"with {ANNOTATED} select count(*) as n_rows, count(*) filter (not missing_annotation) as matched, count(*) filter (missing_annotation) as unmatched, count(*) filter (excluded) as n_excluded, count(distinct sample) as n_samples from j",
    "dup_keys": "select sample, cell_no, chrom, pos, count(*) as n from fx_sites group by all having count(*) > 1",
    "conflict_check": "select sample, cell_no, chrom, pos, count(distinct mc) as n_values from fx_sites group by all having count(distinct mc) > 1",
    "cell_status": f"with {STATUS} select * from st",
    "cardinality_check": "select count(*) as n_rows, count(distinct cell_no) as n_keys, count(distinct sample) as n_samples, count(*) = count(distinct cell_no) and count(*) = (select count(*) from customer) as holds from fx_cells",
    "keep_cells": "select * from fx_cells where cell_no in (select vec_id from fx_clusters)",
    "set_diff": """select cell_no, 'left' as side from fx_cells where cell_no not in (select cell_no from fx_counts)
union all select distinct cell_no, 'right' from fx_counts where cell_no not in (select cell_no from fx_cells)""",
    "set_intersect": "select cell_no from fx_cells intersect select cell_no from fx_counts",
    "union_all": "select * from fx_regions union all select * from fx_mask",
    "meta_summary": "select sample, cell_type, case when cell_no % 5 <> 0 then excluded end as excluded, count(*) as n from fx_cells group by all",
    "qc_bins": f"with {QC[: QC.index(', q as')]} select sample, cell_no, case when n_sites < 20 then 'below' when n_sites <= 60 then 'within' else 'above' end as qc from levels",
    "qc_contingency": f"""with {QC}, lv as (select unnest(['below', 'within', 'above']) as qc), c as (select lv.qc, {QC_COLUMNS} from lv left join q on lv.qc = q.qc group by lv.qc)
select *, {QC_PERCENT} from c""",
    "qc_contingency_sample": f"""with {QC}, lv as (select * from (select distinct sample from q), (select unnest(['below', 'within', 'above']) as qc)),
c as (select lv.sample, lv.qc, {QC_COLUMNS} from lv left join q on lv.qc = q.qc and lv.sample = q.sample group by lv.sample, lv.qc) select *, {QC_PERCENT} from c""",
    "crosstab_counts": 'select sample, ' + ", ".join(f"count(*) filter (cell_type = 'T{i}') as T{i}" for i in range(4)) + " from fx_cells group by sample",
    "crosstab_props": _SHARE.format("sample", "cell_type", "fx_cells"),
    "type_counts": "select cell_type, count(*) as n, round(cast(count(*) as double) / sum(count(*)) over (), 6) as share from fx_cells group by cell_type",
    "cells_by_response": "select substr(sample, 1, 2) as response, cell_type, count(*) as n from fx_cells group by all",
    "depth_by_type": f"with {LEVELS} select concat('T', cell_no % 4) as cell_type, {quantile_sql('total_coverage')} from levels group by 1",
    "depth_by_status": f"with {LEVELS}, {STATUS} select status, {quantile_sql('n_sites')} from levels join st using (cell_no) group by 1",
    "metric_quantiles": f"with {LEVELS} select sample, {quantile_sql('overall_level').replace('min(overall_level) as low, max(overall_level) as high', 'round(min(overall_level), 6) as low, round(max(overall_level), 6) as high')} from levels group by 1",
    "before_after_delta": """with c as (select sample, cell_no, sum(mc + uc) as d, count(*) as n, sum(mc + uc) filter (mc + uc > 1) as d2, count(*) filter (mc + uc > 1) as n2 from fx_sites group by all)
select sample, round(avg(d2) - avg(d), 6) as depth_delta, round(avg(case when n2 > 0 then n2 end) - avg(n), 6) as sites_delta from c group by sample""",
    "target_codes": f"""with {METADATA}, k as (select distinct label from a where lower(trim(label)) not in ('', 'unknown', 'unannotated', 'nan')), c as (select label, row_number() over (order by label) - 1 as code from k)
select cell_no, coalesce(code, -1) as code from a left join c using (label)""",
    "zscore": f"with {VALUES}, {MOMENTS} select sample, cell_no, region, round(value, 6) as value, cell_type, round(z, 6) as z from z",
    "zscore_maxabs": f"with {VALUES}, {MOMENTS}, sc as (select sample, max(abs(z)) as s from z group by sample) select sample, cell_no, region, round(case when s > 0 then z / s else z end, 6) as scaled from z join sc using (sample)",
    "dmr_type_means": f"with {VALUES} select region, cell_type, round(avg(value), 6) as mean_value, count(value) as n_values from mx group by all",
    "type_mean_zscore": f"""with {VALUES}, c as (select sample, cell_no, cell_type, avg(value) as m, count(value) as n_values from mx group by all),
t as (select cell_type, count(*) as n, avg(m) as a, stddev_pop(m) as s from c group by all)
select c.sample, c.cell_no, cell_type, round(m, 6) as mean_value, n_values, round(case when n >= 2 and s > 0 then (m - a) / s end, 6) as z from c join t using (cell_type)""",
    "feature_qc": f"""with {VALUES} select region, count(value) as n_values, count(value) = 0 as all_null, count(value) < 2 or min(value) = max(value) as zero_variance,
not (count(value) < 2 or min(value) = max(value)) as retained from mx group by region""",
    "dmr_assign": f"""with {SUPPORT}, s as (select region, count(sp.cell_type) as n, min(sp.cell_type) as one from (select distinct region from tm) left join sp using (region) group by region),
o as (select sp.region, tm.cell_type, m, min(m) over (partition by sp.region) as low from sp join tm using (region, cell_type)),
w as (select region, count(*) filter (m <= low + 1e-12) as ties, min(cell_type) filter (m <= low + 1e-12) as best from o group by region),
r as (select region, case when n = 1 then one when ties = 1 then best else 'Unresolved' end as cell_type,
case when n = 0 then 'unsupported' when n = 1 then 'single' when coalesce(ties, 0) = 0 then 'unobserved' when ties > 1 then 'tie' else 'lowest' end as rule from s left join w using (region))
select region, cell_type, rule, round((select min(m) from tm where tm.region = r.region and tm.cell_type <> r.cell_type) - (select min(m) from tm where tm.region = r.region and tm.cell_type = r.cell_type), 6) as hypo_difference from r""",
    "bin_allocation": f'with {ALLOCATED} select grp as "group", n, n_bins from al',
    "display_bins": f"""with {ALLOCATED}, ix as (select cell_type, row_number() over (partition by cell_type order by region) - 1 as i from (select distinct region, cell_type from mx)),
bb as (select cell_type, i, least(n_bins - 1, i * n_bins // n) as bin from ix join al on cell_type = grp) select cell_type, bin, min(i) as first, max(i) as last, count(*) as n from bb group by all""",
    "label_runs": """with l as (select *, case when lag(cluster_a) over (order by vec_id) = cluster_a then 0 else 1 end as new from fx_clusters), r as (select *, sum(new) over (order by vec_id rows unbounded preceding) as run from l)
select cluster_a, min(vec_id) as first, max(vec_id) as last, count(*) as n from r group by run, cluster_a""",
    "unpivot_matrix": """select sample, 'T' || t as cell, count(*) filter (cell_type = 'T' || t) as value from fx_cells, (select unnest(['0', '1', '2', '3']) as t) group by sample, t""",
    "validate_counts": f"with {BINNED} select count(*) filter (not (mc >= 0 and mc <= cov)) as n_bad, max(cov) as max_cov, case when max(cov) <= 65535 then 'uint16' else 'uint32' end as kind from binned",
    "rna_qc_metrics": f"with {METRICS} select * from q",
    "rna_qc_filter": f"with {METRICS} select * from q where n_genes between 20 and 6000 and pct_mt < 5",
    "rna_qc_counts": f"""with {METRICS} select count(*) as n_in, count(*) filter (n_genes < 20) as few_genes, count(*) filter (n_genes > 6000) as many_genes, count(*) filter (pct_mt >= 5) as high_mt,
count(*) filter (n_genes between 20 and 6000 and pct_mt < 5) as n_out, round(100 * avg(case when n_genes between 20 and 6000 and pct_mt < 5 then 1.0 else 0.0 end), 2) as kept_percent from q""",
    "gene_filter": "select gene_no, count(distinct cell_no) as n_cells from fx_counts where n > 0 group by gene_no having count(distinct cell_no) >= 3",
    "normalize_log1p": f"with {NORMALIZED} select cell_no, gene_no, round(value, 6) as value from nm",
    "scale_clip": f"""with {NORMALIZED}, {FILLED}, g as (select gene_no, avg(value) as m, stddev_samp(value) as s from fu group by gene_no)
select cell_no, gene_no, round(least(case when s > 0 then (value - m) / s else 0 end, 10), 6) as scaled, round(least(case when s > 0 then -m / s else 0 end, 10), 6) as scaled_zero from nm join g using (gene_no)""",
    "hvg_moments": f"with {FILLED_COUNTS} select gene_no, round(avg(n), 6) as mean, round(var_samp(n), 6) as variance, count(*) filter (n > 0) as n_cells from fc group by gene_no",
    "hvg_top": f"""with {FILLED_COUNTS} select gene_no, round(var_samp(n) / avg(n), 6) as dispersion, row_number() over (order by var_samp(n) / avg(n) desc, gene_no) as rank
from fc group by gene_no order by rank limit 200""",
    "dotplot_stats": f"""with {NORMALIZED}, {FILLED} select concat('G', cell_no % 3) as "group", gene_no, round(avg(value), 6) as mean_value, round(avg(case when value > 0 then 1.0 else 0.0 end), 6) as fraction from fu group by 1, 2""",
    "cluster_purity": "with c as (select cluster_a, cluster_b, count(*) as n from fx_clusters group by all), m as (select cluster_a, max(n) as b, sum(n) as n from c group by all) select round(cast(sum(b) as double) / sum(n), 6) as purity from m",
    "cluster_entropy": """with c as (select cluster_a, cluster_b, count(*) as n, cast(count(*) as double) / sum(count(*)) over (partition by cluster_a) as p from fx_clusters group by cluster_a, cluster_b),
m as (select cluster_a, sum(n) as n, -sum(p * ln(p)) as h from c group by all), k as (select count(distinct cluster_b) as k from fx_clusters), t as (select sum(n * h) / sum(n) as h from m) select round(h / ln(k), 6) as entropy from t, k""",
    "ari": """with c as (select cluster_a, cluster_b, cast(count(*) as double) as n from fx_clusters group by all), j as (select sum(n * (n - 1) / 2) as j, sum(n) as t from c),
a as (select sum(n * (n - 1) / 2) as a from (select sum(n) as n from c group by cluster_a)), b as (select sum(n * (n - 1) / 2) as b from (select sum(n) as n from c group by cluster_b))
select round((j - a * b / (t * (t - 1) / 2)) / ((a + b) / 2 - a * b / (t * (t - 1) / 2)), 6) as ari from j, a, b""",
    "cluster_majority": f"select * from ({_SHARE.format('cluster_a', 'cluster_b', 'fx_clusters')}) qualify row_number() over (partition by cluster_a order by n desc, cluster_b) = 1",
    "cluster_composition": _SHARE.format("cluster_a", "cluster_b", "fx_clusters"),
    "knn_exact": KNN_SQL + "select from_id, to_id, round(distance, 6) as distance, rank from k where rank <= 5",
    "knn_edges": KNN_SQL + "select from_id, to_id, round(1 / (1 + round(distance, 6)), 6) as weight from k where rank <= 5",
}
ORACLES["own_dmr_filter"] = "with asg as (" + ORACLES["dmr_assign"] + ") select distinct cell_no, concat('T', cell_no % 4) as cell_type from fx_sites where concat('T', cell_no % 4) in (select cell_type from asg)"
_RANKED = f"""with {NORMALIZED}, {FILLED}, g as (select gene_no, concat('G', cell_no % 3) as grp, round(value, 9) as value from fu),
r as (select gene_no, grp, rank() over (partition by gene_no order by value) + (count(*) over (partition by gene_no, value) - 1) / cast(2 as double) as r, count(*) over (partition by gene_no) as n from g),
w as (select gene_no, grp, sum(r) as w, count(*) as n1, max(n) as n from r group by all),
z as (select gene_no, grp as "group", n1, round(w - n1 * (n1 + 1) / cast(2 as double), 6) as u, round(case when n > n1 then (w - n1 * (n1 + 1) / cast(2 as double) - n1 * (n - n1) / cast(2 as double)) / sqrt(n1 * (n - n1) * (n + 1) / cast(12 as double)) end, 6) as z from w)"""
ORACLES["wilcoxon_rank"] = _RANKED + " select * from z"
ORACLES["topk_both_ends"] = _RANKED + """, h as (select "group", gene_no, z, row_number() over (partition by "group" order by z desc, gene_no) as hi, row_number() over (partition by "group" order by z, gene_no) as lo from z where z is not null)
select "group", gene_no, z, hi as nth, 'high' as side from h where hi <= 5 union all select "group", gene_no, z, lo, 'low' from h where lo <= 5"""

ORACLES |= {
    "annotation_match": """with c as (select distinct cell_no from fx_counts), a as (select cell_no * 2 as cell_no, nullif(cell_type, 'T2') as cell_type, excluded from fx_cells)
select count(*) as n_cells, count(a.cell_no) as n_matched, count(*) - count(a.cell_no) as n_unmatched, round(cast(count(a.cell_no) as double) / count(*), 6) as match_rate, count(a.cell_type) as n_labelled,
count(*) filter (a.excluded) as n_excluded, count(*) filter (not a.excluded) as n_retained, (select count(*) from a) as annotation_rows from c left join a on a.cell_no = c.cell_no""",
    "join_complete": "select vec_id as cell_no, cluster_a, cluster_b from fx_clusters",
    "cluster_status": """with n as (select *, case when cluster_a between 0 and 5 then concat('T', cluster_a) else 'Unknown' end as cell_type from fx_clusters)
select *, cell_type in ('T1', 'T4', 'Unknown') as excluded, case when cell_type in ('T1', 'T4', 'Unknown') then 'Exclude' else 'Keep' end as status from n""",
    "stage_counts": "with cs as (" + ORACLES["comparison_summary"] + """) select sample, count(*) as n, count(*) filter (status = 'complete') as complete, count(*) filter (status = 'partial') as partial,
count(*) filter (status = 'pending') as pending, count(*) filter (status = 'ineligible') as ineligible, cast(0 as bigint) as other, count(*) = count(*) filter (status = 'complete') as all_done from cs group by sample""",
    "dmr_fallback": """select sample, left_type, count(*) as n_records, count(*) filter (line_no % 3001 = 0 or start_pos = 299) as n_bad, count(*) filter (line_no % 3001 = 0 or start_pos = 299) = 0 as valid from fx_dmr group by all""",
    "derive_group": "select cell_no, substr(sample, 1, 2) as condition from fx_cells",
    "meta_validate": """with m as (select concat('S', case when cell_no % 10 = 0 then cell_no - 1 else cell_no end) as sample_id, case when cell_no % 7 = 0 then 'XX' else substr(sample, 1, 2) end as condition from fx_cells)
select sample_id, condition, condition in ('IR', 'NR') and count(*) over (partition by sample_id) = 1 as valid from m""",
    "json_get": "select cell_no, case when cell_no % 3 = 0 then cell_type else 'none' end as value from fx_cells",
    "response_split": "select substr(sample, 1, 2) as response, count(*) as n_cells, count(distinct sample) as n_samples from fx_cells group by 1",
    "cluster_full_outer": """with a as (select vec_id * 2 as cell_no, concat('C', cluster_b) as cluster from fx_clusters)
select coalesce(a.cell_no, c.cell_no) as cell_no, coalesce(cluster, 'none') as cluster, coalesce(cell_type, 'unknown') as cell_type from a full join fx_cells c on a.cell_no = c.cell_no""",
    "cell_plot_order": """with l as (select cell_no, case when cell_no % 2 = 0 then lower(cell_type) else cell_type end as label from fx_cells)
select cell_no, label, row_number() over (order by lower(label), cell_no) - 1 as place from l""",
    "keep_features": f"with {VALUES} select cell_no, region, round(value, 6) as value from mx where region like 'chr1:%'",
    "dtype_choice": "select is_mt, max(n) as largest, case when max(n) <= 65535 then 'uint16' else 'uint32' end as kind from fx_counts group by is_mt",
    "doublet_rate": "select sample, count(*) as n_cells, case when sample = 'IR02' then 0.07 else round(0.004 * count(*) / 1000, 6) end as rate from fx_cells group by sample",
    "doublet_fill": f"""with {METRICS} select cell_no, case when n_genes >= 20 and cell_no % 4 <> 0 then round(cast(n_genes as double) / 1000, 6) end as score,
n_genes >= 20 and cell_no % 4 <> 0 and n_genes % 2 = 0 as predicted from q""",
    "concat_outer": "select cell_no, gene_no, n, count(distinct cell_no % 2) over (partition by gene_no) = 2 as in_both from fx_counts",
    "marker_available": "select concat('T', p_partkey % 6) as cell_type, p_partkey as gene_no from part where p_partkey in (select gene_no from fx_counts) and concat('T', p_partkey % 6) in (select cell_type from fx_cells)",
    "window_variance": f"with {RESIDUALS} select chrom, start_pos, count(*) as n_cells, round(var_samp(r), 6) as variance from wc group by all having count(*) >= 6",
    "welch_t": f"""with {VALUES}, w as (select region, count(value) filter (sample like 'IR%') as n_a, count(value) filter (sample like 'NR%') as n_b, avg(value) filter (sample like 'IR%') as ma,
avg(value) filter (sample like 'NR%') as mb, var_samp(value) filter (sample like 'IR%') as va, var_samp(value) filter (sample like 'NR%') as vb from mx group by region)
select region, n_a, n_b, round(case when n_a > 1 and n_b > 1 and va / n_a + vb / n_b > 0 then (ma - mb) / sqrt(va / n_a + vb / n_b) end, 6) as t from w""",
}


def _hypo(v: Fixtures) -> DataFrame:
    return regions.standardize(regions.select_hypo(v.dmr))


def _typed(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("hypo_type", "cell_type")


def _types(v: Fixtures) -> DataFrame:
    united = intervals.merge_intervals(_typed(_hypo(v)), ["sample", "cell_type"], touching=False)
    shared = _typed(regions.region_sources(_hypo(v)).where("n_rows > 1").withColumn("hypo_type", F.explode(F.split("types", ",")))).withColumn("sample", F.explode(F.split("samples", ",")))
    return regions.type_summary(_hypo(v), regions.opponents(v.dmr), united, shared)


def _subtraction(v: Fixtures) -> DataFrame:
    by_type = v.dmr.withColumnRenamed("left_type", "cell_type")
    response, pairwise = by_type.where("raw_p < 0.01"), by_type.where("raw_p > 0.19 and cell_type <> 'T2'")
    selected = pairwise.where("raw_p > 0.195 and cell_type <> 'T1'")
    clean = intervals.drop_overlapping(response, selected, ["cell_type"])
    return _rounded(regions.subtraction_summary(response, clean, pairwise, selected, "cell_type"), "removed_fraction")


def _context_paths(v: Fixtures) -> DataFrame:
    name = F.concat(F.lit("/data/allc/25110891_"), F.col("sample"), F.lit("_Met-BC"), F.col("cell_no"), F.when(F.col("cell_no") % 3 == 0, ".allc.tsv").otherwise(".allc.tsv.gz"))
    return v.cells.select(name.alias("path"))


def _coverage_paths(v: Fixtures) -> DataFrame:
    own = F.when(F.col("cell_no") % 2 == 0, F.concat(F.col("sample"), F.lit("_"))).otherwise("")
    folder = F.when(F.col("cell_no") % 5 == 0, "raw").otherwise("cov_dedup_probability")
    return v.cells.select(F.concat(F.lit("/data/25110891_"), F.col("sample"), F.lit("_Met/"), folder, F.lit("/"), own, F.lit("BC"), F.col("cell_no"), F.lit(".cov.gz")).alias("path"))


def _record_paths(v: Fixtures) -> DataFrame:
    """A file per sample and left type; which of the layouts holds it depends on the type."""
    name = F.concat("sample", F.lit("__"), "left_type", F.lit("_vs_"), "right_type", F.lit("_DMRs.bed"))
    folder = F.when(F.col("left_type") == "T0", F.concat(F.lit("/data/in/"), "sample", F.lit("_sample_celltype/"))).when(F.col("left_type") == "T1", "/data/in/sample_celltype/").otherwise("/data/more/")
    return v.dmr.groupBy("sample", "left_type").agg(F.max("right_type").alias("right_type")).select(F.concat(folder, name).alias("path"))


def _site_bins(v: Fixtures) -> DataFrame:
    """Mean ratio per cell and bin of the genome: what a bin has no site for is a gap."""
    feature = F.concat_ws(":", "chrom", F.floor(F.col("pos") / 1000).cast("string"))
    return v.sites.select("cell_no", feature.alias("feature"), sites.ratio().alias("value")).groupBy("cell_no", "feature").agg(F.avg("value").alias("value"))


def _batches(v: Fixtures) -> DataFrame:
    return v.counts.select("cell_no").distinct().select("cell_no", (F.col("cell_no") % 3).alias("batch"))


QUERIES |= {
    "type_summary": _types,
    "input_summary": lambda v: regions.input_summary(v.dmr, _hypo(v), regions.top_intervals(_hypo(v), 20)),
    "subtraction_summary": _subtraction,
    "context_index": lambda v: files.context_index(_context_paths(v)),
    "coverage_index": lambda v: files.coverage_index(_coverage_paths(v)),
    "record_files": lambda v: files.record_files(_record_paths(v), "/data/in", ["/data/more"]),
    "named_regions": lambda v: sinks.named_regions(intervals.merge_intervals(_typed(_hypo(v)), ["sample", "cell_type"], touching=False), ["sample", "cell_type"], "hypo_any_other").drop("n_records"),
    "shuffled_cells": lambda v: annotation.shuffled(v.cells.select("cell_no", "cell_type"), "cell_no", 7),
    "purity_all_rows": lambda v: _rounded(clusters.purity(v.clusters.withColumn("label", F.when(F.col("cluster_a") != 2, F.col("cluster_a"))), "cluster_b", "label", True), "purity"),
    "entropy_all_rows": lambda v: _rounded(clusters.entropy(v.clusters.withColumn("label", F.when(F.col("cluster_a") != 2, F.col("cluster_a"))), "cluster_b", "label", True), "entropy"),
    "dense_size": lambda v: v.counts.agg(annotation.dense_size(F.count_distinct("cell_no"), F.count_distinct("gene_no")).alias("gib"), annotation.dense_size(F.count_distinct("cell_no"), F.count_distinct("gene_no") * 1000).alias("gib_1000")),
    "lsi_weights": lambda v: _rounded(decomposition.tf_idf(v.counts.where("n > 0")), "value"),
    "pca_scores": lambda v: decomposition.components(expression.normalize_log1p(v.counts), 10, sweeps=20)[0],
    "pca_impute": lambda v: decomposition.impute_components(_site_bins(v), 5, most=20)[0],
    "hvg_seurat_v3": lambda v: expression.variable_genes(v.counts, _batches(v), 200, rows=v.rows("fx_counts")),
}

_UNITED = f"""{STANDARD}, hy as (select * from d where raw_p < 0.01 and diff >= 0.25), mo as (select sample, hypo_type as cell_type, chrom, start_pos, end_pos,
max(end_pos) over (partition by sample, hypo_type, chrom order by start_pos, end_pos rows between unbounded preceding and 1 preceding) as reach from hy),
mi as (select *, sum(case when reach is null or start_pos >= reach then 1 else 0 end) over (partition by sample, cell_type, chrom order by start_pos, end_pos rows unbounded preceding) as island from mo),
un as (select sample, cell_type, chrom, min(start_pos) as start_pos, max(end_pos) as end_pos from mi group by sample, cell_type, chrom, island)"""
_NULLED = "cn as (select cluster_b, coalesce(cast(nullif(cluster_a, 2) as varchar), 'none') as label, count(*) as n from fx_clusters group by all)"

ORACLES |= {
    "type_summary": f"""with {_UNITED}, op as (select distinct sample, left_type as cell_type, right_type as other from fx_dmr union select distinct sample, right_type, left_type from fx_dmr),
o as (select sample, cell_type, count(*) as n_opponents, string_agg(other, ',' order by other) as opponents from op group by all),
w as (select sample, hypo_type as cell_type, count(distinct other_type) as n_with_hypo, count(*) as n_records, count(distinct ({PLACE})) as n_intervals, count(*) filter (not consistent) as n_mismatches from hy group by all),
u as (select sample, cell_type, count(*) as n_united from un group by all), rs as (select {PLACE}, list(distinct hypo_type) as ts, list(distinct sample) as ss from hy group by all having count(*) > 1),
sh as (select sample, cell_type, count(*) as n_shared from (select cell_type, unnest(ss) as sample from (select unnest(ts) as cell_type, ss from rs)) group by all)
select sample, cell_type, n_opponents, coalesce(n_with_hypo, 0) as n_with_hypo, coalesce(n_records, 0) as n_records, coalesce(n_intervals, 0) as n_intervals, coalesce(n_mismatches, 0) as n_mismatches,
coalesce(n_united, 0) as n_united, coalesce(n_shared, 0) as n_shared, opponents from o left join w using (sample, cell_type) left join u using (sample, cell_type) left join sh using (sample, cell_type)""",
    "input_summary": "with top as (" + ORACLES["topn_intervals"].replace("from fx_dmr)", f"from fx_dmr where {HYPO})") + f"""), a as (select sample, count(distinct (left_type, right_type)) as n_files, count(*) as n_rows from fx_dmr group by all),
b as (select sample, count(*) as n_passing from fx_dmr where {HYPO} group by all), c as (select sample, count(*) as n_selected, count(distinct ({PLACE})) as n_selected_intervals from top group by all)
select sample, n_files, n_rows, coalesce(n_passing, 0) as n_passing, coalesce(n_selected, 0) as n_selected, coalesce(n_selected_intervals, 0) as n_selected_intervals from a left join b using (sample) left join c using (sample)""",
    "subtraction_summary": """with r as (select left_type as cell_type, chrom, start_pos, end_pos from fx_dmr where raw_p < 0.01), p as (select left_type as cell_type, chrom, start_pos, end_pos, raw_p from fx_dmr where raw_p > 0.19 and left_type <> 'T2'),
s as (select * from p where raw_p > 0.195 and cell_type <> 'T1'), k as (select r.*, exists (select 1 from s where s.cell_type = r.cell_type and s.chrom = r.chrom and s.start_pos < r.end_pos and s.end_pos > r.start_pos) as hit from r)
select cell_type, count(*) as n_rows, count(*) filter (not hit) as n_clean, count(*) filter (hit) as n_removed, round(count(*) filter (hit) / count(*), 6) as removed_fraction,
case when cell_type not in (select cell_type from p) then 'no_pairwise_input' when cell_type not in (select cell_type from s) then 'input_present_no_DMR_passed' else 'complete' end as status from k group by cell_type""",
    "context_index": "select concat(sample, '__BC', cell_no) as cell, concat('/data/allc/25110891_', sample, '_Met-BC', cell_no, '.allc.tsv.gz') as path from fx_cells where cell_no % 3 <> 0",
    "coverage_index": """select concat(sample, '__BC', cell_no) as cell, concat('/data/25110891_', sample, '_Met/cov_dedup_probability/', case when cell_no % 2 = 0 then concat(sample, '_') else '' end, 'BC', cell_no, '.cov.gz') as path
from fx_cells where cell_no % 5 <> 0""",
    "record_files": """with c as (select distinct sample, left_type, right_type, concat(case left_type when 'T0' then concat(sample, '_sample_celltype/') when 'T1' then 'sample_celltype/' else '' end, sample, '__', left_type, '_vs_', right_type, '_DMRs.bed') as rest from fx_dmr)
select sample, left_type, right_type, concat(case when left_type in ('T0', 'T1') then '/data/in/' else '/data/more/' end, rest) as path, concat(case when left_type in ('T0', 'T1') then 'standard:' else 'rawp_fallback_no_null_dmrs:' end, rest) as source from c""",
    "named_regions": f"""with {_UNITED} select *, concat(sample, '__', cell_type, '__hypo_any_other__', row_number() over (partition by sample, cell_type order by chrom, start_pos, end_pos)) as name from un""",
    "shuffled_cells": "select cell_no, cell_type, md5(concat('7:', cell_no)) as place from fx_cells",
    "purity_all_rows": f"with {_NULLED} select round(sum(m) / sum(t), 6) as purity from (select max(n) as m, sum(n) as t from cn group by cluster_b)",
    "entropy_all_rows": f"""with {_NULLED}, t as (select *, n / sum(n) over (partition by cluster_b) as share from cn), h as (select cluster_b, sum(n) as n, -sum(share * ln(share)) as h from t group by all)
select round(sum(n * h) / sum(n) / (select ln(count(distinct label)) from cn), 6) as entropy from h""",
    "dense_size": """select round(count(distinct cell_no)::double * count(distinct gene_no) * 4 / 1073741824, 2) as gib, round(count(distinct cell_no)::double * count(distinct gene_no) * 1000 * 4 / 1073741824, 2) as gib_1000 from fx_counts""",
    "lsi_weights": """with t as (select distinct cell_no, gene_no from fx_counts where n > 0), r as (select cell_no, count(*) as nr from t group by all), c as (select gene_no, count(*) as nc from t group by all)
select cell_no, gene_no, round(ln(1 + 100000.0::double / nr) * ln(1 + (select count(*) from r)::double / nc), 6) as value from t join r using (cell_no) join c using (gene_no)""",
}
