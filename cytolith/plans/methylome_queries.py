"""Queries of smoothed means, variable regions, permuted differences and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytolith.operators import methylome, regions, sites
from cytolith.plans.fixtures import Fixtures
from cytolith.plans.site_queries import RATIO, _rounded, merged_sql
from cytolith.session import kept, spread

BANDWIDTH, WIDTH, STEP, SHARE, LEAST_CELLS = 200, 200, 50, 0.02, 6
SIDES, PERMUTATIONS, SEED = ("IR", "NR"), 5, 11
FLANK, PROFILE_BIN = 100, 20


def _site_values(v: Fixtures) -> DataFrame:
    return spread(v.sites, "chrom", "pos", rows=v.rows("fx_sites")).groupBy("chrom", "pos", "cell_no").agg(F.avg(sites.ratio()).alias("ratio"))


def _smoothed(v: Fixtures, weigh: bool = False) -> DataFrame:
    return methylome.smooth_means(_site_values(v), BANDWIDTH, weigh, rows=v.rows("fx_sites"))


def _statistics(v: Fixtures) -> DataFrame:
    rows = v.rows("fx_sites")
    values = methylome.window_residuals(methylome.residuals(_site_values(v), BANDWIDTH, rows), WIDTH, STEP, rows)
    members = v.cells.select("cell_no", F.substring("sample", 1, 2).alias("side"))
    # all cells are shuffled, those without sites as well; labels are needed of the others only
    labels = methylome.permuted_labels(members, SIDES, PERMUTATIONS, SEED).join(v.sites.select("cell_no").distinct(), "cell_no", "left_semi")
    return methylome.permuted_statistics(values, labels, SIDES, ["chrom", "block", "start_pos"]).drop("block")


def _fallback(v: Fixtures) -> DataFrame:
    statistics = kept(_statistics(v))
    tested = methylome.permuted_fdr(statistics, ["chrom", "start_pos"]).withColumn("permutation", F.lit(0))
    nothing = [F.lit(None).cast("double").alias(c) for c in ("p", "adjusted_p")]
    permuted = statistics.where("permutation > 0 and chrom <> 'chr2'").select("chrom", "start_pos", "n_a", "n_b", "t", *nothing, "permutation")
    return regions.without_null_fdr(tested.unionByName(permuted), F.col("permutation") > 0, ["chrom"]).where("permutation = 0").drop("permutation")


def _starts(v: Fixtures) -> DataFrame:
    return v.regions.withColumn("strand", F.when(F.floor(F.col("start_pos") / 2) % 2 == 0, "+").otherwise("-"))


QUERIES = {
    "smooth_means": lambda v: _rounded(_smoothed(v), "site_mean", "smoothed"),
    "smooth_means_weighted": lambda v: _rounded(_smoothed(v, weigh=True), "site_mean", "smoothed"),
    "variable_regions": lambda v: _rounded(methylome.variable_regions(_site_values(v), WIDTH, STEP, SHARE, LEAST_CELLS, BANDWIDTH, v.rows("fx_sites")), "variance"),
    "permuted_statistics": lambda v: _rounded(_statistics(v), "t"),
    "permuted_fdr": lambda v: _rounded(methylome.permuted_fdr(_statistics(v), ["chrom", "start_pos"]), "t", "p", "adjusted_p"),
    "permuted_fdr_fallback": lambda v: _rounded(_fallback(v), "t", "p", "adjusted_p"),
    "start_profile": lambda v: _rounded(methylome.start_profile(v.sites, _starts(v), FLANK, PROFILE_BIN), "level"),
}

_SITES = f"""sv as (select chrom, pos, cell_no, avg({RATIO}) as ratio from fx_sites group by all),
sm as (select chrom, pos, count(ratio) as n_cells, avg(ratio) as site_mean from sv where ratio is not null group by all)"""


def _smooth(weight: str = "") -> str:
    kernel = f"pow(1 - pow(abs(a.pos - b.pos) / {BANDWIDTH / 2}, 3), 3){weight}"
    return f"""{_SITES}, sk as (select a.chrom, a.pos, a.n_cells, a.site_mean, sum({kernel} * b.site_mean) / sum({kernel}) as smoothed
from sm a join sm b on a.chrom = b.chrom and b.pos > a.pos - {BANDWIDTH // 2} and b.pos < a.pos + {BANDWIDTH // 2} group by all)"""


_RESTS = f"""{_smooth()}, rs as (select sv.chrom, sv.pos, cell_no, ratio - smoothed as residual from sv join sk using (chrom, pos) where ratio is not null),
wd as (select *, unnest(range(case when pos < {WIDTH} then 0 else (pos - {WIDTH}) // {STEP} + 1 end, pos // {STEP} + 1)) * {STEP} as start_pos from rs),
wc as (select chrom, start_pos, cell_no, round(sum(residual) / (count(*) + 1), 12) as value from wd group by all)"""
_REGIONS = f"""{_RESTS}, ws as (select chrom, start_pos, count(*) as n_cells, round(var_samp(value), 12) as variance from wc group by all having count(*) >= {LEAST_CELLS}),
wl as (select variance as least from ws where variance is not null order by variance desc limit 1 offset (select cast(ceil({SHARE} * count(variance)) as bigint) - 1 from ws)),
ch as (select chrom, start_pos, start_pos + {WIDTH} as end_pos from ws where variance >= (select least from wl)), {merged_sql("ch", True)},
rc as (select m.chrom, m.start_pos, m.end_pos, n_records, cell_no, round(sum(residual) / (count(*) + 1), 12) as value
from rs join m on rs.chrom = m.chrom and pos >= m.start_pos and pos < m.end_pos group by all)"""
_PERMUTED = f"""{_RESTS}, lb as (select cell_no, substr(sample, 1, 2) as side from fx_cells), nf as (select count(*) filter (side = '{SIDES[0]}') as n_first from lb),
dr as (select cell_no, side, unnest(range(1, {PERMUTATIONS + 1})) as permutation from lb),
sh as (select cell_no, permutation, case when row_number() over (partition by permutation order by md5(concat_ws(':', '{SEED}', permutation, cell_no)), cell_no) <= n_first then '{SIDES[0]}' else '{SIDES[1]}' end as side from dr, nf
union all select cell_no, 0, side from lb),
mo as (select chrom, start_pos, permutation, count(value) filter (side = '{SIDES[0]}') as n_a, count(value) filter (side = '{SIDES[1]}') as n_b, avg(value) filter (side = '{SIDES[0]}') as ma,
avg(value) filter (side = '{SIDES[1]}') as mb, var_samp(value) filter (side = '{SIDES[0]}') as va, var_samp(value) filter (side = '{SIDES[1]}') as vb from wc join sh using (cell_no) group by all),
st as (select chrom, start_pos, permutation, n_a, n_b, case when n_a > 1 and n_b > 1 and va / n_a + vb / n_b > 0 then (ma - mb) / sqrt(va / n_a + vb / n_b) end as t from mo)"""
_FDR = f"""{_PERMUTED}, sz as (select round(abs(t), 9) as size, count(*) filter (permutation = 0) as seen, count(*) filter (permutation > 0) as drawn from st where t is not null group by all),
ab as (select *, sum(seen) over d as sum_seen, sum(drawn) over d as sum_drawn, sum(seen) over () as n_seen, sum(drawn) over () as n_drawn from sz window d as (order by size desc)),
pv as (select size, (1 + sum_drawn) / cast(1 + n_drawn as double) as p, case when seen > 0 then (1 + sum_drawn) / cast(1 + n_drawn as double) * n_seen / sum_seen end as bound from ab),
aj as (select size, p, least(1, min(bound) over (order by size)) as adjusted_p from pv),
fd as (select chrom, start_pos, n_a, n_b, t, p, adjusted_p from st left join aj on round(abs(t), 9) = size where permutation = 0)"""
ORACLES = {
    "smooth_means": f"with {_smooth()} select chrom, pos, n_cells, round(site_mean, 6) as site_mean, round(smoothed, 6) as smoothed from sk",
    "smooth_means_weighted": f"with {_smooth(' * ln(1 + b.n_cells)')} select chrom, pos, n_cells, round(site_mean, 6) as site_mean, round(smoothed, 6) as smoothed from sk",
    "variable_regions": f"with {_REGIONS} select chrom, start_pos, end_pos, n_records as n_windows, count(*) as n_cells, round(var_samp(value), 6) as variance from rc group by all",
    "permuted_statistics": f"with {_PERMUTED} select chrom, start_pos, permutation, n_a, n_b, round(t, 6) as t from st",
    "permuted_fdr": f"with {_FDR} select chrom, start_pos, n_a, n_b, round(t, 6) as t, round(p, 6) as p, round(adjusted_p, 6) as adjusted_p from fd",
    "permuted_fdr_fallback": f"""with {_FDR} select chrom, start_pos, n_a, n_b, round(t, 6) as t, round(p, 6) as p,
case when chrom <> 'chr2' and chrom in (select chrom from st where permutation > 0) then round(adjusted_p, 6) end as adjusted_p from fd""",
    "start_profile": f"""with sp as (select chrom, (start_pos + end_pos) // 2 as middle, case when start_pos // 2 % 2 = 0 then 1 else -1 end as turn from fx_regions)
select cell_no, cast(floor((pos - middle) * turn / {PROFILE_BIN}.0) * {PROFILE_BIN} as bigint) as "offset", cast(sum(mc) as bigint) as mc, cast(sum(mc + uc) as bigint) as cov, count(*) as n_sites,
round(cast(sum(mc) as double) / nullif(sum(mc + uc), 0), 6) as level
from fx_sites s join sp on s.chrom = sp.chrom and pos > middle - {FLANK} and pos < middle + {FLANK} group by all""",
}
