"""Queries of markers, comparison families, number texts, annotation counts and builds."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytolith.functions import labels
from cytolith.operators import annotation, expression, regions
from cytolith.plans.cell_queries import _RANKED, _group_of, _normalized
from cytolith.plans.fixtures import Fixtures
from cytolith.plans.site_queries import _merged, _rounded, merged_sql
from cytolith.session import shared_folder
from cytolith.sources import builds

MARKERS = 20
FAMILIES = {"response": (["cell_type"], "response"), "samples": (["response"], "sample"), "type_samples": (["response", "cell_type"], "sample")}


def _markers(v: Fixtures) -> DataFrame:
    return _rounded(expression.rank_markers(_normalized(v), _group_of(v), MARKERS, v.rows("fx_counts")), "z", "p", "adjusted_p", "log2_fold").withColumn("nth", F.col("nth").cast("long"))


def _annotation_counts(v: Fixtures) -> DataFrame:
    cells = v.cells.select("cell_no", F.when(F.col("cell_no") % 17 != 0, F.col("sample")).alias("sample"))
    known = v.cells.select("cell_no", F.when(~F.col("excluded"), F.col("cell_type")).alias("cell_type"))
    metadata = v.cells.select("sample", F.when(F.col("sample") != "IR03", F.substring("sample", 1, 2)).alias("condition")).distinct()
    return annotation.annotation_counts(cells, known, metadata)


def _built(v: Fixtures) -> DataFrame:
    """A build of all cells that was broken off after a part of them, and is taken up."""
    sites = v.sites.withColumn("cell_no", F.concat_ws("_", "sample", "cell_no"))
    cells, areas = sites.select("cell_no").distinct(), _merged(v)
    folder = f"{shared_folder(v.spark)}/counts-{uuid.uuid4().hex}"

    def read(open_: DataFrame) -> DataFrame:
        return sites.join(open_, "cell_no", "left_semi")

    def broken_off(open_: DataFrame) -> DataFrame:
        raise InterruptedError("nothing was read")

    try:
        builds.build_counts(cells, areas, broken_off, folder)
    except InterruptedError:
        pass
    return builds.build_counts(cells, areas, read, folder)[0]


QUERIES = {
    "rank_markers": _markers,
    "comparison_families": lambda v: regions.comparison_families(v.cells.withColumn("response", F.substring("sample", 1, 2)), FAMILIES, 20),
    "number_general": lambda v: v.table("lineitem").select(
        "l_orderkey", "l_linenumber", *[labels.number_general(F.sqrt(F.col("l_extendedprice") / F.col("l_quantity")) * F.pow(F.lit(10.0), (F.col("l_linenumber") * 3 - 10).cast("double")), d).alias(f"g{d}") for d in (6, 8)]
    ),
    "annotation_counts": _annotation_counts,
    "resumed_counts": _built,
}


def _erfc(x: str) -> str:
    t, inner = f"(1 / (1 + {x} / 2))", str(expression.ERFC[-1])
    for c in reversed(expression.ERFC[:-1]):
        inner = f"({c} + {t} * {inner})"
    return f"least(1, {t} * exp(-{x} * {x} + {inner}))"


def _family(name: str, shared: list[str], label: str) -> str:
    within = f"concat_ws(':', {', '.join(shared)})"
    return f"""select '{name}' as family, a.within, a.label as label_a, b.label as label_b, a.n as n_a, b.n as n_b, case when a.n >= 20 and b.n >= 20 then 'yes' else 'no' end as eligible
from (select {within} as within, {label} as label, count(*) as n from rc group by all) a join (select {within} as within, {label} as label, count(*) as n from rc group by all) b on a.within = b.within and a.label < b.label"""


ORACLES = {
    "rank_markers": f"""{_RANKED}, zz as (select gene_no, grp, (w - n1 * (n1 + 1) / cast(2 as double) - n1 * (n - n1) / cast(2 as double)) / sqrt(n1 * (n - n1) * (n + 1) / cast(12 as double)) as z from w where n > n1),
zp as (select *, {_erfc("(abs(z) / sqrt(cast(2 as double)))")} as p from zz),
zb as (select *, p * count(*) over (partition by grp) / count(*) over (partition by grp order by p) as bound from zp),
zq as (select *, least(1, min(bound) over (partition by grp order by p desc)) as adjusted_p, row_number() over (partition by grp order by round(z, 12) desc, gene_no) as nth from zb),
sm as (select gene_no, grp, sum(value) as total, count(*) as size from g group by all), sa as (select gene_no, sum(total) as total, sum(size) as size from sm group by all)
select zq.grp as "group", zq.gene_no, round(z, 6) as z, round(p, 6) as p, round(adjusted_p, 6) as adjusted_p,
round(log2((exp(sm.total / sm.size) - 1 + 1e-9) / (exp((sa.total - sm.total) / (sa.size - sm.size)) - 1 + 1e-9)), 6) as log2_fold, nth from zq join sm using (gene_no, grp) join sa using (gene_no) where nth <= {MARKERS}""",
    "comparison_families": "with rc as (select *, substr(sample, 1, 2) as response from fx_cells) " + " union all ".join(_family(name, *family) for name, family in FAMILIES.items()),
    "number_general": "select l_orderkey, l_linenumber, " + ", ".join(f"printf('%.{d}g', sqrt(l_extendedprice / l_quantity) * pow(cast(10 as double), l_linenumber * 3 - 10)) as g{d}" for d in (6, 8)) + " from lineitem",
    "annotation_counts": """with c as (select cell_no, coalesce(case when cell_no % 17 <> 0 then sample end, 'Unknown') as sample from fx_cells),
k as (select cell_no, max(case when not excluded then cell_type end) as label from fx_cells group by all), m as (select distinct sample, case when sample <> 'IR03' then substr(sample, 1, 2) end as condition from fx_cells),
j as (select c.sample, coalesce(label, 'Unannotated') as label, coalesce(condition, 'Unknown') as condition from c left join k using (cell_no) left join m on m.sample = c.sample)
select 'cell_type' as kind, label as name, count(*) as n from j group by label union all select 'condition', condition, count(*) from j group by condition
union all select 'total', 'unknown_sample', count(*) filter (sample = 'Unknown') from j union all select 'total', 'unknown_condition', count(*) filter (condition = 'Unknown') from j
union all select 'total', 'samples', count(distinct sample) from j union all select 'total', 'metadata_rows', count(*) from m""",
    "resumed_counts": f"""with {merged_sql("fx_regions", False)} select concat_ws('_', sample, cell_no) as cell_no, s.chrom, m.start_pos as region_start, m.end_pos as region_end, cast(sum(mc) as bigint) as mc, cast(sum(mc + uc) as bigint) as cov
from fx_sites s join m on s.chrom = m.chrom and pos >= m.start_pos and pos < m.end_pos group by all""",
}
