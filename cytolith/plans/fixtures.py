"""Views of the driver's tables in the shape of site, region, cell and count tables.

The texts run in Spark and DuckDB alike; ``line_no`` stands for the order of lines in a file.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from cytolith.operators.intervals import distinct_rows
from cytolith.session import spread

_LINE = "(((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 1000 + l_suppkey % 1000) * 1000 + cast(round(l_extendedprice * 100) as bigint) % 1000"
_SAMPLE = "concat(case when {0} % 10 < 5 then 'IR0' else 'NR0' end, cast(1 + {0} % 5 as varchar(4)))"

VIEWS = {
    "fx_sites": f"""select {_SAMPLE.format("l_suppkey")} as sample, l_suppkey % 50 as cell_no, concat('chr', cast(1 + l_partkey % 4 as varchar(4))) as chrom,
  l_orderkey * 2 as pos, l_orderkey * 2 + 1 + l_suppkey % 2 as end_pos, cast(cast(l_quantity as bigint) % 4 * 25 as double) as prob, cast(l_quantity as bigint) % 4 as mc,
  cast(round(l_discount * 100) as bigint) % 3 as uc, {_LINE} as line_no from lineitem""",
    "fx_regions": """select distinct concat('chr', cast(1 + o_custkey % 4 as varchar(4))) as chrom, o_orderkey * 2 as start_pos,
  o_orderkey * 2 + 1 + o_custkey % 7 as end_pos from orders""",
    "fx_mask": """select distinct concat('chr', cast(1 + (o_custkey + o_orderkey) % 4 as varchar(4))) as chrom, o_orderkey * 2 + 3 as start_pos,
  o_orderkey * 2 + 4 + o_custkey % 3 as end_pos from orders""",
    "fx_cells": f"""select c_custkey as cell_no, {_SAMPLE.format("c_custkey")} as sample, concat('T', cast(c_nationkey % 4 as varchar(4))) as cell_type,
  c_custkey % 13 = 0 as excluded from customer""",
    "fx_dmr": f"""select {_SAMPLE.format("l_suppkey")} as sample, concat('T', cast(l_linenumber % 3 as varchar(4))) as left_type, 'T3' as right_type,
  concat('chr', cast(1 + l_partkey % 4 as varchar(4))) as chrom, cast(l_orderkey % 300 as bigint) as start_pos, cast(l_orderkey % 300 + 1 + l_quantity as bigint) as end_pos,
  l_tax * 10 as meth_a, l_discount * 5 as meth_b, case when l_tax * 10 < l_discount * 5 then 'group_A' else 'group_B' end as lower_group,
  cast(l_partkey % 200 as double) / 1000 as raw_p, {_LINE} as line_no from lineitem""",
    "fx_counts": """select l_suppkey as cell_no, l_partkey as gene_no, p_brand = 'Brand#13' as is_mt, cast(sum(l_quantity) as bigint) as n
  from lineitem join part on p_partkey = l_partkey group by l_suppkey, l_partkey, p_brand""",
    "fx_clusters": "select vec_id, label as cluster_a, cast(vec_id % 7 as int) as cluster_b from embeddings",
}

#: Tables that the views read.
SOURCES = {"fx_sites": ["lineitem"], "fx_regions": ["orders"], "fx_mask": ["orders"], "fx_cells": ["customer"], "fx_dmr": ["lineitem"], "fx_counts": ["lineitem", "part"], "fx_clusters": ["embeddings"]}
#: Keys of the first table by which a view joins and groups.
DEALT = {"fx_counts": "l_partkey"}


def with_views(sql: str) -> str:
    """A DuckDB text with the views it names in front of it."""
    used = [f"{name} as ({text})" for name, text in VIEWS.items() if name in sql]
    body = sql.strip()
    if body.startswith("with "):
        return f"with {', '.join(used)}, {body[5:]}" if used else body
    return f"with {', '.join(used)} {body}" if used else body


def snapped(sql: str) -> str:
    """``sql`` with every ``round(x, 6)`` taken of x at twelve digits, so that the order of a sum decides no tie."""
    out, at = [], 0
    while (found := sql.find("round(", at)) >= 0:
        start = end = found + len("round(")
        depth, comma = 1, 0
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            comma = end if sql[end] == "," and depth == 1 else comma
            end += 1
        inner = sql[start:comma]
        out.append(sql[at:start])
        if sql[comma + 1 : end - 1].strip() == "6":
            out.append(f"round({snapped(inner)}, 12), 6)")
            at = end
        else:
            at = start
    return "".join(out) + sql[at:]


class Fixtures:
    """The views as DataFrames over the Parquet tables of a folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def rows(self, name: str) -> int:
        """Rows of the first table that a view reads; no view but the joined ones has more."""
        return self.table(SOURCES[name][0]).count()

    def source(self, name: str, source: str) -> DataFrame:
        """A table as a view reads it: one that is joined and grouped is dealt by its key over as many tasks as it needs."""
        table = self.table(source)
        return spread(table, DEALT[name], rows=self.rows(name)) if name in DEALT and source == SOURCES[name][0] else table

    def view(self, name: str) -> DataFrame:
        text = VIEWS[name]
        for source in SOURCES[name]:
            text = text.replace(f"from {source}", f"from {{{source}}}").replace(f"join {source}", f"join {{{source}}}")
        plain = text.removeprefix("select distinct ")
        found = self.spark.sql(text if plain == text else f"select {plain}", **{source: self.source(name, source) for source in SOURCES[name]})
        # distinct rows are dealt by their number, where the text alone would leave them to a fixed number of tasks
        return found if plain == text else distinct_rows([found], self.rows(name))

    @cached_property
    def sites(self) -> DataFrame:
        return self.view("fx_sites")

    @cached_property
    def regions(self) -> DataFrame:
        return self.view("fx_regions")

    @cached_property
    def mask(self) -> DataFrame:
        return self.view("fx_mask")

    @cached_property
    def cells(self) -> DataFrame:
        return self.view("fx_cells")

    @cached_property
    def dmr(self) -> DataFrame:
        return self.view("fx_dmr")

    @cached_property
    def counts(self) -> DataFrame:
        return self.view("fx_counts")

    @cached_property
    def clusters(self) -> DataFrame:
        return self.view("fx_clusters")
