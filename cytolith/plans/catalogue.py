"""Registered queries of the library and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cytolith.plans import cell_queries, graph_queries, methylome_queries, rule_queries, site_queries
from cytolith.plans.fixtures import Fixtures, snapped, with_views

_PLANS = (site_queries, cell_queries, methylome_queries, graph_queries, rule_queries)


def _bound(query: Callable[[Fixtures], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: query(Fixtures(spark, sf_dir))


QUERIES = {name: _bound(query) for plan in _PLANS for name, query in plan.QUERIES.items()}
ORACLES = {name: snapped(with_views(sql)) for plan in _PLANS for name, sql in plan.ORACLES.items()}
