"""Every registered query against its SQL twin in DuckDB, on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

from cytolith.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()


def plain(frame):
    columns = sorted(frame.columns)

    def one(x):
        if x is None or x is pd.NA or x != x:
            return None
        return round(float(x), 6) + 0.0 if isinstance(x, (int, float)) or hasattr(x, "dtype") else str(x)

    return columns, sorted((tuple(map(one, row)) for row in frame[columns].itertuples(index=False, name=None)), key=str)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    return connection


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, duck, name):
    assert plain(catalogue.QUERIES[name](spark, SF).toPandas()) == plain(duck.execute(catalogue.ORACLES[name]).df())


#: Iterative or local fits; test_decomposition, test_variable_genes, test_graph and test_integration hold them against numpy.
WITHOUT_SQL = {
    "pca_scores", "pca_impute", "hvg_seurat_v3", "communities", "consensus_communities", "significant_components", "pca_scaled", "correct_batches", "doublet_scores",
}


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES) | WITHOUT_SQL


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(WITHOUT_SQL))
def test_query_without_sql_gives_rows(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
