"""Components against numpy's own decomposition."""

from __future__ import annotations

import numpy as np
import pytest

from cytolith.operators import decomposition

LONG = "cell_no long, gene_no long, value double"


def long(spark, matrix):
    rows = [(i, j, float(x)) for (i, j), x in np.ndenumerate(matrix) if x == x]
    return spark.createDataFrame(rows, LONG).repartition(3)


def by_key(df, key):
    return np.array([r[1] for r in sorted((r[0], r[-1]) for r in df.select(key, df.columns[-1]).collect())])


def low_rank(rows, columns, k, noise, seed):
    g = np.random.default_rng(seed)
    return (g.standard_normal((rows, k)) * (10.0 / (1 + np.arange(k)))) @ g.standard_normal((k, columns)) + noise * g.standard_normal((rows, columns))


@pytest.mark.parametrize("center", [True, False])
def test_components_equal_the_decomposition(spark, monkeypatch, center):
    monkeypatch.setattr(decomposition, "CHUNK", 100)
    x = low_rank(40, 25, 4, 0.3, 1) + 3
    x[np.random.default_rng(2).random(x.shape) < 0.4] = 0
    kept = np.where(x == 0, np.nan, x)
    scores, loadings, singular = decomposition.components(long(spark, kept), 3, center=center, sweeps=300, close=1e-14)
    u, s, v = np.linalg.svd(x - x.mean(axis=0) if center else x, full_matrices=False)
    assert np.allclose(singular, s[:3], rtol=1e-6)
    found = by_key(loadings, "gene_no")
    sign = np.sign((found * v[:3].T).sum(axis=0))
    assert np.allclose(found, v[:3].T * sign, atol=1e-4)
    assert np.allclose(by_key(scores, "cell_no"), (u * s)[:, :3] * sign, atol=1e-3)


def reference_imputation(x, k, rounds):
    gaps = np.isnan(x)
    x = np.where(gaps, 0, x - np.nanmean(x, axis=0))
    errors = []
    for _ in range(rounds):
        u, s, v = np.linalg.svd(x, full_matrices=False)
        new = (u[:, :k] * s[:k]) @ v[:k]
        errors.append(((x - new)[gaps] ** 2).mean())
        x = np.where(gaps, new, x)
        if errors[-1] < 0.001 * max(errors):
            break
    return new, errors


def test_imputation_equals_rounds_over_the_filled_table(spark):
    x = low_rank(30, 20, 2, 0.01, 3)
    x[np.random.default_rng(4).random(x.shape) < 0.25] = np.nan
    expected, wanted = reference_imputation(x, 2, 50)
    scores, loadings, errors = decomposition.impute_components(long(spark, x), 2, column="gene_no", sweeps=12)
    assert len(errors) == len(wanted)
    assert np.allclose(errors, wanted, rtol=1e-2)
    vectors = by_key(loadings.select("gene_no", "loadings"), "gene_no")
    assert np.allclose(by_key(scores, "cell_no") @ vectors.T, expected, atol=0.02)


def test_imputation_without_gaps_is_one_decomposition(spark):
    x = low_rank(12, 6, 2, 0.1, 5)
    scores, loadings, errors = decomposition.impute_components(long(spark, x), 2, column="gene_no")
    u, s, v = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    assert errors == []
    assert np.allclose(by_key(scores, "cell_no") @ by_key(loadings.select("gene_no", "loadings"), "gene_no").T, (u[:, :2] * s[:2]) @ v[:2], atol=1e-3)


@pytest.mark.parametrize("center", [True, False])
def test_wide_tables_are_turned(spark, monkeypatch, center):
    x = low_rank(15, 60, 4, 0.3, 7) + 3
    x[np.random.default_rng(8).random(x.shape) < 0.4] = 0
    plain = decomposition.components(long(spark, np.where(x == 0, np.nan, x)), 3, center=center, sweeps=300, close=1e-14)
    monkeypatch.setattr(decomposition, "WIDE", 50)
    monkeypatch.setattr(decomposition, "CHUNK", 100)
    turned = decomposition.components(long(spark, np.where(x == 0, np.nan, x)), 3, center=center, sweeps=300, close=1e-14)
    assert np.allclose(turned[2], plain[2], rtol=1e-9)
    assert np.allclose(by_key(turned[0], "cell_no"), by_key(plain[0], "cell_no"), atol=1e-4)
    assert np.allclose(by_key(turned[1], "gene_no"), by_key(plain[1], "gene_no"), atol=1e-5)


@pytest.mark.parametrize("wide", [20_000, 50])
def test_components_of_many_blocks_make_their_values_once(spark, monkeypatch, wide):
    monkeypatch.setattr(decomposition, "WIDE", wide)
    monkeypatch.setattr(decomposition, "PACK", 20)  # less than most rows and some columns have
    monkeypatch.setattr(decomposition, "SLICE", 7)
    made = spark.sparkContext.accumulator(0)

    def work(frames):
        for frame in frames:
            made.add(len(frame))
            yield frame

    x = low_rank(30, 60, 4, 0.3, 11) + 3
    x[np.random.default_rng(12).random(x.shape) < 0.4] = 0
    rows = long(spark, np.where(x == 0, np.nan, x))
    names = rows.selectExpr("concat('c', lpad(cell_no, 2, '0')) as cell", "cast(gene_no as int) as gene", "value")
    scores, loadings, singular = decomposition.components(names.mapInPandas(work, names.schema), 3, "cell", "gene", sweeps=300, close=1e-14)
    assert made.value == rows.count()
    u, s, v = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    assert np.allclose(singular, s[:3], rtol=1e-6)
    found = by_key(loadings, "gene")
    sign = np.sign((found * v[:3].T).sum(axis=0))
    assert np.allclose(found, v[:3].T * sign, atol=1e-4) and (found[np.abs(found).argmax(axis=0), range(3)] > 0).all()
    assert np.allclose(by_key(scores, "cell"), (u * s)[:, :3] * sign, atol=1e-3)
    assert scores.dtypes == [("cell", "string"), ("scores", "array<double>")] and loadings.dtypes == [("gene", "int"), ("loadings", "array<double>")]


def test_wide_tables_with_gaps_are_turned(spark, monkeypatch):
    x = low_rank(12, 40, 2, 0.01, 9)
    x[np.random.default_rng(10).random(x.shape) < 0.25] = np.nan
    monkeypatch.setattr(decomposition, "WIDE", 30)
    expected, wanted = reference_imputation(x, 2, 50)
    scores, loadings, errors = decomposition.impute_components(long(spark, x), 2, column="gene_no", sweeps=12)
    assert len(errors) == len(wanted) and np.allclose(errors, wanted, rtol=1e-2)
    vectors = by_key(loadings.select("gene_no", "loadings"), "gene_no")
    assert np.allclose(by_key(scores, "cell_no") @ vectors.T, expected, atol=0.02)
    assert np.allclose(vectors.T @ vectors, np.eye(2), atol=1e-2) and loadings.columns == ["gene_no", "loadings", "mean"]


def test_empty_tables_nulls_repeats_and_bounds(spark):
    empty = spark.createDataFrame([], LONG)
    scores, loadings, singular = decomposition.components(empty, 3)
    assert (scores.count(), loadings.count(), singular) == (0, 0, [])
    assert decomposition.impute_components(empty, 3, column="gene_no")[2] == []
    rows = [(1, 1, 2.0), (1, 1, 4.0), (1, 2, None), (2, 2, 3.0), (None, 1, 5.0)]
    _, _, singular = decomposition.components(spark.createDataFrame(rows, LONG), 5, center=False)
    assert np.allclose(singular, [3.0, 3.0])
    with pytest.raises(ValueError, match="most_features"):
        decomposition.components(long(spark, np.ones((2, 9))), 1, most_features=8)
    assert spark.createDataFrame([(1, 1, 1.0)], LONG).transform(decomposition.tf_idf).first().value == pytest.approx(np.log1p(1e5) * np.log(2))


def test_weights_leave_values_dealt_by_column_where_they_are(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.createDataFrame([(i, i * j % 7, 1.0) for i in range(9) for j in range(5)], LONG)
        weights = decomposition.tf_idf(rows.repartition(3, "gene_no"))
        plan = weights._jdf.queryExecution().executedPlan().toString()
        moves = [x for x in plan.split("Exchange hashpartitioning(")[1:] if x.startswith("gene_no") and "ENSURE_REQUIREMENTS" in x.split("\n")[0]]
        assert not moves
        assert {(r.cell_no, r.gene_no): round(r.value, 9) for r in weights.collect()} == {
            (i, g): round(float(np.log1p(1e5 / len({i * j % 7 for j in range(5)})) * np.log1p(9 / sum(g in {a * j % 7 for j in range(5)} for a in range(9)))), 9)
            for i in range(9) for g in {i * j % 7 for j in range(5)}
        }
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
