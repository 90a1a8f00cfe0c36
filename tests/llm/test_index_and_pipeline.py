"""The permutation index and the pipeline as a whole."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytolith.llm import permutation_index
from test_jaccard import kept_by_comparing_all

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, score string"


def exact(data, queries, k):
    out = {}
    for q in queries:
        scores = sorted(((-float(np.dot(np.float64(data[q]), np.float64(v))), i) for i, v in data.items() if i != q))
        out[q] = [i for _, i in scores[:k]]
    return out


def test_recall_ties_and_odd_vectors(spark):
    r = np.random.default_rng(1)
    data = {i: r.normal(size=16).astype(np.float32).tolist() for i in range(600)}
    for i in range(300, 380):
        data[i] = data[300]  # one very common vector
    rows = [(i, v, "x") for i, v in data.items()]
    rows += [rows[7], (1000, None, ""), (1020, [0.0] * 16, ""), (1040, [float("nan")] * 16, ""), (1060, [1.0, None] * 8, ""), (None, data[1], ""), (1080, [1.0], ""), (1100, [], "")]
    df = spark.createDataFrame(rows, VECTORS)
    got: dict = {}
    for x in permutation_index.nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        assert x.vec_id != x.query_id
        assert x.score == pytest.approx(float(np.dot(np.float64(data[x.query_id]), np.float64(data[x.vec_id]))), abs=1e-12)
        got.setdefault(x.query_id, []).append(x.vec_id)
    truth = exact(data, [i for i in data if i % 20 == 0], 20)
    assert set(got) == set(truth)
    assert np.mean([len(set(got[q]) & set(t)) / 20 for q, t in truth.items()]) >= 0.9
    assert got[300] == truth[300] and got[320] == truth[320]


def test_recall_holds_with_many_pivots(spark, monkeypatch):
    """As many pivots as half a million vectors have; 40 visited files are too few of them."""
    monkeypatch.setattr(permutation_index, "PIVOT_FACTOR", 15)
    r = np.random.default_rng(2)
    data = r.normal(size=(3000, 64)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(data)], VECTORS)
    got: dict = {}
    for x in permutation_index.nearest(df, F.col("vec_id") % 60 == 0).collect():
        got.setdefault(x.query_id, set()).add(x.vec_id)
    truth = exact(dict(enumerate(data)), range(0, 3000, 60), 20)
    assert np.mean([len(got[q] & set(t)) / 20 for q, t in truth.items()]) >= 0.9


def test_the_exact_setting_leaves_nothing_out(spark):
    r = np.random.default_rng(3)
    data = {i: [float(round(x, 2)) for x in r.normal(size=8)] for i in range(1500)}
    short = {2000 + i: [float(round(x, 1)) for x in r.normal(size=3)] for i in range(60)}
    rows = [(i, v, "x") for i, v in (data | short).items()]
    df = spark.createDataFrame([*rows, (40, [9.0] * 8, "x")], "vec_id long, embedding array<double>, score string")
    got: dict = {}
    for x in permutation_index.nearest(df, F.col("vec_id") % 20 == 0, setting=permutation_index.EXACT).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append((x.vec_id, x.score))
    data[40] = min(data[40], [9.0] * 8)
    for group in (data, short):
        for q, ids in exact(group, [i for i in group if i % 20 == 0], 20).items():
            scores = [float(np.dot(group[q], group[i])) for i in ids]
            assert [s for _, s in got[q]] == pytest.approx(scores, abs=1e-9)
    with pytest.raises(ValueError):
        permutation_index.Setting(posted=0)


def test_few_or_no_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], ""), (20, [0.5, 0.5], ""), (21, [0.0, 1.0], "")], VECTORS)
    got = permutation_index.nearest(df, F.col("vec_id") % 20 == 0).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == [(0, 1, 20), (0, 2, 21), (20, 1, 0), (20, 2, 21)]
    assert permutation_index.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_pipeline_stages_follow_each_other(spark):
    import corpus_pipeline
    from cytolith.llm import decontamination, quality
    from cytolith.llm.common import read_table

    docs = read_table(spark, SF, "documents")
    first = corpus_pipeline.quality_stage(spark, docs, SF)
    assert first.columns == docs.columns
    scores = quality.score(docs, quality.fit(docs, read_table(spark, SF, "labels")))
    good = {r.doc_id for r in scores.where("quality_score >= 0.3").collect()}
    single = set(kept_by_comparing_all([(r.doc_id, r.text) for r in docs.where(F.col("doc_id").isin(list(good))).collect()]))
    held = {r.doc_id for r in decontamination.leaks(docs, read_table(spark, SF, "benchmark")).collect()}
    packed = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in packed} == single - held
    redacted = corpus_pipeline.pii_stage(spark, docs, SF)
    assert redacted.columns == docs.columns and redacted.where("length(text) <> n_chars").count() == 0


def test_registry_names_every_operator():
    from cytolith.llm import registry

    assert sorted(int(name[2:].split("_")[0]) for name in registry.QUERIES) == list(range(1, 14))
    assert set(registry.ORACLES) <= set(registry.QUERIES)


def test_stages_take_empty_tables(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "an item of the benchmark, with words enough to be one")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, __text string")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)
