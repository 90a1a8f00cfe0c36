"""Edges and errors of the methods over sites; the queries hold whole tables against SQL."""

from __future__ import annotations

import numpy as np
import pytest

from cytolith.operators import methylome

VALUES = "chrom string, pos long, cell_no long, ratio double"


def test_smoothing_crosses_block_edges(spark):
    r = np.random.default_rng(0)
    rows = [("chr1", int(p), c, float(r.random()) if r.random() < 0.8 else None) for p in sorted(r.choice(400, 90, replace=False)) for c in range(3)] + [("chr2", 5, 0, 0.5)]
    got = {(x.chrom, x.pos): x for x in methylome.smooth_means(spark.createDataFrame(rows, VALUES), 20, weigh=True).collect()}
    sites = {}
    for chrom, pos, _, ratio in rows:
        if ratio is not None:
            sites.setdefault((chrom, pos), []).append(ratio)
    for (chrom, pos), own in sites.items():
        near = [(abs(p - pos) / 10, np.log1p(len(v)), np.mean(v)) for (c, p), v in sites.items() if c == chrom and abs(p - pos) < 10]
        weights = [(1 - d**3) ** 3 * w for d, w, _ in near]
        assert np.isclose(got[chrom, pos].smoothed, np.average([m for *_, m in near], weights=weights)) and got[chrom, pos].n_cells == len(own)
    assert len(got) == len(sites) and any(p % 40 in (0, 39) for _, p in sites)


def test_profile_turns_minus_and_counts_for_all_starts(spark):
    sites = spark.createDataFrame([(1, "chr1", p, 1, 1) for p in (89, 90, 95, 105, 110, 111)] + [(2, "chr2", 100, 1, 0)], "cell_no long, chrom string, pos long, mc long, uc long")
    starts = spark.createDataFrame([("chr1", 99, 101, "+"), ("chr1", 100, 100, "-"), ("chr3", 5, 6, "+")], "chrom string, start_pos long, end_pos long, strand string")
    got = {(x.cell_no, x.offset): (x.mc, x["cov"], x.n_sites, x.level) for x in methylome.start_profile(sites, starts, 11, 5).collect()}
    want = {}
    for pos in (90, 95, 105, 110):
        for turn in (1, -1):
            offset = int(np.floor((pos - 100) * turn / 5) * 5)
            n = want.get((1, offset), (0,))[0] + 1
            want[1, offset] = (n, 2 * n, n, 0.5)
    assert got == want


def test_regions_find_planted_variance(spark):
    r = np.random.default_rng(5)
    rows = [("chr1", p, c, float(np.clip(0.5 + (0.45 if c % 2 else -0.45) * (1000 <= p < 1300) + r.normal() / 50, 0, 1))) for p in range(0, 3000, 10) for c in range(10)]
    found = methylome.variable_regions(spark.createDataFrame(rows, VALUES), 100, 50, 0.08, 6, 400).collect()
    assert found and all(900 <= x.start_pos and x.end_pos <= 1400 for x in found)
    assert methylome.variable_regions(spark.createDataFrame([], VALUES)).count() == 0


def test_permuted_p_of_planted_and_null_places(spark):
    r = np.random.default_rng(6)
    rows = [(c, place, float(r.normal() + (4 if place < 10 and c < 20 else 0))) for c in range(40) for place in range(200)]
    values = spark.createDataFrame(rows, "cell_no long, place long, value double")
    labels = methylome.permuted_labels(spark.createDataFrame([(c, "a" if c < 20 else "b") for c in range(40)], "cell_no long, side string"), ("a", "b"), 4, 3)
    sizes = {(x.permutation, x.side): x["count"] for x in labels.groupBy("permutation", "side").count().collect()}
    assert sizes == {(p, s): 20 for p in range(5) for s in "ab"}
    statistics = methylome.permuted_statistics(values, labels, ("a", "b"), ["place"])
    got = {x.place: x for x in methylome.permuted_fdr(statistics, ["place"]).collect()}
    drawn = np.array([abs(x.t) for x in statistics.where("permutation > 0").collect()])
    assert all(np.isclose(x.p, (1 + (drawn >= abs(x.t)).sum()) / (1 + len(drawn))) for x in got.values())
    p = np.array([got[i].p for i in range(200)])
    order = np.argsort(p)
    bounds = np.minimum.accumulate((p[order] * 200 / np.array([(p <= x).sum() for x in p[order]]))[::-1])[::-1]
    assert np.allclose([got[i].adjusted_p for i in order], np.minimum(bounds, 1))
    assert all(got[i].adjusted_p < 0.05 for i in range(10))
    alone = methylome.permuted_fdr(statistics.where("permutation = 0"), ["place"])
    assert alone.where("p is not null or adjusted_p is not null").count() == 0 and alone.count() == 200


@pytest.mark.parametrize("call", [lambda v: methylome.smooth_means(v, 0), lambda v: methylome.variable_regions(v, share=0), lambda v: methylome.variable_regions(v, step=0), lambda v: methylome.start_profile(v, v, -1)])
def test_ranges_are_checked(spark, call):
    with pytest.raises(ValueError):
        call(spark.createDataFrame([], VALUES))


def test_tasks_grow_with_the_values(spark):
    values = spark.createDataFrame([("1", p, c, 0.5 * (p % 3)) for p in range(0, 4000, 7) for c in range(3)], VALUES)
    rows = 5 << 20
    assert methylome.smooth_means(values, 200, rows=rows).rdd.getNumPartitions() == 5
    rests = methylome.residuals(values, 200, rows)
    assert rests.rdd.getNumPartitions() == 5
    assert methylome.window_residuals(rests, 200, 50, rows).rdd.getNumPartitions() == 20
    several = {tuple(x) for x in methylome.smooth_means(values, 200, rows=rows).collect()}
    assert several == {tuple(x) for x in methylome.smooth_means(values, 200).collect()}


def test_few_cells_with_many_values_stay_where_they_are(spark):
    values = spark.range(3000, numPartitions=7).selectExpr("id % 100 as place", "id % 2 as cell_no", "cast(id % 11 as double) as value")
    labels = spark.createDataFrame([(c, p, "ab"[(c + p) % 2]) for c in range(2) for p in range(4)], "cell_no long, permutation int, side string")
    statistics = methylome.permuted_statistics(values, labels, ("a", "b"), ["place"])
    assert "SortMergeJoin" not in statistics._jdf.queryExecution().executedPlan().toString()
    assert statistics.count() == 100 * 4
