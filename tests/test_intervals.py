"""Interval algebra against brute force over positions."""

from __future__ import annotations

import random

import pytest

from cytolith.operators import intervals

PLACE = "chrom string, start_pos long, end_pos long"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def drawn(seed: int, n: int, longest: int = 9):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        start = r.randrange(60)
        out.append((f"chr{r.randrange(2)}", start, start + 1 + r.randrange(longest)))
    return out


def merged(rows, touching):
    out = []
    for chrom, start, end in sorted(rows):
        if out and out[-1][0] == chrom and (start <= out[-1][2] if touching else start < out[-1][2]):
            out[-1][2] = max(out[-1][2], end)
            out[-1][3] += 1
        else:
            out.append([chrom, start, end, 1])
    return [tuple(x) for x in out]


@pytest.mark.parametrize("touching", [True, False])
@pytest.mark.parametrize("seed", [1, 2])
def test_merge(spark, touching, seed, monkeypatch):
    monkeypatch.setattr(intervals, "BLOCK", 7)
    data = drawn(seed, 25)
    assert rows(intervals.merge_intervals(spark.createDataFrame(data, PLACE), touching=touching)) == merged(data, touching)


def test_touching_intervals_differ(spark):
    df = spark.createDataFrame([("chr1", 0, 5), ("chr1", 5, 9)], PLACE)
    assert rows(intervals.merge_intervals(df, touching=True)) == [("chr1", 0, 9, 2)]
    assert rows(intervals.merge_intervals(df, touching=False)) == [("chr1", 0, 5, 1), ("chr1", 5, 9, 1)]


def test_merge_of_an_empty_table(spark):
    assert rows(intervals.merge_intervals(spark.createDataFrame([], PLACE))) == []


@pytest.mark.parametrize("seed", [3, 4])
def test_semi_and_anti_joins(spark, seed):
    left, right = drawn(seed, 20), drawn(seed + 10, 6)
    meets = lambda a: any(a[0] == b[0] and a[1] < b[2] and b[1] < a[2] for b in right)
    a, b = spark.createDataFrame(left, PLACE), spark.createDataFrame(right, PLACE)
    assert rows(intervals.keep_overlapping(a, b, size=5)) == sorted(x for x in left if meets(x))
    assert rows(intervals.drop_overlapping(a, b, size=5)) == sorted(x for x in left if not meets(x))


def test_fraction_counts_single_intervals(spark):
    a = spark.createDataFrame([("chr1", 0, 10)], PLACE)
    b = spark.createDataFrame([("chr1", 0, 1), ("chr1", 9, 10)], PLACE)
    assert rows(intervals.drop_overlapping(a, b, least_fraction=0.2)) == [("chr1", 0, 10)]
    assert rows(intervals.drop_overlapping(a, b, least_fraction=0.1)) == []


@pytest.mark.parametrize("seed", [5, 6])
def test_consensus(spark, seed):
    data = [(("x", "y", "z")[i % 3], *row) for i, row in enumerate(drawn(seed, 30))]
    df = spark.createDataFrame(data, "label string, " + PLACE)
    common = {(c, p) for c in ("chr0", "chr1") for p in range(80) if {d[0] for d in data if d[1] == c and d[2] <= p < d[3]} == {"x", "y", "z"}}
    got = intervals.consensus(df, "label", ["x", "y", "z"]).collect()
    assert {(r.chrom, p) for r in got for p in range(r.start_pos, r.end_pos)} == common
    assert rows(intervals.consensus(df, "label", ["x", "y", "z", "absent"])) == []


def test_points_in_regions(spark):
    points = spark.createDataFrame([("chr1", p) for p in (0, 4, 5, 9, 10)], "chrom string, pos long")
    regions = spark.createDataFrame([("chr1", 0, 5), ("chr1", 5, 10)], PLACE)
    found = intervals.points_in_regions(points, regions, size=3).select("pos", "region_start")
    assert rows(found) == [(0, 0), (4, 0), (5, 5), (9, 5)]


def test_bins_are_whole(spark):
    bins = intervals.make_bins(spark.createDataFrame([("chr1", 12), ("chr2", 3)], "chrom string, length long"), 5)
    assert rows(bins) == [("chr1", 0, 0, 5), ("chr1", 1, 5, 10)]


def test_sweeps_by_block_are_those_of_the_whole(spark, monkeypatch):
    import random

    r = random.Random(3)
    data = [(r.choice("ab"), r.choice(["chr1", "chr2"]), s := r.randrange(200), s + r.randrange(1, 30)) for _ in range(60)]
    df = spark.createDataFrame(data, "label string, chrom string, start_pos long, end_pos long")

    def found():
        united = intervals.consensus(df, "label", ["a", "b"])
        pairs = intervals.overlapping_pairs(df.drop("label"))
        return sorted(tuple(x) for x in united.collect()), sorted(tuple(x) for x in pairs.collect())

    whole = found()
    monkeypatch.setattr(intervals, "BLOCK", 7)
    assert found() == whole and whole[0]
    covered = {(c, x) for c in ("chr1", "chr2") for x in range(240) if all(any(k == l and d == c and s <= x < e for k, d, s, e in data) for l in "ab")}
    assert {(c, x) for c, s, e in whole[0] for x in range(s, e)} == covered


def test_distinct_rows_and_bins_take_as_many_tasks_as_they_need(spark):
    from cytolith.operators import sites

    table = spark.createDataFrame([("1", 5, 9), ("1", 5, 9), (None, 5, 9)], "chrom string, start_pos long, end_pos long")
    found = intervals.distinct_rows([table, table], rows=7 << 20)
    assert found.rdd.getNumPartitions() == 7
    assert {tuple(x) for x in found.collect()} == {("1", 5, 9), (None, 5, 9)} and found.count() == 2
    lines = spark.createDataFrame([("s", 1, "1", p, 1, 0) for p in (3, 4, 60)], "sample string, cell_no long, chrom string, pos long, mc long, uc long")
    bins = spark.createDataFrame([("1", 0)], "chrom string, bin long")
    binned = sites.aggregate_bins(lines, bins, 50, rows=7 << 20)
    assert "hashpartitioning(chrom" in (plan := binned._jdf.queryExecution().executedPlan().toString()) and ", 7), REPARTITION_BY_NUM" in plan
    assert [tuple(x) for x in binned.select("bin", "mc", "cov").collect()] == [(0, 2, 2)]


def test_bins_are_never_broadcast(spark):
    """An exploded range looks like one row per chromosome to Spark, in the plan and while it runs."""
    from cytolith.operators import sites

    lines = spark.createDataFrame([("s", 1, "1", p, 1, 0) for p in range(0, 3000, 30)], "sample string, cell_no long, chrom string, pos long, mc long, uc long")
    sizes = spark.createDataFrame([("1", 1000), ("1", 2000)], "chrom string, length long").groupBy("chrom").agg({"length": "max"}).toDF("chrom", "length")
    binned = sites.aggregate_bins(lines, intervals.make_bins(sizes, 50), 50, rows=100, each=20)
    assert len(binned.collect()) == 40 and "Broadcast" not in binned._jdf.queryExecution().executedPlan().toString()
    assert [sites.sites_each(n) for n in (10, 36_000_000, 1 << 40)] == [1 << 17, 180_000, 1 << 20]
    assert ", 5), REPARTITION_BY_NUM" in binned._jdf.queryExecution().executedPlan().toString()
