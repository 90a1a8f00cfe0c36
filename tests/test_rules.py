"""Small cases of site, label, matrix and status rules."""

from __future__ import annotations

import gzip

import pytest
from pyspark.sql import functions as F

from cytolith.functions import ids, labels
from cytolith.operators import annotation, matrix, sites
from cytolith.sources import sinks, tables

SITE = "sample string, cell_no long, chrom string, pos long, end_pos long, prob double, mc long, uc long, line_no long"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_dedup_keeps_the_first_of_equal_and_drops_the_rest(spark):
    data = [
        ("S", 1, "chr1", 5, 6, 50.0, 1, 1, 0), ("S", 1, "chr1", 5, 6, 50.0, 2, 2, 1), ("S", 1, "chr1", 9, 10, 100.0, 1, 0, 2), ("S", 1, "chr1", 9, 10, 0.0, 0, 1, 3),
        ("S", 1, "chr1", 11, 12, 0.0, 0, 0, 4), ("S", 1, "chr1", 11, 13, 7.0, 0, 0, 5), ("S", 1, "chr1", 20, 21, 33.0, 1, 3, 6), ("S", 1, "chr1", 20, 21, 25.0, 2, 6, 7), ("S", 1, "chr1", 30, 31, None, 1, 1, 8),
    ]
    df = spark.createDataFrame(data, SITE)
    assert rows(sites.dedup_by_probability(df)) == [data[0], data[4], data[5]]
    assert rows(sites.dedup_stats(df)) == [("S", 1, 9, 3, 3, 1, 2, 6, True)]


def test_sites_without_coverage(spark):
    df = spark.createDataFrame([("S", 1, "chr1", 5, 6, 0.0, 0, 0, 0), ("S", 1, "chr1", 5, 6, 0.0, 0, 0, 1), ("S", 1, "chr1", 7, 8, 50.0, 1, 1, 2), ("S", 2, "chr1", 7, 8, 0.0, 0, 0, 3)], SITE)
    merged = {(r.cell_no, r.pos): (r.ratio, r.discordant) for r in sites.merge_counts(df).collect()}
    assert merged == {(1, 5): (None, False), (1, 7): (0.5, False), (2, 7): (None, False)}
    assert [(r.mean_site_level, r.overall_level) for r in sites.cell_levels(df).orderBy("cell_no").collect()] == [(0.5, 0.5), (None, None)]
    regions = spark.createDataFrame([("chr1", 0, 9)], "chrom string, start_pos long, end_pos long")
    assert sorted((r.cell_no, r.mean_ratio) for r in sites.region_mean(df, regions).collect()) == [(1, 0.5), (2, None)]


def test_audit_counts_runs(spark):
    data = [("S", 1, "chr1", 5, 6, 50.0, 1, 1, 0), ("S", 1, "chr1", 5, 6, 50.0, 2, 2, 1), ("S", 1, "chr2", 1, 2, 0.0, 1, 0, 2), ("S", 1, "chr1", 3, 4, 0.0, 0, 1, 3), ("S", 1, "chr1", 2, 3, 0.0, 0, 1, 4), ("S", 1, "chr1", 2, 4, 0.0, 0, 1, 5)]
    found = sites.audit_duplicates(spark.createDataFrame(data, SITE)).first().asDict()
    assert (found["duplicate_loci"], found["exact_loci"], found["conflicting_loci"]) == (1, 0, 1)
    assert (found["descents"], found["reentries"], found["ordering_ok"]) == (1, 1, False)


def test_expression_counts_absent_values_as_zero(spark):
    from cytolith.operators import expression

    values = spark.createDataFrame([(1, 7, 3.0), (2, 8, 1.0), (3, 8, 1.0)], "cell_no long, gene_no long, value double")
    groups = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "cell_no long, group string")
    assert rows(expression.dotplot(values, groups)) == [("a", 7, 1.5, 0.5), ("a", 8, 0.5, 0.5), ("b", 7, 0.0, 0.0), ("b", 8, 1.0, 1.0)]
    assert {r.gene_no: (r.mean, round(r.variance, 9), r.n_cells) for r in expression.moments(values, "value").collect()} == {7: (1.0, 3.0, 1), 8: (2 / 3, round(1 / 3, 9), 2)}
    assert {(r.gene_no, r.group): (r.n1, r.u) for r in expression.rank_sum(values, groups).collect()} == {(7, "a"): (2, 1.5), (7, "b"): (1, 0.5), (8, "a"): (2, 0.5), (8, "b"): (1, 1.5)}


def test_files_may_have_further_columns(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "a.cov").write_text("chr1\t5\t6\t50\t1\t1\textra\nchr1\t7\t8\t0\t0\t0\n")
    (tmp_path / "s" / "b.cov").write_text("chr1\t5\t6\t50\t1\nchr1\t9\t10\t50\t1\t1\tx\ty\n")
    assert sorted(r.start_pos for r in tables.read_sites(spark, str(tmp_path / "s"), strict=False).collect()) == [5, 9]
    assert sorted((r.n_lines, r.n_bad, r.n_uncovered) for r in tables.left_out(spark, str(tmp_path / "s")).collect()) == [(2, 0, 1), (2, 1, 0)]
    with pytest.raises(Exception, match="not a site"):
        tables.read_sites(spark, str(tmp_path / "s" / "b.cov")).collect()
    (tmp_path / "c").write_text("chr1\t5\t+\tCGA\t1\t2\nchr1\t6\t+\tCGA\t1\t2\t1\t9\n")
    assert [(r.pos0, r.flag) for r in tables.read_context_sites(spark, str(tmp_path / "c")).orderBy("pos").collect()] == [(4, None), (5, 1)]


def test_runs_cross_blocks(spark):
    labels_ = "aabbbbabbbaaaaaaac"
    df = spark.createDataFrame([(i, c) for i, c in enumerate(labels_)], "at long, c string")
    for block in (1, 3, 100):
        found = sorted((r.first, r.last, r.c, r.n) for r in matrix.label_runs(df, [], "at", "c", block).collect())
        assert found == [(0, 1, "a", 2), (2, 5, "b", 4), (6, 6, "a", 1), (7, 9, "b", 3), (10, 16, "a", 7), (17, 17, "c", 1)]


def test_bins_of_context_rows(spark):
    data = [("chr1", 1, "CGN", 1, 2), ("chr1", 5000, "CGN", 2, 3), ("chr1", 5001, "CGN", 4, 5), ("chr1", 6000, "CHN", 9, 9)]
    df = spark.createDataFrame(data, "chrom string, pos long, context string, mc long, cov long").where(sites.in_context(F.col("context"), "CGN"))
    shaped = df.select(F.lit("S").alias("sample"), F.lit(1).alias("cell_no"), "chrom", (F.col("pos") - 1).alias("pos"), "mc", (F.col("cov") - F.col("mc")).alias("uc"))
    bins = spark.createDataFrame([("chr1", 0), ("chr1", 1)], "chrom string, bin long")
    assert [r[3:] for r in rows(sites.aggregate_bins(shaped, bins, 5000))] == [(0, 3, 5), (1, 4, 5)]


def test_identifiers(spark):
    names = ["D01-AA-BB", " IR01_X", "IR01__X", "25110891_IR01_Met__X", "-X"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select(ids.canonical_cell_id(F.col("n")))
    assert [r[0] for r in df.collect()] == ["D01_AA-BB", "IR01__X", "IR01__X", "IR01__X", "-X"]


def test_region_names(spark):
    df = spark.createDataFrame([("chr1-0-5000",), ("chr1:10000-15000",), ("x",)], "n string").select(*labels.parse_region(F.col("n")))
    assert [tuple(r) for r in df.collect()] == [("chr1", 0, 5000), ("chr1", 10000, 15000), (None, None, None)]


def test_booleans(spark):
    df = spark.createDataFrame([("TRUE",), ("y",), ("",), (None,)], "b string")
    assert [r[0] for r in df.select(labels.parse_bool(F.col("b"))).collect()] == [True, True, False, False]
    with pytest.raises(Exception, match="not a boolean"):
        spark.createDataFrame([("maybe",)], "b string").select(labels.parse_bool(F.col("b"))).collect()


def test_zscore_needs_enough_values_and_spread(spark):
    data = [("a", float(i)) for i in range(30)] + [("b", float(i)) for i in range(29)] + [("c", 1.0)] * 40 + [("a", None)]
    out = matrix.zscore(spark.createDataFrame(data, "g string, value double"), ["g"])
    counts = {r.g: r.n for r in out.groupBy("g").agg(F.count("z").alias("n")).collect()}
    assert counts == {"a": 30, "b": 0, "c": 0}


@pytest.mark.parametrize(
    ("counts", "target", "expected"), [([5, 5, 3, 1], 2, 3), ([5, 5, 3, 1], 3, 1), ([5, 5, 3, 1], 4, 0), ([5, 5, 3, 2], 1, 5)]
)
def test_threshold_for_a_target(spark, counts, target, expected):
    support = spark.createDataFrame([("chr1", i, n) for i, n in enumerate(counts)], "chrom string, bin long, n_cells long")
    found = sites.threshold_for_target(support, 10, target).first()
    assert found.threshold == expected
    assert sum(n > found.threshold for n in counts) <= target


def test_threshold_beyond_the_supported_bins_is_an_error(spark):
    with pytest.raises(Exception, match="exceeds"):
        sites.threshold_for_target(spark.createDataFrame([("chr1", 0, 1)], "chrom string, bin long, n_cells long"), 10, 2).collect()


@pytest.mark.parametrize(("sizes", "bins", "expected"), [([3, 2, 0], 9, [3, 2, 0]), ([10, 10, 0], 5, [3, 2, 0]), ([8, 1, 1], 4, [2, 1, 1])])
def test_bin_allocation(spark, sizes, bins, expected):
    df = spark.createDataFrame([(f"g{i}", n, i) for i, n in enumerate(sizes)], "group string, n long, nth int")
    assert [r.n_bins for r in matrix.allocate_bins(df, bins).orderBy("group").collect()] == expected


def test_status_needs_current_cells_in_the_clean_list(spark):
    of = lambda *x: spark.createDataFrame([(i,) for i in x], "k long")
    assert rows(annotation.cell_status(of(1, 2, 3), of(1), of(1, 2), "k")) == [(1, "retained"), (2, "qc_removed"), (3, "clean_list_removed")]
    with pytest.raises(Exception, match="clean list"):
        annotation.cell_status(of(1), of(1), of(2), "k").collect()


def test_single_supporter_wins_without_a_value(spark):
    means = spark.createDataFrame([("r1", "A", 0.5), ("r2", "A", 0.2), ("r2", "B", 0.2), ("r3", "A", 0.1), ("r3", "B", 0.4)], "region string, cell_type string, mean_value double")
    support = spark.createDataFrame([("r1", "B"), ("r2", "A"), ("r2", "B"), ("r3", "A"), ("r3", "B")], "region string, cell_type string")
    found = {r.region: (r.cell_type, r.rule) for r in matrix.assign_region_type(means, support, ["region"]).collect()}
    assert found == {"r1": ("B", "single"), "r2": ("Unresolved", "tie"), "r3": ("A", "lowest")}


def test_files_there_and_back(spark, tmp_path):
    (tmp_path / "in").mkdir()
    with gzip.open(tmp_path / "in" / "S1.cov.gz", "wt") as f:
        f.write("chr1\t5\t6\t50\t1\t1\nchr1\t9\t10\t0\t0\t2\n")
    df = tables.read_sites(spark, str(tmp_path / "in"))
    assert [(r.chrom, r.start_pos, r.mc, r.uc) for r in df.orderBy("start_pos").collect()] == [("chr1", 5, 1, 1), ("chr1", 9, 0, 2)]
    lines = tables.numbered_lines(spark, str(tmp_path / "in")).orderBy("line_no").collect()
    assert [(r.line_no, r.line[:6]) for r in lines] == [(0, "chr1\t5"), (1, "chr1\t9")]
    with gzip.open(tmp_path / "in" / "S2.cov.gz", "wt") as f:
        f.write("chr1\tx\t6\t50\t1\t1\n")
    with pytest.raises(Exception, match="not a site"):
        tables.read_sites(spark, str(tmp_path / "in")).collect()
    values = spark.createDataFrame([("chr1", 0, 5, "a", 0.25), ("chr1", 0, 5, "b", None)], "chrom string, start_pos long, end_pos long, cell string, value double")
    sinks.write_region_matrix(values, str(tmp_path / "out"), ["a", "b"])
    back = spark.read.csv(str(tmp_path / "out"), sep="\t", header=True).collect()
    assert [tuple(r) for r in back] == [("chr1", "0", "5", "0.25000000", "NA")]


def test_new_files_are_taken_once(spark, tmp_path):
    from cytolith.streaming import incremental

    source, out, mark = (str(tmp_path / x) for x in ("source", "out", "mark"))
    (tmp_path / "source").mkdir()
    for n in (1, 2):
        (tmp_path / "source" / f"c{n}.tsv").write_text("chr1\t5\t6\t50\t1\t1\n" * n)
        incremental.append_levels(incremental.read_stream(spark, source), out, mark).awaitTermination()
        assert sorted(r.n_sites for r in incremental.read_levels(spark, out).collect()) == list(range(1, n + 1))


def test_joins_that_have_to_be_complete(spark):
    left, right = spark.createDataFrame([(1, "a"), (2, "b")], "k long, x string"), spark.createDataFrame([(1, "c"), (2, "d"), (3, "e")], "k long, y string")
    assert rows(annotation.complete_join(left, right, "k")) == [(1, "a", "c"), (2, "b", "d")]
    for bad in (right.where("k <> 2"), right.union(right.where("k = 1"))):
        with pytest.raises(Exception, match="partners"):
            annotation.complete_join(left, bad, "k").collect()


def test_fallback_records(spark):
    from cytolith.operators import regions

    data = [("f", "0.5", "NA"), ("f", "1e-9", "NA"), ("g", ".5", "NA"), ("h", "0.5", "0.1"), ("i", None, "NA")]
    df = spark.createDataFrame(data, "file string, raw_p string, adjusted_p string")
    assert {r.file: (r.n_records, r.n_bad, r.valid) for r in regions.fallback_validity(df, ["file"]).collect()} == {"f": (2, 0, True), "g": (1, 1, False), "h": (1, 1, False), "i": (1, 1, False)}


def test_parameters_out_of_range(spark):
    from cytolith.operators import regions

    df = spark.createDataFrame([], SITE)
    for call in (lambda: regions.windows(df, 0, 1), lambda: regions.windows(df, 1, 0), lambda: sites.aggregate_bins(df, df, 0)):
        with pytest.raises(ValueError, match="no (windows|size)"):
            call()


def test_neighbours_leave_null_vectors_out(spark):
    from cytolith.operators import neighbours

    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 3.0]), (3, None), (4, [None, 1.0]), (5, [0.0, 1.0])], "id long, v array<double>")
    assert [(r.from_id, r.to_id, r.distance) for r in neighbours.knn(df, "id", "v", 1).orderBy("from_id").collect()] == [(1, 5, 1.0), (2, 5, 2.0), (5, 1, 1.0)]
    assert neighbours.knn(df.where("id = 3"), "id", "v", 1).count() == 0


def test_settings_out_of_range(spark):
    from cytolith.operators import expression, integration, neighbours, regions

    df = spark.createDataFrame([], SITE)
    calls = {
        "raw_p": lambda: regions.select_hypo(df, raw_p=1.5), "above": lambda: regions.select_response(df, above=-1), "q": lambda: regions.select_q(df, "x", 2), "n =": lambda: regions.top_intervals(df, 0),
        "min_level": lambda: sites.cell_qc_filter(df, min_level=2), "min_sites": lambda: sites.cell_qc_filter(df, 5, 4), "cutoff": lambda: sites.bin_support(df, 1.2), "target": lambda: sites.threshold_for_target(df, 3, -1),
        "mt": lambda: expression.rna_qc_filter(df, mt=101), "low": lambda: expression.rna_qc_filter(df, 9, 8), "min_cells": lambda: expression.gene_filter(df, 0), "rate": lambda: integration.doublet_scores(df, 1.5),
        "clusters": lambda: integration.correct_batches(df, clusters=0), "k =": lambda: neighbours.knn(spark.createDataFrame([], "id long, v array<double>"), "id", "v", 0),
    }
    for name, call in calls.items():
        with pytest.raises(ValueError, match=name):
            call()


def test_checks_name_what_is_wrong(spark):
    from cytolith.operators import checks

    df = spark.createDataFrame([("s", 1, "chr1", 5, 6, 1.0, 1, 1, 0), ("s", 2, "chr1", 7, 8, 1.0, 0, 0, 3), ("s", 2, "chr1", 7, 8, 1.0, None, 1, 4)], SITE)
    assert checks.valid_counts(df.where("cell_no = 1"), ["cell_no", "line_no"]).count() == 1
    for line in (3, 4):
        with pytest.raises(Exception, match=f"no valid counts at cell_no=2, line_no={line}"):
            checks.valid_counts(df.where(f"line_no = {line}"), ["cell_no", "line_no"]).collect()
    text = spark.createDataFrame([("a", "12", " 3"), ("b", "1.5", "4"), ("c", None, "4")], "file string, mc string, uc string")
    assert [(r.mc, r.uc) for r in checks.whole_numbers(text.where("file = 'a'"), ["mc", "uc"], ["file"]).collect()] == [(12, 3)]
    for file in "bc":
        with pytest.raises(Exception, match=f"mc is no whole number at file={file}"):
            checks.whole_numbers(text.where(f"file = '{file}'"), ["mc", "uc"], ["file"]).collect()
    levels = sites.cell_levels(df.where("cell_no = 1 or uc = 0"))
    checks.covered_cells(levels, df.where("cell_no = 1"), ["sample", "cell_no"])
    with pytest.raises(ValueError, match="no usable site in: sample=s, cell_no=2"):
        checks.covered_cells(levels, df, ["sample", "cell_no"])
    checks.unique(df, ["cell_no", "line_no"])
    with pytest.raises(ValueError, match="not unique: cell_no=2, pos=7, rows=2"):
        checks.unique(df, ["cell_no", "pos"])
    samples = spark.createDataFrame([("IR",)] * 5 + [("NR",)] * 4, "condition string")
    checks.expected_counts(samples, "condition", {"IR": 5}, 9)
    with pytest.raises(ValueError, match="NR: 4 instead of 5; all: 9 instead of 10"):
        checks.expected_counts(samples, "condition", {"IR": 5, "NR": 5}, 10)
    a, b = spark.createDataFrame([(1,), (2,)], "k long"), spark.createDataFrame([(1,), (3,)], "k long")
    assert checks.same_cells(a, a, "k", 2) == 2
    for table, message in ((a.union(a), "source=2 table=4 unique=2"), (b, "not in the table: k=2"), (a, "2 cells instead of 3")):
        with pytest.raises(ValueError, match=message):
            checks.same_cells(a, table, "k", 3)


def test_numbers_as_c_writes_them(spark):
    values = [0.0, 1.0, -2.5, 1e-5, 0.0001234567891, 123456789.0, 1e15, 1 / 3, -1e-300, 99999999.6, 12345678.0, 5e22, None, float("nan"), float("-inf")]
    df = spark.createDataFrame([(x,) for x in values], "x double").select("x", *[labels.number_general(F.col("x"), d).alias(f"g{d}") for d in (3, 8, 12)])
    for r in df.collect():
        for d in (3, 8, 12):
            assert r[f"g{d}"] == ("NA" if r.x is None else f"%.{d}g" % r.x)


def test_regions_without_supporters_stay(spark):
    means = spark.createDataFrame([("r1", "A", 0.5), ("r2", "A", 0.2), ("r2", "B", 0.1), ("r4", "A", None)], "region string, cell_type string, mean_value double")
    support = spark.createDataFrame([("r2", "X"), ("r3", "A"), ("r4", "A"), ("r4", "B")], "region string, cell_type string")
    found = {r.region: (r.cell_type, r.rule, r.hypo_difference) for r in matrix.assign_region_type(means, support, ["region"], known=["A", "B"]).collect()}
    assert found == {"r1": ("Unresolved", "unsupported", None), "r2": ("Unresolved", "unsupported", None), "r3": ("A", "single", None), "r4": ("Unresolved", "unobserved", None)}


def test_p_of_the_normal_distribution(spark):
    import math

    from cytolith.operators import expression

    df = spark.createDataFrame([(float(z),) for z in (0, 0.5, -1.96, 3, 8, -20)], "z double").select("z", expression.two_sided_p(F.col("z")).alias("p"))
    for r in df.collect():
        assert abs(r.p / math.erfc(abs(r.z) / math.sqrt(2)) - 1) < 2e-7
    p = [0.01, 0.02, 0.02, 0.5, None]
    rows = expression.adjusted(spark.createDataFrame([("g", i, x) for i, x in enumerate(p)], "g string, i int, p double"), ["g"]).orderBy("i").collect()
    assert [None if r.adjusted_p is None else round(r.adjusted_p, 9) for r in rows] == [round(0.02 * 4 / 3, 9)] * 3 + [0.5, None]


def test_files_are_ordered_by_ranges(spark, monkeypatch):
    import random

    from cytolith.operators import sites

    r = random.Random(5)
    rows, place = [], (1, 10)
    for n in range(300):
        place = place if r.random() < 0.5 else (r.randrange(3), r.randrange(40))
        rows.append(("S" if n % 7 else None, n % 2, f"chr{place[0]}", place[1], place[1] + 1, r.choice([0.0, 50.0]), 1, 1, n))
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "sample string, cell_no long, chrom string, pos long, end_pos long, prob double, mc long, uc long, line_no long")
    whole = [sorted(map(str, f(df).collect())) for f in (sites.audit_duplicates, sites.order_audit)]
    monkeypatch.setattr(sites, "LINES", 20)
    assert sites._in_order(df, "line_no", ["chrom", "pos"]).select("part").distinct().count() > 10
    assert [sorted(map(str, f(df).collect())) for f in (sites.audit_duplicates, sites.order_audit)] == whole
