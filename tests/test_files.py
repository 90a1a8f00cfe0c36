"""Tables of files and the writers of named regions, records and groups."""

from __future__ import annotations

import glob

import pytest

from cytolith.sources import files, sinks, tables


def paths(spark, *names):
    return spark.createDataFrame([(x,) for x in names], "path string")


def test_context_files(spark):
    rows = files.context_index(paths(spark, "/a/IR01-AA.allc.tsv.gz", "/a/x-y.allc.tsv.gz", "/a/IR01-CC.allc.tsv", "/a/readme.txt", "/a/x-y.allc.tsv.gz")).collect()
    assert sorted((r.cell, r.path) for r in rows) == [("IR01__AA", "/a/IR01-AA.allc.tsv.gz"), ("x_y", "/a/x-y.allc.tsv.gz")]
    assert [r.cell for r in files.context_index(paths(spark, "/a/IR01-CC.allc.tsv")).collect()] == ["IR01__CC"]
    assert files.context_index(paths(spark)).count() == 0
    with pytest.raises(Exception, match="two files of one cell"):
        files.context_index(paths(spark, "/a/IR01-AA.allc.tsv.gz", "/b/IR01__AA.allc.tsv.gz")).collect()


def test_coverage_files(spark):
    folder = "/d/25110891_IR01_Met/cov_dedup_probability"
    rows = files.coverage_index(paths(spark, f"{folder}/AA.cov.gz", f"{folder}/IR01_CC.cov", f"{folder}/x.txt", "/d/25110891_IR01_Met/raw/GG.cov", "/d/other/cov_dedup_probability/GG.cov")).collect()
    assert sorted(r.cell for r in rows) == ["IR01__AA", "IR01__CC"]
    with pytest.raises(Exception, match="two files of one cell"):
        files.coverage_index(paths(spark, f"{folder}/AA.cov.gz", f"{folder}/IR01_AA.cov")).collect()
    with pytest.raises(Exception, match="no sample in"):
        files.coverage_index(paths(spark, "/d/25110891_XX_Met/cov_dedup_probability/AA.cov")).collect()


def test_record_files(spark):
    found = ["/r/IR01_sample_celltype/IR01__A_vs_B_DMRs.bed", "/r/IR01__A_vs_C_DMRs.bed", "/r/sample_celltype/IR02__A_vs_B_DMRs.bed", "/f/IR02__B_vs_C_DMRs.bed"]
    others = ["/r/notes_DMRs.bed", "/r/deep/er/IR01__X_vs_Y_DMRs.bed", "/f/deep/IR01__X_vs_Z_DMRs.bed", "/else/IR01__X_vs_Z_DMRs.bed"]
    rows = files.record_files(paths(spark, *found, *others, found[0]), "/r/", ["/f"]).collect()
    assert sorted((r.sample, r.left_type, r.right_type, r.source) for r in rows) == [
        ("IR01", "A", "B", "standard:IR01_sample_celltype/IR01__A_vs_B_DMRs.bed"), ("IR01", "A", "C", "standard:IR01__A_vs_C_DMRs.bed"),
        ("IR02", "A", "B", "standard:sample_celltype/IR02__A_vs_B_DMRs.bed"), ("IR02", "B", "C", "rawp_fallback_no_null_dmrs:IR02__B_vs_C_DMRs.bed"),
    ]
    assert files.record_files(paths(spark, *found), "/r", samples=["IR02"]).count() == 1
    with pytest.raises(Exception, match="two files of one comparison"):
        files.record_files(paths(spark, found[0], "/f/IR01__A_vs_B_DMRs.bed"), "/r", ["/f"]).collect()
    with pytest.raises(Exception, match="folder's sample"):
        files.record_files(paths(spark, "/r/IR01_sample_celltype/IR02__A_vs_B_DMRs.bed"), "/r").collect()


def lines(folder):
    return [x for name in sorted(glob.glob(f"{folder}/**/part-*", recursive=True)) for x in open(name).read().splitlines()]


def test_records_keep_their_text(spark, tmp_path):
    text = ["chr1\t5\t9\t1.50\t3\t4\t4\t0.10\t0.5\tgroup_A\t0.010\tNA", "chr1\t2\t4\t-2e0\t3\t4\t4\t0.9\t0.50\tgroup_B\t1e-3\t0.05"]
    source = tmp_path / "IR01__A_b_vs_C_DMRs.bed"
    source.write_text("\n".join(text) + "\n")
    records = tables.read_records(spark, str(source))
    assert [(r.sample, r.left_type, r.right_type) for r in records.collect()] == [("IR01", "A_b", "C")] * 2
    sinks.write_lines(records, str(tmp_path / "out"))
    assert lines(tmp_path / "out") == text[::-1]
    source.rename(tmp_path / "odd.bed")
    with pytest.raises(Exception, match="not a region record"):
        tables.read_records(spark, str(tmp_path / "odd.bed")).collect()
    assert [x.path.rsplit("/", 1)[1] for x in files.listing(spark, str(tmp_path / "*.bed")).collect()] == ["odd.bed"]


def test_named_regions_and_groups(spark, tmp_path):
    regions = spark.createDataFrame([("IR01", "A", "chr10", 1, 2), ("IR01", "A", "chr2", 5, 6), ("IR01", "A", "chr2", 1, 3), ("IR01", "B", "chr1", 1, 2)], "sample string, cell_type string, chrom string, start_pos long, end_pos long")
    named = sinks.named_regions(regions, ["sample", "cell_type"], "hypo_any_other")
    sinks.write_named_regions(named, str(tmp_path / "n"), ["sample", "cell_type"], ["name"])
    assert lines(tmp_path / "n" / "sample=IR01" / "cell_type=A") == [
        "#chrom\tstart\tend\tname", "chr2\t1\t3\tIR01__A__hypo_any_other__1", "chr2\t5\t6\tIR01__A__hypo_any_other__2", "chr10\t1\t2\tIR01__A__hypo_any_other__3",
    ]
    groups = spark.createDataFrame([("IR01", 2, "group_A"), ("IR01", 1, "group_B"), ("IR01", 3, "-")], "sample string, cell_no long, membership string")
    sinks.write_groups(groups, str(tmp_path / "g"), ["sample"])
    assert lines(tmp_path / "g") == ["2,group_A", "1,group_B"]
