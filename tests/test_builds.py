"""Builds that are taken up again."""

from __future__ import annotations

import glob
import os

import pytest

from cytolith.sources import builds

SITES = "cell_no long, chrom string, pos long, mc long, uc long"


def test_build_is_taken_up(spark, tmp_path):
    rows = [(c, "chr1", p, (c + p) % 3, 1) for c in range(1, 5) for p in range(0, 60, 7)]
    sites = spark.createDataFrame(rows, SITES)
    cells = spark.createDataFrame([(c,) for c in range(1, 6)], "cell_no long")
    regions = spark.createDataFrame([("chr1", 0, 10), ("chr1", 20, 40), ("chr2", 0, 5)], "chrom string, start_pos long, end_pos long")
    asked, folder = [], str(tmp_path / "build")

    def read(open_):
        asked.append(sorted(int(r.cell_no) for r in open_.collect()))
        return sites.join(open_.selectExpr("cast(cell_no as long) as cell_no"), "cell_no", "left_semi")

    def rows_of(df):
        return sorted(tuple(r) for r in df.collect())

    want = sorted(
        (str(c), "chr1", a, b, sum(x[3] for x in rows if x[0] == c and a <= x[2] < b), sum(x[3] + x[4] for x in rows if x[0] == c and a <= x[2] < b)) for c in range(1, 5) for a, b in ((0, 10), (20, 40))
    )
    counts, n = builds.build_counts(cells, regions, read, folder, {"context": "CG"})
    assert n == 5 and rows_of(counts) == want and asked == [[1, 2, 3, 4, 5]]
    counts, n = builds.build_counts(cells, regions, read, folder, {"context": "CG"})
    assert n == 0 and rows_of(counts) == want and len(asked) == 1

    damaged = glob.glob(f"{folder}/parts/cell_no=2/*.parquet")
    os.remove(damaged[0])
    other = glob.glob(f"{folder}/parts/cell_no=3/*.parquet")[0]
    with open(other, "r+b") as f:
        f.truncate(20)
    for crc in glob.glob(f"{folder}/parts/cell_no=*/.*.crc"):
        os.remove(crc)
    counts, n = builds.build_counts(cells, regions, read, folder, {"context": "CG"})
    assert n == 2 and asked[-1] == [2, 3] and rows_of(counts) == want

    for other_cells, other_regions, settings, name in [(cells.limit(2), regions, {"context": "CG"}, "cells"), (cells, regions.limit(1), {"context": "CG"}, "regions"), (cells, regions, {}, "settings")]:
        with pytest.raises(ValueError, match=name):
            builds.build_counts(other_cells, other_regions, read, folder, settings)
    assert len(asked) == 2


def test_digest_knows_the_order_of_places(spark):
    df = spark.createDataFrame([(3,), (1,), (2,), (2,)], "cell_no long")
    n, digest = builds.ordered_digest(df, ["cell_no"])
    assert n == 3 and builds.ordered_digest(df.repartition(7), ["cell_no"]) == (n, digest)
    assert builds.ordered_digest(df.where("cell_no > 1"), ["cell_no"])[1] != digest
    assert builds.ordered_digest(df.limit(0), ["cell_no"]) == (0, "")
