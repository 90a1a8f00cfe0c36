"""Running totals and order statistics against numpy."""

from __future__ import annotations

import numpy as np
import pytest

from cytolith.operators import ordered


@pytest.mark.parametrize("descending", [False, True])
def test_running(spark, descending):
    r = np.random.default_rng(1)
    rows = [(float(x), int(n), None if n % 3 == 0 else float(y), 9) for x, n, y in zip(r.permutation(500) / 7, r.integers(0, 9, 500), r.normal(size=500), strict=True)]
    df = spark.createDataFrame(rows, "at double, n long, low double, part int").repartition(5)
    got = ordered.running(df, "at", ["n"], ["low"], descending).orderBy("at").collect()
    order = sorted(rows, reverse=descending)
    total, least, want = 0, None, {}
    for at, n, low, _ in order:
        total += n
        least = low if least is None or (low is not None and low < least) else least
        want[at] = (total, least)
    assert {x["at"]: (x.sum_n, x.least_low) for x in got} == want and {x.part for x in got} == {9}
    assert ordered.running(df.limit(0), "at", ["n"]).count() == 0


@pytest.mark.parametrize("small", [1, 50])
def test_kth_largest(spark, small):
    r = np.random.default_rng(2)
    values = np.concatenate([r.normal(size=300), np.full(200, 0.25), [1e6, -1e6]])
    df = spark.createDataFrame([(float(x),) for x in values] + [(None,), (float("nan"),)], "v double")
    down = np.sort(values)[::-1]
    for k in (1, 2, 100, 250, len(values)):
        assert ordered.kth_largest(df, "v", k, bins=16, small=small) == down[k - 1]
    with pytest.raises(ValueError):
        ordered.kth_largest(df, "v", len(values) + 1)
