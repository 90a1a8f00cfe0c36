"""Neighbours, their weights and communities against single-machine versions."""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pytest

from cytolith.operators import graph, neighbours

POINTS = "id long, v array<double>"


def brute_knn(points, k):
    out = set()
    for i, v in points:
        away = sorted((float(np.sqrt(((np.array(w) - np.array(v)) ** 2).sum())), j) for j, w in points if j != i)
        out |= {(i, j, round(d, 9), n) for n, (d, j) in enumerate(away[:k], 1)}
    return out


def clustered(n, centres, d, seed, spread=0.05):
    r = np.random.default_rng(seed)
    middle = r.normal(size=(centres, d)) * 10
    return [(int(i), [float(x) for x in middle[i % centres] + spread * r.normal(size=d)]) for i in range(n)]


@pytest.mark.parametrize(("points", "k"), [(clustered(300, 8, 5, 1), 4), (clustered(200, 1, 3, 2, 5.0), 3), ([(i, [float(i % 4), 0.0]) for i in range(60)], 7), (clustered(3, 1, 2, 3), 5)])
def test_knn_is_exact(spark, points, k):
    got = neighbours.knn(spark.createDataFrame(points, POINTS).repartition(3), "id", "v", k, block=25)
    assert {(r.from_id, r.to_id, round(r.distance, 9), r.rank) for r in got.collect()} == brute_knn(points, k)


def test_clusters_visit_few_blocks(spark):
    points = clustered(600, 12, 6, 4)
    partition = neighbours.MetricPartition(spark.createDataFrame(points, POINTS), "id", "v", 25)
    found, visits = partition.search(3)
    parts = partition.placed.select("part", "sub").distinct().count()
    pairs = visits.select("part", "sub", "other").distinct().count()
    assert parts >= 12 and pairs < parts * parts / 5
    assert found.count() == 1800


def test_open_vectors_are_sent_once_per_side(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "TILE", 50)
    points = clustered(400, 1, 16, 6, 1.0)
    partition = neighbours.MetricPartition(spark.createDataFrame(points, POINTS), "id", "v", 10)
    found, visits = partition.search(3)
    assert partition.sides == neighbours.SIDES and visits.count() <= 400 * partition.sides
    assert {(r.from_id, r.to_id, round(r.distance, 9), r.rank) for r in found.collect()} == brute_knn(points, 3)


def test_copies_are_told_apart_by_id(spark):
    points = [(i, [1.0, -0.0 if i % 2 else 0.0]) for i in range(90)] + [(200, [2.0, 0.0]), (201, [float("nan"), 0.0]), (202, [float("inf"), 0.0])]
    got = neighbours.knn(spark.createDataFrame(points, POINTS), "id", "v", 4, block=20)
    assert {(r.from_id, r.to_id, r.distance, r.rank) for r in got.collect()} == brute_knn(points[:91], 4)


def test_empty_and_null_vectors(spark):
    df = spark.createDataFrame([(1, None), (2, [1.0, None]), (None, [1.0])], POINTS)
    assert neighbours.knn(df, "id", "v", 2).count() == 0


def test_weights_of_neighbours(spark):
    points = [*clustered(40, 3, 2, 5, 1.0), (100, [3.0, 3.0]), (101, [3.0, 3.0])]
    near = brute_knn(points, 5)
    lists = {i: sorted((d, j) for a, j, d, _ in near if a == i) for i, _ in points}
    one_way = {}
    for i, found in lists.items():
        d = np.array([x for x, _ in found])
        nearest = d[d > 0].min() if (d > 0).any() else 0.0
        low, high, mid = 0.0, np.inf, 1.0
        for _ in range(64):
            if np.exp(-np.maximum(0, d - nearest) / mid).sum() > np.log2(len(d) + 1):
                high, mid = mid, (low + mid) / 2
            else:
                low, mid = mid, 2 * mid if np.isinf(high) else (mid + high) / 2
        width = max(mid, d.mean() / 1000)
        one_way |= {(i, j): float(np.exp(-max(0, x - nearest) / width)) for x, j in found}
    want = {}
    for i, j in one_way:
        a, b = one_way[i, j], one_way.get((j, i), 0.0)
        want[min(i, j), max(i, j)] = a + b - a * b
    got = neighbours.neighbour_weights(spark.createDataFrame(sorted(near), "from_id long, to_id long, distance double, rank long"))
    found = {(r.from_id, r.to_id): r.weight for r in got.collect()}
    assert found.keys() == want.keys() and all(abs(found[x] - want[x]) < 1e-6 for x in want)


def planted(groups, size, inside, outside, seed):
    r = np.random.default_rng(seed)
    return [(i, j, 1.0) for i, j in itertools.combinations(range(groups * size), 2) if r.random() < (inside if i // size == j // size else outside)]


def ring(cliques, size):
    out = [(c * size + i, c * size + j, 1.0) for c in range(cliques) for i, j in itertools.combinations(range(size), 2)]
    return out + [(c * size, (c + 1) % cliques * size + 1, 1.0) for c in range(cliques)]


def star(leaves):
    return [(0, i, 1.0) for i in range(1, leaves + 1)] + [(i, i + 1, 3.0) for i in range(1, leaves, 2)]


def matrix(edges):
    n = max(max(a, b) for a, b, _ in edges) + 1
    a = np.zeros((n, n))
    for i, j, w in edges:
        a[i, j] += w
        a[j, i] += w
    return a


def quality(a, label, resolution=1.0):
    d, total = a.sum(axis=1), a.sum()
    same = label[:, None] == label
    return float(((a - resolution * np.outer(d, d) / total) * same).sum() / total)


def greedy(a):
    """Nodes one after another to their best community, then communities as nodes."""
    owner = np.arange(len(a))
    while True:
        d, total, label, moved = a.sum(axis=1), a.sum(), np.arange(len(a)), True
        start = label.copy()
        while moved:
            moved = False
            for i in range(len(a)):
                gains = {c: a[i, (label == c) & (np.arange(len(a)) != i)].sum() - d[i] * d[(label == c) & (np.arange(len(a)) != i)].sum() / total for c in {*label[a[i] > 0], label[i]}}
                best = max(gains, key=lambda c: (gains[c], -c))
                if gains[best] > gains[label[i]] + 1e-12:
                    label[i], moved = best, True
        names, label = np.unique(label, return_inverse=True)
        owner = label[owner]
        if len(names) == len(start):
            return owner
        fold = np.eye(len(names))[label]
        a = fold.T @ a @ fold


@pytest.mark.parametrize(
    ("edges", "options"), [(planted(4, 12, 0.6, 0.05, 1), {}), (ring(6, 5), {}), (star(40), {}), (planted(2, 6, 0.9, 0.1, 2), {"small": 0, "split": 3, "most_rounds": 8}), (star(8), {"small": 20, "split": 3, "most_rounds": 4})]
)
def test_communities_are_as_good_as_greedy_ones(spark, edges, options):
    df = spark.createDataFrame(edges, "from_id long, to_id long, weight double").repartition(3)
    found = graph.communities(df, **options)
    label = {r.id: r.community for r in found.collect()}
    a = matrix(edges)
    mine = np.array([label.get(i, i) for i in range(len(a))])
    assert all(label[c] == c and c <= i for i, c in label.items())
    assert quality(a, mine) >= quality(a, greedy(a)) - 1e-9
    assert abs(graph.modularity(df, found) - quality(a, mine)) < 1e-9


@pytest.mark.parametrize("options", [{"small": 0}, {"small": 0, "held": 0, "split": 3, "most_rounds": 8}, {"small": 60, "resolution": 1.5}])
def test_held_and_tabled_graphs_are_as_good_as_greedy_ones(spark, monkeypatch, options):
    monkeypatch.setattr(graph, "BLOCK", 40)  # a few nodes to a task, and one node of more edges
    if options.get("held") != 0:
        monkeypatch.setattr(graph, "_moved", lambda *_: pytest.fail("a round of a held graph is one pass over its edges"))
    edges = [(5 * a - 7, 5 * b - 7, w) for a, b, w in [*planted(5, 10, 0.7, 0.03, 4), *((0, i, 0.2) for i in range(11, 50)), (3, 3, 2.0)]]
    df = spark.createDataFrame(edges, "from_id int, to_id int, weight double").repartition(3)
    found = graph.communities(df, **options)
    label = {r.id: r.community for r in found.collect()}
    a = matrix([((x + 7) // 5, (y + 7) // 5, w) for x, y, w in edges])
    mine = np.array([label[5 * i - 7] for i in range(50)])
    assert sorted(label) == [5 * i - 7 for i in range(50)] and all(label[c] == c <= i for i, c in label.items())
    assert quality(a, mine, options.get("resolution", 1.0)) >= quality(a, greedy(a), options.get("resolution", 1.0)) - (1e-9 if "resolution" not in options else 0.02)
    assert [str(f.dataType) for f in found.schema] == ["IntegerType()"] * 2
    again = {r.id: r.community for r in graph.communities(df.repartition(2), **options).collect()}
    assert again == label


def test_edges_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def work(frames):
        for frame in frames:
            made.add(len(frame))
            yield frame

    df = spark.createDataFrame(ring(6, 5), "from_id long, to_id long, weight double").coalesce(1)
    assert graph.communities(df.mapInPandas(work, df.schema)).count() == 30
    assert made.value == df.count()


def test_consensus_and_odd_edges(spark):
    edges = [*ring(4, 5), (7, 7, 1.0), (1, 2, 0.0), (3, 4, -1.0), (None, 5, 1.0), (50, 51, 2.0), (51, 50, 1.0), (60, 60, 1.0)]
    df = spark.createDataFrame(edges, "from_id long, to_id long, weight double")
    label = {r.id: r.community for r in graph.consensus_communities(df.where("from_id is not null and weight > 0"), seeds=2).collect()}
    assert label == {i: i // 5 * 5 for i in range(20)} | {50: 50, 51: 50, 60: 60}
    assert graph.communities(df.limit(0)).count() == 0


def test_consensus_of_held_graphs_is_one_pass_a_round(spark, monkeypatch):
    monkeypatch.setattr(graph, "BLOCK", 40)
    monkeypatch.setattr(graph, "_moved", lambda *_: pytest.fail("a round of a held graph is one pass over its edges"))
    monkeypatch.setattr(graph, "communities", functools.partial(graph.communities, small=0))
    df = spark.createDataFrame(ring(6, 5), "from_id long, to_id long, weight double").repartition(3)
    label = {r.id: r.community for r in graph.consensus_communities(df, seeds=2).collect()}
    assert label == {i: i // 5 * 5 for i in range(30)}
