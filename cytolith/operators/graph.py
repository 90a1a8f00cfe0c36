"""Communities of weighted graphs: modularity by parallel moves, contraction by levels, consensus over seeds.

Edges are rows (from_id, to_id, weight), undirected; both directions of a pair and its
repeats add up, loops count as weight within their node. All rounds work on the edges as a
table that is checkpointed. Of a graph of at most HELD nodes the driver and the tasks hold one
number per node and one per community as arrays, and a round is one pass over the edges; of a
larger one they see counts and one number per round, and a round is joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytolith.session import kept

#: Rounds without a gain after which a level ends.
PATIENCE = 6
#: Edges of one node that meet its community in one task; nodes of more are split.
SPLIT = 10_000
#: Nodes whose communities are held as arrays, some 60 bytes a node on the driver; graphs of more stay tables in all rounds.
HELD = 2_000_000
#: Edges that a task of a held graph goes through, one node after another.
BLOCK = 1 << 17


def _both_ways(edges: DataFrame) -> DataFrame:
    """(src, dst, w) in both directions, loops twice, one row per ordered pair; null ids and weights that are not above 0 are left out."""
    good = edges.where("from_id is not null and to_id is not null and weight > 0")
    # both directions of a row, not a union, which would make the edges twice
    ends = F.array(F.struct(F.col("from_id").alias("src"), F.col("to_id").alias("dst")), F.struct(F.col("to_id").alias("src"), F.col("from_id").alias("dst")))
    both = good.select(F.explode(ends).alias("x"), F.col("weight").cast("double").alias("w"))
    return both.groupBy(F.col("x.src").alias("src"), F.col("x.dst").alias("dst")).agg(F.sum("w").alias("w"))


def _spread(edges: DataFrame, split: int) -> tuple[DataFrame, DataFrame]:
    """Edges with the slice of their target that they meet, and nodes (id, degree, slices)."""
    nodes = kept(edges.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("degree"), F.ceil(F.count(F.lit(1)) / split).cast("int").alias("slices")))
    hubs = nodes.where("slices > 1").select(F.col("id").alias("dst"), "slices")
    salted = edges.join(hubs, "dst", "left").withColumn("slice", F.when(F.col("slices").isNull(), 0).otherwise(F.pmod(F.xxhash64("src"), F.col("slices"))).cast("int"))
    return kept(salted.select("src", "dst", "slice", "w")), nodes


def _by_slice(nodes: DataFrame, *columns: str) -> DataFrame:
    return nodes.select(F.col("id").alias("dst"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), *columns)


def _modularity(edges: DataFrame, nodes: DataFrame, total: float, resolution: float) -> tuple[float, int]:
    """Of nodes (id, degree, slices, community, moved), and how many of them moved."""
    ends = _by_slice(nodes, F.col("community").alias("there"))
    inside = edges.join(ends, ["dst", "slice"]).join(nodes.select(F.col("id").alias("src"), "community"), "src").where("community = there").agg(F.sum("w")).first()[0] or 0.0
    squares, moved = nodes.groupBy("community").agg(F.sum("degree").alias("d"), F.count_if("moved").alias("m")).agg(F.sum(F.col("d") * F.col("d")), F.sum("m")).first()
    return inside / total - resolution * (squares or 0.0) / total**2, moved or 0


def _moved(edges: DataFrame, nodes: DataFrame, total: float, resolution: float, chosen: Column) -> DataFrame:
    """``nodes`` after each chosen one has gone where modularity gains most, if it gains at all; ties go to the smaller community."""
    sizes = nodes.groupBy("community").agg(F.sum("degree").alias("size"))
    ends = _by_slice(nodes, "community")
    links = edges.where("src <> dst").join(nodes.where(chosen).select(F.col("id").alias("src")), "src", "left_semi").join(ends, ["dst", "slice"])
    links = links.groupBy("src", "community").agg(F.sum("w").alias("w"))
    own = nodes.select(F.col("id").alias("src"), "degree", F.col("community").alias("own"))
    stay = own.select("src", F.col("own").alias("community"), F.lit(0.0).alias("w"))
    offers = links.unionByName(stay).groupBy("src", "community").agg(F.sum("w").alias("w")).join(own, "src").join(sizes, "community")
    rest = F.col("size") - F.when(F.col("community") == F.col("own"), F.col("degree")).otherwise(0.0)
    gain = F.round((F.col("w") - resolution * F.col("degree") * rest / total) / total, 15)
    best = offers.groupBy("src").agg(
        F.max(F.struct(gain.alias("gain"), (-F.col("community")).alias("less"))).alias("best"), F.max(F.when(F.col("community") == F.col("own"), gain)).alias("kept")
    )
    goes = best.where(F.col("best.gain") > F.col("kept") + 1e-12).select(F.col("src").alias("id"), (-F.col("best.less")).alias("target"))
    return nodes.join(goes, "id", "left").select("id", "degree", "slices", F.coalesce("target", "community").alias("community"), F.col("target").isNotNull().alias("moved"))


def _level(edges: DataFrame, resolution: float, seed: int, most_rounds: int, split: int) -> tuple[DataFrame, DataFrame, float, float]:
    """Moves until modularity rises no more: (edges, nodes with their community, modularity before, modularity after)."""
    edges, nodes = _spread(edges, split)
    total = edges.agg(F.sum("w")).first()[0]
    nodes = kept(nodes.withColumns({"community": F.col("id"), "moved": F.lit(False)}))
    start = value = _modularity(edges, nodes, total, resolution)[0]
    parts, idle, still = 2, 0, 0
    for nth in range(most_rounds):
        some = F.pmod(F.xxhash64("id", F.lit(seed), F.lit(nth // 2)), F.lit(parts)) == nth % 2
        tried = kept(_moved(edges, nodes, total, resolution, some))
        new, moved = _modularity(edges, tried, total, resolution)
        still = still + 1 if parts == 2 and not moved else 0
        if still == 2 and nth % 2:
            break  # neither half has a move that gains
        if moved and new > value + 1e-9:
            nodes, value, parts, idle = tried, new, max(2, parts // 2), 0
        elif moved or parts > 2:
            # too many moved at once, or none of these few could: others are tried next
            idle, parts = idle + 1, parts * 2 if moved else parts
            if idle == PATIENCE:
                break
    return edges, nodes, start, value


def _blocks(edges: DataFrame, ids: np.ndarray, counts: np.ndarray) -> DataFrame:
    """Edges by the places of their ends in ``ids``, as one row (src, dst, w: arrays) of whole nodes per task, about BLOCK edges each."""
    block = (np.cumsum(counts) - counts) // BLOCK

    def numbered(frames: Iterator) -> Iterator:
        import pandas as pd

        for frame in frames:
            src = np.searchsorted(ids, frame["src"].to_numpy())
            yield pd.DataFrame({"block": block[src], "src": src, "dst": np.searchsorted(ids, frame["dst"].to_numpy()), "w": frame["w"].to_numpy()})

    def packed(frames: Iterator) -> Iterator:
        import pandas as pd

        if some := [x for x in frames if len(x)]:
            whole = pd.concat(some).sort_values(["src", "dst"])
            yield pd.DataFrame({"src": [whole["src"].to_numpy()], "dst": [whole["dst"].to_numpy()], "w": [whole["w"].to_numpy()]})

    placed = kept(edges.mapInPandas(numbered, "block int, src int, dst int, w double")).repartitionByRange(int(block[-1]) + 1, "block")
    return kept(placed.select("src", "dst", "w").mapInPandas(packed, "src array<int>, dst array<int>, w array<double>"))


def _drawn(nodes: np.ndarray, seed: int, nth: int, parts: int) -> np.ndarray:
    """Which nodes may move in a round; ``parts`` is how many rounds would draw them all."""
    with np.errstate(over="ignore"):
        x = nodes.astype(np.uint64) + np.array([seed, nth // 2], np.int64).astype(np.uint64) @ np.array([0xD1342543DE82EF95, 0x9E3779B97F4A7C15], np.uint64)
        for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ x >> np.uint64(shift)) * np.uint64(times)
    return (x ^ x >> np.uint64(31)) % np.uint64(parts) == nth % 2


def _stepped(blocks: DataFrame, label: np.ndarray, size: np.ndarray, total: float, resolution: float, seed: int, nth: int, parts: int) -> tuple[float, np.ndarray, np.ndarray]:
    """(weight within communities, nodes that move, communities they go to) in one pass over the edges.

    In a task the nodes that may move go one after another where modularity gains most, if it
    gains at all, and see those before them moved; ties go to the smaller community.
    """
    shared = blocks.sparkSession.sparkContext.broadcast((label, size))

    def work(frames: Iterator) -> Iterator:
        import pandas as pd

        label, size = shared.value
        owner, sizes, inside, at, to = label.tolist(), size.tolist(), 0.0, [], []
        for frame in frames:
            for src, dst, w in zip(frame["src"], frame["dst"], frame["w"], strict=True):
                inside += float(w[label[src] == label[dst]].sum())
                first = np.flatnonzero(np.diff(src, prepend=-1))
                nodes, last, degree = src[first], np.append(first[1:], len(src)), np.add.reduceat(w, first)
                some = _drawn(nodes, seed, nth, parts)
                for i, a, b, d in zip(nodes[some].tolist(), first[some].tolist(), last[some].tolist(), degree[some].tolist(), strict=True):
                    own = owner[i]
                    towards = {own: 0.0}
                    for j, x in zip(dst[a:b].tolist(), w[a:b].tolist(), strict=True):
                        if j != i:
                            c = owner[j]
                            towards[c] = towards.get(c, 0.0) + x
                    sizes[own] -= d
                    pull = resolution * d / total
                    gains = {c: x - pull * sizes[c] for c, x in towards.items()}
                    best = max(gains.values())
                    if best > gains[own] + 1e-12 * total:
                        owner[i] = own = min(c for c, x in gains.items() if x >= best - 1e-15 * total)
                        at.append(i)
                        to.append(own)
                    sizes[own] += d
        yield pd.DataFrame({"at": [-1, *at], "to": [-1, *to], "inside": [inside] + [0.0] * len(at)})

    found = blocks.mapInPandas(work, "at int, to int, inside double").toArrow()
    shared.destroy()
    at, to = found["at"].to_numpy(), found["to"].to_numpy()
    return float(found["inside"].to_numpy().sum()), at[at >= 0], to[at >= 0]


def _held_level(blocks: DataFrame, degree: np.ndarray, resolution: float, seed: int, most_rounds: int) -> tuple[np.ndarray, float, float]:
    """Moves as in ``_level``, over arrays: (community of each node, modularity before, modularity after)."""
    total = float(degree.sum())
    n = len(degree)

    def sizes(label: np.ndarray) -> np.ndarray:
        return np.bincount(label, degree, n)

    def step(label: np.ndarray, nth: int, parts: int) -> tuple[float, np.ndarray, np.ndarray]:
        size = sizes(label)
        inside, at, to = _stepped(blocks, label, size, total, resolution, seed, nth, parts)
        return inside / total - resolution * float((size**2).sum()) / total**2, at, to

    label = np.arange(n, dtype=np.int32)
    parts, idle, still = 2, 0, 0
    start, at, to = step(label, 0, parts)
    value = start
    for nth in range(most_rounds):
        tried, moved = label.copy(), len(at)
        tried[at] = to
        still = still + 1 if parts == 2 and not moved else 0
        if still == 2 and nth % 2:
            break  # neither half has a move that gains
        new, then = value, None
        if moved:
            # what the next round would move, should this one be accepted, comes with its value
            new, *then = step(tried, nth + 1, max(2, parts // 2))
        if moved and new > value + 1e-9:
            label, value, parts, idle = tried, new, max(2, parts // 2), 0
        else:
            if moved or parts > 2:
                # too many moved at once, or none of these few could: others are tried next
                idle, parts = idle + 1, parts * 2 if moved else parts
                if idle == PATIENCE:
                    break
            _, *then = step(label, nth + 1, parts)
        at, to = then
    return label, start, value


def _folded(blocks: DataFrame, label: np.ndarray) -> DataFrame:
    """Edges (src, dst, w) between communities, each task's own added up first."""
    shared = blocks.sparkSession.sparkContext.broadcast(label)

    def work(frames: Iterator) -> Iterator:
        import pandas as pd

        label = shared.value
        for frame in frames:
            for src, dst, w in zip(frame["src"], frame["dst"], frame["w"], strict=True):
                yield pd.DataFrame({"src": label[src], "dst": label[dst], "w": w}).groupby(["src", "dst"], as_index=False).sum()

    found = kept(blocks.mapInPandas(work, "src int, dst int, w double").groupBy("src", "dst").agg(F.sum("w").alias("w")))
    shared.destroy()
    return found


def _held(both: DataFrame, resolution: float, seed: int, most_rounds: int, most_levels: int, small: int) -> DataFrame:
    """``communities`` of a graph of at most HELD nodes."""
    import pyarrow as pa

    spark, kind, names, member = both.sparkSession, both.schema["src"].dataType, None, None
    for level in range(most_levels):
        nodes = both.groupBy("src").agg(F.sum("w").alias("degree"), F.count(F.lit(1)).alias("n")).toArrow().sort_by("src")
        ids, degree, counts = (nodes[c].to_numpy() for c in ("src", "degree", "n"))
        if names is None:
            names, member = ids, np.arange(len(ids), dtype=np.int32)
        last = both.count() <= small
        if last:
            found = _finished(both, resolution).toArrow().sort_by("community")
            label = np.searchsorted(ids, found["next"].to_numpy()).astype(np.int32)
        else:
            blocks = _blocks(both, ids, counts)
            label, before, after = _held_level(blocks, degree, resolution, seed + 1000 * level, most_rounds)
            last = not after > before + 1e-9
        label = np.unique(label, return_inverse=True)[1].astype(np.int32)
        member = label[member]
        if last:
            break
        both = _folded(blocks, label)
    # names ascend, so the first of a community is its smallest
    _, first, which = np.unique(member, return_index=True, return_inverse=True)
    found = spark.createDataFrame(pa.table({"id": names, "community": names[first[which]]}))
    return kept(found.select(F.col("id").cast(kind).alias("id"), F.col("community").cast(kind).alias("community")))


def modularity(edges: DataFrame, membership: DataFrame, resolution: float = 1.0) -> float:
    """Modularity of (id, community); 0 without edges. Runs jobs."""
    both, nodes = _spread(_both_ways(edges), SPLIT)
    total = both.agg(F.sum("w")).first()[0]
    return _modularity(both, nodes.join(membership, "id").withColumn("moved", F.lit(False)), total, resolution)[0] if total else 0.0


def _climb(links: dict[int, dict[int, float]], resolution: float) -> dict[int, int]:
    """Communities of a graph that fits into one task: node after node to its best community, then communities as nodes."""
    owner = {i: i for i in links}
    while True:
        degree = {i: sum(near.values()) for i, near in links.items()}
        total = sum(degree.values())
        label, size = {i: i for i in links}, dict(degree)
        moved, gained = True, False
        while moved:
            moved = False
            for i in sorted(links):
                towards: dict[int, float] = {label[i]: 0.0}
                for j, w in links[i].items():
                    if j != i:
                        towards[label[j]] = towards.get(label[j], 0.0) + w
                size[label[i]] -= degree[i]
                gain = {c: w - resolution * degree[i] * size[c] / total for c, w in towards.items()}
                best = max(gain, key=lambda c: (gain[c], -c))
                if gain[best] > gain[label[i]] + 1e-9 * total:
                    label[i], moved, gained = best, True, True
                size[label[i]] += degree[i]
        owner = {i: label[c] for i, c in owner.items()}
        if not gained:
            return owner
        folded: dict[int, dict[int, float]] = {}
        for i, near in links.items():
            row = folded.setdefault(label[i], {})
            for j, w in near.items():
                row[label[j]] = row.get(label[j], 0.0) + w
        links = folded


def _finished(edges: DataFrame, resolution: float) -> DataFrame:
    """(community, next) of all nodes of a small graph, in one task."""

    def work(frame):
        import pandas as pd

        links: dict[int, dict[int, float]] = {}
        for i, j, w in zip(frame["src"].tolist(), frame["dst"].tolist(), frame["w"].tolist(), strict=True):
            links.setdefault(i, {})[j] = w
        found = _climb(links, resolution)
        return pd.DataFrame({"community": list(found), "next": list(found.values())})

    return edges.groupBy(F.lit(0).alias("all")).applyInPandas(work, "community long, next long")


def communities(
    edges: DataFrame, resolution: float = 1.0, seed: int = 0, most_rounds: int = 40, most_levels: int = 20, split: int = SPLIT, small: int = 200_000, held: int = HELD
) -> DataFrame:
    """(id, community: the smallest id in it) of every node with an edge.

    Moves as in the method of Blondel and others, but many at once: in each round a half of
    the nodes, drawn anew, may move, so that neighbours seldom change places. A round that
    does not raise modularity is taken back and a smaller part is drawn; PATIENCE such
    rounds end a level. Communities then become nodes, until none joins another, or until no
    more than ``small`` edges are left, which one task finishes node by node. ``seed`` decides the halves.
    Of at most ``held`` nodes the communities are arrays, and the nodes of a task move one after
    another; of more they are tables, and nodes with more than ``split`` edges are met in slices.
    """
    both = kept(_both_ways(edges))
    if both.isEmpty():
        return both.select(F.col("src").alias("id"), F.col("src").alias("community"))
    if both.count() > small and both.select("src").distinct().count() <= held:
        return _held(both, resolution, seed, most_rounds, most_levels, small)
    membership = None
    for level in range(most_levels):
        if both.count() <= small:
            up = _finished(both, resolution)
            start = up.select(F.col("community").alias("id"), "community") if membership is None else membership
            membership = kept(start.join(up, "community").select("id", F.col("next").alias("community")))
            break
        both, nodes, before, after = _level(both, resolution, seed + 1000 * level, most_rounds, split)
        if membership is None:
            membership = kept(nodes.select("id", "community"))
        elif after > before + 1e-9:
            up = nodes.select(F.col("id").alias("community"), F.col("community").alias("next"))
            membership = kept(membership.join(up, "community").select("id", F.col("next").alias("community")))
        if not after > before + 1e-9:
            break
        ends = _by_slice(nodes, F.col("community").alias("to"))
        starts = nodes.select(F.col("id").alias("src"), F.col("community").alias("at"))
        both = kept(both.join(ends, ["dst", "slice"]).join(starts, "src").groupBy(F.col("at").alias("src"), F.col("to").alias("dst")).agg(F.sum("w").alias("w")))
    least = membership.groupBy("community").agg(F.min("id").alias("least"))
    return membership.join(least, "community").select("id", F.col("least").alias("community"))


def consensus_communities(edges: DataFrame, resolution: float = 1.0, seeds: int = 5, floor: float = 0.05) -> DataFrame:
    """(id, community) of the graph whose edges weigh the share of ``seeds`` runs that put both ends together.

    The ensemble method of Poulin and Théberge: an edge keeps ``floor`` of its weight at least, so no node is lost.
    """
    edges = kept(edges.select("from_id", "to_id", "weight"))  # what makes them runs once, not once per seed
    shares = edges.withColumn("together", F.lit(0))
    for seed in range(seeds):
        found = communities(edges, resolution, seed)
        a, b = (found.select(F.col("id").alias(end), F.col("community").alias(f"{end}_in")) for end in ("from_id", "to_id"))
        joined = shares.join(a, "from_id").join(b, "to_id")
        shares = kept(joined.select("from_id", "to_id", "weight", (F.col("together") + (F.col("from_id_in") == F.col("to_id_in")).cast("int")).alias("together")))
    share = floor + (1 - floor) * F.col("together") / seeds
    return communities(shares.select("from_id", "to_id", (F.col("weight") * share).alias("weight")), resolution, seeds)
