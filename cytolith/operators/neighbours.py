"""Exact nearest neighbours over a metric partition, and the fuzzy weights of their graph."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cytolith.operators.checks import in_range
from cytolith.session import kept, spread

#: Rows whose distances to the pivots, or to other points, a task holds at a time.
CHUNK = 1024
#: Candidates that a chunk is held against at a time.
TILE = 8192
#: Numbers, and rows, in one side of a task of the search; a table of fewer is cut into SIDES sides, so that there are tasks for all cores.
SIDE, SIDE_ROWS, SIDES = 1 << 22, 1 << 17, 4
#: Neighbours whose widths a task finds by bisection.
WIDTHS = 1 << 16
_FOUND = "from_id long, to_id long, distance double"


def _pairwise(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows, up to rounding; only bounds are taken from them."""
    squares = (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1) - 2 * a @ b.T
    return np.sqrt(np.maximum(squares, 0))


def _part_of(ids: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """Blocks of ids within their part, alike in size."""
    return (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % parts


def _without_copies(ids: np.ndarray, data: np.ndarray, most: int) -> np.ndarray:
    """Places of the rows, but of equal ones only those with the ``most`` smallest ids."""
    rows = np.ascontiguousarray(data + 0.0).view(np.dtype((np.void, data.shape[1] * 8)))[:, 0]
    _, which = np.unique(rows, return_inverse=True)
    order = np.lexsort((ids, which))
    nth = np.arange(len(ids)) - np.searchsorted(which[order], which[order])
    return np.sort(order[nth < most])


def _closest(own: np.ndarray, asked: np.ndarray, bound: np.ndarray, ids: np.ndarray, data: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in ``own``, id, distance) of the k nearest rows within the bound of each query, ties by id.

    Products of matrices propose, with room for their rounding; the distances of what they leave decide.
    """
    middle = data.mean(axis=0)
    moved, held = asked - middle, data - middle
    size, sizes = (moved**2).sum(axis=1), (held**2).sum(axis=1)
    slack, limit = 1e-9 * (size + sizes.max()), bound.copy()
    at, to, far, fresh = np.array([], np.int64), np.array([], np.int64), np.array([]), 0
    for first in range(0, len(data), TILE):
        squares = size[:, None] + sizes[first : first + TILE] - 2 * moved @ held[first : first + TILE].T
        reach = limit**2 + slack
        hits = squares <= reach[:, None]
        many = np.flatnonzero(hits.sum(axis=1) > 4 * (k + 1))
        if len(many):  # k of this tile are nearer, beside the query itself
            reach[many] = np.minimum(reach[many], np.partition(squares[many], k, axis=1)[:, k] + 2 * slack[many])
            hits[many] = squares[many] <= reach[many, None]
        q, c = np.nonzero(hits)
        c += first
        other = ids[c] != own[q]
        q, c = q[other], c[other]
        step = CHUNK * TILE // 8
        exact = [np.sqrt(((data[c[i : i + step]] - asked[q[i : i + step]]) ** 2).sum(axis=1)) for i in range(0, len(q), step)]
        at, to, far, fresh = np.concatenate([at, q]), np.concatenate([to, c]), np.concatenate([far, *exact]), fresh + len(q)
        if fresh and (fresh > k * len(own) or first + TILE >= len(data)):
            order = np.lexsort((ids[to], far, at))
            at, to, far = at[order], to[order], far[order]
            nth = np.arange(len(at)) - np.searchsorted(at, at)
            full = nth == k - 1
            limit[at[full]] = np.minimum(limit[at[full]], far[full])
            at, to, far, fresh = at[nth < k], to[nth < k], far[nth < k], 0
    good = np.isfinite(far)
    return at[good], ids[to[good]], far[good]


def _stacked(column) -> np.ndarray:
    return np.stack(column.to_list()).astype(np.float64)


def _nearest(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("from_id").orderBy("distance", "to_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class MetricPartition:
    """Points dealt to their nearest pivot, with the radius of each part; parts are cut into blocks of about ``block`` points.

    A query first searches its own block, which bounds the distance of its kth neighbour;
    then only parts that the triangle inequality does not rule out: by their radius, and by
    the plane between their pivot and its own. Parts that follow each other make up sides of
    alike size, and a task holds one side against another, so a point is sent as often as
    there are sides, whose number follows from what a task may hold. On clustered vectors few
    parts are left; on vectors of many independent dimensions nearly all are, and the work is that of all
    pairs, done as products of matrices. Pivots (``most_pivots`` at most) are all that tasks are given.
    """

    def __init__(self, df: DataFrame, key: str, vector: str, block: int = 2048, most_pivots: int = 2048, seed: int = 5) -> None:
        """Counts, pivots and radii take three jobs. Null vectors, and vectors that hold a null or a number that is not finite, take no part."""
        df = df.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
        points = df.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
        self.n = points.count()
        drawn = points.orderBy(F.xxhash64("id", F.lit(seed))).limit(min(most_pivots, max(1, -(-self.n // block) * 4))).collect()
        self.pivots = pivots = np.unique(np.array([r.v for r in drawn], float), axis=0) if drawn else np.zeros((0, 0))

        def near(frames: Iterator) -> Iterator:
            for frame in frames:
                for at in range(0, len(frame), CHUNK):
                    some = frame.iloc[at : at + CHUNK].copy()
                    away = _pairwise(_stacked(some["v"]), pivots)
                    some["part"], some["away"] = away.argmin(axis=1), away.min(axis=1)
                    yield some

        dealt = kept(points.mapInPandas(near, "id long, v array<double>, part int, away double"))
        sizes = {r.part: (r.n, r.radius) for r in dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius")).collect()}
        self.counts = np.array([sizes.get(p, (0, 0))[0] for p in range(len(pivots))], np.int64)
        self.radius = np.array([sizes.get(p, (0, -np.inf))[1] for p in range(len(pivots))], float)
        self.blocks = np.maximum(1, -(-self.counts // block))
        rows = max(1, min(SIDE_ROWS, SIDE // max(1, pivots.shape[1])))
        self.sides = max(min(SIDES, -(-self.n // block)), -(-self.n // rows), 1)
        self.before = np.cumsum(self.counts) - self.counts
        blocks, side = self.blocks, self._side

        def cut(frames: Iterator) -> Iterator:
            for frame in frames:
                part = frame["part"].to_numpy()
                frame["sub"] = _part_of(frame["id"].to_numpy(), blocks[part])
                frame["side"] = side(part, frame["sub"].to_numpy())
                yield frame[["id", "v", "part", "sub", "side"]]

        self.placed = dealt.mapInPandas(cut, "id long, v array<double>, part int, sub int, side int")

    @property
    def _side(self):
        """The side of a block: blocks follow each other, alike in size."""
        before, counts, blocks, each = self.before, self.counts, self.blocks, max(1, self.n) / self.sides
        last = self.sides - 1
        return lambda part, sub: np.minimum((before[part] + counts[part] * (sub / blocks[part])) / each, last).astype(np.int64)

    @property
    def _open(self):
        """Which parts may hold a point within ``bound`` of vectors of one part or several; their own part always is one."""
        pivots, radius, counts = self.pivots, self.radius, self.counts
        between = _pairwise(pivots, pivots) if len(pivots) else pivots

        def work(v: np.ndarray, part: np.ndarray, bound: np.ndarray, k: int) -> np.ndarray:
            away = _pairwise(v, pivots)
            own = away[np.arange(len(v)), part]
            within = np.where(counts > 0, away + radius, np.inf)
            order = np.argsort(within, axis=1)
            enough = np.cumsum(counts[order], axis=1) > k
            reach = np.take_along_axis(np.take_along_axis(within, order, 1), enough.argmax(axis=1)[:, None], 1)[:, 0]
            bound = np.minimum(bound, np.where(enough.any(axis=1), reach, np.inf))
            with np.errstate(divide="ignore", invalid="ignore"):
                plane = np.nan_to_num((away**2 - own[:, None] ** 2) / (2 * between[part]), nan=0.0, posinf=0.0, neginf=0.0)
                slack = 1e-7 * (1 + away) + np.nan_to_num(1e-9 * (away**2 + own[:, None] ** 2) / between[part], nan=0.0, posinf=np.inf)
            found = np.maximum(away - radius, plane) <= bound[:, None] + slack
            found[np.arange(len(v)), part] = True
            return found & np.isfinite(radius)

        return work

    def visits(self, k: int) -> DataFrame:
        """(id, v, part, sub, side, bound, other): the sides that may hold a point nearer than the kth of the own block."""
        counts, blocks, sides, side, is_open = self.counts, self.blocks, self.sides, self._side, self._open
        parts = np.arange(len(counts))
        first, last = (side(parts, np.zeros(len(parts), np.int64)), side(parts, blocks - 1)) if len(parts) else (parts, parts)
        holds = (np.arange(sides)[None, :] >= first[:, None]) & (np.arange(sides)[None, :] <= last[:, None])

        def work(frame):
            ids, v = frame["id"].to_numpy(), _stacked(frame["v"])
            bound, others = np.full(len(ids), np.inf), []
            for at in range(0, len(ids), CHUNK):
                some = slice(at, at + CHUNK)
                nth, _, far = _closest(ids[some], v[some], bound[some], ids, v, k)
                place, n = np.unique(nth, return_counts=True)
                ends = np.cumsum(n) - 1
                bound[at + place[n == k]] = far[ends[n == k]]
                found = is_open(v[some], frame["part"].to_numpy()[some], bound[some], k).astype(np.float32) @ holds.astype(np.float32) > 0
                others += [np.flatnonzero(x).astype(np.int32) for x in found]
            frame["bound"], frame["others"] = bound, others
            return frame

        asked = self.placed.groupBy("part", "sub").applyInPandas(work, "id long, v array<double>, part int, sub int, side int, bound double, others array<int>")
        return asked.select("id", "v", "part", "sub", "side", "bound", F.explode("others").alias("other"))

    def search(self, k: int) -> tuple[DataFrame, DataFrame]:
        """(neighbours, visits to sides)."""
        in_range("k", k, 1)
        is_open = self._open

        def work(left, right):
            import pandas as pd

            out = [(np.array([], np.int64), np.array([], np.int64), np.array([], np.float64))]
            if len(left) and len(right):
                left, right = left.sort_values(["part", "sub"]), right.sort_values(["part", "id"])
                ids, data, part = right["id"].to_numpy(), _stacked(right["v"]), right["part"].to_numpy()
                single = _without_copies(ids, data, k + 1)
                ids, data, part = ids[single], data[single], part[single]
                for at in range(0, len(left), CHUNK):
                    some = left.iloc[at : at + CHUNK]
                    own, v, bound = some["id"].to_numpy(), _stacked(some["v"]), some["bound"].to_numpy(float)
                    meets = is_open(v, some["part"].to_numpy(), bound, k).any(axis=0)[part]
                    if meets.any():
                        nth, to, far = _closest(own, v, bound, ids if meets.all() else ids[meets], data if meets.all() else data[meets], k)
                        out.append((own[nth], to, far))
            return pd.DataFrame({c: np.concatenate([x[i] for x in out]) for i, c in enumerate(("from_id", "to_id", "distance"))})

        visits = self.visits(k)
        # the sides of the cogroup share a source, so their columns are named anew
        left = visits.select(*[F.col(c).alias(c) for c in ("side", "other", "id", "v", "part", "sub", "bound")])
        right = self.placed.select(F.explode(F.sequence(F.lit(0), F.lit(self.sides - 1))).alias("side"), F.col("side").alias("other"), *[F.col(c).alias(c) for c in ("id", "v", "part")])
        found = left.groupBy("side", "other").cogroup(right.groupBy("side", "other")).applyInPandas(work, _FOUND)
        return kept(_nearest(found, k)), visits


def knn(df: DataFrame, key: str, vector: str, k: int, block: int = 2048) -> DataFrame:
    """Exact nearest neighbours by Euclidean distance: (from_id, to_id, distance, rank), ties by to_id. Runs jobs.

    Searched over a ``MetricPartition``. Null vectors, and vectors that hold a null or a number that is not finite, take no part.
    """
    return MetricPartition(df, key, vector, block).search(k)[0]


def neighbour_weights(neighbours: DataFrame, steps: int = 64) -> DataFrame:
    """(from_id, to_id, weight), from_id < to_id: the fuzzy union of both directions of a neighbour graph.

    As published for manifold projections: a neighbour counts exp(-(d - nearest) / width),
    nearest being the smallest distance above 0; the width of each row is found by
    bisection, so that its weights add up to the log (base 2) of its neighbours and itself,
    and is a thousandth of the mean distance at least. Two directions a and b make
    a + b - ab. A list of neighbours is one row, so nothing but built-in functions runs. Neighbours
    are counted, so that the bisections are as many tasks as they need.
    """
    lists = spread(neighbours.where("from_id <> to_id and distance is not null"), "from_id", each=WIDTHS).groupBy("from_id").agg(F.array_sort(F.collect_list(F.struct("distance", "to_id"))).alias("near"))
    away = F.transform("near", lambda x: x["distance"])
    nearest = F.coalesce(F.get(F.filter(away, lambda d: d > 0), F.lit(0)), F.lit(0.0))
    rows = lists.withColumns({"nearest": nearest, "target": F.log2(F.size("near") + 1.0), "mean": F.aggregate(away, F.lit(0.0), lambda a, d: a + d) / F.size("near")})

    def total(width):
        return F.aggregate("near", F.lit(0.0), lambda a, x: a + F.exp(-F.greatest(F.lit(0.0), x["distance"] - F.col("nearest")) / width))

    def halve(at, _):
        much = total(at["mid"]) > F.col("target")
        low, high = F.when(much, at["low"]).otherwise(at["mid"]), F.when(much, at["mid"]).otherwise(at["high"])
        return F.struct(low.alias("low"), high.alias("high"), F.when(F.isnan(high), 2 * at["mid"]).otherwise((low + high) / 2).alias("mid"))

    begin = F.struct(F.lit(0.0).alias("low"), F.lit(float("nan")).alias("high"), F.lit(1.0).alias("mid"))
    width = F.greatest(F.aggregate(F.sequence(F.lit(1), F.lit(steps)), begin, halve)["mid"], F.col("mean") / 1000)
    each = rows.withColumn("width", width).select("from_id", "nearest", "width", F.explode("near").alias("x"))
    beyond = F.greatest(F.lit(0.0), F.col("x.distance") - F.col("nearest"))
    one_way = each.select("from_id", F.col("x.to_id").alias("to_id"), F.when(beyond == 0, 1.0).otherwise(F.exp(-beyond / F.col("width"))).alias("w"))
    both = one_way.groupBy(F.least("from_id", "to_id").alias("from_id"), F.greatest("from_id", "to_id").alias("to_id"))
    union = F.sum("w") - F.when(F.count("w") > 1, F.max("w") * F.min("w")).otherwise(0.0)
    return both.agg(union.alias("weight"))
