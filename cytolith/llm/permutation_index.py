"""Approximate nearest neighbours by a permutation index.

Pivots are drawn from the vectors; a vector is represented by its nearest pivots in
order, and is posted in the inverted files of the first few. A query visits the files of
its own nearest pivots, ranks what is posted there by the footrule distance between the
ordered pivot lists, and reranks the best by the inner product of the original vectors.
Postings carry the whole ordered list, so the footrule is known inside any one file.
Files are dealt out in blocks of bounded size, so one that holds a third of all vectors
is many tasks; queries go to every block of the files they visit, in bounded groups too.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cytolith.llm.common import checkpointed

#: Pivots per square root of the number of vectors, and their bounds; they are the only sample that is drawn.
PIVOT_FACTOR, LEAST_PIVOTS, MOST_PIVOTS = 1.15, 16, 4096
BLOCK, QUERY_BLOCK = 1024, 2048  # vectors and queries per block of a file
NEAREST, QUERY_STEP = 20, 20


@dataclass(frozen=True)
class Setting:
    """How the index is built and asked; ``EXACT`` is the setting that leaves nothing out.

    ``listed`` is the length of the ordered pivot lists, ``posted`` the files of a vector,
    ``visited`` and ``share`` the least number and share of files that a query visits,
    ``reranked`` the candidates of a block whose inner product is taken (None: all).
    """

    listed: int = 64
    posted: int = 4
    visited: int = 40
    share: float = 0.155
    reranked: int | None = 256

    def __post_init__(self) -> None:
        if min(self.listed, self.posted, self.visited) < 1 or not 0 <= self.share <= 1 or (self.reranked is not None and self.reranked < 1):
            raise ValueError(f"{self} is no setting of an index")

    def visits(self, n_pivots: int) -> int:
        """Files a query visits; they grow with the pivots, so the share of the index that is seen does not shrink."""
        return min(n_pivots, max(self.visited, math.ceil(self.share * n_pivots)))


EXACT = Setting(posted=1, share=1.0, reranked=None)


def usable(vectors: DataFrame, is_query: Column) -> DataFrame:
    """(vec_id, vector, asked) of the rows that take part.

    Null identifiers, null, empty and zero vectors, and those with null or non-finite
    components do not.
    """
    vector = F.col("embedding")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where("vec_id is not null and embedding is not null").where(finite).where(F.exists(vector, lambda x: x != 0))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asked"))


def _pivots(rows: DataFrame, n: int):
    """Distinct vectors drawn by a hash of their content, scaled to unit length."""
    import numpy as np

    count = int(min(MOST_PIVOTS, max(LEAST_PIVOTS, PIVOT_FACTOR * n**0.5)))
    kept = rows.where(F.pmod(F.xxhash64("vector", F.lit(3)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, 20 * count / max(n, 1))))
    drawn = [r[0] for r in kept.groupBy("vector").count().orderBy(F.xxhash64("vector", F.lit(5))).limit(count).select("vector").collect()]
    if not drawn:
        return np.zeros((0, 0))
    found = np.array(drawn, dtype=np.float64)
    return found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-300)


def _listed(rows: DataFrame, pivots, setting: Setting) -> DataFrame:
    """``rows`` with near, the ordered list of the nearest pivots by direction, and files, those that a row is posted in or visits."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)
    length, visits, posted = min(setting.listed, len(pivots)), setting.visits(len(pivots)), setting.posted
    pivot_list = T.ArrayType(T.ShortType())
    schema = T.StructType([*rows.schema.fields, T.StructField("near", pivot_list), T.StructField("files", pivot_list)])

    def work(batches: Iterator) -> Iterator:
        import numpy as np

        base = shared.value
        for frame in batches:
            if len(frame):
                data = np.stack(frame["vector"].to_numpy()).astype(np.float64)
                order = np.argsort(-(data @ base.T), axis=1, kind="stable")[:, : max(length, visits, posted)].astype(np.int16)
                files = [x[: max(visits, posted) if asked else posted].copy() for x, asked in zip(order, frame["asked"], strict=True)]
                yield frame.assign(near=list(order[:, :length].copy()), files=files)

    return rows.mapInPandas(work, schema)


def nearest(vectors: DataFrame, is_query: Column, k: int = NEAREST, setting: Setting = Setting()) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every query, by largest inner product.

    ``is_query`` is a condition on the rows of ``vectors`` (vec_id, embedding). A query is
    no candidate of its own; ties go to the smaller vec_id; scores are inner products of
    the original vectors in double precision. Repeated rows of an identifier count once: the
    first by their vector. Vectors are compared with those of their own length, each length
    by an index of its own. With ``EXACT``, every vector is compared with every query, block
    by block. Without usable vectors the result is empty.
    """
    rows = usable(vectors, is_query).groupBy("vec_id").agg(F.min("vector").alias("vector"), F.max("asked").alias("asked"))
    rows = checkpointed(rows)
    lengths = rows.groupBy(F.size("vector").alias("size")).agg(F.count(F.lit(1)).alias("n"), F.count_if("asked").alias("q")).orderBy("size").collect()
    out = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for r in lengths:
        if r.n > 1 and r.q:
            out = out.unionByName(_nearest(rows if len(lengths) == 1 else rows.where(F.size("vector") == r["size"]), r.n, k, setting))
    return out


def _nearest(rows: DataFrame, n: int, k: int, setting: Setting) -> DataFrame:
    pivots = _pivots(rows, n)
    listed = _listed(rows, pivots, setting)
    visits = listed.select("asked", F.posexplode("files").alias("nth", "file"))
    sizes = visits.groupBy("file").agg(F.count_if(F.col("nth") < setting.posted).alias("n"), F.count_if("asked").alias("q")).where("n > 0 and q > 0")
    parts = [F.ceil(F.col(c) / size).cast("int").alias(name) for c, size, name in (("n", BLOCK, "parts"), ("q", QUERY_BLOCK, "groups"))]
    sizes = F.broadcast(checkpointed(sizes.select("file", *parts)))  # a row per pivot at most

    def dealt(df: DataFrame, files: int, own: str, own_parts: str, other: str, other_parts: str) -> DataFrame:
        out = df.select("vec_id", "vector", "near", F.explode(F.slice("files", 1, files)).alias("file")).join(sizes, "file")
        out = out.withColumn(own, F.pmod(F.xxhash64("vec_id"), F.col(own_parts)).cast("int"))
        out = out.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other_parts) - 1)))
        return out.select(*[F.col(c).alias(c) for c in ("file", "part", "group", "vec_id", "vector", "near")])  # the sides of the cogroup share a source

    posted = dealt(listed, setting.posted, "part", "parts", "group", "groups")
    asked = dealt(listed.where("asked"), setting.visits(len(pivots)), "group", "groups", "part", "parts")
    n_pivots, length, reranked = len(pivots), min(setting.listed, len(pivots)), setting.reranked

    def search(left, right):
        import numpy as np
        import pandas as pd

        out = {"query_id": [np.array([], np.int64)], "vec_id": [np.array([], np.int64)], "score": [np.array([], np.float64)]}
        if len(left) and len(right):
            right = right.sort_values("vec_id")
            ids, data = right["vec_id"].to_numpy(), np.stack(right["vector"].to_numpy()).astype(np.float64)
            near = np.stack(right["near"].to_numpy())
            place = np.full((n_pivots, len(ids)), length, np.int16)
            place[near.T, np.arange(len(ids))[None, :]] = np.arange(length, dtype=np.int16)[:, None]
            nth = np.arange(length, dtype=np.int16)[:, None]
            for query, vector, order in zip(left["vec_id"], left["vector"], left["near"], strict=True):
                there = place[order]
                # the footrule over both lists, less a constant; pivots that a list lacks stand at its end
                footrule = (np.abs(there - nth) + there).sum(axis=0, dtype=np.int32)
                found = np.argsort(footrule, kind="stable")[:reranked]
                found = found[ids[found] != query]
                score = (data[found] * np.asarray(vector, np.float64)).sum(axis=1)
                best = np.lexsort((ids[found], -score))[:k]
                out["query_id"].append(np.full(len(best), query))
                out["vec_id"].append(ids[found[best]])
                out["score"].append(score[best])
        return pd.DataFrame({c: np.concatenate(v) for c, v in out.items()})

    keys = ["file", "part", "group"]
    found = asked.groupBy(*keys).cogroup(posted.groupBy(*keys)).applyInPandas(search, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    from cytolith.llm.common import read_table

    return nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_STEP == 0)
