"""Best-two-fit packing of documents into sequences of bounded length.

Tasks turn texts into pieces. What is left after full pieces is shorter than a sequence,
so the number of pieces of each length is a histogram with at most ``capacity`` entries,
however large the corpus is. Best-two-fit runs on that histogram: it fills a bin
greedily, then replaces the bin's smallest piece with two unpacked ones that fit the
expanded gap more tightly, and repeats the bin as often as its lengths last. The plan is
a bounded table of rank ranges per length; pieces are numbered within their length and
find their place by a join. No piece passes through the driver.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cytolith.llm.common import checkpointed, whole_text
from cytolith.llm.tokens import default_path, encoder, read_vocabulary

CAPACITY = 2048
SEPARATOR = 0
#: At least so many numbered groups per length, so that one very common length is many tasks.
SALTS, ROWS_PER_GROUP = 64, 200_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of at most ``capacity`` ids of each row: the ids of its whole text, then the separator.

    Only longer documents are cut, into pieces of ``capacity`` ids; the first may be
    shorter. A null or empty text has the separator only. Repeated rows are packed as
    often as they occur.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(tokenizer_path or default_path()))

    def work(batches: Iterator) -> Iterator:
        import zlib

        import numpy as np
        import pyarrow as pa

        encode = encoder(shared.value)
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*encode(text.as_py()), SEPARATOR], "<u4")
                end = len(ids) % capacity or min(capacity, len(ids))
                start = 0
                for k in range(-(-len(ids) // capacity)):
                    out.append((doc, k, start, end - start, zlib.crc32(ids[start:end].tobytes())))
                    start, end = end, end + capacity
            columns = zip(*out, strict=True) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(work, PIECES)


def best_two_fit(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Bins as (lengths, how often), for so many pieces of each length.

    Each step uses up the chance to repeat its bin, so the number of bins listed follows
    the number of lengths, not of pieces.
    """
    import numpy as np

    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} ids does not fit {capacity}")
        left[length] += n
    plan = []
    while left.any():
        free = left.copy()
        members: list[int] = []
        gap = capacity
        while gap > 0 and len(fits := np.flatnonzero(free[: gap + 1])):
            members.append(int(fits[-1]))
            free[members[-1]] -= 1
            gap -= members[-1]
        while gap > 0 and len(members) > 1:
            small = min(members)
            lengths = np.flatnonzero(free)
            lengths = lengths[lengths <= gap + small]
            if not len(lengths):
                break
            at = np.searchsorted(lengths, gap + small - lengths, side="right") - 1
            partner = np.where(at >= 0, lengths[at], 0)
            same = (partner == lengths) & (free[lengths] < 2)
            partner = np.where(same, np.where(at > 0, lengths[np.maximum(at - 1, 0)], 0), partner)
            both = np.where(partner > 0, lengths + partner, 0)
            best = int(both.argmax())
            if both[best] <= small:
                break
            members.remove(small)
            free[small] += 1
            for x in (int(lengths[best]), int(partner[best])):
                members.append(x)
                free[x] -= 1
            gap = capacity - sum(members)
        need = Counter(members)
        times = min(int(left[x]) // n for x, n in need.items())
        for x, n in need.items():
            left[x] -= n * times
        plan.append((tuple(sorted(members, reverse=True)), times))
    return plan


def placement(plan: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Rank ranges per length: (length, lo, hi, times, first sequence, first offset)."""
    rows, used, sequence = [], Counter(), 0
    for members, times in plan:
        offset = 0
        for length, n in Counter(members).items():
            rows.append((length, used[length], used[length] + n * times, times, sequence, offset))
            used[length] += n * times
            offset += n * length
        sequence += times
    return rows


def pack(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with sequence_id and offset; sequences have no gaps and start at 0."""
    cut = checkpointed(pieces(docs, tokenizer_path, capacity))
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = cut.sparkSession.createDataFrame(
        placement(best_two_fit(histogram, capacity)), "at_length long, lo long, hi long, times long, first_sequence long, first_offset long"
    )
    salts = max(SALTS, sum(histogram.values()) // ROWS_PER_GROUP)
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.lit(7)), F.lit(salts)).cast("int"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece")
    numbered = salted.withColumn("nth", F.row_number().over(order).cast("long") - 1).join(counts, ["length", "salt"])
    numbered = numbered.withColumn("rank", F.col("base") + F.col("nth"))
    near = (F.col("length") == F.col("at_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    placed = numbered.join(F.broadcast(places), near)
    within = F.col("rank") - F.col("lo")
    return placed.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("first_sequence") + within % F.col("times")).alias("sequence_id"),
        (F.col("first_offset") + F.floor(within / F.col("times")).cast("long") * F.col("length")).alias("offset"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    from cytolith.llm.common import read_table

    return pack(read_table(spark, sf_dir, "documents"))
