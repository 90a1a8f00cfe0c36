"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint is 64 bits wide. Two fingerprints at two or fewer differing bits have a
third one at most one bit from both, so every distinct fingerprint emits itself and its
64 one-bit variants, variants are shuffled, and fingerprints that meet are linked after
their distance is verified. At most 65 distinct fingerprints can meet at one variant;
they are chained in order, which keeps every link of the component and never forms all
pairs. Copies share a fingerprint and are carried by one row, so a group of copies of
any size costs one row.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cytolith.llm.common import checkpointed, hex64, whole_text
from cytolith.llm.components import connected_components

BITS = 64
SEED = 42


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp): the SimHash of each row's whole text over shingles of ``words`` words.

    A-Z is lowered, words are runs without ASCII white space, shingles keep repeats. Fewer
    words than a shingle: the whole sequence is the only shingle; no word or a null text:
    zero. fp is the fingerprint as a signed 64-bit integer. Repeated rows and null
    identifiers keep their rows.
    """

    def work(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash

        digest = xxhash.xxh64_intdigest
        block = 1 << 16

        def one(text: bytes) -> int:
            found = text.lower().split()
            if len(found) < words:
                hashes = [digest(b" ".join(found), SEED)] if found else []
            else:
                hashes = [digest(b" ".join(x), SEED) for x in zip(*(found[i:] for i in range(words)), strict=False)]
            counts = np.zeros(BITS, np.int64)
            for i in range(0, len(hashes), block):
                bits = np.unpackbits(np.array(hashes[i : i + block], "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                counts += bits.sum(axis=0, dtype=np.int64)
            return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])

        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([one(x) for x in texts], pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(work, "doc_id long, fp long")


def ball_links(distinct: DataFrame) -> DataFrame:
    """(a, b): links between the distinct fingerprints ``fp`` that join all those at two or fewer differing bits.

    The links are a subset of all such pairs with the same components.
    """
    flips = [F.lit(0).cast("long")] + [F.shiftleft(F.lit(1).cast("long"), i) for i in range(BITS)]
    variants = distinct.select("fp", F.explode(F.transform(F.array(*flips), lambda m: F.col("fp").bitwiseXOR(m))).alias("variant"))
    near = Window.partitionBy("variant").orderBy("fp")
    pairs = variants.select(F.lag("fp").over(near).alias("a"), F.col("fp").alias("b")).where("a is not null")
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2).distinct()


def near_duplicates(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) per row; component_id is the smallest doc_id reachable over links.

    Links join fingerprints at two or fewer differing bits. An empty table gives an empty
    result; rows with a null identifier get one too, and a component without any
    identifier has a null component_id.
    """
    prints = checkpointed(fingerprints(docs, words))
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = connected_components(ball_links(distinct.select("fp")))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    members = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(members, "fp").select("doc_id", "fp", "component_id")


def query(spark, sf_dir: str) -> DataFrame:
    from cytolith.llm.common import read_table

    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex64(F.col("fp")).alias("fingerprint"), "component_id")
