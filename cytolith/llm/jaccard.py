"""Near duplicates by the Jaccard similarity of shingles: MinHash bands propose, exact sets confirm.

Every distinct text has BANDS digests of ROWS minima each; texts that share one meet. A
pair at similarity s shares none with probability (1 - s**6)**24, which is 0.0007 at 0.8.
Other proposals can be added: texts of one component of SimHash fingerprints meet as well.

A text goes if it is similar to one that comes before it, in order of the smallest doc_id.
Where texts meet, the first one is held against all others, and then the first four of
those that are left; texts that are similar to one of them leave everywhere, and the ones
held against leave that group. So a group of near copies of any size is as many pairs as
it has members, for its first texts take them out. What still has company afterwards is
compared exactly by prefixes: of two similar sets, each has a member in common with the
other among the first fifth of its own, rarest first. Texts that met for a passage that
very many share have no rare member in common, and make no pairs. No group is capped.

Digests are made where rows are read, so that copies are told by keys. Texts that meet
are compressed one by one and moved by their key once; from there each goes to the parts
of groups in which it is compared, and nowhere else.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cytolith.llm.common import checkpointed, gathered, sized, unused, whole_text
from cytolith.llm.simhash import near_duplicates
from cytolith.session import spread

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 6
#: Texts of a group per part that it is dealt in, texts held against one per part, and slices in which the first of a group are sought.
TEXTS_PER_SALT, PAIRS_PER_SALT, SLICES = 5000, 1000, 64
#: Compressed texts that a task holds by their keys, and that it compares.
KEPT_EACH, HELD_EACH = 1 << 13, 1 << 11
#: Texts of a group that are held against the others in the first rounds.
FIRST = (1, 4)
SEED = 42


def _key() -> Column:
    return F.unhex(F.md5(whole_text().cast("binary")))


def shingles(text: bytes, words: int):
    """Sorted distinct 64-bit hashes of the shingles: words as in ``simhash.fingerprints``.

    Fewer words than a shingle: the whole sequence is the only one, also without any word.
    """
    import numpy as np
    import xxhash

    found = text.lower().split()
    parts = zip(*(found[i:] for i in range(words)), strict=False) if len(found) >= words else [found]
    return np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(x), SEED) for x in parts], np.uint64))


def signatures(texts: DataFrame, words: int = SHINGLE) -> DataFrame:
    """(key, lacks, first, n, bands): number of distinct shingles and band digests beside the other columns of ``texts``."""

    def work(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash

        draw = np.random.default_rng(SEED)
        factor, shift = (draw.integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
        block = 2048

        def one(text: bytes) -> tuple[int, list[int]]:
            hashes = shingles(text, words)
            least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
            for i in range(0, len(hashes), block):
                np.minimum(least, (hashes[None, i : i + block] * factor + shift).min(axis=1), out=least)
            digests = [xxhash.xxh64_intdigest(row.tobytes(), band) for band, row in enumerate(least.reshape(BANDS, ROWS))]
            return len(hashes), np.array(digests, np.uint64).view(np.int64).tolist()

        for batch in batches:
            found = [one(x.as_py()) for x in batch.column("text").cast(pa.binary())]
            columns = [*(batch.column(c) for c in ("key", "lacks", "first")), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "lacks", "first", "n", "bands"])

    return texts.select("key", "lacks", "first", "text").mapInArrow(work, "key binary, lacks boolean, first long, n long, bands array<long>")


def _compressed(docs: DataFrame) -> DataFrame:
    """(key, packed): the texts of all rows, compressed; of equal ones in a batch of rows one stays."""

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            firsts = dict(zip(reversed(batch.column("key").to_pylist()), range(batch.num_rows - 1, -1, -1), strict=True))
            texts = batch.column("text").cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(firsts, pa.binary()), pa.array([packer.compress(texts[i].as_py()) for i in firsts.values()], pa.binary())], ["key", "packed"])

    return docs.select(_key().alias("key"), whole_text().alias("text")).mapInArrow(work, "key binary, packed binary")


def _similar(pairs: DataFrame, texts: DataFrame, names: DataFrame, words: int, least: float) -> DataFrame:
    """(a, b) of the pairs whose texts (key, packed) have at least the similarity ``least``; names are (id, key). Runs jobs."""

    def work(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import zstandard

        opener, own = zstandard.ZstdDecompressor(), None
        for batch in batches:
            kept = []
            for i, (b, packed) in enumerate(zip(batch.column("b").to_pylist(), batch.column("packed"), strict=True)):
                found = shingles(opener.decompress(packed.as_py()), words)
                if b is None:
                    own = found
                    continue
                common = len(np.intersect1d(own, found, assume_unique=True))
                if common >= least * (len(own) + len(found) - common):
                    kept.append(i)
            yield batch.select(["a", "b"]).take(pa.array(kept, pa.int64()))

    n = pairs.count()
    pairs = gathered(pairs, n)
    # the texts held against a very common one are many tasks, each with a copy of that one
    large = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PAIRS_PER_SALT).cast("int").alias("salts")).where("salts > 1")
    salt = F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64("b"), F.col("salts"))).cast("int")
    others = pairs.join(sized(checkpointed(gathered(large, n))), "a", "left").select("a", "b", salt.alias("salt"))
    firsts = others.select("a", "salt").distinct().select(F.col("a").alias("id"), "a", "salt", F.lit(None).cast("long").alias("b"))
    asked = others.select(F.col("b").alias("id"), "a", "salt", "b").unionByName(firsts).join(names, "id").select("key", "a", "salt", "b")
    # a copy of the one that the others are held against comes before them
    sent = spread(asked.join(texts, "key").select("a", "salt", "b", "packed"), "a", "salt", rows=2 * n, each=HELD_EACH)
    return gathered(checkpointed(sent.sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first()).select("a", "b", "packed").mapInArrow(work, "a long, b long")), n)


def _prefix_pairs(texts: DataFrame, words: int, least: float) -> DataFrame:
    """(a, b), a < b, of the texts (id, packed) that may be that similar; all similar ones are among them."""

    def work(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import zstandard

        opener = zstandard.ZstdDecompressor()
        for batch in batches:
            found = [shingles(opener.decompress(x.as_py()), words).view(np.int64) for x in batch.column("packed")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.list_(pa.int64()))], ["id", "members"])

    members = texts.select("id", "packed").mapInArrow(work, "id long, members array<long>")
    members = checkpointed(members.select("id", F.size("members").alias("n"), F.explode("members").alias("member")))
    n = members.count()
    members = gathered(members, n)
    common = members.groupBy("member").agg(F.count(F.lit(1)).alias("df"))
    nth = F.row_number().over(Window.partitionBy("id").orderBy("df", "member"))
    prefix = members.join(common, "member").withColumn("nth", nth)
    prefix = prefix.where((F.col("nth") <= F.col("n") - F.ceil(F.lit(least) * F.col("n") - 1e-9) + 1) & (F.col("df") > 1))
    prefix = checkpointed(gathered(prefix.select("member", "id", "n", "nth"), n))
    met = prefix.select("member", F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("nth").alias("nth_a")).join(prefix.withColumnRenamed("id", "b"), "member")
    # the first common member and all that come after it have to suffice
    most = F.least(F.col("n_a") - F.col("nth_a"), F.col("n") - F.col("nth")) + 1
    enough = (most >= least / (1 + least) * (F.col("n_a") + F.col("n")) - 1e-9) & (F.least("n", "n_a") >= least * F.greatest("n", "n_a"))
    return met.where((F.col("a") < F.col("b")) & enough).select("a", "b").distinct()


def fingerprint_groups(docs: DataFrame) -> DataFrame:
    """(name, band): texts, by a hash of their key, and the component of SimHash fingerprints that they are in. Runs jobs."""
    found = near_duplicates(docs.select(F.xxhash64(_key()).alias("doc_id"), whole_text().alias("text")))
    return found.select(F.col("doc_id").alias("name"), F.xxhash64(F.lit("simhash"), "component_id").alias("band")).distinct()


def similar_to_earlier(docs: DataFrame, words: int = SHINGLE, least: float = SIMILARITY, proposed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(texts, links): the distinct texts as (id, key, first), and (a, b) where text b goes for its similarity to text a.

    ``proposed`` (as of ``fingerprint_groups``) are groups of texts that meet beside those of the bands.
    ids follow the order of the smallest doc_id; texts without one come last.
    """
    first = F.col("doc_id").cast("long")
    prints = signatures(docs.select(_key().alias("key"), first.isNull().alias("lacks"), first.alias("first"), whole_text().alias("text")), words)
    prints = prints.groupBy("key").agg(F.min("lacks").alias("lacks"), F.min("first").alias("first"), F.any_value("n").alias("n"), F.any_value("bands").alias("bands"))
    # ids grow in the order of the rows, which is kept by the checkpoint
    prints = checkpointed(prints)
    n_texts = prints.count()
    prints = gathered(checkpointed(gathered(prints, n_texts).orderBy("lacks", "first", "key").withColumn("id", F.monotonically_increasing_id())), n_texts)

    def in_company(met: DataFrame, most: int) -> tuple[DataFrame, int]:
        """Those of ``most`` rows at most that have others in their group, and how many these are."""
        several = met.groupBy("band").agg(F.count(F.lit(1)).alias("members")).where("members > 1").select("band")
        left = checkpointed(gathered(met.join(several, "band", "left_semi"), most))
        rows = left.count()
        return gathered(left, rows), rows

    def earliest(met: DataFrame, many: int) -> DataFrame:
        """The first texts of each group: those of its slices first, so that no group is ordered in one task."""
        if many == 1:
            return met.groupBy("band").agg(F.min(F.struct("id", "n")).alias("x")).select("band", F.col("x.id").alias("a"), F.col("x.n").alias("n_a"))
        piece = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(SLICES))
        some = met.withColumn("piece", piece).withColumn("place", F.row_number().over(Window.partitionBy("band", "piece").orderBy("id"))).where(F.col("place") <= many)
        place = F.row_number().over(Window.partitionBy("band").orderBy("id"))
        return some.select("band", "id", "n", place.alias("place")).where(F.col("place") <= many).select("band", F.col("id").alias("a"), F.col("n").alias("n_a"))

    def dealt(met: DataFrame, chosen: DataFrame, rows: int) -> DataFrame:
        """Each text beside the chosen ones of its group; large groups are dealt in parts by their counted size."""
        large = met.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / TEXTS_PER_SALT).cast("int").alias("salts")).where("salts > 1")
        large = sized(checkpointed(gathered(large, rows)))
        left = met.join(large, "band", "left").withColumn("salt", F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64("id"), F.col("salts"))).cast("int"))
        right = chosen.join(large, "band", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
        return left.select("band", "salt", "id", "n").join(right.select("band", "salt", "a", "n_a"), ["band", "salt"]).where("a < id")

    met = prints.select("id", "n", F.explode("bands").alias("band"))
    if proposed is not None:
        met = met.unionByName(prints.select("id", "n", F.xxhash64("key").alias("name")).join(proposed, "name").select("id", "n", "band"))
    met, rows = in_company(met, (BANDS + 1) * n_texts)
    names = prints.select("id", "key")
    wanted = met.select("id").distinct().join(names, "id")
    # the checkpoint stays dealt by key, so what asks for texts is moved and not they
    texts = spread(_compressed(docs), "key", rows=n_texts, each=KEPT_EACH)
    texts = checkpointed(texts.join(wanted, "key").dropDuplicates(["key"]).select("key", "id", "packed"))
    links = docs.sparkSession.createDataFrame([], "a long, b long")
    for many in FIRST:
        chosen = gathered(checkpointed(gathered(earliest(met, many), rows)), rows)
        near = dealt(met, chosen, rows).where(F.least("n", "n_a") >= least * F.greatest("n", "n_a"))
        pairs = checkpointed(gathered(near.select("a", F.col("id").alias("b")).distinct(), many * rows))
        found = _similar(pairs, texts.drop("id"), names, words, least)
        links = links.unionByName(found)
        gone = found.select(F.col("b").alias("id")).distinct()
        met, rows = in_company(gathered(met.join(gone, "id", "left_anti").join(chosen.select("band", F.col("a").alias("id")), ["band", "id"], "left_anti"), rows), rows)
    rest = checkpointed(texts.join(met.select("id").distinct().join(names, "id").select("key"), "key", "left_semi"))
    pairs = checkpointed(_prefix_pairs(rest, words, least))
    return prints.select("id", "key", "first"), links.unionByName(_similar(pairs, rest.drop("id"), names, words, least))


def drop_similar(docs: DataFrame, words: int = SHINGLE, least: float = SIMILARITY, proposed: DataFrame | None = None) -> DataFrame:
    """``docs`` without the rows whose text equals, or is that similar to, the text of a row before it.

    Rows come in the order of doc_id, those without one last; of equal texts one row stays,
    with the smallest doc_id. Null texts count as empty; texts without any word are similar
    to each other only. Rows that share a doc_id are judged by their texts alone. All
    columns are kept; an empty table gives an empty result. Runs jobs when it is called.
    """
    texts, links = similar_to_earlier(docs, words, least, proposed)
    name = unused(docs, "__name")
    held = f"{name}_kept"
    kept = texts.join(links.select(F.col("b").alias("id")).distinct(), "id", "left_anti").select(F.struct("key", "first").alias(held))
    # of the rows of a text those with the smallest doc_id are left; one name for both moves the rows only once
    rows = docs.withColumn(name, F.struct(_key().alias("key"), F.col("doc_id").cast("long").alias("first")))
    return rows.join(kept, F.col(name) == F.col(held), "left_semi").dropDuplicates([name]).select(*docs.columns)
