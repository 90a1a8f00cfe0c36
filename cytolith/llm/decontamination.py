"""Benchmark decontamination by spaced-seed hashing, with built-in functions only.

Texts become arrays of word hashes. Fixed masks pick words of a short stretch and ignore
the others, so a seed still hits where an ignored word was replaced. Seeds of documents
are joined to those of benchmark items; each hit names an item and a diagonal (where the
item would start in the document). On every diagonal the words of item and document are
compared place by place, and an overlap counts if a window of the item has at least 80 %
equal words. The window is half of the item, 13 words at least, or the whole of a shorter
item. The masks hit every such window, wherever its replaced words stand: two masks of
five words for windows from 13 words on, two of three words for shorter ones. No way to
replace a fifth of a window avoids them (the tests count the least replacements that do).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytolith.llm.common import BROADCAST_ROWS, checkpointed, sized, whole_text

#: Word offsets that a mask looks at, for items from WINDOW_WORDS words on and for shorter ones. All begin with two neighbours.
MASKS = ((0, 1, 2, 3, 4), (0, 1, 2, 4, 5))
SHORT_MASKS = ((0, 1, 2), (0, 1, 3))
LEAST_WORDS = 5
WINDOW_WORDS = 13
SIMILARITY = 0.8

#: ASCII and common typographic characters that separate words.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\xA9\xAB-\xB4\xB6-\xB9\xBB-\xBF\xD7\xF7 -⁯　-〿]+"


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the lower-cased words of a text, in order."""
    words = F.filter(F.split(F.lower(text), SEPARATORS), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


SPAN = 1 + max(mask[-1] for mask in MASKS + SHORT_MASKS)
WORDS = [f"w{i}" for i in range(SPAN)]


def _places(df: DataFrame, key: str) -> DataFrame:
    """(key, at, w0, w1 ..): every word of every row's ``words`` with those that follow, null beyond the end."""
    n = F.size("words")
    shifted = [F.slice("words", i + 1, n) for i in range(SPAN)]
    rows = df.where(n > 0).select(key, F.inline(F.arrays_zip(F.sequence(F.lit(0), n - 1), *shifted)))
    return rows.toDF(key, "at", *WORDS)


def _pair() -> Column:
    """All masks begin with two neighbouring words."""
    return F.xxhash64("w0", "w1")


def _seeded(places: DataFrame, key: str) -> DataFrame:
    """(key, seed, at): the seed of each mask at each place; none where the mask runs over the end.

    ``short`` and ``long`` say which masks a place needs.
    """
    families = (("long", MASKS), ("short", SHORT_MASKS))
    seeds = [
        F.when(F.col(need) & F.col(f"w{mask[-1]}").isNotNull(), F.xxhash64(*[F.col(f"w{o}") for o in mask], F.lit(f"{need}{k}"))) for need, masks in families for k, mask in enumerate(masks)
    ]
    return places.select(key, "at", F.explode(F.array(*seeds)).alias("seed")).where("seed is not null")


def _best_window(equal: Column, size: Column) -> Column:
    """(n, at): the most equal words in a window of ``size`` places, and the first place where it begins, from running sums."""

    def step(state: Column, i: Column) -> Column:
        total = state["total"] + F.get(equal, i) - F.coalesce(F.get(equal, i - size), F.lit(0))
        better = (i + 1 >= size) & (total > state["n"])
        return F.struct(total.alias("total"), F.when(better, total).otherwise(state["n"]).alias("n"), F.when(better, i + 1 - size).otherwise(state["at"]).alias("at"))

    none = F.struct(F.lit(0).alias("total"), F.lit(-1).alias("n"), F.lit(0).alias("at"))
    return F.aggregate(F.sequence(F.lit(0), F.size(equal) - 1), none, step)


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, start, n_equal, n_compared, similarity): the best overlap of each document and item.

    start is the word of the document where the compared window begins. Rows without
    doc_id or item_id, null and empty texts, and items of fewer than five words take no
    part. Repeated rows count once. Columns other than the identifiers and text are not
    read, so they may have any names.
    """
    items = benchmark.where("item_id is not null").select("item_id", word_hashes(whole_text()).alias("words")).distinct()
    items = checkpointed(items.where(F.size("words") >= LEAST_WORDS))
    kinds = [(F.size("words") < WINDOW_WORDS).alias("short"), (F.size("words") >= WINDOW_WORDS).alias("long")]
    item_places = _places(items.select("item_id", "words"), "item_id").join(sized(items.select("item_id", *kinds).distinct()), "item_id")
    seeds = _seeded(item_places, "item_id").select("seed", "item_id", F.col("at").alias("item_at"))
    pairs = item_places.groupBy(_pair().alias("pair")).agg(F.bool_or("short").alias("short"), F.bool_or("long").alias("long"))
    texts = docs.where("doc_id is not null").select("doc_id", whole_text().alias("text"))
    places = _places(texts.select("doc_id", word_hashes(F.col("text")).alias("words")), "doc_id").withColumn("pair", _pair())
    # few places have two neighbouring words of an item; only there are seeds made
    places = places.join(sized(pairs), "pair")
    found = _seeded(places, "doc_id").join(sized(seeds), "seed")
    hits = checkpointed(found.select("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("diagonal")).distinct())

    few = hits.count() <= BROADCAST_ROWS
    near = F.broadcast(hits) if few else hits
    marked = hits.select("doc_id").distinct()
    held = texts.join(F.broadcast(marked) if few else marked, "doc_id", "left_semi")
    held = held.select("doc_id", word_hashes(F.col("text")).alias("words"))
    sides = held.join(near, "doc_id").select(
        "doc_id",
        "item_id",
        "diagonal",
        F.slice("words", F.greatest("diagonal", F.lit(0)) + 1, F.size("words")).alias("rest"),
    )
    sides = sides.join(sized(items.withColumnRenamed("words", "item_words"), width=8 * F.size("item_words")), "item_id")
    skipped = F.greatest(-F.col("diagonal"), F.lit(0))
    equal = F.transform("item_words", lambda w, q: F.coalesce(((q >= skipped) & (F.get("rest", q - skipped) == w)).cast("int"), F.lit(0)))
    n = F.size("item_words")
    window = F.least(n, F.greatest(F.lit(WINDOW_WORDS), F.ceil(n / 2).cast("int")))
    scored = sides.select("doc_id", "item_id", "diagonal", equal.alias("equal"), window.alias("n_compared"))
    best = scored.select("doc_id", "item_id", "diagonal", "n_compared", _best_window(F.col("equal"), F.col("n_compared")).alias("best"))
    best = best.where(F.col("best.n") >= F.ceil(F.lit(similarity) * F.col("n_compared") - 1e-9))
    start = (F.col("diagonal") + F.col("best.at")).cast("long")
    ranked = best.select("doc_id", "item_id", F.struct(F.col("best.n").alias("n"), (-start).alias("back"), F.col("n_compared").alias("of")).alias("b"))
    top = ranked.groupBy("doc_id", "item_id").agg(F.max("b").alias("b"))
    return top.select(
        "doc_id",
        "item_id",
        (-F.col("b.back")).alias("start"),
        F.col("b.n").cast("long").alias("n_equal"),
        F.col("b.of").cast("long").alias("n_compared"),
        F.round(F.col("b.n") / F.col("b.of"), 6).alias("similarity"),
    )


def drop_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` without the documents that hold benchmark passages; all columns and repeated rows are kept."""
    marked = checkpointed(leaks(docs, benchmark, similarity).select("doc_id").distinct())
    return docs.join(sized(marked), "doc_id", "left_anti").select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    from cytolith.llm.common import read_table

    return leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))




def oracle() -> str:
    """The same overlaps in SQL, by comparing every item with every document on every diagonal."""
    split = f"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '{SEPARATORS}'), lambda w: w <> '')"
    return f"""
with docs as (select distinct doc_id, {split} as w from documents where doc_id is not null),
items as (select distinct item_id, {split} as w, len({split}) as n from benchmark where item_id is not null and len({split}) >= {LEAST_WORDS}),
d as (select doc_id, unnest(w) as word, unnest(range(len(w))) as p from docs),
i as (select item_id, unnest(w) as word, unnest(range(len(w))) as q, n, least(n, greatest({WINDOW_WORDS}, cast(ceil(n / 2.0) as bigint))) as size from items),
equal as (select distinct doc_id, item_id, p - q as diagonal, q, n, size from d join i using (word)),
near as (select doc_id, item_id, diagonal, n, size from equal group by all having count(*) >= ceil({SIMILARITY} * size - 1e-9)),
starts as (select *, unnest(range(n - size + 1)) as a from near),
counted as (select s.doc_id, s.item_id, s.diagonal + a as start, size, count(*) as n_equal from starts s join equal e using (doc_id, item_id, diagonal, size)
  where e.q >= a and e.q < a + size group by all),
best as (select * from counted where n_equal >= ceil({SIMILARITY} * size - 1e-9) qualify row_number() over (partition by doc_id, item_id order by n_equal desc, start) = 1)
select doc_id, item_id, start, n_equal, size as n_compared, round(cast(n_equal as double) / size, 6) as similarity from best
"""
