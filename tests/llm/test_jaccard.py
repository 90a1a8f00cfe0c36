"""Near duplicates by the similarity of shingles, on planted copies."""

from __future__ import annotations

import random

import corpus_pipeline
from cytolith.llm import jaccard
from cytolith.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    found = (text or "").encode().lower().split()
    return {tuple(found[i : i + 5]) for i in range(len(found) - 4)} or {tuple(found)}


def planted():
    r = random.Random(3)
    texts = []
    for _ in range(60):
        base = [f"w{r.randrange(3000)}" for _ in range(r.randint(60, 300))]
        texts.append(" ".join(base))
        for part in (0.012, 0.02, 0.03):  # similarities about 0.9, 0.8 and 0.75
            copy = [f"z{r.randrange(9999)}" if r.random() < part else w for w in base]
            texts.append(" ".join(copy))
    return [*texts, texts[0].upper(), texts[4].replace(" ", " \n"), "", None, " \t", "one two", "ONE\ntwo", "one three"]


def kept_by_comparing_all(docs):
    """Identifiers (-1 for none) of the texts that are like no earlier one that was held against them."""
    first: dict = {}
    for i, t in sorted(docs, key=lambda x: (x[0] is None, x[0] or 0)):
        first.setdefault(t or "", i)
    texts = list(first.items())
    sets = [shingles(t) for t, _ in texts]
    near = [[i for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])] for j in range(len(texts))]
    return sorted(-1 if i is None else i for (_, i), before in zip(texts, near, strict=True) if not before)


def test_the_stage_drops_planted_near_copies(spark):
    docs = list(enumerate(planted(), 1))
    docs += [(None, docs[0][1]), (None, docs[4][1] + " tail"), (None, "alone, without an identifier"), (None, "alone, without an identifier"), (7, "another text of that identifier"), docs[11]]
    expected = kept_by_comparing_all(docs)
    df = spark.createDataFrame([(i, t, "en", "x", 0) for i, t in docs], DOCS)
    kept = corpus_pipeline.near_dedup_stage(spark, df, "")
    assert kept.columns == df.columns
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect()) == expected
    links = jaccard.similar_to_earlier(df)[1].collect()
    assert all(r.a < r.b for r in links) and len(links) > 40
    assert corpus_pipeline.near_dedup_stage(spark, df.limit(0), "").count() == 0


def test_a_large_group_of_near_copies_and_one_of_unlike_texts(spark, monkeypatch):
    """Texts that share half of their words meet often; no group is capped and no similar pair stays."""
    r = random.Random(4)
    base = [f"w{k}" for k in range(200)]
    docs = []
    for i in range(120):
        docs.append((i, " ".join(base[:k] + [f"x{i}"] + base[k + 1 :] if (k := r.randrange(200)) else base)))  # one word of 200: similar to all
    for i in range(120, 180):
        docs.append((i, " ".join(base[:100] + [f"own{i}x{k}" for k in range(r.choice([20, 60]))])))
    df = spark.createDataFrame([(i, t, "en", "x", 0) for i, t in docs], DOCS)
    assert sorted(x.doc_id for x in jaccard.drop_similar(df).collect()) == kept_by_comparing_all(docs)


def test_large_groups_are_dealt_in_parts(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TEXTS_PER_SALT", 7)
    monkeypatch.setattr(jaccard, "PAIRS_PER_SALT", 5)
    monkeypatch.setattr(jaccard, "SLICES", 3)
    docs = list(enumerate(planted(), 1))
    base = [f"w{k}" for k in range(100)]
    docs += [(1000 + i, " ".join([*base, f"tail{i}"])) for i in range(50)]
    df = spark.createDataFrame([(i, t, "en", "x", 0) for i, t in docs], DOCS)
    assert sorted(x.doc_id for x in jaccard.drop_similar(df).collect()) == kept_by_comparing_all(docs)


def test_names_of_columns_do_not_matter(spark):
    """Every stage with columns that are called as its own are on the way."""
    names = ["__key", "__key_kept", "__text", "__words", "__features", "__upper", "__spans", "__score", "__probability", "band"]
    docs = [(1, "some words here, and more of them."), (2, "some words here, and more of them."), (3, "mail a.b@example.org now"), (None, None)]
    df = spark.createDataFrame([(i, t, "en", "x", 9, *names) for i, t in docs], DOCS + "".join(f", `{x}` string" for x in names))
    for out in (corpus_pipeline.near_dedup_stage(spark, df, ""), corpus_pipeline.pii_stage(spark, df, "")):
        assert out.columns == df.columns and all([r[x] for x in names] == names for r in out.collect())
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 4)], "doc_id long, quality int")
    from cytolith.llm import quality

    out = quality.keep_good(df, labels, 0.0)
    assert out.columns == df.columns and out.count() == 4 and all([r[x] for x in names] == names for r in out.collect())


def test_fingerprints_propose_what_no_band_does(spark, monkeypatch):
    from pyspark.sql import functions as F

    made = jaccard.signatures
    monkeypatch.setattr(jaccard, "signatures", lambda *x: made(*x).withColumn("bands", F.array(F.xxhash64("key"))))
    text = " ".join(f"w{i * i % 977}" for i in range(80))
    rows = [(2, text.upper()), (1, text), (3, text.replace(" ", "  ")), (4, "some other words that are like none of these"), (5, text)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS)
    assert sorted(x.doc_id for x in corpus_pipeline.near_dedup_stage(spark, df, "").collect()) == [1, 4]


def test_texts_move_a_few_times_only(spark):
    """Shuffles write less than six times the texts, most of which leave in the first round."""
    r = random.Random(5)
    docs = []
    for i in range(40):
        base = [f"{r.getrandbits(64):x}" for _ in range(1500)]
        docs += [(3 * i + k, " ".join([*base, *["tail"] * k])) for k in range(3)]
    df = jaccard.checkpointed(spark.createDataFrame([(i, t, "en", "x", 0) for i, t in docs], DOCS).repartition(3))
    gateway = spark.sparkContext._gateway

    def written():
        store = spark.sparkContext._jsc.sc().statusStore()
        stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = written()
    assert sorted(x.doc_id for x in jaccard.drop_similar(df).collect()) == [3 * i for i in range(40)]
    assert 0 < written() - before < 6 * sum(len(t) for _, t in docs)


def test_few_rows_make_few_tasks(spark):
    """Tasks follow the rows and not the partitions of shuffles: over 40 of them, components and the stage keep to a few tasks."""
    gateway = spark.sparkContext._gateway

    def tasks():
        store = spark.sparkContext._jsc.sc().statusStore()
        stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return {stages.apply(i).stageId(): stages.apply(i).numCompleteTasks() for i in range(stages.size())}

    def ran(before):
        return sum(n for k, n in tasks().items() if k not in before)

    settings = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    were = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        before = tasks()
        edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
        found = {r.node: r.root for r in connected_components(edges).collect()}
        assert found == {i: 0 for i in range(61)} | {100: 100, 101: 100}
        chain = ran(before)
        before = tasks()
        docs = list(enumerate(planted(), 1))
        df = spark.createDataFrame([(i, t, "en", "x", 0) for i, t in docs], DOCS)
        assert sorted(x.doc_id for x in jaccard.drop_similar(df).collect()) == kept_by_comparing_all(docs)
        stage = ran(before)
    finally:
        for k, v in were.items():
            spark.conf.set(k, v)
    assert 0 < chain < 1000 and 0 < stage < 2700
