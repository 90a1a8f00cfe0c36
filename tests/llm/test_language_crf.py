"""Languages of words: the recursion and the gradient against brute force, accuracy on held-out rows."""

from __future__ import annotations

import itertools
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytolith.llm import language_crf as crf

SCHEMA = "doc_id long, text string, lang string, key string, score double, spans string"
WORDS = {"aa": "ba bo bi bu bado bolibo", "zz": "xyl xor kyx zyxa wyk xxoz"}


def chains(n, k, seed):
    r = np.random.default_rng(seed)
    first = r.random(n) < 0.3
    first[0] = True
    return r.normal(size=(n, k)) * 2, first, r.normal(size=(k, k)), r.normal(size=k)


@pytest.mark.parametrize("seed", range(4))
def test_forward_backward_sums_over_all_paths(seed):
    scores, first, transitions, start = chains(7, 3, seed)
    shares, expected, total = np.zeros((7, 3)), np.zeros((3, 3)), 0.0
    for path in itertools.product(range(3), repeat=7):
        value = sum(scores[t, y] + (start[y] if first[t] else transitions[path[t - 1], y]) for t, y in enumerate(path))
        weight = np.exp(value)
        total += weight
        for t, y in enumerate(path):
            shares[t, y] += weight
            if not first[t]:
                expected[path[t - 1], y] += weight
    got, log_sum, pairs = crf.forward_backward(scores, first, transitions, start, pairs=True)
    assert np.allclose(got, shares / total) and np.isclose(log_sum, np.log(total)) and np.allclose(pairs, expected / total)


def test_blocks_of_steps_do_not_change_long_chains():
    scores, first, transitions, start = chains(5000, 4, 9)
    alpha, beta = np.zeros((5000, 4)), np.ones((5000, 4))
    for t in range(5000):
        state = np.exp(start if first[t] else np.log(alpha[t - 1] @ np.exp(transitions))) * np.exp(scores[t])
        alpha[t] = state / state.sum()
    for t in range(4998, -1, -1):
        beta[t] = 1.0 if first[t + 1] else np.exp(transitions) @ (np.exp(scores[t + 1]) * beta[t + 1])
        beta[t] /= beta[t].sum()
    plain = alpha * beta
    assert np.allclose(crf.forward_backward(scores, first, transitions, start)[0], plain / plain.sum(axis=1, keepdims=True))


def test_gradient_is_that_of_the_loss():
    r = np.random.default_rng(3)
    features, starts = crf.word_features(["ba", "xyl", "bo"], {"ba": [0]}, 2)
    block = ([0, 1, 2, 0, 1], [0, 1, 0, 0, 1], [True, False, False, True, False], features, starts)
    theta = r.normal(size=(crf.BUCKETS + 2 + 1 + 2 + 1) * 2) / 10
    _, slope = crf.block_loss(theta, 2, *block)
    for at in [*(2 * f for f in features[:6]), 2 * crf.BUCKETS, *range(len(theta) - 6, len(theta))]:
        step = np.zeros(len(theta))
        step[at] = 1e-5
        plain = (crf.block_loss(theta + step, 2, *block)[0] - crf.block_loss(theta - step, 2, *block)[0]) / 2e-5
        assert abs(plain - slope[at]) < 1e-6


def test_features_of_a_word_do_not_hang_on_the_others():
    words = ["a", "ab", "Ärger", "ÄRGER", "𝄞x", "word" * 50, "naïve"]
    features, starts = crf.word_features(words, {"ab": [1], "naïve": [0, 1]}, 2)
    cut = [list(x) for x in np.split(features, starts[1:])]
    assert cut == [list(crf.word_features([w], {"ab": [1], "naïve": [0, 1]}, 2)[0]) for w in words]
    assert cut[2] == cut[3] and [len(x) for x in cut[:2]] == [1 + 2 + 1 + 2 + 1, 1 + 3 + 2 + 4 + 1 + 1] and max(features) == crf.BUCKETS + 2


def test_fast_words_are_the_same():
    every = "".join(map(chr, range(256)))
    for text in (every, "ab c1d éa_b x²y ªº µ", " ".join(every), "中文 ab", ""):
        import regex

        assert crf.words_of(text) == regex.findall(crf.WORD, text)
    for text in ("a", " ab, cd. ", "x " * 300 + "last" * 90 + "!", "only" * 90, "ab ab ab 1"):
        spans = crf._spans_of(text)
        assert crf._outer(text) == (spans[0][0], spans[-1][1])


def made(spark):
    r = np.random.default_rng(0)
    rows = [(i, " ".join(r.choice(WORDS[lang].split(), 30)), lang, "x", 0.0, "y") for i in range(120) for lang in ("aa", "zz")]
    return spark.createDataFrame(rows, SCHEMA)


def test_code_switched_text_and_odd_rows(spark):
    model = crf.fit(made(spark), fit_rows=60, steps=12)
    texts = ["ba bo bi bado xyl xor kyx wyk xxoz zyxa xyl", None, "", "123 ½ _ ...", "bolibo", "Xyl, XOR", "bolibo"]
    odd = spark.createDataFrame([(i, t, "aa", "k", 1.0, "s") for i, t in enumerate(texts)] + [(None, "xor xyl", None, "", 0.0, "")], SCHEMA)
    got = {r.key: r for r in crf.label(odd, model).collect()}
    assert [(s.start, s.end, s.lang) for s in got[0].spans] == [(0, 13, "aa"), (14, 43, "zz")]
    assert got[0].lang_pred == "zz" and abs(got[0].score - 7 / 11) < 0.1
    for i in (1, 2, 3):
        assert (got[i].lang_pred, got[i].score, got[i].n_words, got[i].spans) == ("und", 0.0, 0, [])
    assert [got[i].lang_pred for i in (4, 5, 6, None)] == ["aa", "zz", "aa", "zz"]
    assert crf.label(odd.limit(0), model).count() == 0


def test_pieces_do_not_change_results(spark, monkeypatch):
    model = crf.fit(made(spark), fit_rows=40, steps=6)
    docs = made(spark).repartition(1)
    plain = sorted(crf.label(docs, model).collect(), key=str)
    monkeypatch.setattr(crf, "PIECE_WORDS", 50)
    monkeypatch.setattr(crf, "REMEMBERED", 3)
    small = sorted(crf.label(docs, model).collect(), key=str)
    assert [(r.key, r.lang_pred, round(r.score, 9), r.spans) for r in plain] == [(r.key, r.lang_pred, round(r.score, 9), r.spans) for r in small]


def test_nothing_to_learn(spark):
    model = crf.fit(made(spark).withColumn("lang", F.lit(None).cast("string")))
    assert {(r.lang_pred, r.score) for r in crf.label(made(spark), model).collect()} == {("und", 0.0)}
    assert crf.fit(made(spark).limit(0)).labels == []
    alone = crf.fit(made(spark).where("lang = 'aa'"), steps=3)
    assert {(r.lang_pred, r.score) for r in crf.label(made(spark), alone).collect()} == {("aa", 1.0)}


def test_very_long_text(spark):
    model = crf.fit(made(spark), fit_rows=40, steps=8)
    got = crf.label(spark.createDataFrame([(1, "ba bo " * 100_000 + "xyl " * 50_000)], "doc_id long, text string"), model).first()
    assert got.lang_pred == "aa" and got.n_words == 250_000 and len(got.spans) == 2


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="the driver's tables are not here")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = crf.query(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null and lang_pred <> 'und'")
    hits, n = got.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count(F.lit(1))).first()
    assert hits / n > 0.97
