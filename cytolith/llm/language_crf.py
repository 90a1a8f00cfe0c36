"""Language of words in code-switched text: a linear-chain conditional random field.

Every word (a letter and the letters and marks behind it) has hashed features: itself, its
prefixes and suffixes of up to three characters, its n-grams of two and three characters,
and the lexicons that list it. Weights of features and of transitions between languages
are learned together from drawn documents with a language: their stretches are shuffled
and joined, so the chains that are learned from switch as code-switched text does.
Forward-backward gives each word its shares of the languages; a text's share of a language
is the mean over its words, the largest names the text.

All chains of a batch are one row of step matrices (a new chain forgets what was before
it), which is worked on in blocks at once: products of blocks, states between blocks, then
states within. Results are those of the plain recursion.

Null texts count as empty. Texts without a letter are ``und`` with score 0, and so is every
text where nothing could be learned. Repeated rows and null keys stay rows of their own;
a null key is held out. Ties go to the language that sorts first. Clashing columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytolith.llm.common import checkpointed, whole_text

WORD = r"\p{L}[\p{L}\p{M}]*"
UNKNOWN = "und"
FOLDS, HELD = 4, 2
BUCKETS = 1 << 15
#: The fit reads about so many documents of each language at most, and so many stretches, spread evenly, of each.
FIT_ROWS, FIT_STRETCHES, FIT_BLOCKS = 250, 32, 12
STRETCH_WORDS, CHAIN_STRETCHES = 24, 10
LEXICON_WORDS, DRAWS = 300, 10**15
STEPS, PENALTY = 24, 1e-5
MOST_LABELS = 200
#: Words that a task labels at a time (a longer text is one piece), and words whose scores it remembers.
PIECE_WORDS, REMEMBERED = 200_000, 300_000
#: Characters at the end of a text in which its last word is looked for first.
TAIL = 200
_LATIN = re.compile("[A-Za-zªµºÀ-ÖØ-öø-ÿ]+")


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # features x labels
    transitions: np.ndarray
    start: np.ndarray
    lexicon: dict[str, list[int]] = field(default_factory=dict)


def fold(key: Column) -> Column:
    """crc32 of the identifier as text, modulo the folds; a null identifier is held out."""
    return F.coalesce((F.crc32(key.cast("string").cast("binary")) % FOLDS).cast("int"), F.lit(HELD))


#: Seeds of the parts of a word: prefixes and suffixes of one to three characters, n-grams of two and three.
_PREFIXES, _SUFFIXES, _GRAMS = (11, 12, 13), (21, 22, 23), {2: 32, 3: 33}
_FACTORS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _hashed(seed: int, *characters: np.ndarray) -> np.ndarray:
    h = np.full(len(characters[0]), seed, np.uint64)
    for factor, c in zip(_FACTORS, characters, strict=False):
        h = (h ^ (c * factor)) * _FACTORS[0]
        h ^= h >> np.uint64(29)
    return (h % np.uint64(BUCKETS)).astype(np.int64)


def word_features(words: list[str], lexicon: dict[str, list[int]], n_labels: int) -> tuple[np.ndarray, np.ndarray]:
    """(columns, where each word's begin): hashed ones, then one for each lexicon that lists the word, then one that all words have.

    An n-gram that a word holds twice counts twice. All words are hashed at once, as an array of their characters.
    """
    n = len(words)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = [w.lower() for w in words]
    marked = [f"^{w}$" for w in low]
    sizes = np.array([len(w) for w in marked])
    text = np.frombuffer("".join(marked).encode("utf-32-le"), "<u4").astype(np.uint64)
    begins = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(n), sizes)
    found = [(np.arange(n), np.array([zlib.crc32(w.encode()) % BUCKETS for w in low]))]
    for k, seed in _GRAMS.items():
        at = np.flatnonzero(owner[: len(text) - k + 1] == owner[k - 1 :])
        found.append((owner[at], _hashed(seed, *[text[at + i] for i in range(k)])))
    for k in (1, 2, 3):
        long = np.flatnonzero(sizes >= k + 2)
        front, back = begins[long] + 1, begins[long] + sizes[long] - 1 - k
        found.append((long, _hashed(_PREFIXES[k - 1], *[text[front + i] for i in range(k)])))
        found.append((long, _hashed(_SUFFIXES[k - 1], *[text[back + i] for i in range(k)])))
    listed = [(i, BUCKETS + x) for i, w in enumerate(low) for x in lexicon.get(w, ())]
    if listed:
        found.append(tuple(np.array(x) for x in zip(*listed, strict=True)))
    found.append((np.arange(n), np.full(n, BUCKETS + n_labels)))
    of, columns = (np.concatenate(x) for x in zip(*found, strict=True))
    columns = columns[np.argsort(of, kind="stable")]
    counts = np.bincount(of, minlength=n)
    return columns, np.cumsum(counts) - counts


def type_scores(features: np.ndarray, starts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return np.add.reduceat(weights[features], starts, axis=0) if len(starts) else np.zeros((0, weights.shape[1]))


def forward_backward(scores: np.ndarray, first: np.ndarray, transitions: np.ndarray, start: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, float, np.ndarray]:
    """(shares of labels per word, log of the partition sum of all chains, expected transitions if ``pairs``)."""
    n, k = scores.shape
    if not n:
        return np.zeros((0, k)), 0.0, np.zeros((k, k))
    steps = max(1, int(np.sqrt(n)))
    blocks = -(-n // steps)
    top, high, top_start = scores.max(axis=1), transitions.max(), start.max()
    emit = np.ones((blocks * steps, k))
    emit[:n] = np.exp(scores - top[:, None])
    new = np.ones(blocks * steps, bool)
    new[:n] = first
    new[0] = True
    emit, new = emit.reshape(blocks, steps, k), new.reshape(blocks, steps)
    move, begin = np.exp(transitions - high), np.exp(start - top_start)

    products = np.broadcast_to(np.eye(k), (blocks, k, k)).copy()
    for t in range(steps):
        products = np.where(new[:, t, None, None], products.sum(axis=2, keepdims=True) * begin, products @ move) * emit[:, t, None, :]
        products /= products.sum(axis=(1, 2), keepdims=True)
    into, after = np.full((blocks, k), 1 / k), np.full((blocks, k), 1 / k)
    for b in range(1, blocks):
        state = into[b - 1] @ products[b - 1]
        into[b] = state / state.sum()
    for b in range(blocks - 2, -1, -1):
        state = products[b + 1] @ after[b + 1]
        after[b] = state / state.sum()

    alpha, total, state = np.empty_like(emit), np.empty((blocks, steps)), into
    for t in range(steps):
        state = np.where(new[:, t, None], begin, state @ move) * emit[:, t]
        total[:, t] = state.sum(axis=1)
        state = state / total[:, t, None]
        alpha[:, t] = state
    beta, state = np.empty_like(emit), after
    for t in range(steps - 1, -1, -1):
        beta[:, t] = state
        state = np.where(new[:, t, None], 1.0, (emit[:, t] * state) @ move.T)
        state = state / state.sum(axis=1, keepdims=True)
    alpha, beta, emit = alpha.reshape(-1, k)[:n], beta.reshape(-1, k)[:n], emit.reshape(-1, k)[:n]
    shares = alpha * beta
    shares /= shares.sum(axis=1, keepdims=True)
    inner = ~new.reshape(-1)[:n]
    log_sum = float(np.log(total.reshape(-1)[:n]).sum() + top.sum() + inner.sum() * high + (~inner).sum() * top_start)
    expected = np.zeros((k, k))
    if pairs and inner.any():
        at = np.flatnonzero(inner)
        joint = alpha[at - 1][:, :, None] * move * (emit[at] * beta[at])[:, None, :]
        expected = (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    return shares, log_sum, expected


# learning


def _drawn(docs: DataFrame, key: str, text: str, lang: str, fit_rows: int) -> tuple[DataFrame, list[str]]:
    """Labelled rows outside the held-out fold, about ``fit_rows`` of each language at most, by a hash of the key."""
    usable = docs.where(F.col(lang).isNotNull() & (fold(F.col(key)) != HELD)).select(F.col(key).cast("string").alias("key"), F.col(lang).alias("lang"), whole_text(text).alias("text"))
    sizes = {r[0]: r[1] for r in usable.groupBy("lang").count().orderBy("lang").limit(MOST_LABELS + 1).collect()}
    if len(sizes) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} languages")
    if not sizes:
        return usable.limit(0), []
    parts = F.create_map(*[F.lit(x) for name, n in sizes.items() for x in (name, int(DRAWS * min(1.0, 0.95 * fit_rows / n)))])
    return usable.where(F.pmod(F.xxhash64("key", F.lit(23)), F.lit(DRAWS)) < F.element_at(parts, F.col("lang"))), sorted(sizes)


def _lexicon(drawn: DataFrame, labels: list[str], size: int) -> dict[str, list[int]]:
    """The commonest words of each language in the drawn rows, with the numbers of the languages that list them."""
    from pyspark.sql import Window

    def count(frames: Iterator) -> Iterator:
        from collections import Counter

        import pandas as pd
        import regex

        for frame in frames:
            seen = Counter()
            for lang, text in zip(frame["lang"], frame["text"], strict=True):
                seen.update((lang, x.lower()) for x in regex.findall(WORD, text))
            yield pd.DataFrame([(*k, n) for k, n in seen.items()], columns=["lang", "word", "n"])

    counts = drawn.select("lang", "text").mapInPandas(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    out: dict[str, list[int]] = {}
    for lang, word in counts.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= size).select("lang", "word").orderBy("lang", "word").collect():
        out.setdefault(word, []).append(labels.index(lang))
    return out


def _blocks(drawn: DataFrame, labels: list[str], lexicon: dict[str, list[int]]) -> DataFrame:
    """Rows of (block, words, gold, first, features, starts): shuffled stretches, as chains of word types."""
    number = {x: i for i, x in enumerate(labels)}

    def build(frame):
        import pandas as pd
        import regex

        frame = frame.sort_values(["key", "text"])
        stretches = []
        for lang, text in zip(frame["lang"], frame["text"], strict=True):
            words = regex.findall(WORD, text)
            cut = [words[i : i + STRETCH_WORDS] for i in range(0, len(words), STRETCH_WORDS)]
            stretches += [(number[lang], cut[i]) for i in np.unique(np.linspace(0, len(cut) - 1, min(len(cut), FIT_STRETCHES)).astype(int))] if cut else []
        order = np.random.default_rng(int(frame["block"].iloc[0])).permutation(len(stretches))
        types = _Numbers()
        words, gold, first = [], [], []
        for nth, i in enumerate(order):
            label, chain = stretches[i]
            for j, word in enumerate(chain):
                words.append(types[word])
                gold.append(label)
                first.append(j == 0 and nth % CHAIN_STRETCHES == 0)
        features, starts = word_features(list(types), lexicon, len(labels))
        return pd.DataFrame({"block": [int(frame["block"].iloc[0])], "words": [words], "gold": [gold], "first": [first], "features": [features], "starts": [starts]})

    parted = drawn.withColumn("block", F.pmod(F.xxhash64("key", F.lit(29)), F.lit(FIT_BLOCKS)).cast("int")).repartition(FIT_BLOCKS, "block")
    return parted.groupBy("block").applyInPandas(build, "block int, words array<int>, gold array<int>, first array<boolean>, features array<int>, starts array<int>")


def _cut(theta: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows = BUCKETS + k + 1
    return theta[: rows * k].reshape(rows, k), theta[rows * k : (rows + k) * k].reshape(k, k), theta[(rows + k) * k :]


def block_loss(theta: np.ndarray, k: int, words, gold, first, features, starts) -> tuple[float, np.ndarray]:
    """Negative log likelihood of the gold labels of a block, and its gradient."""
    weights, transitions, start = _cut(theta, k)
    words, gold, first, features, starts = (np.asarray(x) for x in (words, gold, first, features, starts))
    first = first.astype(bool)
    first[:1] = True
    scores = type_scores(features, starts, weights)[words]
    shares, log_sum, expected = forward_backward(scores, first, transitions, start, pairs=True)
    inner = np.flatnonzero(~first)
    reached = scores[np.arange(len(gold)), gold].sum() + transitions[gold[inner - 1], gold[inner]].sum() + start[gold[first]].sum()
    errors = shares.copy()
    errors[np.arange(len(gold)), gold] -= 1
    by_type = np.stack([np.bincount(words, errors[:, j], len(starts)) for j in range(k)], axis=1)
    owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(features))))
    slope = np.stack([np.bincount(features, by_type[owner, j], len(weights)) for j in range(k)], axis=1)
    seen = np.zeros((k, k))
    np.add.at(seen, (gold[inner - 1], gold[inner]), 1)
    return log_sum - reached, np.concatenate([slope.ravel(), (expected - seen).ravel(), errors[first].sum(axis=0)])


def _minimise(loss, theta: np.ndarray, steps: int, memory: int = 6) -> np.ndarray:
    """Limited-memory quasi-Newton steps, each halved until the loss falls; ``steps`` bounds the evaluations."""
    value, slope = loss(theta)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    scale, used = 1.0 / max(1e-12, np.abs(slope).max()), 1
    while used < steps:
        way, kept = slope.copy(), []
        for s, y in reversed(past):
            a = (s @ way) / (s @ y)
            way -= a * y
            kept.append(a)
        way *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else scale
        for (s, y), a in zip(past, reversed(kept), strict=True):
            way += (a - (y @ way) / (s @ y)) * s
        length, moved = 1.0, False
        while used < steps and not moved:
            there = theta - length * way
            new, new_slope = loss(there)
            used, moved = used + 1, new < value
            length /= 2
        if not moved:
            break
        s, y = there - theta, new_slope - slope
        if s @ y > 1e-12:
            past = [*past, (s, y)][-memory:]
        gain, theta, value, slope = value - new, there, new, new_slope
        if gain < 1e-6 * max(1.0, abs(value)):
            break
    return theta


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", fit_rows: int = FIT_ROWS, steps: int = STEPS, lexicon_words: int = LEXICON_WORDS) -> Model:
    """A model of the languages in ``lang``, learned outside the held-out fold from about ``fit_rows`` rows of each at most."""
    drawn, labels = _drawn(docs, key, text, lang, fit_rows)
    k = len(labels)
    if not k:
        return Model([], np.zeros((BUCKETS + 1, 0)), np.zeros((0, 0)), np.zeros(0))
    drawn = checkpointed(drawn)
    lexicon = _lexicon(drawn, labels, lexicon_words)
    blocks = checkpointed(_blocks(drawn, labels, lexicon).repartition(FIT_BLOCKS, "block"))
    n = max(1, blocks.agg(F.sum(F.size("words"))).first()[0] or 0)

    def loss(theta: np.ndarray) -> tuple[float, np.ndarray]:
        def work(frames: Iterator) -> Iterator:
            import pandas as pd

            for frame in frames:
                for row in frame.itertuples():
                    value, slope = block_loss(theta, k, row.words, row.gold, row.first, row.features, row.starts)
                    yield pd.DataFrame({"block": [row.block], "value": [value], "slope": [slope.astype(np.float32).tobytes()]})

        found = sorted(blocks.where(F.size("words") > 0).mapInPandas(work, "block int, value double, slope binary").collect())
        value = sum(r.value for r in found) / n + PENALTY / 2 * float(theta @ theta)
        return value, sum((np.frombuffer(r.slope, np.float32).astype(float) for r in found), np.zeros(len(theta))) / n + PENALTY * theta

    theta = _minimise(loss, np.zeros((BUCKETS + k + 1 + k + 1) * k), steps)
    return Model(labels, *_cut(theta, k), lexicon)


# labelling


class _Numbers(dict):
    """Words by number, in the order in which they were first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class _Scores:
    """Scores of word types, made once and remembered."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.numbers = _Numbers()
        self.known = np.zeros((0, len(self.model.labels)))

    def table(self) -> np.ndarray:
        new = list(islice(self.numbers, len(self.known), None))
        if new:
            found = type_scores(*word_features(new, self.model.lexicon, len(self.model.labels)), self.model.weights)
            self.known = np.concatenate([self.known, found])
        return self.known


def words_of(text: str) -> list[str]:
    """The words of a text; those of western Europe by their letters, which is faster and gives the same."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        import regex

        return regex.findall(WORD, text)
    return _LATIN.findall(text)


def _spans_of(text: str) -> list[tuple[int, int]]:
    import regex

    return [x.span() for x in regex.finditer(WORD, text)]


def _runs(best: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes of words that begin a run of one language within their text."""
    new = np.zeros(len(best), bool)
    new[1:] = best[1:] != best[:-1]
    new[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
    return np.flatnonzero(new)


def _bounds(text: str, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs that begin at these words start and end in the text."""
    spans = np.array(_spans_of(text), np.int64) if len(runs) > 1 else np.array([_outer(text)], np.int64)
    stops = np.append(runs[1:], len(spans)) - 1
    return spans[runs, 0], spans[stops, 1]


def _outer(text: str) -> tuple[int, int]:
    """From the first character of the first word to the last one of the last word; there is one."""
    import regex

    start = regex.search(WORD, text).start()
    last = words_of(text[max(start, len(text) - TAIL) :])
    if len(last) < 2:  # the last word may begin before the tail
        return start, _spans_of(text)[-1][1]
    return start, text.rindex(last[-1]) + len(last[-1])


def label(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score, n_words, spans) per row: spans are runs of words of one language, by code points, end exclusive."""
    kind = docs.schema[key].dataType.simpleString()

    def work(batches: Iterator) -> Iterator:
        from array import array

        import pyarrow as pa

        scores, names = _Scores(model), np.array([*model.labels, UNKNOWN])
        for batch in batches:
            done = 0
            while done < len(batch):
                types, lengths, texts = array("q"), [], []
                while done + len(lengths) < len(batch) and len(types) < PIECE_WORDS:
                    texts.append(batch.column(1)[done + len(lengths)].as_py() if model.labels else "")
                    before = len(types)
                    types.extend(map(scores.numbers.__getitem__, words_of(texts[-1])))
                    lengths.append(len(types) - before)
                keys, lengths = batch.column(0).slice(done, len(lengths)), np.array(lengths)
                done += len(lengths)
                edges = np.concatenate([[0], np.cumsum(lengths)])
                first = np.zeros(len(types), bool)
                first[edges[:-1][lengths > 0]] = True
                shares, _, _ = forward_backward(scores.table()[np.array(types, np.int64)], first, model.transitions, model.start)
                found, score = np.full(len(lengths), len(model.labels)), np.zeros(len(lengths))
                if len(types):
                    mean = np.add.reduceat(shares, edges[:-1][lengths > 0], axis=0) / lengths[lengths > 0, None]
                    found[lengths > 0], score[lengths > 0] = mean.argmax(axis=1), np.minimum(mean.max(axis=1), 1.0)
                best = shares.argmax(axis=1) if len(types) else np.zeros(0, np.int64)
                begins = _runs(best, lengths)
                at = np.searchsorted(begins, edges)
                starts, ends = np.zeros(len(begins), np.int64), np.zeros(len(begins), np.int64)
                for i in np.flatnonzero(lengths):
                    runs = begins[at[i] : at[i + 1]] - edges[i]
                    starts[at[i] : at[i + 1]], ends[at[i] : at[i + 1]] = _bounds(texts[i], runs)
                fields = [pa.array(starts), pa.array(ends), pa.array(names[best[begins]].tolist(), pa.string())]
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.StructArray.from_arrays(fields, ["start", "end", "lang"]))
                yield pa.RecordBatch.from_arrays(
                    [keys, pa.array(names[found].tolist(), pa.string()), pa.array(score), pa.array(lengths.astype(np.int64)), lists], ["key", "lang_pred", "score", "n_words", "spans"]
                )
                if len(scores.numbers) > REMEMBERED:
                    scores.forget()

    rows = docs.select(F.col(key).alias("key"), whole_text(text).alias("text"))
    return rows.mapInArrow(work, f"key {kind}, lang_pred string, score double, n_words long, spans array<struct<start: long, end: long, lang: string>>")


def query(spark, sf_dir: str) -> DataFrame:
    from cytolith.llm.common import read_table

    docs = read_table(spark, sf_dir, "documents")
    labelled = label(docs, fit(docs)).withColumnRenamed("key", "doc_id")
    return labelled.select("doc_id", (fold(F.col("doc_id")) == HELD).alias("held_out"), "lang_pred", "score", "n_words", F.size("spans").cast("long").alias("n_spans"))
