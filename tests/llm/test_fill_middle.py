"""Fill-in-middle by frames against slices of whole texts."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
import zstandard

from cytolith.llm import fill_middle as fim

SCHEMA = "doc_id long, text string, frames string, form string, key string"
TEXTS = [
    "one\ntwo\nthree\n", "one line", "a\n\nb\n\n\nç é\n漢字 𝄞", "\n", "", None, "has <P> inside\nx\n", "<", "<S\n<\n>S>\nM>\n", "x" * 300 + "\n" + "é" * 200,
    "\n".join("line %d ünd" % i for i in range(200)), "a\r\nb c\n", "one\ntwo\nthree\n",
]


def brute(doc_id, text, seed=7, percent=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "plain" if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent else "spm" if h[3] % 100 < spm else "psm"
    out = {"plain": text, "psm": f"<P>{prefix}<S>{suffix}<M>{middle}", "spm": f"<S>{suffix}<P>{prefix}<M>{middle}"}[form]
    sizes = (None, None) if form == "plain" else (len(prefix), len(middle))
    return (doc_id, len(units), form, *sizes, hashlib.sha256(out.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()), out


def rows(spark, texts):
    listed = [(i, t, "x", "y", "z") for i, t in enumerate(texts)] + [(None, "lost\nkey\n", "", "", ""), (3, "\n", "", "", "")]
    return listed, spark.createDataFrame(listed, SCHEMA).repartition(3)


@pytest.mark.parametrize("size", [1, 7, 64, fim.FRAME_BYTES])
def test_frames_of_any_size_give_the_same_rows(spark, size):
    listed, df = rows(spark, TEXTS)
    got = fim.digests(fim.fill_middle(fim.store(df, frame_bytes=size)))
    assert sorted(map(tuple, got.collect()), key=str) == sorted((brute(i, t)[0] for i, t, *_ in listed), key=str)


def test_outputs_are_streams(spark):
    r = random.Random(1)
    texts = ["".join(r.choice("ab é\n") for _ in range(r.randrange(400))) for _ in range(60)]
    listed, df = rows(spark, texts)
    want = {i: brute(i, t, 5, 60, 30)[1] for i, t, *_ in listed if i is not None and i != 3}
    out = fim.fill_middle(fim.store(df, frame_bytes=50), 5, 60, 30).where("key <> 3").collect()
    assert {r.form for r in out} == {"plain", "psm", "spm"}
    for r in out:
        joined = zstandard.ZstdDecompressor().decompressobj(read_across_frames=True).decompress(b"".join(r.output)).decode() if r.output else ""
        assert joined == want[r.key]
        assert b"".join(fim.restored(r.output, r.form)).decode() == listed[r.key][1]


def test_only_cut_frames_are_compressed_again(spark):
    text = "".join(f"{i:015d}\n" for i in range(4000))
    stored = fim.store(spark.createDataFrame([(1, text)], "doc_id long, text string"), frame_bytes=1000).first()
    out = fim.fill_middle(spark.createDataFrame([stored], fim.store(spark.createDataFrame([], "doc_id long, text string")).schema)).first()
    assert len(stored.frames) == 64
    kept = {f.data for f in stored.frames} & set(out.output)
    assert len(kept) >= 62


def test_empty_table_and_bad_size(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert fim.digests(fim.fill_middle(fim.store(none))).count() == 0
    with pytest.raises(ValueError):
        fim.store(none, frame_bytes=0)


def test_very_long_text(spark):
    text = "word " * 400_000 + "\n" + "línea\n" * 300_000
    got = fim.digests(fim.fill_middle(fim.store(spark.createDataFrame([(9, text)], "doc_id long, text string")))).first()
    assert tuple(got) == brute(9, text)[0]
