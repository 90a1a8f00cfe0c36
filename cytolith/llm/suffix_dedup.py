"""Removal of repeated byte strings by column-wise construction of multi-document suffix arrays.

A byte goes if a string of ``SPAN`` bytes over it also starts in a document with a smaller
doc_id. One suffix order over a whole corpus would need as many rounds as its longest
document has bytes, so the collection is dealt out first, such that equal strings meet:

1. Tasks pack rows into chunks of bounded size, which are written once, compressed. A row
   is named by its chunk and its place there, so rows may share a doc_id.
2. Every string of SPAN bytes has an anchor, its least-hashed gram of ``GRAM`` bytes;
   neighbouring strings with one anchor form a segment. Each chunk sends the distinct
   hashes of its anchors to buckets, which answer with a code per anchor: of one document
   only, shared, or common (very many segments have it).
3. Chunks send each distinct segment with a shared anchor once, as a text of at most 76
   bytes, with the smallest doc_id that has it there. Segments of common anchors are sent
   as single strings of SPAN bytes, each to the bucket of its own hash, so that no anchor
   fills a bucket. Anchors only choose where strings meet, not what is equal.
4. In a bucket the texts are the documents of a collection whose suffix order is built
   column by column: each round inserts one symbol of every document, updating the
   Burrows-Wheeler transform of the collection, which passes from round to round through
   files that are read and written in sequence, block by block.
   Runs with common prefixes of SPAN bytes or more are equal strings; their smallest
   doc_id goes back to the chunks, which remove what starts in a smaller document.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytolith.llm.common import checkpointed, stored, whole_text

SPAN, GRAM = 50, 24
WINDOW = SPAN - GRAM + 1
SIDE = (SPAN - GRAM) // 2
#: Bytes of text per chunk (a longer text is a chunk of its own), per step inside a task, and per bucket of anchors.
CHUNK_BYTES, STEP_BYTES, BUCKET_BYTES = 4 << 20, 1 << 17, 16 << 20
#: Texts that are put in order together, about; whole anchors at a time. An anchor with more segments counts as common.
GROUP = 20_000
#: Entries of the transform file per block.
BLOCK = 1 << 18
BASE = 0x9E3779B97F4A7C15 | 1
ALONE, SHARED, COMMON = 0, 1, 2


def _power(n: int) -> int:
    return pow(BASE, n, 1 << 64)


def segments(data, starts, ends):
    """Segments of texts that lie at [starts, ends) of a byte array: arrays (first, count, anchor, key).

    first is where the first string of a segment starts, count the number of its strings,
    anchor the place of their gram from there on, key the gram's hash.
    """
    import numpy as np

    n = len(data)
    none = np.array([], np.int64)
    if n < SPAN:
        return none, none, none, none.astype(np.uint64)
    h1 = data.astype(np.uint64) + np.uint64(1)

    def joined(a, size, b, added):
        """Hashes of strings of ``size`` bytes, grown by the ``added`` bytes that follow."""
        n_both = len(b) - size
        return a[:n_both] * np.uint64(_power(added)) + b[size:]

    h2 = joined(h1, 1, h1, 1)
    h4 = joined(h2, 2, h2, 2)
    h8 = joined(h4, 4, h4, 4)
    h16 = joined(h8, 8, h8, 8)
    gram = joined(h16, 16, h8, 8)
    gram ^= gram >> np.uint64(31)
    gram *= np.uint64(0xBF58476D1CE4E5B9)
    gram ^= gram >> np.uint64(29)
    low = np.uint64((1 << 24) - 1)
    least = (gram & ~low) | np.arange(len(gram), dtype=np.uint64)
    for step in (1, 2, 4, 8, WINDOW - 16):
        least = np.minimum(least[:-step], least[step:])
    place = (least & low).astype(np.int64)
    valid = np.zeros(len(place) + 1, np.int32)
    long = ends - starts >= SPAN
    np.add.at(valid, starts[long], 1)
    np.add.at(valid, ends[long] - SPAN + 1, -1)
    valid = np.cumsum(valid[:-1]) > 0
    opens = valid.copy()
    opens[1:] &= (place[1:] != place[:-1]) | ~valid[:-1]
    closes = valid.copy()
    closes[:-1] &= (place[1:] != place[:-1]) | ~valid[1:]
    first = np.flatnonzero(opens)
    return first, np.flatnonzero(closes) - first + 1, place[first] - first, gram[place[first]]


def packed(*arrays) -> bytes:
    """Arrays in one compressed blob; planes of bytes are kept together."""
    import numpy as np
    import zstandard

    planes = [x if x.dtype == np.uint8 else np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.reshape(-1) for x in arrays]
    head = np.array([len(p) for p in planes], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(p.tobytes() for p in planes))


def unpacked(blob: bytes, *kinds: str) -> list:
    """The arrays of a blob, by their kinds."""
    import numpy as np
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    out, at = [], 8 * len(kinds)
    for kind, n in zip(kinds, np.frombuffer(raw, "<i8", len(kinds)).tolist(), strict=True):
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n, at).reshape(width, n // width).T).view(kind).reshape(-1))
        at += n
    return out


#: Kinds of the blobs: chunks (doc_id, length, bytes), anchors (hash, segments up to 65,535, several documents),
#: texts (hash, doc_id, several documents, place of the anchor or SPAN, length, bytes), marks (text, first string, strings, doc_id).
CHUNK, ANCHORS, TEXTS, MARKS = ("<i8", "<i8", "u1"), ("<u4", "<u2", "u1"), ("<u4", "<i8", "u1", "u1", "u1", "u1"), ("<u4", "u1", "u1", "<i8")


def _pack_chunks(chunk_bytes: int):
    """Rows (doc_id, text) to chunks (chunk, n_bytes, blob), as they come; nothing is shuffled."""

    def work(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        docs, texts, size, number = [], [], 0, TaskContext.get().partitionId() << 32

        def flush():
            nonlocal docs, texts, size, number
            blob = packed(np.array(docs, "<i8"), np.array([len(t) for t in texts], "<i8"), np.frombuffer(b"".join(texts), np.uint8))
            row = pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([size], pa.int64()), pa.array([blob], pa.binary())], ["chunk", "n_bytes", "blob"])
            docs, texts, size, number = [], [], 0, number + 1
            return row

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = text.as_py()
                if docs and size + len(raw) > chunk_bytes:
                    yield flush()
                docs.append(doc)
                texts.append(raw)
                size += len(raw)
        if docs:
            yield flush()

    return work


class Chunk:
    """The rows of a chunk and its segments; ``names`` are the distinct anchors in order of bucket and hash."""

    def __init__(self, blob: bytes, buckets: int, step_bytes: int) -> None:
        import numpy as np

        self.docs, lengths, self.data = unpacked(blob, *CHUNK)
        self.offsets = np.concatenate([[0], np.cumsum(lengths)])
        parts, row, offsets = [], 0, self.offsets
        while row < len(self.docs):
            # a step of whole texts, or pieces of one that is longer than a step
            last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + step_bytes, side="right")) - 1)
            base, stop, alone = int(offsets[row]), int(offsets[last]), last == row + 1
            for begin in range(base, stop, step_bytes) if alone else [base]:
                end = min(stop, begin + step_bytes + SPAN - 1) if alone else stop
                starts, ends = (np.array([0]), np.array([end - begin])) if alone else (offsets[row:last] - begin, offsets[row + 1 : last + 1] - begin)
                first, *rest = segments(self.data[begin:end], starts, ends)
                parts.append((first + begin, *rest))
            row = last
        empty = np.array([], np.int64)
        self.first, self.count, self.anchor, key = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (empty, empty, empty, empty.astype(np.uint64))
        self.row = np.repeat(np.arange(len(self.docs)), np.diff(np.searchsorted(self.first, offsets)))
        self.buckets = buckets
        bucket = (key >> np.uint64(32)) % np.uint64(buckets)
        self.names, self.name = np.unique((bucket << np.uint64(32)) | (key & np.uint64(0xFFFFFFFF)), return_inverse=True)

    def anchors(self) -> tuple:
        """Segments and whether there are several documents, for each name."""
        import numpy as np

        n = np.bincount(self.name, minlength=len(self.names))
        order = np.argsort(self.name, kind="stable")
        docs, heads = self.docs[self.row[order]], np.concatenate([[0], np.cumsum(n)[:-1]])
        several = np.minimum.reduceat(docs, heads) < np.maximum.reduceat(docs, heads) if len(n) else np.array([], bool)
        return n, several

    def texts(self, codes) -> tuple:
        """Distinct texts to compare, and where they stand: (bucket, hash, anchor, text), (text of each occurrence, its start, its row).

        Segments of shared anchors are texts; those of common ones are cut into single strings.
        """
        import numpy as np
        import xxhash

        code = codes[self.name]
        whole, cut = np.flatnonzero(code == SHARED), np.flatnonzero(code == COMMON)
        singles = np.repeat(self.first[cut], self.count[cut]) + (np.arange(int(self.count[cut].sum())) - np.repeat(np.cumsum(self.count[cut]) - self.count[cut], self.count[cut]))
        start, row = np.concatenate([self.first[whole], singles]), np.concatenate([self.row[whole], np.repeat(self.row[cut], self.count[cut])])
        end = np.concatenate([self.first[whole] + self.count[whole] + SPAN - 1, singles + SPAN])
        raw, known = self.data.tobytes(), {}
        text = np.array([known.setdefault(raw[a:b], len(known)) for a, b in zip(start.tolist(), end.tolist(), strict=True)], np.int64)
        found = list(known)
        bucket, name, anchor = np.zeros(len(found), np.int64), np.zeros(len(found), np.uint32), np.full(len(found), SPAN, np.uint8)
        anchor[text[: len(whole)]] = self.anchor[whole]
        names = self.names[self.name[whole]]
        bucket[text[: len(whole)]], name[text[: len(whole)]] = (names >> np.uint64(32)).astype(np.int64), (names & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        for i in np.unique(text[len(whole) :]).tolist():
            h = xxhash.xxh3_64_intdigest(found[i], 1)
            bucket[i], name[i] = (h >> 32) % self.buckets, h & 0xFFFFFFFF
        return (bucket, name, anchor, found), (text, start, row)


def _by(values) -> Iterator:
    """(value, places) for each distinct value."""
    import numpy as np

    order = np.argsort(values, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(values[order])) + 1) if len(order) else []:
        yield int(values[rows[0]]), rows


def _send_anchors(buckets: int, step_bytes: int):
    def work(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for number, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                chunk = Chunk(blob.as_py(), buckets, step_bytes)
                n, several = chunk.anchors()
                n, several = np.minimum(n, 65535).astype("<u2"), several.astype(np.uint8)
                rows = [(b, packed((chunk.names[r] & np.uint64(0xFFFFFFFF)).astype("<u4"), n[r], several[r])) for b, r in _by((chunk.names >> np.uint64(32)).astype(np.int64))]
                for i in range(0, len(rows), 256):
                    b, x = zip(*rows[i : i + 256], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array([number] * len(b), pa.int64()), pa.array(x, pa.binary())], ["bucket", "chunk", "blob"])

    return work


def _judge_anchors(common: int):
    """In a bucket: a code for each anchor that a chunk has sent, in the order in which it did."""

    def work(frame):
        import numpy as np
        import pandas as pd

        parts = [unpacked(blob, *ANCHORS) for blob in frame["blob"]]
        names, name = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        segments = np.bincount(name, weights=np.concatenate([p[1] for p in parts]), minlength=len(names))
        shared = (np.bincount(name, minlength=len(names)) > 1) | (np.bincount(name, weights=np.concatenate([p[2] for p in parts]), minlength=len(names)) > 0)
        code = np.where(shared, np.where(segments > common, COMMON, SHARED), ALONE).astype(np.uint8)[name]
        codes = np.split(code, np.cumsum([len(p[0]) for p in parts])[:-1])
        return pd.DataFrame({"chunk": frame["chunk"].to_numpy(), "bucket": frame["bucket"].to_numpy(), "codes": [packed(c) for c in codes]})

    return work


def _codes(frame):
    """The codes of a chunk's anchors, bucket by bucket."""
    import numpy as np

    codes = frame[frame["codes"].notna()].sort_values("bucket")["codes"]
    return np.concatenate([unpacked(x, "u1")[0] for x in codes]) if len(codes) else np.array([], np.uint8)


def _send_texts(buckets: int, step_bytes: int):
    """Each distinct text of a chunk that may also be elsewhere, to its bucket."""

    def work(left, right):
        import numpy as np
        import pandas as pd

        out: dict = {"bucket": [], "chunk": [], "blob": []}
        for number, blob in zip(left["chunk"].tolist(), left["blob"], strict=True):
            chunk = Chunk(blob, buckets, step_bytes)
            (bucket, name, anchor, texts), (text, _, row) = chunk.texts(_codes(right))
            least, most = np.full(len(texts), np.iinfo(np.int64).max), np.full(len(texts), np.iinfo(np.int64).min)
            np.minimum.at(least, text, chunk.docs[row])
            np.maximum.at(most, text, chunk.docs[row])
            several, lengths = (least < most).astype(np.uint8), np.array([len(t) for t in texts], np.uint8)
            for b, r in _by(bucket):
                own = np.frombuffer(b"".join([texts[i] for i in r.tolist()]), np.uint8)
                out["bucket"].append(b)
                out["chunk"].append(number)
                out["blob"].append(packed(name[r], least[r], several[r], anchor[r], lengths[r], own))
        return pd.DataFrame(out).astype({"bucket": "int32", "chunk": "int64"})

    return work


def _blocks(transform_file: str, block: int) -> Iterator:
    """(start, transform) of the file, in sequence."""
    import numpy as np

    with open(transform_file, "rb") as t:
        start = 0
        while raw := t.read(block):
            yield start, np.frombuffer(raw, np.uint8)
            start += len(raw)


def _ranks(blocks: Iterator, place, symbols):
    """For places in order and the symbols there: how many equal symbols come before. One pass; between blocks only counts are kept."""
    import numpy as np

    rank, seen = np.zeros(len(place), np.int64), np.zeros(256, np.int64)
    for start, transform in blocks:
        lo, hi = np.searchsorted(place, (start, start + len(transform)))
        counts = np.bincount(transform, minlength=256)
        if hi > lo:
            asked = np.zeros(len(transform), bool)
            asked[place[lo:hi] - start] = True
            by = np.argsort(symbols[lo:hi], kind="stable") + lo
            rank[by] = (seen - np.cumsum(counts) + counts)[symbols[by]] + np.flatnonzero(asked[np.argsort(transform, kind="stable")])
        seen += counts
    return rank


def _common_prefixes(cells, owner, offset):
    """Symbols that each suffix shares with the one before it, 255 at most; ends equal nothing."""
    import numpy as np

    rounds, m = len(cells) - 1, cells.shape[1]
    prefix, cells = np.zeros(len(owner), np.uint8), cells.ravel()
    at = (rounds - 1 - offset.astype(np.int64)) * m + owner
    which, a, b = np.arange(1, len(owner)), at[:-1], at[1:]
    for _ in range(min(rounds, 255)):
        same = (cells[a] == cells[b]) & (cells[a] > 0)
        which, a, b = which[same], a[same] - m, b[same] - m
        prefix[which] += 1
    return prefix


def column_wise_order(texts: list[bytes], folder: str, block: int = BLOCK):
    """(document, offset, common prefix) of all suffixes of a collection, in order.

    Every round inserts one suffix of each document, the next longer one. All documents end
    with the last round, so shorter ones enter later, and no round passes over symbols
    of documents that were done long before. The place of a suffix that a symbol precedes
    follows from the number of smaller symbols, and of equal ones before it, in the
    transform. Ends of documents are smaller than all symbols and differ by document. The
    transform is a file in ``folder``; each round reads that of the round before in
    sequence, block by block, and writes its own. Documents and offsets are read off at
    the end, by walking the transform from the ends; common prefixes by comparing each
    suffix with the one before it.
    """
    import os

    import numpy as np

    m = len(texts)
    lengths = np.array([len(t) for t in texts], np.int64)
    rounds = int(lengths.max()) if m else 0
    if 255 in b"".join(texts):
        raise ValueError("the byte 255 is no part of a text")
    cells = np.zeros((m, rounds + 1), np.uint8)  # symbols from the end, 0 before the start and until a document enters
    for i, t in enumerate(texts):
        cells[i, rounds - len(t) : rounds] = np.frombuffer(t, np.uint8)[::-1] + 1
    cells = np.ascontiguousarray(cells.T)
    transform_file = f"{folder}/transform-0"
    cells[0].tofile(transform_file)
    counts = np.bincount(cells[0], minlength=256)
    place, active, total = np.empty(0, np.int64), np.empty(0, np.int64), m
    for j in range(1, rounds + 1):
        entering = np.flatnonzero(lengths == rounds - j + 1)  # the last symbols of these come before their ends, which are the first rows
        if j > 1 and len(entering):
            with open(transform_file, "r+b") as t:
                ends = np.frombuffer(t.read(m), np.uint8).copy()
                ends[entering] = cells[j - 1][entering]
                t.seek(0)
                t.write(ends.tobytes())
            counts += np.bincount(cells[j - 1][entering], minlength=256)
            counts[0] -= len(entering)
        active, place = np.concatenate([entering, active]), np.concatenate([entering, place])
        symbols = cells[j - 1][active]
        rank = _ranks(_blocks(transform_file, block), place, symbols)
        starts = np.concatenate([[0], np.cumsum(counts)])
        # ends precede nothing; the m empty suffixes come first. Places are in order within a symbol
        by = np.argsort(symbols, kind="stable")
        place, active = (m + starts[symbols] - starts[1] + rank)[by], active[by]
        before = place - np.arange(len(by))  # rows of the files that come before an inserted one
        new_symbols = cells[j][active]
        grown = f"{folder}/transform-{j}"
        with open(grown, "wb") as t:
            for start, transform in _blocks(transform_file, block):
                stop = start + len(transform)
                lo, hi = np.searchsorted(before, (start, stop if stop < total else stop + 1))
                rows, both = before[lo:hi] - start + np.arange(hi - lo), np.empty(len(transform) + hi - lo, np.uint8)
                there = np.ones(len(both), bool)
                there[rows] = False
                both[rows], both[there] = new_symbols[lo:hi], transform
                t.write(both)
        os.unlink(transform_file)
        transform_file = grown
        counts += np.bincount(new_symbols, minlength=256)
        total += len(by)
    transform = np.fromfile(transform_file, np.uint8)
    order = np.argsort(transform, kind="stable")
    to = np.empty(len(order), np.int32)
    to[order] = np.arange(len(order), dtype=np.int32) + m - int((transform == 0).sum())
    owner, offset = np.empty(len(order), np.int32), np.empty(len(order), np.int32)
    place, active = np.arange(m), np.arange(m)
    for j in range(rounds + 1):
        owner[place], offset[place] = active, lengths[active] - j
        going = lengths[active] > j
        active, place = active[going], to[place[going]]
    return owner, offset, _common_prefixes(cells, owner, offset)


def least_documents(texts: list[bytes], docs):
    """(text, first string, strings, doc_id): the smallest document of each string of SPAN bytes of distinct texts.

    ``docs`` has the smallest document of each text. Strings that follow each other and
    have the same smallest document are one row. The files of the order are scratch of
    the task, on the executor's own disk, and end with the call.
    """
    import tempfile

    import numpy as np

    with tempfile.TemporaryDirectory(prefix="cytolith-suffixes-") as folder:
        owner, offset, prefix = column_wise_order(texts, folder)
    full = np.array([len(t) for t in texts], np.int64)[owner] - offset >= SPAN
    run = np.cumsum(prefix < SPAN)
    owner, offset, run = owner[full], offset[full], run[full]
    heads = np.flatnonzero(np.diff(run, prepend=-1))
    least = np.minimum.reduceat(docs[owner], heads)[np.cumsum(np.diff(run, prepend=-1) != 0) - 1]
    order = np.lexsort((offset, owner))
    owner, offset, least = owner[order], offset[order], least[order]
    opens = np.flatnonzero((np.diff(owner, prepend=-1) != 0) | (np.diff(least, prepend=-1) != 0))
    return owner[opens], offset[opens], np.diff(opens, append=len(owner)), least[opens]


def _may_overlap(texts: list[bytes], places: list[int]) -> list[int]:
    """Texts that share their anchor and SIDE bytes before or after it with another one.

    A string of SPAN bytes reaches at least that far to one side of its anchor, so all
    others have no string in common. Single strings, with SPAN for a place, overlap nothing else.
    """
    met: dict = {}
    for i, (t, at) in enumerate(zip(texts, places, strict=True)):
        if at < SPAN:
            if at >= SIDE:
                met.setdefault(t[at - SIDE : at + GRAM], []).append(i)
            if at + GRAM + SIDE <= len(t):
                met.setdefault((t[at : at + GRAM + SIDE],), []).append(i)
    return [i for members in met.values() if len(members) > 1 for i in members]


def _order_texts(group: int):
    """Marks for the chunks that have texts in a bucket, from the order of whole anchors, about ``group`` texts at a time."""

    def work(frame):
        import numpy as np
        import pandas as pd

        known: dict = {}
        text, docs, several, places, nth, chunk, names = [], [], [], [], [], [], []
        for number, blob in zip(frame["chunk"].tolist(), frame["blob"], strict=True):
            name, least, multi, place, lengths, raw = unpacked(blob, *TEXTS)
            ends, raw = np.cumsum(lengths.astype(np.int64)), raw.tobytes()
            text.append([known.setdefault(raw[b - n : b], len(known)) for b, n in zip(ends.tolist(), lengths.tolist(), strict=True)])
            docs.append(least)
            several.append(multi)
            places.append(place)
            names.append(name)
            nth.append(np.arange(len(name)))
            chunk.append(np.full(len(name), number))
        text, docs, several, places, nth, chunk, names = (np.concatenate(x) for x in (text, docs, several, places, nth, chunk, names))
        texts = list(known)
        del known
        least, anchor, place = np.full(len(texts), np.iinfo(np.int64).max), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        np.minimum.at(least, text, docs)
        anchor[text], place[text] = names, places
        most, lone = least.copy(), np.ones(len(texts), bool)
        np.maximum.at(most, text, docs)
        lone[text[several > 0]] = False
        asked = ~lone | (least < most)
        asked[_may_overlap(texts, place.tolist())] = True
        order = np.argsort(anchor, kind="stable")
        order = order[asked[order]]
        parts, start = [], 0
        while start < len(order):
            end = int(np.searchsorted(anchor[order], anchor[order[min(start + group, len(order)) - 1]], side="right"))
            mine = order[start:end]
            owner, *rest = least_documents([texts[i] for i in mine.tolist()], least[mine])
            parts.append((mine[owner], *rest))
            start = end
        out: dict = {"chunk": [], "bucket": [], "marks": []}
        if parts:
            owner, first, n, doc = (np.concatenate(x) for x in zip(*parts, strict=True))
            by = np.argsort(owner, kind="stable")
            owner, first, n, doc = owner[by], first[by], n[by], doc[by]
            lo, hi = np.searchsorted(owner, text, side="left"), np.searchsorted(owner, text, side="right")
            which = np.repeat(np.arange(len(text)), hi - lo)
            run = np.arange(len(which)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[which]
            told = (doc[run] < docs[which]) | (several[which] > 0)
            which, run = which[told], run[told]
            for number, rows in _by(chunk[which]):
                out["chunk"].append(number)
                out["bucket"].append(int(frame["bucket"].iloc[0]))
                out["marks"].append(packed(nth[which[rows]].astype("<u4"), first[run[rows]].astype("u1"), n[run[rows]].astype("u1"), doc[run[rows]].astype("<i8")))
        return pd.DataFrame(out).astype({"bucket": "int32", "chunk": "int64"})

    return work


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, starts array<long>, ends array<long>"


def _cut(buckets: int, step_bytes: int, with_texts: bool):
    """The rows of a chunk without the strings that start in smaller documents."""

    def removed(chunk: Chunk, answers):
        import numpy as np

        edges = np.zeros(len(chunk.data) + 1, np.int32)
        marks = answers[answers["marks"].notna()]
        if len(marks):
            (bucket, _, _, texts), (text, start, row) = chunk.texts(_codes(answers))
            places = dict(_by(bucket))
            at = np.argsort(text, kind="stable")
            heads = np.searchsorted(text[at], np.arange(len(texts) + 1))
            for b, blob in zip(marks["bucket"].tolist(), marks["marks"], strict=True):
                nth, first, n, doc = unpacked(blob, *MARKS)
                own = places[b][nth]
                times = heads[own + 1] - heads[own]
                which = np.repeat(np.arange(len(own)), times)
                there = at[np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times) + heads[own[which]]]
                gone = chunk.docs[row[there]] > doc[which]
                begin = start[there[gone]] + first[which[gone]]
                np.add.at(edges, begin, 1)
                np.add.at(edges, begin + n[which[gone]].astype(np.int64) + SPAN - 1, -1)
        return np.cumsum(edges[:-1]) > 0

    def work(left, right):
        import hashlib

        import numpy as np
        import pandas as pd

        out = []
        for blob in left["blob"]:
            chunk = Chunk(blob, buckets, step_bytes)
            mask = removed(chunk, right)
            for i, doc in enumerate(chunk.docs.tolist()):
                data, gone = chunk.data[chunk.offsets[i] : chunk.offsets[i + 1]], mask[chunk.offsets[i] : chunk.offsets[i + 1]]
                kept = data[~gone].tobytes()
                spans = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))).reshape(-1, 2)
                texts = (kept, spans[:, 0].tolist(), spans[:, 1].tolist()) if with_texts else (None, None, None)
                out.append((doc, len(data), int(gone.sum()), len(spans), hashlib.sha256(kept).hexdigest(), *texts))
        return pd.DataFrame(out, columns=[x.split()[0] for x in RESULT.split(", ")])

    return work


def remove_repeats(docs: DataFrame, with_texts: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept, starts, ends) per row of (doc_id, text).

    Strings of SPAN bytes are judged on the input; those that also start in a document with
    a smaller doc_id lose their bytes; n_spans and starts, ends give the maximal removed
    runs, kept the bytes left (null without ``with_texts``). Nulls and texts shorter than
    SPAN lose nothing. Rows that repeat a doc_id are equal in rank: none removes from
    another, whether their texts are equal or not. Rows without a doc_id lose nothing and
    are no source. Other columns are not read. An empty table gives an empty result. Runs
    the first of its jobs when it is called.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(whole_text(), "UTF-8").alias("text"))
    chunks = stored(texts.where("doc_id is not null").mapInArrow(_pack_chunks(CHUNK_BYTES), "chunk long, n_bytes long, blob binary"), "suffix-chunks")
    total = chunks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    buckets, chunks = max(24, total // BUCKET_BYTES) | 1, chunks.select("chunk", "blob")
    anchors = chunks.mapInArrow(_send_anchors(buckets, STEP_BYTES), "bucket int, chunk long, blob binary")
    codes = checkpointed(anchors.groupBy("bucket").applyInPandas(_judge_anchors(GROUP), "chunk long, bucket int, codes binary"))
    sent = chunks.groupBy("chunk").cogroup(codes.groupBy("chunk")).applyInPandas(_send_texts(buckets, STEP_BYTES), "bucket int, chunk long, blob binary")
    marks = sent.groupBy("bucket").applyInPandas(_order_texts(GROUP), "chunk long, bucket int, marks binary")
    answers = codes.withColumn("marks", F.lit(None).cast("binary")).unionByName(marks.withColumn("codes", F.lit(None).cast("binary")))
    found = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(_cut(buckets, STEP_BYTES, with_texts), RESULT)
    lone = texts.where("doc_id is null").select(
        "doc_id",
        F.octet_length("text").cast("long").alias("n_bytes"),
        F.lit(0).cast("long").alias("n_removed"),
        F.lit(0).cast("long").alias("n_spans"),
        F.sha2("text", 256).alias("kept_sha256"),
        (F.col("text") if with_texts else F.lit(None).cast("binary")).alias("kept"),
        F.array().cast("array<long>").alias("starts"),
        F.array().cast("array<long>").alias("ends"),
    )
    return found.unionByName(lone)


def query(spark, sf_dir: str) -> DataFrame:
    from cytolith.llm.common import read_table

    found = remove_repeats(read_table(spark, sf_dir, "documents"), with_texts=False)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def oracle() -> str:
    """The same removal in SQL, from all strings of SPAN bytes, as hexadecimal digits."""
    return f"""
with t as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
s as (select doc_id, place, substr(h, 2 * place + 1, {2 * SPAN}) as string from (select doc_id, h, unnest(range(length(h) // 2 - {SPAN - 1})) as place from t)),
first as (select string, min(doc_id) as least from s group by string),
gone as (select s.doc_id, place from s join first using (string) where doc_id > least),
bytes as (select doc_id, p, substr(h, 2 * p + 1, 2) as byte from (select doc_id, h, unnest(range(length(h) // 2)) as p from t)),
marked as (select b.doc_id, b.p, byte, coalesce(max(g.place) over (partition by b.doc_id order by b.p rows between {SPAN - 1} preceding and current row) is not null, false) as out
  from bytes b left join gone g on b.doc_id = g.doc_id and b.p = g.place),
runs as (select *, out and not coalesce(lag(out) over (partition by doc_id order by p), false) as opens from marked),
sums as (select doc_id, count(*) filter (out) as n_removed, count(*) filter (opens) as n_spans, coalesce(string_agg(byte, '' order by p) filter (not out), '') as kept from runs group by doc_id)
select t.doc_id, length(h) // 2 as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(kept, ''))) as kept_sha256
from t left join sums using (doc_id)
"""
