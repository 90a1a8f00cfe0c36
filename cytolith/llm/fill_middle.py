"""Fill-in-middle over seekable compressed frames.

A text is stored as independent zstandard frames of at most ``FRAME_BYTES`` bytes of its
UTF-8, each with the units (lines), characters and bytes before it. A place between two
units is found by the cumulative counts, so only the frames that are cut are read and
compressed again; all others move into the output as they stand, for frames one after
another are a stream of their own. Digests are fed frame by frame, so a task holds the
compressed frames of a document and one frame of its text.

Null texts count as empty; an empty text has no frames. Repeated rows and null keys stay
rows of their own (a null key draws as an empty one). Only the key and the text are read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytolith.llm.common import whole_text

FRAME_BYTES = 1 << 16
LEVEL = 1
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SEED, PERCENT, SPM_PERCENT = 7, 100, 50
FRAME = "struct<units: long, chars: long, bytes: long, data: binary>"


def _chars(data: bytes) -> int:
    """Characters that begin in these bytes of UTF-8."""
    import numpy as np

    return len(data) - int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) == 0x80))


def store(docs: DataFrame, key: str = "doc_id", text: str = "text", frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """(key, n_units, n_chars, n_bytes, marked, frames): ``marked`` texts hold one of the three marks."""
    if frame_bytes < 1:
        raise ValueError(f"{frame_bytes} bytes are no frame")
    kind = docs.schema[key].dataType.simpleString()

    def work(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import zstandard

        pack = zstandard.ZstdCompressor(level=LEVEL).compress
        for batch in batches:
            totals, offsets, frames = [], [0], []
            for value in batch.column(1):
                data = value.as_buffer().to_pybytes()
                units = chars = 0
                for at in range(0, len(data), frame_bytes):
                    part = data[at : at + frame_bytes]
                    frames.append((units, chars, at, pack(part)))
                    units, chars = units + part.count(b"\n"), chars + _chars(part)
                offsets.append(len(frames))
                units += bool(data) and not data.endswith(b"\n")
                totals.append((units, chars, len(data), any(mark in data for mark in (PREFIX, SUFFIX, MIDDLE))))
            counts = np.array([x[:3] for x in frames], np.int64).reshape(-1, 3)
            fields = [pa.array(counts[:, i]) for i in range(3)] + [pa.array([x[3] for x in frames], pa.binary())]
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(fields, ["units", "chars", "bytes", "data"]))
            columns = [pa.array([x[i] for x in totals], pa.int64()) for i in range(3)] + [pa.array([x[3] for x in totals], pa.bool_()), lists]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["key", "n_units", "n_chars", "n_bytes", "marked", "frames"])

    rows = docs.select(F.col(key).alias("key"), whole_text(text).alias("text"))
    return rows.mapInArrow(work, f"key {kind}, n_units long, n_chars long, n_bytes long, marked boolean, frames array<{FRAME}>")


class Frames:
    """The stored frames of one text: places by unit, parts between places, still compressed."""

    def __init__(self, frames: list[dict], n_units: int, n_chars: int) -> None:
        import zstandard

        self.frames, self.n_units, self.n_chars = frames, n_units, n_chars
        self.units = [f["units"] for f in frames]
        self.read, self.pack = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=LEVEL).compress

    def place(self, units: int) -> tuple[int, int, int]:
        """(frame, byte in it, characters before) of the end of so many units; reads one frame at most."""
        if units == 0:
            return 0, 0, 0
        if units == self.n_units:
            return len(self.frames), 0, self.n_chars
        nth = bisect_left(self.units, units) - 1
        data, at = self.read(self.frames[nth]["data"]), 0
        for _ in range(units - self.units[nth]):
            at = data.index(b"\n", at) + 1
        return nth, at, self.frames[nth]["chars"] + _chars(data[:at])

    def part(self, start: tuple[int, int, int], end: tuple[int, int, int]) -> list[bytes]:
        """Compressed frames of the text between two places: whole ones as they stand, cut ones compressed anew."""
        out = []
        for nth in range(start[0], min(end[0] + 1, len(self.frames))):
            low, high = (start[1] if nth == start[0] else 0), (end[1] if nth == end[0] else None)
            if low == 0 and high is None:
                out.append(self.frames[nth]["data"])
            elif cut := self.read(self.frames[nth]["data"])[low:high]:
                out.append(self.pack(cut))
        return out


def _draw(key: Column, nth: int, seed: int) -> Column:
    """The nth group of eight hex digits of the digest of seed and key, as a number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.conv(F.substring(digest, 8 * nth + 1, 8), 16, 10).cast("long")


def fill_middle(stored: DataFrame, seed: int = SEED, percent: int = PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """Stored texts with their middle moved to the end: (key, n_units, form, prefix_chars, middle_chars, output).

    Two draws from the key cut the units in three. ``output`` is the list of compressed frames
    of the new text. Empty and marked texts, and those outside ``percent``, stay plain.
    """
    kind = stored.schema["key"].dataType.simpleString()
    ends = [_draw(F.col("key"), i, seed) % (F.col("n_units") + 1) for i in (0, 1)]
    plain = (F.col("n_units") == 0) | F.col("marked") | (_draw(F.col("key"), 2, seed) % 100 >= percent)
    form = F.when(plain, "plain").when(_draw(F.col("key"), 3, seed) % 100 < spm_percent, "spm").otherwise("psm")
    rows = stored.select("key", "n_units", "n_chars", form.alias("form"), F.least(*ends).alias("first"), F.greatest(*ends).alias("second"), "frames")

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        pack = zstandard.ZstdCompressor(level=LEVEL).compress
        marks = {mark: [pack(mark)] for mark in (PREFIX, SUFFIX, MIDDLE)}
        for batch in batches:
            prefix_chars, middle_chars, outputs = [], [], []
            for nth, form in enumerate(batch.column("form").to_pylist()):
                frames = batch.column("frames")[nth].as_py()
                if form == "plain":
                    prefix_chars.append(None)
                    middle_chars.append(None)
                    outputs.append([f["data"] for f in frames])
                    continue
                text = Frames(frames, batch.column("n_units")[nth].as_py(), batch.column("n_chars")[nth].as_py())
                first, second = text.place(batch.column("first")[nth].as_py()), text.place(batch.column("second")[nth].as_py())
                prefix, middle, suffix = text.part((0, 0, 0), first), text.part(first, second), text.part(second, (len(frames), 0, 0))
                before = marks[PREFIX] + prefix + marks[SUFFIX] + suffix if form == "psm" else marks[SUFFIX] + suffix + marks[PREFIX] + prefix
                outputs.append(before + marks[MIDDLE] + middle)
                prefix_chars.append(first[2])
                middle_chars.append(second[2] - first[2])
            columns = [pa.array(prefix_chars, pa.int64()), pa.array(middle_chars, pa.int64()), pa.array(outputs, pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays([*batch.select(["key", "n_units", "form"]).columns, *columns], ["key", "n_units", "form", "prefix_chars", "middle_chars", "output"])

    return rows.mapInArrow(work, f"key {kind}, n_units long, form string, prefix_chars long, middle_chars long, output array<binary>")


def _between(frames: list[bytes], sizes: list[int], start: int, end: int, read) -> Iterator[bytes]:
    at = 0
    for frame, size in zip(frames, sizes, strict=True):
        if at < end and at + size > start:
            yield read(frame)[max(0, start - at) : end - at]
        at += size


def _scan(frames: list[bytes], marks: tuple[bytes, ...], read) -> tuple[str, list[int], list[int]]:
    """Digest of the stream, the sizes of its frames, and where each mark first stands behind the one before it."""
    digest, sizes, found, kept, at = hashlib.sha256(), [], [], b"", 0
    for frame in frames:
        data = read(frame)
        digest.update(data)
        sizes.append(len(data))
        window, base, after = kept + data, at - len(kept), 0
        while len(found) < len(marks) and (hit := window.find(marks[len(found)], after)) >= 0:
            found.append(base + hit)
            after = hit + len(marks[len(found) - 1])
        kept, at = window[max(after, len(window) - 2) :], at + len(data)
    return digest.hexdigest(), sizes, found


def restored(frames: list[bytes], form: str) -> Iterator[bytes]:
    """The text before ``fill_middle``, piece by piece, from an output and its form alone."""
    import zstandard

    read = zstandard.ZstdDecompressor().decompress
    if form == "plain":
        yield from map(read, frames)
        return
    _, sizes, (a, b, c) = _scan(frames, (PREFIX, SUFFIX, MIDDLE) if form == "psm" else (SUFFIX, PREFIX, MIDDLE), read)
    one, two, middle = (a + 3, b), (b + 3, c), (c + 3, sum(sizes))
    for span in (one, middle, two) if form == "psm" else (two, middle, one):
        yield from _between(frames, sizes, *span, read)


def digests(outputs: DataFrame) -> DataFrame:
    """``outputs`` of ``fill_middle`` with output_sha256 and restored_sha256 instead of the frames."""
    kept = [c for c in outputs.columns if c != "output"]

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        read = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            sums, backs = [], []
            for frames, form in zip(batch.column("output"), batch.column("form").to_pylist(), strict=True):
                frames, back = frames.as_py(), hashlib.sha256()
                sums.append(_scan(frames, (), read)[0])
                for piece in restored(frames, form):
                    back.update(piece)
                backs.append(back.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.select(kept).columns, pa.array(sums, pa.string()), pa.array(backs, pa.string())], [*kept, "output_sha256", "restored_sha256"])

    schema = ", ".join(f"`{c}` {outputs.schema[c].dataType.simpleString()}" for c in kept)
    return outputs.mapInArrow(work, f"{schema}, output_sha256 string, restored_sha256 string")


def query(spark, sf_dir: str) -> DataFrame:
    from cytolith.llm.common import read_table

    out = digests(fill_middle(store(read_table(spark, sf_dir, "documents"))))
    return out.withColumnsRenamed({"key": "doc_id", "n_units": "n"})
