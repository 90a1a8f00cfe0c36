"""Edit-aware token counts: a segment tree of pre-token blocks per document.

A text is cut into blocks at places where a pre-token ends whatever stands further off:
between a character that is no white space and a single space before another such
character. Blocks can be encoded apart from each other, so the leaves of a document's
tree hold their lengths and token counts and inner nodes hold sums. An edit re-encodes
the blocks it touches, with two characters of context to either side, cuts what has grown
too long, and updates the sums on the way to the root; all other blocks keep their counts.
Trees are kept as a column beside the texts: the leaves, from which the rest follows. Edits
return the tree of the new text, so batch after batch is counted without whole encoding.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytolith.llm.common import stored, whole_text
from cytolith.llm.tokens import default_path, encoder, read_vocabulary

BLOCK_CHARS = 256
CONTEXT_CHARS = 2
_CUT = re.compile(r"(?<=\S) (?=\S)")


class TokenTree:
    """Block texts of one document under a binary tree of (characters, tokens)."""

    def __init__(self, text: str, count: Callable[[str], int], leaves: list[tuple[int, int]] | None = None) -> None:
        """``leaves`` are the characters and tokens of the blocks of this text, if they are known."""
        self.count = count
        self.encoded = 0
        if leaves is None:
            blocks = self.cut(text)
            counts = [self._encode(block) for block in blocks]
        else:
            ends = list(accumulate(chars for chars, _ in leaves))
            if (ends[-1] if ends else 0) != len(text):
                raise ValueError("the leaves are not those of this text")
            blocks, counts = [text[end - chars : end] for end, (chars, _) in zip(ends, leaves, strict=True)] or [""], [n for _, n in leaves] or [0]
        self._plant(blocks, counts)

    def leaves(self) -> list[tuple[int, int]]:
        """Characters and tokens of the blocks that are not empty; a tree grows from them again."""
        return [(len(block), self.tokens[self.size + i]) for i, block in enumerate(self.blocks) if block]

    def _plant(self, blocks: list[str], counts: list[int]) -> None:
        self.blocks = blocks
        self.size = 1 << max(0, len(blocks) - 1).bit_length()
        self.chars = [0] * (2 * self.size)
        self.tokens = [0] * (2 * self.size)
        for i, (block, n) in enumerate(zip(blocks, counts, strict=True)):
            self.chars[self.size + i], self.tokens[self.size + i] = len(block), n
        for i in range(self.size - 1, 0, -1):
            self._sum(i)

    @staticmethod
    def cut(text: str) -> list[str]:
        out, start = [], 0
        while found := _CUT.search(text, start + BLOCK_CHARS):
            out.append(text[start : found.start()])
            start = found.start()
        out.append(text[start:])
        return out

    def _encode(self, block: str) -> int:
        self.encoded += len(block)
        return self.count(block)

    def _sum(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def _find(self, at: int) -> tuple[int, int]:
        """The block with the character at ``at``, and where that block starts."""
        i, start = 1, 0
        while i < self.size:
            i *= 2
            if at - start >= self.chars[i]:
                start += self.chars[i]
                i += 1
        return i - self.size, start

    def _set(self, block: int, text: str, tokens: int) -> None:
        self.blocks[block] = text
        i = self.size + block
        self.chars[i], self.tokens[i] = len(text), tokens
        while i := i // 2:
            self._sum(i)

    def replace(self, start: int, end: int, new: str) -> None:
        """Put ``new`` in the place of the characters from start to end."""
        n = self.chars[1]
        if not 0 <= start <= end <= n:
            raise ValueError(f"an edit from {start} to {end} is outside a text of {n} characters")
        first, offset = self._find(max(0, start - CONTEXT_CHARS)) if n else (0, 0)
        last = self._find(min(n - 1, end + CONTEXT_CHARS))[0] if n else 0
        text = "".join(self.blocks[first : last + 1])
        pieces = self.cut(text[: start - offset] + new + text[end - offset :])
        counts = [self._encode(piece) for piece in pieces]
        slots = last + 1 - first
        if len(pieces) > slots:
            # more blocks than leaves: the tree is planted again, with the counts that are known
            known = self.tokens[self.size : self.size + len(self.blocks)]
            self._plant(self.blocks[:first] + pieces + self.blocks[last + 1 :], known[:first] + counts + known[last + 1 :])
            return
        for i in range(slots):
            self._set(first + i, *((pieces[i], counts[i]) if i < len(pieces) else ("", 0)))

    def total(self) -> int:
        return self.tokens[1]

    def text(self) -> str:
        return "".join(self.blocks)


def apply_in_order(tree: TokenTree, edits: list[tuple[int | None, int | None, str | None]]) -> int:
    """Apply edits in coordinates of the unedited text, and say how many.

    Left out are edits without a start or end, those that reach beyond the text or end
    before they start, and those that overlap one that comes before them in order of
    start, end and replacement. A null replacement is empty.
    """
    n = tree.chars[1]
    kept, at = [], 0
    for start, end, new in sorted((a, b, c or "") for a, b, c in edits if a is not None and b is not None):
        if at <= start <= end <= n:
            kept.append((start, end, new))
            at = end
    for start, end, new in reversed(kept):
        tree.replace(start, end, new)
    return len(kept)


def _counter(vocabulary: bytes) -> Callable[[str], int]:
    encode = encoder(vocabulary)
    return lambda text: len(encode(text))


#: A tree beside its text: the leaves, from which all sums follow, and the text's crc32, by which a tree of another text is known.
TREE = "struct<mark: long, chars: array<int>, tokens: array<int>>"


def _kept(text: str, leaves: list[tuple[int, int]]) -> dict:
    return {"mark": zlib.crc32(text.encode()), "chars": [c for c, _ in leaves], "tokens": [n for _, n in leaves]}


def _arrow_tree():
    import pyarrow as pa

    return pa.struct([("mark", pa.int64()), ("chars", pa.list_(pa.int32())), ("tokens", pa.list_(pa.int32()))])


def _fits(tree: dict | None, text: str) -> bool:
    """Whether a kept tree is whole and that of this text."""
    if not tree or tree["mark"] is None or tree["chars"] is None or tree["tokens"] is None:
        return False
    chars, tokens = tree["chars"], tree["tokens"]
    return None not in chars and None not in tokens and len(chars) == len(tokens) and sum(chars) == len(text) and tree["mark"] == zlib.crc32(text.encode())


def build(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """(doc_id, text, n_tokens, tree) per row: the tokens of the whole text and the tree of its blocks.

    Null texts count as empty, with no tokens. Repeated rows and null identifiers stay; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(tokenizer_path or default_path()))

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        count = _counter(shared.value)
        for batch in batches:
            totals, trees = [], []
            for x in batch.column(1):
                text = x.as_py()
                leaves = [(len(block), count(block)) for block in TokenTree.cut(text) if block]
                totals.append(sum(n for _, n in leaves))
                trees.append(_kept(text, leaves))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(totals, pa.int64()), pa.array(trees, _arrow_tree())], ["doc_id", "text", "n_tokens", "tree"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInArrow(work, f"doc_id long, text string, n_tokens long, tree {TREE}")


def recount(rows: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, n_tokens_after, n_edits, n_edits_left_out, n_chars, n_chars_encoded_again, text_after, tree_after).

    ``rows`` has doc_id, text, edits as array<struct<start, end, replacement>> in code
    points, and tree from ``build`` or from an earlier batch of edits; a null or damaged
    tree, or that of another text, is made anew from the text. Only blocks that edits touch
    are encoded again, and tree_after knows all others by their old counts. Null
    texts and lists of edits count as empty; ``apply_in_order`` says which edits are left out.
    """
    shared = rows.sparkSession.sparkContext.broadcast(read_vocabulary(tokenizer_path or default_path()))
    schema = f"doc_id long, n_tokens long, n_tokens_after long, n_edits int, n_edits_left_out int, n_chars long, n_chars_encoded_again long, text_after string, tree_after {TREE}"

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        count = _counter(shared.value)
        names = ["doc_id", "n_tokens", "n_tokens_after", "n_edits", "n_edits_left_out", "n_chars", "n_chars_encoded_again", "text_after", "tree_after"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), _arrow_tree()]
        for batch in batches:
            out = []
            for doc, text, edits, kept in zip(*(batch.column(i) for i in range(4)), strict=True):
                text, edits, kept = text.as_py(), [e or {} for e in edits.as_py() or []], kept.as_py()
                tree = TokenTree(text, count, list(zip(kept["chars"], kept["tokens"], strict=True)) if _fits(kept, text) else None)
                before, tree.encoded = tree.total(), 0
                n = apply_in_order(tree, [(e.get("start"), e.get("end"), e.get("replacement")) for e in edits])
                after = tree.text()
                out.append((doc.as_py(), before, tree.total(), n, len(edits) - n, len(text), tree.encoded, after, _kept(after, tree.leaves())))
            columns = zip(*out, strict=True) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    columns = [F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")]
    columns += [F.col("edits").cast("array<struct<start:int,end:int,replacement:string>>").alias("edits"), F.col("tree").cast(TREE).alias("tree")]
    return rows.select(*columns).mapInArrow(work, schema)


def apply_edits(trees: DataFrame, edits: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """``recount`` for a table of edits (doc_id, start, end, replacement) and trees from ``build`` or ``edited``.

    Only documents with edits are read further and returned. Rows that share a doc_id all
    get its edits; edits without a doc_id, or with one that no tree has, do nothing.
    """
    listed = edits.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", "replacement")).alias("edits"))
    return recount(trees.select("doc_id", "text", "tree").join(listed, "doc_id"), tokenizer_path)


def edited(recounted: DataFrame) -> DataFrame:
    """Texts and trees after a batch of edits, in the shape of ``build``, for the next batch."""
    return recounted.select("doc_id", F.col("text_after").alias("text"), F.col("n_tokens_after").alias("n_tokens"), F.col("tree_after").alias("tree"))


#: What the query edits out: mail addresses and long numbers.
REDACTED = r"[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]++|[0-9][0-9 ().-]{7,24}[0-9]"


def query(spark, sf_dir: str) -> DataFrame:
    """Token counts of every document before and after its mail addresses and long numbers are edited out."""
    from cytolith.llm.common import read_table

    trees = stored(build(read_table(spark, sf_dir, "documents")), "token-trees")
    gaps, hits = F.split("text", REDACTED, -1), F.regexp_extract_all("text", F.lit(REDACTED), F.lit(0))
    parts = F.zip_with(gaps, hits, lambda gap, hit: F.struct(F.length(gap).alias("gap"), F.length(hit).alias("hit")))
    none = F.array().cast("array<struct<start:int,end:int,replacement:string>>")

    def step(state, part):
        start = state["at"] + part["gap"]
        end = start + F.coalesce(part["hit"], F.lit(0))
        edit = F.struct(start.alias("start"), end.alias("end"), F.lit("[redacted]").alias("replacement"))
        return F.struct(end.alias("at"), F.when(part["hit"].isNull(), state["edits"]).otherwise(F.concat(state["edits"], F.array(edit))).alias("edits"))

    edits = F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("edits")), step, lambda state: state["edits"])
    return recount(trees.withColumn("edits", F.when(F.col("text").rlike(REDACTED), edits).otherwise(none))).drop("text_after", "tree_after")
