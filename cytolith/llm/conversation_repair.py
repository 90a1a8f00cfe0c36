"""Conversation structure repair: Viterbi over chunks of turns by rank convergence.

A conversation's roles must spell ``(s?(ua)+)?``. Each row is kept (0), given another role
(2) or deleted (3, a must for blank and repeated rows), empty turns are inserted (2), and
a truncated row that stays costs 1. The cheapest edits are found backwards: a vector holds
the cost to go from each of four states (start, after s, after u, after a).

Rows are sorted over the cluster by conversation and turn and cut into chunks. A
conversation that lies within one chunk is solved where it is read. The chunks of the
others start side by side from a speculative vector. A fix-up pass gives each chunk the
vector of its successor and runs it again until old and new vectors differ by a constant
only, from where on nothing but that constant changes; passes end when no chunk's end
vector changes (rank convergence). Costs are the sum of the constants. The edits are then
traced forwards along the costs to go, always by the least letter that is still cheapest:
each chunk is traced from all four states, the maps of states are composed along the
conversation, and the trace from the state that is reached counts.

Ties of a turn are ordered by a hash of role and text, then by role and text. Null roles,
texts and identifiers (in the damage) count as one space, null turns come first, rows with
a null conv_id are one conversation. Extra columns are not read. An empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from cytolith.llm.common import checkpointed, stored

#: Rows, and bytes of texts, after which a chunk ends.
CHUNK_ROWS, CHUNK_BYTES = 128, 4 << 20
SPACES = " \t\n\x0b\x0c\r"
LEGAL = ("su", "ua", "au")
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state behind an inserted turn or a new role, by the state before it; and behind a kept role.
NEXT = (USER, USER, ASSISTANT, USER)
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: Costs to go at the end of a conversation; every chunk but the last begins with them as a guess.
ACCEPTED = (0, 4, 2, 0)
#: Codes of rows: two that must go, then pairs (whole, truncated) for the initials s, u, a and all others.
BLANK, DUPLICATE, FIRST_FREE, INITIALS = 0, 1, 2, "sua"


def code_of(role: str, text: str) -> int:
    """The code of a row that is no duplicate."""
    last = text.rstrip(SPACES)[-1:]
    if not last:
        return BLANK
    nth = INITIALS.find(role[:1]) if role else -1
    return FIRST_FREE + 2 * (nth if nth >= 0 else 3) + (last not in ".!?")


def _row(code: int, after: tuple[int, ...]) -> tuple[list[int], list[int]]:
    """Costs to go before a row, without and with turns inserted in front of it."""
    plain = [3 + x for x in after]
    if code >= FIRST_FREE:
        initial, extra = (INITIALS + "-")[(code - FIRST_FREE) // 2], (code - FIRST_FREE) % 2
        for q in range(4):
            plain[q] = min(plain[q], 2 + extra + after[NEXT[q]])
            if (q, initial) in KEPT:
                plain[q] = min(plain[q], extra + after[KEPT[q, initial]])
    return plain, [min(plain[q], 2 + plain[NEXT[q]], 4 + plain[NEXT[NEXT[q]]]) for q in range(4)]


@lru_cache(maxsize=None)  # vectors less their least entry are few
def step(code: int, after: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    """The vector before a row, less its least entry, and that entry."""
    costs = _row(code, after)[1]
    least = min(costs)
    return tuple(x - least for x in costs), least


@lru_cache(maxsize=None)
def edit(code: int, state: int, after: tuple[int, ...]) -> tuple[str, int]:
    """The least letters among the cheapest edits up to and with a row, and the state behind it."""
    costs, letters = _row(code, after)[1], ""
    free, extra = code >= FIRST_FREE, (code - FIRST_FREE) % 2
    while True:
        if costs[state] == 3 + after[state]:
            return letters + "D", state
        if costs[state] == 2 + costs[NEXT[state]]:
            letters, state = letters + "I", NEXT[state]
            continue
        kept = KEPT.get((state, (INITIALS + "-")[(code - FIRST_FREE) // 2])) if free else None
        if kept is not None and costs[state] == extra + after[kept]:
            return letters + "K", kept
        return letters + "R", NEXT[state]


def backward(codes: bytes, end: tuple[int, ...]) -> tuple[list[tuple[int, ...]], int]:
    """Vectors behind each row, the one before the first row last, and the sum of the constants taken off."""
    vectors, total = [end], 0
    for code in reversed(codes):
        vector, least = step(code, vectors[-1])
        vectors.append(vector)
        total += least
    return vectors, total


def rerun(codes: bytes, old: tuple[int, ...], new: tuple[int, ...], out: tuple[int, ...], total: int) -> tuple[tuple[int, ...], int]:
    """What ``backward`` gives from ``new``, if it gave (out, total) from ``old``; stops where the two run alike."""
    moved = 0
    for code in reversed(codes):
        if old == new:
            return out, total + moved
        (old, a), (new, b) = step(code, old), step(code, new)
        moved += b - a
    return new, total + moved


def trace(codes: bytes, vectors: list[tuple[int, ...]], state: int, last: bool) -> tuple[list[str], int]:
    """Letters of each row (those behind the last row as one more), and the state at the end."""
    letters = []
    for nth, code in enumerate(codes):
        found, state = edit(code, state, vectors[len(codes) - 1 - nth])
        letters.append(found)
    tail = ""
    while last and state not in (START, ASSISTANT):
        tail, state = tail + "I", NEXT[state]
    return [*letters, tail], state


def rewritten(roles: list[str], texts: list[str], letters: list[str], state: int) -> list[str]:
    """The rows that the edits leave, as ``role:text``."""
    out = []
    for nth, found in enumerate(letters):
        for letter in found:
            if letter == "D":
                continue
            if letter == "K":
                out.append(f"{roles[nth]}:{texts[nth]}")
                state = KEPT[state, roles[nth][0]]
                continue
            state = NEXT[state]
            out.append(f"{NAMES[state]}:{texts[nth] if letter == 'R' else ''}")
    return out


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with planted faults by crc32 of ``conv_id:turn``: dropped, emptied, truncated, repeated (copies = 2), or given to the user."""
    kind = F.crc32(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]).cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    return conversations.where(kind != 0).select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def _key(conv_id: Column) -> Column:
    return F.coalesce(F.concat(F.lit("v"), conv_id.cast("string")), F.lit("n"))


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))


COUNTS = "blank long, duplicate long, truncated long, illegal long"
_CHUNK = f"ckey string, part int, nth int, whole boolean, {COUNTS}, cost long, audit string, n_lines long, repaired string, roles array<string>, texts array<string>, codes binary, digests array<binary>"


def _solved(roles: list[str], texts: list[str], codes: bytes) -> tuple[int, str, list[str]]:
    """Cost, audit and rows of a whole conversation."""
    vectors, total = backward(codes, ACCEPTED)
    letters, _ = trace(codes, vectors, START, True)
    return total + vectors[-1][START], "".join(letters), rewritten(roles, texts, letters, START)


def chunks(rows: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Chunks of sorted rows (conv_id, turn, role, text, copies): ``whole`` ones solved, the others with what solving takes.

    Repeats of a row are told apart by a hash of its place in the input, so that they may lie in several tasks.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = rows.withColumns({"tie": F.xxhash64("role", "text"), "salt": F.xxhash64(F.monotonically_increasing_id())})
    schema = to_arrow_schema(StructType.fromDDL(_CHUNK))
    dealt = keyed.repartitionByRange(n, "conv_id", "turn", "tie", "salt").sortWithinPartitions("conv_id", "turn", "tie", "role", "text")

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        out: list[dict] = []
        roles, texts, seen, held, key, edge, nth = [], [], {}, 0, None, True, 0

        def chunk(whole: bool) -> dict:
            codes, digests = bytearray(), []
            seen.clear()
            for role, text in zip(roles, texts, strict=True):
                code, digest = code_of(role, text), b""
                if code != BLANK:
                    digest = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
                    if digest in seen:
                        code, digest = DUPLICATE, b""
                    seen[digest] = True
                codes.append(code)
                digests.append(digest)
            codes = bytes(codes)
            row = {"ckey": key, "part": part, "nth": nth, "whole": whole, "illegal": _illegal([r[:1] for r in roles])}
            if not whole:
                return row | {"roles": list(roles), "texts": list(texts), "codes": codes, "digests": digests}
            cost, audit, lines = _solved(roles, texts, codes)
            return row | _faults(codes) | {"cost": cost, "audit": audit, "n_lines": len(lines), "repaired": "\n".join(lines)}

        def ready():
            nonlocal out, held
            batch, out, held = pa.RecordBatch.from_pylist(out, schema), [], 0
            return batch

        for batch in batches:
            for k, role, text, copies in zip(*batch.to_pydict().values(), strict=True):
                if k != key:
                    if roles:
                        out.append(chunk(whole=not edge and nth == 0))
                    edge, key, nth, roles, texts = key is None, k, 0, [], []
                for _ in range(copies):
                    if len(roles) >= chunk_rows or held > CHUNK_BYTES and roles:
                        out.append(chunk(whole=False))
                        nth, roles, texts = nth + 1, [], []
                        if held > CHUNK_BYTES:
                            yield ready()
                    roles.append(role)
                    texts.append(text)
                    held += len(text)
            if out and len(out) > 256:
                yield ready()
        if roles:
            out.append(chunk(whole=False))
        if out:
            yield ready()

    return stored(dealt.select(_key(F.col("conv_id")).alias("ckey"), "role", "text", "copies").mapInArrow(work, _CHUNK), "conversation-chunks")


def _faults(codes: bytes) -> dict[str, int]:
    return {"blank": codes.count(BLANK), "duplicate": codes.count(DUPLICATE), "truncated": sum(c >= FIRST_FREE and (c - FIRST_FREE) % 2 for c in codes)}


def _chained(parts: DataFrame) -> DataFrame:
    """Open chunks with their ordinal in the conversation, and rows seen in an earlier chunk marked as duplicates.

    A conversation has at most one run of chunks per task of the sort, so what is ordered per conversation is bounded by the tasks.
    """
    runs = parts.groupBy("ckey", "part").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("ckey").orderBy("part")
    runs = runs.select("ckey", "part", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"), F.sum("n").over(Window.partitionBy("ckey")).alias("pieces"))
    ordered = parts.join(runs, ["ckey", "part"]).withColumn("ordinal", F.col("offset") + F.col("nth"))
    firsts = ordered.where("pieces > 1").select("ckey", "ordinal", F.posexplode("digests").alias("at", "digest")).where(F.length("digest") > 0)
    earliest = firsts.groupBy("ckey", "digest").agg(F.min("ordinal").alias("earliest"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = firsts.join(earliest, ["ckey", "digest"]).where(F.col("ordinal") > F.col("earliest")).groupBy("ckey", "ordinal").agg(F.collect_list("at").alias("again"))
    initials = F.transform("roles", lambda r: F.substring(r, 1, 1))
    return ordered.join(again, ["ckey", "ordinal"], "left").withColumns({"first_initial": F.get(initials, F.lit(0)), "last_initial": F.element_at(initials, -1)}).drop("digests", "offset")


_VECTOR = "array<int>"


def _converged(chain: DataFrame) -> DataFrame:
    """(ckey, ordinal, part, nth, codes, last, used, out, total): chunks whose ``used`` is their successor's ``out``.

    Each pass is a join of neighbours. A pass settles at least one more chunk of each
    conversation from its end; mostly all are settled by the first, for old and new vectors soon run alike.
    """
    schema = f"ckey string, ordinal long, part int, nth int, codes binary, last boolean, used {_VECTOR}, out {_VECTOR}, total long"

    def begin(frames: Iterator) -> Iterator:
        for frame in frames:
            marked = []
            for codes, again in zip(frame["codes"], frame["again"], strict=True):
                codes = bytearray(codes)
                for at in again if again is not None else ():
                    codes[at] = DUPLICATE
                marked.append(bytes(codes))
            found = [backward(codes, ACCEPTED) for codes in marked]
            frame["codes"], frame["used"] = marked, [list(ACCEPTED)] * len(frame)
            frame["out"], frame["total"] = [list(v[-1]) for v, _ in found], [t for _, t in found]
            yield frame.drop(columns="again")

    def again(frames: Iterator) -> Iterator:
        for frame in frames:
            found = [
                (list(o), t) if want is None else rerun(codes, tuple(used), tuple(want), tuple(o), t)
                for codes, used, want, o, t in zip(frame["codes"], frame["used"], frame["want"], frame["out"], frame["total"], strict=True)
            ]
            frame["used"] = [used if want is None else want for used, want in zip(frame["used"], frame["want"], strict=True)]
            frame["out"], frame["total"] = [list(map(int, o)) for o, _ in found], [t for _, t in found]
            yield frame.drop(columns="want")

    last = F.col("ordinal") == F.col("pieces") - 1
    state = checkpointed(chain.select("ckey", "ordinal", "part", "nth", "codes", last.alias("last"), "again").mapInPandas(begin, schema))
    while True:
        following = state.select("ckey", (F.col("ordinal") - 1).alias("ordinal"), F.col("out").alias("want"))
        joined = state.join(following, ["ckey", "ordinal"], "left")
        if joined.where(F.col("want") != F.col("used")).isEmpty():
            return state
        state = checkpointed(joined.select(*state.columns, "want").mapInPandas(again, schema))


def _composed(maps: DataFrame, by: list[str], order: str, state: str) -> DataFrame:
    """``maps`` (by, order, moves: the state behind a chunk by the state before it) with ``before``: the moves of all chunks in front."""
    import pandas as pd

    def compose(frame: pd.DataFrame) -> pd.DataFrame:
        frame, before, out = frame.sort_values(order), [0, 1, 2, 3], []
        for moves in frame["moves"]:
            out.append(before)
            before = [int(moves[q]) for q in before]
        frame["before"], frame["through"] = out, [before] * len(frame)
        return frame

    return maps.groupBy(*by).applyInPandas(compose, f"{state}, moves {_VECTOR}, before {_VECTOR}, through {_VECTOR}")


def _entered(state: DataFrame) -> DataFrame:
    """(ckey, ordinal, state in which the chunk is entered): moves are composed within a task's run, then over runs."""

    def moves(frames: Iterator) -> Iterator:
        for frame in frames:
            found = []
            for codes, used, last in zip(frame["codes"], frame["used"], frame["last"], strict=True):
                vectors, _ = backward(codes, tuple(map(int, used)))
                found.append([trace(codes, vectors, q, last)[1] for q in range(4)])
            frame["moves"] = found
            yield frame[["ckey", "part", "nth", "ordinal", "moves"]]

    each = state.mapInPandas(moves, f"ckey string, part int, nth int, ordinal long, moves {_VECTOR}")
    inner = _composed(each, ["ckey", "part"], "nth", "ckey string, part int, nth int, ordinal long")
    runs = inner.groupBy("ckey", "part").agg(F.first("through").alias("moves"))
    outer = _composed(runs, ["ckey"], "part", "ckey string, part int").select("ckey", "part", F.get("before", F.lit(START)).alias("entered"))
    return inner.join(outer, ["ckey", "part"]).select("ckey", "ordinal", F.get("before", F.col("entered")).alias("entered"))


_PIECE = f"ckey string, ordinal long, pieces long, {COUNTS}, cost long, audit string, n_lines long, repaired string"


def repaired(rows: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Repaired conversations in pieces: (ckey, ordinal, pieces, faults, cost, audit, n_lines, repaired text)."""
    found = chunks(rows, chunk_rows)
    whole = found.where("whole").select("ckey", F.lit(0).cast("long").alias("ordinal"), F.lit(1).cast("long").alias("pieces"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", "n_lines", "repaired")
    chain = _chained(found.where("not whole"))
    state = _converged(chain)
    before = chain.select("ckey", (F.col("ordinal") + 1).alias("ordinal"), F.col("last_initial").alias("before"))
    texts = chain.select("ckey", "ordinal", "pieces", "illegal", "roles", "texts", "first_initial").join(before, ["ckey", "ordinal"], "left")
    joint = F.when(F.col("before").isNotNull() & ~F.concat("before", "first_initial").isin(*LEGAL), 1).otherwise(0)
    cost = F.col("total") + F.when(F.col("ordinal") == 0, F.get("out", F.lit(START))).otherwise(0)
    open_ = texts.join(state.select("ckey", "ordinal", "codes", "last", "used", cost.alias("cost")), ["ckey", "ordinal"]).join(_entered(state), ["ckey", "ordinal"])

    def work(frames: Iterator) -> Iterator:
        import pandas as pd

        for frame in frames:
            out = []
            for r in frame.itertuples():
                vectors, _ = backward(r.codes, tuple(map(int, r.used)))
                letters, _ = trace(r.codes, vectors, r.entered, r.last)
                lines, faults = rewritten(list(r.roles), list(r.texts), letters, r.entered), _faults(r.codes)
                out.append((r.ckey, r.ordinal, r.pieces, *faults.values(), r.illegal, r.cost, "".join(letters), len(lines), "\n".join(lines)))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in _PIECE.split(", ")])

    columns = ["ckey", "ordinal", "pieces", "roles", "texts", "codes", "last", "used", "entered"]
    return whole.unionByName(open_.select(*columns, (F.col("illegal") + joint).alias("illegal"), "cost").mapInPandas(work, _PIECE))


def digests(pieces: DataFrame) -> DataFrame:
    """One row per conversation: faults and cost, the audit, and the digest of the repaired text.

    A digest runs over the whole text in order, so the pieces of one conversation pass one task, one after another.
    """
    names = ["blank", "duplicate", "truncated", "illegal", "cost"]
    single = pieces.where("pieces = 1").select("ckey", *names, "audit", F.sha2(F.col("repaired").cast("binary"), 256).alias("repaired_sha256"))

    def work(frames: Iterator) -> Iterator:
        import pandas as pd

        key, sums, audit, digest, lines = None, [0] * len(names), [], None, 0
        columns = ["ckey", *names, "audit", "repaired_sha256"]

        def row():
            return pd.DataFrame([(key, *sums, "".join(audit), digest.hexdigest())], columns=columns)

        for frame in frames:
            for r in frame.itertuples():
                if r.ckey != key:
                    if key is not None:
                        yield row()
                    key, sums, audit, digest, lines = r.ckey, [0] * len(names), [], hashlib.sha256(), 0
                sums = [a + getattr(r, b) for a, b in zip(sums, names, strict=True)]
                audit.append(r.audit)
                if r.n_lines:
                    digest.update((b"\n" if lines else b"") + r.repaired.encode())
                    lines += r.n_lines
        if key is not None:
            yield row()

    several = pieces.where("pieces > 1").repartition("ckey").sortWithinPartitions("ckey", "ordinal")
    return single.unionByName(several.mapInPandas(work, f"ckey string, {COUNTS}, cost long, audit string, repaired_sha256 string"))


def report(conversations: DataFrame, rows: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Every conversation of ``conversations`` with gaps of turns, faults, cost, audit and digest of ``rows``; zeros without rows."""
    turns = rows.groupBy(_key(F.col("conv_id")).alias("ckey")).agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    ids = conversations.select("conv_id").distinct().withColumn("ckey", _key(F.col("conv_id")))
    out = ids.join(turns, "ckey", "left").join(digests(repaired(rows, chunk_rows)), "ckey", "left")
    numbers = [F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    none = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(none)).alias("repaired_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    from cytolith.llm.common import read_table

    conversations = read_table(spark, sf_dir, "conversations")
    return report(conversations, damaged(conversations))
