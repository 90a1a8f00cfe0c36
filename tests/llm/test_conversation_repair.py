"""Repairs against a search that carries whole audits, and chunks of any size against each other."""

from __future__ import annotations

import hashlib
import itertools
import os
import random
import re
import zlib

import pytest

from cytolith.llm import conversation_repair as repair

SCHEMA = "conv_id long, turn long, role string, text string, ckey string, copies string, tie int"
SHAPE = re.compile(r"(s?(ua)+)?")


def moves(state, role):
    """State behind a role's initial, None where it may not stand."""
    return {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((state, role))


def brute(rows):
    """(cost, audit, lines) of the least audit among the cheapest; each row is (role, text, forced, truncated)."""
    best = {"0": (0, "", ()), "a": (0, "", ())}
    for at in range(len(rows), -1, -1):
        here = {}
        if at < len(rows):
            role, text, forced, truncated = rows[at]
            for state in "0sua":
                found = []
                if state in best:
                    cost, audit, lines = best[state]
                    found.append((3 + cost, "D" + audit, lines))
                if not forced:
                    for letter, price, as_role in [("K", 0, role), ("R", 2, "user"), ("R", 2, "assistant")]:
                        then = moves(state, as_role[:1])
                        if then in best:
                            cost, audit, lines = best[then]
                            found.append((price + truncated + cost, letter + audit, (f"{as_role}:{text}", *lines)))
                if found:
                    here[state] = min(found)
        else:
            here = dict(best)
        for _ in range(4):
            for state in "0sua":
                for name in ("user", "assistant"):
                    then = moves(state, name[0])
                    if then in here:
                        cost, audit, lines = here[then]
                        new = (2 + cost, "I" + audit, (f"{name}:", *lines))
                        here[state] = min(here.get(state, new), new)
        best = here
    return best["0"]


def faults(rows):
    """(role, text, forced, truncated) and the counts of faults of (role, text) rows."""
    seen, out, counts = set(), [], [0, 0, 0]
    for role, text in rows:
        last = re.sub(r"[\x20\x09-\x0D]", "", text)[-1:]
        kind = 0 if not last else 1 if (role, text) in seen else 2 if last not in ".!?" else 3
        if kind < 3:
            counts[kind] += 1
        if last:
            seen.add((role, text))
        out.append((role, text, kind < 2, kind == 2))
    return out, counts


def expected(rows):
    out, counts = faults(rows)
    cost, audit, lines = brute(out)
    illegal = sum((a[:1] + b[:1]) not in ("su", "ua", "au") for (a, _), (b, _) in itertools.pairwise(rows))
    return (*counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def test_brute_force_is_least_over_all_edits():
    r = random.Random(4)
    for _ in range(60):
        rows, _ = faults([(r.choice(["user", "assistant", "system", "tool"]), r.choice(["", "a.", "b", "c!"])) for _ in range(r.randrange(4))])
        found = []
        for inserts in itertools.product([(), ("u",), ("a",), ("u", "a"), ("a", "u")], repeat=len(rows) + 1):
            for letters in itertools.product("DKua", repeat=len(rows)):
                cost, audit, roles = 0, "", ""
                for at in range(len(rows) + 1):
                    cost, audit, roles = cost + 2 * len(inserts[at]), audit + "I" * len(inserts[at]), roles + "".join(inserts[at])
                    if at < len(rows):
                        role, _, forced, truncated = rows[at]
                        if forced and letters[at] != "D":
                            cost = 10**6
                        cost += 3 if letters[at] == "D" else truncated + (0 if letters[at] == "K" else 2)
                        audit += letters[at] if letters[at] in "DK" else "R"
                        roles += {"D": "", "K": role[0]}.get(letters[at], letters[at])
                if SHAPE.fullmatch(roles):
                    found.append((cost, audit))
        assert min(found) == brute(rows)[:2]


def made(n, seed, length=14):
    r = random.Random(seed)
    out = []
    for c in range(n):
        for t in range(r.randrange(length)):
            role = r.choice(["user", "assistant"] * 3 + ["system", "tool", None, "unknown", ""])
            out.append((c, t + r.choice([0, 0, 0, 1]) * 3, role, r.choice(["Hi.", "So?", "no end", "", " \t", None, "ça va!", f"x{r.randrange(9)}."])))
    return out


def ordered(rows, tie):
    return sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0, tie[x[2], x[3]], x[2], x[3]))


def ties(spark, pairs):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(sorted(pairs), "role string, text string")
    return {(x.role, x.text): x.tie for x in df.withColumn("tie", F.xxhash64("role", "text")).collect()}


def harm(rows):
    """Planted faults, as the contract words them."""
    out = []
    for conv, turn, role, text in rows:
        name = ":".join(" " if x is None else str(x) for x in (conv, turn))
        kind = zlib.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def whole(spark, rows):
    left, out = harm(rows), {}
    order = ties(spark, {x[2:] for x in left})
    for conv in {x[0] for x in rows}:
        mine = ordered([x for x in left if x[0] == conv], order)
        turns = [x[1] for x in mine if x[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *expected([x[2:] for x in mine]))
    return out


def run(spark, rows, chunk_rows):
    df = spark.createDataFrame([(*x, "k", "c", 1) for x in rows], SCHEMA).repartition(3)
    return {r[0]: tuple(r)[1:] for r in repair.report(df, repair.damaged(df), chunk_rows).collect()}


@pytest.mark.parametrize("chunk_rows", [1, 3, 128])
def test_chunks_of_any_size_give_the_same_repairs(spark, chunk_rows):
    rows = made(60, 1) + [(None, None, "user", "lost."), (None, 3, "assistant", "too."), (None, 3, "assistant", "too.")]
    rows += [(99, None, r, t) for r, t in [("user", "a."), ("assistant", "b.")]] + [(98, 4, "system", "only")]
    assert run(spark, rows, chunk_rows) == whole(spark, rows)


def test_one_long_conversation(spark):
    r = random.Random(7)
    rows = [(5, t // 2 if t > 400 else t, r.choice(["user", "assistant"]), r.choice(["yes.", "no end", f"t{t % 90}."])) for t in range(1500)] + [(6, 0, "user", "x.")]
    assert run(spark, rows, 40) == whole(spark, rows)


def test_vectors_that_never_run_alike():
    codes = bytes([repair.DUPLICATE] * 50)
    out, total = repair.backward(codes, repair.ACCEPTED)[0][-1], repair.backward(codes, repair.ACCEPTED)[1]
    again = repair.rerun(codes, repair.ACCEPTED, (2, 2, 0, 1), out, total)
    vectors, plain = repair.backward(codes, (2, 2, 0, 1))
    assert again == (vectors[-1], plain)


def test_empty_dropped_and_repeated(spark):
    assert run(spark, [], 4) == {}
    dropped = next(t for t in range(1000) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    assert run(spark, [(1, dropped, "user", "x.")], 4) == {1: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    same = [(2, 1, "user", "same.")] * 30
    assert run(spark, same, 4) == whole(spark, same)


def test_very_long_text(spark):
    rows = [(1, 0, "user", "word " * 300_000 + "."), (1, 1, "assistant", "x" * 2_000_000), (1, 2, "user", "b.")]
    assert run(spark, rows, 128) == whole(spark, rows)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the driver's tables are not here")
def test_query_equals_brute_force(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    assert {r[0]: tuple(r)[1:] for r in repair.query(spark, "/root/testdata/sf0.001").collect()} == whole(spark, [tuple(x) for x in table.collect()])
