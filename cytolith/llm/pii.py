"""Personal data in texts, with built-in functions only.

Regular expressions propose spans, validators confirm them (Luhn for cards, mod-97 for
IBANs, ranges for addresses, digit counts), and words near a span adjust its score.
Positions are code points. A pattern is run twice by the engine: once for the matches
and once for the gaps between them; their lengths give the positions. The patterns are
written so that a search takes time in proportion to the text: a run that was tried from
its start is not tried again from its middle, and no quantifier gives back characters
that could not help.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytolith.llm.common import unused, whole_text

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban")

#: A match starts where the last one ended, or where no character of its first run stands before.
_LOCAL = "[A-Za-z0-9._%+-]"
#: Characters of an IBAN by country, as registered.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_REGISTERED = "|".join(rf"(?:{codes.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])" for n, codes in IBAN_LENGTHS.items())
#: Codes without a registered length take the longest run, which no registered number begins in.
_OTHER = rf"(?!{'|'.join(IBAN_LENGTHS.values()).replace(' ', '|')})[A-Z]{{2}}[0-9]{{2}}(?:[A-Z0-9]|\x20(?!{_REGISTERED})[A-Z0-9]){{11,30}}(?![A-Za-z0-9])"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{_REGISTERED}|{_OTHER})",
}
#: What a text must hold for a pattern to have a confirmed match; spares the two full searches.
NEEDS = {
    "email": r"[A-Za-z0-9._%+-]@[A-Za-z0-9-]++\.[A-Za-z0-9-]",
    "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]",
    "card": r"[0-9](?:[\x20-]?[0-9]){13}",
    "phone": r"\+[0-9](?:[\x20().-]*+[0-9]){9}",
    "iban": r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11}",
}
SCORES = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9}
#: Words in five languages that raise or lower a score when they stand, as words, within CONTEXT characters before or behind.
CONTEXT = 40
RAISING = {
    "email": r"e?-?mails?|contact\w*|write|kontakt\w*|correo|courriel|schreib\w*",
    "ip": r"ips?|address|host|server|adresse|login",
    "card": r"cards?|visa|credit|karte|carte|tarjeta|pay|payment|paid",
    "phone": r"phone|call|tel|mobile|fax|telefon|tel[eé]fono|appel\w*|llam\w*",
    "iban": r"iban|account|bank|konto|compte|cuenta",
}
LOWERING = r"version|isbn|order|serial|example|chapter|build"


def _stands(near: Column, words: str) -> Column:
    """Whether one of the words stands there by itself: ``tel`` does not in hotel, ``order`` not in border."""
    return near.rlike(rf"(?<![\p{{L}}\p{{N}}])(?:{words})(?![\p{{L}}\p{{N}}])")


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(hit: Column) -> Column:
    digits = _digits(hit)

    def add(total: Column, i: Column) -> Column:
        value = F.substring(digits, -i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + value - F.when(value > 9, 9).otherwise(0)

    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add)
    return F.length(digits).between(14, 19) & F.when(F.length(digits).between(14, 19), total % 10 == 0).otherwise(False)


def _octets(hit: Column) -> Column:
    return F.forall(F.split(hit, r"\."), lambda x: x.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def _mod97(hit: Column) -> Column:
    plain = F.replace(hit, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 1000), F.substring(plain, 1, 4))

    def add(rest: Column, i: Column) -> Column:
        code = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(code < 65, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


VALID: dict[str, Callable[[Column], Column]] = {
    "email": lambda hit: F.lit(True),
    "ip": _octets,
    "card": _luhn,
    "phone": lambda hit: F.length(_digits(hit)).between(10, 15),
    "iban": _mod97,
}

SPAN = "struct<start:int,rank:int,end:int,kind:string,score:double>"


def _spans(text: Column, kind: str) -> Column:
    """Confirmed spans of a kind in order, leftmost and non-overlapping; failed matches are not tried anew.

    The context of a span ends at the matches of its kind before and behind it.
    """
    pattern = PATTERNS[kind]
    gaps = F.split(text, pattern, -1)
    behind = F.transform(F.slice(gaps, F.lit(2), F.greatest(F.size(gaps) - 1, F.lit(0))), lambda gap: F.left(gap, F.lit(CONTEXT)))
    hits = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), behind, lambda hit, next: F.struct(hit.alias("hit"), next.alias("next")))
    parts = F.zip_with(gaps, hits, lambda gap, x: F.struct(gap.alias("gap"), x["hit"].alias("hit"), x["next"].alias("next")))

    def step(state: Column, part: Column) -> Column:
        start = state["at"] + F.length(part["gap"])
        end = start + F.coalesce(F.length(part["hit"]), F.lit(0))
        near = F.lower(F.concat(F.right(part["gap"], F.lit(CONTEXT)), F.lit("\n"), F.coalesce(part["next"], F.lit(""))))
        score = SCORES[kind] + F.when(_stands(near, RAISING[kind]), 0.1).otherwise(0.0) - F.when(_stands(near, LOWERING), 0.3).otherwise(0.0)
        span = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), F.round(score, 2).alias("score"))
        holds = part["hit"].isNotNull() & VALID[kind](part["hit"])
        return F.struct(end.alias("at"), F.when(holds, F.concat(state["found"], F.array(span.cast(SPAN)))).otherwise(state["found"]).alias("found"))

    none = F.array().cast(f"array<{SPAN}>")
    found = F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("found")), step, lambda state: state["found"])
    return F.when(text.rlike(NEEDS[kind]), found).otherwise(none)


def with_spans(df: DataFrame, text: str = "text", spans: str = "pii_spans") -> DataFrame:
    """``df`` and an array of all spans (start, rank, end, kind, score), by start, then kind as listed.

    start and end are code points of the whole text, end exclusive. A null or empty text
    has an empty array. Spans of different kinds may overlap. Rows are kept as they are.
    """
    each = reduce(F.concat, [_spans(whole_text(text), kind) for kind in KINDS])
    return df.withColumn(spans, F.array_sort(each))


def redact(df: DataFrame, text: str = "text", least_score: float = 0.0) -> DataFrame:
    """``df`` whose text has each span of at least the score replaced by its kind in brackets.

    Of overlapping spans the first names the replacement, which covers them all. Null
    texts stay null; texts without spans stay as they are.
    """
    whole = whole_text(text)
    held = unused(df, "__spans")
    found = with_spans(df, text, held)
    spans = F.filter(held, lambda s: s["score"] >= least_score)

    def step(state: Column, span: Column) -> Column:
        begins = span["start"] >= state["at"]
        gap = F.substring(whole, state["at"] + 1, span["start"] - state["at"])
        out = F.when(begins, F.concat(state["out"], F.array(gap, F.concat(F.lit("["), F.upper(span["kind"]), F.lit("]"))))).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], span["end"]).alias("at"), out.alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    built = F.aggregate(
        spans, start, step, lambda state: F.concat(F.array_join(state["out"], ""), F.substring(whole, state["at"] + 1, F.length(whole) - state["at"]))
    )
    return found.withColumn(text, F.when(F.size(spans) > 0, built).otherwise(F.col(text))).drop(held)


def report(df: DataFrame) -> DataFrame:
    """Counts per kind, a digest of the base spans and all spans as text, per row of (doc_id, text), repeated rows and null keys too; other columns are not read."""

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def of(kind: str) -> Column:
        return F.filter("pii_spans", lambda s: s["kind"] == kind)

    found = with_spans(df.select("doc_id", "text"))
    base = F.filter("pii_spans", lambda s: s["rank"] < len(BASE_KINDS))
    counts = [F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("pii_spans")).alias("spans"),
        F.coalesce(F.array_max(F.transform("pii_spans", lambda s: s["score"])), F.lit(0.0)).alias("top_score"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    from cytolith.llm.common import read_table

    return report(read_table(spark, sf_dir, "documents"))
