"""Booleans, missing labels, chromosome order and number texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words for true, false and missing in the input files.
TRUE_WORDS = ("true", "1", "yes", "y")
FALSE_WORDS = ("false", "0", "no", "n", "")
MISSING = ("", "NA", "NaN", "nan", "None")


def parse_bool(text: Column, true: tuple[str, ...] = TRUE_WORDS, false: tuple[str, ...] = FALSE_WORDS) -> Column:
    """True or false by word lists, any case, trimmed; other words are an error, null counts as empty."""
    word = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return F.when(word.isin(*true), True).when(word.isin(*false), False).otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), word)).cast("boolean"))


def try_bool(text: Column, true: tuple[str, ...] = TRUE_WORDS, false: tuple[str, ...] = FALSE_WORDS) -> Column:
    """As ``parse_bool``, null instead of an error."""
    word = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return F.when(word.isin(*true), True).when(word.isin(*false), False)


def clean_label(label: Column) -> Column:
    """Trimmed label, null where it stands for a missing value."""
    return F.when(~F.trim(label).isin(*MISSING), F.trim(label))


def chrom_key(chrom: Column, mitochondrial: bool = False) -> Column:
    """Sort key (class, number, name): chr1..chr22, X, Y, M if wanted, then all others by name."""
    name = F.regexp_replace(chrom, "^chr", "")
    number = F.when(name.rlike("^[0-9]{1,9}$"), name.try_cast("int")).when(name == "X", 23).when(name == "Y", 24)
    if mitochondrial:
        number = number.when(name == "M", 25)
    return F.struct(F.when(number.isNull(), 1).otherwise(0).alias("class"), F.coalesce(number, F.lit(0)).alias("number"), chrom.alias("name"))


# Names of the primary chromosomes.
def is_primary(chrom: Column, mitochondrial: bool = False) -> Column:
    return chrom.rlike("^chr([1-9]|1[0-9]|2[0-2]|X|Y|M)$" if mitochondrial else "^chr([1-9]|1[0-9]|2[0-2]|X|Y)$")


def number_or_na(value: Column, digits: int = 8) -> Column:
    """Fixed digits, ``NA`` for null."""
    return F.when(value.isNull(), "NA").otherwise(F.format_string(f"%.{digits}f", value))


def number_general(value: Column, digits: int = 6) -> Column:
    """A number as C's ``%.<digits>g`` writes it; ``NA`` for null, ``nan`` and ``inf`` by name.

    Digits come from one rounding to ``digits`` of them, halves away from zero by the shortest text of the number.
    """
    if digits < 1:
        raise ValueError(f"{digits} digits are no number")
    text = F.format_string(f"%.{digits - 1}e", F.abs(value))
    figures, exponent = F.replace(F.split_part(text, F.lit("e"), F.lit(1)), F.lit("."), F.lit("")), F.split_part(text, F.lit("e"), F.lit(2)).cast("int")
    whole = F.when(exponent >= 0, F.substring(figures, F.lit(1), exponent + 1)).otherwise("0")
    part = F.when(exponent >= 0, F.substring(figures, exponent + 2, F.lit(digits))).otherwise(F.concat(F.repeat(F.lit("0"), -exponent - 1), figures))
    power = F.concat(F.lit("e"), F.when(exponent < 0, "-").otherwise("+"), F.when(F.abs(exponent) < 10, F.concat(F.lit("0"), F.abs(exponent))).otherwise(F.abs(exponent).cast("string")))

    def joined(front: Column, behind: Column) -> Column:
        rest = F.rtrim(behind, F.lit("0"))
        return F.concat(front, F.when(rest == "", "").otherwise(F.concat(F.lit("."), rest)))

    scientific = F.concat(joined(F.substring(figures, 1, 1), F.substring(figures, 2, digits)), power)
    plain = F.when((exponent < -4) | (exponent >= digits), scientific).otherwise(joined(whole, part))
    sign = F.when(value < 0, "-").otherwise("")
    named = F.when(value.isNull(), "NA").when(F.isnan(value), "nan").when(F.abs(value) == float("inf"), F.concat(sign, F.lit("inf")))
    return named.otherwise(F.concat(sign, plain))


def parse_region(name: Column) -> list[Column]:
    """chrom, start, end of ``chr1:0-5000``, ``chr1_0_5000`` or ``chr1-0-5000``; null where it is none."""
    pattern = r"^(.+?)[:_-]([0-9]+)[_-]([0-9]+)$"
    parts = [F.nullif(F.regexp_extract(name, pattern, i), F.lit("")) for i in (1, 2, 3)]
    return [parts[0].alias("chrom"), parts[1].cast("long").alias("start_pos"), parts[2].cast("long").alias("end_pos")]
