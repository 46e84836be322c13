"""Money tokens as column expressions: digits, parsing by country, comparison within a tolerance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let
from .text import squeezed

#: Countries whose decimal mark is a dot, the tolerance of money comparisons, the amount patterns.
DOT_DECIMAL = ("PH", "US", "BN", "MY", "SG", "GB", "AU", "JP", "HK", "TH")
TOLERANCE = 0.02
STRICT = r"^[^\d]{0,3}(\d{1,3}(?:[,.\s]\d{3})*[.,]\d{1,2})[^\d]{0,3}$"
ANYWHERE = r"\d{1,3}(?:[,.\s]\d{3})*[,.]\d{2}\b|\b\d+[,.]\d{2}\b"


def digits_only(x: Column) -> Column:
    return F.regexp_replace(F.coalesce(x.cast("string"), F.lit("")), "[^0-9]+", "")


def normalize(raw: Column, country: Column | None = None) -> Column:
    """The amount a printed token stands for; null when it is none. Unknown countries use the decimal dot."""
    dot = F.lit(True) if country is None else country.isNull() | F.upper(country).isin(*DOT_DECIMAL)
    signed = lambda t: F.when(t.endswith("-") & ~t.startswith("-"), F.concat(F.lit("-"), F.regexp_replace(t, "-$", ""))).otherwise(t)

    def number(t: Column) -> Column:
        commas = F.when(t.rlike(r"^-?\d{1,3}(\.\d{3})*,\d{1,2}$") & ~dot, F.translate(F.translate(t, ".", ""), ",", ".")).when(t.rlike(r"^-?\d+,\d{2}$") & dot, F.translate(t, ",", ".")).otherwise(F.translate(t, ",", ""))
        plain = F.when(F.contains(t, F.lit(",")), commas).otherwise(t)
        return F.when(t.rlike("[0-9]"), F.round(plain.try_cast("decimal(28,10)"), 2).cast("decimal(18,2)"))

    return let(let(F.regexp_replace(raw.cast("string"), r"[^0-9.,\-]", ""), signed), number)


def close(a: Column, b: Column, tolerance: float = TOLERANCE) -> Column:
    return F.abs(a - b) <= F.lit(tolerance).cast("decimal(18,3)")


def plausible(token: Column) -> Column:
    """An amount has two to nine digits."""
    return F.length(digits_only(token)).between(2, 9)


def printed(token: Column) -> Column:
    """The amount inside a word that is nothing but an amount with up to three other characters at either end, else ''."""
    return F.regexp_extract(token, STRICT, 1)


#: An amount split in two words, and the word in front of its fraction.
SPLIT = r"(?<!\S)([^\d\s]{0,3}\d{1,7})\s([.,]\d{1,2}[^\d\s]{0,2})(?!\S)"


#: Fixed value: a word that is an amount of two to nine digits and up to three other characters at either end, or one that was split in two.
AMOUNT_WORD = r"(?<!\S)(?=(?:[^\d\s]*+\d){2,9}[^\d\s]*+(?!\S))(?:[^\d\s]{0,3}\d{1,3}(?:[,.]\d{3})*[.,]\d{1,2}[^\d\s]{0,3}|[^\s\u0001]*\u0001\S*)(?!\S)"


def words_of(line: Column) -> Column:
    """A line's words as (money, those that are amounts, and rest, the others); an amount that was split in two words is one.

    Two patterns over the line, and none where no digit follows a decimal mark: nothing is done word by word.
    """
    plain = lambda x: F.translate(x, "\u0001", "")

    def parted(joined: Column) -> Column:
        money = F.transform(F.regexp_extract_all(joined, F.lit(AMOUNT_WORD), F.lit(0)), plain)
        return F.struct(money.alias("money"), squeezed(plain(F.regexp_replace(joined, AMOUNT_WORD, ""))).alias("rest"))

    joined = F.when(line.rlike(r"[0-9]\s[.,][0-9]"), F.regexp_replace(line, SPLIT, "$1\u0001$2")).otherwise(line)
    none = F.struct(F.array().cast("array<string>").alias("money"), squeezed(plain(line)).alias("rest"))
    return F.when(line.rlike(r"[.,][0-9]"), let(joined, parted)).otherwise(none)


def money_of(words: Column) -> Column:
    return words["money"]


def rest_of(words: Column) -> Column:
    """The line without its amounts."""
    return F.coalesce(words["rest"], F.lit(""))


def number_or_null(x: Column) -> Column:
    return x.try_cast("double")


def clamped(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(x, F.lit(1.0)))


def whole_quantity(x: Column) -> Column:
    """A stated quantity as a whole number of at least 1, halves to even; 1 where it is no number."""
    return F.greatest(F.lit(1), F.coalesce(F.bround(x.try_cast("double"), 0).try_cast("int"), F.lit(1)))


def with_separators(x: Column) -> Column:
    return F.format_number(x, 2)


def stands_in(amount: Column, digits: Column) -> Column:
    """Whether an amount's digits, with two places or (if whole) without, are in a stream of digits."""
    c = F.round(F.abs(amount) * 100).cast("bigint")
    two = F.when(c < 100, F.lpad(c.cast("string"), 3, "0")).otherwise(c.cast("string"))
    whole = F.when(c % 100 == 0, (c / 100).cast("bigint").cast("string"))
    return F.contains(digits, two) | F.coalesce(F.contains(digits, whole), F.lit(False))
