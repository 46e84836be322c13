"""Text tests and repairs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let


def squashed(x: Column) -> Column:
    """Lower case, with each run of white space as one space and none at the ends."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(x.cast("string"), F.lit(""))), r"\s+", " "))


def squeezed(x: Column, named: bool = False) -> Column:
    """Each run of white space as one space, and no spaces at the ends. named: x is a column of its own, which may be written out twice."""

    def plain(t: Column) -> Column:
        odd = F.contains(t, F.lit("  ")) | t.rlike(r"[\t\n\x0B\f\r]")
        return F.trim(F.when(odd, F.regexp_replace(t, r"\s+", " ")).otherwise(t))

    return plain(x) if named else let(x, plain)


def letters(x: Column) -> Column:
    # by what is left without the others: a count of matches makes a text of each
    return F.length(F.regexp_replace(x, r"\P{L}+", ""))


def looks_like_words(x: Column) -> Column:
    """Five letters or more that make up 0.6 of the text; two words of three letters, few with a capital inside."""

    def judged(t: Column) -> Column:
        solid = F.filter(t["tokens"], lambda w: F.length(w) >= 3)
        return let(F.struct(solid.alias("solid"), F.size(t["tokens"]).alias("tokens")), lambda u: _wordy(u["solid"], u["tokens"]))

    def told(s: Column) -> Column:
        tokens = F.regexp_extract_all(s, F.lit(r"[A-Za-z][A-Za-z.'&-]*"), F.lit(0))
        return let(letters(s), lambda n: (F.length(s) >= 5) & (n >= 5) & (n >= F.length(s) * 0.6)) & let(F.struct(tokens.alias("tokens")), judged)

    return let(F.trim(x), told)


def _wordy(solid: Column, tokens: Column) -> Column:
    few = (F.size(solid) == 1) & (F.length(F.get(solid, F.lit(0))) >= 4) & (tokens <= 2)
    odd = F.size(F.filter(solid, lambda t: t.rlike("[a-z][A-Z]")))
    return F.when(F.size(solid) < 2, few).otherwise(odd <= F.size(solid) * 0.34)


def bounded(x: Column, most: int = 6000, head: int = 3500, tail: int = 2500, mark: str = "\n...\n") -> Column:
    """A text of at most ``most`` characters as it is; a longer one as its head, a mark and its tail."""
    return F.when(F.length(x) <= most, x).otherwise(F.concat(F.substring(x, 1, head), F.lit(mark), F.right(x, F.lit(tail))))


def blank_to_null(x: Column, most: int = 255) -> Column:
    return F.nullif(F.substring(F.trim(x), 1, most), F.lit(""))


def nearest(word: Column, vocabulary: Column) -> Column:
    """The closest vocabulary word within 1 edit (2 from five letters on): (distance, word), ties alphabetical; null if none."""
    most = F.when(F.length(word) < 5, 1).otherwise(2)
    near = F.filter(F.transform(vocabulary, lambda v: F.struct(F.levenshtein(word, v).alias("d"), v.alias("w"))), lambda s: s["d"] <= most)
    return F.array_min(near)


def solid_tokens(x: Column, pattern: str) -> Column:
    return F.filter(F.regexp_extract_all(x, F.lit(pattern), F.lit(0)), lambda t: F.length(t) >= 3)


def looks_like_item_name(x: Column) -> Column:
    """Three letters or more that make up half of the text, and a word of four letters or two of three, few with a capital inside."""

    def words(solid: Column) -> Column:
        odd = F.size(F.filter(solid, lambda t: t.rlike("[a-z][A-Z]")))
        return ((F.size(solid) >= 2) | ((F.size(solid) == 1) & (F.length(F.get(solid, F.lit(0))) >= 4))) & (odd <= F.size(solid) * 0.5)

    enough = lambda s: let(letters(s), lambda n: (n >= 3) & (n >= F.length(s) * 0.5))
    return let(F.trim(x), lambda s: enough(s) & let(solid_tokens(s, r"[A-Za-z][A-Za-z.'&/-]*"), words))


def looks_like_store_code(x: Column) -> Column:
    """All capitals, with a word in which a capital follows a digit."""
    return x.rlike("[0-9][A-Z0-9]*[A-Z]") & (F.upper(x) == x)


def plausible_description(x: Column) -> Column:
    return let(letters(x), lambda n: (n >= 3) & (n >= F.length(x) * 0.4))


#: What is stripped from the ends of an item's name, its barcode, the longest name, the name of noise.
NAME_ENDS, BARCODE, LONGEST_NAME, UNREADABLE = " .,:;-*\\/", r"^\s*(?:\d{8,14}|[A-Za-z0-9]{2,6}\d{7,14})\s+", 255, "Unreadable item"


def clean_name(x: Column) -> Column:
    """An item's name without column rules, barcode and outer punctuation; '' without a letter."""
    unruled = let(x, lambda t: F.when(F.contains(t, F.lit("|")) | F.contains(t, F.lit("_")), F.regexp_replace(t, r"[|_]+", " ")).otherwise(t))
    s = F.btrim(squeezed(unruled), F.lit(NAME_ENDS))
    bare = let(s, lambda t: F.when(t.rlike(BARCODE), F.btrim(F.regexp_replace(t, BARCODE, ""), F.lit(NAME_ENDS))).otherwise(t))
    return let(bare, lambda t: F.when(t.rlike(r"\p{L}"), F.substring(t, 1, LONGEST_NAME)).otherwise(""))


def readable(x: Column, like_item: Column | None = None) -> Column:
    """The name, or the stand-in for one that could not be read. like_item: looks_like_item_name of it, where that is known."""
    return F.when(looks_like_item_name(x) if like_item is None else like_item, F.substring(x, 1, LONGEST_NAME)).otherwise(UNREADABLE)


#: The counts in front of, behind and instead of an item's name.
LEADING = r"^\s*(\d{1,3})\s*(?:x|pc|pcs|pieces)?\s+(?=\S)"
TRAILING = r"(?i)(?:\s+x\s*(\d{1,3})|\s+(\d{1,3}))\s*$"
COUNT_ONLY, COUNT_DIGITS = r"^\s*[0-9Il]{1,3}\s*[xX×]\s*$", r"^\s*(\d{1,3})\s*[xX×]\s*$"


def item_quantity(x: Column) -> Column:
    """The count in front of a name, else behind it; 1 without one, and at least 1."""
    number = lambda c: F.nullif(c, F.lit("")).cast("int")

    def found(t: Column) -> Column:
        ahead = F.when(t.rlike(r"^\s*[0-9]"), number(F.regexp_extract(t, LEADING, 1)))
        behind = F.when(t.rlike(r"[0-9]\s*$"), F.coalesce(number(F.regexp_extract(t, TRAILING, 1)), number(F.regexp_extract(t, TRAILING, 2))))
        return F.greatest(F.lit(1), F.coalesce(ahead, behind, F.lit(1)))

    return let(x, lambda t: F.when(t.isNotNull() & ~t.rlike(r"[0-9]"), 1).otherwise(found(t)))


def without_quantity(x: Column) -> Column:
    def bare(t: Column) -> Column:
        behind = F.when(t.rlike(r"[0-9]\s*$"), F.regexp_replace(t, TRAILING, "")).otherwise(t)
        return F.when(t.rlike(r"^\s*[0-9]"), F.when(t.rlike(LEADING), F.regexp_replace(t, LEADING, "")).otherwise(behind)).otherwise(behind)

    return let(x, lambda t: F.when(t.rlike(r"[0-9]"), bare(t)).otherwise(t))


def is_count_only(x: Column) -> Column:
    return x.rlike(COUNT_ONLY)


def count_only(x: Column) -> Column:
    """The count of a line that holds nothing else; 1 where its digits are misread."""
    return F.greatest(F.lit(1), F.coalesce(F.nullif(F.regexp_extract(x, COUNT_DIGITS, 1), F.lit("")).cast("int"), F.lit(1)))


#: The least mean confidence and share of words of a page that can be read, and scripts that are not read.
LEAST_CONFIDENCE, LEAST_WORDS = 0.45, 0.55
NON_LATIN = r"[぀-ヿ一-鿿฀-๿Ѐ-ӿ]"


def illegible(text: Column, confidence: Column) -> Column:
    """Blank, of low mean confidence (0 says nothing), or with few words among its tokens."""
    t = F.trim(F.coalesce(text, F.lit("")))
    share = F.regexp_count(t, F.lit("[A-Za-z]{2,}")) / F.regexp_count(t, F.lit(r"\S+"))
    low = F.coalesce((confidence != 0) & (confidence < LEAST_CONFIDENCE), F.lit(False))
    return F.when(~t.rlike(r"\S"), True).otherwise(low | (share < LEAST_WORDS))


def non_latin(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(NON_LATIN)
