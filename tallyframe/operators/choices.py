"""Which reading, which page and which context to go on with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binding import let
from .locale import CURRENCY, EXCLUSIVE, INCLUSIVE, SYMBOLS
from .readings import is_enough

#: Currency codes, lines that state a total, places by country, the least certainty of a model's answer.
ISO = "AED ARS AUD BHD BND BRL CAD CHF CNY COP CZK DKK EGP EUR GBP HKD IDR ILS INR JPY KRW KWD MYR MXN NOK NZD PHP PLN QAR RUB SAR SEK SGD THB TRY TWD USD VND ZAR"
TOTAL_LINE = r"(?i)\b(?:total|grand total|amount due|balance due|net amount due|total sales)\b"
PLACES = (("philippines", "PH"), ("manila", "PH"), ("malaysia", "MY"), ("singapore", "SG"), ("brunei", "BN"), ("japan", "JP"), ("thailand", "TH"), ("hong kong", "HK"), ("australia", "AU"), ("united states", "US"), ("usa", "US"))
BASES, CERTAIN = ("inclusive", "exclusive", "unknown"), 0.75
ASKS = r"(?i)\b(?:vat|tax|gst|sst|inclusive|exclusive)\b|[₱€£฿$]"


def _first(df: DataFrame, *order: Column) -> DataFrame:
    return df.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order))).where("nth = 1").drop("nth")


def best_layout(scans: DataFrame) -> DataFrame:
    """Of scans(doc_id, reading, reconciled, labels, has_total) each document's first best: reconciled, then labels, then with a total."""
    return _first(scans, F.desc("reconciled"), F.desc("labels"), F.desc("has_total"), F.col("reading"))


def best_page(pages: DataFrame) -> DataFrame:
    """Of pages(doc_id, page, failed, reconciled, has_total, anchor) each document's first best; failed pages do not count."""
    return _first(pages.where(~F.col("failed")), F.desc("reconciled"), F.desc("has_total"), F.desc("anchor"), F.col("page"))


def read_further(pages: DataFrame) -> DataFrame:
    """Pages whose fast reading is not enough, for the full pool: anchors too weak, not reconciled, or no total."""
    enough = F.coalesce(is_enough(F.col("reconciled"), F.col("total"), F.col("anchor")), F.lit(False))
    return pages.withColumn("path", F.when(enough, "fast").otherwise("pooled"))


def symbol_currency(text: Column) -> Column:
    low = F.lower(text)
    return F.coalesce(*(F.when(F.regexp_like(low, F.lit(p)), c) for p, c in SYMBOLS))


def explicit_currency(text: Column) -> Column:
    """The currency that a total's line states, else any line: the first code (a company's Sdn. Bhd. is none), else a symbol."""

    def stated(x: Column) -> Column:
        plain = F.regexp_replace(x, r"(?i)\bsdn\.?\s*bhd\b", " ")
        code = F.upper(F.regexp_extract(plain, rf"(?i)\b({ISO.replace(' ', '|')})\b", 1))
        return F.coalesce(F.nullif(code, F.lit("")), symbol_currency(x))

    totals = F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit(TOTAL_LINE)))
    return F.coalesce(F.get(F.filter(F.transform(totals, stated), lambda c: c.isNotNull()), F.lit(0)), stated(text))


def resolve_locale(text: Column, detected: Column, country: Column, currency: Column, location: Column, model: Column) -> Column:
    """Struct (country, currency, score): what the caller says, then the receipt, then the country's currency, then a model. detected: struct of locale.detect."""
    place = F.coalesce(*(F.when(F.contains(F.lower(location), F.lit(m)), c) for m, c in PLACES))
    of = F.coalesce(F.nullif(F.upper(F.trim(country)), F.lit("")), place, detected["country"])
    table = F.create_map(*[F.lit(x) for kv in CURRENCY.items() for x in kv])
    score = F.when(F.coalesce(country, location).isNotNull(), F.greatest(detected["score"], F.lit(3.0))).otherwise(detected["score"])
    return F.struct(of.alias("country"), F.coalesce(currency, explicit_currency(text), table[of], detected["currency"], model).alias("currency"), score.alias("score"))


def evidence_list(value: Column) -> Column:
    """Evidence given as JSON text: a text as a list of one, a list as its trimmed entries that are not empty, else none."""
    # by its first letter, since a schema costs more than the value
    none, v = F.array().cast("array<string>"), F.try_parse_json(F.when(F.regexp_like(value, F.lit(r'^\s*["\[]')), value))
    rows = F.when(F.regexp_like(value, F.lit(r"^\s*\[")), F.coalesce(F.try_variant_get(v, "$", "array<string>"), none)).when(F.regexp_like(value, F.lit(r'^\s*"')), F.coalesce(F.array_compact(F.array(F.try_variant_get(v, "$", "string"))), none)).otherwise(none)
    return F.filter(F.transform(rows, lambda x: F.trim(x)), lambda x: x != "")


def parse_object(answer: Column) -> Column:
    """The JSON object of an answer as a variant: all of it, else from the first brace to the last; null if it is no object."""
    # what begins with a brace is an object if it can be parsed; what does not is no object, and a failed parse costs an exception
    whole = F.try_parse_json(F.when(F.regexp_like(answer, F.lit(r"^\s*\{")), answer))
    return F.coalesce(whole, F.try_parse_json(F.nullif(F.regexp_extract(answer, r"(?s)\{.*\}", 0), F.lit(""))))


def validated_semantics(answer: Column, text: Column) -> Column:
    """Struct (tax_basis, confidence, currency, currency_confidence): a model's opinion, kept where it is certain and all its evidence stands in the text."""
    return let(F.struct(parse_object(answer).alias("v"), text.alias("text")), lambda t: _validated(t["v"], t["text"]))


def _validated(v: Column, text: Column) -> Column:
    get = lambda *names: F.coalesce(*(F.try_variant_get(v, f"$.{n}", "string") for n in names))
    listed = lambda *names: evidence_list(F.coalesce(*(F.to_json(F.try_variant_get(v, f"$.{n}", "variant")) for n in names)))
    low = F.lower(text)
    shown = lambda items: let(items, lambda xs: F.coalesce((F.size(xs) > 0) & F.forall(xs, lambda x: F.contains(low, F.lower(x))), F.lit(False)))
    sure = lambda *names: F.coalesce(get(*names).try_cast("double"), F.lit(0.0))
    basis, code = F.lower(F.trim(get("tax_basis"))), F.upper(F.trim(get("currency")))
    b_sure, c_sure = sure("tax_basis_confidence", "confidence"), sure("currency_confidence", "confidence")
    b_ok = F.coalesce(basis.isin("inclusive", "exclusive"), F.lit(False)) & (b_sure >= CERTAIN) & shown(listed("tax_basis_evidence", "evidence"))
    c_ok = F.coalesce(code.isin(*ISO.split()), F.lit(False)) & (c_sure >= CERTAIN) & shown(listed("currency_evidence", "evidence"))
    unit = lambda ok, x: F.when(ok, F.least(x, F.lit(1.0))).otherwise(0.0)
    # an answer that was unknown from the start keeps its certainty
    b_keep, c_keep = b_ok | F.coalesce(~basis.isin("inclusive", "exclusive"), F.lit(True)), c_ok | F.coalesce(~code.isin(*ISO.split()), F.lit(True))
    clamp = lambda x: F.greatest(F.lit(0.0), F.least(x, F.lit(1.0)))
    return F.when(v.isNotNull(), F.struct(F.when(b_ok, basis).otherwise("unknown").alias("tax_basis"), F.when(b_keep, clamp(b_sure)).otherwise(0.0).alias("confidence"), F.when(c_ok, code).otherwise("unknown").alias("currency"), F.when(c_keep, clamp(c_sure)).otherwise(0.0).alias("currency_confidence")))


def semantics_asked(text: Column, ambiguous: Column) -> Column:
    """Whether a model's opinion on taxes and currency is worth having."""
    return ambiguous | F.regexp_like(text, F.lit(ASKS))


def printed_exclusive(text: Column, net: Column, tax: Column, service: Column, total: Column, derived: Column) -> Column:
    """Whether printed amounts show that tax comes on top, against which no opinion stands: net, tax and service make the total, none of them derived, and no wording says otherwise."""
    low = F.lower(text)
    says = F.regexp_like(low, F.lit(INCLUSIVE))
    adds = F.abs(net + tax + F.coalesce(service, F.lit(0).cast("decimal(18,2)")) - total) <= F.lit("0.02").cast("decimal(18,2)")
    return F.coalesce(~says & ~F.arrays_overlap(derived, F.array(F.lit("net_sales"), F.lit("tax_amount"), F.lit("total_amount"))) & adds, F.lit(False))


__all__ = ["BASES", "EXCLUSIVE", "best_layout", "best_page", "evidence_list", "explicit_currency", "parse_object", "printed_exclusive", "read_further", "resolve_locale", "semantics_asked", "symbol_currency", "validated_semantics"]
