"""What comes in and goes out: requests, callbacks, audit records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import clamped, whole_quantity
from ..functions.text import blank_to_null
from .category import coerce
from .choices import ISO

#: What the receiver accepts.
CURRENCIES = ("PHP", "USD", "BND", "MYR", "SGD", "JPY", "HKD", "THB", "AUD", "GBP", "EUR")
STATUSES = ("unresolved", "reconciled", "computed", "reported", "reported_conflict", "computed_conflict")
OPTIONAL = ("tax_basis", "financial_reconciliation_status", "needs_manual_review")
TOP = 5


def request(country: Column, currency: Column, location: Column) -> Column:
    """Struct (country, currency, location) of a request, null where it makes no sense."""
    c, code = F.upper(F.trim(country)), F.upper(F.trim(currency))
    return F.struct(F.when(c.rlike(r"^\p{L}{2}$"), c).alias("country"), F.when(code.isin(*ISO.split()), code).alias("currency"), F.nullif(F.trim(location), F.lit("")).alias("location"))


def valid_items(items: Column) -> Column:
    """items(name, quantity, price as text) that can be sent; a line that cannot goes alone."""
    price = lambda x: x["price"].try_cast("double")
    kept = F.filter(items, lambda x: price(x).isNotNull() & (price(x) >= 0))
    name = lambda x: F.substring(F.coalesce(F.nullif(x["name"], F.lit("")), F.lit("item")), 1, 255)
    return F.transform(kept, lambda x: F.struct(name(x).alias("name"), whole_quantity(x["quantity"]).alias("quantity"), price(x).alias("price")))


def callback(fields: Column, confidence: Column, duplicate: Column, similarity: Column, semantic: Column) -> Column:
    """The payload as a map of texts; the optional keys only where a model gave them, and no key with null among these.

    fields: map of texts by field name; semantic: whether the tax semantics come from a model.
    """
    one_of = lambda x, allowed: F.when(x.isin(*allowed), x)
    code = F.upper(F.trim(fields["currency"]))
    plain = F.map_from_arrays(
        F.array(*map(F.lit, ("vendor_name", "transaction_date", "total_amount", "vat_amount", "tin", "invoice_number", "vat_classification", "currency", "expense_category", "location", "ocr_confidence_score", "is_duplicate", "duplicate_similarity", "status", "rejection_code"))),
        F.array(
            blank_to_null(fields["vendor_name"]), fields["transaction_date"], fields["total_amount"], fields["tax_amount"], blank_to_null(fields["vendor_tax_id"]), blank_to_null(fields["invoice_number"]),
            one_of(fields["vat_classification"], ("vat", "non-vat")), one_of(code, CURRENCIES), F.when(F.coalesce(fields["expense_category"], F.lit("")) != "", coerce(fields["expense_category"])), blank_to_null(fields["location"]),
            F.round(clamped(confidence), 4).cast("string"), duplicate.cast("string"), F.round(similarity, 4).cast("string"), F.when(duplicate, "rejected").otherwise("completed"), F.when(duplicate, "duplicate"),
        ),
    )
    extra = F.map_from_arrays(F.array(*map(F.lit, OPTIONAL)), F.array(one_of(fields["tax_basis"], ("inclusive", "exclusive", "unknown")), one_of(fields["financial_reconciliation_status"], STATUSES), fields["needs_manual_review"]))
    extra = F.map_filter(extra, lambda k, v: v.isNotNull() & semantic)
    return F.map_concat(plain, extra)


def evidence(df: DataFrame) -> DataFrame:
    """doc_id, evidence: what each value was read from, in words, for the values that have one.

    df: doc_id, tax_id_role, tax_id_line, date_raw, date_score, number_line, address, vendor_method, shortlist, category_method (null where there is none).
    """
    say = lambda pattern, *c: F.when(F.coalesce(*(x.isNull() for x in c)) | c[0].isNull(), None).otherwise(F.format_string(pattern, *c))
    told = {
        "vendor_tax_id": say("role=%s line=%d", F.col("tax_id_role"), F.col("tax_id_line")), "transaction_date": say("'%s' score=%.2f", F.col("date_raw"), F.col("date_score")), "invoice_number": F.col("number_line"),
        "location": F.col("address"), "vendor_name": say("%s from [%s]", F.col("vendor_method"), F.concat_ws(", ", F.slice("shortlist", 1, 3))), "expense_category": F.col("category_method"),
    }
    whole = F.map_from_arrays(F.array(*map(F.lit, told)), F.array(*told.values()))
    return df.select("doc_id", F.map_filter(whole, lambda k, v: v.isNotNull()).alias("evidence"))


def selection(ranked: DataFrame) -> DataFrame:
    """Per document of ranked readings (rank, anchor, confidence, engine, variant, psm): the primary, its margin to the runner-up, the best TOP candidates, how many there were."""
    label = F.concat_ws("/", "engine", "variant", F.concat(F.lit("psm"), F.col("psm").cast("string")))
    first = lambda c: F.min_by(c, "rank")
    best = F.slice(F.array_sort(F.collect_list(F.when(F.col("rank") <= TOP, F.struct("rank", label.alias("label"), F.round("anchor", 4).alias("anchor"))))), 1, TOP)
    second = F.max(F.when(F.col("rank") == 2, F.col("anchor")))
    return ranked.groupBy("doc_id").agg(first(label).alias("label"), F.round(F.coalesce(first("anchor") - second, F.lit(0.0)), 4).alias("margin"), best.alias("top"), F.count("*").alias("candidates"))


def audit(df: DataFrame) -> DataFrame:
    """doc_id, document: what was decided and why, as JSON. df: a row of the receipt plan (plans.receipts.extract) joined to a row of selection()."""
    part = lambda *names: F.struct(*names)
    doc = F.struct(
        part(F.col("label").alias("reading"), F.col("margin").alias("selection_margin"), F.col("candidates").alias("candidates_evaluated"), F.col("top").alias("candidate_summary")).alias("ocr_selection"),
        part((F.size("reasons") > 0).alias("needs_manual_review"), F.col("reasons").alias("review_reasons")).alias("verification"),
        part("reconciled", F.col("basis").alias("tax_basis"), F.col("status").alias("financial_reconciliation_status"), "tax_breakdown").alias("reconciliation"),
        part("country", "currency").alias("locale"), F.col("score").alias("composite_confidence_score"),
    )
    return df.select("doc_id", F.to_json(doc).alias("document"))
