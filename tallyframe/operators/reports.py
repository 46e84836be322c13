"""Reports over many documents: items, recoverable fields, variants, gates, generated corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fields, how strict the gate on each is, whether it is read off the page; the gates.
SPECS = (
    ("vendor_name", "standard", True), ("country", "standard", False), ("currency", "standard", False), ("vendor_tax_id", "critical", True), ("vendor_tax_id_type", "standard", False),
    ("transaction_date", "critical", True), ("net_sales", "standard", True), ("tax_amount", "standard", True), ("tax_type", "standard", False), ("tax_rate", "untracked", False),
    ("total_sales", "standard", True), ("service_charge", "standard", True), ("total_amount", "critical", True), ("vat_classification", "standard", False), ("invoice_number", "standard", True), ("expense_category", "untracked", False),
)
GATES = {"critical": 0.95, "standard": 0.90}
UNREADABLE = "Unreadable item"


def specs(spark) -> DataFrame:
    return spark.createDataFrame(SPECS, "field string, gate string, transcribed boolean")


def scored_fields(truth: DataFrame) -> DataFrame:
    """truth(doc_id, expected map, unknown array): doc_id, field, value of the fields that are known and not left out."""
    rows = truth.select("doc_id", F.coalesce("unknown", F.array().cast("array<string>")).alias("unknown"), F.explode("expected").alias("field", "value"))
    return rows.where(~F.array_contains("unknown", F.col("field"))).drop("unknown")


def item_tallies(documents: DataFrame, matched: DataFrame) -> DataFrame:
    """One row. documents(doc_id, expected, produced, reconciled): numbers of rows; matched(doc_id, quantity_ok, price_ok, name, alike)."""
    d = documents.where("expected > 0").agg(
        F.count("*").alias("receipts"), F.sum("expected").alias("expected_rows"), F.count_if(F.col("expected") == F.col("produced")).alias("row_count_exact"), F.count_if("reconciled").alias("reconciled_receipts"), F.count_if(F.col("produced") == 0).alias("suppressed_receipts")
    )
    unreadable = F.col("name") == UNREADABLE
    m = matched.agg(F.count("*").alias("matched_rows"), F.count_if("quantity_ok").alias("quantity_correct"), F.count_if("price_ok").alias("price_correct"), F.count_if(unreadable).alias("name_unreadable"), F.count_if(~unreadable & F.col("alike")).alias("name_correct"))
    both = d.join(F.broadcast(m))  # one row each
    share = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b))
    return both.select("*", share("row_count_exact", "receipts").alias("row_count_accuracy"), share("matched_rows", "expected_rows").alias("recall"), share("quantity_correct", "matched_rows").alias("quantity_accuracy"), share("price_correct", "matched_rows").alias("price_accuracy"), share("name_correct", "matched_rows").alias("name_accuracy"), share("reconciled_receipts", "receipts").alias("reconcile_rate"))


def recoverability(rows: DataFrame) -> DataFrame:
    """rows(doc_id, print_type, field, present): per document, per print type and over all (nulls) how many fields can be read."""
    each = rows.groupBy("doc_id", "print_type").agg(F.count_if("present").alias("recoverable"), F.count("*").alias("total"))
    return each.rollup("print_type", "doc_id").agg(F.sum("recoverable").alias("recoverable"), F.sum("total").alias("total"))


def variant_sweep(rows: DataFrame, variants: list[str]) -> DataFrame:
    """rows(doc_id, variant, field, present): per document the fields each variant has, and those that any has."""
    wide = rows.groupBy("doc_id").pivot("variant", variants).agg(F.count_if("present"))
    best = rows.where("present").groupBy("doc_id").agg(F.size(F.collect_set("field")).alias("best_of"))
    return wide.join(best, "doc_id", "left").na.fill(0)


def gated(tallies: DataFrame, gates: DataFrame) -> DataFrame:
    """tallies(field, scored, passed) with the gate of each field and whether it is met; null where there is none or nothing was scored."""
    least = F.create_map(*[F.lit(x) for kv in GATES.items() for x in kv])[F.col("gate")]
    return gates.join(tallies, "field", "left").select("field", "gate", "scored", "passed", (F.try_divide(F.col("passed").cast("double"), F.col("scored")) >= least).alias("met"))


def composite(confidence: Column, total: Column, country: Column, valid: Column) -> Column:
    """The score of old: weights of certainty, a total, valid tax data and a country."""
    has = lambda c: c.isNotNull().cast("double")
    return F.round(0.30 * F.greatest(F.lit(0.0), F.least(confidence, F.lit(1.0))) + 0.35 * has(total) + 0.25 * valid.cast("double") + 0.10 * has(country), 4)


def chosen(fixtures: DataFrame, corpus: str | None = None, names: list[str] | None = None, most: int | None = None) -> DataFrame:
    """fixtures(corpus, name, exists) of a corpus, of some names, the first by name; absent ones stay out."""
    out = fixtures.where("exists")
    out = out if corpus is None else out.where(F.col("corpus") == corpus)
    out = out if names is None else out.where(F.col("name").isin(names))
    return out if most is None else out.orderBy("name").limit(most)
