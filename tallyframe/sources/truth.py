"""Truth documents as VARIANT: a key that is missing, one that is null and one with a value are told apart, and keys that are not known are kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The keys of a truth document, and what stands for a missing one.
KNOWN = ("image", "source", "script", "print_type", "truth_source", "notes", "expect_manual_review", "expected", "expected_items", "unknown", "not_expected_values", "also_acceptable")
DEFAULTS = {"source": "real_sample", "script": "latin", "truth_source": "unspecified", "notes": ""}


def at(document: Column, *path: str) -> Column:
    """The variant at a path of keys, whatever is in them; SQL null where one is missing."""
    steps = "".join('["' + k.replace("\\", "\\\\").replace('"', '\\"') + '"]' for k in path)
    return F.try_variant_get(document, "$" + steps, "variant")


def presence(document: Column, *path: str) -> Column:
    """missing, null or value."""
    found = at(document, *path)
    return F.when(found.isNull(), "missing").when(F.is_variant_null(found), "null").otherwise("value")


def parsed(documents: DataFrame, text: str = "document") -> DataFrame:
    """documents with: v (the VARIANT, null for text that is no JSON), the known keys typed, with their defaults, and extra (key to JSON of the others; null without any)."""
    rows = documents.withColumn("v", F.try_parse_json(text))
    get = lambda k, kind: F.try_variant_get("v", f"$.{k}", kind)
    plain = {k: F.coalesce(get(k, "string"), F.lit(DEFAULTS[k])) if k in DEFAULTS else get(k, "string") for k in ("image", "source", "script", "print_type", "truth_source", "notes")}
    members = F.from_json(F.to_json("v"), "map<string,variant>")
    extra = F.transform_values(F.map_filter(members, lambda k, x: ~k.isin(*KNOWN)), lambda k, x: F.to_json(x))
    return rows.withColumns(plain | {
        "expect_manual_review": F.coalesce(get("expect_manual_review", "boolean"), F.lit(False)), "unknown": F.coalesce(get("unknown", "array<string>"), F.array().cast("array<string>")),
        "n_expected_items": F.when(presence(F.col("v"), "expected_items") == "value", F.size(get("expected_items", "array<variant>"))), "extra": F.when(F.size(extra) > 0, extra),
    })


def field_states(documents: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """parsed() documents, one row for each of the expected fields: field, state (missing, null, value; unknown where the document says so), value as text."""
    state = lambda f: F.when(F.array_contains("unknown", f), "unknown").otherwise(presence(F.col("v"), "expected", f))
    entry = lambda f: F.struct(F.lit(f).alias("field"), state(f).alias("state"), F.try_variant_get("v", f'$.expected["{f}"]', "string").alias("value"))
    return documents.select(*[c for c in documents.columns if c != "v"], F.explode(F.array(*map(entry, fields))).alias("f")).select("*", "f.*").drop("f")
