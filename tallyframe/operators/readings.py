"""Competing readings of a document: ranking, support, pooled lines, agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Supporting readings, their least share of the primary's score, anchors that make a fast reading enough.
SUPPORT, SHARE, ENOUGH = 3, 0.5, 6.0


def ranked(readings: DataFrame, key: str = "doc_id", ident: str = "reading_id") -> DataFrame:
    """Readings with text, best first: anchor, confidence, length, then the first read. Adds rank and margin to the next."""
    w = Window.partitionBy(key).orderBy(F.desc("anchor"), F.desc("confidence"), F.desc(F.length("text")), ident)
    out = readings.where(F.trim("text") != "")
    return out.withColumns({"rank": F.row_number().over(w), "margin": F.round(F.col("anchor") - F.lead("anchor").over(w), 4)})


def with_support(readings: DataFrame, key: str = "doc_id", ident: str = "reading_id") -> DataFrame:
    """Roles: primary, up to SUPPORT readings of other texts with half the primary's score (unseen variants first), other."""
    r = ranked(readings, key, ident)
    best = Window.partitionBy(key)
    r = r.withColumns({"top": F.max("anchor").over(best), "primary_text": F.max(F.when(F.col("rank") == 1, F.col("text"))).over(best), "primary_variant": F.max(F.when(F.col("rank") == 1, F.col("variant"))).over(best)})
    r = r.withColumn("first_of_text", F.row_number().over(Window.partitionBy(key, "text").orderBy("rank")) == 1)
    can = (F.col("rank") > 1) & F.col("first_of_text") & (F.col("text") != F.col("primary_text")) & (F.col("anchor") >= SHARE * F.col("top"))
    r = r.withColumn("can", can)
    r = r.withColumn("new_variant", F.col("can") & (F.col("variant") != F.col("primary_variant")) & (F.row_number().over(Window.partitionBy(key, "variant", "can").orderBy("rank")) == 1))
    order = Window.partitionBy(key, "can").orderBy(F.desc(F.col("new_variant").cast("int")), "rank")
    r = r.withColumn("support_rank", F.when(F.col("can"), F.row_number().over(order)))
    role = F.when(F.col("rank") == 1, "primary").when(F.col("support_rank") <= SUPPORT, "support").otherwise("other")
    return r.withColumn("role", role).drop("top", "primary_text", "primary_variant", "first_of_text", "can", "new_variant")


def pooled_lines(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Lines of all readings, each (without regard to case) once, in the order first met: rank, line_no."""
    low = F.lower(F.trim("text"))
    w = Window.partitionBy(key, low).orderBy("rank", "line_no")
    return lines.where(low != "").withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def line_meta(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per line text: where it first stands, its highest confidence, how many readings have it."""
    return lines.groupBy(key, F.lower(F.trim("text")).alias("line")).agg(F.min("line_no").alias("first_line"), F.max("confidence").alias("confidence"), F.count("*").alias("occurrences"))


def combined_text(readings: DataFrame, key: str = "doc_id") -> DataFrame:
    """Texts of the primary and its support, each once, primary first, a line break between."""
    r = with_support(readings, key).where("role <> 'other'")
    order = F.array_sort(F.collect_list(F.struct(F.when(F.col("role") == "primary", 0).otherwise(F.col("support_rank")).alias("o"), "text")))
    return r.groupBy(key).agg(order.alias("t")).select(key, F.concat_ws("\n", F.transform("t", lambda x: x["text"])).alias("combined"))


def agreement(readings: DataFrame, tokens: DataFrame, key: str = "doc_id") -> DataFrame:
    """How many of a document's readings contain each token."""
    both = tokens.join(readings.select(key, "text"), key)
    return both.groupBy(key, "token").agg(F.count_if(F.contains("text", F.col("token"))).alias("readings"))


def is_enough(reconciled: Column, total: Column, anchor: Column) -> Column:
    """A fast reading is enough when its anchors reach ENOUGH, its money reconciles and it has a total."""
    return (anchor >= ENOUGH) & reconciled & total.isNotNull()


def lines_at(pages: Column) -> Column:
    """Of a document's pages, an array of (reading, lines), each text once: (text, at: where it stands, as (reading, line_no)).

    Lines are first looked up at their own place in the first page, where most of them are.
    """
    first = F.get(pages, F.lit(0))["lines"]
    place = lambda p, n: F.struct(p["reading"].alias("reading"), n.alias("line_no"))
    same = lambda p, n, t: F.coalesce(F.get(p["lines"], n) == t, F.lit(False))
    shared = F.transform(first, lambda t, n: F.struct(t.alias("text"), F.transform(F.filter(pages, lambda p, i: (i == 0) | same(p, n, t)), lambda p: place(p, n)).alias("at")))
    differ = lambda p, i: F.filter(F.transform(p["lines"], lambda t, n: F.when((i > 0) & ~F.coalesce(F.get(first, n) == t, F.lit(False)), F.struct(t.alias("text"), F.array(place(p, n)).alias("at")))), lambda x: x.isNotNull())
    return F.concat(shared, F.flatten(F.transform(pages, differ)))
