"""When a model is asked, and what is made of its answers: questions leave under a key, answers are a table that joins back.

Nothing here calls a model. Equal questions have one key, so they are asked once; an answer is honoured only where it
keeps to what was asked (a name on the list offered, as many names as were sent), and only documents with an honoured
answer are worked again.

Cases: null lists are empty; null amounts ask nothing; documents without a question are not in the result; a key
without an answer, and a null or blank answer, change nothing; of several answers to one key the first by its text counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import looks_like_store_code

#: How many candidates make a question, how far a net may pass the total, the least names worth a batch, the share of them that can be corrected.
LEAST_CANDIDATES, OVER, LEAST_NAMES, SHARE = 2, "0.05", 3, 0.5


def wants_subtotal(net: Column, total: Column, n_items: Column, met: Column) -> Column:
    """Whether a net is doubtful: more than the total, or there are items and they do not add up to it. met: the target that the items met, null for none."""
    impossible = F.coalesce(net > total + F.lit(OVER).cast("decimal(4,2)"), F.lit(False))
    return net.isNotNull() & (impossible | ((F.coalesce(n_items, F.lit(0)) > 0) & ~F.coalesce(met == net, F.lit(False))))


def questions(documents: DataFrame) -> DataFrame:
    """documents(doc_id, vendors, addresses, net, total, n_items, met, semantics): doc_id, key, vendors, addresses (lists offered, empty where not asked), subtotal, semantics (whether asked)."""
    offered = lambda c: F.when(F.size(c) >= LEAST_CANDIDATES, F.col(c)).otherwise(F.array().cast("array<string>")).alias(c)
    asked = documents.select("doc_id", offered("vendors"), offered("addresses"), wants_subtotal(F.col("net"), F.col("total"), F.col("n_items"), F.col("met")).alias("subtotal"), F.coalesce("semantics", F.lit(False)).alias("semantics"), "net", "total")
    asked = asked.where((F.size("vendors") > 0) | (F.size("addresses") > 0) | F.col("subtotal") | F.col("semantics"))
    told = F.to_json(F.struct("vendors", "addresses", "semantics", "subtotal", F.when(F.col("subtotal"), F.col("net")).alias("net"), F.when(F.col("subtotal"), F.col("total")).alias("total")))
    return asked.select("doc_id", F.sha2(told, 256).alias("key"), "vendors", "addresses", "subtotal", "semantics")


def once(answers: DataFrame) -> DataFrame:
    """One answer for each key."""
    rest = [c for c in answers.columns if c != "key"]
    return answers.groupBy("key").agg(F.min(F.struct(*rest)).alias("a")).select("key", "a.*")


def honoured(asked: DataFrame, answers: DataFrame) -> DataFrame:
    """questions() with answers(key, vendor, address, subtotal as text): doc_id, vendor, address, subtotal where they keep to what was asked; documents without any are left out."""
    picked = lambda choice, of: F.when(F.array_contains(of, F.trim(choice)), F.trim(choice))
    both = asked.alias("q").join(once(answers).alias("a"), "key")
    out = both.select("doc_id", picked(F.col("vendor"), F.col("vendors")).alias("vendor"), picked(F.col("address"), F.col("addresses")).alias("address"), F.when(F.col("q.subtotal"), F.col("a.subtotal").try_cast("double")).alias("subtotal"))
    return out.where(F.coalesce("vendor", "address", F.col("subtotal").cast("string")).isNotNull())


def name_batches(items: DataFrame) -> DataFrame:
    """items(doc_id, ord, name): for documents worth it doc_id, key, names and their ords: names that are no store codes, at least three and at least half of all that are not blank."""
    rows = items.where(F.coalesce("name", F.lit("")) != "").withColumn("code", looks_like_store_code(F.col("name")))
    able = F.array_sort(F.collect_list(F.when(~F.col("code"), F.struct("ord", "name"))))
    per = rows.groupBy("doc_id").agg(able.alias("able"), F.count("*").alias("n"))
    per = per.where((F.size("able") >= LEAST_NAMES) & (F.size("able") >= SHARE * F.col("n")))
    names = F.transform("able", lambda x: x["name"])
    return per.select("doc_id", F.sha2(F.to_json(names), 256).alias("key"), names.alias("names"), F.transform("able", lambda x: x["ord"]).alias("ords"))


def renamed(items: DataFrame, batches: DataFrame, answers: DataFrame) -> DataFrame:
    """items with the names of answers(key, names): all of a batch's or none. A batch of another length is refused whole; an empty name, or one that differs in case only, leaves the item's."""
    both = batches.select("doc_id", "key", "ords").join(once(answers.select("key", "names")), "key").where(F.size("names") == F.size("ords"))
    new = both.select("doc_id", F.explode(F.arrays_zip("ords", "names")).alias("x")).select("doc_id", F.col("x.ords").alias("ord"), F.col("x.names").alias("given"))
    given = F.when((F.coalesce("given", F.lit("")) != "") & (F.lower("given") != F.lower("name")), F.col("given"))
    return items.join(new, ["doc_id", "ord"], "left").withColumn("name", F.coalesce(given, "name")).drop("given")
