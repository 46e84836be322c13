"""Misread words set right by the nearest word of a vocabulary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import let
from ..functions.text import looks_like_store_code

#: The confidences between which a word is corrected, the least length, from how many letters two edits may be made.
FROM, TO, LEAST, LONG = 0.5, 0.9, 3, 5
#: Deletions are made in so many letters at the front: the rest of a word needs none of its own to be found.
FRONT = 8


def bare(word: Column) -> Column:
    return F.lower(F.regexp_replace(word, r"[^\w\s]", ""))


def vocabulary(*words: DataFrame) -> DataFrame:
    """The distinct words, in lower case, of tables with a column word."""
    out = words[0].select(F.lower("word").alias("term"))
    for w in words[1:]:
        out = out.union(w.select(F.lower("word").alias("term")))
    return out.where("term <> ''").distinct()


def nearest_terms(words: DataFrame, terms: DataFrame) -> DataFrame:
    """word and term: for each distinct word that is no term the nearest one within 1 edit (2 from five letters on), ties alphabetical.

    Words meet terms on what is left of their fronts after up to two deletions: an edit is undone by deleting its letter
    on either side, so a word and a term within two edits share such a rest, whatever their lengths, and one rest is far
    rarer than one length. Whole words are compared only where rests meet. Only distinct words are looked up.
    """
    known = words.select("word").distinct().where(F.length("word") >= LEAST).join(terms, F.col("word") == F.col("term"), "left_anti")
    able = F.when(F.length("word") >= LONG, 2).otherwise(1)
    asked = known.withColumn("able", able).select("word", "able", F.explode(F.when(F.col("able") == 2, rests(F.col("word"), 2)).otherwise(rests(F.col("word"), 1))).alias("rest"))
    found = terms.select("term", F.explode(rests(F.col("term"), 2)).alias("rest"))
    near = asked.join(found, "rest").where(F.abs(F.length("word") - F.length("term")) <= F.col("able"))
    near = near.withColumn("edits", F.levenshtein("word", "term", 2)).where((F.col("edits") >= 0) & (F.col("edits") <= F.col("able")))
    return near.groupBy("word").agg(F.min(F.struct("edits", "term"))["term"].alias("term"))


def rests(word: Column, deletions: int) -> Column:
    """What is left of a word's front after up to so many deletions, each once."""
    without = lambda x: F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))

    def one(x: Column) -> Column:
        return F.when(F.length(x) > 0, without(x)).otherwise(F.array().cast("array<string>"))

    front = F.substring(word, 1, FRONT)
    if deletions == 1:
        return F.array_distinct(F.concat(F.array(front), one(front)))
    return let(one(front), lambda first: F.array_distinct(F.concat(F.array(front), first, F.flatten(F.transform(first, one)))))


def cased(word: Column, clean: Column, term: Column) -> Column:
    """The term in the word's case, with the punctuation that stood before and after it."""
    shown = F.when((F.upper(word) == word) & (F.lower(word) != word), F.upper(term)).when(F.initcap(word) == word, F.initcap(term)).otherwise(term)
    at = F.instr(F.lower(word), clean)
    return F.when(at > 0, F.concat(F.substring(word, F.lit(1), at - 1), shown, F.substring(word, at + F.length(clean), F.length(word)))).otherwise(shown)


def corrected(phrases: DataFrame, readings: DataFrame, terms: DataFrame) -> DataFrame:
    """phrases(doc_id, ord, phrase) with their words set right: doc_id, ord, corrected.

    readings(doc_id, text, confidence): the words as read; one that was read with a confidence outside the band stays,
    as does a phrase that is a store's code.
    """
    words = phrases.select("doc_id", "ord", "phrase", looks_like_store_code(F.col("phrase")).alias("code"), F.posexplode(F.split("phrase", r"\s+")).alias("n", "word"))
    words = words.withColumn("clean", bare(F.col("word")))
    least = readings.groupBy("doc_id", F.lower("text").alias("low")).agg(F.min("confidence").alias("confidence"))
    words = words.withColumn("low", F.lower("word")).join(least, ["doc_id", "low"], "left")
    near = nearest_terms(words.select(F.col("clean").alias("word")), terms).withColumnRenamed("word", "clean")
    words = words.join(near, "clean", "left")
    due = ~F.coalesce(F.col("code"), F.lit(False)) & F.col("term").isNotNull() & F.coalesce(F.col("confidence").between(FROM, TO), F.lit(True))
    words = words.withColumn("out", F.when(due, cased(F.col("word"), F.col("clean"), F.col("term"))).otherwise(F.col("word")))
    parts = F.array_sort(F.collect_list(F.struct("n", "out")))
    return words.groupBy("doc_id", "ord").agg(F.concat_ws(" ", parts.getField("out")).alias("corrected"))
