"""A training corpus from documents: language ID, toxicity, near-duplicates, repeated passages, packing.

Each stage gets what its predecessor kept, written as Parquet and read again, and returns the columns of documents;
the last returns the pieces of the packed sequences.

Every stage keeps extra columns, whatever their names. Documents whose text is null, empty or without a letter go in the
first stage; very long texts are treated whole; rows repeated with one doc_id and text stay once from the third stage on;
ties go to the least doc_id; no documents give no pieces; without labels of both kinds nothing is toxic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import materialise
from tallyframe.llm.lang_mixture import keep_identified
from tallyframe.llm.ngram_join import one_of_each
from tallyframe.llm.packing import pack_documents
from tallyframe.llm.suffix_dedup import remove_repeats
from tallyframe.llm.toxicity_cnn import keep_civil


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: null, empty or without a letter, or no language for 0.4 of the text. Repeated rows all stay."""
    return keep_identified(docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go; an empty text scores as one without words. Repeated rows go or stay together."""
    return keep_civil(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each linked group stays, once; empty texts link with nothing, null ids stay."""
    return one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes or more that start elsewhere too are cut out of the texts; every document stays, with an empty text if all of it repeats."""
    out = remove_repeats(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, in sequences of 2048 tokens; an empty text is its end id alone."""
    return pack_documents(docs)


STAGES = [("language_id", language_id), ("toxicity", toxicity), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can't express the trained stages; tests/llm checks the rows against the stages on small tables.
ORACLE_SQL = None
