"""The queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentencepiece_nbest import segment

    return segment(_table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import digest_removed

    return digest_removed(_table(spark, sf_dir, "documents"))


def op3_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_blocks import extract

    return extract(_table(spark, sf_dir, "pages"))


def op4_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fertility import judge

    return judge(_table(spark, sf_dir, "documents"))


def op5_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity_cnn import classify

    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"))


def op7_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .dac import read_segments, write_segments

    return read_segments(write_segments(_table(spark, sf_dir, "documents")))


def op8_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lang_mixture import identify_languages

    return identify_languages(_table(spark, sf_dir, "documents"))


def op9_itq_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .itq_dedup import near_classes

    return near_classes(_table(spark, sf_dir, "embeddings"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import jaccard_classes

    return jaccard_classes(_table(spark, sf_dir, "documents"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefix_trie import trie

    return trie(_table(spark, sf_dir, "conversations"))


def op12_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_bytes import score_quality

    return score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .turn_repair import repair

    return repair(_table(spark, sf_dir, "conversations"))


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    """Those that SQL can express."""
    from .conversation_sql import REPAIR, TRIE

    return {"op11_conversation_trie": TRIE, "op13_turn_repair": REPAIR}
