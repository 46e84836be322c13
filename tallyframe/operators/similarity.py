"""Near-duplicates of stored vectors within a look-back window, and the verdict on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import dot

#: The least cosine, the days looked back, the matches given.
THRESHOLD, DAYS, TOP = 0.85, 90, 10


def similar(queries: DataFrame, stored: DataFrame, now: str, threshold: float = THRESHOLD, days: int = DAYS, top: int = TOP, keep_self: bool = False) -> DataFrame:
    """queries and stored: receipt_id, source_service, embedding, stored with created_at too. The nearest of the same service.

    The join is an equi-join on the service; norms are computed once a row before it, the age filter reaches the scan,
    and the top rows are cut per query with a window, so a query set of any size runs at once.
    """
    unit = lambda df: df.withColumn("norm", F.sqrt(dot(F.col("embedding"), F.col("embedding")))).where("norm > 0")
    recent = unit(stored.where(F.col("created_at") >= F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(days))))
    q = unit(queries).select(F.col("receipt_id").alias("query_id"), "source_service", F.col("embedding").alias("q"), F.col("norm").alias("q_norm"))
    pairs = q.join(recent.select("receipt_id", "source_service", "embedding", "norm"), "source_service")
    if not keep_self:
        pairs = pairs.where("query_id <> receipt_id")
    pairs = pairs.withColumn("similarity", dot(F.col("q"), F.col("embedding")) / (F.col("q_norm") * F.col("norm"))).where(F.col("similarity") >= threshold)
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "receipt_id")
    return pairs.select("query_id", "receipt_id", "similarity").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def verdicts(queries: DataFrame, matches: DataFrame) -> DataFrame:
    """Per query: is_duplicate and the top similarity (null without a match)."""
    best = matches.groupBy("query_id").agg(F.max("similarity").alias("score"))
    return queries.select(F.col("receipt_id").alias("query_id")).join(best, "query_id", "left").select("query_id", F.col("score").isNotNull().alias("is_duplicate"), "score")
