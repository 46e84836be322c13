"""Look-back duplicates: each row with the earlier rows of its key within a window, as one join on tables and on streams.

On streams both sides have watermarks and the join bounds their times, so each side's state holds the window and the
lateness, and what is older is dropped. Vectors are compared after the join, on the rows of one key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import cosine


def earlier_of_key(rows: DataFrame, stored: DataFrame, key: list[str], ident: str = "receipt_id", time: str = "ts", window: str = "90 days", late: str = "1 hour", vector: str | None = None, least: float = 0.85) -> DataFrame:
    """rows and stored (streams or tables, with ident, time and key): ident, time, earlier_id, earlier_time, and similarity where vectors are compared.

    A stored row counts if it is at most ``window`` older and not the row itself; of two rows of one time the one of the
    lower ident is the earlier. With a vector column only pairs of ``least`` cosine or more stay. Rows with a null in key
    or time meet nothing. Late rows count as far as the watermark lets them.
    """
    extra = [vector] if vector else []
    a = rows.select(ident, time, *key, *extra)
    b = stored.select(F.col(ident).alias("earlier_id"), F.col(time).alias("earlier_time"), *(F.col(k).alias(f"earlier_{k}") for k in key), *(F.col(v).alias("earlier_vector") for v in extra))
    if rows.isStreaming:
        a = a.withWatermark(time, late)
    if stored.isStreaming:
        b = b.withWatermark("earlier_time", late)
    same = F.lit(True)
    for k in key:
        same &= F.col(k) == F.col(f"earlier_{k}")
    span = (F.col("earlier_time") <= F.col(time)) & (F.col("earlier_time") >= F.col(time) - F.expr(f"interval {window}"))
    before = (F.col("earlier_time") < F.col(time)) | (F.col("earlier_id") < F.col(ident))
    both = a.join(b, same & span & before)
    out = [ident, time, "earlier_id", "earlier_time"]
    if not vector:
        return both.select(*out)
    return both.withColumn("similarity", cosine(F.col(vector), F.col("earlier_vector"))).where(F.col("similarity") >= least).select(*out, "similarity")
