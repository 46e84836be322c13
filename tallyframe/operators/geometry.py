"""Words and lines with their places on the page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bounds(points: Column) -> Column:
    """Struct (left, top, right, bottom), whole numbers, of a polygon's points [[x, y], ...]."""
    of = lambda k, f: f(F.transform(points, lambda p: F.get(p, F.lit(k)))).cast("int")
    return F.struct(of(0, F.array_min).alias("left"), of(1, F.array_min).alias("top"), of(0, F.array_max).alias("right"), of(1, F.array_max).alias("bottom"))


def normalised_words(words: DataFrame) -> DataFrame:
    """Raw words of an engine, confidence 0 to 100 with negatives for none: blank ones go, confidence becomes 0 to 1."""
    out = words.withColumn("text", F.trim("text")).where("text <> ''")
    return out.withColumn("confidence", F.greatest(F.col("confidence"), F.lit(0.0)) / 100)


def mean_confidence(words: DataFrame, *by: str) -> DataFrame:
    """The mean of the raw confidences that are not negative, 0 to 1; 0 without any."""
    known = F.when(F.col("confidence") >= 0, F.col("confidence"))
    exact = F.try_divide(F.sum(known.cast("decimal(18,6)")), F.count(known).cast("decimal(18,0)"))  # the sum of decimals is the same in any order
    return words.groupBy(*by).agg((F.coalesce(exact, F.lit(0)) / 100).cast("decimal(30,18)").alias("confidence"))


def placed(words: DataFrame) -> DataFrame:
    """words with right, bottom, center_y and line_key."""
    return words.withColumns({"right": F.col("left") + F.col("width"), "bottom": F.col("top") + F.col("height"), "center_y": F.col("top") + F.col("height") / 2, "line_key": F.struct("block", "par", "line")})


def spread_words(lines: DataFrame) -> DataFrame:
    """Lines whose words have no boxes of their own as words, placed by where their letters stand in the line's box.

    lines: doc_id, line, text, confidence, left, top, right, bottom; the result: doc_id, line, word_id, text, confidence, left, top, width, height.
    """
    text = F.trim("text")
    words = F.regexp_extract_all("t", F.lit(r"\S+"), F.lit(0))
    gaps = F.split("t", r"\S+")  # what stands before each word, and after the last
    rows = lines.withColumn("t", text).where("t <> ''").select("*", F.posexplode(words).alias("word_id", "word"), gaps.alias("gaps"), words.alias("all"))
    upto = lambda xs, n: F.aggregate(F.slice(xs, 1, n), F.lit(0), lambda a, x: a + F.length(x))
    start = upto(F.col("gaps"), F.col("word_id") + 1) + upto(F.col("all"), F.col("word_id"))
    width = F.greatest(F.lit(1), F.col("right") - F.col("left"))
    at = lambda n: (F.col("left") + F.bround(width * n / F.length("t"))).cast("int")
    rows = rows.withColumns({"l": at(start), "r": at(start + F.length("word"))})
    unit = F.greatest(F.lit(0.0), F.least("confidence", F.lit(1.0)))
    return rows.select("doc_id", "line", "word_id", F.col("word").alias("text"), unit.alias("confidence"), F.col("l").alias("left"), "top", F.greatest(F.lit(1), F.col("r") - F.col("l")).alias("width"), F.greatest(F.lit(1), F.col("bottom") - F.col("top")).alias("height"))


def label(engine: Column, variant: Column, psm: Column) -> Column:
    return F.concat(engine, F.lit("/"), variant, F.lit("/psm"), psm.cast("string"))


def segments(requests: DataFrame, least: int = 2, most: int = 4) -> DataFrame:
    """requests(doc_id, urls) of documents that come in several pictures: doc_id, segment, url, in order. Fewer than ``least`` or more than ``most`` urls are an error."""
    n = F.size("urls")
    checked = F.when(n.between(least, most), F.col("urls")).otherwise(F.raise_error(F.format_string(f"%d segments, {least} to {most} are allowed", n)).cast("array<string>"))
    return requests.select("doc_id", F.posexplode(checked).alias("segment", "url"))


def stitched(words: DataFrame, sizes: DataFrame) -> DataFrame:
    """Words of segments as words of one page, each segment below the ones before: words(doc_id, segment, top, ...), sizes(doc_id, segment, height)."""
    from pyspark.sql import Window

    before = Window.partitionBy("doc_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("doc_id", "segment", F.coalesce(F.sum("height").over(before), F.lit(0)).cast("int").alias("offset"))
    return words.join(offsets, ["doc_id", "segment"]).withColumn("top", F.col("top") + F.col("offset")).drop("offset")
