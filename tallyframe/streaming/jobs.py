"""Jobs as an append-only log: the latest view, the state machine, and the streaming intake."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Which status may follow which.
NEXT = {"queued": ("processing", "rejected"), "processing": ("completed", "failed")}
LOG = "job_id bigint, seq bigint, status string, updated_at timestamp, patch map<string,string>"


def latest(log: DataFrame, key: str = "job_id") -> DataFrame:
    """Per job and key of its patches the value last written; the status and time of the last entry."""
    last = log.groupBy(key).agg(F.max_by("status", F.struct("updated_at", "seq")).alias("status"), F.max("updated_at").alias("updated_at"), F.min("updated_at").alias("created_at"))
    patches = log.select(key, "updated_at", "seq", F.explode("patch").alias("name", "value")).groupBy(key, "name").agg(F.max_by("value", F.struct("updated_at", "seq")).alias("value"))
    fields = patches.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("fields"))
    return last.join(fields, key, "left")


def broken_steps(log: DataFrame, key: str = "job_id") -> DataFrame:
    """Entries whose status may not follow the one before."""
    from pyspark.sql import Window

    before = F.lag("status").over(Window.partitionBy(key).orderBy("updated_at", "seq"))
    allowed = F.create_map(*[x for k, v in NEXT.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    fits = F.when(F.col("before").isNull(), F.col("status").isin("queued", "rejected")).otherwise(F.coalesce(F.array_contains(allowed[F.col("before")], F.col("status")), F.lit(False)))
    return log.withColumn("before", before).where(~fits)


def metrics(jobs: DataFrame, now: str) -> DataFrame:
    """Jobs in all and in the last 24 hours, mean time, success rate, how many wait."""
    recent = F.col("updated_at") >= F.lit(now).cast("timestamp") - F.expr("interval 24 hours")
    took = (F.unix_micros(F.col("updated_at").cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))) / 1000
    done = F.col("status").isin("completed", "failed")
    return jobs.agg(F.count("*").alias("jobs"), F.count_if(recent).alias("last_day"), F.avg(F.when(done, took)).alias("avg_ms"), F.try_divide(F.count_if(F.col("status") == "completed").cast("double"), F.count_if(done)).alias("success_rate"), F.count_if(F.col("status") == "queued").alias("queue_depth"))


def intake(requests: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Processes a stream of requests at least once: each micro-batch drops repeated job_ids, runs work and appends Parquet.

    Batches are written under their id, so a batch that runs again after a failure replaces what it wrote before.
    """

    def batch(df: DataFrame, number: int) -> None:
        work(df.dropDuplicates(["job_id"])).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return requests.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str = "ts", late: str = "10 minutes", size: str = "1 hour", by: str = "event_type") -> DataFrame:
    """Counts by window and kind with a watermark; the same plan in batch and in streaming."""
    return events.withWatermark(time, late).groupBy(F.window(time, size), by).agg(F.count("*").alias("n"))


def inserted(requests: DataFrame, now: str) -> DataFrame:
    """Requests as first entries of the log, stamped with the time they came in."""
    at = F.lit(now).cast("timestamp")
    return requests.withColumns({"status": F.lit("queued"), "seq": F.lit(0).cast("bigint"), "created_at": at, "updated_at": at})


def entry(log: DataFrame, job_id: int, key: str = "job_id") -> DataFrame:
    """One job's latest view; no row where there is none. The filter reaches the files."""
    return latest(log.where(F.col(key) == job_id), key)


def stored_vectors(rows: DataFrame) -> DataFrame:
    """Rows (receipt_id, source_service, receipt_text, embedding, created_at) that go to the store: blank texts do not, and failed embeddings (null) neither."""
    return rows.where((F.trim(F.coalesce("receipt_text", F.lit(""))) != "") & F.col("embedding").isNotNull())


def append_vectors(rows: DataFrame, path: str) -> None:
    stored_vectors(rows).withColumn("day", F.to_date("created_at")).write.mode("append").partitionBy("source_service", "day").parquet(path)


def seen_within(rows: DataFrame, key: list[str], time: str = "ts", days: int = 90) -> DataFrame:
    """rows with is_repeat: whether a row of the same key came within ``days`` before."""
    from pyspark.sql import Window

    before = F.lag(time).over(Window.partitionBy(*key).orderBy(time))
    return rows.withColumn("is_repeat", F.coalesce(before >= F.col(time) - F.make_dt_interval(F.lit(days)), F.lit(False)))


def lookback_verdicts(requests: DataFrame, store: DataFrame, now: str, path: str, checkpoint: str, **how) -> StreamingQuery:
    """A stream of requests (job_id, receipt_id, source_service, embedding) against the stored vectors of the look-back window: verdicts, batch by batch."""
    from ..operators.similarity import similar, verdicts

    return intake(requests, lambda batch: verdicts(batch, similar(batch, store, now, **how)), path, checkpoint)
