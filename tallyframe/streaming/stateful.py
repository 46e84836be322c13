"""Jobs as keyed state: retries with back-off and time limits, and the latest view of each job with illegal steps turned away.

Each has a stateful operator for streams (``transformWithStateInPandas``; it needs the RocksDB state store, see
``use_rocksdb``) and the same rules as one aggregate a job for tables. State is small: a job's place in its retries, or
its fields; timers and times to live remove it, so it does not grow with the stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from .jobs import NEXT

#: Retries after the first attempt, the seconds of the first wait (the next ones are twice and three times that), the longest run.
RETRIES, BACK_OFF_S, LIMIT_S = 3, 10, 3600
_S = 1_000_000

RESULTS = "job_id bigint, attempt int, ts timestamp, ok boolean, took_us bigint"
OUTCOMES = "job_id bigint, attempt int, status string, at_us bigint, reason string"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def wait_us(attempt: int) -> int:
    return BACK_OFF_S * (attempt + 1) * _S


class Retries(StatefulProcessor):
    """One job's attempts in their order, whatever the order of their messages; a message that comes again says nothing new.

    A failed attempt is due again 10, 20 and 30 seconds after it ended, the fourth failure is final; an attempt that runs
    over the limit, or whose message has not come when the limit after its due time has passed, fails the job.
    """

    def init(self, handle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "attempt int, due_us bigint, ended boolean")
        self.waiting = handle.getMapState("waiting", "attempt int", "at_us bigint, ok boolean, took_us bigint")

    def _timer(self, at_us: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(-(-(at_us + LIMIT_S * _S) // 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        attempt, due, ended = self.job.get() if self.job.exists() else (0, None, False)
        out, latest = [], None
        for pdf in rows:
            for r in pdf.sort_values("ts").itertuples(index=False):
                at = int(pd.Timestamp(r.ts).value // 1000)
                latest = at if latest is None else max(latest, at)
                if not ended and r.attempt >= attempt and not self.waiting.containsKey((int(r.attempt),)):
                    self.waiting.updateValue((int(r.attempt),), (at, bool(r.ok), int(r.took_us)))
        while not ended and self.waiting.containsKey((attempt,)):
            at, ok, took = self.waiting.getValue((attempt,))
            self.waiting.removeKey((attempt,))
            due = at if due is None else due
            if took > LIMIT_S * _S:
                status, reason, end, ended = "failed", "time_limit", due + LIMIT_S * _S, True
            elif ok:
                status, reason, end, ended = "completed", None, due + took, True
            elif attempt == RETRIES:
                status, reason, end, ended = "failed", "retries", due + took, True
            else:
                status, reason, end = "retry", None, due + took + wait_us(attempt)
            out.append((key[0], attempt + (status == "retry"), status, end, reason))
            attempt, due = attempt + (status == "retry"), end
        if ended:
            self.waiting.clear()
        self.job.update((attempt, due, ended))
        self._timer(due if due is not None else latest)
        yield pd.DataFrame(out, columns=["job_id", "attempt", "status", "at_us", "reason"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        attempt, due, ended = self.job.get() if self.job.exists() else (0, None, True)
        lost = not ended and due is not None
        self.job.clear()
        self.waiting.clear()
        yield pd.DataFrame([(key[0], attempt, "failed", due + LIMIT_S * _S, "lost")] if lost else [], columns=["job_id", "attempt", "status", "at_us", "reason"])

    def close(self) -> None:
        pass


def retried(results: DataFrame, late: str = "1 hour") -> DataFrame:
    """A stream of RESULTS to a stream of OUTCOMES: one row for each retry and for the end of each job."""
    rows = results.select("job_id", "attempt", "ts", "ok", "took_us").withWatermark("ts", late)
    return rows.groupBy("job_id").transformWithStateInPandas(Retries(), OUTCOMES, "Append", "EventTime")


def outcomes(results: DataFrame, until_us: Column | int) -> DataFrame:
    """A table of RESULTS to the last of each job's OUTCOMES, as known at until_us: an attempt that should have been heard of by then is lost.

    One aggregate a job, of at most one message for each attempt. Jobs whose first attempt is not there are left out.
    """
    first = results.where(F.col("attempt").between(0, RETRIES)).groupBy("job_id", "attempt").agg(F.min(F.struct("ts", "ok", "took_us")).alias("m"))
    jobs = first.groupBy("job_id").agg(F.map_from_entries(F.collect_list(F.struct("attempt", "m"))).alias("of"))
    jobs = jobs.where(F.map_contains_key("of", F.lit(0)))
    limit, until = F.lit(LIMIT_S * _S).cast("bigint"), until_us if isinstance(until_us, Column) else F.lit(until_us)
    kind = "struct<attempt:int,status:string,at_us:bigint,reason:string>"

    def step(s: Column, k: Column) -> Column:
        m = F.try_element_at(F.col("of"), k)
        to = lambda status, at, reason, attempt=k: F.struct(F.lit(attempt).cast("int") if isinstance(attempt, int) else attempt.cast("int").alias("attempt"), F.lit(status).alias("status"), at.cast("bigint").alias("at_us"), F.lit(reason).cast("string").alias("reason")).cast(kind)
        due = s["at_us"]
        return (
            F.when(s["status"] != "retry", s).when(m.isNull(), F.when(due + limit < until, to("failed", due + limit, "lost")).otherwise(s))
            .when(m["took_us"] > limit, to("failed", due + limit, "time_limit")).when(m["ok"], to("completed", due + m["took_us"], None))
            .when(k == RETRIES, to("failed", due + m["took_us"], "retries")).otherwise(to("retry", due + m["took_us"] + F.lit(BACK_OFF_S * _S) * (k + 1), None, k + 1))
        )

    zero = F.struct(F.lit(0).alias("attempt"), F.lit("retry").alias("status"), F.unix_micros(F.try_element_at(F.col("of"), F.lit(0))["ts"].cast("timestamp")).alias("at_us"), F.lit(None).cast("string").alias("reason")).cast(kind)
    # an attempt that has not come ends the fold: those after it are not looked at
    waits = lambda s, k: F.when((s["status"] == "retry") & (s["attempt"] < k), s).otherwise(step(s, k))
    return jobs.select("job_id", F.aggregate(F.sequence(F.lit(0), F.lit(RETRIES)), zero, waits).alias("o")).select("job_id", "o.*")


VIEW = "job_id bigint, seq bigint, status string, before string, accepted boolean, fields map<string,string>, created_at timestamp, updated_at timestamp"


class LatestView(StatefulProcessor):
    """One job's view, merged key by key: of two values of a key the one written later counts. A step that may not follow the job's status is turned away whole.

    An entry older than the job's last one (it came late) adds only what nothing newer has set. Fields of a job that has
    not been written for the time to live are dropped.
    """

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle) -> None:
        self.job = handle.getValueState("job", "status string, created_at timestamp, updated_at timestamp, seq bigint", self.ttl_ms)
        self.fields = handle.getMapState("fields", "name string", "value string, updated_at timestamp, seq bigint", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for r in pd.concat(list(rows)).sort_values(["updated_at", "seq"]).itertuples(index=False):
            at, seq = pd.Timestamp(r.updated_at).to_pydatetime(), int(r.seq)
            status, created, updated, last = self.job.get() if self.job.exists() else (None, at, None, None)
            newer = updated is None or (at, seq) > (updated, last)
            fits = may_follow(status, r.status) if newer else True
            if fits:
                for name, value in dict(r.patch or {}).items():
                    old = self.fields.getValue((name,)) if self.fields.containsKey((name,)) else None
                    if old is None or (at, seq) > (old[1], old[2]):
                        self.fields.updateValue((name,), (value, at, seq))
                self.job.update((r.status, created, at, seq) if newer else (status, min(created, at), updated, last))
            now = self.job.get() if self.job.exists() else (None, None, None, None)
            fields = {k[0]: v[0] for k, v in self.fields.iterator()}
            out.append((key[0], seq, r.status, status, fits, fields, now[1], now[2]))
        yield pd.DataFrame(out, columns=[x.split()[0] for x in VIEW.split(", ")])

    def close(self) -> None:
        pass


def may_follow(before: str | None, status: str) -> bool:
    return status in (("queued", "rejected") if before is None else NEXT.get(before, ()))


def latest_view(log: DataFrame, ttl_days: int = 90) -> DataFrame:
    """A stream of the log (jobs.LOG) to a stream of VIEW: for each entry whether it was accepted, and the job's view after it."""
    return log.select("job_id", "seq", "status", "updated_at", "patch").groupBy("job_id").transformWithStateInPandas(LatestView(ttl_days * 86_400_000), VIEW, "Update", "ProcessingTime")


def accepted(log: DataFrame) -> DataFrame:
    """The same of a table: per job the view after all entries in order, and how many were turned away: job_id, status, fields, created_at, updated_at, refused.

    One aggregate a job; jobs none of whose entries were accepted have no status.
    """
    per = log.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("updated_at", "seq", "status", F.map_entries(F.coalesce("patch", F.create_map().cast("map<string,string>"))).alias("patch")))).alias("log"))
    allowed = F.create_map(*[x for k, v in NEXT.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    kind = "struct<status:string,fields:map<string,string>,created_at:timestamp,updated_at:timestamp,refused:int>"
    zero = F.struct(F.lit(None).cast("string").alias("status"), F.create_map().cast("map<string,string>").alias("fields"), F.lit(None).cast("timestamp").alias("created_at"), F.lit(None).cast("timestamp").alias("updated_at"), F.lit(0).alias("refused")).cast(kind)

    def step(s: Column, x: Column) -> Column:
        fits = F.when(s["status"].isNull(), x["status"].isin("queued", "rejected")).otherwise(F.coalesce(F.array_contains(F.try_element_at(allowed, s["status"]), x["status"]), F.lit(False)))
        names = F.transform(x["patch"], lambda e: e["key"])
        merged = F.map_concat(F.map_filter(s["fields"], lambda k, v: ~F.array_contains(names, k)), F.map_from_entries(x["patch"]))
        taken = F.struct(x["status"].alias("status"), merged.alias("fields"), F.coalesce(s["created_at"], x["updated_at"].cast("timestamp")).alias("created_at"), x["updated_at"].cast("timestamp").alias("updated_at"), s["refused"].alias("refused")).cast(kind)
        return F.when(fits, taken).otherwise(s.withField("refused", s["refused"] + 1))

    return per.select("job_id", F.aggregate("log", zero, step).alias("v")).select("job_id", "v.*")
