"""Stateful streams against the same rules on tables: retries, the latest view of jobs, look-back duplicates."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from tallyframe.plans import streams
from tallyframe.streaming import stateful

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture
def state(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    stateful.use_rocksdb(spark)
    yield
    spark.conf.set(key, before)


def run(spark, folder, parts, schema, build, name, mode, endless=False):
    """Each part as a file and so as a batch of its own; the rows of all batches. endless: a stream on processing time, which never has all that is available."""
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{folder}/in")
    q = build(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint")
    if endless:
        q, until = q.start(), time.time() + 90
        while q.isActive and time.time() < until and spark.table(name).count() < sum(map(len, parts)):
            time.sleep(1)
        q.stop()
    else:
        q = q.trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None and not q.isActive
    return spark.table(name).collect()


def message(job, attempt, at_s, ok, took_s=1):
    return (job, attempt, T0 + dt.timedelta(seconds=at_s), ok, took_s * 1_000_000)


def test_retries_on_a_stream_equal_those_of_a_table(spark, state, tmp_path):
    parts = [
        [message(1, 0, 0, True), message(2, 0, 1, False, 2), message(3, 0, 2, False), message(4, 0, 3, True, 4000), message(5, 0, 4, False), message(7, 2, 5, True)],
        [message(2, 1, 20, True), message(2, 0, 1, False, 2), message(3, 2, 60, False), message(1, 0, 0, True)],  # job 3's third before its second; two again
        [message(3, 1, 61, False), message(3, 3, 100, False), message(6, 0, 110, True)],
        [message(99, 0, 30_000, True)],  # time passes: job 5 was never heard of again
        [message(98, 0, 60_000, True)],
    ]
    got = run(spark, str(tmp_path), parts, stateful.RESULTS, lambda s: stateful.retried(s, "5 minutes"), "retries", "append")
    by_job = {}
    for r in sorted(got, key=lambda r: (r["job_id"], r["at_us"])):
        by_job.setdefault(r["job_id"], []).append((r["attempt"], r["status"], (r["at_us"] - int(T0.replace(tzinfo=dt.timezone.utc).timestamp()) * 1_000_000) / 1e6, r["reason"]))
    assert by_job[1] == [(0, "completed", 1, None)] and by_job[2] == [(1, "retry", 13, None), (1, "completed", 14, None)]
    assert by_job[3] == [(1, "retry", 13, None), (2, "retry", 34, None), (3, "retry", 65, None), (3, "failed", 66, "retries")]
    assert by_job[4] == [(0, "failed", 3603, "time_limit")] and by_job[5] == [(1, "retry", 15, None), (1, "failed", 3615, "lost")] and 7 not in by_job
    table = stateful.outcomes(spark.createDataFrame([r for p in parts for r in p], stateful.RESULTS), F.unix_micros(F.lit(T0 + dt.timedelta(seconds=60_000)).cast("timestamp"))).collect()
    last = {r["job_id"]: (r["attempt"], r["status"], r["reason"]) for r in table}
    assert last == {j: (v[-1][0], v[-1][1], v[-1][3]) for j, v in by_job.items()}


def test_retries_over_events(spark, sf, state, tmp_path):
    rows = [tuple(r) for r in streams.attempts(spark, sf).orderBy("ts").collect()]
    parts = [rows[k : k + 400] for k in range(0, len(rows), 400)]
    until = max(r[2] for r in rows)
    got = run(spark, str(tmp_path), parts, stateful.RESULTS, lambda s: stateful.retried(s, "1 hour"), "retried_events", "append")
    last = {}
    for r in sorted(got, key=lambda r: (r["attempt"], r["at_us"])):
        last[r["job_id"]] = (r["attempt"], r["status"], r["at_us"], r["reason"])
    ended = {k: v for k, v in last.items() if v[1] in ("completed",) or v[3] in ("retries", "time_limit")}
    want = {r["job_id"]: tuple(r)[1:] for r in stateful.outcomes(spark.createDataFrame(rows, stateful.RESULTS), F.unix_micros(F.lit(until).cast("timestamp"))).collect()}
    assert ended and all(want[k] == v for k, v in ended.items())


def test_latest_view_on_a_stream_equals_that_of_a_table(spark, state, tmp_path):
    log = "job_id bigint, seq bigint, status string, updated_at timestamp, patch map<string,string>"

    def entry(job, seq, status, **patch):
        return (job, seq, status, T0 + dt.timedelta(seconds=seq), patch)

    parts = [
        [entry(1, 0, "queued", a="1", b="1"), entry(2, 0, "processing", a="x"), entry(3, 0, "rejected")],
        [entry(1, 1, "processing", a="2"), entry(1, 2, "queued", a="never"), entry(2, 1, "queued", c="y"), entry(3, 1, "queued", a="never")],
        [entry(1, 3, "completed", c=None), entry(1, 4, "failed", a="never")],
    ]
    got = run(spark, str(tmp_path), parts, log, stateful.latest_view, "views", "update", endless=True)
    last = {}
    for r in sorted(got, key=lambda r: r["seq"]):
        refused = last.get(r["job_id"], (0, 0, 0))[2] + (not r["accepted"])
        last[r["job_id"]] = (r["status"] if r["accepted"] else last.get(r["job_id"], (None,))[0], dict(r["fields"] or {}), refused)
    want = {r["job_id"]: (r["status"], r["fields"], r["refused"]) for r in stateful.accepted(spark.createDataFrame([r for p in parts for r in p], log)).collect()}
    assert last == want == {1: ("completed", {"a": "2", "b": "1", "c": None}, 2), 2: ("queued", {"c": "y"}, 1), 3: ("rejected", {}, 1)}


def test_no_messages(spark):
    assert stateful.outcomes(spark.createDataFrame([], stateful.RESULTS), 0).count() == 0


STORED = "receipt_id bigint, ts timestamp, service string, embedding array<double>"


def test_look_back_on_streams_equals_that_on_tables(spark, tmp_path):
    from tallyframe.streaming import lookback

    r = [(i, T0 + dt.timedelta(hours=i), "ab"[i % 2] if i % 7 else None, [1.0, float(i % 3)]) for i in range(40)] + [(50, T0 + dt.timedelta(hours=3), "b", [1.0, 0.0]), (51, T0 + dt.timedelta(hours=3), "b", None)]
    parts = [r[k::4] for k in range(4)]  # out of order by hours, within the watermark
    how = {"key": ["service"], "window": "10 hours", "late": "3 days", "vector": "embedding", "least": 0.9}
    stored = spark.createDataFrame([(i, t, s, e) for i, t, s, e in r], STORED)
    want = {(x["receipt_id"], x["earlier_id"]) for x in lookback.earlier_of_key(stored, stored, **how).collect()}
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
    plain = {(a[0], b[0]) for a in r for b in r if a[2] and a[2] == b[2] and a[3] and b[3] and (b[1], b[0]) < (a[1], a[0]) and a[1] - b[1] <= dt.timedelta(hours=10) and cos(a[3], b[3]) >= 0.9}
    assert want == plain and len(plain) > 20
    got = run(spark, str(tmp_path), parts, STORED, lambda s: lookback.earlier_of_key(s, spark.readStream.schema(STORED).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in"), **how), "earlier", "append")
    assert {(x["receipt_id"], x["earlier_id"]) for x in got} == want and len(got) == len(want)
