"""Queries of the job streams' rules over the events table, each with the same query as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import lookback, stateful
from .registry import query, table

#: Attempts of jobs: four events each, one in 23 of which never came; views and errors are failures, an event's value is its run in minutes.
_ATTEMPTS = """WITH r AS (SELECT event_id // 4 AS job_id, event_id % 4 AS attempt, epoch_us(ts) AS t_us, event_type NOT IN ('error', 'view') AS ok, CAST(round(value * 100) AS BIGINT) * 600000 AS took FROM events WHERE event_id * 7 % 23 <> 5),
  w AS (SELECT *, row_number() OVER o - 1 = attempt AS reached, coalesce(bool_and(NOT ok AND took <= 3600000000) OVER (PARTITION BY job_id ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS open,
    first_value(t_us) OVER o + CAST(coalesce(sum(took + 10000000 * (attempt + 1)) OVER (PARTITION BY job_id ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS due FROM r WINDOW o AS (PARTITION BY job_id ORDER BY attempt)),
  last AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY attempt DESC) AS nth FROM w WHERE reached AND open),
  ends AS (SELECT *, CASE WHEN took > 3600000000 THEN 'long' WHEN ok THEN 'ok' WHEN attempt = 3 THEN 'spent' WHEN due + took + 10000000 * (attempt + 1) + 3600000000 < (SELECT max(epoch_us(ts)) FROM events) THEN 'lost' ELSE 'waits' END AS how, due + took + 10000000 * (attempt + 1) AS next FROM last WHERE nth = 1)"""


def attempts(spark, sf):
    e = F.col("event_id")
    rows = table(spark, sf, "events").where(e * 7 % 23 != 5)
    return rows.select(F.floor(e / 4).cast("bigint").alias("job_id"), (e % 4).cast("int").alias("attempt"), "ts", (~F.col("event_type").isin("error", "view")).alias("ok"), (F.round(F.col("value") * 100).cast("bigint") * 600000).alias("took_us"))


@query(_ATTEMPTS + """ SELECT job_id, CAST(CASE WHEN how IN ('lost', 'waits') THEN attempt + 1 ELSE attempt END AS INT) AS attempt, CASE how WHEN 'ok' THEN 'completed' WHEN 'waits' THEN 'retry' ELSE 'failed' END AS status,
  CAST(CASE how WHEN 'long' THEN due + 3600000000 WHEN 'lost' THEN next + 3600000000 WHEN 'waits' THEN next ELSE due + took END AS BIGINT) AS at_us, CASE how WHEN 'long' THEN 'time_limit' WHEN 'lost' THEN 'lost' WHEN 'spent' THEN 'retries' END AS reason FROM ends""")
def stm_retried_jobs(spark, sf):
    """STM-01: three retries after 10, 20 and 30 seconds and a limit of an hour, as known at the last event; streaming/stateful.py has the same on streams."""
    rows = attempts(spark, sf)
    now = table(spark, sf, "events").agg(F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("now")).first()["now"]
    return stateful.outcomes(rows.unionByName(rows.where("attempt = 1")), now or 0)


_STEPS = "CASE event_type WHEN 'click' THEN 'queued' WHEN 'view' THEN 'processing' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'rejected' END"


def steps(spark, sf):
    """A log of eight entries a job, many of which may not follow the one before."""
    e = F.col("event_id")
    patch = F.create_map(F.concat(F.lit("f"), (e % 3).cast("string")), F.col("user_id").cast("string"), F.lit("kind"), F.col("event_type"))
    return table(spark, sf, "events").select(F.floor(e / 8).cast("bigint").alias("job_id"), (e % 8).cast("bigint").alias("seq"), F.expr(_STEPS).alias("status"), F.col("ts").alias("updated_at"), patch.alias("patch"))


@query(f"""WITH RECURSIVE g AS (SELECT event_id // 8 AS job_id, event_id % 8 AS seq, {_STEPS} AS status, event_id, user_id, event_type, ts, row_number() OVER (PARTITION BY event_id // 8 ORDER BY ts, event_id % 8) AS n FROM events),
  st AS (SELECT DISTINCT job_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS status, CAST(NULL AS VARCHAR) AS f0, CAST(NULL AS VARCHAR) AS f1, CAST(NULL AS VARCHAR) AS f2, CAST(NULL AS VARCHAR) AS kind, CAST(NULL AS BIGINT) AS updated, 0 AS refused FROM g
   UNION ALL SELECT job_id, n, CASE WHEN fits THEN new ELSE status END, CASE WHEN fits AND k = 0 THEN u ELSE f0 END, CASE WHEN fits AND k = 1 THEN u ELSE f1 END, CASE WHEN fits AND k = 2 THEN u ELSE f2 END, CASE WHEN fits THEN event_type ELSE kind END, CASE WHEN fits THEN t_us ELSE updated END, refused + CASE WHEN fits THEN 0 ELSE 1 END
    FROM (SELECT s.*, g.n AS n2, g.status AS new, g.event_id % 3 AS k, CAST(g.user_id AS VARCHAR) AS u, g.event_type, epoch_us(g.ts) AS t_us, CASE WHEN s.status IS NULL THEN g.status IN ('queued', 'rejected') WHEN s.status = 'queued' THEN g.status IN ('processing', 'rejected') WHEN s.status = 'processing' THEN g.status IN ('completed', 'failed') ELSE false END AS fits
      FROM (SELECT * EXCLUDE (n), n + 1 AS n FROM st) s JOIN g ON g.job_id = s.job_id AND g.n = s.n)),
  fin AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY n DESC) AS nth FROM st)
  SELECT job_id, status, f0, f1, f2, kind, updated AS updated_us, refused FROM fin WHERE nth = 1""")
def snk_accepted_jobs(spark, sf):
    """SNK-02, STM-02: patches merged key by key where the step may follow, others counted; streaming/stateful.py has the same on streams."""
    f = lambda k: F.col("fields")[k].alias(k)
    return stateful.accepted(steps(spark, sf)).select("job_id", "status", f("f0"), f("f1"), f("f2"), f("kind"), F.unix_micros("updated_at").alias("updated_us"), "refused")


@query("""SELECT a.event_id AS receipt_id, b.event_id AS earlier_id, epoch_us(a.ts) - epoch_us(b.ts) AS age_us FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = b.event_type
  AND b.ts <= a.ts AND b.ts >= a.ts - INTERVAL 12 HOUR AND (b.ts < a.ts OR b.event_id < a.event_id)""")
def stm_earlier_pairs(spark, sf):
    """STM-04, FLT-07: events with the earlier ones of their user and kind within 12 hours; the same function joins two streams."""
    rows = table(spark, sf, "events").select(F.col("event_id").alias("receipt_id"), "ts", "user_id", "event_type")
    out = lookback.earlier_of_key(rows, rows, ["user_id", "event_type"], window="12 hours")
    return out.select("receipt_id", "earlier_id", (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("earlier_time").cast("timestamp"))).alias("age_us"))
