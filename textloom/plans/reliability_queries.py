"""Queries of the reliability log: events as the log, their type or user as the component."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import reliability
from ..sources.io import table
from ..streaming import events as streams
from .registry import query

#: In SQL: `error` fails, `click` falls back, everything else succeeds; a user is a component.
LOG = """
    log AS (SELECT event_id, ts, user_id AS component, value AS elapsed_ms,
        CASE event_type WHEN 'error' THEN 'failure' WHEN 'click' THEN 'fallback' ELSE 'success' END AS event FROM events)"""
ISLANDS = f"""
    {LOG},
    k AS (SELECT *, event = 'failure' AS f FROM log WHERE event <> 'fallback'),
    b AS (SELECT *, coalesce(lag(f) OVER w, false) AS before FROM k WINDOW w AS (PARTITION BY component ORDER BY ts, event_id)),
    o AS (SELECT *, sum((f AND NOT before)::INT) OVER (PARTITION BY component ORDER BY ts, event_id) AS outage FROM b),
    i AS (
        SELECT component, outage::BIGINT AS outage, min(ts) FILTER (f) AS failed_at, min(ts) FILTER (NOT f) AS recovered_at
        FROM o WHERE outage > 0 AND (f OR before) GROUP BY ALL)"""


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "failure").when(F.col("event_type") == "click", "fallback").otherwise("success")
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("component"), F.col("value").alias("elapsed_ms"), kind.alias("event")
    )


@query(
    "component_counters",
    f"""
    WITH {LOG}
    SELECT component, count(*) FILTER (event <> 'fallback') AS requests, count(*) FILTER (event = 'failure') AS failures,
           count(*) FILTER (event = 'fallback') AS fallbacks,
           round(avg(elapsed_ms) FILTER (event <> 'fallback'), 6) AS latency_avg_ms,
           round(count(*) FILTER (event = 'failure') / count(*) FILTER (event <> 'fallback'), 6) AS failure_rate,
           round(1 - count(*) FILTER (event = 'failure') / count(*) FILTER (event <> 'fallback'), 6) AS success_rate
    FROM log GROUP BY component HAVING count(*) FILTER (event <> 'fallback') > 0""",
)
def component_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = reliability.counters(log(spark, sf_dir))
    rounded = {c: F.round(c, 6) for c in ("latency_avg_ms", "failure_rate", "success_rate")}
    return counted.withColumns(rounded)


@query(
    "mtbf",
    f"""
    WITH {LOG}, g AS (
        SELECT component, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY component ORDER BY ts) AS gap FROM log WHERE event = 'failure')
    SELECT component, count(*) AS failures, round(avg(gap) / 1e6, 3) AS mtbf_s FROM g GROUP BY component HAVING count(*) > 1""",
)
def mtbf(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reliability.mean_time_between_failures(log(spark, sf_dir))
    return found.withColumn("mtbf_s", F.round("mtbf_s", 3))


@query(
    "outage_islands",
    f"WITH {ISLANDS} SELECT component, outage, epoch_us(failed_at) AS failed_us, coalesce(epoch_us(recovered_at), -1) AS recovered_us FROM i",
)
def outage_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reliability.outages(log(spark, sf_dir), "event_id")
    return found.select(
        "component",
        "outage",
        F.unix_micros("failed_at").alias("failed_us"),
        F.coalesce(F.unix_micros("recovered_at"), F.lit(-1)).alias("recovered_us"),
    )


@query(
    "mttr",
    f"""WITH {ISLANDS} SELECT component, count(*) AS recoveries, round(avg(epoch_us(recovered_at) - epoch_us(failed_at)) / 1e6, 3) AS mttr_s
    FROM i WHERE recovered_at IS NOT NULL GROUP BY component""",
)
def mttr(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reliability.mean_time_to_recovery(reliability.outages(log(spark, sf_dir), "event_id"))
    return found.withColumn("mttr_s", F.round("mttr_s", 3))


@query(
    "availability",
    f"""
    WITH {ISLANDS}, e AS (SELECT epoch_us(TIMESTAMP '2024-03-01') AS now)
    SELECT component, round(CASE WHEN now - min(epoch_us(failed_at)) > 0 THEN
        greatest(0, 1 - sum(coalesce(epoch_us(recovered_at), now) - epoch_us(failed_at)) / (now - min(epoch_us(failed_at))))
        ELSE 1 END, 6) AS availability FROM i, e GROUP BY component, now""",
)
def availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    islands = reliability.outages(log(spark, sf_dir), "event_id")
    found = reliability.availability(islands, F.lit("2024-03-01").cast("timestamp"))
    return found.withColumn("availability", F.round("availability", 6))


@query(
    "events_window_counts",
    """
    SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS value_sum
    FROM events GROUP BY ALL""",
)
def events_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by the hour; the tests run the same function over a stream."""
    found = streams.windowed(table(spark, sf_dir, "events"), "1 hour", "event_type")
    return found.withColumn("value_sum", F.round("value_sum", 4))


@query(
    "user_sessions",
    """
    WITH g AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER w > INTERVAL 30 MINUTE, true) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(new::INT) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
    SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts) + INTERVAL 30 MINUTE) AS end_us, count(*) AS n FROM s GROUP BY user_id, k""",
)
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = streams.sessions(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "30 minutes")
    return found.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")
