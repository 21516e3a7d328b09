"""Metrics of an event log: counters, latency, failures and recoveries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counters(events: DataFrame) -> DataFrame:
    """A row for each component with requests: requests, failures, fallbacks, rates and mean latency.

    events: component, event (success, failure, fallback, info), elapsed_ms.
    """
    n = lambda *kinds: F.count_if(F.col("event").isin(*kinds))
    sums = events.groupBy("component").agg(
        n("success", "failure").alias("requests"),
        n("failure").alias("failures"),
        n("fallback").alias("fallbacks"),
        F.avg(F.when(F.col("event").isin("success", "failure"), F.col("elapsed_ms"))).alias("latency_avg_ms"),
    )
    return sums.where("requests > 0").withColumns(
        {
            "failure_rate": F.col("failures") / F.col("requests"),
            "success_rate": 1 - F.col("failures") / F.col("requests"),
        }
    )


def mean_time_between_failures(events: DataFrame) -> DataFrame:
    """component, failures, mtbf_s: the mean gap of consecutive failures; components with two at least.

    The gaps add up to the span, so no sort is needed.
    """
    failed = events.where("event = 'failure'").groupBy("component")
    spans = failed.agg(F.count("*").alias("failures"), F.min("ts").alias("a"), F.max("ts").alias("z"))
    span = (F.unix_micros("z") - F.unix_micros("a")) / 1e6
    return spans.where("failures > 1").select("component", "failures", (span / (F.col("failures") - 1)).alias("mtbf_s"))


#: Length of the slices that outages are first found in, in seconds.
SLICE = 3600


def outages(events: DataFrame, order: str, length: int = SLICE) -> DataFrame:
    """component, outage, failed_at, recovered_at: from the first failure to the next success (null if open).

    events: component, ts, event; of equal times the order column decides. Other events are ignored. A component's
    log is never one task's work: time is cut to slices, each is read for itself, and what slices tell of themselves
    (see slice_summaries) is put together in order, a row a slice. An outage over several slices has a part in
    each. A null ts comes before all others.
    """
    log = events.where("event IN ('failure', 'success')").withColumn("failed", F.col("event") == "failure")
    log = log.withColumn("slice", F.floor(F.unix_micros("ts") / (length * 1_000_000)))
    by_time = Window.partitionBy("component", "slice").orderBy("ts", order)
    log = log.withColumn("before", F.lag("failed").over(by_time))
    # Numbers within a slice; part 0 goes on with what the slice before left, or opens if that is nothing.
    opens = F.coalesce(F.col("failed") & ~F.col("before"), F.lit(False)).cast("long")
    log = log.withColumn("part", F.sum(opens).over(by_time.rowsBetween(Window.unboundedPreceding, 0)))
    parts = log.groupBy("component", "slice", "part").agg(
        F.min(F.when(F.col("failed"), F.col("ts"))).alias("failed_at"),
        F.max("failed").alias("fails"),
        F.min(F.when(~F.col("failed") & F.col("before"), F.col("ts"))).alias("recovered_at"),
        # The slice's first event, where that is a success: it ends what came in open.
        F.min(F.when(~F.col("failed") & F.col("before").isNull(), F.struct("ts"))).alias("first_success"),
        F.max_by("failed", F.struct(F.col("ts").isNotNull(), "ts", order)).alias("last_failed"),
        F.min_by("failed", F.struct(F.col("ts").isNotNull(), "ts", order)).alias("first_failed"),
    )
    parts = parts.join(slice_summaries(parts), (F.col("component") == F.col("c")) & F.col("slice").eqNullSafe(F.col("s")))
    enters = F.col("carried") & (F.col("part") == 0)
    parts = parts.where(F.col("fails") | enters).select(
        "component",
        (F.col("offset") + F.col("part")).alias("outage"),
        "failed_at",
        F.coalesce("recovered_at", F.when(enters, F.col("first_success.ts"))).alias("recovered_at"),
    )
    found = parts.groupBy("component", "outage").agg(F.min("failed_at").alias("failed_at"), F.min("recovered_at").alias("recovered_at"))
    return found.select("component", "outage", "failed_at", "recovered_at")


def slice_summaries(parts: DataFrame) -> DataFrame:
    """c, s (component and slice), carried (whether it begins in an outage), offset (of its outages' numbers).

    A slice is summed up by its first and last state and the outages that open inside; of these summaries each
    component has one row a slice, so the window over them sees no events.
    """
    slices = parts.groupBy(F.col("component").alias("c"), F.col("slice").alias("s")).agg(
        F.min_by("first_failed", "part").alias("first_failed"),
        F.max_by("last_failed", "part").alias("last_failed"),
        F.max("part").alias("inside"),
    )
    in_order = Window.partitionBy("c").orderBy("s")
    slices = slices.withColumn("carried", F.lag("last_failed", 1, False).over(in_order))
    fresh = (F.col("first_failed") & ~F.col("carried")).cast("long")
    before = F.coalesce(F.sum(F.col("inside") + fresh).over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return slices.select("c", "s", "carried", (before + fresh).alias("offset"))


def mean_time_to_recovery(islands: DataFrame) -> DataFrame:
    """component, recoveries, mttr_s over closed outages."""
    closed = islands.where("recovered_at IS NOT NULL")
    length = (F.unix_micros("recovered_at") - F.unix_micros("failed_at")) / 1e6
    return closed.groupBy("component").agg(F.count("*").alias("recoveries"), F.avg(length).alias("mttr_s"))


def availability(islands: DataFrame, as_of: Column) -> DataFrame:
    """component, availability: the share of the time since the first failure outside outages; open ones last
    until as_of."""
    end = F.coalesce(F.col("recovered_at"), as_of)
    down = F.sum((F.unix_micros(end) - F.unix_micros("failed_at")) / 1e6)
    window = (F.unix_micros(as_of) - F.unix_micros(F.min("failed_at"))) / 1e6
    share = F.when(window > 0, F.greatest(F.lit(0.0), 1 - down / window)).otherwise(1.0)
    return islands.groupBy("component").agg(share.alias("availability"))
