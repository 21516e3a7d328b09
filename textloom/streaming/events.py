"""Event logs as streams: windows with late data, and outages as they open and close."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed(events: DataFrame, length: str, kind: str, late: str | None = None) -> DataFrame:
    """window_start, kind, n, value_sum: counts and sums in windows; the same for tables and streams."""
    timed = events.withWatermark("ts", late) if late else events
    sums = timed.groupBy(F.window("ts", length), kind).agg(F.count("*").alias("n"), F.sum("value").alias("value_sum"))
    return sums.select(F.col("window.start").alias("window_start"), kind, "n", "value_sum")


def sessions(events: DataFrame, key: str, gap: Column | str, late: str | None = None) -> DataFrame:
    """Sessions of a key that end after a gap without events."""
    timed = events.withWatermark("ts", late) if late else events
    found = timed.groupBy(key, F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return found.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def run_to_end(spark: SparkSession, stream: DataFrame, where: str, checkpoint: str) -> DataFrame:
    """Runs a stream over all that is there and returns what it wrote. A run that broke off goes on where it was."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", where)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(where)


def outages(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """component, failed_at, recovered_at, put out when a component recovers. The state of a component is the
    time of the failure that opened its outage. Events of one batch are taken in order of time and order_id."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        since = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["ts", "order_id"])
        closed = []
        for ts, event in zip(rows["ts"], rows["event"], strict=True):
            if event == "failure" and since is None:
                since = ts.to_pydatetime()
            elif event == "success" and since is not None:
                closed.append((key[0], since, ts))
                since = None
        if since is not None:
            state.update((since,))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(closed, columns=["component", "failed_at", "recovered_at"])

    return (
        events.withWatermark("ts", late)
        .groupBy("component")
        .applyInPandasWithState(
            step,
            "component string, failed_at timestamp, recovered_at timestamp",
            "since timestamp",
            "append",
            GroupStateTimeout.NoTimeout,
        )
    )
