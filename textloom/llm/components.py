"""Connected components of a graph of links, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, written


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node with a link (a, b).

    Each round a node takes the smallest label among its own and its neighbours', then the label of that
    label, so paths shorten by doubling. The rounds' tables are written, and only the number of labels that
    changed reaches the driver. Labels are aggregated map-side first, so a node with many links is no burden.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = written(both.where("a <> b").distinct(), "links")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
    labels = stored = written(labels.select("node", F.least("node", "least").alias("component")), "labels")
    while True:
        offers = both.join(labels, F.col("a") == F.col("node")).groupBy(F.col("b").alias("other"))
        offers = offers.agg(F.min("component").alias("offer"))
        hooked = labels.join(offers, F.col("node") == F.col("other"), "left").select(
            "node", F.col("component").alias("was"), F.least("component", F.coalesce("offer", "component")).alias("hook")
        )
        jump = labels.select(F.col("node").alias("hook"), F.col("component").alias("further"))
        new = written(
            hooked.join(jump, "hook").select("node", "was", F.least("hook", "further").alias("component")), "labels"
        )
        done = new.where("component <> was").isEmpty()
        free(stored)
        stored, labels = new, new.select("node", "component")
        if done:
            free(both)
            return labels
