"""Listings over several stored pages: the chain of pages from a first one on, and the links of all of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.pages import following, listed_links
from ..sources.stored import stored


def successors(pages: DataFrame) -> DataFrame:
    """url, after: the page that each stored page (url, html) leads on to, if that is stored too."""
    found = pages.where("url IS NOT NULL").groupBy("url").agg(F.min("html").alias("html"))
    found = stored(found.select("url", following("html", "url").alias("after")), "following")
    return found.where("after IS NOT NULL").join(found.select(F.col("url").alias("after")), "after", "left_semi").select("url", "after")


def chains(starts: DataFrame, steps: DataFrame) -> DataFrame:
    """start, place, url: the pages from each start (start) on in order, each once, by steps (url, after).

    Chains are followed by doubling: the pages up to place 2**k, moved on by 2**k steps, are the next 2**k, so a chain of
    n pages takes about log2(n) rounds. A chain ends at a page that leads nowhere or to one that it has had.
    """
    found = starts.where("start IS NOT NULL").distinct().select("start", F.lit(0).cast("long").alias("place"), F.col("start").alias("url"))
    jump, length = steps, 1
    while True:
        moved = found.join(jump, "url").select("start", (F.col("place") + length).alias("place"), F.col("after").alias("url"))
        # Pages that come again come at every place from there on; the first place of each counts.
        both = found.unionByName(moved).groupBy("start", "url").agg(F.min("place").alias("place"))
        both = stored(both.select("start", "place", "url"), "chains")
        if both.where(F.col("place") >= length).isEmpty():
            return both
        found = both
        onward = jump.select(F.col("url").alias("after"), F.col("after").alias("further"))
        jump = stored(jump.join(onward, "after").select("url", F.col("further").alias("after")), "jumps")
        length *= 2


def chain_links(pages: DataFrame, starts: DataFrame, pattern: str, dropped: Sequence[str] = fixed.SKIPPED_EXTENSIONS) -> DataFrame:
    """start, link: the links with the pattern on all pages of each listing, each once.

    pages: url, html, an address once or with equal contents. starts: start. A start that is not stored has no links.
    """
    stored_starts = starts.join(pages.select(F.col("url").alias("start")), "start", "left_semi")
    places = chains(stored_starts, successors(pages))
    links = listed_links(pages, pattern, dropped, by_page=True)
    return places.join(links, "url").select("start", "link").distinct()
