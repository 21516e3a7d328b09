"""The answer cache as it goes along: requests, entries, expiry and eviction in the order of a log.

Whether a request hits depends on what was stored before it, so a cache's log is read in order. What a cache holds is
bounded (`most` entries and one more), so its state is small however long its log is. Over a table, logs are sorted by
Spark and read batch by batch; over a stream, the entries are keyed state, and a timer frees that of a cache that has
had no request for so long that all its entries are expired.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..functions import fixed
from ..functions.text import normalized_query, query_key

#: cache, nth: names of a log and of an event in it; hit: exact, fuzzy, or null for a miss; entry: the hit entry's key.
ANSWERS = "cache string, nth long, hit string, entry string, similarity double, response string"
#: What there is to do.
GET, SET, ASK, INVALIDATE, CLEAR = "get", "set", "ask", "invalidate", "clear"


def windows(norm: str) -> frozenset[str]:
    """The set of trigrams, as functions.text.trigrams has it."""
    padded = f"  {norm}  "
    return frozenset(padded[k : k + 3] for k in range(len(padded) - 2))


class Cache:
    """Entries by key in the order of their first storing: norm, response, created (microseconds)."""

    def __init__(self, ttl: float, most: int, least: float):
        self.ttl, self.most, self.least = ttl * 1e6, most, least
        self.entries: dict[str, tuple[str, str | None, int]] = {}
        self.grams: dict[str, frozenset[str]] = {}

    def similarity(self, a: str, b: str) -> float:
        if len(self.grams) > 4 * self.most:
            self.grams.clear()
        x, y = (self.grams.get(norm) or self.grams.setdefault(norm, windows(norm)) for norm in (a, b))
        return len(x & y) / len(x | y)

    def get(self, norm: str, key: str, now: int) -> tuple[str | None, str | None, float | None, str | None]:
        """hit, entry, similarity, response: the entry itself, else the first live one that is similar enough."""
        found = self.entries.get(key)
        if found and now - found[2] <= self.ttl:
            return "exact", key, 1.0, found[1]
        if self.least < 1:
            for other, (text, response, created) in self.entries.items():
                # Sets of too different sizes can't be similar enough.
                if now - created <= self.ttl and (s := self.similarity(norm, text)) >= self.least:
                    return "fuzzy", other, s, response
        return None, None, None, None

    def set(self, norm: str, key: str, response: str | None, now: int) -> None:
        """Makes room first, if the cache is full, so one entry more than that may stay."""
        if len(self.entries) >= self.most:
            self.entries = {k: e for k, e in self.entries.items() if now - e[2] <= self.ttl}
            oldest = sorted(self.entries, key=lambda k: self.entries[k][2])
            for k in oldest[: max(len(oldest) - self.most, 0)]:
                del self.entries[k]
        self.entries[key] = (norm, response, now)

    def replayed(self, rows: pd.DataFrame) -> list[tuple]:
        """Applies rows (nth, op, norm, key, response, micros) in order; (nth, hit, entry, similarity, response) of requests."""
        out = []
        for nth, op, norm, key, response, now in rows[["nth", "op", "norm", "key", "response", "micros"]].itertuples(index=False):
            if op in (GET, ASK):
                found = self.get(norm, key, now)
                out.append((nth, *found))
                if op == ASK and found[0] is None:
                    self.set(norm, key, response, now)
            elif op == SET:
                self.set(norm, key, response, now)
            elif op == INVALIDATE:
                self.entries.pop(key, None)
            elif op == CLEAR:
                self.entries.clear()
        return out


def prepared(log: DataFrame) -> DataFrame:
    """log (cache, nth, ts, op, query, response) with normal forms. Rows without cache, nth, ts or op are left out; a null
    query counts as empty."""
    query = F.coalesce("query", F.lit(""))
    log = log.where("cache IS NOT NULL AND nth IS NOT NULL AND ts IS NOT NULL AND op IS NOT NULL")
    return log.select(
        F.col("cache").cast("string").alias("cache"), F.col("nth").cast("long").alias("nth"), F.col("ts").cast("timestamp").alias("ts"), "op",
        normalized_query(query).alias("norm"), query_key(query).alias("key"), "response",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"),
    )


def framed(cache: str, found: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame([(cache, *row) for row in found], columns=["cache", "nth", "hit", "entry", "similarity", "response"])


def replayed(log: DataFrame, ttl: float = fixed.CACHE_TTL_SECONDS, most: int = fixed.CACHE_MOST_ENTRIES, least: float = fixed.CACHE_SIMILARITY) -> DataFrame:
    """See ANSWERS: a row for each get and ask of the log (cache, nth, ts, op, query, response), each cache by itself.

    Events are taken by ts, then nth. ask is a get that stores its response if it misses. An entry lives ttl seconds; of
    a full cache the expired and then the oldest entries go when one is stored. least: of 1, only equal questions hit.
    """
    ordered = prepared(log).repartition("cache").sortWithinPartitions("cache", "micros", "nth")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, cache = None, None
        for frame in frames:
            for own, rows in frame.groupby("cache", sort=False):
                if own != name:
                    name, cache = own, Cache(ttl, most, least)
                yield framed(name, cache.replayed(rows))

    return ordered.drop("ts").mapInPandas(run, ANSWERS)


class _Processor(StatefulProcessor):
    def __init__(self, ttl: float, most: int, least: float):
        self.ttl, self.most, self.least = ttl, most, least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getMapState("entries", "key string", "norm string, response string, created long, place long")
        self.last = handle.getValueState("last", "micros long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["micros", "nth"])
        held = sorted(((k[0], *e) for k, e in self.entries.iterator()), key=lambda e: e[4])
        cache = Cache(self.ttl, self.most, self.least)
        cache.entries = {k: (norm, response, created) for k, norm, response, created, _ in held}
        before = {k: (norm, response, created, place) for k, norm, response, created, place in held}
        found = cache.replayed(frame)
        for gone in before.keys() - cache.entries.keys():
            self.entries.removeKey((gone,))
        for place, (k, entry) in enumerate(cache.entries.items()):
            if before.get(k) != (*entry, place):
                self.entries.updateValue((k,), (*entry, place))
        last = max(int(frame["micros"].max()), self.last.get()[0] if self.last.exists() else 0)
        self.last.update((last,))
        self.handle.registerTimer(int(last / 1000 + self.ttl * 1000) + 1)
        yield framed(key[0], found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """All entries are expired if nothing came since the timer was set."""
        if self.last.exists() and self.last.get()[0] / 1000 + self.ttl * 1000 < expiredTimerInfo.getExpiryTimeInMs():
            self.entries.clear()
            self.last.clear()
        yield framed(key[0], [])

    def close(self) -> None:
        pass


def replayed_stream(
    log: DataFrame, late: str = "1 hour", ttl: float = fixed.CACHE_TTL_SECONDS, most: int = fixed.CACHE_MOST_ENTRIES, least: float = fixed.CACHE_SIMILARITY
) -> DataFrame:
    """As `replayed`, over a stream. Events of a batch are taken in order; those of a later batch come after them, and
    rows later than `late` are dropped by the watermark. Needs the RocksDB state store."""
    timed = prepared(log).withWatermark("ts", late)
    schema = StructType.fromDDL(ANSWERS)
    return timed.groupBy("cache").transformWithStateInPandas(_Processor(ttl, most, least), schema, "Append", "EventTime")
