"""The cache replayed over tables and streams against a plain dictionary that sees one event after another."""

import random
from datetime import UTC, datetime, timedelta

import pytest

from textloom.streaming import replay

START = datetime(2024, 3, 1, tzinfo=UTC)


def normal(text):
    line = " ".join((text or "").lower().split())
    return (line[:-1] if line[-1:] in set("?!.,;") else line).strip()


def grams(text):
    padded = f"  {text}  "
    return {padded[k : k + 3] for k in range(len(padded) - 2)}


def brute(log, ttl, most, least):
    """(cache, nth, hit, the hit entry's normal form, response) of each request; and how many entries are left."""
    caches, out = {}, {}
    for cache, nth, ts, op, query, response in sorted(log, key=lambda r: (r[2], r[1])):
        entries, norm, found = caches.setdefault(cache, {}), normal(query), None
        if op in ("get", "ask"):
            if norm in entries and (ts - entries[norm][1]).total_seconds() <= ttl:
                found = ("exact", entries[norm][0])
            elif least < 1:
                for other, (reply, made) in entries.items():
                    a, b = grams(norm), grams(other)
                    if (ts - made).total_seconds() <= ttl and len(a & b) / len(a | b) >= least:
                        found = ("fuzzy", reply)
                        break
            out[cache, nth] = found or (None, None)
        if op == "set" or op == "ask" and found is None:
            if len(entries) >= most:
                for k in [k for k, e in entries.items() if (ts - e[1]).total_seconds() > ttl]:
                    del entries[k]
                for k in sorted(entries, key=lambda k: entries[k][1])[: max(len(entries) - most, 0)]:
                    del entries[k]
            entries[norm] = (response, ts)
        elif op == "invalidate":
            entries.pop(norm, None)
        elif op == "clear":
            entries.clear()
    return out, {c: len(e) for c, e in caches.items()}


def events(seed, n=600, words=40):
    pick = random.Random(seed)
    log, ts = [], START
    for nth in range(n):
        ts += timedelta(seconds=pick.choice((0, 1, 5, 40)))
        query = pick.choice(("Where is", "where  is", "when was")) + f" course {pick.randrange(words)}" + pick.choice(("?", "", "!", " please"))
        op = pick.choices(("ask", "get", "set", "invalidate", "clear"), (50, 20, 20, 5, 0.5))[0]
        log.append((pick.choice("ab"), nth, ts, op, query if pick.random() > 0.02 else None, f"r{nth}"))
    return log


SCHEMA = "cache string, nth long, ts timestamp, op string, query string, response string"


def found(df):
    return {(r["cache"], r["nth"]): (r["hit"], r["response"]) for r in df.collect()}


@pytest.mark.parametrize(("ttl", "most", "least"), [(3600, 512, 0.82), (300, 5, 0.82), (60, 20, 1.0), (10**6, 3, 0.6)])
def test_replay_of_a_table(spark, ttl, most, least):
    log = events(most)
    df = spark.createDataFrame(log, SCHEMA).repartition(7)
    assert found(replay.replayed(df, ttl, most, least)) == brute(log, ttl, most, least)[0]


def test_a_full_cache_holds_one_more(spark):
    log = [("a", k, START + timedelta(seconds=k), "set", f"question number {k}", f"r{k}") for k in range(700)]
    log += [("a", 1000 + k, START + timedelta(seconds=800), "get", f"question number {k}", None) for k in range(700)]
    want, sizes = brute(log, 10**6, 512, 1.0)
    assert sizes == {"a": 513} and sum(hit == "exact" for hit, _ in want.values()) == 513
    assert found(replay.replayed(spark.createDataFrame(log, SCHEMA), 10**6, 512, 1.0)) == want


def test_odd_logs(spark):
    log = [("a", 1, START, "ask", None, None), ("a", 2, START, "ask", "", "x"), (None, 3, START, "ask", "q", "x"), ("b", 4, None, "ask", "q", "x"), ("b", 5, START, None, "q", "x")]
    got = found(replay.replayed(spark.createDataFrame(log, SCHEMA)))
    assert got == {("a", 1): (None, None), ("a", 2): ("exact", None)}
    assert replay.replayed(spark.createDataFrame([], SCHEMA)).count() == 0


def test_replay_of_a_stream_in_batches(spark, tmp_path):
    log = events(11, 300)
    for k in range(0, 300, 100):
        spark.createDataFrame(log[k : k + 100], SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in/{k // 100}"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        # Files of one batch each, in the order of their making.
        query = replay.replayed_stream(stream, "10 hours", 300, 8).writeStream.format("memory").queryName("replayed").outputMode("append")
        query = query.option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination()
        assert len(query.recentProgress) >= 3
        assert found(spark.table("replayed")) == brute(log, 300, 8, 0.82)[0]
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
