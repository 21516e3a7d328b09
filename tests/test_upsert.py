"""A table that a stream merges into: repeated and half-failed batches change nothing."""

import pytest
from pyspark.sql import functions as F

from textloom.operators.ingest import upserted
from textloom.streaming.upsert import Merged, merged_stream

SCHEMA = "doc_id long, text string, at long"


def rows(df):
    return sorted(tuple(r) for r in df.select("doc_id", "text", "at").collect())


def batch(spark, ids, at):
    return spark.createDataFrame([(i, f"text {i} of {at}", at) for i in ids], SCHEMA)


def test_batches_equal_one_upsert(spark, tmp_path):
    table = Merged(spark, f"file://{tmp_path}/t", SCHEMA, buckets=4)
    assert table.read().count() == 0
    first, second = batch(spark, range(30), 1), batch(spark, [*range(20, 40), None], 2)
    table.merge(first, 0)
    table.merge(second, 1)
    want = rows(upserted(first, second, "doc_id"))
    assert rows(table.read()) == want and len(want) == 40
    table.merge(batch(spark, range(5), 9), 1)  # tried again, with whatever rows: it is done
    table.merge(batch(spark, range(5), 9), 0)
    assert rows(table.read()) == want
    table.merge(batch(spark, [], 9), 2)
    assert rows(table.read()) == want and table.manifest()[0] == 2


def test_a_batch_that_breaks_off_is_written_over(spark, tmp_path, monkeypatch):
    table = Merged(spark, f"file://{tmp_path}/t", SCHEMA, buckets=4)
    table.merge(batch(spark, range(30), 1), 0)
    before = rows(table.read())
    with monkeypatch.context() as patch:
        patch.setattr(Merged, "_commit", lambda self, number, held: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            table.merge(batch(spark, range(10), 2), 1)
    assert rows(table.read()) == before
    table.merge(batch(spark, range(10), 3), 1)
    assert rows(table.read()) == sorted([*rows(batch(spark, range(10), 3)), *before[10:]])


def test_one_bucket_leaves_others_alone(spark, tmp_path):
    table = Merged(spark, f"file://{tmp_path}/t", SCHEMA, buckets=16)
    table.merge(batch(spark, range(200), 1), 0)
    table.merge(batch(spark, [7], 2), 1)
    folders = set(table.manifest()[1].values())
    assert sum(f.startswith("batches/1/") for f in folders) == 1 and len(folders) > 10


def test_stream_into_the_table(spark, tmp_path):
    parts = [batch(spark, range(k, k + 20), k) for k in (0, 10, 20)]
    for k, part in enumerate([*parts, parts[1].union(parts[1].withColumn("at", F.lit(-1).cast("long")))]):
        part.coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    table = Merged(spark, f"file://{tmp_path}/t", SCHEMA)
    got = rows(merged_stream(stream, table, str(tmp_path / "check"), "at"))
    want = parts[0]
    for part in (*parts[1:], parts[1]):
        want = upserted(want, part, "doc_id").drop("batch")
    assert got == rows(want)
    assert rows(merged_stream(stream, table, str(tmp_path / "check"), "at")) == got
