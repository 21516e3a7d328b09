"""A stream's batches merged into a table by key, each batch once, however often it is tried.

The table is cut to buckets by the hash of the key. A batch writes the buckets that it touches anew, into folders that
bear its number, and then puts down a manifest that says which folder holds each bucket. The manifest is the
commit: until it stands, readers see the table as it was, and a batch that broke off is written over by the next try. A
batch whose number the manifest has already is left out. A bucket bounds what a batch has to rewrite.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ingest import upserted

#: Manifests kept, so that readers of the last tables can end.
MANIFESTS = 3


class Merged:
    """A table in a folder of shared storage, with the columns of `schema` (DDL), one row for each key."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: str = "doc_id", buckets: int = 64):
        self.spark, self.folder, self.schema, self.key, self.buckets = spark, folder.rstrip("/"), schema, key, buckets

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        where = path(self.folder)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _numbers(self) -> list[int]:
        files, path = self._files()
        where = path(f"{self.folder}/manifests")
        return sorted(int(f.getPath().getName()) for f in files.listStatus(where)) if files.exists(where) else []

    def manifest(self) -> tuple[int, dict[int, str]]:
        """The last committed batch (-1: none) and each bucket's folder."""
        numbers = self._numbers()
        if not numbers:
            return -1, {}
        text = self.spark.read.text(f"{self.folder}/manifests/{numbers[-1]}", wholetext=True).first()[0]
        return numbers[-1], {int(k): v for k, v in json.loads(text).items()}

    def read(self) -> DataFrame:
        return self._of(self.manifest()[1])

    def _of(self, held: dict[int, str]) -> DataFrame:
        if not held:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.folder}/{where}" for where in held.values()])

    def merge(self, batch: DataFrame, number: int, newest: str | None = None) -> None:
        """Rows of the batch take the place of those with their key; of a key's rows in the batch the one with the
        greatest `newest` stays (without that, any one). Rows without a key are left out."""
        last, held = self.manifest()
        if number <= last:
            return
        batch = batch.select(*[f.name for f in self.spark.createDataFrame([], self.schema).schema]).where(F.col(self.key).isNotNull())
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        touched = sorted(r[0] for r in batch.select(bucket.alias("b")).distinct().collect())  # at most `buckets` rows
        if touched:
            old = self._of({b: held[b] for b in touched if b in held})
            nth = F.row_number().over(Window.partitionBy(self.key).orderBy(F.desc(newest))) if newest else None
            once = batch.withColumn("_nth", nth).where("_nth = 1").drop("_nth") if newest else batch.dropDuplicates([self.key])
            merged = upserted(old, once, self.key).drop("batch").withColumn("bucket", bucket)
            merged.repartition(len(touched), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/batches/{number}")
            held |= {b: f"batches/{number}/bucket={b}" for b in touched}
        self._commit(number, held)

    def _commit(self, number: int, held: dict[int, str]) -> None:
        """The manifest is written beside and renamed, as a whole."""
        files, path = self._files()
        aside = path(f"{self.folder}/aside-{number}")
        with_text = files.create(aside, True)
        with_text.write(bytearray(json.dumps(held).encode()))
        with_text.close()
        files.mkdirs(path(f"{self.folder}/manifests"))
        if not files.rename(aside, path(f"{self.folder}/manifests/{number}")):
            raise OSError(f"no manifest of batch {number} in {self.folder}")
        for old in self._numbers()[:-MANIFESTS]:
            files.delete(path(f"{self.folder}/manifests/{old}"), False)

    def sink(self, newest: str | None = None) -> Callable[[DataFrame, int], None]:
        """For writeStream.foreachBatch."""
        return lambda batch, number: self.merge(batch, number, newest)


def merged_stream(stream: DataFrame, table: Merged, checkpoint: str, newest: str | None = None) -> DataFrame:
    """Runs a stream over all that is there into the table, and reads it. A run that broke off goes on where it was."""
    query = stream.writeStream.foreachBatch(table.sink(newest)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return table.read()
