"""S8 for streams: a keyed table in hash buckets, merged batch by batch.

``batch=<b>/bucket=<k>`` holds bucket ``k`` as micro-batch ``b`` left it.  A batch reads
the buckets that its keys fall into, drops the keys that it brings, adds its last row per
key and writes those buckets anew; a manifest per batch names the newest version of every
bucket.  The manifest is written last, so a batch that dies half-way leaves the table as it
was, and a batch that is run again writes the same version.  Versions behind the manifest
of the batch before are removed.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import remove

MANIFEST = "bucket int, version long"
PARTS = 8


class KeyedTable:
    """Last row per key; at most ``buckets`` versions are named by a manifest."""

    def __init__(self, spark: SparkSession, folder: str, key: list[str], order: str, schema, buckets: int = 16):
        self.spark, self.folder, self.key, self.order = spark, folder, key, order
        self.schema, self.buckets = schema, buckets

    def versions(self, batch_id: int) -> dict[int, int]:
        """Bucket → batch that wrote it last, up to and with ``batch_id``: at most ``buckets`` rows."""
        if batch_id < 0:
            return {}
        return {r["bucket"]: r["version"] for r in
                self.spark.read.schema(MANIFEST).parquet(f"{self.folder}/manifest/{batch_id}").collect()}

    def _rows(self, versions: dict[int, int]) -> DataFrame:
        paths = [f"{self.folder}/batch={v}/bucket={k}" for k, v in sorted(versions.items())]
        reader = self.spark.read.schema(self.schema)
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, batch_id: int | None = None) -> DataFrame:
        """The table after ``batch_id``, or after the last batch."""
        return self._rows(self.versions(self.last() if batch_id is None else batch_id))

    def last(self) -> int:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/manifest")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return -1
        return max((int(s.getPath().getName()) for s in fs.listStatus(path)), default=-1)

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        """Merge the batch in; the greatest ``order`` of a key wins inside the batch.

        A stream's batch is computed anew whenever it is read, state and all, so it is landed
        first.  Its rows and those of the buckets that they fall into are dealt once by bucket
        and part of a bucket; a part holds whole keys and is written where they were ranked.
        """
        before = self.versions(batch_id - 1)
        hashed = F.xxhash64(*self.key)
        bucket = F.pmod(hashed, F.lit(self.buckets)).cast("int")
        names = [f.name for f in self.schema.fields]
        landed = f"{self.folder}/landed/{batch_id}"
        batch.select(*names).write.mode("overwrite").parquet(landed)
        new = self.spark.read.schema(self.schema).parquet(landed)
        touched = sorted(r["bucket"] for r in new.select(bucket.alias("bucket")).distinct().collect())
        old = self._rows({k: before[k] for k in touched if k in before})
        rows = new.withColumn("_new", F.lit(True)).unionByName(old.withColumn("_new", F.lit(False)))
        dealt = rows.withColumn("bucket", bucket).withColumn(
            "_part", F.pmod(F.shiftrightunsigned(hashed, 32), F.lit(PARTS))).repartition("bucket", "_part")
        w = Window.partitionBy("bucket", "_part", *self.key).orderBy(F.desc("_new"), F.desc(self.order))
        (dealt.withColumn("_k", F.row_number().over(w)).filter("_k = 1").select(*names, "bucket")
         .write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/batch={batch_id}"))
        remove(self.spark, landed)
        now = {**before, **{k: batch_id for k in touched}}
        (self.spark.createDataFrame(sorted(now.items()), MANIFEST).coalesce(1).write.mode("overwrite")
         .parquet(f"{self.folder}/manifest/{batch_id}"))
        self._expire(batch_id, before, now)

    def _expire(self, batch_id: int, before: dict[int, int], now: dict[int, int]) -> None:
        """Drop versions that neither this manifest nor the one before it names."""
        old = self.versions(batch_id - 2) if batch_id > 1 and self._has(batch_id - 2) else {}
        gone = {(v, k) for k, v in old.items() if before.get(k) != v and now.get(k) != v}
        remove(self.spark, *[f"{self.folder}/batch={v}/bucket={k}" for v, k in sorted(gone)])
        if batch_id > 1:
            remove(self.spark, f"{self.folder}/manifest/{batch_id - 2}")

    def _has(self, batch_id: int) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/manifest/{batch_id}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)


def write_keyed(stream: DataFrame, key: list[str], folder: str, checkpoint: str, buckets: int = 16,
                available_now: bool = True, derive: Callable[[DataFrame], DataFrame] | None = None):
    """Start a stream in ``update`` mode whose rows replace those of their key."""
    table = keyed_table(stream, key, folder, buckets, derive)

    def sink(batch: DataFrame, batch_id: int):
        rows = (derive(batch) if derive else batch).withColumn("_version", F.lit(batch_id).cast("long"))
        table.merge(rows, batch_id)

    w = stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(sink)
    return (w.trigger(availableNow=True) if available_now else w).start()


def keyed_table(stream: DataFrame, key: list[str], folder: str, buckets: int = 16, derive=None) -> KeyedTable:
    shaped = (derive(stream) if derive else stream).withColumn("_version", F.lit(0).cast("long"))
    return KeyedTable(stream.sparkSession, folder, key, "_version", shaped.schema, buckets)
