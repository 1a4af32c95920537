"""Incremental runs: micro-batches of files, upserted by key into a versioned store."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Versions:
    """Numbered JSON notes in a folder, each written to a temporary name and then renamed: a reader sees a whole note or
    none, and always the newest. A number is taken once, so of two writers one fails. Any file system Spark knows."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_versions/{name}" if name else self.path)

    def current(self) -> int | None:
        folder = self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_versions")
        if not self._fs.exists(folder):
            return None
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return max((int(n) for n in names if n.isdigit()), default=None)

    def note(self, version: int | None = None) -> dict:
        v = self.current() if version is None else version
        if v is None:
            return {}
        stream = self._fs.open(self._at(str(v)))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, version: int, note: dict) -> None:
        temporary = self._at(f".{version}-{self._jvm.java.util.UUID.randomUUID().toString()}")
        out = self._fs.create(temporary, True)
        out.write(bytearray(json.dumps(note, sort_keys=True).encode()))
        out.close()
        if self._fs.exists(self._at(str(version))) or not self._fs.rename(temporary, self._at(str(version))):
            self._fs.delete(temporary, False)
            raise FileExistsError(f"version {version} of {self.path} was written by another run")


class VersionedStore:
    """Parquet rows dealt into `buckets` by a hash of `key`; a version names, for each bucket, the version that wrote it.

    A write replaces the buckets it touches and no others, so a micro-batch costs the buckets of its keys, not the
    store. The note of a version also says which batch of which stream it holds, so a batch that runs again is not
    applied twice, and a new stream goes on from what is stored.
    """

    def __init__(self, spark: SparkSession, path: str, key: list[str] | None = None, buckets: int = 32):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets if key else 1
        self.versions = Versions(spark, path)

    def version(self) -> int | None:
        return self.versions.current()

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int") if self.key else F.lit(0)

    def read(self, only: list[int] | None = None) -> DataFrame | None:
        """The stored rows, or those of some buckets; None before the first write."""
        note = self.versions.note()
        if not note:
            return None
        paths = [f"{self.path}/v{v}/_bucket={b}" for b, v in note["buckets"].items() if only is None or int(b) in only]
        schema = self.spark.createDataFrame([], note["schema"]).schema
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def done(self, stream: str) -> int:
        """The last batch of a stream that is stored, -1 if none is."""
        return self.versions.note().get("streams", {}).get(stream, -1)

    def replace(self, df: DataFrame, touched: list[int] | None = None, stream: str | None = None, batch: int = 0,
        totals: dict | None = None) -> None:
        """Write df as the rows of the touched buckets (all of them by default) in a new version."""
        note, v = self.versions.note(), (self.version() if self.version() is not None else -1) + 1
        df.withColumn("_bucket", self._bucket()).write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/v{v}")
        folder = self.versions._jvm.org.apache.hadoop.fs.Path(f"{self.path}/v{v}")
        filled = [s.getPath().getName().split("=")[1] for s in self.versions._fs.listStatus(folder) if s.getPath().getName().startswith("_bucket=")]
        old = {b: w for b, w in note.get("buckets", {}).items() if touched is not None and int(b) not in touched}
        streams = dict(note.get("streams", {}))
        if stream is not None:
            streams[stream] = batch
        added = dict(note.get("totals", {}))
        for k, n in (totals or {}).items():
            added[k] = added.get(k, 0) + n
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
        self.versions.commit(v, {"buckets": old | {b: v for b in filled}, "streams": streams, "totals": added, "schema": schema})

    def totals(self) -> dict:
        """Sums of what the batches counted."""
        return self.versions.note().get("totals", {})

    def upsert(self, batch: DataFrame, merge: Callable[[DataFrame | None, DataFrame], DataFrame], stream: str | None = None,
        number: int = 0,
               totals: dict | None = None) -> None:
        """merge(stored rows or None, batch) becomes the rows of the buckets that the batch's keys fall into."""
        if stream is not None and self.done(stream) >= number:
            return
        touched = sorted(r[0] for r in batch.select(self._bucket().alias("b")).distinct().collect())  # at most `buckets` numbers
        if touched or self.version() is None:
            self.replace(merge(self.read(touched), batch), touched, stream, number, totals)


def upsert_stream(source: DataFrame, store: VersionedStore, merge: Callable[[DataFrame | None, DataFrame], DataFrame],
    checkpoint: str) -> None:
    """Run every available micro-batch of a streaming DataFrame: merge(stored rows of the same buckets or None, batch) replaces
    them. A batch that is run again after a failure is not applied twice; a new checkpoint is a new stream, which goes
    on from what is stored."""

    def write(batch: DataFrame, batch_id: int) -> None:
        stream = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        store.upsert(batch, merge, stream, batch_id)

    source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def merge_counts(key: list[str]) -> Callable[[DataFrame | None, DataFrame], DataFrame]:
    """Merge for claim tables (key, source): distinct (claim, source) rows, whatever the batches were."""

    def merge(before: DataFrame | None, batch: DataFrame) -> DataFrame:
        rows = batch.select(*key, "source").distinct()
        return rows if before is None else before.union(rows.join(before, [*key, "source"], "left_anti"))

    return merge


def tumbling(events: DataFrame, time: str, width: str, late: str, *aggs) -> DataFrame:
    """Extension: event-time windows with a watermark, on a stream or a table."""
    e = events.withWatermark(time, late) if events.isStreaming else events
    w = e.groupBy(F.window(time, width)).agg(*aggs)
    return w.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *[c for c in w.columns if c != "window"])


def sessions(events: DataFrame, key: str, time: str, gap: str, *aggs) -> DataFrame:
    """Extension: sessions of a key that end after `gap` without an event."""
    w = events.groupBy(key, F.session_window(time, gap)).agg(*aggs)
    return w.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"),
        *[c for c in w.columns if c not in (key, "session_window")])
