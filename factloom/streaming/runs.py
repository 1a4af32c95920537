"""Streamed runs: micro-batches of triples or documents through the same stages as a whole run, into a store that grows.

What is kept is evidence, dealt into buckets by the fact's signature; facts are derived from the evidence of the
buckets that a batch touches. Whatever the batches are, the stored facts are those of a whole run over all rows, and a
batch costs the buckets of its keys.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import run
from ..operators import lookup, resolve
from ..operators.fold import resolve_batch
from ..shared import cut
from .micro import VersionedStore

#: What makes a row of evidence: the same row again, in a later batch, is not new.
ROW = ["sig", "doc_id", "start", "end", "origin"]


def merge_rows(key: list[str]) -> Callable[[DataFrame | None, DataFrame], DataFrame]:
    """Stored rows and those of the batch whose key is not stored yet, each key once."""

    def merge(before: DataFrame | None, batch: DataFrame) -> DataFrame:
        new = batch.dropDuplicates(key)
        if before is None:
            return new
        return before.unionByName(_unseen(new, before, key))

    return merge


def _unseen(new: DataFrame, before: DataFrame, key: list[str]) -> DataFrame:
    a, b = new.alias("a"), before.select(*key).alias("b")
    on = None
    for k in key:
        same = F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
        on = same if on is None else on & same
    return a.join(b, on, "left_anti").select(*[F.col(f"a.{c}").alias(c) for c in new.columns])


class StreamedValidation:
    """Validation of triples as they come. `store` holds the evidence; facts() are gated from it."""

    def __init__(self, spark: SparkSession, config: run.Config, documents: DataFrame, path: str, buckets: int = 16):
        self.spark, self.config, self.documents = spark, config, documents
        self.store = VersionedStore(spark, path, ["sig"], buckets)

    def batch(self, triples: DataFrame, stream: str | None = None, number: int = 0, update: bool = False) -> None:
        """One micro-batch. With `update` the evidence of its documents is withdrawn first: what a document says now stands."""
        evidence = cut(run.evidence_of(self.spark, self.config, self.documents, triples))
        if stream is not None and self.store.done(stream) >= number:
            return
        if update:
            self.withdraw(evidence.select("doc_id").distinct())
        n = {"rows": triples.count(), "evidence": evidence.count(), "batches": 1}
        self.store.upsert(evidence, merge_rows(ROW), stream, number, n)

    def withdraw(self, documents: DataFrame) -> None:
        """Takes the evidence of documents (doc_id) out of the store, in the buckets that hold some."""
        stored = self.store.read()
        if stored is None:
            return
        hit = stored.join(documents, "doc_id", "left_semi")
        touched = sorted(r[0] for r in hit.select(self.store._bucket().alias("b")).distinct().collect())  # at most as many as buckets
        if touched:
            self.store.replace(self.store.read(touched).join(documents, "doc_id", "left_anti"), touched)

    def run(self, triples: DataFrame, checkpoint: str, update: bool = False) -> dict:
        """Every available micro-batch of a streaming table of triples. Returns the totals of all batches so far."""

        def one(batch: DataFrame, batch_id: int) -> None:
            stream = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
            self.batch(batch, stream, batch_id, update)

        triples.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        return self.store.totals()

    def facts(self) -> tuple[DataFrame, DataFrame]:
        """The facts kept and refused, of everything stored."""
        stored = self.store.read()
        if stored is None:
            stored = self.spark.createDataFrame([], run.EVIDENCE)
        return run.gated_facts(self.spark, self.config, stored)


def streamed_stages(source: DataFrame, stages: list[Callable[[DataFrame], DataFrame]], store: VersionedStore, key: list[str],
    checkpoint: str) -> None:
    """A streamed run of any stages: each micro-batch goes through all of them and is added to the store by `key`."""

    def one(batch: DataFrame, batch_id: int) -> None:
        stream = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        out = batch
        for stage in stages:
            out = stage(out)
        out = cut(out)
        store.upsert(out, merge_rows(key), stream, batch_id, {"rows": out.count(), "batches": 1})

    source.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def identities(batch: DataFrame, stored: DataFrame | None, limit: int = 100) -> DataFrame:
    """Entities of a batch (key, type, label, aliases, external_id, attributes) -> key, canonical, resolved among themselves and against the
    stored ones: an entity that is the same as a stored one takes its key, whatever batch either came in."""
    p = resolve.profiles(batch)
    pairs = resolve.candidate_pairs(p)
    everyone = p
    if stored is not None:
        s = resolve.profiles(stored.join(batch.select("key"), "key", "left_anti").select(*batch.columns))
        pairs, everyone = pairs.union(lookup.store_candidates(p, s, limit)), p.unionByName(s)
    links = resolve.judge(cut(pairs.distinct()), cut(everyone))
    return resolve_batch(links, batch, stored.select("key") if stored is not None else batch.select("key").limit(0))


def serve_names(names: VersionedStore, batch: DataFrame) -> DataFrame:
    """batch (stem, doc_id) of documents seen -> stem, doc_id for all names served so far: the first document that had a name keeps it, in
    later batches too."""
    first = batch.groupBy("stem").agg(F.min("doc_id").alias("doc_id"))
    names.upsert(first, lambda before,
        new: new if before is None else before.unionByName(new.join(before.select("stem"), "stem", "left_anti")))
    return names.read()
