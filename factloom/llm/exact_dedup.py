"""Exact deduplication on disk-backed streaming state.

A streaming aggregation keyed by the SHA-256 digest of the normalised text keeps, in RocksDB state
without watermark or expiry, the largest stable identifier, the content locator of that row (file
and row index) and the number of rows. Duplicate keys meet in partial aggregation before the
shuffle, so a digest with a third of all rows costs one state update per task.

Digest hits, and only they, are then checked on full bytes: the rows whose digest has more than one row are named by
their locators, their texts fetched by these, and per digest the smallest and the largest text must be the same
string (partial aggregation again: one text a task and digest is shuffled). Digests that fail, should there ever be
any, are regrouped by text.

Everything is DataFrame code; the state is read back as a table with the state data source.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, delete_path, fresh_path, written

#: Bits of the table that tells which rows are no hits: 2 ** 24 bits are 2 MB.
SLOT_BITS = 24
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. lower() does the same, and faster, unless other cased letters occur."""
    return F.when(text.rlike(r"[^\x00-\x7F]") & text.rlike(r"[\p{Lt}\p{IsUppercase}&&[^\x00-\x7F]]"),
                  F.translate(text, string.ascii_uppercase, string.ascii_lowercase)).otherwise(F.lower(text))


def _with_locator(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "text", F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("row_index"))


def _located(df: DataFrame) -> DataFrame:
    """doc_id, text, path, row_index -> with norm (the normalised text) in place of text."""
    return df.select("doc_id", ascii_lower(F.coalesce("text", F.lit(""))).alias("norm"), "path", "row_index")


def _digested(df: DataFrame) -> DataFrame:
    return _located(_with_locator(df)).withColumn("digest", F.unhex(F.sha2("norm", 256))).drop("norm")


def _pattern(path: str) -> str:
    """The path as a glob: a stream reads a single file by a glob, not by its name. As in every reader, glob characters
    in the path are a pattern."""
    plain = path.rstrip("/")
    return f"{plain[:-1]}[{plain[-1]}]" if plain[-1].isalnum() else plain


def digest_state(spark: SparkSession, path: str) -> DataFrame:
    """Run the streaming aggregation over all files of `path`; one row per digest:
    digest, keep struct(doc_id, path, row_index), group_size."""
    conf = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB,
            "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
            # small stores take the disk that they fill, and are closed when a task has committed
            "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
            "spark.sql.streaming.stateStore.unloadOnCommit": "true"}
    before = {k: spark.conf.get(k, None) for k in conf}
    where = fresh_path(spark, "exact-dedup")
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        source = spark.readStream.schema(spark.read.parquet(path).schema).parquet(_pattern(path))
        state = _digested(source).groupBy("digest").agg(
            F.max(F.struct("doc_id", "path", "row_index")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
        query = (state.writeStream.format("noop").outputMode("update").trigger(availableNow=True)
                 .option("checkpointLocation", where).start())
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    kept = spark.read.format("statestore").load(where)
    size, keep = sorted((f.name for f in kept.schema["value"].dataType), key=lambda n: "count" not in n)
    out = cut(kept.select(F.col("key.digest").alias("digest"), F.col(f"value.`{keep}`").alias("keep"),
                          F.col(f"value.`{size}`").alias("group_size")))
    delete_path(spark, where)
    return out


def _slot(path, row_index) -> Column:
    return F.xxhash64(path, row_index).bitwiseAND(F.lit((1 << SLOT_BITS) - 1))


def _perhaps(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """docs without most of the rows that hits (path, row_index) does not name: those whose hashed locator has no bit set.

    The bits are a table of at most 2 ** (SLOT_BITS - 6) words, whatever the number of hits, so it is broadcast; texts of
    other rows are then neither read into a shuffle nor compared. With very many hits more rows pass, and the join decides.
    """
    slot = _slot("path", "row_index")
    bits = hits.groupBy(F.shiftright(slot,
        6).alias("_fl_word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(xxhash64(path, row_index) & 63 AS INT))")).alias("_fl_bits"))
    located = _with_locator(docs).withColumn("_fl_slot", _slot("path", "row_index"))
    return located.withColumn("_fl_word", F.shiftright("_fl_slot", 6)).join(F.broadcast(bits), "_fl_word").where(
        F.expr("(shiftright(_fl_bits, CAST(_fl_slot & 63 AS INT)) & 1) = 1"))


def exact_dedup(spark: SparkSession, path: str) -> DataFrame:
    """One row per row of the documents at `path` (Parquet: doc_id, text, any other columns):
    doc_id, keep_id, group_size, kept, text_sha256.

    Equal: identical after lower-casing A-Z only; null text counts as empty. The row with the
    largest doc_id of a group stays; of repeated rows with that id, the one whose locator is
    largest. A null doc_id is smaller than any other. An empty table gives an empty result. Texts of any length
    count whole; other columns do not matter.
    """
    docs = spark.read.parquet(path)
    if docs.limit(1).count() == 0:
        return spark.createDataFrame([], "doc_id long, keep_id long, group_size long, kept boolean, text_sha256 string")
    state = digest_state(spark, path)
    rows = written(_digested(docs), "digests")
    # full bytes of hits: a group whose texts differ has a different smallest and largest text
    hits = written(rows.join(state.where("group_size > 1").select("digest"), "digest").select("digest", "path", "row_index"), "hits")
    fetched = _located(_perhaps(docs, hits)).join(hits, ["path", "row_index"])
    clash = cut(fetched.groupBy("digest").agg(F.min("norm").alias("a"), F.max("norm").alias("b")).where("a != b").select("digest"))
    same = rows.join(state, "digest")
    if clash.limit(1).count():
        same = same.join(clash, "digest", "left_anti")
        apart = fetched.join(clash, "digest", "left_semi")
        groups = apart.groupBy("digest", "norm").agg(
            F.max(F.struct("doc_id", "path", "row_index")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
        same = same.unionByName(apart.join(groups, ["digest", "norm"]).drop("norm"))
    return same.select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), F.col("group_size").cast("long").alias("group_size"),
        (F.col("doc_id").eqNullSafe(F.col("keep.doc_id")) & (F.col("path") == F.col("keep.path"))
         & (F.col("row_index") == F.col("keep.row_index"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts of documents: every row with the row that stays."""
    return exact_dedup(spark, f"{sf_dir}/documents.parquet")


SQL = """
WITH n AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, CAST(count(*) OVER w AS BIGINT) AS group_size,
  doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256)
"""
