"""The corpus pipeline: language, quality, repeated lines, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.llm import language_id, line_dedup, line_quality, packing, simhash
from factloom.llm.shared import delete_path, fresh_path, scratch, table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled rows teach; null texts and those without a letter go too."""
    if docs.limit(1).count() == 0:
        return docs
    return language_id.accepted(docs)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on all of this stage's own labelled input, does not reject."""
    out = line_quality.train_and_score(docs, table(spark, sf_dir, "labels"), "_fl_quality", line_quality.fit_all)
    return out.where(F.col("_fl_quality") >= line_quality.THRESHOLD).drop("_fl_quality")


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines are cut and n_chars counted anew; documents go if all their text was cut."""
    out = line_dedup.line_dedup(docs)
    out = out.where((F.col("n_dropped") <= 0) | F.col("text").rlike(r"\S"))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group the document with the smallest doc_id stays, once; of rows that repeat that id and are in the group, the
    one with the smallest hash of its text, then the smallest other columns. Rows without doc_id stay."""
    near = simhash.near_duplicates(docs.where("doc_id IS NOT NULL")).where("doc_id = component_id")
    kept = near.groupBy("doc_id", "component_fp").agg(F.min("text_hash").alias("_fl_hash")).drop("component_fp")
    named = docs.where("doc_id IS NOT NULL").withColumn("_fl_hash", F.xxhash64("text")).join(kept, ["doc_id", "_fl_hash"], "left_semi")
    place = F.row_number().over(Window.partitionBy("doc_id", "_fl_hash").orderBy(*[F.col(f"`{c}`") for c in docs.columns]))
    once = named.withColumn("_fl_place", place).where("_fl_place = 1")
    return once.select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's tokens in sequences of at most 4096, one row per piece. Null text has the end id only; rows that
    repeat a doc_id are documents of their own; an empty table gives no rows."""
    import public_tokenizers

    return packing.pack(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"))).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language", known_language),
    ("quality", good_quality),
    ("line_dedup", without_repeated_lines),
    ("near_dedup", without_near_duplicates),
    ("packing", packed),
]

#: Language and quality models cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each written and read again. What a stage cut or wrote for itself is deleted when it is
    written, and its input when the next one is; the last stage's folder is the result and stays."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = fresh_path(spark, f"stage-{name}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            delete_path(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
