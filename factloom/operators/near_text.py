"""Near-duplicate texts by exact shingle overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import shingle_hashes
from ..shared import cut


def shingle_pairs(documents: DataFrame, threshold: float = 0.8, size: int = 5, other_source: bool = False) -> DataFrame:
    """documents (doc_id, text, source) -> a, b (a < b), jaccard of pairs at the threshold or above.

    Equal texts are one class: pairs are between class representatives (the smallest doc_id), each with
    its copies listed by text_classes. Prefix filter: two sets with Jaccard t share one of the rarest
    (1 - t) * n + 1 shingles of each, in one global order (by frequency), so only those are joined; a
    frequent shingle is in few prefixes. Candidates are then counted exactly.
    """
    reps = text_classes(documents).groupBy("rep").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    # read for the frequencies and for the sets: texts are cut into shingles once
    texts = documents.join(reps, "doc_id", "left_semi").select("doc_id", "source", shingle_hashes(F.col("text"), size).alias("s"))
    # an id that occurs twice is one document; the join has dealt the rows by id already
    rows = cut(texts.groupBy("doc_id").agg(F.min("source").alias("source"), F.array_distinct(F.flatten(F.collect_list("s"))).alias("s")))
    # only ids and hashes are dealt out by hash, once; a shingle has a row for each document at most. A document's source and size stay
    # where its row is. Shingles of one document only match nothing: they fill the rarest places of the prefix
    sets = rows.select("doc_id", F.explode("s").alias("h")).withColumn("f", F.count(F.lit(1)).over(Window.partitionBy("h"))).where("f > 1")
    held = sets.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("f", "h"))).alias("o"))
    # read for both sides of both joins: materialised once
    shared = cut(held.join(rows.select("doc_id", "source", F.size("s").alias("n")), "doc_id").select("doc_id", "source", "n", "o"))
    lone = F.col("n") - F.size("o")
    need = F.floor((1 - F.lit(threshold)) * F.col("n") + 1e-9).cast("int") + 1 - lone
    kept = shared.withColumn("all", F.transform("o", lambda x: x["h"])).where(need > 0).select(
        "doc_id", "source", "n", "all", F.explode(F.slice(F.col("all"), F.lit(1), need)).alias("h"))
    a, b = kept.alias("a"), kept.select("doc_id", "source", "n", "h").alias("b")
    on = (F.col("a.h") == F.col("b.h")) & (F.col("a.doc_id") < F.col("b.doc_id")) & (
        F.least("a.n", "b.n") >= F.lit(threshold) * F.greatest("a.n", "b.n") - 1e-9)
    if other_source:
        on = on & (F.col("a.source") != F.col("b.source"))
    cand = a.join(b, on).select(F.col("a.doc_id").alias("a"), F.col("b.doc_id").alias("b")).distinct()
    sized = shared.select("doc_id", "n", F.transform("o", lambda x: x["h"]).alias("all"))
    both = cand.join(sized.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("all").alias("sa")), "a").join(
        sized.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("all").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.select("a", "b",
        (common / (F.col("na") + F.col("nb") - common)).alias("jaccard")).where(F.col("jaccard") >= threshold - 1e-12)


def text_classes(documents: DataFrame) -> DataFrame:
    """doc_id, rep: the smallest doc_id with the same text."""
    keyed = documents.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("k"))
    return keyed.join(keyed.groupBy("k").agg(F.min("doc_id").alias("rep")), "k").select("doc_id", "rep")
