"""Whether two differently written facts say the same: candidates, the passage to judge them by, and decisions that are kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..provider import answered, cache_key


def passages(pairs: DataFrame, sentences: DataFrame) -> DataFrame:
    """pairs (doc_id, gold, predicted, names: the ends of both facts), sentences (doc_id, pos, text) -> pairs with passage: of the document's
    sentences the one that names most of the ends, the first of a tie; null if none does."""
    x = pairs.join(sentences, "doc_id")
    low = F.lower("text")
    hits = F.aggregate("names", F.lit(0), lambda acc, n: acc + F.when((n != "") & F.contains(low, F.lower(n)), 1).otherwise(0))
    best = x.withColumn("hits", hits).where("hits > 0").groupBy("doc_id", "gold",
        "predicted").agg(F.max_by("text", F.struct("hits", -F.col("pos"))).alias("passage"))
    return pairs.join(best, ["doc_id", "gold", "predicted"], "left")


def judge_equivalence(pairs: DataFrame, recorded: DataFrame, provider: Callable | None = None) -> DataFrame:
    """pairs (doc_id, gold, predicted, gold_claim, predicted_claim, passage) -> with same: true if the judge says so in both orders, false if it
    denies it in both, null if the orders differ or an answer is missing. Requests are keyed by their text, so decisions are
    read from `recorded` where they were made before."""
    def prompt(a: str, b: str):
        return F.concat_ws("\n", F.lit("Do these say the same? Answer yes or no."), F.concat(F.lit("1: "), a), F.concat(F.lit("2: "), b),
            F.concat(F.lit("Text: "), F.coalesce("passage", F.lit(""))))

    x = pairs.withColumn("_p1", prompt("gold_claim", "predicted_claim")).withColumn("_p2", prompt("predicted_claim", "gold_claim"))
    asked = x.select(F.explode(F.array("_p1", "_p2")).alias("prompt")).distinct().withColumn("cache_key", cache_key(F.col("prompt")))
    got = answered(asked, recorded, provider).select("prompt", F.lower(F.trim("answer")).startswith("yes").alias("said"))
    x = x.join(got.select(F.col("prompt").alias("_p1"), F.col("said").alias("_s1")), "_p1",
        "left").join(got.select(F.col("prompt").alias("_p2"), F.col("said").alias("_s2")), "_p2", "left")
    return x.withColumn("same", F.when(F.col("_s1") == F.col("_s2"), F.col("_s1"))).drop("_p1", "_p2", "_s1", "_s2")


def decisions(judged: DataFrame) -> DataFrame:
    """What to keep of judged pairs: doc_id, gold, predicted, same; undecided pairs are asked again."""
    return judged.where("same IS NOT NULL").select("doc_id", "gold", "predicted", "same")


def repeats(requests: DataFrame, runs: int) -> DataFrame:
    """requests (prompt) once for each run: the run is part of the key, so that each is answered by itself."""
    return requests.withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(runs)))).withColumn("cache_key",
        cache_key(F.col("prompt"), F.col("run")))
