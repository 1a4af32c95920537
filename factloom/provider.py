"""Model calls behind one seam: recorded answers by default, any callable instead.

A request is a row with a cache key, the digest of its canonical JSON. Answers come from a table; what is missing goes to
a provider, a function of one text to (answer, prompt tokens, completion tokens), in Arrow batches. A call that fails
gives an error column, and its document can be left out whole.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ANSWERS = "cache_key string, answer string, prompt_tokens long, completion_tokens long, error string"


def cache_key(*parts) -> Column:
    return F.sha2(F.to_json(F.struct(*[p.cast("string").alias(f"p{k}") for k, p in enumerate(parts)]), {"ignoreNullFields": "false"}), 256)


def call(requests: DataFrame, provider: Callable[[str], tuple[str, int, int]], retries: int = 1,
    most_partitions: int | None = None) -> DataFrame:
    """requests (cache_key, prompt) -> ANSWERS. most_partitions bounds the calls in flight."""

    def run(batches):
        for b in batches:
            rows = []
            for key, prompt in zip(b["cache_key"], b["prompt"]):
                error = None
                for _ in range(retries + 1):
                    try:
                        rows.append((key, *provider(prompt), None))
                        break
                    except Exception as e:  # noqa: BLE001  what a provider raises is its answer's error
                        error = f"{type(e).__name__}: {e}"
                else:
                    rows.append((key, None, 0, 0, error))
            yield pd.DataFrame(rows, columns=["cache_key", "answer", "prompt_tokens", "completion_tokens", "error"])

    unique = requests.select("cache_key", "prompt").dropDuplicates(["cache_key"])
    return (unique.coalesce(most_partitions) if most_partitions else unique).mapInPandas(run, ANSWERS)


def answered(requests: DataFrame, recorded: DataFrame, provider: Callable | None = None, **options) -> DataFrame:
    """requests with answer and error: recorded ones by key, the rest from the provider; without one they have no answer."""
    known = requests.join(recorded.select("cache_key", "answer", F.lit(None).cast("string").alias("error")), "cache_key", "left")
    if provider is None:
        return known
    missing = requests.join(recorded, "cache_key", "left_anti")
    fresh = call(missing, provider, **options).select("cache_key", F.col("answer").alias("_a"), F.col("error").alias("_e"))
    return known.join(fresh, "cache_key", "left").withColumn("answer", F.coalesce("answer", "_a")).withColumn("error",
        F.coalesce("error", "_e")).drop("_a", "_e")


def without_failed_documents(facts: DataFrame, answers: DataFrame) -> DataFrame:
    """facts (doc_id, cache_key) without the documents of which any call failed."""
    failed = facts.join(answers.where("error IS NOT NULL").select("cache_key"), "cache_key", "left_semi").select("doc_id").distinct()
    return facts.join(failed, "doc_id", "left_anti")


def both_orders(a: Column, b: Column) -> Column:
    """Verdict of a pair judged in both orders: same or different if they agree, else unsure."""
    return F.when(a == b, a).otherwise("unsure")


def two_of_three(votes: list) -> Column:
    """Refused if at least two of three votes refuse."""
    return sum((F.when(v == "refuse", 1).otherwise(0) for v in votes[1:]), F.when(votes[0] == "refuse", 1).otherwise(0)) >= 2


def embedded(texts: DataFrame, column: str, embed: Callable[[list[str]], list[list[float]]], name: str = "v",
    batch: int = 256) -> DataFrame:
    """texts with a vector for each text of a column: embed is called with lists of at most `batch` texts."""
    @F.pandas_udf("array<float>")
    def run(c: pd.Series) -> pd.Series:
        out: list = []
        for at in range(0, len(c), batch):
            out += embed(c.iloc[at:at + batch].fillna("").tolist())
        return pd.Series(out, index=c.index)

    return texts.withColumn(name, run(F.col(column)))


def embedding_text(label: Column, type_name: Column, aliases: Column) -> Column:
    """What of an entity is embedded: its type, its label and its aliases."""
    return F.concat_ws(" ", F.concat(type_name, F.lit(":")), label,
        F.when(F.size(aliases) > 0, F.concat(F.lit("("), F.array_join(aliases, ", "), F.lit(")"))))


REPLY = "array<struct<subject:string,predicate:string,object:string,quote:string,start:int,end:int,confidence:double>>"


def read_replies(replies: DataFrame, chunks: DataFrame, known: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """replies (doc_id, idx, answer: a JSON list of candidates), chunks (doc_id, idx, start, text) -> candidates with spans in the document, and what was
    dropped with its reason: no JSON, an end is missing, an unknown predicate, a quote that the chunk does not have.

    Offsets in a reply are the chunk's; a quote that stands elsewhere in the chunk is placed there."""
    x = replies.join(chunks.select("doc_id", "idx", F.col("start").alias("_from"), F.col("text").alias("_text")), ["doc_id", "idx"])
    parsed = F.from_json("answer", REPLY)
    broken = x.where(parsed.isNull()).select("doc_id", "idx", F.lit(None).cast("string").alias("predicate"),
        F.lit("not JSON").alias("reason"))
    each = x.select("doc_id", "idx", "_from", "_text", F.explode(parsed).alias("c")).select("doc_id", "idx", "_from", "_text", "c.*")
    cited = F.substring("_text", F.col("start") + 1, F.col("end") - F.col("start")) == F.col("quote")
    found = F.expr("locate(quote, _text)")
    place = F.when(F.coalesce(cited, F.lit(False)), F.col("start")).when(found > 0, found - 1)
    missing = F.coalesce(F.trim("subject"), F.lit("")) == ""
    reason = (F.when(missing | (F.coalesce(F.trim("object"), F.lit("")) == ""),
        "an end is missing").when(~F.col("predicate").isin(*known) if known else F.lit(False), "unknown predicate")
              .when(F.col("predicate").isNull(), "unknown predicate").when(F.col("quote").isNotNull() & place.isNull(),
              "the quote is not in the chunk"))
    y = each.withColumn("reason", reason).withColumn("_at", place)
    good = y.where("reason IS NULL").select("doc_id", "idx", "subject", "predicate", "object", "quote",
        (F.col("_from") + F.col("_at")).cast("int").alias("start"),
                                            (F.col("_from") + F.col("_at") + F.length("quote")).cast("int").alias("end"),
                                            F.coalesce("confidence", F.lit(0.5)).alias("confidence"))
    return good, broken.union(y.where("reason IS NOT NULL").select("doc_id", "idx", "predicate", "reason"))


def reextract(candidates: DataFrame, gaps: DataFrame, extractor: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """candidates with what the extractor finds in gaps (windows that no candidate covers, as chunks), without what was there before."""
    key = ["doc_id", "subject", "predicate", "object"]
    new = extractor(gaps).select(*candidates.columns)
    return candidates.unionByName(new.join(candidates.select(*key), key, "left_anti"))
