"""Grounding and gating: widening, claim text, gate verdicts, qualifiers, type votes, hallucination, diagnosis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold

STARTS, ENDS = ("start_time", "start"), ("end_time", "end")


def gate(verdict: Column, problem: Column | None = None, refuse_not_found: bool = False, mark: bool = False) -> Column:
    """struct(action, reason, review): a schema problem is refused; a refused verdict is dropped, or accepted and marked."""
    bad = verdict.isin("contradicted", "not_found") if refuse_not_found else verdict == "contradicted"
    reason = F.when(verdict == "contradicted", "the text contradicts it").otherwise("the text does not state it")
    out = F.when(bad, F.struct(F.lit("accept" if mark else "refuse").alias("action"), reason.alias("reason"),
        F.lit("judge" if mark else None).cast("string").alias("review"))).otherwise(
        F.struct(F.lit("accept").alias("action"), F.lit(None).cast("string").alias("reason"), F.lit(None).cast("string").alias("review")))
    if problem is None:
        return out
    return F.when(problem.isNotNull(),
        F.struct(F.lit("refuse").alias("action"), F.concat(F.lit("schema: "), problem).alias("reason"),
        F.lit(None).cast("string").alias("review"))).otherwise(out)


def render_claim(subject: Column, predicate: Column, obj: Column, polarity: Column, qualifiers: Column | None = None) -> Column:
    """One line for a judge: words of the predicate, polarity spelled out, identity qualifiers behind."""
    words = F.replace(predicate, F.lit("_"), F.lit(" "))
    line = F.concat_ws(" ", subject,
        F.when(polarity == "denied", F.concat(F.lit("not "), words)).when(polarity == "partial",
        F.concat(F.lit("partly "), words)).otherwise(words), obj)
    if qualifiers is None:
        return line
    pairs = F.transform(F.array_sort(F.map_entries(qualifiers)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.when(F.size(pairs) > 0, F.concat(line, F.lit(" ("), F.array_join(pairs, ", "), F.lit(")"))).otherwise(line)


def widen(spans: DataFrame, sentences: DataFrame) -> DataFrame:
    """spans (id, doc_id, start, end) -> with wide_start, wide_end: the sentences (doc_id, start, end) that they touch; null where a
    span is as wide as they are already."""
    s = sentences.select(F.col("doc_id").alias("_d"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    x = spans.join(s, (F.col("doc_id") == F.col("_d")) & (F.col("start") < F.col("_e")) & (F.col("_s") < F.col("end")), "left")
    g = x.groupBy("id", "doc_id", "start", "end").agg(F.min("_s").alias("lo"), F.max("_e").alias("hi"))
    grew = (F.col("lo") < F.col("start")) | (F.col("hi") > F.col("end"))
    return g.select("id", "doc_id", "start", "end", F.when(grew, F.least("lo", "start")).alias("wide_start"),
        F.when(grew, F.greatest("hi", "end")).alias("wide_end"))


def reconcile_qualifiers(members: DataFrame, key: list[str]) -> DataFrame:
    """members (key columns, ord, tier_w, retrieved_at, qualifiers map) -> key columns, qualifier, value. One distinct value stays; starts
    take the smallest and ends the largest; else the value of the strongest member: tier, then newest, then first."""
    x = members.select(*key, "ord", "tier_w", "retrieved_at", F.explode("qualifiers").alias("qualifier", "v"))
    g = x.groupBy(*key, "qualifier").agg(F.min("v").alias("lo"), F.max("v").alias("hi"),
        F.max_by("v", F.struct("tier_w", "retrieved_at", -F.col("ord"))).alias("best"))
    return g.select(*key, "qualifier",
        F.when(F.col("qualifier").isin(*STARTS), F.col("lo")).when(F.col("qualifier").isin(*ENDS),
        F.col("hi")).otherwise(F.col("best")).alias("value"))


#: Votes and the rank of a type in one number; an ontology has fewer types.
_TYPES = 1 << 24


def best_type(predicates: DataFrame, domains: DataFrame) -> DataFrame:
    """predicates (item, predicate), domains (predicate, type) -> item, type: most votes, then the type with fewest predicates, then by name.

    Items are dealt out before their votes are made, so votes are counted where they arise: what is shuffled is the
    predicates, and a task's counters are those of its items. Domains are an ontology's.
    """
    order = Window.orderBy("size", "type")
    types = domains.where("type IS NOT NULL").groupBy("type").agg(F.count(F.lit(1)).alias("size")).select("type",
        (F.row_number().over(order) - 1).cast("long").alias("rank"))
    ranks = domains.join(types, "type").select("predicate", "rank")
    parts = int(predicates.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # votes are many for the rows that make them
    votes = predicates.repartition(parts, "item").join(F.broadcast(ranks), "predicate").groupBy("item", "rank").agg(F.count(F.lit(1)).alias("n"))
    best = votes.groupBy("item").agg(F.max(F.col("n") * _TYPES - F.col("rank")).alias("best")).select("item", "best",
        F.shiftright(F.col("best") + (_TYPES - 1), 24).alias("votes"))
    return best.withColumn("rank", F.col("votes") * _TYPES - F.col("best")).join(F.broadcast(types), "rank").select("item", "type", "votes")


def hallucinated(text: Column, subject: Column, obj: Column) -> Column:
    """True where the subject or object, letters and digits only, is not in the text."""
    t = fold(text)
    return ~(F.contains(t, fold(subject)) & F.contains(t, fold(obj)))


def locate_pair(sentences: DataFrame, pairs: DataFrame) -> DataFrame:
    """sentences (doc_id, pos, start, end, text), pairs (id, doc_id, subject, object) -> id, n, start, end of the narrowest window of one or two adjacent
    sentences that names both: by number of sentences, width, place. Pairs without one are left out."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    s = sentences.withColumn("t2", F.concat_ws(" ", "text", F.lead("text").over(w))).withColumn("end2", F.lead("end").over(w))
    windows = s.select("doc_id", F.explode(F.array(F.struct(F.lit(1).alias("n"), "start", "end", F.col("text").alias("t")),
                                                   F.struct(F.lit(2).alias("n"), "start", F.col("end2").alias("end"),
                                                   F.col("t2").alias("t")))).alias("x")).select("doc_id", "x.*").where("end IS NOT NULL")
    hit = pairs.join(windows, "doc_id").where(F.contains(F.lower("t"), F.lower("subject")) & F.contains(F.lower("t"), F.lower("object")))
    return hit.groupBy("id").agg(F.min(F.struct("n", (F.col("end") - F.col("start")).alias("width"), "start",
        "end")).alias("b")).select("id", "b.n", "b.start", "b.end")


def miss_buckets(flags: DataFrame, causes: list[str]) -> DataFrame:
    """flags (boolean columns) with bucket: the first cause in order that holds, else other."""
    c = F.lit("other")
    for name in reversed(causes):
        c = F.when(F.col(name), name).otherwise(c)
    return flags.withColumn("bucket", c)


def cap_supported(rows: DataFrame, most: int) -> DataFrame:
    """rows (name, support, rank null if unranked) with kept: among the `most` best by support, then ranked ones, then rank, then name."""
    best = rows.orderBy(F.desc("support"), F.col("rank").isNull(), "rank", "name").limit(most).select("name", F.lit(True).alias("kept"))
    return rows.join(F.broadcast(best), "name", "left").fillna(False, ["kept"])


def compare_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """a, b (item, right) over the same items -> one row: items, both, gained, lost, only_a and only_b (items that the other run lacks)."""
    x = a.select("item", F.col("right").alias("a")).join(b.select("item", F.col("right").alias("b")), "item", "full_outer")
    return x.agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("items"),
        F.count_if(F.col("a") & F.col("b")).alias("both"), F.count_if(~F.col("a") & F.col("b")).alias("gained"),
                 F.count_if(F.col("a") & ~F.col("b")).alias("lost"), F.count_if(F.col("b").isNull()).alias("only_a"),
                 F.count_if(F.col("a").isNull()).alias("only_b"))
