"""Claims: merging by identity, support, contests, partners, retraction and upserts.

A claim table has one row per evidence: claim key columns, then source, doc_id, tier_w (weight of the
source's tier) and retrieved_at. Every function is a DataFrame transformation with group-bys that
combine partially before they shuffle; no group is gathered but where the result is a list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import freshness
from ..shared import cut


def signature(*parts: Column) -> Column:
    """Stored identity: the digest of the identity's parts as one JSON value."""
    return F.sha2(F.to_json(F.struct(*[p.cast("string").alias(f"p{k}") for k, p in enumerate(parts)]), {"ignoreNullFields": "false"}), 256)


def merge_claims(evidence: DataFrame, key: list[str], verdict: str | None = None) -> DataFrame:
    """One row per identity: support (distinct sources), documents, best tier, newest clock and,
    where the columns exist, the widest valid interval, the largest confidence and the most
    informative verdict."""
    has = set(evidence.columns)
    aggs = [F.count_distinct("source").alias("support"), F.count_distinct("doc_id").alias("documents"),
            F.max("tier_w").alias("tier_w"), F.max("retrieved_at").alias("retrieved_at")]
    if "valid_from" in has:
        aggs += [F.min("valid_from").alias("valid_from"), F.max("valid_to").alias("valid_to")]
    if "confidence" in has:
        aggs.append(F.max("confidence").alias("confidence"))
    if verdict:
        order = F.array_position(F.array(*map(F.lit, ("supported", "contradicted", "not_found", "unchecked"))), F.col(verdict))
        aggs.append(F.min_by(verdict, order).alias("verdict"))
    return evidence.groupBy(*key).agg(*aggs)


def support_list(evidence: DataFrame, key: list[str]) -> DataFrame:
    """One row per identity and source: sorted documents, best tier, newest clock."""
    return evidence.groupBy(*key, "source").agg(F.array_sort(F.collect_set("doc_id")).alias("doc_ids"),
                                                F.max("tier_w").alias("tier_w"), F.max("retrieved_at").alias("retrieved_at"))


def standing(evidence: DataFrame, key: list[str], half_life_days: float = 365.0, floor: float = 0.5) -> DataFrame:
    """Rank of every claim: trust (best tier x freshness) x agreement of its sources.

    A source that backs many claims counts less: 1 / (1 + ln of its number of claims).
    """
    newest = evidence.agg(F.max("retrieved_at").alias("newest"))  # one row
    trust = F.col("tier_w") * freshness(F.col("retrieved_at"), F.col("newest"), half_life_days, floor)
    by_source = evidence.crossJoin(F.broadcast(newest)).groupBy(*key, "source").agg(F.max(trust).alias("trust"))
    volume = by_source.groupBy("source").agg(F.count(F.lit(1)).alias("volume"))
    return by_source.join(volume, "source").groupBy(*key).agg(
        F.count(F.lit(1)).alias("support"), F.max("trust").alias("trust"),
        (F.lit(1.0) + F.log1p(F.sum(F.lit(1.0) / (F.lit(1.0) + F.ln("volume"))))).alias("agreement"),
    ).withColumn("rank", F.col("trust") * F.col("agreement"))


def contest(ranked: DataFrame, group: list[str], value: str) -> DataFrame:
    """Claims of one group with different values are rivals: outcome (won, lost, tied or null without a rival),
    top (the best rival's rank) and ratio.

    The best rival of all but the best claim is the best claim; of the best claim, it is the second. Two
    aggregations with partial combining find both, however many claims a group holds. Ranks are read for each of them
    and for the result, so they are worked out once.
    """
    ranked = cut(ranked)
    best = ranked.groupBy(*group).agg(F.max(F.struct("rank", value)).alias("first"))
    marked = ranked.join(best, group)
    second = marked.where(F.col(value) != F.col("first")[value]).groupBy(*group).agg(F.max("rank").alias("second"))
    out = marked.join(second, group, "left").withColumn("top",
        F.when(F.col(value) == F.col("first")[value], F.col("second")).otherwise(F.col("first")["rank"]))
    close = F.abs(F.col("rank") - F.col("top")) <= F.lit(1e-9) * F.greatest(F.abs("rank"), F.abs("top"))
    return out.withColumn("outcome",
        F.when(F.col("top").isNull(), None).when(close, "tied").when(F.col("top") > F.col("rank"), "lost").otherwise("won")).withColumn(
        "ratio", F.when(F.col("outcome") == "lost", F.col("rank") / F.col("top"))).drop("first", "second")


def overlapping_rivals(claims: DataFrame, group: list[str], value: str, ident: str, width_days: int = 30, most: int = 64) -> DataFrame:
    """Pairs (a, b) of one group with different values whose valid intervals overlap; unknown bounds are open.

    Time is cut into slots of width_days, and a claim goes to each slot that it touches, so a group with many claims is
    joined slot by slot: rows grow with the claims that are valid at one time, not with the square of the group. A pair is made in the
    slot where the later of the two starts. Claims that are open, or longer than `most` slots, are compared with the whole group.
    """
    size = width_days * 86_400_000_000

    def slot(c: str) -> Column:
        return F.floor(F.unix_micros(F.col(c).cast("timestamp")) / F.lit(size)).cast("long")

    x = claims.select(*group, F.col(value).alias("_v"), F.col(ident).alias("_i"), "valid_from", "valid_to", slot("valid_from").alias("_lo"),
        slot("valid_to").alias("_hi"))
    wide = F.coalesce((F.col("_hi") < F.col("_lo")) | (F.col("_hi") - F.col("_lo") >= most), F.lit(True))
    narrow, wide = x.where(~wide), x.where(wide)

    def pairs(left: DataFrame, right: DataFrame, slots: bool) -> DataFrame:
        a, b = left.alias("a"), right.alias("b")
        on = F.col("a._v") != F.col("b._v")
        for g in [*group, *(["_slot"] if slots else [])]:
            on = (F.col(f"a.{g}") == F.col(f"b.{g}")) & on
        if slots:
            on = on & (F.col("a._slot") == F.greatest("a._lo", "b._lo"))
        apart = F.coalesce(F.col("a.valid_to") <= F.col("b.valid_from"),
            F.lit(False)) | F.coalesce(F.col("b.valid_to") <= F.col("a.valid_from"), F.lit(False))
        return a.join(b, on & ~apart).select(*[F.col(f"a.{g}").alias(g) for g in group], F.col("a._i").alias("a"), F.col("b._i").alias("b"))

    placed = narrow.withColumn("_slot", F.explode(F.sequence("_lo", "_hi")))
    return pairs(placed, placed, True).union(pairs(wide, x, False)).union(pairs(narrow, wide, False))


def single_value_violations(facts: DataFrame, subject: list[str], obj: str, live: Column | None = None) -> DataFrame:
    """Subjects that hold more than one distinct current object of a single-valued predicate."""
    return (facts if live is None else facts.where(live)).groupBy(*subject).agg(F.count_distinct(obj).alias("values")).where("values > 1")


def best_literal(claims: DataFrame, subject: list[str], value: str) -> DataFrame:
    """The value that a single-valued property is written with: support, then confidence, then the smaller text."""
    order = F.struct((-F.col("support")).alias("s"), (-F.col("confidence")).alias("c"), F.col(value).cast("string").alias("v"))
    return claims.groupBy(*subject).agg(F.min_by(value, order).alias(value), F.count(F.lit(1)).alias("candidates"))


def partners(edges: DataFrame, inverses: DataFrame) -> DataFrame:
    """Inverse and symmetric partners of edges (s_key, predicate, o_key, others) that are not stated already.

    inverses (predicate, inverse) is an ontology's: a handful of rows.
    """
    swapped = edges.join(F.broadcast(inverses), "predicate").select(
        F.col("o_key").alias("s_key"), F.col("inverse").alias("predicate"), F.col("s_key").alias("o_key"),
        F.when(F.col("inverse") == F.col("predicate"), "symmetric").otherwise("inverse").alias("rule"))
    return swapped.join(edges.select("s_key", "predicate", "o_key"), ["s_key", "predicate", "o_key"], "left_anti")


def retract(evidence: DataFrame, key: list[str], gone: DataFrame) -> DataFrame:
    """Per claim, after the documents in gone (doc_id) are withdrawn: support left, cited (did it name one of them),
    retired (no source is left)."""
    marked = evidence.join(gone.select("doc_id").distinct().withColumn("gone", F.lit(True)), "doc_id", "left")
    left = F.col("gone").isNull()
    return marked.groupBy(*key).agg(F.count_distinct(F.when(left, F.col("source"))).alias("support"),
                                    F.max(~left).alias("cited")).withColumn("retired", F.col("support") == 0)


def upsert(store: DataFrame, batch: DataFrame, key: list[str]) -> DataFrame:
    """The store with the batch's rows in place of those of the same key, and the others added."""
    return store.join(batch.select(*key), key, "left_anti").unionByName(batch)


def rebase(mine: DataFrame, read: DataFrame, now: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Three-way merge: a column that I changed since I read it is mine, any other is as it is now."""
    m, r, n = (df.select(*key, F.struct(*columns).alias(x)) for df, x in ((mine, "m"), (read, "r"), (now, "n")))
    both = m.join(r, key, "left").join(n, key, "full_outer")
    return both.select(*key, *[F.when(F.col("m").isNull(),
        F.col("n")[c]).when(F.col("n").isNull() | ~F.col("m")[c].eqNullSafe(F.col("r")[c]), F.col("m")[c])
                               .otherwise(F.col("n")[c]).alias(c) for c in columns])
