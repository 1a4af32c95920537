"""Folding entities and facts: splits, strongest members, merged aliases and attributes, stamps, retirement of derived facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..shared import cut


def edges(facts: DataFrame) -> DataFrame:
    """Facts whose object is an entity."""
    return facts.where("o_kind = 'entity'")


def properties(facts: DataFrame) -> DataFrame:
    """Facts whose object is a value."""
    return facts.where("o_kind IS NULL OR o_kind <> 'entity'")


def strongest(members: DataFrame, key: list[str], order: str = "ord") -> DataFrame:
    """Of each group (key) the member with the heaviest tier (tier_w), then the newest (retrieved_at), then the first."""
    others = [c for c in members.columns if c not in key]
    rank = F.struct("tier_w", "retrieved_at", (-F.col(order)).alias("first"))
    return members.groupBy(*key).agg(F.max_by(F.struct(*others), rank).alias("x")).select(*key, "x.*")


def merge_entities(entities: DataFrame, mapping: DataFrame) -> DataFrame:
    """entities (key, type, label, aliases, external_id, attributes), mapping (key, canonical) -> one row per canonical entity.

    The canonical entity's label, type and attributes win; what it lacks comes from the member with the smallest key. Every
    other spelling of a member, label or alias, becomes an alias, once for each folded form, spelled as the first
    claimant spells it: the canonical entity, then the smallest key, then its place in the list. An attribute or spelling
    is one row before it is grouped, so a hot entity is combined partially.
    """
    none = F.array().cast("array<string>")
    x = entities.join(mapping, "key", "left").withColumn("canonical", F.coalesce("canonical", "key"))
    x = x.withColumn("first", F.struct((F.col("key") != F.col("canonical")).alias("other"), F.col("key").alias("k")))
    heads = x.groupBy("canonical").agg(*[F.min_by(c, F.struct(F.col(c).isNull().alias("none"), "first")).alias(c) for c in ("type", "label",
        "external_id")])

    said = x.select("canonical", "first",
        F.posexplode(F.concat(F.array("label"), F.coalesce("aliases", none))).alias("pos", "said")).where("said IS NOT NULL")
    forms = said.groupBy("canonical", X.fold(F.col("said")).alias("form")).agg(F.min_by("said", F.struct("first", "pos")).alias("said"),
        F.min(F.struct("first", "pos")).alias("at"))
    own = heads.select("canonical", X.fold(F.col("label")).alias("form"))
    aliases = forms.join(own, ["canonical", "form"],
        "left_anti").groupBy("canonical").agg(F.sort_array(F.collect_list(F.struct("at", "said"))).alias("a"))
    aliases = aliases.select("canonical", F.transform("a", lambda e: e["said"]).alias("aliases"))

    pairs = x.select("canonical", "first", F.explode("attributes").alias("name", "value"))
    chosen = pairs.groupBy("canonical", "name").agg(F.min_by("value", "first").alias("value"))
    attributes = chosen.groupBy("canonical").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name",
        "value")))).alias("attributes"))

    out = heads.join(aliases, "canonical", "left").join(attributes, "canonical", "left")
    return out.select(F.col("canonical").alias("key"), "type", "label", F.coalesce("aliases", none).alias("aliases"), "external_id",
                      F.coalesce("attributes", F.create_map().cast("map<string,string>")).alias("attributes"))


def owned_aliases(entities: DataFrame) -> DataFrame:
    """entities (key, ord, aliases) -> key, alias: a spelling that several entities claim belongs to the first of them."""
    each = entities.select("key", "ord", F.explode("aliases").alias("alias"))
    return each.groupBy(X.fold(F.col("alias")).alias("form")).agg(F.min_by(F.struct("key", "alias"),
        F.struct("ord", "key")).alias("x")).select("x.key", "x.alias")


def lookup_stats(incoming: DataFrame, stored: DataFrame, links: DataFrame, mapping: DataFrame) -> DataFrame:
    """One row: entities looked up, stored candidates, links by kind, entities that took a stored key."""
    kinds = links.agg(F.count(F.lit(1)).alias("links"), F.count_if(F.col("kind") == "same_as").alias("same_as"),
                      F.count_if(F.col("kind") == "similar").alias("similar"), F.count_if(F.col("kind") == "different").alias("different"))
    taken = mapping.where("key <> canonical").join(stored.select(F.col("key").alias("canonical")), "canonical", "left_semi")
    return (incoming.agg(F.count_distinct("key").alias("looked_up")).crossJoin(links.select("b").distinct().agg(F.count(F.lit(1)).alias("candidates")))
            .crossJoin(kinds).crossJoin(taken.agg(F.count_distinct("key").alias("rekeyed"))))


def resolve_batch(links: DataFrame, batch: DataFrame, stored: DataFrame) -> DataFrame:
    """links (a, b, kind) among a batch's entities and stored ones -> key, canonical for the batch (key): the smallest stored
    key that it is the same as, directly or over others; else the smallest key of its group."""
    from .components import connected_components

    parts = cut(connected_components(links.where("kind = 'same_as'").select("a", "b")))
    known = parts.join(stored.select(F.col("key").alias("node")), "node",
        "left_semi").groupBy("component").agg(F.min("node").alias("known"))
    named = parts.join(known, "component", "left").select(F.col("node").alias("key"), F.coalesce("known", "component").alias("to"))
    return batch.select("key").distinct().join(named, "key", "left").select("key", F.coalesce("to", "key").alias("canonical"))


def with_parents(facts: DataFrame, at: Column) -> DataFrame:
    """facts (sig, parent_sig, retired_at, others): a derived fact retires with the fact it was derived from, in one step."""
    gone = facts.where("retired_at IS NOT NULL").select(F.col("sig").alias("parent_sig"), F.lit(True).alias("_gone")).distinct()
    out = facts.join(gone, "parent_sig", "left")
    return out.withColumn("retired_at",
        F.when(F.col("retired_at").isNull() & F.col("_gone"), at).otherwise(F.col("retired_at"))).select(*facts.columns)


def stamp_checked(facts: DataFrame, fingerprint: str) -> DataFrame:
    """facts (verdict, review, problem): checked names the ontology they were checked under; a problem marks a fact for
    review, and a supported fact without one loses an old mark."""
    mark = F.when(F.col("problem").isNotNull(), F.col("problem")).when(F.col("verdict") == "supported", None).otherwise(F.col("review"))
    return facts.withColumn("checked", F.lit(fingerprint)).withColumn("review", mark)


def unstamped(facts: DataFrame) -> DataFrame:
    """Facts without what only holds beside the facts of their batch (outcome, top, ratio), and with the confidence from
    before the contest."""
    out = facts.withColumn("confidence", F.coalesce("confidence_before", "confidence")) if "confidence_before" in facts.columns else facts
    return out.drop("outcome", "top", "ratio", "confidence_before")


def source_forms(c: Column) -> Column:
    """Spellings by place from their stored text: a JSON object of lists, or of single strings; null for anything else."""
    lists = F.from_json(c, "map<string,array<string>>", {"mode": "PERMISSIVE"})
    single = F.transform_values(F.from_json(c, "map<string,string>"), lambda k, v: F.array(v))
    return F.when(c.rlike(r'^\s*\{\s*"[^"]*"\s*:\s*\['), lists).when(c.rlike(r"^\s*\{"), single)


def near_duplicate_ids(c: Column) -> Column:
    """Ids of near duplicates from their stored text, a JSON list; null for anything else."""
    return F.when(c.rlike(r"^\s*\["), F.from_json(c, "array<string>"))
