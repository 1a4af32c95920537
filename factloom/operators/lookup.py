"""What a batch finds in a store, and pairs that nearly match: stored facts, candidate entities, surface forms, ids."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..shared import written
from .resolve import block_rows


def stored_facts(store: DataFrame, batch: DataFrame, key: list[str]) -> DataFrame:
    """Stored facts with the keys of a batch."""
    return store.join(batch.select(*key).distinct(), key, "left_semi")


_BLOCK = ["type", "kind", "block"]
#: Stored rows of a block that one unit of a join holds.
_UNIT = 4_000


def store_candidates(incoming: DataFrame, stored: DataFrame, limit: int = 100) -> DataFrame:
    """Profiles of a batch and of a store -> a (incoming key), b (stored key): entities of one type that share a name
    token, a domain or an id. The same key is the same node and no pair; stored entities are never paired with each other.

    A name token with more than `limit` stored entities keeps those most similar in name to the incoming one
    (ties: the smaller key). These are ranked once for each name, not for each entity. Other pairs are the result by themselves, and no
    pair is shuffled: it is made in the first block that its two entities share. Large blocks are joined in units.
    """
    s, i = block_rows(stored, "name_key"), block_rows(incoming, "name_key")
    sizes = s.join(i.select(*_BLOCK).distinct(), _BLOCK, "left_semi").groupBy(*_BLOCK).agg(F.count(F.lit(1)).alias("n"))
    # numbered, so that an entity's blocks are a short list of numbers
    blocks = written(sizes.select(*_BLOCK, "n", F.monotonically_increasing_id().alias("id")), "blocks").withColumn("common",
        (F.col("kind") == "name") & (F.col("n") > limit)).withColumn("units", F.ceil(F.col("n") / _UNIT).cast("int"))

    def held(rows: DataFrame) -> DataFrame:
        """key, rare (numbers of the blocks that are joined whole), all (blocks)."""
        x = rows.join(blocks, _BLOCK)
        return x.groupBy("key").agg(F.sort_array(F.collect_set(F.when(~F.col("common"), F.col("id")))).alias("rare"),
            F.collect_set(F.struct("id", "units", "common", "name_key")).alias("all"))

    def whole(x: DataFrame, name: str) -> DataFrame:
        """A row for each rare block, with the entity's rare blocks of a smaller number."""
        return x.select(F.col("key").alias(name), "rare", F.explode("all").alias("x")).where("NOT x.common").select(name, "x.id", "x.units",
            F.filter("rare", lambda r: r < F.col("x.id")).alias(f"{name}_before")).distinct()

    def ranked(x: DataFrame, key: str, name: str) -> DataFrame:
        return x.select(F.col("key").alias(key), F.col("rare").alias(f"{key}_rare"), F.explode("all").alias("x")).where("x.common").select(key,
            f"{key}_rare", "x.id", "x.units", F.col("x.name_key").alias(name))

    own, theirs = held(i), held(s)
    parts = int(stored.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # the rows are few for the pairs that they make
    left = whole(own, "a").withColumn("unit", F.explode(F.sequence(F.lit(0), F.col("units") - 1))).drop("units")
    right = whole(theirs, "b").withColumn("unit", F.pmod(F.hash("b"), F.col("units"))).drop("units")
    pairs = left.repartition(parts, "id", "unit").join(right.repartition(parts, "id", "unit"), ["id", "unit"]).where(
        (F.col("a") != F.col("b")) & ~F.arrays_overlap("a_before", "b_before")).select("a", "b")

    most = limit + 1  # the incoming key may be among them
    asked = ranked(own, "a", "na")
    each = ranked(theirs, "b", "nb").withColumn("rank", F.row_number().over(Window.partitionBy("id", "nb").orderBy("b"))).where(
        F.col("rank") <= most)
    heads = each.where("rank = 1").select("id", "nb", F.col("b").alias("first"), F.pmod(F.hash("nb"), F.col("units")).alias("unit"))
    scored = asked.select("id", "na", "units").distinct().withColumn("unit", F.explode(F.sequence(F.lit(0), F.col("units") - 1))).join(heads,
        ["id", "unit"]).select("id", "na", "nb", "first", X.token_overlap(F.col("na"), F.col("nb")).alias("o"))
    # a key among the best has a name among the best, by overlap and the name's smallest key
    names = scored.withColumn("rank", F.row_number().over(Window.partitionBy("id", "na").orderBy(F.desc("o"), "first"))).where(
        F.col("rank") <= most).select("id", "na", "nb", "o")
    rank = F.row_number().over(Window.partitionBy("id", "na").orderBy(F.desc("o"), "b"))
    best = names.join(each.select("id", "nb", "b", "b_rare"), ["id", "nb"]).withColumn("rank", rank).where(F.col("rank") <= most).groupBy("id",
        "na").agg(F.sort_array(F.collect_list(F.struct("rank", "b", "b_rare"))).alias("best"))
    kept = asked.join(best, ["id", "na"]).select("a", "a_rare",
        F.explode(F.slice(F.filter("best", lambda x: x["b"] != F.col("a")), 1, limit)).alias("x"))
    return pairs.union(kept.where(~F.arrays_overlap("a_rare", "x.b_rare")).select("a", "x.b").distinct())


def surface_pairs(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """gold, predicted (doc, id, subject, relation, object) -> doc, gold, predicted, side: facts of one document and
    folded relation of which exactly one end is equal once folded; side names the other. Two equi-joins."""
    def folded(df: DataFrame, name: str) -> DataFrame:
        return df.select("doc", F.col("id").alias(name), X.fold(F.col("relation")).alias("r"), X.fold(F.col("subject")).alias(f"{name}_s"),
            X.fold(F.col("object")).alias(f"{name}_o"))

    g, p = folded(gold, "gold"), folded(predicted, "predicted")
    out = []
    for same, other, side in (("s", "o", "object"), ("o", "s", "subject")):
        x = g.withColumn("k", F.col(f"gold_{same}")).join(p.withColumn("k", F.col(f"predicted_{same}")), ["doc", "r", "k"])
        out.append(x.where(F.col(f"gold_{other}") != F.col(f"predicted_{other}")).select("doc", "gold", "predicted",
            F.lit(side).alias("side")))
    return out[0].union(out[1])


def match_by_ids(predicted: DataFrame, names: DataFrame, gold: DataFrame) -> DataFrame:
    """predicted (doc, ord, subject, relation, object), names (doc, name, id), gold (doc, s, relation, o) -> predicted
    with matched: some reading of the two names by the document's ids is a gold triple that no earlier prediction took.

    Candidates are equi-joins; the order-dependent choice goes over each task's candidates in order, document by document.
    """
    n = names.select("doc", X.fold(F.col("name")).alias("name"), "id").distinct()
    c = predicted.select("doc", "ord", "relation", X.fold(F.col("subject")).alias("sn"), X.fold(F.col("object")).alias("on"))
    c = c.join(n.select("doc", F.col("name").alias("sn"), F.col("id").alias("s")),
        ["doc", "sn"]).join(n.select("doc", F.col("name").alias("on"), F.col("id").alias("o")), ["doc", "on"])
    c = c.join(gold.select("doc", "s", "relation", "o").distinct(), ["doc", "s", "relation", "o"]).select("doc", "ord", "s", "relation",
        "o")

    def once(batches):
        doc, num, taken, done = None, None, set(), False
        for b in batches:
            hits = []
            for d, n, *t in zip(*(b[k] for k in ("doc", "ord", "s", "relation", "o"))):
                if d != doc:
                    doc, num, taken = d, None, set()
                if n != num:
                    num, done = n, False
                if not done and (t := tuple(t)) not in taken:
                    taken.add(t)
                    hits.append((d, n))
                    done = True
            yield pd.DataFrame(hits, columns=["doc", "ord"])

    types = dict(c.dtypes)
    rows = c.where("ord IS NOT NULL").repartition("doc").sortWithinPartitions("doc", "ord", "s", "o")
    hits = rows.mapInPandas(once, f"doc {types['doc']}, ord {types['ord']}").withColumn("_hit", F.lit(True))
    return predicted.join(hits, ["doc", "ord"], "left").withColumn("matched", F.coalesce("_hit", F.lit(False))).drop("_hit")


def adjacent_mentions(mentions: DataFrame, texts: DataFrame, most: int = 4) -> DataFrame:
    """mentions (chunk, start, end, name), texts (chunk, text) -> chunk, subject, phrase, object: neighbouring mentions
    of different names with one to `most` lower-case words between them."""
    w = Window.partitionBy("chunk").orderBy("start", "end")
    x = mentions.withColumn("object", F.lead("name").over(w)).withColumn("at", F.lead("start").over(w)).where("at > end AND object != name")
    x = x.join(texts.select("chunk", "text"), "chunk").withColumn("phrase",
        X.squeeze(F.substr("text", F.col("end") + 1, F.col("at") - F.col("end"))))
    return x.where(F.col("phrase").rlike(rf"^\p{{Ll}}[\p{{Ll}}'-]*(?: \p{{Ll}}[\p{{Ll}}'-]*){{0,{most - 1}}}$")).select("chunk",
        F.col("name").alias("subject"), "phrase", "object")


def offered_and_used(declared: DataFrame, offered: DataFrame, used: DataFrame) -> DataFrame:
    """Tables of names -> name, not_offered (declared but never shown), unused (shown but in no fact)."""
    o, u = offered.select("name").distinct().withColumn("_o", F.lit(True)), used.select("name").distinct().withColumn("_u", F.lit(True))
    x = declared.select("name").distinct().join(o, "name", "left").join(u, "name", "left")
    return x.select("name", F.col("_o").isNull().alias("not_offered"), (F.col("_o").isNotNull() & F.col("_u").isNull()).alias("unused"))


def reflect(facts: DataFrame) -> DataFrame:
    """facts (s_key, s_type, predicate, o_kind, o_type, o_repr) -> predicate, domain (sorted types), range (the types of
    its entities, else literal), cardinality (single if no subject has two objects) and support: a store's own schema."""
    per = facts.groupBy("predicate", "s_key").agg(F.count(F.lit(1)).alias("n"), F.min("o_repr").alias("lo"), F.max("o_repr").alias("hi"))
    one = per.groupBy("predicate").agg(F.sum("n").alias("support"), F.max((F.col("lo") != F.col("hi")).cast("int")).alias("several"))
    shape = facts.groupBy("predicate").agg(F.sort_array(F.collect_set("s_type")).alias("domain"),
        F.sort_array(F.collect_set(F.when(F.col("o_kind") == "entity", F.col("o_type")))).alias("to"))
    return one.join(shape, "predicate").select("predicate", F.array_join("domain", " ").alias("domain"),
        F.when(F.size("to") > 0, F.array_join("to", " ")).otherwise("literal").alias("range"),
                                              F.when(F.col("several") == 1, "multi").otherwise("single").alias("cardinality"), "support")
