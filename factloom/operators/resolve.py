"""Entity resolution: blocks, candidate pairs, scored links, constrained merging and re-keying."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.values import cosine
from ..shared import cut
from .components import connected_components


def profiles(entities: DataFrame) -> DataFrame:
    """entities (key, type, label, aliases, external_id, attributes) -> with name_key, names, domains, scheme, id_value.

    Aliases that are hosts are domains; others are further names.
    """
    alias = F.coalesce("aliases", F.array().cast("array<string>"))
    name = X.name_key(F.coalesce("label", "key"))
    domains = F.array_distinct(F.filter(F.transform(alias, X.domain_of), lambda x: x.isNotNull()))
    others = F.transform(F.filter(alias, lambda a: X.domain_of(a).isNull()), lambda a: X.name_key(a))
    return entities.withColumn("name_key", name).withColumn("names",
        F.filter(F.array_distinct(F.concat(F.array("name_key"), others)), lambda n: n != "")).withColumn(
        "domains", domains).withColumn("scheme",
        F.when(F.col("external_id").isNotNull(), X.identifier_scheme(F.col("external_id")))).withColumn(
        "id_value", F.when(F.col("external_id").isNotNull(), X.identifier_value(F.col("external_id"))))


def block_rows(p: DataFrame, *also: str) -> DataFrame:
    """One row per profile and block key: kind (name, domain, id), block; and other columns of the profile."""
    words = F.array_distinct(F.flatten(F.transform("names", X.block_tokens)))
    keys = F.concat(F.transform(words, lambda w: F.struct(F.lit("name").alias("kind"), w.alias("block"))),
                    F.transform("domains", lambda d: F.struct(F.lit("domain").alias("kind"), d.alias("block"))),
                    F.when(F.col("id_value").isNotNull(),
                    F.array(F.struct(F.lit("id").alias("kind"), F.concat_ws(":", "scheme", "id_value").alias("block")))).otherwise(
                        F.array().cast("array<struct<kind:string,block:string>>")))
    return p.select("key", "type", F.col("attributes")["country"].alias("country"), *also, F.explode(keys).alias("k")).select("key", "type",
        "country", *also, "k.kind", "k.block")


def candidate_pairs(p: DataFrame, max_block: int = 100) -> DataFrame:
    """Pairs a < b that share a block of their type. A name block above max_block is split by country, and a
    part still above it is skipped; an exact block (domain, id) above it pairs its smallest key with the others.

    The cap is the operator's rule, as in the catalogue's semantics: it bounds a block's pairs, so no key can
    explode the join.
    """
    rows = block_rows(p)
    sizes = rows.groupBy("type", "kind", "block").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("first"))
    rows = rows.join(sizes, ["type", "kind", "block"])
    small = rows.where(F.col("n") <= max_block).withColumn("part", F.lit(""))
    large = rows.where((F.col("n") > max_block) & (F.col("kind") == "name")).withColumn("part",
        F.concat(F.lit("="), F.coalesce(X.casefold(F.trim("country")), F.lit("\0"))))
    parts = large.groupBy("type", "block", "part").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") <= max_block).drop("m")
    rows_in = small.select("type", "kind", "block", "part",
        "key").unionByName(large.join(parts, ["type", "block", "part"], "left_semi").select("type", "kind", "block", "part", "key"))
    a, b = rows_in.alias("a"), rows_in.alias("b")
    on = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("type", "kind", "block", "part")]
    pairs = a.join(b, on[0] & on[1] & on[2] & on[3] & (F.col("a.key") < F.col("b.key"))).select(F.col("a.key").alias("a"),
        F.col("b.key").alias("b"))
    star = rows.where((F.col("n") > max_block) & (F.col("kind") != "name") & (F.col("key") != F.col("first"))).select(F.col("first").alias("a"),
        F.col("key").alias("b"))
    return pairs.union(star).distinct()


def judge(pairs: DataFrame, p: DataFrame, threshold: float = 0.9, nudge_up: float = 0.05, nudge_down: float = 0.15) -> DataFrame:
    """pairs (a, b) -> a, b, kind (same_as, similar, different or null), score, reason.

    Shared ids or domains prove a match, different ones refuse it; else the best name similarity, nudged by shared
    attributes, decides at the threshold.
    """
    cols = ["names", "domains", "scheme", "id_value", "attributes"]
    left = p.select(F.col("key").alias("a"), *[F.col(c).alias(f"a_{c}") for c in cols])
    right = p.select(F.col("key").alias("b"), *[F.col(c).alias(f"b_{c}") for c in cols])
    x = pairs.join(left, "a").join(right, "b")
    same_scheme = F.coalesce(F.col("a_scheme") == F.col("b_scheme"), F.lit(False))
    id_equal = same_scheme & (F.col("a_id_value") == F.col("b_id_value"))
    shared = F.array_intersect("a_domains", "b_domains")
    has = (F.size("a_domains") > 0) & (F.size("b_domains") > 0)
    agree = id_equal | (has & (F.size(shared) > 0))
    against = (same_scheme & ~id_equal) | (has & (F.size(shared) == 0))
    similarity = X.name_similarity()
    grid = x.select("a", "b", agree.alias("agree"), against.alias("against"), id_equal.alias("by_id"), "a_attributes", "b_attributes",
                    F.explode_outer("a_names").alias("na"), "b_names").withColumn("nb", F.explode_outer("b_names"))
    best = grid.withColumn("s", similarity(F.coalesce("na", F.lit("")), F.coalesce("nb", F.lit("")))).groupBy("a", "b").agg(
        F.max("s").alias("s"), F.first("agree").alias("agree"), F.first("against").alias("against"), F.first("by_id").alias("by_id"),
        F.first("a_attributes").alias("ta"), F.first("b_attributes").alias("tb"))
    keys = F.array_intersect(F.map_keys("ta"), F.map_keys("tb"))
    nudge = F.aggregate(F.coalesce(keys, F.array().cast("array<string>")), F.lit(0.0), lambda acc, k: acc + F.when(
        X.casefold(F.trim(F.col("ta")[k])) == X.casefold(F.trim(F.col("tb")[k])), F.lit(nudge_up)).otherwise(F.lit(-nudge_down)))
    score = F.when(F.col("s") == 0, 0.0).otherwise(F.bround(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("s") + nudge)), 4))
    y = best.withColumn("score", score)
    kind = (F.when(F.col("against"), F.when(F.col("agree") | (F.col("score") >= threshold), "different")).when(F.col("agree"),
        "same_as").when(F.col("score") >= threshold, "similar"))
    reason = F.when(kind == "same_as", F.when(F.col("by_id"), "id").otherwise("domain")).when(kind == "different", "mismatch")
    return y.select("a", "b", kind.alias("kind"), F.when(kind == "same_as", 1.0).otherwise(F.col("score")).alias("score"),
        reason.alias("reason"))


def _fold(edges: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
    """One contested component: union-find, the smaller cluster into the larger; each cluster keeps its ids by scheme and
    the clusters that it may not merge with, so a step costs what the smaller one holds."""
    up = {k: k for k in members["key"]}
    cluster = {k: [k] for k in up}
    known = {k: {s: v} if isinstance(v, str) else {} for k, s, v in zip(members["key"], members["scheme"], members["id_value"])}
    apart: dict[str, set] = {k: set() for k in up}
    bad = edges["score"] < 0
    for a, b in zip(edges["a"][bad], edges["b"][bad]):
        if a in up and b in up:
            apart[a].add(b)
            apart[b].add(a)

    def root(k: str) -> str:
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    for _, a, b in sorted((-s, a, b) for a, b, s in zip(edges["a"], edges["b"], edges["score"]) if s >= 0):
        if a not in up or b not in up:
            continue
        x, y = root(a), root(b)
        if x == y:
            continue
        if len(cluster[x]) + len(apart[x]) < len(cluster[y]) + len(apart[y]):
            x, y = y, x
        if y in apart[x] or any(known[x].get(s, v) != v for s, v in known[y].items()):
            continue
        up[y] = x
        cluster[x] += cluster.pop(y)
        known[x] |= known.pop(y)
        for z in apart.pop(y):
            apart[z].discard(y)
            apart[z].add(x)
            apart[x].add(z)
    has_id = {k for k, v in zip(members["key"], members["id_value"]) if isinstance(v, str)}
    return pd.DataFrame([(k, min(c, key=lambda m: (m not in has_id, m))) for c in cluster.values() for k in c],
        columns=["key", "canonical"])


def merge_components(links: DataFrame, entities: DataFrame) -> DataFrame:
    """Ordered agglomeration: same_as links merge, strongest first, unless the clusters hold two different ids of
    one scheme or a pair that was judged different. -> key, canonical.

    Components of same_as links bound what can merge. Where a component holds no refused pair and no two ids of one scheme,
    nothing can be refused: all of it is one cluster, found by aggregation however large it is. Only contested components
    are folded in order, each in one task, as the order asks. The canonical key has an external id if any member
    has one, then is the smallest.
    """
    same = links.where("kind = 'same_as'").select("a", "b", "score")
    parts = cut(connected_components(same.select("a", "b")))
    side = {c: parts.select(F.col("node").alias(c), F.col("component").alias(f"c_{c}")) for c in ("a", "b")}
    inside = links.where("kind = 'different'").select("a", "b").join(side["a"], "a").join(side["b"], "b").where("c_a = c_b")
    ids = cut(entities.select("key", "scheme", "id_value").join(parts.select(F.col("node").alias("key"), F.col("component").alias("part")),
        "key"))
    clash = ids.where("id_value IS NOT NULL").groupBy("part", "scheme").agg(F.min("id_value").alias("x"),
        F.max("id_value").alias("y")).where("x <> y").select(F.col("part").alias("component"))
    contested = cut(inside.select(F.col("c_a").alias("component")).union(clash).distinct())

    quiet = ids.join(contested.withColumnRenamed("component", "part"), "part", "left_anti")
    head = quiet.groupBy("part").agg(F.min(F.struct(F.col("id_value").isNull().alias("none"), "key"))["key"].alias("canonical"))
    merged = quiet.join(head, "part").select("key", "canonical")

    loud = same.join(side["a"], "a").withColumnRenamed("c_a", "component").join(contested, "component", "left_semi").select("component",
        "a", "b", "score")
    refused = inside.select(F.col("c_a").alias("component"), "a", "b", F.lit(-1.0).alias("score"))
    members = ids.join(contested.withColumnRenamed("component", "part"), "part", "left_semi")
    folded = loud.unionByName(refused).groupBy("component").cogroup(members.groupBy("part")).applyInPandas(lambda e, m: _fold(e, m),
        "key string, canonical string")
    return merged.union(folded)


def rekey(facts: DataFrame, mapping: DataFrame) -> DataFrame:
    """facts (s_key, o_key, others) with both ends replaced by their canonical keys."""
    s = mapping.select(F.col("key").alias("s_key"), F.col("canonical").alias("_s"))
    o = mapping.select(F.col("key").alias("o_key"), F.col("canonical").alias("_o"))
    out = facts.join(s, "s_key", "left").join(o, "o_key", "left")
    return out.withColumn("s_key", F.coalesce("_s", "s_key")).withColumn("o_key", F.coalesce("_o", "o_key")).select(*facts.columns)


#: Rows of a unit when probes meet vectors, and how far a cosine by matrix product may be from the exact one.
_UNIT, _SLACK = 4_000, 1e-7


def _matrix(vectors: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors as rows, padded, and their lengths; one that is null, holds a null or is all zeros has cosine 0 with any."""
    rows = [None if v is None else np.asarray(v, dtype=object) for v in vectors]
    rows = [np.zeros(0) if v is None or any(x is None for x in v) else v.astype(float) for v in rows]
    out = np.zeros((len(rows), max(map(len, rows), default=0)))
    for k, v in enumerate(rows):
        out[k, :len(v)] = v
    with np.errstate(all="ignore"):
        norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return np.where(norm == 0, 0.0, out / norm), np.array([len(v) for v in rows])


def _near(probes: pd.DataFrame, vectors: pd.DataFrame, k: int) -> pd.DataFrame:
    """probe, key, c of the vectors that can be among the k nearest of a probe within this unit."""
    (a, na), (b, nb) = _matrix(probes["v"]), _matrix(vectors["v"])
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (a, b))
    keys, out = vectors["key"].to_numpy(), []
    for at in range(0, len(a), 256):
        with np.errstate(all="ignore"):
            c = a[at:at + 256] @ b.T
        c = np.where(na[at:at + 256, None] == nb[None, :], c, 0.0)
        c[np.isnan(c)] = 2.0  # above any cosine, as NaN is in an order
        own = probes["key"].to_numpy()[at:at + 256, None] == keys[None, :]
        c[own] = -3.0
        least = np.partition(c, -k, axis=1)[:, -k] if c.shape[1] > k else np.full(len(c), -2.0)
        i, j = np.nonzero((c >= least[:, None] - _SLACK) & ~own)
        out.append(pd.DataFrame({"probe": probes["key"].to_numpy()[at:at + 256][i], "key": keys[j], "c": c[i, j]}))
    return pd.concat(out) if out else pd.DataFrame({"probe": [], "key": [], "c": []})


def nearest_vectors(vectors: DataFrame, probes: DataFrame, k: int = 5, groups: list[str] | None = None) -> DataFrame:
    """vectors (key, v, group columns), probes alike -> probe, key, rank, cosine: the k largest cosines, ties to the
    smaller key. The probe set is stated. Units of probes meet units of vectors of their group in a matrix product, which
    leaves those within a slack of the k-th; only their cosines are computed exactly and ranked."""
    groups = groups or []

    def sized(df: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        x = df.select(F.struct(*[F.col(g).alias(g) for g in groups], F.lit(0).alias("all")).alias("g"), F.col("key").alias("key"),
            F.col("v").alias("v"))
        for g in groups:
            x = x.where(F.col(f"g.{g}").isNotNull())
        return x, x.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / _UNIT).cast("int").alias(name))

    (a, na), (b, nb) = sized(probes, "ua"), sized(vectors, "ub")
    units = cut(na.join(nb, "g"))

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        return df.join(units, "g").withColumn(own, F.pmod(F.hash("key"), F.col(own))).withColumn(other,
            F.explode(F.sequence(F.lit(0), F.col(other) - 1)))

    key = ["g", "ua", "ub"]
    kind = vectors.schema["key"].dataType.simpleString()
    found = dealt(a, "ua", "ub").groupBy(*key).cogroup(dealt(b, "ub", "ua").groupBy(*key)).applyInPandas(lambda p, v: _near(p, v, k),
        f"probe {kind}, key {kind}, c double")
    w = Window.partitionBy("probe")
    found = found.withColumn("at", F.row_number().over(w.orderBy(F.desc("c")))).withColumn("least",
        F.max(F.when(F.col("at") == k, F.col("c"))).over(w)).where(F.col("least").isNull() | (F.col("c") >= F.col("least") - _SLACK))
    pairs = found.select("probe", "key").join(probes.select(F.col("key").alias("probe"), F.col("v").alias("x")), "probe").join(
        vectors.select("key", F.col("v").alias("y")), "key")
    scored = pairs.select("probe", "key", F.round(cosine(F.col("x"), F.col("y")), 9).alias("cosine"))
    return scored.withColumn("rank", F.row_number().over(w.orderBy(F.desc("cosine"), "key"))).where(F.col("rank") <= k)
