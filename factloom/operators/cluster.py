"""Clustering of inferred type and predicate candidates, strongest links first, with refusals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..shared import cut
from .naming import _ratio

#: Strength of a link: the same name, a name that is an alias, alike or evidenced by the same values.
SAME, ALIAS, ALIKE = 3, 2, 1


def _forms(candidates: DataFrame) -> DataFrame:
    """Each candidate's names, folded: its own (place 0) and its aliases."""
    said = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    return candidates.select("id", F.posexplode(said).alias("place", "said")).select("id", "place",
        X.fold(X.singular(F.col("said"))).alias("form")).where("form <> ''")


def candidate_links(candidates: DataFrame, evidence: DataFrame | None = None, threshold: float = 0.9, min_shared: int = 2) -> DataFrame:
    """candidates (id, name, aliases), evidence (id, subject, value) -> a, b, strength, reason (the strongest of each pair).

    Names that meet are found by an equi-join on their folded forms, shared evidence by one on (subject, value); names that are
    only alike are compared inside blocks of equal first letter and like length.
    """
    f = _forms(candidates)
    a, b = f.alias("a"), f.alias("b")
    met = a.join(b, (F.col("a.form") == F.col("b.form")) & (F.col("a.id") < F.col("b.id"))).select(
        F.col("a.id").alias("a"), F.col("b.id").alias("b"),
        F.when((F.col("a.place") == 0) & (F.col("b.place") == 0), SAME).otherwise(ALIAS).alias("strength"),
        F.when((F.col("a.place") == 0) & (F.col("b.place") == 0), "same name").otherwise("alias").alias("reason"))
    own = f.where("place = 0").select("id", "form", F.left("form", F.lit(1)).alias("block"))
    p, q = own.alias("p"), own.alias("q")
    near = p.join(q, (F.col("p.block") == F.col("q.block")) & (F.col("p.id") < F.col("q.id")) & (F.col("p.form") != F.col("q.form"))
                  & (2 * F.least(F.length("p.form"), F.length("q.form")) >= threshold * (F.length("p.form") + F.length("q.form"))))
    alike = near.where(_ratio()(F.col("p.form"), F.col("q.form")) >= threshold).select(F.col("p.id").alias("a"), F.col("q.id").alias("b"),
        F.lit(ALIKE).alias("strength"), F.lit("alike").alias("reason"))
    out = met.union(alike)
    if evidence is not None:
        e = evidence.select("id", "subject", "value").distinct()
        x, y = e.alias("x"), e.alias("y")
        both = x.join(y, (F.col("x.subject") == F.col("y.subject")) & (F.col("x.value") == F.col("y.value")) & (F.col("x.id") < F.col("y.id")))
        shared = both.groupBy(F.col("x.id").alias("a"),
            F.col("y.id").alias("b")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_shared)
        out = out.union(shared.select("a", "b", F.lit(ALIKE), F.lit("shared evidence")))
    return out.groupBy("a", "b").agg(F.max(F.struct("strength", "reason")).alias("x")).select("a", "b", "x.*")


def refusals(links: DataFrame, lineage: DataFrame) -> DataFrame:
    """links (a, b) that may not be followed: one candidate is a kind of the other, by lineage (id, ancestor)."""
    up = links.join(lineage.select(F.col("id").alias("a"), F.col("ancestor").alias("b")), ["a", "b"], "left_semi").select("a", "b")
    down = links.join(lineage.select(F.col("id").alias("b"), F.col("ancestor").alias("a")), ["a", "b"], "left_semi").select("a", "b")
    return up.union(down).distinct()


def clusters(candidates: DataFrame, links: DataFrame, refused: DataFrame) -> DataFrame:
    """candidates (id, name, rank), links (a, b, strength), refused (a, b) -> id, cluster (the id of its lead), name (the lead's): links are followed
    strongest first, unless the two clusters hold a refused pair. The lead has the smallest rank, then the smallest id.

    Candidates are an inferred schema, so a component is small; components are folded apart from each other.
    """
    from .resolve import merge_components

    rows = links.select("a", "b", F.lit("same_as").alias("kind"), F.col("strength").cast("double").alias("score"),
        F.lit(None).cast("string").alias("reason"))
    apart = refused.select("a", "b", F.lit("different"), F.lit(1.0), F.lit(None).cast("string"))
    nobody = candidates.select(F.col("id").alias("key"), F.lit(None).cast("string").alias("scheme"),
        F.lit(None).cast("string").alias("id_value"))
    merged = cut(merge_components(rows.union(apart), nobody))
    found = candidates.join(merged.select(F.col("key").alias("id"), "canonical"), "id", "left").withColumn("canonical",
        F.coalesce("canonical", "id"))
    lead = found.groupBy("canonical").agg(F.min(F.struct("rank", "id", "name")).alias("lead"))
    return found.join(lead, "canonical").select("id", F.col("lead.id").alias("cluster"), F.col("lead.name").alias("name"))
