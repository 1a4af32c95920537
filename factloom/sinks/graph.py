"""A graph store as a plan of writes: nodes, edges, claims, projections and links in order, with guarded merges and a report.

The plan is a table; a driver of a store, or a test, takes its rows group by group. Nothing here needs a server.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.claims import rebase
from ..operators.fold import edges, properties
from ..shared import cut
from .writers import plain_facts, scoped

#: Kinds of rows in the order in which they are written: nodes before what refers to them, links last.
KINDS = ("entity", "edge", "claim", "projection", "link")


def graph_nodes(entities: DataFrame, facts: DataFrame) -> DataFrame:
    """type, key, label: every listed entity and both ends of every fact; what is listed wins."""
    listed = entities.select("type", "key", "label", F.lit(0).alias("place"))
    ends = facts.select(F.col("s_type").alias("type"), F.col("s_key").alias("key"), F.lit(None).cast("string").alias("label"),
        F.lit(1).alias("place")).union(
        edges(facts).select("o_type", "o_key", F.lit(None).cast("string"), F.lit(1)))
    return listed.union(ends).groupBy("type", "key").agg(F.min_by("label", "place").alias("label"))


def projections(facts: DataFrame, multi: list[str]) -> DataFrame:
    """s_type, predicate, s_key, values: what stands on a node as a plain property. A single-valued predicate has its best
    claim (support, then confidence, then the smaller value), one of `multi` all of them in that order."""
    plain = plain_facts(properties(facts)).where("o_repr IS NOT NULL")
    place = F.struct((-F.col("support")).alias("s"), (-F.col("confidence")).alias("c"), F.col("o_repr").alias("v"))
    each = plain.groupBy("s_type", "predicate", "s_key", "o_repr").agg(F.min(place).alias("at"))
    several = F.col("predicate").isin(*multi) if multi else F.lit(False)
    key = ["s_type", "predicate", "s_key"]
    one = each.where(~several).groupBy(*key).agg(F.array(F.min("at")["v"]).alias("values"))
    all_ = each.where(several).groupBy(*key).agg(F.transform(F.sort_array(F.collect_list("at")), lambda x: x["v"]).alias("values"))
    return one.union(all_)


def write_plan(entities: DataFrame, facts: DataFrame, links: DataFrame, multi: list[str] | None = None,
    tenant: str | None = None) -> DataFrame:
    """stage (place of the kind), kind, grp (the types and predicate that share a statement), key, row (JSON): every write of a graph.

    Keys and signatures are the tenant's, and each row names it, so no tenant writes on another's node. Sorted by
    (stage, grp, key) the same graph gives the same plan.
    """
    def own(c: Column) -> Column:
        return scoped(c, tenant)

    tenant_ = F.lit(tenant).alias("tenant")

    def rows(df: DataFrame, kind: str, grp: list[Column], key: Column, *fields: Column) -> DataFrame:
        return df.select(F.lit(KINDS.index(kind)).alias("stage"), F.lit(kind).alias("kind"), F.concat_ws(" ", *grp).alias("grp"),
            key.alias("key"), F.to_json(F.struct(*fields, tenant_)).alias("row"))

    c = F.col
    s_key, sig = own(c("s_key")), own(c("sig"))
    props = F.struct("confidence", "support", "polarity", "retired_at").alias("props")
    out = [
        rows(graph_nodes(entities, facts), "entity", [c("type")], own(c("key")), own(c("key")).alias("key"), c("label")),
        rows(edges(facts), "edge", [c("s_type"), c("predicate"), c("o_type")], sig, sig.alias("signature"), s_key.alias("subject_key"),
        own(c("o_key")).alias("object_key"), props),
        rows(properties(facts), "claim", [c("s_type"), c("predicate")], sig, sig.alias("signature"), s_key.alias("subject_key"),
        c("o_repr").alias("value"), props),
        rows(projections(facts, multi or []), "projection", [c("s_type"), c("predicate")], s_key, s_key.alias("subject_key"),
        c("values").alias("value")),
        rows(links, "link", [F.upper("kind")], F.concat_ws(" ", own(c("source_key")), own(c("target_key"))),
        own(c("source_key")).alias("source_key"), own(c("target_key")).alias("target_key"), c("score"), c("reason")),
    ]
    plan = out[0]
    for o in out[1:]:
        plan = plan.union(o)
    return plan


def _name(c: Column) -> Column:
    return F.concat(F.lit("`"), F.replace(c, F.lit("`"), F.lit("``")), F.lit("`"))


def statements(plan: DataFrame) -> DataFrame:
    """A plan -> stage, kind, grp, statement, rows: one parametrised statement a group ($rows is a list of its rows)."""
    groups = plan.groupBy("stage", "kind", "grp").agg(F.count(F.lit(1)).alias("rows"))
    part = F.split("grp", " ")

    def name(k: int) -> Column:
        return _name(F.get(part, F.lit(k)))

    head = F.lit("UNWIND $rows AS r ")
    owner = " WHERE n.tenant IS NOT DISTINCT FROM r.tenant"
    text = (F.when(F.col("kind") == "entity",
        F.concat(head, F.lit("MERGE (n:"), name(0), F.lit(" {key: r.key}) ON CREATE SET n.tenant = r.tenant WITH n, r"), F.lit(owner),
        F.lit(" SET n.label = coalesce(r.label, n.label)")))
            .when(F.col("kind") == "edge",
            F.concat(head, F.lit("MATCH (s:"), name(0), F.lit(" {key: r.subject_key}), (o:"), name(2),
            F.lit(" {key: r.object_key}) MERGE (s)-[f:"), name(1), F.lit(" {signature: r.signature}]->(o) SET f += r.props")))
            .when(F.col("kind") == "claim",
            F.concat(head, F.lit("MATCH (s:"), name(0),
            F.lit(" {key: r.subject_key}) MERGE (s)-[:CLAIMS]->(f:Claim {signature: r.signature}) SET f += r.props, f.value = r.value")))
            .when(F.col("kind") == "projection",
            F.concat(head, F.lit("MATCH (s:"), name(0), F.lit(" {key: r.subject_key}) SET s."), name(1), F.lit(" = r.value")))
            .otherwise(F.concat(head, F.lit("MATCH (a {key: r.source_key}), (b {key: r.target_key}) MERGE (a)-[l:"), name(0),
            F.lit("]->(b) SET l.score = r.score, l.reason = r.reason"))))
    return groups.select("stage", "kind", "grp", text.alias("statement"), "rows")


def compare_and_set(stored: DataFrame, batch: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """stored (key, version, columns), batch (key, read_version, the same columns) -> the store after the batch, and the rows of the
    batch that were not written, because the stored row has moved on since they were read (or is new, or gone)."""
    columns = [c for c in stored.columns if c not in (*key, "version")]
    now = stored.select(*key, F.col("version").alias("_now"))
    x = batch.join(now, key, "left")
    fits = F.col("_now").eqNullSafe(F.col("read_version"))
    good = x.where(fits).select(*key, (F.coalesce("_now", F.lit(0)) + 1).alias("version"), *columns)
    after = stored.select(*key, "version", *columns).join(good.select(*key), key, "left_anti").unionByName(good)
    return after, x.where(~fits).select(*batch.columns)


def merge_moved(moved: DataFrame, read: DataFrame, stored: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Rows that compare_and_set turned back, merged three ways with what they were read as and what is stored now, ready to be tried again."""
    mine = moved.select(*key, *columns)
    keys = mine.select(*key)
    merged = rebase(mine, read.join(keys, key, "left_semi").select(*key, *columns),
        stored.join(keys, key, "left_semi").select(*key, *columns), key, columns)
    return merged.join(stored.select(*key, F.col("version").alias("read_version")), key, "left")


def merge_until_settled(read: Callable[[], DataFrame], write: Callable[[DataFrame], None], mine: DataFrame, key: list[str],
    tries: int = 5) -> int:
    """Write rows (key, read_version, columns) read earlier: what has moved is merged and tried again. Returns the rounds it took."""
    columns = [c for c in mine.columns if c not in (*key, "read_version")]
    seen = cut(read())
    batch = cut(mine)
    for turn in range(1, tries + 1):
        stored = cut(read())
        after, moved = compare_and_set(stored, batch, key)
        write(after)
        moved = cut(moved)
        if not moved.limit(1).count():
            return turn
        batch = cut(merge_moved(moved, seen, stored, key, columns))
    raise RuntimeError(f"rows still move after {tries} tries")


def write_report(stored: DataFrame, written: DataFrame, key: list[str], kind: str = "kind") -> DataFrame:
    """By kind: rows that were new, rows merged into a stored one, rows that changed nothing."""
    columns = [c for c in written.columns if c not in (*key, kind)]
    old = stored.select(*key, F.struct(*columns).alias("_old"))
    x = written.select(kind, *key, F.struct(*columns).alias("_new")).join(old, key, "left")
    same = F.col("_new").eqNullSafe(F.col("_old"))
    return x.groupBy(kind).agg(F.count_if(F.col("_old").isNull()).alias("written"),
        F.count_if(F.col("_old").isNotNull() & ~same).alias("merged"), F.count_if(F.col("_old").isNotNull() & same).alias("skipped"))


def write_verdicts(facts: DataFrame, verdicts: DataFrame, column: str = "verdict") -> DataFrame:
    """facts (sig, others) with the verdict of verdicts (sig, verdict) where there is one."""
    said = verdicts.groupBy("sig").agg(F.max("verdict").alias("_said"))
    return facts.join(said, "sig", "left").withColumn(column,
        F.coalesce("_said", F.col(column) if column in facts.columns else F.lit(None))).drop("_said")


def graph_frames(entities: DataFrame, facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices (id, type, label, properties as a map) and edges (src, dst, relationship, sig, confidence) of a multigraph."""
    values = plain_facts(properties(facts)).groupBy("s_type", "s_key",
        "predicate").agg(F.min_by("o_repr", F.struct((-F.col("support")).alias("s"), "o_repr")).alias("v"))
    held = values.groupBy(F.col("s_type").alias("type"),
        F.col("s_key").alias("key")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("predicate", "v")))).alias("properties"))
    nodes = graph_nodes(entities, facts).join(held, ["type", "key"], "left")
    return (nodes.select(F.col("key").alias("id"), "type", "label",
        F.coalesce("properties", F.create_map().cast("map<string,string>")).alias("properties")),
            edges(facts).select(F.col("s_key").alias("src"), F.col("o_key").alias("dst"), F.col("predicate").alias("relationship"), "sig",
            "confidence"))


def stored_fact(rows: DataFrame, tenant: str | None = None) -> DataFrame:
    """Stored relationship rows (subject_key, object_key, signature, others) as facts, without the tenant in their keys."""
    def bare(c: str) -> Column:
        return F.regexp_replace(c, f"^{tenant}/", "") if tenant else F.col(c)

    rest = [c for c in rows.columns if c not in ("subject_key", "object_key", "signature", "tenant")]
    mine = rows.where(F.col("tenant").eqNullSafe(F.lit(tenant))) if "tenant" in rows.columns else rows
    return mine.select(bare("subject_key").alias("s_key"), bare("object_key").alias("o_key"), bare("signature").alias("sig"), *rest)
