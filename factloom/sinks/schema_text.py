"""Statements and checks for a store's schema, the node-link dump, and the log of what a gate refused."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ddl(ontology: dict) -> list[str]:
    """One uniqueness constraint per type's key, and an index for each key predicate and each predicate of a value."""
    def name(s: str) -> str:
        return "`" + s.replace("`", "``") + "`"

    types = ontology.get("types", {})
    out = [f"CREATE CONSTRAINT IF NOT EXISTS FOR (n:{name(t)}) REQUIRE n.key IS UNIQUE;" for t in sorted(types)]
    for t in sorted(types):
        out += [f"CREATE INDEX IF NOT EXISTS FOR (n:{name(t)}) ON (n.{name(k)});" for k in types[t].get("keys", [])]
    for p, b in sorted(ontology.get("predicates", {}).items()):
        if b.get("range") in types:
            out.append(f"CREATE INDEX IF NOT EXISTS FOR ()-[r:{name(p)}]-() ON (r.sig);")
    return out


def uniqueness_violations(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys that more than one row has, and how many: what a uniqueness constraint would refuse."""
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def split_gate(facts: DataFrame, gate: str = "gate") -> tuple[DataFrame, DataFrame]:
    """Facts with a gate struct (action, reason, review) -> those accepted, with review, and those refused, with reason."""
    kept = facts.where(F.col(f"{gate}.action") == "accept").withColumn("review", F.col(f"{gate}.review")).drop(gate)
    return kept, facts.where(F.col(f"{gate}.action") != "accept").withColumn("reason", F.col(f"{gate}.reason")).drop(gate)


def write_node_link(entities: DataFrame, facts: DataFrame, path: str) -> None:
    """nodes and links as JSON lines, each in its folder, written in parallel."""
    entities.select(F.col("key").alias("id"), "type", "label").write.mode("overwrite").json(f"{path}/nodes")
    facts.where("o_kind = 'entity'").select(F.col("s_key").alias("source"), F.col("o_key").alias("target"), F.col("predicate").alias("key"),
        "confidence").write.mode("overwrite").json(f"{path}/links")
