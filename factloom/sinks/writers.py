"""Writers: JSON lines with a manifest, N-Triples, Cypher, typed CSV, node-link."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.claims import upsert
from ..shared import cut


def scoped(key, tenant: str | None):
    """Key of a tenant: tenant/key."""
    return F.concat_ws("/", F.lit(tenant), key) if tenant else key


def manifest(entities: DataFrame, facts: DataFrame, links: DataFrame) -> DataFrame:
    """One row: counts of entities, facts, edges, properties and links."""
    f = facts.agg(F.count(F.lit(1)).alias("facts"), F.count_if(F.col("o_kind") == "entity").alias("edges"),
        F.count_if(F.col("o_kind") != "entity").alias("properties"))
    return entities.agg(F.count(F.lit(1)).alias("entities")).crossJoin(f).crossJoin(links.agg(F.count(F.lit(1)).alias("links")))


class JsonLinesStore:
    """entities, facts, links and evidence as JSON lines. A version names, for each table, the folders that make it up: a
    write replaces or extends the tables it is given, and the others are carried over as they are."""

    KEYS = {"entities": ["type", "key"], "facts": ["sig"], "links": ["kind", "source_key", "target_key"], "evidence": ["sig", "doc_id"]}

    def __init__(self, spark: SparkSession, path: str):
        from ..streaming.micro import Versions

        self.spark, self.path = spark, path.rstrip("/")
        self.versions = Versions(spark, self.path)

    def read(self, kind: str, schema) -> DataFrame:
        folders = self.versions.note().get("tables", {}).get(kind, [])
        paths = [f"{self.path}/{f}" for f in folders]
        return self.spark.read.schema(schema).json(paths) if paths else self.spark.createDataFrame([], schema)

    def counts(self) -> dict[str, int]:
        return self.versions.note().get("counts", {})

    def _write(self, tables: dict[str, DataFrame], extend: bool) -> dict[str, int]:
        note, v = self.versions.note(), self.versions.current()
        v = 0 if v is None else v + 1
        held, counts = dict(note.get("tables", {})), dict(note.get("counts", {}))
        for kind, df in tables.items():
            folder = f"v{v}/{kind}"
            df.write.mode("overwrite").json(f"{self.path}/{folder}")
            n = self.spark.read.schema(df.schema).json(f"{self.path}/{folder}").count()
            held[kind] = [*held.get(kind, []), folder] if extend else [folder]
            counts[kind] = counts.get(kind, 0) + n if extend else n
        self.versions.commit(v, {"tables": held, "counts": counts})
        return {kind: counts[kind] for kind in tables}

    def replace(self, **tables: DataFrame) -> dict[str, int]:
        return self._write(tables, False)

    def append(self, **tables: DataFrame) -> dict[str, int]:
        """Rows are added behind those stored, and counted with them."""
        return self._write(tables, True)

    def merge(self, **tables: DataFrame) -> dict[str, int]:
        """Rows of a known key are replaced, others added."""
        return self._write({k: upsert(self.read(k, df.schema), df, self.KEYS[k]) for k, df in tables.items()}, False)


def plain_facts(facts: DataFrame) -> DataFrame:
    """Facts that may stand as a plain triple: asserted, in no scope, not outvoted, not retired."""
    return facts.where((F.col("polarity") == "asserted") & (F.size(F.coalesce("qualifiers",
        F.create_map().cast("map<string,string>"))) == 0)
                       & (F.coalesce("outcome", F.lit("")) != "lost") & F.col("retired_at").isNull())


def _iri(c):
    return F.concat(F.lit("<urn:factloom:"), F.url_encode(c), F.lit(">"))


def _literal(c):
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.concat(F.lit('"'), c, F.lit('"'))


def ntriples(facts: DataFrame) -> DataFrame:
    """facts (sig, s_key, predicate, o_kind, o_key, o_repr, confidence, polarity, ...) -> value: N-Triples lines. Each fact is
    a reified statement; plain ones are a triple too."""
    obj = F.when(F.col("o_kind") == "entity", _iri(F.col("o_key"))).otherwise(_literal(F.col("o_repr")))
    node = F.concat(F.lit("_:"), F.concat(F.lit("f"), F.left("sig", F.lit(32))))
    rdf = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
    parts = [(f"<{rdf}type>", F.lit(f"<{rdf}Statement>")), (f"<{rdf}subject>", _iri(F.col("s_key"))),
        (f"<{rdf}predicate>", _iri(F.col("predicate"))), (f"<{rdf}object>", obj),
             ("<urn:factloom:confidence>",
             F.concat(_literal(F.col("confidence").cast("string")), F.lit("^^<http://www.w3.org/2001/XMLSchema#double>")))]
    reified = facts.select(F.explode(F.array(*[F.concat_ws(" ", node, F.lit(p), o, F.lit(".")) for p, o in parts])).alias("value"))
    return reified.union(plain_facts(facts).select(F.concat_ws(" ", _iri(F.col("s_key")), _iri(F.col("predicate")), obj,
        F.lit(".")).alias("value")))


def cypher(facts: DataFrame) -> DataFrame:
    """One MERGE statement per edge or property."""
    def q(c):
        return F.concat(F.lit("'"), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))

    def name(c):
        return F.concat(F.lit("`"), F.replace(c, F.lit("`"), F.lit("``")), F.lit("`"))

    s = F.concat(F.lit("MERGE (s:"), name(F.col("s_type")), F.lit(" {key: "), q(F.col("s_key")), F.lit("}) "))
    edge = F.concat(s, F.lit("MERGE (o:"), name(F.col("o_type")), F.lit(" {key: "), q(F.col("o_key")), F.lit("}) MERGE (s)-[:"),
        name(F.col("predicate")), F.lit(" {sig: "), q(F.col("sig")), F.lit("}]->(o);"))
    prop = F.concat(s, F.lit("SET s."), name(F.col("predicate")), F.lit(" = "), q(F.col("o_repr")), F.lit(";"))
    return facts.select(F.when(F.col("o_kind") == "entity", edge).otherwise(prop).alias("value"))


def write_graph_csv(entities: DataFrame, facts: DataFrame, path: str) -> None:
    """Node rows by type and relation rows by predicate, partitioned, with a header; the last row of a key wins."""
    last = entities.groupBy("type", "key").agg(F.max_by(F.struct("label", "external_id"), "ord").alias("x")).select("type", "key", "x.*")
    last.write.mode("overwrite").partitionBy("type").option("header", True).csv(f"{path}/nodes")
    facts.where("o_kind = 'entity'").select("predicate", F.col("s_key").alias("start"), F.col("o_key").alias("end"),
        "confidence").write.mode("overwrite").partitionBy("predicate").option(
        "header", True).csv(f"{path}/relations")


def digest(rows: DataFrame) -> str:
    """Hash of a table that does not depend on the order of its rows: its row hashes are summed modulo 2^64, twice."""
    parts = [F.to_json(F.struct(*rows.columns))]
    r = rows.select(F.xxhash64(F.lit(1), *parts).alias("a"), F.xxhash64(F.lit(2), *parts).alias("b")).agg(
        F.count(F.lit(1)), *[F.sum(F.col(c).cast("decimal(38,0)")) for c in "ab"]).first()
    return hashlib.sha256("|".join(str(x) for x in r).encode()).hexdigest()


def transaction_groups(rows: DataFrame, order: list[str], size: int) -> DataFrame:
    """Rows packed in order into groups of at most size, without one task that sorts them all: ranges first, then counts."""
    parts = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i",
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    parts = cut(parts)
    sizes = {r["_p"]: r["n"] for r in parts.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).collect()}  # one entry per partition
    starts, total = {}, 0
    for p in sorted(sizes):
        starts[p], total = total, total + sizes[p]
    offset = F.create_map(*[F.lit(x) for kv in starts.items() for x in kv]) if starts else None
    at = (offset[F.col("_p")] if starts else F.lit(0)) + F.col("_i")
    return parts.withColumn("transaction", F.floor(at / size)).drop("_p", "_i")
