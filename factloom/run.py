"""Whole runs from a configuration, and the commands of `python -m factloom`.

A configuration is JSON: documents {path, root, tier}, triples {path}, ontology (a path), gate
{refuse_not_found, mark, schema}, verdicts {path} (recorded answers of a judge, JSON lines of doc, s_key,
predicate, o_repr, verdict), output {path}. An unknown key is an error that names the nearest known one.
"""

from __future__ import annotations

import argparse
import json
from dataclasses import dataclass, field
from difflib import get_close_matches
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .eval import judges, metrics
from .functions.text import source_of
from .operators import claims, extract, ontology, spans, verify
from .schema import TIERS
from .sinks import schema_text, writers
from .sources import readers

_KEYS = {"documents": ("path", "root", "tier"), "triples": ("path",), "ontology": None, "gate": ("refuse_not_found", "mark", "schema"),
    "verdicts": ("path",), "output": ("path",)}
_REQUIRED = ("documents.path", "triples.path", "output.path")
EVIDENCE = "sig string, s_key string, s_type string, predicate string, o_kind string, o_repr string, o_type string, doc_id string, source string, tier_w double, start int, end int, origin string, confidence double, verdict string"
FACTS = "sig string, s_key string, s_type string, predicate string, o_kind string, o_repr string, o_type string, support bigint, documents bigint, tier_w double, confidence double, verdict string, review string, retired_at string"
ENTITIES = "type string, key string"


@dataclass
class Config:
    documents: dict
    triples: dict
    output: dict
    ontology: dict = field(default_factory=dict)
    gate: dict = field(default_factory=dict)
    verdicts: dict = field(default_factory=dict)


def load_config(text: str, base: str = ".") -> Config:
    """Configuration from JSON text; relative paths are below base."""
    data = json.loads(text)

    def known(key: str, keys, at: str) -> None:
        if key not in keys:
            near = get_close_matches(key, keys, 1)
            raise ValueError(f"{at}{key}: unknown key" + (f", did you mean {near[0]!r}?" if near else ""))

    for section, body in data.items():
        known(section, _KEYS, "")
        if (keys := _KEYS[section]) is not None:
            if not isinstance(body, dict):
                raise ValueError(f"{section}: expected an object")
            for k in body:
                known(k, keys, f"{section}.")
    for path in _REQUIRED:
        section, key = path.split(".")
        if not data.get(section, {}).get(key):
            raise ValueError(f"{path}: missing")

    def place(p: str) -> str:
        return p if "://" in p or p.startswith("/") else str(Path(base) / p)

    for section in ("documents", "triples", "verdicts", "output"):
        if "path" in data.get(section, {}):
            data[section]["path"] = place(data[section]["path"])
    if isinstance(data.get("ontology"), str):
        data["ontology"] = ontology.load(Path(place(data["ontology"])).read_text())
    return Config(**data)


def _tier_weight():
    return F.coalesce(F.create_map(*[F.lit(x) for kv in TIERS.items() for x in kv])[F.col("tier")], F.lit(TIERS["unverified"]))


def documents_of(spark: SparkSession, config: Config) -> DataFrame:
    tier = config.documents.get("tier", "unverified")
    return readers.with_path_ids(readers.read_directory(spark, config.documents["path"], tier=tier),
        config.documents.get("root", config.documents["path"]))


def evidence_of(spark: SparkSession, config: Config, docs: DataFrame | None = None, triples: DataFrame | None = None) -> DataFrame:
    """A row per triple that a document evidences: its fact, its span and source. Verdicts of the judge stand where they
    are recorded; a cited span that is not located gives not_found. Documents and triples are the configuration's unless given."""
    docs = documents_of(spark, config) if docs is None else docs
    triples = readers.read_triples(spark, config.triples["path"]) if triples is None else triples
    triples = readers.join_by_stem(triples, docs).where("doc_id IS NOT NULL")
    triples = triples.withColumn("doc", F.col("doc_id"))
    types = None
    if config.ontology.get("types"):
        rows = [(a, n) for n, b in config.ontology["types"].items() for a in (n, *b.get("aliases", []))]
        types = spark.createDataFrame(rows, "alias string, name string")
    facts = extract.triples_to_facts(triples, docs, types).withColumnRenamed("doc", "doc_id").withColumn("o_type", F.col("object_type"))
    x = facts.join(docs.select("doc_id", "text", "uri", "tier"), "doc_id")
    status = spans.span_status(F.col("doc_id"), F.col("doc_id"), F.col("text"), F.col("start"), F.col("end"), F.lit(None).cast("string"))
    x = x.withColumn("verdict", F.when(status == "located", "unchecked").otherwise("not_found"))
    if config.verdicts.get("path"):
        key = ["doc_id", "s_key", "predicate", "o_repr"]
        said = spark.read.schema("doc string, s_key string, predicate string, o_repr string, verdict string").json(config.verdicts["path"]).withColumnRenamed("doc",
            "doc_id")
        said = said.groupBy(*key).agg(F.max("verdict").alias("_said"))
        x = x.join(said, key, "left").withColumn("verdict",
            F.when(F.col("verdict") == "unchecked", F.coalesce("_said", "verdict")).otherwise(F.col("verdict")))
    sig = claims.signature(F.col("s_key"), F.col("predicate"), F.col("o_repr"))
    x = x.withColumn("sig", sig).withColumn("source", source_of(F.col("uri"), F.col("doc_id"))).withColumn("tier_w", _tier_weight())
    return x.select(*[c.split()[0] for c in EVIDENCE.split(", ")])


def facts_of(evidence: DataFrame) -> DataFrame:
    """Evidence -> one row per fact."""
    key = ["sig", "s_key", "s_type", "predicate", "o_kind", "o_repr", "o_type"]
    return claims.merge_claims(evidence.withColumn("retrieved_at", F.lit(None).cast("timestamp")), key, "verdict").drop("retrieved_at")


def gated_facts(spark: SparkSession, config: Config, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The facts of some evidence that the gate keeps, and those that it refuses."""
    facts = facts_of(evidence)
    problem = None
    if config.ontology and config.gate.get("schema", True):
        facts = ontology.schema_problems(spark, facts, config.ontology)
        problem = F.col("problem")
    gated = facts.withColumn("gate",
        verify.gate(F.col("verdict"), problem, config.gate.get("refuse_not_found", False), config.gate.get("mark", False)))
    kept, refused = schema_text.split_gate(gated)
    return kept.withColumn("retired_at", F.lit(None).cast("string")).select(*[c.split()[0] for c in FACTS.split(", ")]), refused


def validate(spark: SparkSession, config: Config) -> dict[str, int]:
    """Documents and another extractor's triples -> grounded, gated, merged facts in the output store. Returns counts."""
    evidence = evidence_of(spark, config)
    kept, refused = gated_facts(spark, config, evidence)
    store = writers.JsonLinesStore(spark, config.output["path"])
    entities = kept.select(F.col("s_type").alias("type"), F.col("s_key").alias("key")).distinct()
    counts = store.replace(facts=kept, entities=entities, evidence=evidence.join(kept.select("sig"), "sig", "left_semi"))
    refused.write.mode("overwrite").json(f"{config.output['path'].rstrip('/')}/refused")
    return counts | {"refused": spark.read.schema(refused.schema).json(f"{config.output['path'].rstrip('/')}/refused").count()}


def reconcile(spark: SparkSession, path: str, gone: list[str], at: str, hard_delete: bool = False) -> dict[str, int]:
    """Withdraw documents from a store: facts lose their evidence; those without any left are retired at `at`, or
    dropped. Running it twice changes nothing more."""
    store = writers.JsonLinesStore(spark, path)
    facts, evidence = store.read("facts", FACTS), store.read("evidence", EVIDENCE)
    named = spark.createDataFrame([(g,) for g in gone], "doc_id string")
    left = claims.retract(evidence, ["sig"], named)
    x = facts.join(left.select("sig", F.col("support").alias("_left"), "cited", "retired"), "sig", "left")
    hit = F.coalesce("cited", F.lit(False)) & F.col("retired_at").isNull()
    out = x.withColumn("support", F.when(hit, F.col("_left")).otherwise(F.col("support"))).withColumn("retired_at",
        F.when(hit & F.col("retired"), F.lit(at)).otherwise(F.col("retired_at")))
    if hard_delete:
        out = out.where("retired_at IS NULL")
    counts = x.agg(F.count_if(hit).alias("cited"), F.count_if(hit & F.col("retired")).alias("retired")).first().asDict()
    written = store.replace(facts=out.select(*facts.columns), entities=store.read("entities", ENTITIES),
        evidence=evidence.join(named, "doc_id", "left_anti").select(*evidence.columns))
    return counts | written


def evaluate(spark: SparkSession, gold: str, predicted: str) -> DataFrame:
    """Gold and predicted facts (JSON lines of doc_id, ord, subject, predicate, obj) -> the extraction report."""
    schema = "doc_id string, ord bigint, subject string, predicate string, obj string"
    return metrics.outcome_report(metrics.match_three_passes(spark.read.schema(schema).json(gold),
        spark.read.schema(schema).json(predicted)), "predicate")


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="factloom")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("validate", help="documents and triples to a store")
    c.add_argument("config")
    c = sub.add_parser("reconcile", help="withdraw documents from a store")
    c.add_argument("store")
    c.add_argument("documents", nargs="+")
    c.add_argument("--at", required=True)
    c.add_argument("--hard-delete", action="store_true")
    c = sub.add_parser("eval", help="report of predicted facts against gold")
    c.add_argument("gold")
    c.add_argument("predicted")
    c = sub.add_parser("ontology", help="types, diagnostics, differences, a type's predicates, statements")
    c.add_argument("what", choices=["types", "validate", "diff", "snippet", "ddl"])
    c.add_argument("files", nargs="+")
    c.add_argument("--type")
    c.add_argument("--limit", type=int, default=25)
    c = sub.add_parser("label", help="sheets to fill by hand, and the way back")
    c.add_argument("what", choices=["make", "read"])
    c.add_argument("source")
    c.add_argument("out")
    c.add_argument("--choices", nargs="+", default=["supported", "contradicted", "not_found"])
    c.add_argument("--per-sheet", type=int, default=50)
    a = p.parse_args(args)

    def session() -> SparkSession:
        return spark or SparkSession.builder.appName("factloom").getOrCreate()

    def say(x) -> None:
        print(json.dumps(x, default=str))

    if a.command == "validate":
        say(validate(session(), load_config(Path(a.config).read_text(), str(Path(a.config).parent))))
    elif a.command == "reconcile":
        say(reconcile(session(), a.store, a.documents, a.at, a.hard_delete))
    elif a.command == "eval":
        for r in evaluate(session(), a.gold, a.predicted).orderBy("predicate").collect():  # a row per predicate
            say(r.asDict())
    elif a.command == "label":
        s = session()
        if a.what == "make":
            judges.make_sheets(s.read.schema("id string, question string").json(a.source), a.choices,
                a.per_sheet).write.mode("overwrite").json(a.out)
        else:
            judges.read_sheets(s.read.schema("sheet bigint, text string").json(a.source)).write.mode("overwrite").json(a.out)
    else:
        found = [ontology.load(Path(f).read_text()) for f in a.files]
        if a.what == "types":
            say(sorted(found[0].get("types", {})))
        elif a.what == "ddl":
            print("\n".join(schema_text.ddl(found[0])))
        elif a.what == "snippet":
            say(ontology.snippet(found[0], a.type, a.limit))
        elif a.what == "validate":
            problems = ontology.diagnostics(found[0])
            for code, path in problems:
                print(f"{path}: {code}")
            return int(bool(problems))
        else:
            for r in ontology.diff(session(), *found[:2]).orderBy("path").collect():  # a row per changed declaration
                say(r.asDict())
    return 0
