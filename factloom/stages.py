"""A document run as a chain of named stages: each is a function of the tables so far, built-in or the user's own.

The tables of a run are a dictionary: documents, chunks, candidates, facts, entities, links, refused. A stage takes the
run's context and the tables and returns those that it makes or changes. Names are looked up in a registry, or imported as
`module:name`; every stage has a pass-through that changes nothing.
"""

from __future__ import annotations

import importlib
import inspect
from collections.abc import Callable
from dataclasses import dataclass, field
from difflib import get_close_matches

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as X
from .functions.values import combined_confidence, verdict_weight
from .operators import claims, extract, naming, ontology, resolve, spans, verify
from .shared import cut
from .sinks import schema_text, writers

Tables = dict[str, DataFrame]
#: The order in which stages run.
ORDER = ("chunker", "router", "extractor", "normalizer", "grounder", "corroborator", "resolver", "scorer", "gate", "sink")


@dataclass
class Context:
    spark: SparkSession
    ontology: dict = field(default_factory=dict)
    providers: dict[str, Callable[[DataFrame], DataFrame]] = field(default_factory=dict)  # by stage: what a model would do
    counts: dict[str, dict] = field(default_factory=dict)


Stage = Callable[[Context, Tables], Tables]
_BUILT: dict[tuple[str, str], Callable[..., Stage]] = {}


def builtin(stage: str, use: str):
    def add(make: Callable[..., Stage]) -> Callable[..., Stage]:
        _BUILT[stage, use] = make
        return make

    return add


def build(stage: str, use: str = "passthrough", **options) -> Stage:
    """A stage by its short name, or `module:name` of a function that takes the options. Unknown names, stages and options are errors."""
    if stage not in ORDER:
        raise ValueError(f"{stage}: no such stage; one of {', '.join(ORDER)}")
    if use == "passthrough":
        return lambda context, tables: {}
    if ":" in use:
        module, _, name = use.partition(":")
        make = getattr(importlib.import_module(module), name, None)
        if make is None:
            raise ValueError(f"{stage}: {module} has no {name}")
    else:
        known = sorted(u for s, u in _BUILT if s == stage)
        if (stage, use) not in _BUILT:
            near = get_close_matches(use, known, 1)
            raise ValueError(f"{stage}: unknown {use!r}" + (f", did you mean {near[0]!r}?" if near else f"; built in: {', '.join(known) or 'none'}"))
        make = _BUILT[stage, use]
    try:
        inspect.signature(make).bind(**options)
    except TypeError as e:
        raise ValueError(f"{stage} {use}: {e}") from None
    built = make(**options)
    if not callable(built):
        raise ValueError(f"{stage} {use}: gave {type(built).__name__}, not a stage")
    return built


def run(context: Context, documents: DataFrame, stages: dict[str, dict]) -> Tables:
    """Documents (doc_id, text, uri, tier, modality) through the stages in order; stages that are not named pass through.

    What a stage makes is cut once, so that each later one reads it and a lost executor repeats one stage."""
    unknown = set(stages) - set(ORDER)
    if unknown:
        raise ValueError(f"{', '.join(sorted(unknown))}: no such stage")
    tables: Tables = {"documents": documents}
    for name in ORDER:
        made = build(name, **stages.get(name, {}))(context, tables)
        tables |= {k: cut(v) for k, v in made.items()}
    return tables


@builtin("chunker", "words")
def words(max_words: int = 200, overlap: int = 0) -> Stage:
    return lambda context, t: {"chunks": spans.chunks(t["documents"], max_words, overlap)}


@builtin("chunker", "document")
def whole_documents() -> Stage:
    """A chunk a document."""
    return lambda context, t: {"chunks": t["documents"].select("doc_id", F.lit(0).alias("idx"), F.lit(0).alias("start"),
        F.length("text").alias("end"), "text")}


@builtin("router", "length")
def by_length(least: int = 1, scope: str = "chunk") -> Stage:
    """Chunks of fewer than `least` words are skipped, alone or with the rest of their document."""

    def stage(context: Context, t: Tables) -> Tables:
        enough = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")) >= least
        routed = t["chunks"].withColumn("action", F.when(enough, "extract").otherwise("skip")).withColumn("scope", F.lit(scope))
        return {"chunks": spans.route_chunks(routed).where("action = 'extract'").drop("action", "scope")}

    return stage


def _candidates(rows: DataFrame, extractor: str, confidence: float) -> DataFrame:
    """Rows (doc_id, subject, s_type, predicate, value) as candidates."""
    return rows.select("doc_id", "subject", "s_type", "predicate", F.col("value").alias("object"),
        F.lit(None).cast("string").alias("o_type"), F.col("value").alias("quote"),
                       F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"), F.lit(extractor).alias("extractor"),
                       F.lit(confidence).alias("confidence"))


def pattern_candidates(context: Context, documents: DataFrame, subject: str) -> DataFrame:
    """Key-value blocks (the key folded to `subject` names what a block is about) and pipe tables (their first column does)."""
    kv = extract.key_value_facts(documents)
    about = kv.where(X.fold(F.col("key")) == X.fold(F.lit(subject))).groupBy("doc_id", "block").agg(F.min("value").alias("subject"))
    blocks = kv.join(about, ["doc_id", "block"]).where(X.fold(F.col("key")) != X.fold(F.lit(subject))).select("doc_id", "subject",
        F.lit("Thing").alias("s_type"), F.col("key").alias("predicate"), "value")
    cells = extract.table_cells(documents)
    lead = cells.where("k = 0").select("doc_id", "table", "row", F.col("value").alias("subject"))
    rows = cells.where("k > 0").join(lead, ["doc_id", "table", "row"]).select("doc_id", "subject", F.lit("Thing").alias("s_type"),
        F.col("column").alias("predicate"), "value")
    found = blocks.union(rows)
    if context.ontology.get("predicates"):
        names = [(form, n, place) for n, b in context.ontology["predicates"].items() for form,
            place in [(n, 0), *((a, 2) for a in b.get("aliases", []))]]
        found = extract.match_predicates(found, context.spark.createDataFrame(names, "form string, name string, priority int"))
    return _candidates(found.select("doc_id", "subject", "s_type", "predicate", "value"), "pattern", 0.9)


@builtin("extractor", "pattern")
def pattern(subject: str = "name") -> Stage:
    return lambda context, t: {"candidates": pattern_candidates(context, t["documents"], subject)}


@builtin("extractor", "model")
def model() -> Stage:
    """Candidates of the context's provider, a function of chunks."""
    return lambda context, t: {"candidates": context.providers["extractor"](t["chunks"])}


@builtin("extractor", "hybrid")
def hybrid(subject: str = "name") -> Stage:
    """Structured documents go to the patterns, unstructured ones to the provider, others to both; of equal claims of a document the more
    confident stays, the pattern's of a tie."""

    def stage(context: Context, t: Tables) -> Tables:
        docs = t["documents"]
        by_rule = pattern_candidates(context, docs.where("modality <> 'unstructured'"), subject).withColumn("ord", F.lit(0))
        asked = t["chunks"].join(docs.where("modality <> 'structured'").select("doc_id"), "doc_id", "left_semi")
        by_model = context.providers["extractor"](asked).select(*by_rule.columns[:-1]).withColumn("ord", F.lit(1))
        key = ["doc_id", "subject", "predicate", "object"]
        return {"candidates": extract.best_per_claim(by_rule.unionByName(by_model), key).drop("ord").select(*by_rule.columns[:-1])}

    return stage


@builtin("normalizer", "values")
def values(intervals: list[str] | None = None, day_first: bool | None = None) -> Stage:
    def stage(context: Context, t: Tables) -> Tables:
        none = F.create_map().cast("map<string,string>")
        x = t["candidates"].withColumn("o_kind", F.when(F.col("o_type").isNotNull(), "entity").otherwise("value")).withColumn("o_repr",
            F.col("object"))
        x = naming.normalise_values(x.withColumn("qualifiers", none).withColumn("source_form", none),
            intervals or ["start_time", "end_time"], day_first)
        return {"candidates": x.withColumn("object", F.col("o_repr")).drop("o_kind", "o_repr", "qualifiers", "source_form")}

    return stage


def _evidence(t: Tables) -> DataFrame:
    """Candidates with their document: the cited span if it is given, else where the quote stands, and whether it holds."""
    docs = t["documents"].select("doc_id", F.col("text").alias("_text"), "uri", "tier")
    x = t["candidates"].join(docs, "doc_id")
    found = F.when(F.col("quote") != "", F.expr("locate(quote, _text)"))
    x = x.withColumn("start", F.coalesce("start", F.when(found > 0, (found - 1).cast("int")))).withColumn("end",
        F.coalesce("end", F.when(found > 0, (found - 1 + F.length("quote")).cast("int"))))
    x = x.withColumn("status", spans.span_status(F.col("doc_id"), F.col("doc_id"), F.col("_text"), F.col("start"), F.col("end"),
        F.col("quote"))).drop("_text")
    return x


@builtin("grounder", "span")
def span() -> Stage:
    """A candidate whose span is not in its document is not found; the others stay unchecked."""
    return lambda context, t: {"candidates": _evidence(t).withColumn("verdict",
        F.when(F.col("status") == "located", "unchecked").otherwise("not_found")).drop("status")}


@builtin("grounder", "checked")
def checked() -> Stage:
    """The schema first: what the ontology refuses keeps its verdict, is marked and reaches no model. The rest is checked by span, and
    what then stands is judged by the provider, a function of candidates that gives them verdicts; without one it stays unchecked."""

    def stage(context: Context, t: Tables) -> Tables:
        x = _evidence(t).withColumn("verdict", F.lit("unchecked"))
        x = cut(ontology.schema_problems(context.spark, x.withColumn("o_type", F.col("o_type")), context.ontology))
        refused = x.where("problem IS NOT NULL")
        placed = x.where("problem IS NULL").withColumn("verdict", F.when(F.col("status") == "located", "unchecked").otherwise("not_found"))
        judge = context.providers.get("grounder")
        if judge is not None:
            open_ = placed.where("verdict = 'unchecked'")
            placed = placed.where("verdict <> 'unchecked'").unionByName(judge(open_).select(*placed.columns))
        return {"candidates": refused.unionByName(placed).drop("status")}

    return stage


@builtin("corroborator", "merge")
def merge() -> Stage:
    """One fact for each claim, with its distinct sources and documents, and the entities that facts name."""

    def stage(context: Context, t: Tables) -> Tables:
        from .run import _tier_weight

        x = t["candidates"]
        for name, value in (("verdict", F.lit("unchecked")), ("problem", F.lit(None).cast("string"))):
            if name not in x.columns:
                x = x.withColumn(name, value)
        if "uri" not in x.columns:
            x = x.join(t["documents"].select("doc_id", "uri", "tier"), "doc_id")
        s_key, o_key = X.entity_key(F.col("s_type"), F.col("subject")), X.entity_key(F.coalesce("o_type", F.lit("Thing")), F.col("object"))
        entity = F.col("o_type").isNotNull()
        x = x.withColumn("s_key", s_key).withColumn("o_kind", F.when(entity, "entity").otherwise("value")).withColumn("o_key",
            F.when(entity, o_key)).withColumn("o_repr", F.col("object"))
        x = x.withColumn("source", X.source_of(F.col("uri"), F.col("doc_id"))).withColumn("tier_w",
            _tier_weight()).withColumn("retrieved_at", F.lit(None).cast("timestamp"))
        x = x.withColumn("sig", claims.signature(F.col("s_key"), F.col("predicate"), F.coalesce("o_key", "o_repr")))
        key = ["sig", "s_key", "s_type", "predicate", "o_kind", "o_key", "o_type", "o_repr", "problem"]
        facts = claims.merge_claims(x, key, "verdict").drop("retrieved_at")
        ends = x.select(F.col("s_key").alias("key"), F.col("s_type").alias("type"),
            F.col("subject").alias("label")).union(x.where(entity).select("o_key", "o_type", "object"))
        return {"evidence": x, "facts": facts, "entities": ends.groupBy("key", "type").agg(F.min("label").alias("label"))}

    return stage


@builtin("resolver", "names")
def names(threshold: float = 0.9, max_block: int = 100) -> Stage:
    """Entities of one name become one: facts are re-keyed and merged again."""

    def stage(context: Context, t: Tables) -> Tables:
        e = t["entities"].withColumn("aliases", F.array().cast("array<string>")).withColumn("external_id",
            F.lit(None).cast("string")).withColumn("attributes", F.create_map().cast("map<string,string>"))
        p = cut(resolve.profiles(e))
        links = cut(resolve.judge(cut(resolve.candidate_pairs(p, max_block)), p, threshold))
        same = links.withColumn("kind", F.when(F.col("kind") == "similar", "same_as").otherwise(F.col("kind")))
        mapping = cut(resolve.merge_components(same, p))
        facts = resolve.rekey(t["facts"], mapping)
        facts = facts.withColumn("sig", claims.signature(F.col("s_key"), F.col("predicate"), F.coalesce("o_key", "o_repr")))
        key = ["sig", "s_key", "s_type", "predicate", "o_kind", "o_key", "o_type", "o_repr", "problem"]
        best = F.min_by("verdict",
            F.array_position(F.array(*map(F.lit, ("supported", "contradicted", "not_found", "unchecked"))), F.col("verdict")))
        # sources of re-keyed facts are counted over the evidence of all of them
        to = mapping.select(F.col("key").alias("s_key"), F.col("canonical").alias("_s")), mapping.select(F.col("key").alias("o_key"),
            F.col("canonical").alias("_o"))
        ev = t["evidence"].join(to[0], "s_key", "left").join(to[1], "o_key", "left")
        ev = ev.withColumn("sig", claims.signature(F.coalesce("_s", "s_key"), F.col("predicate"), F.coalesce("_o", "o_key", "o_repr")))
        counted = ev.groupBy("sig").agg(F.count_distinct("source").alias("support"), F.count_distinct("doc_id").alias("documents"))
        merged = facts.groupBy(*key).agg(F.max("tier_w").alias("tier_w"), F.max("confidence").alias("confidence"),
            best.alias("verdict")).join(counted, "sig")
        kept = t["entities"].join(mapping.where("key <> canonical").select("key"), "key", "left_anti")
        return {"facts": merged.select(*t["facts"].columns), "links": links.where("kind IS NOT NULL"), "entities": kept, "mapping": mapping}

    return stage


@builtin("scorer", "combined")
def combined(prior: float = 0.5) -> Stage:
    """Confidence from the extractor's, the verdict and the number of sources."""
    score = combined_confidence(F.col("confidence"), verdict_weight(F.col("verdict")), F.col("support"), F.lit(1.0), prior)
    return lambda context, t: {"facts": t["facts"].withColumn("confidence", score)}


@builtin("gate", "verdict")
def verdict(refuse_not_found: bool = False, mark: bool = False) -> Stage:
    def stage(context: Context, t: Tables) -> Tables:
        problem = F.col("problem") if context.ontology.get("predicates") else None
        gated = t["facts"].withColumn("gate", verify.gate(F.col("verdict"), problem, refuse_not_found, mark))
        kept, refused = schema_text.split_gate(gated)
        return {"facts": kept.drop("problem"), "refused": refused}

    return stage


@builtin("sink", "json_lines")
def json_lines(path: str, append: bool = False) -> Stage:
    """Facts, entities and links into a store; the counts are in the context."""

    def stage(context: Context, t: Tables) -> Tables:
        store = writers.JsonLinesStore(context.spark, path)
        tables = {k: t[k] for k in ("facts", "entities", "links") if k in t}
        context.counts["sink"] = store.append(**tables) if append else store.replace(**tables)
        return {}

    return stage


def coverage(tables: Tables) -> DataFrame:
    """One row: documents, chunks, candidates, facts kept and refused, entities, of the tables that a run made."""
    out = None
    for name in ("documents", "chunks", "candidates", "facts", "refused", "entities"):
        if name in tables:
            n = tables[name].agg(F.count(F.lit(1)).alias(name))
            out = n if out is None else out.crossJoin(n)
    return out
