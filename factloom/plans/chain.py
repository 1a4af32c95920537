"""Document runs through the stages, schema ontologies and judged equivalence over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import stages
from ..eval import equivalence, reports
from ..operators import ontology
from ..provider import ANSWERS, embedded, read_replies, reextract
from ..shared import fresh_path
from ..sources.tables import table


def _cards(spark, d, modality: str = "semi-structured"):
    """Customers as documents of key-value lines."""
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    text = F.concat(F.lit("Name: "), "c_name", F.lit("\nSegment: "), "c_mktsegment", F.lit("\nNation: "), "n_name")
    return c.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("doc_id"), text.alias("text"),
        F.concat(F.lit("https://host"), (F.col("c_custkey") % 7).cast("string"), F.lit(".example.org/x")).alias("uri"),
                    F.lit("community").alias("tier"), F.lit(modality).alias("modality"))


def document_run(spark, d):
    """Documents to scored, gated facts in a store, by patterns alone; the store is read back."""
    where = fresh_path(spark, "run")
    context = stages.Context(spark)
    t = stages.run(context, _cards(spark, d),
        {"chunker": {"use": "words", "max_words": 50}, "extractor": {"use": "pattern"}, "grounder": {"use": "span"},
        "corroborator": {"use": "merge"},
                                               "scorer": {"use": "combined"}, "gate": {"use": "verdict", "refuse_not_found": True},
                                               "sink": {"use": "json_lines", "path": where}})
    from ..sinks.writers import JsonLinesStore

    return JsonLinesStore(spark, where).read("facts", t["facts"].schema).select("s_key", "predicate", "o_repr", "support", "documents",
        "verdict", F.round("confidence", 6).alias("confidence"))


RUN = """SELECT 'Thing:' || regexp_replace(lower(c_name), '[^\\p{L}\\p{N}]+$', '') AS s_key, unnest(['Segment', 'Nation']) AS predicate, unnest([c_mktsegment, n_name]) AS o_repr, 1::BIGINT AS support, 1::BIGINT AS documents, 'unchecked' AS verdict, 0.54 AS confidence
FROM customer JOIN nation ON c_nationkey = n_nationkey"""


def _told(chunks):
    """What a model would find in a chunk: the segment, and for every third document something that no ontology declares."""
    k = F.regexp_extract("doc_id", r"(\d+)$", 1).cast("long")
    segment = F.regexp_extract("text", r"Segment: (.*)", 1)
    rows = F.array(F.struct(F.lit("segment").alias("predicate"), segment.alias("object")),
        F.struct(F.lit("rumour").alias("predicate"), F.lit("unheard of").alias("object")))
    x = chunks.select("doc_id", F.regexp_extract("text", r"Name: (.*)", 1).alias("subject"),
        F.explode(F.when(k % 3 == 0, rows).otherwise(F.slice(rows, 1, 1))).alias("r"))
    return x.select("doc_id", "subject", F.lit("Customer").alias("s_type"), "r.predicate", "r.object",
        F.lit(None).cast("string").alias("o_type"), F.col("r.object").alias("quote"), F.lit(None).cast("int").alias("start"),
                    F.lit(None).cast("int").alias("end"), F.lit("model").alias("extractor"), F.lit(0.8).alias("confidence"))


def checked_run(spark, d):
    """A model's candidates, checked by schema before anything else; a judge then supports what is left."""
    def judge(candidates):
        return candidates.withColumn("verdict", F.lit("supported"))

    o = {"types": {"Customer": {}}, "predicates": {"segment": {"domain": ["Customer"], "range": "string"}}}
    context = stages.Context(spark, o, {"extractor": _told, "grounder": judge})
    t = stages.run(context, _cards(spark, d),
        {"chunker": {"use": "document"}, "extractor": {"use": "model"}, "grounder": {"use": "checked"}, "corroborator": {"use": "merge"},
        "gate": {"use": "verdict"}})
    kept = t["facts"].groupBy("predicate", "verdict").agg(F.count(F.lit(1)).alias("n")).withColumn("reason", F.lit(None).cast("string"))
    return kept.union(t["refused"].groupBy("predicate", "verdict", "reason").agg(F.count(F.lit(1)).alias("n")).select("predicate",
        "verdict", "n", "reason"))


CHECKED = """SELECT 'segment' AS predicate, 'supported' AS verdict, count(*) AS n, NULL AS reason FROM customer UNION ALL SELECT 'rumour', 'unchecked', count(*), 'schema: predicate' FROM customer WHERE c_custkey % 3 = 0 HAVING count(*) > 0"""


def hybrid_run(spark, d):
    """Structured documents by patterns, unstructured ones by the model, others by both."""
    k = F.regexp_extract("doc_id", r"(\d+)$", 1).cast("long")
    docs = _cards(spark, d).withColumn("modality",
        F.when(k % 3 == 0, "structured").when(k % 3 == 1, "unstructured").otherwise("semi-structured"))
    context = stages.Context(spark, {},
        {"extractor": lambda c: _told(c).withColumn("predicate",
        F.when(F.col("predicate") == "segment", "Segment").otherwise(F.col("predicate")))})
    t = stages.run(context, docs, {"chunker": {"use": "document"}, "router": {"use": "length", "least": 2}, "extractor": {"use": "hybrid"}})
    return t["candidates"].groupBy("extractor", "predicate").agg(F.count(F.lit(1)).alias("n"))


HYBRID = """WITH c AS (SELECT c_custkey % 3 AS m FROM customer) SELECT 'pattern' AS extractor, 'Segment' AS predicate, count(*) AS n FROM c WHERE m <> 1 UNION ALL SELECT 'pattern', 'Nation', count(*) FROM c WHERE m <> 1 UNION ALL SELECT 'model', 'Segment', count(*) FROM c WHERE m = 1"""


def resolved_run(spark, d):
    """Names that differ in their legal form are one entity: facts are re-keyed, and sources and documents counted over all of them."""
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    name = F.concat(F.lit("Firm "),
        F.element_at(F.array(*map(F.lit, ("Alphaton", "Bristowe", "Carmichael", "Dunsinane"))), (k % 4 + 1).cast("int")),
        F.when(k % 8 < 4, " Ltd").otherwise(" Limited"))
    docs = c.select(F.concat(F.lit("c"), k.cast("string")).alias("doc_id"),
        F.concat(F.lit("Name: "), name, F.lit("\nSegment: "), "c_mktsegment").alias("text"),
        F.concat(F.lit("https://host"), (k % 7).cast("string"), F.lit(".example.org/x")).alias("uri"),
                    F.lit("community").alias("tier"), F.lit("structured").alias("modality"))
    t = stages.run(stages.Context(spark), docs,
        {"extractor": {"use": "pattern"}, "grounder": {"use": "span"}, "corroborator": {"use": "merge"}, "resolver": {"use": "names"}})
    return t["facts"].select("s_key", "o_repr", "support", "documents")


RESOLVED = """WITH x AS (SELECT 'Thing:firm ' || ['alphaton', 'bristowe', 'carmichael', 'dunsinane'][c_custkey % 4 + 1] AS n, c_custkey % 8 < 4 AS ltd, c_mktsegment AS o, c_custkey % 7 AS host, c_custkey AS k FROM customer),
m AS (SELECT n, CASE WHEN bool_or(NOT ltd) THEN n || ' limited' ELSE n || ' ltd' END AS s_key FROM x GROUP BY n)
SELECT s_key, o AS o_repr, count(DISTINCT host) AS support, count(DISTINCT k) AS documents FROM x JOIN m USING (n) GROUP BY 1, 2"""


def schema_ontology(spark, d):
    """The ontology that the schemas of two driver tables give."""
    o = ontology.from_schema("tables", {"Nation": table(spark, d, "nation").schema, "Region": table(spark, d, "region").schema})
    rows = [(p, "|".join(b["domain"]), b["range"], b["cardinality"]) for p, b in o["predicates"].items()]
    return spark.createDataFrame(rows, "predicate string, domain string, range string, cardinality string")


SCHEMA = """SELECT * FROM (VALUES ('n_nationkey', 'Nation', 'integer', 'single'), ('n_name', 'Nation', 'string', 'single'), ('n_regionkey', 'Nation', 'integer', 'single'), ('r_regionkey', 'Region', 'integer', 'single'),
('r_name', 'Region', 'string', 'single')) v(predicate, domain, range, cardinality)"""


def equivalence_judged(spark, d):
    """Claims of neighbouring orders, judged in both orders by a callable that compares the two lines, or the first words of one order only."""
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    pairs = o.select(F.col("o_custkey").alias("doc_id"), k.alias("gold"), (k + 1).alias("predicted"),
        F.concat(F.lit("claim "), (k % 3).cast("string")).alias("gold_claim"),
        F.concat(F.lit("claim "), (k % 2).cast("string")).alias("predicted_claim"),
                     F.lit(None).cast("string").alias("passage"))

    def says(prompt: str):
        lines = prompt.split("\n")
        a, b = lines[1][3:], lines[2][3:]
        return ("Yes" if a == b or (a, b) == ("claim 2", "claim 0") else "no"), 1, 1

    return equivalence.judge_equivalence(pairs, spark.createDataFrame([], ANSWERS), says).select("gold", "same")


JUDGED = "SELECT o_orderkey AS gold, CASE WHEN o_orderkey % 3 = o_orderkey % 2 THEN true WHEN o_orderkey % 3 = 2 AND o_orderkey % 2 = 0 THEN NULL ELSE false END AS same FROM orders"


def _replies(spark, d):
    """A model's replies about customers: a good candidate, one whose quote is elsewhere, one that is not in the chunk, one without an end, and no JSON."""
    c = table(spark, d, "customer")
    text = F.concat(F.lit("Head. "), F.col("c_name"), F.lit(" is of "), F.col("c_mktsegment"))
    chunks = c.select(F.col("c_custkey").cast("string").alias("doc_id"), F.lit(0).alias("idx"), F.lit(100).alias("start"),
        text.alias("text"))
    k = F.col("c_custkey") % 5
    reply = F.struct(F.when(k == 3, F.lit("")).otherwise(F.col("c_name")).alias("subject"), F.lit("segment").alias("predicate"),
        F.col("c_mktsegment").alias("object"),
                     F.when(k == 2, F.lit("never said")).otherwise(F.col("c_mktsegment")).alias("quote"),
                     F.when(k == 0, F.instr(text, " is of ") + 6).otherwise(0).alias("start"),
                     F.when(k == 0, F.length(text)).otherwise(3).alias("end"))
    answers = c.select(F.col("c_custkey").cast("string").alias("doc_id"), F.lit(0).alias("idx"),
        F.when(k == 4, F.lit("I cannot say.")).otherwise(F.to_json(F.array(reply))).alias("answer"))
    return answers, chunks


def model_replies(spark, d):
    good, dropped = read_replies(*_replies(spark, d))
    return good.select("doc_id", F.col("start").cast("long").alias("start"),
        F.lit(None).cast("string").alias("reason")).union(dropped.select("doc_id", F.lit(None).cast("long"), "reason"))


REPLIES = """WITH x AS (SELECT CAST(c_custkey AS VARCHAR) AS doc_id, c_custkey % 5 AS k, 'Head. ' || c_name || ' is of ' || c_mktsegment AS t, c_mktsegment AS q FROM customer)
SELECT doc_id, CASE WHEN k < 2 THEN 100 + instr(t, q) - 1 END AS start, CASE k WHEN 2 THEN 'the quote is not in the chunk' WHEN 3 THEN 'an end is missing' WHEN 4 THEN 'not JSON' END AS reason FROM x"""


def reextracted(spark, d):
    """Candidates of even customers; a second extraction over all of them adds what was not there."""
    c = _cards(spark, d)
    k = F.regexp_extract("doc_id", r"(\d+)$", 1).cast("long")
    chunks = c.select("doc_id", F.lit(0).alias("idx"), F.lit(0).alias("start"), "text")
    first = _told(chunks.where(k % 2 == 0))
    return reextract(first, chunks, _told).groupBy("predicate").agg(F.count(F.lit(1)).alias("n"))


REEXTRACTED = "SELECT 'segment' AS predicate, count(*) AS n FROM customer UNION ALL SELECT 'rumour', count(*) FROM customer WHERE c_custkey % 3 = 0 HAVING count(*) > 0"


def metric_builders(spark, d):
    """Shares and F1 of labels by language, from the same totals."""
    l = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id").select(
        "lang", F.col("quality").alias("gold"), (1 - F.col("toxic")).alias("predicted"),
        ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int").alias("hits"))
    share = reports.metric(l, "share", {"hits": "hits"}, ["lang"])
    f1 = reports.metric(l, "f1", {"hits": "hits", "predicted": "predicted", "gold": "gold"}, ["lang"])
    return share.join(f1, "lang").select("lang", F.round("share", 6).alias("share"), F.round("f1", 6).alias("f1"))


METRIC = """SELECT lang, round(count_if(quality = 1 AND toxic = 0) / count(*), 6) AS share, round(2.0 * count_if(quality = 1 AND toxic = 0) / (count_if(toxic = 0) + count_if(quality = 1)), 6) AS f1
FROM labels JOIN documents USING (doc_id) GROUP BY lang"""


def embedded_names(spark, d):
    """Nation names as vectors of a callable: their lengths and first letters."""
    return embedded(table(spark, d, "nation"), "n_name",
        lambda texts: [[float(len(t)), float(ord(t[0]))] for t in texts]).select("n_nationkey", F.col("v")[0].alias("length"),
        F.col("v")[1].alias("first"))


EMBEDDED = "SELECT n_nationkey, CAST(length(n_name) AS FLOAT) AS length, CAST(ord(n_name) AS FLOAT) AS first FROM nation"


def harness_score(spark, d):
    """Order statuses as gold; another pipeline's facts have a third of them wrong."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"),
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("subject"), F.lit("status").alias("predicate"),
        F.col("o_orderstatus").alias("obj"), "o_orderkey")
    out = reports.score_harness(o.drop("o_orderkey"),
        o.withColumn("obj", F.when(F.col("o_orderkey") % 3 == 0, "?").otherwise(F.col("obj"))).drop("o_orderkey"))
    return out.select("predicate", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


HARNESS = """SELECT unnest(['status', NULL]) AS predicate, round(count_if(o_orderkey % 3 <> 0) / count(*), 6) AS precision, round(count_if(o_orderkey % 3 <> 0) / count(*), 6) AS recall FROM orders"""

QUERIES = {
    "document_run": (document_run, RUN), "checked_run": (checked_run, CHECKED), "hybrid_run": (hybrid_run, HYBRID),
    "resolved_run": (resolved_run, RESOLVED), "schema_ontology": (schema_ontology, SCHEMA),
    "equivalence_judged": (equivalence_judged, JUDGED), "model_replies": (model_replies, REPLIES),
    "reextracted": (reextracted, REEXTRACTED), "metric_builders": (metric_builders, METRIC),
    "embedded_names": (embedded_names, EMBEDDED), "harness_score": (harness_score, HARNESS),
}
