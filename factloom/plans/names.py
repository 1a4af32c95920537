"""Names inside longer ones, contexts of citations, normalised facts, retries, routes and lookups over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..control import EventLog, Models, Prompt, Prompts, delay, double_stages
from ..operators import fold, naming, resolve, spans
from ..sinks import graph
from ..sources import datasets
from ..sources.tables import table
from .entities import _people


def name_extensions(spark, d):
    """Customers' nations in sentences: alone, before a capitalised word, a legal form, a small word, or behind a comma."""
    c = table(spark, d, "customer").join(table(spark, d, "nation"),
        F.col("c_nationkey") == F.col("n_nationkey")).where("n_name NOT LIKE '% %'")
    name, k = F.initcap("n_name"), F.col("c_custkey") % 5
    tail = F.when(k == 0, F.lit("Bank")).when(k == 1, F.lit("Ltd")).when(k == 2, F.lit("sells")).when(k == 3,
        F.lit("Bank")).otherwise(F.lit("Limited"))
    words = c.select(F.col("c_custkey").alias("doc_id"), F.lit(0).alias("sentence"),
        F.posexplode(F.array(F.lit("The"), F.lit("old"), name, tail)).alias("pos", "word"))
    words = words.withColumn("joined", ~((F.col("pos") == 3) & (F.col("doc_id") % 5 == 3)))
    matches = c.select(F.col("c_custkey").alias("doc_id"), F.lit(0).alias("sentence"), F.lit(2).alias("first"), F.lit(2).alias("last"))
    return naming.part_of_longer_name(words, matches).select("doc_id", "extends")


EXTENDS = "SELECT c_custkey AS doc_id, c_custkey % 5 = 0 AS extends FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name NOT LIKE '% %'"


def cited_contexts(spark, d):
    """Each customer's first mention, with the sentence before and behind it."""
    c = table(spark, d, "customer")
    docs = c.select(F.col("c_custkey").cast("string").alias("doc_id"),
        F.concat(F.lit("One stands first. Two is next. Here is "), "c_name", F.lit(" at last. Four ends it. Five is far.")).alias("text"))
    s = spans.sentences(docs).join(docs, "doc_id").select("doc_id", "pos", "start", "end",
        F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")).alias("text"))
    m = c.select(F.col("c_name").alias("key"), F.col("c_custkey").cast("string").alias("doc_id"), F.lit(39).alias("start"))
    return naming.cited_context(m, s)


CONTEXTS = "SELECT c_name AS key, 'Two is next. Here is ' || c_name || ' at last. Four ends it.' AS context FROM customer"


def values_normalised(spark, d):
    """Orders as facts with dates and quantities as written, normalised twice."""
    o = table(spark, d, "orders")
    k = F.col("o_orderkey") % 3
    x = o.select(F.col("o_orderkey").alias("sig"), F.lit("value").alias("o_kind"),
        F.when(k == 0, F.date_format("o_orderdate", "d MMMM yyyy")).when(k == 1,
        F.lit("1,500 m")).otherwise(F.lit("plain")).alias("o_repr"),
                 F.create_map(F.lit("start_time"), F.date_format("o_orderdate", "yyyy/MM/dd"), F.lit("unit"),
                 F.lit("kept")).alias("qualifiers"), F.create_map().cast("map<string,string>").alias("source_form"))
    once = naming.normalise_values(x, ["start_time"])
    twice = naming.normalise_values(once, ["start_time"])
    return twice.select("sig", "o_repr", F.col("qualifiers")["start_time"].alias("start"), F.col("qualifiers")["unit"].alias("unit"),
        F.col("source_form")["object"].alias("before"), F.col("source_form")["start_time"].alias("start_before"))


NORMALISED = """SELECT o_orderkey AS sig, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN '1500 m' ELSE 'plain' END AS o_repr, strftime(o_orderdate, '%Y-%m-%d') AS start, 'kept' AS unit,
CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%-d %B %Y') WHEN 1 THEN '1,500 m' END AS before, strftime(o_orderdate, '%Y/%m/%d') AS start_before FROM orders"""


def lookup_stats(spark, d):
    """Parts divisible by ten looked up by id in all others."""
    p = resolve.profiles(_people(spark, d))
    k = F.substring_index("key", ":", -1).cast("long") % 10 == 0
    batch, stored = p.where(k & F.col("id_value").isNotNull()), p.where(~k)
    links = batch.select(F.col("key").alias("a"),
        "id_value").join(stored.where("id_value IS NOT NULL").select(F.col("key").alias("b"), "id_value"), "id_value").select("a", "b",
        F.lit("same_as").alias("kind"))
    mapping = fold.resolve_batch(links, batch, stored)
    return fold.lookup_stats(batch, stored, links, mapping)


LOOKUP = """WITH e AS (SELECT p_partkey AS k, p_partkey % 60 AS id FROM part WHERE p_partkey % 40 = 0), a AS (SELECT * FROM e WHERE k % 10 = 0), b AS (SELECT * FROM e WHERE k % 10 <> 0), l AS (SELECT a.k AS a, b.k AS b FROM a JOIN b USING (id))
SELECT (SELECT count(*) FROM a) AS looked_up, (SELECT count(DISTINCT b) FROM l) AS candidates, (SELECT count(*) FROM l) AS links, (SELECT count(*) FROM l) AS same_as, 0::BIGINT AS similar, 0::BIGINT AS different, (SELECT count(DISTINCT a) FROM l) AS rekeyed"""


def control_plane(spark, d):
    """What a run needs beside its tables, by what it gives: delays, a routed model, a prompt lock, an event log, a stage done twice."""
    models = Models()
    models.register("local", lambda name: lambda text: (name + text, 1, 1))
    prompts = Prompts()
    prompts.add(Prompt("judge", "1", "Is it so?"))
    changed = Prompts({"judge@1": Prompt("judge", "1", "Is it not so?")}).check(prompts.lock())
    log = EventLog("validate", "run", lambda: 0.0)
    n, o = log.observed(table(spark, d, "orders"), "orders", open=F.count_if(F.col("o_orderstatus") == "O"))
    n.write.format("noop").mode("overwrite").save()
    got = log.close(o, "orders")
    rows = [("delays", " ".join(str(delay(k)) for k in (0, 3, 9)) + f" {delay(1, 7.0)}"), ("model", models.resolve("local:x")("y")[0]),
        ("lock", ",".join(changed)), ("double", double_stages({"grounder"}, {"grounder", "gate"})[0][:8]),
            ("events", f"{log.events[0]['stage']} {got['rows']} {got['open']}")]
    return spark.createDataFrame(rows, "what string, value string")


CONTROL = """SELECT 'delays' AS what, '1.0 8.0 60.0 7.0' AS value UNION ALL SELECT 'model', 'xy' UNION ALL SELECT 'lock', 'judge@1' UNION ALL SELECT 'double', 'grounder' UNION ALL SELECT 'events', 'orders ' || count(*) || ' ' || count_if(o_orderstatus = 'O') FROM orders"""


def seeded_selection(spark, d):
    """Five documents of each language, all drawn by a hash: counts by language."""
    return datasets.seeded_selection(table(spark, d, "documents"), "lang", 5).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


SELECTION = "SELECT lang, least(count(*), 5) AS n FROM documents GROUP BY lang"


def squashed_names(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.concat("c_name", F.lit(" -"), "c_mktsegment").alias("n"))
    return c.select("c_custkey", datasets.squashed(F.col("n")).alias("squashed"), datasets.unspaced(F.col("n")).alias("unspaced"))


SQUASHED = r"""SELECT c_custkey, regexp_replace(lower(c_name || ' -' || c_mktsegment), '[^\p{L}\p{N}]+', '', 'g') AS squashed, regexp_replace(lower(c_name || ' -' || c_mktsegment), '[\s_]+', '', 'g') AS unspaced FROM customer"""


def document_identity(spark, d):
    """Texts by their content key: as many keys as distinct texts, whatever the ids."""
    return table(spark, d, "documents").agg(F.count_distinct(naming.document_key(F.col("text"), F.lit(None).cast("string"))).alias("keys"))


IDENTITY = "SELECT count(DISTINCT coalesce(text, '')) AS keys FROM documents"


def tenant_rows(spark, d):
    """Relationship rows of two tenants: each sees its own facts under bare keys."""
    o = table(spark, d, "orders")
    owner = F.when(F.col("o_orderkey") % 2 == 0, "acme").otherwise("zeta")
    rows = o.select(F.concat(owner, F.lit("/Order:"), F.col("o_orderkey").cast("string")).alias("subject_key"),
        F.concat(owner, F.lit("/Customer:"), F.col("o_custkey").cast("string")).alias("object_key"),
        F.concat(owner, F.lit("/s")).alias("signature"), owner.alias("tenant"))
    return graph.stored_fact(rows, "acme").select("s_key", "o_key")


TENANT = "SELECT 'Order:' || o_orderkey AS s_key, 'Customer:' || o_custkey AS o_key FROM orders WHERE o_orderkey % 2 = 0"

QUERIES = {
    "name_extensions": (name_extensions, EXTENDS), "cited_contexts": (cited_contexts, CONTEXTS),
    "values_normalised": (values_normalised, NORMALISED), "lookup_stats": (lookup_stats, LOOKUP),
    "control_plane": (control_plane, CONTROL),
    "seeded_selection": (seeded_selection, SELECTION), "squashed_names": (squashed_names, SQUASHED),
    "document_identity": (document_identity, IDENTITY), "tenant_rows": (tenant_rows, TENANT),
}
