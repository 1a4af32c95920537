"""Gates, claim text, qualifiers, votes, runs and causes of misses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import spans
from ..operators import verify as V
from ..sources.tables import table


def _verdict():
    return F.element_at(F.array(*map(F.lit, ("supported", "contradicted", "not_found", "unchecked"))),
        (F.col("o_orderkey") % 4 + 1).cast("int"))


def gate_orders(spark, d):
    """Gate actions over orders as facts: dropped, marked and refused for their schema."""
    o = table(spark, d, "orders").withColumn("problem", F.when(F.col("o_orderstatus") == "P", "range"))
    x = o.select(V.gate(_verdict(), F.col("problem"), True).alias("g"), V.gate(_verdict(), None, False, True).alias("m"))
    return x.groupBy(F.col("g.action").alias("action"), F.col("g.reason").alias("reason"),
        F.col("m.review").alias("review")).agg(F.count(F.lit(1)).alias("n"))


GATE = """WITH x AS (SELECT o_orderkey % 4 AS v, o_orderstatus = 'P' AS p FROM orders)
SELECT CASE WHEN p OR v IN (1, 2) THEN 'refuse' ELSE 'accept' END AS action, CASE WHEN p THEN 'schema: range' WHEN v = 1 THEN 'the text contradicts it' WHEN v = 2 THEN 'the text does not state it' END AS reason,
CASE WHEN v = 1 THEN 'judge' END AS review, count(*) AS n FROM x GROUP BY ALL"""


def render_claims(spark, d):
    c = table(spark, d, "customer")
    pol = F.element_at(F.array(*map(F.lit, ("asserted", "denied", "partial"))), (F.col("c_custkey") % 3 + 1).cast("int"))
    q = F.when(F.col("c_custkey") % 2 == 0,
        F.create_map(F.lit("zone"), F.col("c_nationkey").cast("string"), F.lit("as_of"),
        F.lit("1998"))).otherwise(F.create_map().cast("map<string,string>"))
    return c.select("c_custkey", V.render_claim(F.col("c_name"), F.lit("market_segment"), F.col("c_mktsegment"), pol, q).alias("claim"))


CLAIMS = """SELECT c_custkey, c_name || ' ' || ['', 'not ', 'partly '][c_custkey % 3 + 1] || 'market segment ' || c_mktsegment || CASE WHEN c_custkey % 2 = 0 THEN ' (as_of=1998, zone=' || c_nationkey || ')' ELSE '' END AS claim FROM customer"""


def qualifier_reconciliation(spark, d):
    """Start, end and priority of each customer's status over its orders."""
    o = table(spark, d, "orders")
    q = F.create_map(F.lit("start"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("end"), F.date_format("o_orderdate", "yyyy-MM-dd"),
        F.lit("priority"), F.col("o_orderpriority"))
    m = o.select(F.col("o_custkey").alias("customer"), F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("ord"),
        (F.col("o_orderkey") % 3).alias("tier_w"), F.col("o_orderdate").alias("retrieved_at"), q.alias("qualifiers"))
    return V.reconcile_qualifiers(m, ["customer", "status"])


QUALIFIERS = """SELECT o_custkey AS customer, o_orderstatus AS status, 'start' AS qualifier, strftime(min(o_orderdate), '%Y-%m-%d') AS value FROM orders GROUP BY 1, 2
UNION ALL SELECT o_custkey, o_orderstatus, 'end', strftime(max(o_orderdate), '%Y-%m-%d') FROM orders GROUP BY 1, 2
UNION ALL SELECT o_custkey, o_orderstatus, 'priority', arg_max(o_orderpriority, (o_orderkey % 3, o_orderdate, -o_orderkey)) FROM orders GROUP BY 1, 2"""


def type_votes(spark, d):
    """Parts typed by the brands' domains of the predicates that their lines have."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("item"), F.explode(F.array("p_brand", "p_type")).alias("predicate"))
    dom = table(spark, d, "part").select(F.col("p_type").alias("predicate"), F.col("p_brand").alias("type")).distinct()
    return V.best_type(p, dom)


VOTES = """WITH p AS (SELECT p_partkey AS item, p_brand AS predicate FROM part UNION ALL SELECT p_partkey, p_type FROM part), dm AS (SELECT DISTINCT p_type AS predicate, p_brand AS type FROM part),
s AS (SELECT type, count(*) AS size FROM dm GROUP BY type), v AS (SELECT item, type, count(*) AS votes FROM p JOIN dm USING (predicate) GROUP BY item, type)
SELECT item, arg_min(type, (-votes, size, type)) AS type, max(votes) AS votes FROM v JOIN s USING (type) GROUP BY item"""


def hallucination_flags(spark, d):
    """Triples that name a benchmark passage's head, or its source, against each document."""
    docs = table(spark, d, "documents")
    flag = V.hallucinated(F.col("text"), F.substr("text", F.lit(3), F.lit(20)),
        F.when(F.col("doc_id") % 3 == 0, F.col("source")).otherwise(F.substr("text", F.lit(1), F.lit(5))))
    return docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(flag).alias("flagged"))


FLAGS = r"""WITH f AS (SELECT lang, regexp_replace(replace(lower(text), 'ß', 'ss'), '[^\p{L}\p{N}]', '', 'g') AS t, regexp_replace(replace(lower(substring(text, 3, 20)), 'ß', 'ss'), '[^\p{L}\p{N}]', '', 'g') AS s,
regexp_replace(replace(lower(CASE WHEN doc_id % 3 = 0 THEN source ELSE substring(text, 1, 5) END), 'ß', 'ss'), '[^\p{L}\p{N}]', '', 'g') AS o FROM documents)
SELECT lang, count(*) AS n, CAST(count_if(NOT (contains(t, s) AND contains(t, o))) AS BIGINT) AS flagged FROM f GROUP BY lang"""


def widened_spans(spark, d):
    """A narrow span in every document, widened to its sentences."""
    docs = table(spark, d, "documents")
    s = docs.select(F.col("doc_id").alias("id"), "doc_id", F.floor(F.length("text") / 3).cast("int").alias("start"),
        (F.floor(F.length("text") / 3) + 5).cast("int").alias("end"))
    return V.widen(s, spans.sentences(docs))


def located_pairs(spark, d):
    """The narrowest window that names two words taken from each document."""
    docs = table(spark, d, "documents")
    s = spans.sentences(docs).join(docs.select("doc_id", "text"), "doc_id").withColumn("text",
        F.substr("text", F.col("start") + 1, F.col("end") - F.col("start")))
    w = F.split("text", r"\s+")
    pairs = docs.select(F.col("doc_id").alias("id"), "doc_id", F.get(w, F.lit(2)).alias("subject"),
        F.get(w, F.lit(6)).alias("object")).where("subject IS NOT NULL AND object IS NOT NULL")
    return V.locate_pair(s, pairs)


def miss_causes(spark, d):
    """Bad labelled documents by the first cause: empty, short, wrong language, toxic, other."""
    x = table(spark, d, "documents").join(table(spark, d, "labels").where("quality = 0"), "doc_id").select(
        (F.length("text") < 100).alias("short"), (F.col("lang") != "en").alias("other_language"),
        F.contains("text", F.lit("|")).alias("table"))
    return V.miss_buckets(x, ["short", "other_language", "table"]).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


CAUSES = """SELECT CASE WHEN length(text) < 100 THEN 'short' WHEN lang <> 'en' THEN 'other_language' WHEN contains(text, '|') THEN 'table' ELSE 'other' END AS bucket, count(*) AS n FROM documents JOIN labels USING (doc_id) WHERE quality = 0 GROUP BY 1"""


def supported_cap(spark, d):
    """The ten best supported part types, and which are dropped."""
    t = table(spark, d, "part").groupBy(F.col("p_type").alias("name")).agg(F.count(F.lit(1)).alias("support"),
        F.min(F.when(F.col("p_size") == 1, F.col("p_partkey"))).alias("rank"))
    return V.cap_supported(t, 3).select("name", "support", "kept")


CAP = """WITH t AS (SELECT p_type AS name, count(*) AS support, min(CASE WHEN p_size = 1 THEN p_partkey END) AS rank FROM part GROUP BY 1)
SELECT name, support, row_number() OVER (ORDER BY support DESC, rank IS NULL, rank, name) <= 3 AS kept FROM t"""


def run_comparison(spark, d):
    l = table(spark, d, "labels")
    return V.compare_runs(l.where("doc_id % 5 != 0").select(F.col("doc_id").alias("item"), (F.col("quality") == 1).alias("right")),
        l.where("doc_id % 7 != 0").select(F.col("doc_id").alias("item"), (F.col("toxic") == 0).alias("right")))


COMPARISON = """WITH a AS (SELECT doc_id, quality = 1 AS a FROM labels WHERE doc_id % 5 <> 0), b AS (SELECT doc_id, toxic = 0 AS b FROM labels WHERE doc_id % 7 <> 0), x AS (SELECT * FROM a FULL JOIN b USING (doc_id))
SELECT count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS items, count(*) FILTER (a AND b) AS both, count(*) FILTER (NOT a AND b) AS gained, count(*) FILTER (a AND NOT b) AS lost, count(*) FILTER (b IS NULL) AS only_a, count(*) FILTER (a IS NULL) AS only_b FROM x"""


def source_shares(spark, d):
    """Distinct lines by the number of documents that state them: one, two, three or more."""
    x = table(spark, d, "documents").select("doc_id",
        F.explode(F.split("text",
        "\n")).alias("line")).where("length(line) > 20").groupBy("line").agg(F.count_distinct("doc_id").alias("k"))
    return x.groupBy(F.when(F.col("k") >= 3,
        "3+").otherwise(F.col("k").cast("string")).alias("documents")).agg(F.count(F.lit(1)).alias("facts"))


SHARES = """SELECT CASE WHEN k >= 3 THEN '3+' ELSE CAST(k AS VARCHAR) END AS documents, count(*) AS facts FROM (SELECT line, count(DISTINCT doc_id) AS k FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
WHERE length(line) > 20 GROUP BY line) GROUP BY 1"""

QUERIES = {
    "gate_orders": (gate_orders, GATE), "render_claims": (render_claims, CLAIMS),
    "qualifier_reconciliation": (qualifier_reconciliation, QUALIFIERS), "type_votes": (type_votes, VOTES),
    "hallucination_flags": (hallucination_flags, FLAGS), "widened_spans": (widened_spans, None), "located_pairs": (located_pairs, None),
    "miss_causes": (miss_causes, CAUSES),
    "supported_cap": (supported_cap, CAP), "run_comparison": (run_comparison, COMPARISON), "source_shares": (source_shares, SHARES),
}
