"""Records, ontologies, inferred schemas, values and incremental runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import extract as E
from ..operators import infer as I
from ..operators import ontology as O
from ..operators import spans
from ..shared import fresh_path
from ..sources.tables import table
from ..streaming import micro

ONTOLOGY = {
    "types": {"Thing": {}, "Agent": {"parents": ["Thing"]}, "Company": {"parents": ["Agent"]}, "Customer": {"parents": ["Company"]},
    "Place": {"parents": ["Thing"]},
              "Nation": {"parents": ["Place"]}, "Region": {"parents": ["Place"]}, "Port": {"parents": ["Place", "Company"]}},
    "predicates": {"segment": {"domain": ["Company"], "range": "string", "aliases": ["c_mktsegment"]},
    "balance": {"domain": ["Agent"], "range": "number", "aliases": ["c_acctbal"]},
                   "located_in": {"domain": ["Agent"], "range": "Place", "inverse_of": "hosts"},
                   "hosts": {"domain": ["Place"], "range": "Agent", "inverse_of": "located_in"},
                   "borders": {"domain": ["Nation"], "range": "Nation", "symmetric": True},
                   "population": {"domain": ["Nation"], "range": "integer", "cardinality": "single"}},
}
LATER = {
    "types": {**{k: v for k, v in ONTOLOGY["types"].items() if k != "Port"}, "Harbour": {"parents": ["Place"]}},
    "predicates": {**{k: v for k, v in ONTOLOGY["predicates"].items() if k != "borders"},
    "balance": {"domain": ["Agent"], "range": "integer", "aliases": ["c_acctbal"]},
                   "population": {"domain": ["Nation"], "range": "integer", "cardinality": "single", "aliases": ["inhabitants"]}},
}


def record_unpivot_facts(spark, d):
    c = table(spark, d, "customer").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 9 == 0, None).otherwise(F.col("c_mktsegment")))
    facts = E.unpivot_facts(c, F.concat(F.lit("Customer:"), F.lower("c_name")), "Customer", ["c_mktsegment", "c_nationkey", "c_custkey"])
    names = spark.createDataFrame([(a, n, p) for n, b in ONTOLOGY["predicates"].items() for p,
        a in enumerate((n, *b.get("aliases", [])))] + [("C-NationKey", "located_in", 1)], "form string, name string, priority int")
    return E.match_predicates(facts, names).select("s_key", "s_type", "predicate", "value")


UNPIVOT = """SELECT 'Customer:' || lower(c_name) AS s_key, 'Customer' AS s_type, 'segment' AS predicate, c_mktsegment AS value FROM customer WHERE c_custkey % 9 <> 0 AND c_mktsegment IS NOT NULL
UNION ALL SELECT 'Customer:' || lower(c_name), 'Customer', 'located_in', CAST(c_nationkey AS VARCHAR) FROM customer"""


def record_render_offsets(spark, d):
    n = table(spark, d, "nation").withColumn("n_name", F.when(F.col("n_nationkey") % 6 == 5, None).otherwise(F.col("n_name")))
    text, fields = E.render_record(["n_nationkey", "n_name", "n_regionkey"])
    x = n.select("n_nationkey", text.alias("text"), F.explode(fields).alias("f"))
    return x.select("n_nationkey", "text", F.col("f.k").alias("field"), F.col("f.start").alias("start"), F.col("f.end").alias("end"))


RENDER = """WITH x AS (SELECT n_nationkey, CAST(n_nationkey AS VARCHAR) AS a, CASE WHEN n_nationkey % 6 <> 5 THEN n_name END AS b, CAST(n_regionkey AS VARCHAR) AS c FROM nation),
t AS (SELECT *, concat_ws(chr(10), 'n_nationkey: ' || a, 'n_name: ' || b, 'n_regionkey: ' || c) AS text FROM x),
f AS (SELECT n_nationkey, text, 'n_nationkey' AS field, 13 AS start, 13 + length(a) AS "end" FROM t
UNION ALL SELECT n_nationkey, text, 'n_name', 14 + length(a) + 8, 14 + length(a) + 8 + length(b) FROM t WHERE b IS NOT NULL
UNION ALL SELECT n_nationkey, text, 'n_regionkey', length(text) - length(c), length(text) FROM t)
SELECT n_nationkey, text, field, CAST(start AS INT) AS start, CAST("end" AS INT) AS "end" FROM f"""


def lineage_closure(spark, d):
    return O.lineage(spark, ONTOLOGY)


LINEAGE = """WITH RECURSIVE p(t, a) AS (VALUES ('Agent', 'Thing'), ('Company', 'Agent'), ('Customer', 'Company'), ('Place', 'Thing'), ('Nation', 'Place'), ('Region', 'Place'), ('Port', 'Place'), ('Port', 'Company')),
r(t, a) AS (SELECT t, t FROM (SELECT t FROM p UNION SELECT a FROM p) UNION SELECT r.t, p.a FROM r JOIN p ON r.a = p.t) SELECT t AS type, a AS ancestor FROM r"""


def inverse_map(spark, d):
    return O.inverses(spark, ONTOLOGY)


INVERSES = "SELECT * FROM (VALUES ('borders', 'borders'), ('located_in', 'hosts'), ('hosts', 'located_in')) v(predicate, inverse)"


def schema_problems(spark, d):
    """One fact per customer, its predicate and types by its key; which of them the ontology has no room for."""
    k = F.col("c_custkey") % 6
    f = table(spark, d, "customer").select("c_custkey",
        F.element_at(F.array(*map(F.lit, ("segment", "balance", "located_in", "owns", "population", "located_in"))),
        (k + 1).cast("int")).alias("predicate"),
                                           F.lit("Customer").alias("s_type"),
                                           F.when(k == 2, "Nation").when(k == 5, "Customer").when(k == 1,
                                           F.when(F.col("c_nationkey") > 12, "Place")).alias("o_type"))
    return O.schema_problems(spark, f, ONTOLOGY).select("c_custkey", "predicate", "problem")


SCHEMA = """SELECT c_custkey, ['segment', 'balance', 'located_in', 'owns', 'population', 'located_in'][c_custkey % 6 + 1] AS predicate,
CASE c_custkey % 6 WHEN 3 THEN 'predicate' WHEN 4 THEN 'domain' WHEN 5 THEN 'range' WHEN 1 THEN CASE WHEN c_nationkey > 12 THEN 'range' END END AS problem FROM customer"""


def ontology_diff(spark, d):
    return O.diff(spark, ONTOLOGY, LATER)


DIFF = """SELECT * FROM (VALUES ('types.Port.', 'removed', true), ('types.Port.parents', 'removed', true), ('types.Harbour.', 'added', false), ('types.Harbour.parents', 'added', false),
('predicates.borders.', 'removed', true), ('predicates.borders.domain', 'removed', true), ('predicates.borders.range', 'removed', true), ('predicates.borders.symmetric', 'removed', true),
('predicates.balance.range', 'changed', true), ('predicates.population.aliases', 'added', false)) v(path, change, breaking)"""


def ontology_diagnostics(spark, d):
    bad = {"types": {"A": {"parents": ["B"]}, "B": {"parents": ["A", "Nowhere"]}}, "predicates": {
        "p": {"domain": ["C"], "range": "text", "inverse_of": "q", "aliases": ["same"]},
        "q": {"range": "A", "inverse_of": "r", "aliases": ["Same"]}, "r": {"range": "string", "symmetric": True, "cardinality": "one"}}}
    return spark.createDataFrame(O.diagnostics(bad), "code string, path string")


DIAGNOSTICS = """SELECT * FROM (VALUES ('inheritance_cycle', 'types.A.parents'), ('inheritance_cycle', 'types.B.parents'), ('unknown_parent', 'types.B.parents'), ('unknown_domain', 'predicates.p.domain'),
('unknown_range', 'predicates.p.range'), ('one_sided_inverse', 'predicates.p.inverse_of'), ('shared_alias', 'predicates.q.aliases'), ('symmetric_value', 'predicates.r.symmetric'), ('cardinality', 'predicates.r.cardinality')) v(code, path)"""


def event_props_json(spark, d):
    """The JSON property of events: its literal range and totals by type."""
    e = table(spark, d, "events").select("event_type", F.get_json_object("props", "$.k").alias("k"))
    g = e.groupBy("event_type").agg(F.count("k").alias("n"), F.sum(F.col("k").cast("long")).alias("total"),
        F.array_sort(F.collect_set(V.literal_kind(F.col("k")))).alias("kinds"))
    return g.select("event_type", "n", "total", V.literal_range(F.col("kinds")).alias("range"))


PROPS = "SELECT event_type, count(json_extract_string(props, '$.k')) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total, 'integer' AS range FROM events GROUP BY event_type"


def record_shape_profile(spark, d):
    return I.record_profile(table(spark, d, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice"])


PROFILE = "WITH n AS (SELECT count(*) AS k FROM orders) " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", k AS rows, k AS \"values\", (SELECT count(DISTINCT {c}) FROM orders) AS \"distinct\", '{r}' AS range, (SELECT count(DISTINCT {c}) FROM orders) = k AS key FROM n"
    for c, r in (("o_orderkey", "integer"), ("o_custkey", "integer"), ("o_orderstatus", "string"), ("o_orderpriority", "string"),
    ("o_totalprice", "number")))


def inclusion_dependencies(spark, d):
    cols = {"customer.c_custkey": ("customer", "c_custkey"), "orders.o_custkey": ("orders", "o_custkey"),
        "nation.n_nationkey": ("nation", "n_nationkey"), "supplier.s_nationkey": ("supplier", "s_nationkey"),
            "supplier.s_suppkey": ("supplier", "s_suppkey"), "lineitem.l_suppkey": ("lineitem", "l_suppkey"),
            "nation.n_name": ("nation", "n_name")}
    out = I.inclusion_dependencies({k: table(spark, d, t).select(c) for k, (t, c) in cols.items()})
    return out.select("a", "b", F.round("share", 6).alias("share"))


INCLUSION = "WITH l AS (" + " UNION ".join(f"SELECT '{t}.{c}' AS c, CAST({c} AS VARCHAR) AS v FROM {t}" for t, c in (
    ("customer", "c_custkey"), ("orders", "o_custkey"), ("nation", "n_nationkey"), ("supplier", "s_nationkey"), ("supplier", "s_suppkey"), ("lineitem", "l_suppkey"), ("nation", "n_name"))) + """),
n AS (SELECT c, count(*) AS n FROM l GROUP BY c) SELECT a.c AS a, b.c AS b, round(count(*) / any_value(n.n), 6) AS share FROM l a JOIN l b ON a.v = b.v AND a.c <> b.c JOIN n ON n.c = a.c GROUP BY a.c, b.c HAVING count(*) / any_value(n.n) >= 0.5"""


def predicate_importance(spark, d):
    s = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("name")).agg(F.count(F.lit(1)).alias("support"))
    return I.importance(s)


IMPORTANCE = """WITH s AS (SELECT l_returnflag AS name, count(*) AS support FROM lineitem GROUP BY 1) SELECT name, support, round(ln(1 + support) / ln(1 + (SELECT max(support) FROM s)), 3) AS importance FROM s"""


def value_normalise_dates(spark, d):
    """Order dates written in six ways, read back."""
    t = F.col("o_orderdate")
    k = (F.col("o_orderkey") % 6 + 1).cast("int")
    forms = F.array(F.date_format(t, "yyyy-MM-dd"), F.date_format(t, "d MMMM yyyy"), F.date_format(t, "MMM d, yyyy"),
        F.date_format(t, "dd/MM/yyyy"), F.date_format(t, "MMMM yyyy"), F.date_format(t, "yyyy.M.d"))
    return table(spark, d, "orders").select("o_orderkey", V.normalize_date(F.element_at(forms, k)).alias("value"))


DATES = """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 4 THEN strftime(o_orderdate, '%Y-%m') WHEN 3 THEN CASE WHEN day(o_orderdate) > 12 OR day(o_orderdate) = month(o_orderdate) THEN strftime(o_orderdate, '%Y-%m-%d') END
ELSE strftime(o_orderdate, '%Y-%m-%d') END AS value FROM orders"""


def value_normalise_quantities(spark, d):
    """Part sizes written in units, in their canonical unit."""
    u = F.element_at(F.array(*map(F.lit, (" km", " inches", " kg", " hours", "%", " GB"))), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", V.normalize_quantity()(F.concat(F.col("p_size").cast("string"), u)).alias("value"))


QUANTITIES = """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_size * 1000 || ' m' WHEN 1 THEN rtrim(rtrim(CAST(CAST(p_size * 0.0254 AS DECIMAL(18, 4)) AS VARCHAR), '0'), '.') || ' m' WHEN 2 THEN p_size || ' kg'
WHEN 3 THEN p_size * 3600 || ' s' WHEN 4 THEN p_size || ' %' ELSE p_size * 1000000000::BIGINT || ' B' END AS value FROM part"""


def _sentences(spark, d):
    docs = table(spark, d, "documents")
    s = spans.sentences(docs).join(docs.select("doc_id", "text"), "doc_id")
    return s.select("doc_id", "pos", "start", "end", F.substr("text", F.col("start") + 1, F.col("end") - F.col("start")).alias("text"))


def mention_coverage(spark, d):
    """Sentences that name two or more known names and that no benchmark passage cites, by document."""
    names = table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]{7,}"),
        F.lit(0))).alias("name")).distinct()
    s = _sentences(spark, d)
    found = I.mentions(s.select("doc_id", "pos", "text"), names)
    quotes = table(spark, d, "benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"))
    cited = spans.locate_quotes(table(spark, d, "documents"), quotes)
    return I.uncovered_sentences(s.drop("text"), found, cited).groupBy("doc_id").agg(F.count(F.lit(1)).alias("uncovered"),
        F.max("names").alias("most"))


def extract_key_values(spark, d):
    """Key: value lines and pipe tables made from the dimension tables, read back as facts."""
    text, _ = E.render_record(["n_name", "n_regionkey"])
    docs = table(spark, d, "nation").select(F.col("n_nationkey").alias("doc_id"),
        F.concat(F.lit("# Nation\n"), text, F.lit("\n\nSome prose.\n")).alias("text"))
    return E.key_value_facts(docs).select("doc_id", "heading", "key", "value")


KEY_VALUES = """SELECT n_nationkey AS doc_id, 'Nation' AS heading, 'n_name' AS key, n_name AS value FROM nation UNION ALL SELECT n_nationkey, 'Nation', 'n_regionkey', CAST(n_regionkey AS VARCHAR) FROM nation"""


def extract_pipe_tables(spark, d):
    n = table(spark, d, "nation")
    rows = n.groupBy(F.col("n_regionkey").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey",
        "n_name"))), lambda x: F.concat(
        F.lit("| "), x["n_nationkey"].cast("string"), F.lit(" | "), x["n_name"], F.lit(r" \| x |"))), "\n").alias("body"))
    docs = rows.select("doc_id", F.concat(F.lit("Intro\n| id | name |\n|---|:--|\n"), F.col("body"), F.lit("\nEnd")).alias("text"))
    return E.table_facts(docs).select("doc_id", "row", "column", "value")


PIPES = """WITH r AS (SELECT n_regionkey AS doc_id, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INT) AS row, n_nationkey, n_name FROM nation)
SELECT doc_id, row, 'id' AS "column", CAST(n_nationkey AS VARCHAR) AS value FROM r UNION ALL SELECT doc_id, row, 'name', n_name || ' | x' FROM r"""


def triples_to_facts(spark, d):
    """A triple per document: its source says its language, cited by offsets, by quote, or by the whole text."""
    docs = table(spark, d, "documents")
    k = F.col("doc_id") % 3
    t = docs.select(F.col("doc_id").cast("string").alias("doc"), F.col("source").alias("subject"), F.lit("language").alias("predicate"),
        F.col("lang").alias("object"), F.lit("site").alias("subject_type"),
                    F.lit(None).cast("string").alias("object_type"), F.when(k == 0, 0).alias("start"),
                    F.when(k == 0, F.least(F.length("text"), F.lit(10))).alias("end"),
                    F.when(k == 1, F.substr("text", F.lit(2), F.lit(12))).alias("quote"), F.when(k == 2, 0.9).alias("confidence"))
    types = spark.createDataFrame([("site", "Website")], "alias string, name string")
    return E.triples_to_facts(t, docs, types).select("doc", "s_key", "s_type", "o_kind", "o_repr", F.col("start").cast("long"),
        F.col("end").cast("long"), "origin", "confidence")


TRIPLES = """SELECT CAST(doc_id AS VARCHAR) AS doc, 'Website:' || source AS s_key, 'Website' AS s_type, 'value' AS o_kind, lang AS o_repr,
CASE doc_id % 3 WHEN 1 THEN CASE WHEN substring(text, 2, 12) <> '' THEN instr(text, substring(text, 2, 12)) - 1 ELSE 0 END ELSE 0 END AS start,
CASE doc_id % 3 WHEN 0 THEN least(length(text), 10) WHEN 1 THEN CASE WHEN substring(text, 2, 12) <> '' THEN instr(text, substring(text, 2, 12)) - 1 + length(substring(text, 2, 12)) ELSE length(text) END ELSE length(text) END AS "end",
CASE WHEN doc_id % 3 = 0 OR (doc_id % 3 = 1 AND substring(text, 2, 12) <> '') THEN 'cited' ELSE 'context' END AS origin, CASE doc_id % 3 WHEN 2 THEN 0.9::DOUBLE ELSE 0.5::DOUBLE END AS confidence FROM documents"""


def hybrid_best_per_claim(spark, d):
    """Two extractors' facts on parts: the more confident stays, the first of a tie."""
    p = table(spark, d, "part").select(F.col("p_brand").alias("s_key"), F.col("p_type").alias("predicate"), F.col("p_partkey").alias("ord"),
        (F.col("p_size") % 7 / 10.0).alias("confidence"), F.col("p_name").alias("quote"))
    return E.best_per_claim(p, ["s_key", "predicate"]).select("s_key", "predicate", "ord", "confidence", "quote")


HYBRID = """SELECT s_key, predicate, ord, confidence, quote FROM (SELECT p_brand AS s_key, p_type AS predicate, p_partkey AS ord, p_size % 7 / 10.0 AS confidence, p_name AS quote,
 row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_size % 7 DESC, p_partkey) AS rn FROM part) WHERE rn = 1"""


def microbatch_equals_batch(spark, d):
    """Order claims merged file by file by the streaming upsert; support of each claim, as a batch would have it."""
    where = fresh_path(spark, "micro")
    claims = table(spark, d, "orders").select(F.col("o_custkey").alias("customer"), F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("source"))
    claims.repartition(4).write.parquet(f"{where}/in")
    stream = spark.readStream.schema(claims.schema).option("maxFilesPerTrigger", 2).parquet(f"{where}/in")
    store = micro.VersionedStore(spark, f"{where}/store")
    micro.upsert_stream(stream, store, micro.merge_counts(["customer", "status"]), f"{where}/ck")
    return store.read().groupBy("customer", "status").agg(F.count(F.lit(1)).alias("support"))


MICRO = "SELECT o_custkey AS customer, o_orderstatus AS status, count(DISTINCT o_orderpriority) AS support FROM orders GROUP BY 1, 2"


def event_windows(spark, d):
    """Extension: hourly windows of events."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    w = micro.tumbling(e, "ts", "1 hour", "10 minutes", F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))
    return w.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "n", "users")


WINDOWS = "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1"


def event_sessions(spark, d):
    """Extension: sessions of a user that end after six hours."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    s = micro.sessions(e, "user_id", "ts", "6 hours", F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


SESSIONS = """WITH x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
y AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM x) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM y GROUP BY user_id, s"""


def projected_graph_counts(spark, d):
    """Entities, edges and properties of the graph that the order tables make."""
    c = table(spark, d, "customer").agg(F.count(F.lit(1)).alias("customers"), F.count("c_mktsegment").alias("properties"))
    o = table(spark, d, "orders").agg(F.count(F.lit(1)).alias("orders"))
    l = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").distinct().agg(F.count(F.lit(1)).alias("edges"))
    return c.crossJoin(o).crossJoin(l).select((F.col("customers") + F.col("orders")).alias("entities"), "edges", "properties")


COUNTS = "SELECT (SELECT count(*) FROM customer) + (SELECT count(*) FROM orders) AS entities, (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)) AS edges, (SELECT count(c_mktsegment) FROM customer) AS properties"

QUERIES = {
    "record_unpivot_facts": (record_unpivot_facts, UNPIVOT), "record_render_offsets": (record_render_offsets, RENDER),
    "lineage_closure": (lineage_closure, LINEAGE), "inverse_map": (inverse_map, INVERSES),
    "schema_problems": (schema_problems, SCHEMA), "ontology_diff": (ontology_diff, DIFF),
    "ontology_diagnostics": (ontology_diagnostics, DIAGNOSTICS), "event_props_json": (event_props_json, PROPS),
    "record_shape_profile": (record_shape_profile, PROFILE), "inclusion_dependencies": (inclusion_dependencies, INCLUSION),
    "predicate_importance": (predicate_importance, IMPORTANCE),
    "value_normalise_dates": (value_normalise_dates, DATES), "value_normalise_quantities": (value_normalise_quantities, QUANTITIES),
    "mention_coverage": (mention_coverage, None),
    "extract_key_values": (extract_key_values, KEY_VALUES), "extract_pipe_tables": (extract_pipe_tables, PIPES),
    "triples_to_facts": (triples_to_facts, TRIPLES), "hybrid_best_per_claim": (hybrid_best_per_claim, HYBRID),
    "microbatch_equals_batch": (microbatch_equals_batch, MICRO), "event_windows": (event_windows, WINDOWS),
    "event_sessions": (event_sessions, SESSIONS), "projected_graph_counts": (projected_graph_counts, COUNTS),
}
