"""Lookups in a store, surface forms, ids, judges, sheets, paths and a store's own schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..eval import judges as J
from ..operators import infer as I
from ..operators import lookup as L
from ..operators import resolve as R
from ..operators import verify as V
from ..sinks.schema_text import uniqueness_violations
from ..sources.structure import at_path
from ..sources.tables import table
from .entities import _people


def stored_facts(spark, d):
    """Orders on record of the batch of large lines."""
    return L.stored_facts(table(spark, d, "orders").where("o_orderkey % 2 = 0").select("o_orderkey", "o_custkey"),
        table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"])


STORED = "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)"


def store_candidates(spark, d):
    """Every tenth part as a batch against all parts as the store."""
    p = R.profiles(_people(spark, d))
    return L.store_candidates(p.where(F.substring_index("key", ":", -1).cast("long") % 10 == 0), p, 100_000)


CANDIDATES = r"""WITH e AS (SELECT 'Part:' || p_partkey AS key, p_brand AS type, p_partkey AS k, array_to_string(regexp_extract_all(lower(p_name), '[\p{L}\p{N}]+'), ' ') AS w FROM part),
b AS (SELECT key, type, k, 'name' AS kind, unnest(list_distinct([string_split(w, ' ')[1], string_split(w, ' ')[-1]])) AS block FROM e
 UNION ALL SELECT key, type, k, 'domain', 'brand' || k % 7 || '.example.com' FROM e WHERE k % 50 = 0 UNION ALL SELECT key, type, k, 'id', 'reg:' || k % 60 FROM e WHERE k % 40 = 0)
SELECT DISTINCT x.key AS a, y.key AS b FROM b x JOIN b y USING (type, kind, block) WHERE x.k % 10 = 0 AND x.key <> y.key"""


def store_nearest_names(spark, d):
    """The same with at most three partners for a common token: counts by batch entity."""
    p = R.profiles(_people(spark, d))
    return L.store_candidates(p.where(F.substring_index("key", ":", -1).cast("long") % 10 == 0), p,
        3).groupBy("a").agg(F.count(F.lit(1)).alias("n"))


def surface_pairs(spark, d):
    """Even orders as gold, odd ones as predicted: facts of one customer that differ in one end."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("id"),
        F.col("o_orderstatus").alias("subject"), F.col("o_orderpriority").alias("object"))
    return L.surface_pairs(o.where("id % 2 = 0").withColumn("relation", F.lit("has priority")),
        o.where("id % 2 = 1").withColumn("relation", F.lit("Has_Priority")))


SURFACE = """SELECT a.o_custkey AS doc, a.o_orderkey AS gold, b.o_orderkey AS predicted, CASE WHEN a.o_orderstatus = b.o_orderstatus THEN 'object' ELSE 'subject' END AS side
FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND (a.o_orderstatus = b.o_orderstatus) <> (a.o_orderpriority = b.o_orderpriority) WHERE a.o_orderkey % 2 = 0 AND b.o_orderkey % 2 = 1"""


def id_matches(spark, d):
    """Orders as predictions, whose gold is each third customer's distinct statuses and priorities, each to be met once."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("ord"),
        F.col("o_orderstatus").alias("subject"), F.lit("r").alias("relation"), F.col("o_orderpriority").alias("object"))
    names = o.select("doc", F.explode(F.array("subject", "object")).alias("name")).distinct().withColumn("id",
        F.concat(F.lit("id:"), "name"))
    gold = o.where("doc % 3 = 0").select("doc", F.concat(F.lit("id:"), "subject").alias("s"), "relation",
        F.concat(F.lit("id:"), "object").alias("o")).distinct()
    return L.match_by_ids(o, names, gold).select("doc", "ord", "matched")


ID_MATCHES = """SELECT o_custkey AS doc, o_orderkey AS ord, o_custkey % 3 = 0 AND row_number() OVER (PARTITION BY o_custkey, o_orderstatus, o_orderpriority ORDER BY o_orderkey) = 1 AS matched FROM orders"""


def adjacent_mentions(spark, d):
    """Customers and their nations named in one sentence each."""
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    gap = F.when(F.col("c_custkey") % 2 == 0, " buys goods of ").otherwise(" buys The goods of ")
    t = c.select(F.col("c_custkey").alias("chunk"), F.col("c_name").alias("a"), F.col("n_name").alias("b"),
        F.concat("c_name", gap, "n_name").alias("text"))
    first = t.select("chunk", F.lit(0).alias("start"), F.length("a").alias("end"), F.col("a").alias("name"))
    second = t.select("chunk", (F.length("text") - F.length("b")).alias("start"), F.length("text").alias("end"), F.col("b").alias("name"))
    return L.adjacent_mentions(first.union(second), t)


ADJACENT = "SELECT c_custkey AS chunk, c_name AS subject, 'buys goods of' AS phrase, n_name AS object FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 2 = 0"


def offered_and_used(spark, d):
    p = table(spark, d, "part").select(F.col("p_type").alias("name"), "p_size")
    return L.offered_and_used(p, p.where("p_size > 10"), p.where("p_size > 40"))


OFFERED = """SELECT p_type AS name, NOT bool_or(p_size > 10) AS not_offered, bool_or(p_size > 10) AND NOT bool_or(p_size > 40) AS unused FROM part GROUP BY p_type"""


def reflected_schema(spark, d):
    """The schema that stored order facts show by themselves."""
    o, l = table(spark, d, "orders"), table(spark, d, "lineitem")
    key = F.concat(F.lit("Order:"), F.col("o_orderkey").cast("string"))
    placed = o.select(key.alias("s_key"), F.lit("Order").alias("s_type"), F.lit("placed_by").alias("predicate"),
        F.lit("entity").alias("o_kind"), F.lit("Customer").alias("o_type"), F.col("o_custkey").cast("string").alias("o_repr"))
    status = o.select(key, F.lit("Order"), F.lit("status"), F.lit("value"), F.lit(None).cast("string"), "o_orderstatus")
    lines = l.select(F.concat(F.lit("Order:"), F.col("l_orderkey").cast("string")), F.lit("Order"), F.lit("contains"), F.lit("entity"),
        F.lit("Part"), F.col("l_partkey").cast("string"))
    return L.reflect(placed.union(status).union(lines))


REFLECTED = """SELECT 'placed_by' AS predicate, 'Order' AS domain, 'Customer' AS range, 'single' AS cardinality, count(*) AS support FROM orders UNION ALL SELECT 'status', 'Order', 'literal', 'single', count(*) FROM orders
UNION ALL SELECT 'contains', 'Order', 'Part', 'multi', count(*) FROM lineitem"""


def judge_card(spark, d):
    l = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    word = lambda c: F.when(c, "supported").otherwise("not_found")
    x = l.select(word(F.col("quality") == 1).alias("gold"), word(F.col("toxic") == 0).alias("judged"),
        (F.col("doc_id") % 10 == 0).alias("planted"), (F.col("doc_id") % 7 == 0).alias("flipped"), F.col("n_chars").alias("length"))
    c = J.judge_card(x)
    return c.select("band", "n", *[F.round(k, 6).alias(k) for k in c.columns[2:]])


CARD = """WITH x AS (SELECT CASE WHEN n_chars <= 200 THEN '<=200' WHEN n_chars <= 1000 THEN '<=1000' ELSE '>1000' END AS band, quality = 1 AS g, toxic = 0 AS k, doc_id % 10 = 0 AS p, doc_id % 7 = 0 AS f FROM labels JOIN documents USING (doc_id)),
n AS (SELECT band, count(*) AS n, count(*) FILTER (g = k) / count(*) AS po, count(*) FILTER (g) AS ng, count(*) FILTER (k) AS nk, count(*) FILTER (NOT g AND NOT k) AS c, count(*) FILTER (g AND NOT k) AS l, count(*) FILTER (p) AS np,
 count(*) FILTER (p AND NOT k) AS pc, count(*) FILTER (f) AS nf FROM x GROUP BY ROLLUP (band)), y AS (SELECT *, (ng * nk + (n - ng) * (n - nk)) / (n * n) AS pe FROM n)
SELECT band, n, round(po, 6) AS agreement, round(CASE WHEN pe < 1 THEN (po - pe) / (1 - pe) END, 6) AS kappa, round(c / nullif(n - ng, 0), 6) AS fail_recall, round(l / nullif(ng, 0), 6) AS false_refusals,
round(pc / nullif(np, 0), 6) AS planted_catch, round(nf / n, 6) AS flip_rate FROM y"""


def link_scores(spark, d):
    """Links of neighbouring parts, checked by brand where the size is above five."""
    p, k = table(spark, d, "part"), F.col("p_partkey")
    links = p.select(k.alias("a"), (k + 1).alias("b"),
        F.element_at(F.array(*map(F.lit, ("same_as", "similar", "different"))), (k % 3 + 1).cast("int")).alias("kind"),
        F.when(k % 2 == 0, "rule").otherwise("judge").alias("decider"))
    return J.link_scores(links, p.where("p_size > 5").select(k.alias("key"), F.col("p_brand").alias("id")))


LINKS = """WITH x AS (SELECT ['same_as', 'similar', 'different'][a.p_partkey % 3 + 1] AS kind, CASE WHEN a.p_partkey % 2 = 0 THEN 'rule' ELSE 'judge' END AS decider, CASE WHEN a.p_size > 5 AND b.p_size > 5 THEN (a.p_brand = b.p_brand) <> (a.p_partkey % 3 = 2) END AS r
FROM part a LEFT JOIN part b ON b.p_partkey = a.p_partkey + 1) SELECT kind, decider, count(*) FILTER (r) AS right, count(*) FILTER (NOT r) AS wrong, count(*) FILTER (r IS NULL) AS uncheckable FROM x GROUP BY ALL"""


def micro_macro(spark, d):
    k = F.col("o_orderkey")
    u = table(spark, d, "orders").select("o_orderpriority", (k % 3).alias("tp"), (k % 4).alias("fp"), (k % 2).alias("fn"))
    m = J.micro_macro(u, "o_orderpriority")
    return m.select("o_orderpriority", *[F.round(c, 6).alias(c) for c in m.columns[1:]])


MICRO = """WITH u AS (SELECT o_orderpriority, o_orderkey % 3 AS tp, o_orderkey % 4 AS fp, o_orderkey % 2 AS fn FROM orders)
SELECT o_orderpriority, round(sum(tp) / sum(tp + fp), 6) AS micro_precision, round(sum(tp) / sum(tp + fn), 6) AS micro_recall, round(2 * sum(tp) / sum(2 * tp + fp + fn), 6) AS micro_f1,
round(avg(coalesce(tp / nullif(tp + fp, 0), 0)), 6) AS macro_precision, round(avg(coalesce(tp / nullif(tp + fn, 0), 0)), 6) AS macro_recall, round(avg(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)), 6) AS macro_f1 FROM u GROUP BY 1"""


def label_sheets(spark, d):
    """A sheet's way out and back: the first box is ticked but for ids that end in 0."""
    items = table(spark, d, "labels").where("doc_id IS NOT NULL").select("doc_id").distinct().select(F.col("doc_id").alias("id"),
        F.concat(F.lit("Is document "), "doc_id", F.lit(" good?\n## really")).alias("question"))
    s = J.make_sheets(items, ["yes", "no"])
    filled = s.withColumn("text", F.regexp_replace("text", r"(?m)(^## \d*[1-9]\n(?:(?!^## ).*\n)*?)- \[ \] yes", "$1- [x] yes"))
    return J.read_sheets(filled).select(F.col("id").cast("long").alias("id"), "label", "problem")


SHEETS = """SELECT DISTINCT doc_id AS id, CASE WHEN doc_id % 10 <> 0 THEN 'yes' END AS label, CASE WHEN doc_id % 10 = 0 THEN 'no tick' END AS problem FROM labels WHERE doc_id IS NOT NULL"""


def record_paths(spark, d):
    """Values below a wildcard in a JSON record of each customer."""
    k = F.col("c_custkey")
    j = F.format_string('{"a b": [{"x": [%d, %d]}, {"x": []}, {"x": ["%s"]}]}', k, k + 1, F.col("c_mktsegment"))
    return at_path(table(spark, d, "customer").select("c_custkey", j.alias("j")), "j", '["a b"][*].x[*]').select("c_custkey",
        F.array_join("pos", ".").alias("place"), "value")


PATHS = """SELECT c_custkey, unnest(['0.0', '0.1', '2.0']) AS place, unnest([CAST(c_custkey AS VARCHAR), CAST(c_custkey + 1 AS VARCHAR), c_mktsegment]) AS value FROM customer"""


def shared_keys(spark, d):
    """Order and status keys that a uniqueness constraint over customers would refuse."""
    return uniqueness_violations(table(spark, d, "orders"), ["o_custkey", "o_orderstatus"])


SHARED = "SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) > 1"

def proposed_types(spark, d):
    """Types that sentences over nations and regions state."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    name = F.concat(F.lit("N"), F.col("n_nationkey").cast("string"))
    text = F.concat(F.lit("They saw places such as "), name, F.lit(", R"), F.col("r_regionkey").cast("string"), F.lit(" and Old Town. "),
        name, F.lit(" is a country."))
    return I.proposed_types(n.select(F.col("n_nationkey").alias("doc_id"), text.alias("text")))


PROPOSED = """SELECT 'place' AS type, 'N' || n_nationkey AS instance, 1 AS support FROM nation UNION ALL SELECT 'place', 'R' || n_regionkey, count(*) FROM nation GROUP BY n_regionkey
UNION ALL SELECT 'place', 'Old Town', count(*) FROM nation UNION ALL SELECT 'country', 'N' || n_nationkey, 1 FROM nation"""


def gate_by_card(spark, d):
    """Gate actions over orders once the judge's card (weak here) has turned its refusals into marks."""
    word = lambda c: F.when(c, "supported").otherwise("not_found")
    verdict = F.element_at(F.array(*map(F.lit, ("supported", "contradicted", "not_found", "unchecked"))),
        (F.col("o_orderkey") % 4 + 1).cast("int"))
    o = table(spark, d, "orders").select(V.gate(verdict, F.when(F.col("o_orderstatus") == "P", "range"), True).alias("gate"))
    items = table(spark, d, "orders").select(word(F.col("o_orderkey") % 2 == 0).alias("gold"),
        word(F.col("o_orderkey") % 3 == 0).alias("judged"), F.lit(False).alias("planted"), F.lit(False).alias("flipped"),
        F.lit(1).alias("length"))
    return J.by_card(o, J.judge_card(items)).groupBy("gate.action", "gate.review").agg(F.count(F.lit(1)).alias("n"))


BY_CARD = """SELECT CASE WHEN o_orderstatus = 'P' THEN 'refuse' ELSE 'accept' END AS action, CASE WHEN o_orderstatus <> 'P' AND o_orderkey % 4 IN (1, 2) THEN 'judge' END AS review, count(*) AS n FROM orders GROUP BY ALL"""

QUERIES = {
    "proposed_types": (proposed_types, PROPOSED), "gate_by_card": (gate_by_card, BY_CARD),
    "stored_facts": (stored_facts, STORED), "store_candidates": (store_candidates, CANDIDATES),
    "store_nearest_names": (store_nearest_names, None), "surface_pairs": (surface_pairs, SURFACE),
    "id_matches": (id_matches, ID_MATCHES), "adjacent_mentions": (adjacent_mentions, ADJACENT),
    "offered_and_used": (offered_and_used, OFFERED), "reflected_schema": (reflected_schema, REFLECTED),
    "judge_card": (judge_card, CARD), "link_scores": (link_scores, LINKS), "micro_macro": (micro_macro, MICRO),
    "label_sheets": (label_sheets, SHEETS), "record_paths": (record_paths, PATHS), "shared_keys": (shared_keys, SHARED),
}
