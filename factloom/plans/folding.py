"""Folding, reports over runs, graph plans, budgets and batches over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..control import within_budget
from ..eval import reports as E
from ..operators import cluster, fold, naming, ordering
from ..sinks import graph
from ..sources import datasets
from ..sources.tables import table


def _text(c: str):
    return F.col(c).cast("string")


def _order_facts(spark, d):
    """Orders as facts: placed_by edges to customers and status values; statuses of late orders are retired."""
    o = table(spark, d, "orders")
    rest = [F.lit(1.0).alias("confidence"), F.lit(1).cast("long").alias("support"), F.lit("asserted").alias("polarity"),
        F.create_map().cast("map<string,string>").alias("qualifiers"), F.lit("").alias("outcome")]
    key = F.concat(F.lit("Order:"), _text("o_orderkey"))
    edge = o.select(F.concat(F.lit("e"), _text("o_orderkey")).alias("sig"), key.alias("s_key"), F.lit("Order").alias("s_type"),
        F.lit("placed_by").alias("predicate"), F.lit("entity").alias("o_kind"),
                    F.concat(F.lit("Customer:"), _text("o_custkey")).alias("o_key"), F.lit("Customer").alias("o_type"),
                    F.lit(None).cast("string").alias("o_repr"), *rest, F.lit(None).cast("string").alias("retired_at"))
    late = F.when(F.year("o_orderdate") >= 2000, "2001-01-01")
    value = o.select(F.concat(F.lit("v"), _text("o_orderkey")), key, F.lit("Order"), F.lit("status"), F.lit("value"),
        F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("o_orderstatus"), *rest, late)
    return edge.union(value)


def _customers(spark, d):
    c = table(spark, d, "customer")
    return c.select(F.concat(F.lit("Customer:"), _text("c_custkey")).alias("key"), F.lit("Customer").alias("type"),
        F.col("c_name").alias("label"))


def merged_entities(spark, d):
    """Suppliers folded in threes: the one divisible by three is canonical, where there is one."""
    s, k = table(spark, d, "supplier"), F.col("s_suppkey")
    e = s.select(k.alias("k"), F.lit("Supplier").alias("type"), F.concat(F.lit("Firm "), (k % 4).cast("string")).alias("label"),
        F.array(F.concat(F.lit("FIRM-"), (k % 5).cast("string")), F.col("s_name")).alias("aliases"),
                 F.when(k % 3 == 1, F.concat(F.lit("reg:"), k.cast("string"))).alias("external_id"),
                 F.create_map(F.lit("nation"), _text("s_nationkey"), F.concat(F.lit("m"), (k % 3).cast("string")),
                 k.cast("string")).alias("attributes"))
    name = lambda x: F.concat(F.lit("S"), F.lpad(x.cast("string"), 8, "0"))
    e, m = e.withColumn("key", name(F.col("k"))), s.select(name(k).alias("key"), name(k - k % 3).alias("canonical"))
    out = fold.merge_entities(e.drop("k"), m.join(s.select(name(k).alias("canonical")), "canonical", "left_semi"))
    return out.select("key", "label", F.array_join("aliases", "|").alias("aliases"), "external_id",
        F.array_join(F.transform(F.map_entries("attributes"), lambda x: F.concat(x["key"], F.lit("="), x["value"])),
        ";").alias("attributes"))


MERGED = """WITH e AS (SELECT s_suppkey AS k, 'S' || lpad(CAST(s_suppkey AS VARCHAR), 8, '0') AS key, CASE WHEN s_suppkey % 3 = 0 OR s_suppkey - s_suppkey % 3 NOT IN (SELECT s_suppkey FROM supplier) THEN s_suppkey ELSE s_suppkey - s_suppkey % 3 END AS c,
 'Firm ' || s_suppkey % 4 AS label, ['FIRM-' || s_suppkey % 5, s_name] AS al, CASE WHEN s_suppkey % 3 = 1 THEN 'reg:' || s_suppkey END AS ext, s_nationkey, s_suppkey % 3 AS m FROM supplier),
f AS (SELECT *, 'S' || lpad(CAST(c AS VARCHAR), 8, '0') AS ck, k <> c AS other FROM e),
h AS (SELECT ck, arg_min(label, (other, key)) AS label, arg_min(ext, (other, key)) FILTER (ext IS NOT NULL) AS external_id FROM f GROUP BY ck),
s AS (SELECT ck, other, key, 0 AS pos, label AS said FROM f UNION ALL SELECT ck, other, key, 1, al[1] FROM f UNION ALL SELECT ck, other, key, 2, al[2] FROM f),
g AS (SELECT ck, regexp_replace(lower(said), '[^\\p{L}\\p{N}]', '', 'g') AS form, arg_min(said, (other, key, pos)) AS said, min((other, key, pos)) AS place FROM s GROUP BY 1, 2),
a AS (SELECT g.ck, string_agg(said, '|' ORDER BY place) AS aliases FROM g JOIN h USING (ck) WHERE form <> regexp_replace(lower(label), '[^\\p{L}\\p{N}]', '', 'g') GROUP BY g.ck),
p AS (SELECT ck, 'nation' AS n, CAST(s_nationkey AS VARCHAR) AS v, other, key FROM f UNION ALL SELECT ck, 'm' || m, CAST(k AS VARCHAR), other, key FROM f),
q AS (SELECT ck, n, arg_min(v, (other, key)) AS v FROM p GROUP BY ck, n), r AS (SELECT ck, string_agg(n || '=' || v, ';' ORDER BY n) AS attributes FROM q GROUP BY ck)
SELECT h.ck AS key, label, coalesce(aliases, '') AS aliases, external_id, attributes FROM h LEFT JOIN a USING (ck) LEFT JOIN r USING (ck)"""


def strongest_member(spark, d):
    """Of the lines of each part the one that counts: the heaviest discount tier, then the newest, then the first."""
    l = table(spark, d, "lineitem").select("l_partkey", F.col("l_discount").alias("tier_w"), F.col("l_shipdate").alias("retrieved_at"),
        (F.col("l_orderkey") * 100000000 + F.col("l_suppkey") * 1000 + F.col("l_linenumber") * 100 + F.col("l_quantity")).cast("long").alias("ord"))
    return fold.strongest(l, ["l_partkey"]).select("l_partkey", "tier_w", F.date_format("retrieved_at", "yyyy-MM-dd").alias("newest"),
        "ord")


STRONGEST = """WITH l AS (SELECT l_partkey, l_discount AS tier_w, l_shipdate, CAST(l_orderkey * 100000000 + l_suppkey * 1000 + l_linenumber * 100 + l_quantity AS BIGINT) AS ord FROM lineitem)
SELECT l_partkey, tier_w, strftime(l_shipdate, '%Y-%m-%d') AS newest, ord FROM l QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY tier_w DESC, l_shipdate DESC, ord) = 1"""


def owned_aliases(spark, d):
    """Part names as aliases: each belongs to the first part that claims it."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_partkey").alias("ord"), F.array("p_name").alias("aliases"))
    return fold.owned_aliases(p)


OWNED = """SELECT min(p_partkey) AS key, arg_min(p_name, p_partkey) AS alias FROM part GROUP BY regexp_replace(lower(p_name), '[^\\p{L}\\p{N}]', '', 'g')"""


def edge_property_split(spark, d):
    f = _order_facts(spark, d)
    a, b = fold.edges(f).agg(F.count(F.lit(1)).alias("edges")), fold.properties(f).agg(F.count(F.lit(1)).alias("properties"))
    return a.crossJoin(b)


SPLIT = "SELECT count(*) AS edges, count(*) AS properties FROM orders"


def retired_with_parents(spark, d):
    """A status is derived from the order's first line of thought, the customer's first order: it retires with it."""
    o = table(spark, d, "orders")
    first = o.groupBy("o_custkey").agg(F.min("o_orderkey").alias("parent"))
    x = o.join(first, "o_custkey").select(F.col("o_orderkey").alias("sig"),
        F.when(F.col("parent") != F.col("o_orderkey"), F.col("parent")).alias("parent_sig"),
        F.when(F.col("o_orderkey") % 4 == 0, "2000-01-01").alias("retired_at"))
    return fold.with_parents(x, F.lit("2001-01-01"))


PARENTS = """WITH x AS (SELECT o_orderkey AS sig, nullif(min(o_orderkey) OVER (PARTITION BY o_custkey), o_orderkey) AS parent_sig FROM orders)
SELECT sig, parent_sig, CASE WHEN sig % 4 = 0 THEN '2000-01-01' WHEN parent_sig % 4 = 0 THEN '2001-01-01' END AS retired_at FROM x"""


def unstamped_facts(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("sig"), F.round(F.col("o_orderkey") % 7 / 10, 1).alias("confidence"),
        F.when(F.col("o_orderkey") % 2 == 0, 0.9).alias("confidence_before"), F.lit("lost").alias("outcome"), F.lit(0.5).alias("ratio"))
    return fold.unstamped(o)


UNSTAMPED = "SELECT o_orderkey AS sig, CASE WHEN o_orderkey % 2 = 0 THEN 0.9 ELSE round(o_orderkey % 7 / 10, 1) END AS confidence FROM orders"


def checked_stamps(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("sig"),
        F.when(F.col("o_orderstatus") == "F", "supported").otherwise("not_found").alias("verdict"),
        F.when(F.col("o_orderkey") % 3 == 0, "old").alias("review"), F.when(F.col("o_orderkey") % 5 == 0, "range").alias("problem"))
    return fold.stamp_checked(o, "f00d").select("sig", "review", "checked")


STAMPS = "SELECT o_orderkey AS sig, CASE WHEN o_orderkey % 5 = 0 THEN 'range' WHEN o_orderstatus = 'F' THEN NULL WHEN o_orderkey % 3 = 0 THEN 'old' END AS review, 'f00d' AS checked FROM orders"


def stored_forms(spark, d):
    """Source forms stored as JSON lists, as single strings, or as something else, read back."""
    n, k = table(spark, d, "nation"), F.col("n_nationkey")
    c = F.when(k % 3 == 0, F.concat(F.lit('{"name": ["'), "n_name", F.lit('", "x"]}'))).when(k % 3 == 1,
        F.concat(F.lit('{"name": "'), "n_name", F.lit('"}'))).otherwise(F.lit("none"))
    return n.select("n_nationkey", F.array_join(fold.source_forms(c)["name"], "|").alias("forms"))


FORMS = "SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN n_name || '|x' WHEN 1 THEN n_name END AS forms FROM nation"


def corroboration_effect(spark, d):
    """Customer and status as an edge, priorities as its sources; the set knows every edge of even customers, half of them with sources."""
    o = table(spark, d, "orders")
    edge = F.concat_ws(" ", "o_custkey", "o_orderstatus")
    claims = o.where("o_custkey % 3 <> 0").groupBy(edge.alias("edge")).agg(F.count_distinct("o_orderpriority").alias("support"))
    gold = o.where("o_custkey % 2 = 0").groupBy(edge.alias("edge")).agg(F.count_distinct("o_orderpriority").alias("n"),
        F.first("o_custkey").alias("c"))
    gold = gold.select("edge", F.when(F.col("c") % 4 == 0, F.col("n")).alias("sources"), F.lit(True).alias("factual"))
    out = E.corroboration_effect(claims, gold)
    return out.select(*out.columns[:7], F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


EFFECT = """WITH e AS (SELECT o_custkey AS c, o_custkey || ' ' || o_orderstatus AS edge, count(DISTINCT o_orderpriority) AS n FROM orders GROUP BY 1, 2),
x AS (SELECT edge, n AS support, CASE WHEN c % 4 = 0 THEN least(n, 3) END AS sources, c % 2 = 0 AS factual FROM e WHERE c % 3 <> 0),
g AS (SELECT least(n, 3) AS b, count(*) AS gold FROM e WHERE c % 4 = 0 GROUP BY 1),
k AS (SELECT 'off' AS config, 0 AS least_ UNION ALL SELECT 'on', 0 UNION ALL SELECT 'on_two_or_more', 2),
m AS (SELECT config, count(*) AS edges, count_if(factual) AS factual, count(sources) AS in_gold FROM k JOIN x ON support >= least_ GROUP BY config),
f AS (SELECT config, sources AS b, count(*) AS found FROM k JOIN x ON support >= least_ WHERE sources IS NOT NULL GROUP BY 1, 2)
SELECT config, CASE WHEN g.b = 3 THEN '3+' ELSE CAST(g.b AS VARCHAR) END AS bucket, edges, CAST(factual AS BIGINT) AS factual, in_gold, gold, coalesce(found, 0) AS found, round(factual / edges, 6) AS precision, round(coalesce(found, 0) / gold, 6) AS recall
FROM m CROSS JOIN g LEFT JOIN f USING (config, b)"""


def ablation_rows(spark, d):
    """Labels as facts: good ones are correct, a toxic mark is a refusal, length decides a contest."""
    l = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    x = l.select((F.col("quality") == 1).alias("correct"), F.when(F.col("toxic") == 0, "supported").otherwise("not_found").alias("verdict"),
        F.when(F.col("n_chars") < 500, "lost").alias("outcome"))
    out = E.ablation(x, 1000)
    return out.select("config", "kept", "correct", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


ABLATION = """WITH x AS (SELECT quality = 1 AS c, toxic = 0 AS g, toxic = 0 AND n_chars >= 500 AS s FROM labels JOIN documents USING (doc_id)),
y AS (SELECT 'extraction' AS config, c FROM x UNION ALL SELECT '+ grounding', c FROM x WHERE g UNION ALL SELECT '+ corroboration', c FROM x WHERE s)
SELECT config, count(*) AS kept, CAST(count_if(c) AS BIGINT) AS correct, round(count_if(c) / count(*), 6) AS precision, round(count_if(c) / 1000, 6) AS recall FROM y GROUP BY config"""


def adjudicated_precision(spark, d):
    """Three runs of a judge over every label."""
    l = table(spark, d, "labels")
    votes = l.select(F.col("doc_id").alias("fact"), F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("run")).withColumn("verdict",
        F.when((F.col("fact") + F.col("run") * 7) % 3 > 0, "supported").otherwise("not_found"))
    out = E.adjudicated_precision(l.select(F.col("doc_id").alias("fact"), (F.col("quality") == 1).alias("correct")),
        votes.where("(fact + run) % 5 > 0"))
    return out.select("facts", F.round("strict", 6).alias("strict"), F.round("adjudicated", 6).alias("adjudicated"))


ADJUDICATED = """WITH v AS (SELECT doc_id, count(*) AS n FROM labels, range(1, 4) r(run) WHERE (doc_id + run) % 5 > 0 AND (doc_id + run * 7) % 3 > 0 GROUP BY doc_id)
SELECT count(*) AS facts, round(count_if(quality = 1) / count(*), 6) AS strict, round(count_if(quality = 1 OR coalesce(n, 0) >= 2) / count(*), 6) AS adjudicated FROM labels LEFT JOIN v USING (doc_id)"""


def lenient_rows(spark, d):
    """Outcomes by order: some are hits, the rest a missing and a spurious fact, of which a judge finds some the same."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("k"))
    none = F.lit(None).cast("long")
    outcomes = o.where("k % 3 = 0").select("doc_id", F.lit("correct").alias("kind"), F.col("k").alias("gold_ord"),
        F.col("k").alias("predicted_ord"))
    outcomes = outcomes.union(o.where("k % 3 = 1").select("doc_id", F.lit("missing"), "k",
        none)).union(o.where("k % 3 = 2").select("doc_id", F.lit("spurious"), none, "k"))
    g, p = o.where("k % 3 = 1").select("doc_id", F.col("k").alias("gold_ord")), o.where("k % 3 = 2").select("doc_id",
        F.col("k").alias("predicted_ord"))
    pairs = g.join(p, "doc_id").withColumn("same", (F.col("gold_ord") + F.col("predicted_ord")) % 4 == 0)
    out = E.lenient_score(outcomes, pairs)
    return out.select("hits", "pairs", *[F.round(c, 6).alias(c) for c in out.columns[2:]])


LENIENT = """WITH o AS (SELECT o_custkey AS d, o_orderkey AS k FROM orders), t AS (SELECT g.d, g.k AS g, min(p.k) AS p FROM o g JOIN o p ON g.d = p.d AND g.k % 3 = 1 AND p.k % 3 = 2 AND (g.k + p.k) % 4 = 0 GROUP BY g.d, g.k),
n AS (SELECT (SELECT count(*) FROM o WHERE k % 3 = 0) AS hits, (SELECT count(*) FROM (SELECT DISTINCT d, p FROM t)) AS pairs, (SELECT count(*) FROM o WHERE k % 3 < 2) AS gold, (SELECT count(*) FROM o WHERE k % 3 <> 1) AS predicted)
SELECT hits, pairs, round(hits / predicted, 6) AS precision, round(hits / gold, 6) AS recall, round((hits + pairs) / predicted, 6) AS lenient_precision, round((hits + pairs) / gold, 6) AS lenient_recall FROM n"""


def fix_prices(spark, d):
    """Events by type as causes of misses, and their users as the run's own rates."""
    names = {"view": "never_offered", "click": "wrong_relation", "purchase": "refused", "signup": "cross_sentence", "error": "not_linked"}
    name = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    e = table(spark, d, "events")
    causes = e.groupBy(name[F.col("event_type")].alias("cause")).agg(F.count(F.lit(1)).alias("n"))
    one = e.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("value") > 50).alias("hits"))
    rates = one.select(F.lit("gold").alias("rate"), "hits",
        (F.col("total") * 2).alias("total")).union(one.select(F.lit("overall"), "hits", "total")).union(one.select(F.lit("offered"),
        (F.col("total") / 2).cast("long"), "total"))
    out = E.price_fixes(causes, rates)
    return out.select("fix", "misses", F.round("expected", 6).alias("expected"), F.round("ceiling", 6).alias("ceiling"), "exact",
        F.col("rank").cast("long").alias("rank"))


FIXES = """WITH c AS (SELECT event_type AS t, count(*) AS n FROM events GROUP BY 1), g AS (SELECT count(*) AS total, count_if(value > 50) AS hits FROM events),
r(t, fix, place) AS (VALUES ('view', 'offer-relations', 0), ('purchase', 'audit-refusals', 1), ('click', 'relation-descriptions', 2), ('signup', 'wider-context', 6), ('error', 'reextract', 9)),
x AS (SELECT fix, place, n AS misses, n * CASE t WHEN 'purchase' THEN 1.0 WHEN 'view' THEN CAST(trunc(total / 2) AS BIGINT) / total ELSE hits / total END / (2 * total) AS e, n / (2 * total) AS ceiling, t = 'purchase' AS exact FROM r JOIN c USING (t), g)
SELECT fix, misses, round(e, 6) AS expected, round(ceiling, 6) AS ceiling, exact, row_number() OVER (ORDER BY e DESC, ceiling DESC, place) AS rank FROM x"""


def measured_fixes(spark, d):
    """Every nation's run predicted a fix; those of even ones were applied in the next nation's run."""
    n = table(spark, d, "nation")
    k = F.col("n_nationkey")
    predicted = n.select(_text("n_nationkey").alias("run"), F.lit("reextract").alias("fix"), (k / 100).alias("expected"),
        (k / 50).alias("ceiling"))
    applied = n.where("n_nationkey % 2 = 0").select(_text("n_nationkey").alias("run"), (k + 1).cast("string").alias("against"),
        F.lit("reextract").alias("fix"))
    compared = n.select(_text("n_nationkey").alias("run"), (k + 1).cast("string").alias("against"), (k / 200).alias("difference"),
        (k / 400).alias("low"), (k / 100).alias("high"), F.lit("better").alias("verdict"))
    return E.measured_fixes(predicted, applied, compared)


MEASURED = """SELECT CAST(n_nationkey AS VARCHAR) AS run, CAST(n_nationkey + 1 AS VARCHAR) AS against, 'reextract' AS fix, n_nationkey / 100 AS expected, n_nationkey / 50 AS ceiling, n_nationkey / 200 AS measured, n_nationkey / 400 AS low, n_nationkey / 100 AS high, 'better' AS verdict
FROM nation WHERE n_nationkey % 2 = 0"""


def job_counts(spark, d):
    """Orders by status as stages of a run."""
    one = F.lit(1)
    o = table(spark, d, "orders").select(F.col("o_orderstatus").alias("stage"), one.alias("facts_in"),
        F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(0).alias("facts_out"),
        F.when(F.col("o_orderkey") % 2 == 1, 1).otherwise(0).alias("refused"),
                                         F.lit(0).alias("merged"), F.lit(0).alias("linked"),
                                         F.when(F.col("o_orderkey") % 5 == 0, 1).otherwise(0).alias("review"))
    return E.job_counts(o)


JOBS = """SELECT o_orderstatus AS stage, count(*) AS facts_in, CAST(count_if(o_orderkey % 2 = 0) AS BIGINT) AS facts_out, CAST(count_if(o_orderkey % 2 = 1) AS BIGINT) AS refused, CAST(0 AS BIGINT) AS merged, CAST(0 AS BIGINT) AS linked,
CAST(count_if(o_orderkey % 5 = 0) AS BIGINT) AS review FROM orders GROUP BY ROLLUP (o_orderstatus)"""


def eval_report(spark, d):
    """Languages as runs, with the shares of labels as metrics of two sections."""
    x = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").groupBy("lang").agg(F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("quality") == 1).alias("good"))
    rows = x.select(F.col("lang").alias("name"),
        F.explode(F.array(F.struct(F.lit("size").alias("section"), F.lit("n").alias("metric"), F.col("n").cast("long").alias("value")),
                                                                   F.struct(F.lit("quality").alias("section"),
                                                                   F.lit("good").alias("metric"),
                                                                   F.col("good").cast("long").alias("value")))).alias("r")).select("name",
                                                                   "r.*")
    return E.eval_report(rows.withColumn("low", F.lit(None).cast("long")).withColumn("high", F.col("value")), "labels")


REPORT = """SELECT '1.0' AS schema_version, 'labels' AS title, lang AS name, '{"quality":{"good":{"value":' || count_if(quality = 1) || ',"high":' || count_if(quality = 1) || '}},"size":{"n":{"value":' || count(*) || ',"high":' || count(*) || '}}}' AS sections
FROM documents JOIN labels USING (doc_id) GROUP BY lang"""


def judge_standing(spark, d):
    """Languages as stages, the agreement of their labels as cards; one stage has no card."""
    x = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id",
        "left").groupBy(F.col("lang").alias("stage")).agg(F.count("quality").alias("m"), F.count_if(F.col("quality") == 1).alias("good"))
    return E.standing(x.select("stage", F.lit("judge").alias("model"), F.when(F.col("stage") != "es", F.col("m")).alias("n"),
        (F.col("good") / F.col("m")).alias("kappa")), 0.6, 50)


STANDING = """SELECT lang AS stage, 'judge' AS model, CASE WHEN lang = 'es' THEN 'no card' WHEN count(quality) < 50 THEN 'too few labels' WHEN count_if(quality = 1) / count(quality) < 0.6 THEN 'below agreement' ELSE 'in good standing' END AS standing
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang"""


def graph_write_plan(spark, d):
    """The plan of writes of the order graph, counted by its groups in their order."""
    links = _customers(spark, d).select(F.col("key").alias("source_key"), F.lit("Customer:0").alias("target_key"),
        F.lit("similar").alias("kind"), F.lit(0.5).alias("score"), F.lit("test").alias("reason"))
    plan = graph.write_plan(_customers(spark, d), _order_facts(spark, d), links, tenant="acme")
    counts = graph.statements(plan).select("stage", "kind", "grp", "rows")
    owned = plan.where(F.col("row").contains('"tenant":"acme"')).groupBy("kind").agg(F.count(F.lit(1)).alias("owned"))
    return counts.join(owned, "kind").select(F.col("stage").cast("long").alias("stage"), "kind", "grp", "rows", "owned")


PLAN = """WITH n AS (SELECT count(*) AS orders, (SELECT count(*) FROM (SELECT c_custkey FROM customer UNION SELECT o_custkey FROM orders)) AS customers, (SELECT count(*) FROM customer) AS listed, (SELECT count(*) FROM orders WHERE year(o_orderdate) < 2000) AS live FROM orders)
SELECT 0::BIGINT AS stage, 'entity' AS kind, 'Customer' AS grp, customers AS rows, customers + orders AS owned FROM n UNION ALL SELECT 0, 'entity', 'Order', orders, customers + orders FROM n UNION ALL SELECT 1, 'edge', 'Order placed_by Customer', orders, orders FROM n
UNION ALL SELECT 2, 'claim', 'Order status', orders, orders FROM n UNION ALL SELECT 3, 'projection', 'Order status', live, live FROM n WHERE live > 0 UNION ALL SELECT 4, 'link', 'SIMILAR', listed, listed FROM n"""


def graph_vertices(spark, d):
    v, e = graph.graph_frames(_customers(spark, d), _order_facts(spark, d))
    a = v.groupBy("type").agg(F.count(F.lit(1)).alias("vertices"), F.count("label").alias("labelled"),
        F.sum(F.size("properties")).cast("long").alias("properties"))
    return a.crossJoin(e.agg(F.count(F.lit(1)).alias("edges")))


VERTICES = """WITH n AS (SELECT count(*) AS orders, count_if(year(o_orderdate) < 2000) AS live FROM orders), c AS (SELECT count(*) AS c FROM (SELECT c_custkey FROM customer UNION SELECT o_custkey FROM orders))
SELECT 'Order' AS type, orders AS vertices, 0::BIGINT AS labelled, CAST(live AS BIGINT) AS properties, orders AS edges FROM n UNION ALL SELECT 'Customer', c, (SELECT count(*) FROM customer), 0, orders FROM n, c"""


def compare_and_set(spark, d):
    """Parts at versions 0 to 2; a batch that read version 1 of every second part, and one new part."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("k"), (F.col("p_partkey") % 3).alias("version"), "p_size")
    batch = p.where("k % 2 = 0").select("k", F.lit(1).cast("long").alias("read_version"), (F.col("p_size") + 100).alias("p_size"))
    after, moved = graph.compare_and_set(p, batch, ["k"])
    return after.select("k", F.col("version").cast("long"), "p_size",
        F.lit("stored").alias("what")).union(moved.select("k", "read_version", "p_size", F.lit("moved")))


CAS = """SELECT p_partkey AS k, p_partkey % 3 + CASE WHEN p_partkey % 2 = 0 AND p_partkey % 3 = 1 THEN 1 ELSE 0 END AS version, p_size + CASE WHEN p_partkey % 2 = 0 AND p_partkey % 3 = 1 THEN 100 ELSE 0 END AS p_size, 'stored' AS what FROM part
UNION ALL SELECT p_partkey, 1, p_size + 100, 'moved' FROM part WHERE p_partkey % 2 = 0 AND p_partkey % 3 <> 1"""


def write_report(spark, d):
    p = table(spark, d, "part").select(F.col("p_brand").alias("kind"), "p_partkey", "p_size")
    new = p.withColumn("p_size", F.when(F.col("p_partkey") % 3 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")))
    return graph.write_report(p.where("p_partkey % 5 <> 0"), new, ["p_partkey"])


WRITTEN = """SELECT p_brand AS kind, CAST(count_if(p_partkey % 5 = 0) AS BIGINT) AS written, CAST(count_if(p_partkey % 5 <> 0 AND p_partkey % 3 = 0) AS BIGINT) AS merged, CAST(count_if(p_partkey % 5 <> 0 AND p_partkey % 3 <> 0) AS BIGINT) AS skipped FROM part GROUP BY p_brand"""


def verdicts_written(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("sig"), F.lit("unchecked").alias("verdict"))
    return graph.write_verdicts(o, o.where("sig % 3 = 0").select("sig", F.lit("supported").alias("verdict")))


VERDICTS = "SELECT o_orderkey AS sig, CASE WHEN o_orderkey % 3 = 0 THEN 'supported' ELSE 'unchecked' END AS verdict FROM orders"


def budget_calls(spark, d):
    """A call for every document, by doc_id, until tokens or calls run out."""
    c = table(spark, d, "documents").select("doc_id", F.coalesce("n_chars", F.lit(0)).alias("input_tokens"),
        F.lit(100).alias("output_tokens"), F.lit(0.01).alias("usd"))
    return within_budget(c, ["doc_id"], calls_limit=500, tokens_limit=200_000).select("doc_id", "allowed")


BUDGET = """WITH c AS (SELECT doc_id, row_number() OVER w AS n, sum(coalesce(n_chars, 0) + 100) OVER w AS t FROM documents WINDOW w AS (ORDER BY doc_id ROWS UNBOUNDED PRECEDING)), s AS (SELECT min(doc_id) AS stop FROM c WHERE n > 500 OR t > 200000)
SELECT doc_id, stop IS NULL OR doc_id < stop AS allowed FROM c, s"""


def text_batches(spark, d):
    """Lines in batches of about 50, all lines of an order in one."""
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    out = ordering.text_batches(l, "l_orderkey", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], 50)
    return out.groupBy("batch").agg(F.count(F.lit(1)).alias("rows"), F.min("l_orderkey").alias("first"), F.max("l_orderkey").alias("last"))


BATCHES = """WITH t AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1), c AS (SELECT *, coalesce(sum(n) OVER (ORDER BY l_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM t)
SELECT CAST(floor(b / 50) AS BIGINT) AS batch, CAST(sum(n) AS BIGINT) AS rows, min(l_orderkey) AS first, max(l_orderkey) AS last FROM c GROUP BY 1"""


def near_names(spark, d):
    """Customer names against their nation's with a word added, changed, or another name: by the cheap rules and the ratio."""
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey")
    b = F.when(k % 4 == 0, F.upper("n_name")).when(k % 4 == 1, F.concat("n_name", F.lit(" Trading"))).when(k % 4 == 2,
        F.lit("zzzz qqqq xxxx")).otherwise(F.lit(""))
    return naming.near_names(c.select("c_custkey", F.col("n_name").alias("a"), b.alias("b")), "a", "b").select("c_custkey", "near")


NEAR = "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN true WHEN 1 THEN length(n_name) >= 4 ELSE false END AS near FROM customer JOIN nation ON c_nationkey = n_nationkey"


def observed_predicates(spark, d):
    """Order lines as gold facts: what predicates a set of facts shows."""
    o = table(spark, d, "orders")
    g = o.select(F.col("o_orderpriority").alias("relation"), F.col("o_orderstatus").alias("s_type"),
        F.concat(F.lit("T"), (F.col("o_custkey") % 3).cast("string")).alias("o_type"))
    out = datasets.observed_predicates(g)
    return out.select("relation", F.array_join("domain", "|").alias("domain"), "range", "seen", "importance")


OBSERVED = """WITH g AS (SELECT o_orderpriority AS relation, o_orderstatus AS s, 'T' || o_custkey % 3 AS o FROM orders), r AS (SELECT relation, o, count(*) AS n FROM g GROUP BY 1, 2), b AS (SELECT relation, arg_min(o, (-n, o)) AS range FROM r GROUP BY 1),
s AS (SELECT relation, array_to_string(list_sort(list(DISTINCT s)), '|') AS domain, count(*) AS seen FROM g GROUP BY 1)
SELECT relation, domain, range, seen, round(0.05 + 0.95 * ln(1 + seen) / ln(1 + max(seen) OVER ()), 4) AS importance FROM s JOIN b USING (relation)"""


def candidate_clusters(spark, d):
    """Part types as candidates by brand: the same type name of several brands is one, unless the brands are refused."""
    p = table(spark, d, "part").select("p_brand", "p_type").distinct()
    c = p.select(F.concat_ws("/", "p_type", "p_brand").alias("id"), F.col("p_type").alias("name"),
        F.array().cast("array<string>").alias("aliases"), F.lit(0).alias("rank"))
    links = cluster.candidate_links(c, threshold=1.01)
    out = cluster.clusters(c, links, links.select("a", "b").limit(0))
    return out.groupBy("cluster", "name").agg(F.count(F.lit(1)).alias("members"))


CLUSTERS = """WITH c AS (SELECT DISTINCT p_type || '/' || p_brand AS id, p_type AS name FROM part), k AS (SELECT *, regexp_replace(lower(name), '[^\\p{L}\\p{N}]', '', 'g') AS f FROM c)
SELECT min(id) AS cluster, arg_min(name, id) AS name, count(*) AS members FROM k GROUP BY f"""

QUERIES = {
    "merged_entities": (merged_entities, MERGED), "strongest_member": (strongest_member, STRONGEST),
    "owned_aliases": (owned_aliases, OWNED), "edge_property_split": (edge_property_split, SPLIT),
    "retired_with_parents": (retired_with_parents, PARENTS), "unstamped_facts": (unstamped_facts, UNSTAMPED),
    "checked_stamps": (checked_stamps, STAMPS), "stored_forms": (stored_forms, FORMS),
    "corroboration_effect": (corroboration_effect, EFFECT), "ablation_rows": (ablation_rows, ABLATION),
    "adjudicated_precision": (adjudicated_precision, ADJUDICATED), "lenient_rows": (lenient_rows, LENIENT),
    "fix_prices": (fix_prices, FIXES), "measured_fixes": (measured_fixes, MEASURED), "job_counts": (job_counts, JOBS),
    "eval_report": (eval_report, REPORT), "judge_standing": (judge_standing, STANDING),
    "graph_write_plan": (graph_write_plan, PLAN), "graph_vertices": (graph_vertices, VERTICES), "compare_and_set": (compare_and_set, CAS),
    "write_report": (write_report, WRITTEN), "verdicts_written": (verdicts_written, VERDICTS),
    "budget_calls": (budget_calls, BUDGET), "text_batches": (text_batches, BATCHES), "near_names": (near_names, NEAR),
    "observed_predicates": (observed_predicates, OBSERVED), "candidate_clusters": (candidate_clusters, CLUSTERS),
}
