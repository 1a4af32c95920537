"""Unit prices as contested claims, and other merges of claims over the order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.values import combined_confidence
from ..operators import claims as C
from ..sources.tables import table


def _tier_weight():
    return F.element_at(F.array(*map(F.lit, (1.0, 0.8, 0.5, 0.2, 0.2))), F.col("n_regionkey") + 1)


def price_evidence(spark, d):
    """One row per line item: (part, unit price) claimed by a supplier, at the ship date."""
    nation = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    supplier = table(spark, d, "supplier").select("s_suppkey", "s_nationkey").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    lines = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_extendedprice", "l_quantity", "l_shipdate")
    return lines.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("l_partkey").alias("part"), (F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100 + 0.5) / 100).alias("price"),
        F.col("l_suppkey").alias("source"), F.col("l_orderkey").alias("doc_id"), _tier_weight().alias("tier_w"),
        F.col("l_shipdate").cast("timestamp").alias("retrieved_at"))


EVIDENCE_SQL = """
ev AS (SELECT l_partkey AS part, floor(l_extendedprice / l_quantity * 100 + 0.5) / 100 AS price, l_suppkey AS source, l_orderkey AS doc_id,
  [1.0, 0.8, 0.5, 0.2, 0.2][n_regionkey + 1]::DOUBLE AS tier_w, l_shipdate AS retrieved_at
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"""
STANDING_SQL = EVIDENCE_SQL.replace("ev AS (", "ev AS MATERIALIZED (") + """,
vol AS MATERIALIZED (SELECT source, count(DISTINCT (part, price)) AS volume FROM ev GROUP BY source),
newest AS MATERIALIZED (SELECT max(retrieved_at) AS newest FROM ev),
tr AS MATERIALIZED (SELECT part, price, max(tier_w * (0.5 + 0.5 * pow(0.5, greatest(0, epoch_us(newest) - epoch_us(retrieved_at)) / 86400000000.0 / 365.0))) AS trust
  FROM ev, newest GROUP BY part, price),
ag AS MATERIALIZED (SELECT part, price, count(*) AS support, 1 + ln(1 + sum(1 / (1 + ln(volume)))) AS agreement
  FROM (SELECT DISTINCT part, price, source FROM ev) JOIN vol USING (source) GROUP BY part, price),
st AS MATERIALIZED (SELECT part, price, support, trust * agreement AS rank FROM tr JOIN ag USING (part, price)),
w AS MATERIALIZED (SELECT *, row_number() OVER o AS rn, nth_value(rank, 1) OVER o AS best, nth_value(rank, 2) OVER o AS second FROM st
  WINDOW o AS (PARTITION BY part ORDER BY rank DESC, price DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
ct AS (SELECT *, CASE WHEN rn = 1 THEN second ELSE best END AS top FROM w),
oc AS (SELECT *, CASE WHEN top IS NULL THEN NULL WHEN abs(rank - top) <= 1e-9 * greatest(rank, top) THEN 'tied' WHEN top > rank THEN 'lost' ELSE 'won' END AS outcome FROM ct)"""


def ranked_prices(spark, d):
    return C.contest(C.standing(price_evidence(spark, d), ["part", "price"]), ["part"], "price")


def price_contest(spark, d):
    return ranked_prices(spark, d).select("part", "price", "support", F.round("rank", 6).alias("rank"), F.round("top", 6).alias("top"),
        "outcome", F.round("ratio", 4).alias("ratio"))


PRICE_CONTEST = f"""WITH {STANDING_SQL}
SELECT part, price, support, round(rank, 6) AS rank, round(top, 6) AS top, outcome, CASE WHEN outcome = 'lost' THEN round(rank / top, 4) END AS ratio FROM oc"""


def price_score(spark, d):
    """Confidence of each price: extractor 0.8, supported, less the ratio of a lost contest."""
    c = combined_confidence(F.lit(0.8), F.lit(1.0), F.col("support"), F.coalesce(F.col("ratio"), F.lit(1.0)))
    return ranked_prices(spark, d).select("part", "price", F.round(c, 6).alias("confidence"))


PRICE_SCORE = f"""WITH {STANDING_SQL}
SELECT part, price, round((1 - pow(0.2, 1 + ln(greatest(1, support)))) * CASE WHEN outcome = 'lost' THEN rank / top ELSE 1 END, 6) AS confidence FROM oc"""


def price_support_list(spark, d):
    out = C.support_list(price_evidence(spark, d), ["part", "price"])
    return out.select("part", "price", "source", F.size("doc_ids").cast("long").alias("documents"), "tier_w",
        F.date_format("retrieved_at", "yyyy-MM-dd").alias("newest"))


PRICE_SUPPORT = f"""WITH {EVIDENCE_SQL}
SELECT part, price, source, count(DISTINCT doc_id) AS documents, max(tier_w) AS tier_w, strftime(max(retrieved_at), '%Y-%m-%d') AS newest FROM ev GROUP BY part, price, source"""


def cardinality_violations(spark, d):
    """Parts with more than one price and no valid interval to tell them apart."""
    return C.single_value_violations(price_evidence(spark, d), ["part"], "price")


CARDINALITY = f"WITH {EVIDENCE_SQL} SELECT part, count(DISTINCT price) AS \"values\" FROM ev GROUP BY part HAVING count(DISTINCT price) > 1"


def projection_best_literal(spark, d):
    claims = C.merge_claims(price_evidence(spark, d), ["part", "price"]).withColumn("confidence", F.lit(0.8))
    return C.best_literal(claims, ["part"], "price")


PROJECTION = f"""WITH {EVIDENCE_SQL}, c AS (SELECT part, price, count(DISTINCT source) AS support FROM ev GROUP BY part, price)
SELECT part, arg_min(price, (-support, CAST(price AS VARCHAR))) AS price, count(*) AS candidates FROM c GROUP BY part"""


def _status_evidence(spark, d):
    """Order status claims of a customer, valid for the order's year."""
    o = table(spark, d, "orders")
    at = F.col("o_orderdate").cast("timestamp")
    return o.select(F.col("o_custkey").alias("customer"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("source"),
        F.col("o_orderkey").alias("doc_id"),
                    F.lit(0.5).alias("tier_w"), at.alias("retrieved_at"), at.alias("valid_from"),
                    (at + F.expr("INTERVAL 30 DAYS")).alias("valid_to"),
                    F.round(F.lit(0.5) + F.col("o_orderkey") % 50 / 100, 2).alias("confidence"),
                    F.element_at(F.array(*map(F.lit, ("supported", "contradicted", "not_found", "unchecked"))),
                    (F.col("o_orderkey") % 4 + 1).cast("int")).alias("v"))


def claim_merge_valid_clock(spark, d):
    out = C.merge_claims(_status_evidence(spark, d), ["customer", "status"], "v")
    day = "yyyy-MM-dd"
    return out.select("customer", "status", "support", "documents", F.date_format("valid_from", day).alias("valid_from"),
        F.date_format("valid_to", day).alias("valid_to"), "confidence", "verdict")


STATUS_SQL = """
ev AS (SELECT o_custkey AS customer, o_orderstatus AS status, o_orderpriority AS source, o_orderkey AS doc_id, o_orderdate AS valid_from,
  o_orderdate + INTERVAL 30 DAY AS valid_to, round(0.5 + (o_orderkey % 50) / 100, 2) AS confidence, o_orderkey % 4 AS v FROM orders)"""
MERGE_CLOCK = f"""WITH {STATUS_SQL}
SELECT customer, status, count(DISTINCT source) AS support, count(DISTINCT doc_id) AS documents, strftime(min(valid_from), '%Y-%m-%d') AS valid_from,
  strftime(max(valid_to), '%Y-%m-%d') AS valid_to, max(confidence) AS confidence, ['supported', 'contradicted', 'not_found', 'unchecked'][min(v) + 1] AS verdict
FROM ev GROUP BY customer, status"""


def interval_overlap_contest(spark, d):
    """How many rival statuses overlap each order's validity, of the same customer."""
    ev = _status_evidence(spark, d).select("customer", "status", "doc_id", "valid_from", "valid_to")
    pairs = C.overlapping_rivals(ev, ["customer"], "status", "doc_id")
    return pairs.groupBy("customer", F.col("a").alias("doc_id")).agg(F.count(F.lit(1)).alias("rivals"))


OVERLAP = f"""WITH {STATUS_SQL}
SELECT a.customer, a.doc_id, count(*) AS rivals FROM ev a JOIN ev b ON a.customer = b.customer AND a.status <> b.status
AND NOT (a.valid_to <= b.valid_from OR b.valid_to <= a.valid_from) GROUP BY a.customer, a.doc_id"""


def store_merge_upsert(spark, d):
    """Customer status facts: orders before 1998 are the store, later ones the batch."""
    o = table(spark, d, "orders")
    facts = o.groupBy(F.col("o_custkey").alias("customer"), (F.year("o_orderdate") >= 1998).alias("late")).agg(
        F.max(F.struct("o_orderdate", "o_orderkey", "o_orderstatus")).alias("x")).select("customer", "late",
        F.col("x.o_orderkey").alias("orderkey"), F.col("x.o_orderstatus").alias("status"))
    return C.upsert(facts.where("NOT late").drop("late"), facts.where("late").drop("late"), ["customer"])


UPSERT = """WITH f AS (SELECT o_custkey AS customer, year(o_orderdate) >= 1998 AS late, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS orderkey,
  arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS status FROM orders GROUP BY 1, 2)
SELECT customer, orderkey, status FROM f WHERE late UNION ALL SELECT customer, orderkey, status FROM f WHERE NOT late AND customer NOT IN (SELECT customer FROM f WHERE late)"""


def rebase_three_way(spark, d):
    """Three-way merge of part rows: I changed sizes of even parts, another writer changed prices of parts divisible by 3."""
    read = table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    mine = read.withColumn("p_size", F.when(F.col("p_partkey") % 2 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")))
    now = read.withColumn("p_retailprice",
        F.when(F.col("p_partkey") % 3 == 0, F.col("p_retailprice") + 1).otherwise(F.col("p_retailprice"))).where("p_partkey % 5 != 0")
    out = C.rebase(mine, read, now, ["p_partkey"], ["p_size", "p_retailprice"])
    return out.select("p_partkey", "p_size", F.round("p_retailprice", 2).alias("p_retailprice"))


REBASE = """SELECT p_partkey, CAST(p_size + CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END AS INT) AS p_size,
round(p_retailprice + CASE WHEN p_partkey % 3 = 0 AND p_partkey % 5 <> 0 THEN 1 ELSE 0 END, 2) AS p_retailprice FROM part"""


def partners_antijoin(spark, d):
    """part_of edges of nations and a few stated contains edges give the missing contains edges."""
    n = table(spark, d, "nation")
    part = n.select(F.concat(F.lit("Nation:"), "n_name").alias("s_key"), F.lit("part_of").alias("predicate"),
        F.concat(F.lit("Region:"), F.col("n_regionkey").cast("string")).alias("o_key"))
    stated = n.where("n_nationkey % 4 = 0").select(F.concat(F.lit("Region:"), F.col("n_regionkey").cast("string")).alias("s_key"),
        F.lit("contains").alias("predicate"),
                                                   F.concat(F.lit("Nation:"), "n_name").alias("o_key"))
    inverses = spark.sql("SELECT * FROM VALUES ('part_of', 'contains'), ('contains', 'part_of'), ('borders', 'borders') AS v(predicate, inverse)")
    return C.partners(part.union(stated), inverses)


PARTNERS = """SELECT 'Region:' || n_regionkey AS s_key, 'contains' AS predicate, 'Nation:' || n_name AS o_key, 'inverse' AS rule FROM nation WHERE n_nationkey % 4 <> 0"""


def retract_prices(spark, d):
    """Prices after all orders divisible by 3 are withdrawn."""
    gone = table(spark, d, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("doc_id"))
    return C.retract(price_evidence(spark, d), ["part", "price"], gone)


RETRACT = f"""WITH {EVIDENCE_SQL}, m AS (SELECT *, doc_id IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0) AS gone FROM ev)
SELECT part, price, count(DISTINCT source) FILTER (NOT gone) AS support, bool_or(gone) AS cited, count(DISTINCT source) FILTER (NOT gone) = 0 AS retired FROM m GROUP BY part, price"""


def retract_documents(spark, d):
    """Document text claims (source, text) after the documents of one source are withdrawn; tally of RC."""
    docs = table(spark, d, "documents").select(F.sha2("text", 256).alias("sig"), "source", "doc_id")
    gone = docs.where("source = 'src3'").select("doc_id")
    out = C.retract(docs.withColumn("tier_w", F.lit(0.5)), ["sig"], gone)
    return out.agg(F.count(F.lit(1)).alias("claims"), F.count_if("cited").alias("cited"), F.count_if("retired").alias("retired"),
                   F.sum("support").alias("support_left"))


RETRACT_DOCS = """WITH c AS (SELECT text, count(DISTINCT source) FILTER (source <> 'src3') AS support, bool_or(source = 'src3') AS cited FROM documents GROUP BY text)
SELECT count(*) AS claims, CAST(count_if(cited) AS BIGINT) AS cited, CAST(count_if(support = 0) AS BIGINT) AS retired, CAST(sum(support) AS BIGINT) AS support_left FROM c"""

QUERIES = {
    "price_contest": (price_contest, PRICE_CONTEST),
    "price_score": (price_score, PRICE_SCORE),
    "price_support_list": (price_support_list, PRICE_SUPPORT),
    "cardinality_violations": (cardinality_violations, CARDINALITY),
    "projection_best_literal": (projection_best_literal, PROJECTION),
    "claim_merge_valid_clock": (claim_merge_valid_clock, MERGE_CLOCK),
    "interval_overlap_contest": (interval_overlap_contest, OVERLAP),
    "store_merge_upsert": (store_merge_upsert, UPSERT),
    "rebase_three_way": (rebase_three_way, REBASE),
    "partners_antijoin": (partners_antijoin, PARTNERS),
    "retract_prices": (retract_prices, RETRACT),
    "retract_documents": (retract_documents, RETRACT_DOCS),
}
