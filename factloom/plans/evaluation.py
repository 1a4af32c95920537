"""Evaluation queries over labels, orders and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..eval import metrics as M
from ..functions import stats as S
from ..sources.tables import table


def _labels(spark, d):
    return table(spark, d, "labels")


def _scored(spark, d):
    """A confidence for each labelled document, from its id and quality."""
    return _labels(spark, d).select("doc_id", "quality", "toxic",
        ((F.col("doc_id") * 37 % 101) / 200.0 + F.col("quality") * 0.495).alias("c"))


SCORED = "s AS (SELECT doc_id, quality, toxic, (doc_id * 37 % 101) / 200.0::DOUBLE + quality * 0.495::DOUBLE AS c FROM labels)"


def _r(c, k=6):
    return F.round(c, k)


def confusion_quality_toxic(spark, d):
    pairs = _labels(spark, d).select(F.col("quality").alias("gold"), (1 - F.col("toxic")).alias("predicted"))
    return M.confusion(pairs)


CONFUSION = """WITH p AS (SELECT quality AS gold, 1 - toxic AS predicted FROM labels), c AS (SELECT gold AS c FROM p UNION SELECT predicted FROM p)
SELECT a.c AS gold, b.c AS predicted, count(p.gold) AS n FROM c a CROSS JOIN c b LEFT JOIN p ON p.gold = a.c AND p.predicted = b.c GROUP BY 1, 2"""


def per_class_quality(spark, d):
    pairs = _labels(spark, d).select(F.col("quality").alias("gold"), (1 - F.col("toxic")).alias("predicted"))
    return M.per_class(pairs).select("c", *[_r(F.col(x)).alias(x) for x in ("precision", "recall", "f1")], "support")


PER_CLASS = """WITH p AS (SELECT quality AS g, 1 - toxic AS p FROM labels), c AS (SELECT g AS c FROM p UNION SELECT p FROM p),
n AS (SELECT c, count(*) FILTER (g = c AND p = c) AS tp, count(*) FILTER (g <> c AND p = c) AS fp, count(*) FILTER (g = c AND p <> c) AS fn FROM c, p GROUP BY c)
SELECT c, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall,
round(CASE WHEN tp + fp + fn = 0 THEN NULL WHEN tp = 0 THEN 0.0 ELSE 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) END, 6) AS f1, tp + fn AS support FROM n"""


def kappa_quality_toxic(spark, d):
    pairs = _labels(spark, d).select(F.col("quality").alias("gold"), (1 - F.col("toxic")).alias("predicted"))
    return M.agreement(pairs).select("n", _r(F.col("accuracy")).alias("accuracy"), _r(F.col("kappa")).alias("kappa"))


KAPPA = """WITH p AS (SELECT quality AS g, 1 - toxic AS p FROM labels), t AS (SELECT count(*) AS n, count_if(g = p) / count(*) AS o FROM p),
e AS (SELECT sum(a.k * b.k) / (SELECT n * n FROM t) AS e FROM (SELECT g AS c, count(*) AS k FROM p GROUP BY g) a JOIN (SELECT p AS c, count(*) AS k FROM p GROUP BY p) b USING (c))
SELECT n, round(o, 6) AS accuracy, round((o - e) / (1 - e), 6) AS kappa FROM t, e"""


def routing_report(spark, d):
    """Routing by length against quality: skipped facts and wasted extractions, by language."""
    docs = table(spark, d, "documents").join(_labels(spark, d), "doc_id")
    action, label = F.when(F.length("text") < 800, "skip").otherwise("extract"), F.when(F.col("quality") == 1, "extract").otherwise("skip")
    x = docs.select("lang", action.alias("a"), label.alias("l"))
    return x.rollup("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("a") == F.col("l")).alias("right"),
                                F.count_if((F.col("a") == "skip") & (F.col("l") == "extract")).alias("facts_skipped"),
                                F.count_if((F.col("a") == "extract") & (F.col("l") == "skip")).alias("wasted"))


ROUTING = """WITH x AS (SELECT lang, CASE WHEN length(text) < 800 THEN 'skip' ELSE 'extract' END AS a, CASE WHEN quality = 1 THEN 'extract' ELSE 'skip' END AS l FROM documents JOIN labels USING (doc_id))
SELECT lang, count(*) AS n, CAST(count_if(a = l) AS BIGINT) AS "right", CAST(count_if(a = 'skip' AND l = 'extract') AS BIGINT) AS facts_skipped, CAST(count_if(a = 'extract' AND l = 'skip') AS BIGINT) AS wasted FROM x GROUP BY ROLLUP (lang)"""


def calibration_curve(spark, d):
    b = M.reliability(_scored(spark, d), "c", "quality")
    return b.select("bin", "n", *[_r(F.col(x)).alias(x) for x in ("mean_confidence", "fraction_true", "gap")])


CURVE = f"""WITH {SCORED}, b AS (SELECT CAST(least(floor(c * 10 + 1e-9), 9) AS INT) AS bin, count(*) AS n, avg(c) AS m, avg(quality) AS f FROM s GROUP BY 1)
SELECT bin, n, round(m, 6) AS mean_confidence, round(f, 6) AS fraction_true, round(abs(m - f), 6) AS gap FROM b"""


def brier_ece(spark, d):
    out = M.calibration(_scored(spark, d), "c", "quality")
    return out.select("n", *[_r(F.col(x)).alias(x) for x in ("brier", "brier_baseline", "ece", "max_gap", "true_rate_at_threshold")],
        "scored_at_threshold")


BRIER = f"""WITH {SCORED}, b AS (SELECT count(*) AS k, abs(avg(c) - avg(quality)) AS gap FROM s GROUP BY least(floor(c * 10 + 1e-9), 9))
SELECT count(*) AS n, round(avg((c - quality) * (c - quality)), 6) AS brier, round(avg(quality) * (1 - avg(quality)), 6) AS brier_baseline,
(SELECT round(sum(k * gap) / sum(k), 6) FROM b) AS ece, (SELECT round(max(gap), 6) FROM b) AS max_gap, round(avg(CASE WHEN c >= 0.9 THEN quality END), 6) AS true_rate_at_threshold,
CAST(count_if(c >= 0.9) AS BIGINT) AS scored_at_threshold FROM s"""


def wilson_by_source(spark, d):
    x = table(spark, d, "documents").join(_labels(spark, d), "doc_id").groupBy("source").agg(F.sum("quality").alias("good"),
        F.count(F.lit(1)).alias("n"))
    low, high = S.wilson(F.col("good"), F.col("n"))
    return x.select("source", "good", "n", _r(low).alias("low"), _r(high).alias("high"))


WILSON = f"""WITH x AS (SELECT source, CAST(sum(quality) AS BIGINT) AS good, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY source),
z AS (SELECT *, {S.Z95}::DOUBLE AS z, good / n AS p FROM x)
SELECT source, good, n, round(CASE WHEN good = 0 THEN 0 ELSE greatest(0, (p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n))) / (1 + z * z / n)) END, 6) AS low,
round(CASE WHEN good = n THEN 1 ELSE least(1, (p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n))) / (1 + z * z / n)) END, 6) AS high FROM z"""


def ppi_precision(spark, d):
    """The judge (no toxic mark) on all labelled rows; people labelled those with an id divisible by 4."""
    f, y, small = F.col("toxic") == 0, F.col("quality") == 1, F.col("doc_id") % 4 == 0
    n = _labels(spark, d).agg(F.count(F.lit(1)).alias("judged"), F.count_if(f).alias("jt"), F.count_if(small).alias("n"),
        F.count_if(small & y).alias("lt"),
                              F.count_if(small & f).alias("jl"), F.count_if(small & (f != y)).alias("dis"))
    value, low, high = S.prediction_powered(*map(F.col, ("judged", "jt", "n", "lt", "jl", "dis")))
    return n.select("judged", "n", _r(value).alias("precision"), _r(low).alias("low"), _r(high).alias("high"))


PPI = f"""WITH x AS (SELECT count(*) AS big, count_if(toxic = 0) AS jt, count_if(doc_id % 4 = 0) AS n, count_if(doc_id % 4 = 0 AND quality = 1) AS lt,
 count_if(doc_id % 4 = 0 AND toxic = 0) AS jl, count_if(doc_id % 4 = 0 AND (toxic = 0) <> (quality = 1)) AS dis FROM labels),
v AS (SELECT *, jt / big + (lt - jl) / n AS v, (lt + 2) / (n + 4) AS s FROM x),
h AS (SELECT *, {S.Z95} * sqrt(s * (1 - s) / big + (dis + 2) / (n + 4) * (1 / n - 1 / big)) AS h FROM v)
SELECT CAST(big AS BIGINT) AS judged, CAST(n AS BIGINT) AS n, round(least(1, greatest(0, v)), 6) AS precision, round(least(1, greatest(0, v - h)), 6) AS low, round(least(1, greatest(0, v + h)), 6) AS high FROM h"""


def mcnemar_flips(spark, d):
    """The exact sign test over all labels; the SQL sums the binomial tail in logarithms too."""
    a, b = F.col("quality") == 1, F.col("toxic") == 0
    x = _labels(spark, d).agg(F.count(F.lit(1)).alias("items"), F.count_if(~a & b).alias("gained"), F.count_if(a & ~b).alias("lost"))
    return x.select("items", "gained", "lost", _r(S.mcnemar(F.col("gained"), F.col("lost"))).alias("p_value"))


MCNEMAR = """WITH x AS (SELECT count(*) AS items, CAST(count_if(quality = 0 AND toxic = 0) AS BIGINT) AS g, CAST(count_if(quality = 1 AND toxic = 1) AS BIGINT) AS l FROM labels),
k AS (SELECT items, g, l, unnest(range(0, least(g, l) + 1)) AS k FROM x),
t AS (SELECT items, g, l, sum(exp(lgamma(g + l + 1) - lgamma(k + 1) - lgamma(g + l - k + 1) + (g + l) * ln(0.5))) AS tail FROM k GROUP BY items, g, l)
SELECT items, g AS gained, l AS lost, round(least(1, 2 * tail), 6) AS p_value FROM t"""


def detection_limits(spark, d):
    x = table(spark, d, "documents").join(_labels(spark, d), "doc_id").groupBy("lang").agg(F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("quality") == F.col("toxic")).alias("flips"))
    return x.select("lang", "n", "flips", _r(S.detection_limit(F.col("flips"), F.col("n") * F.col("n"))).alias("limit"))


LIMITS = f"""SELECT lang, count(*) AS n, CAST(count_if(quality = toxic) AS BIGINT) AS flips, round({S.Z95} * sqrt(count_if(quality = toxic) / (count(*) * count(*))), 6) AS "limit" FROM documents JOIN labels USING (doc_id) GROUP BY lang"""


def bootstrap_f1(spark, d):
    """Interval of F1 of the toxic mark against quality 0."""
    items = _labels(spark, d).select(F.col("doc_id").alias("i"), F.col("quality"), F.col("toxic"))
    tp, pr, gd = (F.sum(F.when(c, F.col("w")).otherwise(0)) for c in ((F.col("quality") == 1) & (F.col("toxic") == 0), F.col("toxic") == 0,
        F.col("quality") == 1))
    return M.bootstrap(spark, items, F.try_divide(2.0 * tp, pr + gd))


def paired_runs(spark, d):
    """Run b (no toxic mark) against run a (quality) on the same labelled documents."""
    return M.paired_bootstrap(spark,
        _labels(spark, d).select(F.col("doc_id").alias("i"), F.col("quality").alias("a"), (1 - F.col("toxic")).alias("b")))


def _gold(spark, d):
    o = table(spark, d, "orders").select((F.col("o_custkey") % 300).alias("doc_id"), F.col("o_orderkey").alias("ord"),
        (F.col("o_orderkey") % 7).alias("subject"),
                                         F.col("o_orderstatus").alias("predicate"), F.col("o_orderpriority").alias("obj"))
    pred = table(spark, d, "orders").where("o_orderkey % 11 != 0").select((F.col("o_custkey") % 300).alias("doc_id"),
        (F.col("o_orderkey") + 1000000).alias("ord"),
                                                                          ((F.col("o_orderkey") + F.when(F.col("o_orderkey") % 13 == 0,
                                                                          1).otherwise(0)) % 7).alias("subject"),
                                                                          F.col("o_orderstatus").alias("predicate"),
                                                                          F.when(F.col("o_orderkey") % 5 == 0,
                                                                          "other").otherwise(F.col("o_orderpriority")).alias("obj"))
    return o, pred


def gold_match_three_pass(spark, d):
    return M.match_three_passes(*_gold(spark, d)).groupBy("doc_id", "predicate", "kind").agg(F.count(F.lit(1)).alias("n"))


MATCH_SQL = """
g0 AS (SELECT o_custkey % 300 AS doc, o_orderkey AS ord, o_orderkey % 7 AS s, o_orderstatus AS p, o_orderpriority AS o FROM orders),
p0 AS (SELECT o_custkey % 300 AS doc, o_orderkey + 1000000 AS ord, (o_orderkey + CASE WHEN o_orderkey % 13 = 0 THEN 1 ELSE 0 END) % 7 AS s, o_orderstatus AS p,
 CASE WHEN o_orderkey % 5 = 0 THEN 'other' ELSE o_orderpriority END AS o FROM orders WHERE o_orderkey % 11 <> 0),
h1 AS (SELECT g.doc, g.p, 'correct' AS kind, g.ord AS go, p.ord AS po FROM (SELECT *, row_number() OVER (PARTITION BY doc, p, s, o ORDER BY ord) AS k FROM g0) g
 JOIN (SELECT *, row_number() OVER (PARTITION BY doc, p, s, o ORDER BY ord) AS k FROM p0) p USING (doc, p, s, o, k)),
g1 AS (SELECT * FROM g0 WHERE ord NOT IN (SELECT go FROM h1)), p1 AS (SELECT * FROM p0 WHERE ord NOT IN (SELECT po FROM h1)),
h2 AS (SELECT g.doc, g.p, 'wrong_value' AS kind, g.ord AS go, p.ord AS po FROM (SELECT *, row_number() OVER (PARTITION BY doc, p, s ORDER BY ord) AS k FROM g1) g
 JOIN (SELECT *, row_number() OVER (PARTITION BY doc, p, s ORDER BY ord) AS k FROM p1) p USING (doc, p, s, k)),
g2 AS (SELECT * FROM g1 WHERE ord NOT IN (SELECT go FROM h2)), p2 AS (SELECT * FROM p1 WHERE ord NOT IN (SELECT po FROM h2)),
h3 AS (SELECT g.doc, g.p, 'wrong_entity' AS kind, g.ord AS go, p.ord AS po FROM (SELECT *, row_number() OVER (PARTITION BY doc, p, o ORDER BY ord) AS k FROM g2) g
 JOIN (SELECT *, row_number() OVER (PARTITION BY doc, p, o ORDER BY ord) AS k FROM p2) p USING (doc, p, o, k)),
oc AS (SELECT doc, p, kind FROM h1 UNION ALL SELECT doc, p, kind FROM h2 UNION ALL SELECT doc, p, kind FROM h3
 UNION ALL SELECT doc, p, 'missing' FROM g2 WHERE ord NOT IN (SELECT go FROM h3) UNION ALL SELECT doc, p, 'spurious' FROM p2 WHERE ord NOT IN (SELECT po FROM h3))"""
MATCH = f"WITH {MATCH_SQL} SELECT doc AS doc_id, p AS predicate, kind, count(*) AS n FROM oc GROUP BY ALL"


def prf_rollup(spark, d):
    out = M.outcome_report(M.match_three_passes(*_gold(spark, d)), "predicate")
    return out.select("predicate", "correct", "wrong_value", "wrong_entity", "missing", "spurious",
        *[_r(F.col(x)).alias(x) for x in ("precision", "recall", "f1")])


PRF = f"""WITH {MATCH_SQL}, n AS (SELECT p AS predicate, count_if(kind = 'correct') AS c, count_if(kind = 'wrong_value') AS v, count_if(kind = 'wrong_entity') AS e, count_if(kind = 'missing') AS m, count_if(kind = 'spurious') AS s
 FROM oc GROUP BY ROLLUP (p)), r AS (SELECT *, c / (c + v + e + s) AS pr, c / (c + v + e + m) AS re FROM n)
SELECT predicate, CAST(c AS BIGINT) AS correct, CAST(v AS BIGINT) AS wrong_value, CAST(e AS BIGINT) AS wrong_entity, CAST(m AS BIGINT) AS missing, CAST(s AS BIGINT) AS spurious,
round(pr, 6) AS precision, round(re, 6) AS recall, round(2 * pr * re / (pr + re), 6) AS f1 FROM r"""


def bcubed_vs_label(spark, d):
    items = table(spark, d, "embeddings").select("vec_id", "label",
        F.when(F.element_at("embedding", 1) > 0, F.col("label")).otherwise(F.col("label") % 3).alias("found"))
    return M.b_cubed(items, "label", "found").select(*[_r(F.col(x)).alias(x) for x in ("precision", "recall", "f1")])


ITEMS = "i AS (SELECT vec_id, label, CASE WHEN embedding[1] > 0 THEN label ELSE label % 3 END AS found FROM embeddings)"
BCUBED = f"""WITH {ITEMS}, x AS (SELECT count(*) OVER (PARTITION BY label, found) AS n, count(*) OVER (PARTITION BY found) AS nf, count(*) OVER (PARTITION BY label) AS ng FROM i),
y AS (SELECT avg(n / nf) AS p, avg(n / ng) AS r FROM x) SELECT round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1 FROM y"""


def pairwise_clusters(spark, d):
    items = table(spark, d, "embeddings").select("vec_id", "label",
        F.when(F.element_at("embedding", 1) > 0, F.col("label")).otherwise(F.col("label") % 3).alias("found"))
    return M.pairwise(items, "label", "found").select(*[_r(F.col(x)).alias(x) for x in ("precision", "recall", "f1")])


PAIRWISE = f"""WITH {ITEMS}, t AS (SELECT count_if(a.label = b.label AND a.found = b.found) AS tp, count_if(a.found = b.found) AS pred, count_if(a.label = b.label) AS gold FROM i a JOIN i b ON a.vec_id < b.vec_id)
SELECT round(tp / pred, 6) AS precision, round(tp / gold, 6) AS recall, round(2 * (tp / pred) * (tp / gold) / (tp / pred + tp / gold), 6) AS f1 FROM t"""


def cost_per_stage(spark, d):
    """Event types as stages, value as cost: null if any call has none; per thousand users."""
    e = table(spark, d, "events")
    cost = F.when(F.col("event_id") % 997 == 0, None).otherwise(F.floor(F.col("value") * 100) / 100)
    g = e.withColumn("cost", cost).groupBy(F.col("event_type").alias("stage")).agg(F.count(F.lit(1)).alias("calls"),
        F.count_if(F.col("cost").isNull()).alias("unpriced"), F.sum("cost").alias("usd"),
                                                                                   F.count_distinct("user_id").alias("users"))
    usd = F.when(F.col("unpriced") == 0, F.col("usd"))
    return g.select("stage", "calls", "unpriced", F.round(usd, 2).alias("usd"),
        F.round(usd / F.col("users") * 1000, 2).alias("usd_per_1000"))


COST = """WITH c AS (SELECT event_type AS stage, user_id, CASE WHEN event_id % 997 = 0 THEN NULL ELSE floor(value * 100) / 100 END AS cost FROM events),
g AS (SELECT stage, count(*) AS calls, CAST(count_if(cost IS NULL) AS BIGINT) AS unpriced, sum(cost) AS usd, count(DISTINCT user_id) AS users FROM c GROUP BY stage)
SELECT stage, calls, unpriced, round(CASE WHEN unpriced = 0 THEN usd END, 2) AS usd, round(CASE WHEN unpriced = 0 THEN usd END / users * 1000, 2) AS usd_per_1000 FROM g"""


def output_saturation(spark, d):
    """Slope of log lines on log characters, by language."""
    x = table(spark, d, "documents").where("length(text) > 0").select("lang", F.ln(F.size(F.split("text", "\n"))).alias("y"),
        F.ln(F.length("text")).alias("x"))
    return x.groupBy("lang").agg(F.round(F.regr_slope("y", "x"), 6).alias("slope"), F.count(F.lit(1)).alias("n"))


SATURATION = "SELECT lang, round(regr_slope(ln(len(string_split(text, chr(10)))), ln(length(text))), 6) AS slope, count(*) AS n FROM documents WHERE length(text) > 0 GROUP BY lang"


def stratified_refusals(spark, d):
    """Size-weighted share of good rows over languages, from the labelled ones, with the effective n."""
    docs = table(spark, d, "documents").join(_labels(spark, d), "doc_id", "left")
    s = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("size"), F.count("quality").alias("n"), F.sum("quality").alias("good"))
    t = s.crossJoin(F.broadcast(s.agg(F.sum("size").alias("total")))).withColumn("w", F.col("size") / F.col("total")).withColumn("p",
        F.col("good") / F.col("n"))
    x = t.agg(F.sum(F.col("w") * F.col("p")).alias("share"),
        F.sum(F.col("w") * F.col("w") * F.col("p") * (1 - F.col("p")) / F.col("n")).alias("var"), F.sum("n").alias("n"))
    return x.select("n", _r(F.col("share")).alias("share"),
        _r(F.col("share") * (1 - F.col("share")) / F.col("var"), 3).alias("effective_n"))


REFUSALS = """WITH s AS (SELECT lang, count(*) AS size, count(quality) AS n, sum(quality) AS good FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang),
t AS (SELECT *, size / (SELECT sum(size) FROM s) AS w, good / n AS p FROM s), x AS (SELECT sum(w * p) AS sh, sum(w * w * p * (1 - p) / n) AS v, sum(n) AS n FROM t)
SELECT CAST(n AS BIGINT) AS n, round(sh, 6) AS share, round(sh * (1 - sh) / v, 3) AS effective_n FROM x"""

QUERIES = {
    "confusion_quality_toxic": (confusion_quality_toxic, CONFUSION), "per_class_quality": (per_class_quality, PER_CLASS),
    "kappa_quality_toxic": (kappa_quality_toxic, KAPPA),
    "routing_report": (routing_report, ROUTING), "calibration_curve": (calibration_curve, CURVE), "brier_ece": (brier_ece, BRIER),
    "wilson_by_source": (wilson_by_source, WILSON),
    "ppi_precision": (ppi_precision, PPI), "mcnemar_flips": (mcnemar_flips, MCNEMAR), "detection_limits": (detection_limits, LIMITS),
    "bootstrap_f1": (bootstrap_f1, None),
    "paired_runs": (paired_runs, None),
    "gold_match_three_pass": (gold_match_three_pass, MATCH), "prf_rollup": (prf_rollup, PRF), "bcubed_vs_label": (bcubed_vs_label, BCUBED),
    "pairwise_clusters": (pairwise_clusters, PAIRWISE),
    "cost_per_stage": (cost_per_stage, COST), "output_saturation": (output_saturation, SATURATION),
    "stratified_refusals": (stratified_refusals, REFUSALS),
}
