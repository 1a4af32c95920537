"""Evaluators: confusion, matching, calibration, resolution and resampling over label tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats as S
from ..shared import cut


def confusion(pairs: DataFrame, gold: str = "gold", predicted: str = "predicted") -> DataFrame:
    """Long form: one row per (gold, predicted) of the union of classes, zeros included."""
    counts = pairs.groupBy(F.col(gold).alias("gold"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    classes = counts.select(F.col("gold").alias("c")).union(counts.select("predicted")).distinct()  # as many as there are classes
    grid = classes.select(F.col("c").alias("gold")).crossJoin(F.broadcast(classes.select(F.col("c").alias("predicted"))))
    return grid.join(counts, ["gold", "predicted"], "left").fillna(0, ["n"])


def per_class(pairs: DataFrame, gold: str = "gold", predicted: str = "predicted") -> DataFrame:
    """Precision, recall, F1 and support of every class."""
    n = confusion(pairs, gold, predicted)
    tp = F.sum(F.when(F.col("c") == F.col("gold"), F.when(F.col("gold") == F.col("predicted"), F.col("n")).otherwise(0)).otherwise(0))
    long = n.select(F.explode(F.array_distinct(F.array("gold", "predicted"))).alias("c"), "gold", "predicted", "n")
    both = long.groupBy("c").agg(tp.alias("tp"),
        F.sum(F.when((F.col("c") == F.col("predicted")) & (F.col("c") != F.col("gold")), F.col("n")).otherwise(0)).alias("fp"),
                                 F.sum(F.when((F.col("c") == F.col("gold")) & (F.col("c") != F.col("predicted")),
                                 F.col("n")).otherwise(0)).alias("fn"))
    p, r, f1 = S.precision_recall_f1(F.col("tp"), F.col("fp"), F.col("fn"))
    return both.select("c", p.alias("precision"), r.alias("recall"), f1.alias("f1"), (F.col("tp") + F.col("fn")).alias("support"))


def agreement(pairs: DataFrame, gold: str = "gold", predicted: str = "predicted") -> DataFrame:
    """One row: n, accuracy and Cohen's kappa (null if chance agreement is certain)."""
    n = pairs.groupBy(F.col(gold).alias("g"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("total"), F.sum(F.when(F.col("g") == F.col("p"), F.col("n")).otherwise(0)).alias("same"))
    left, right = n.groupBy(F.col("g").alias("c")).agg(F.sum("n").alias("a")), n.groupBy(F.col("p").alias("c")).agg(F.sum("n").alias("b"))
    chance = left.join(right, "c").agg(F.sum(F.col("a").cast("double") * F.col("b")).alias("chance"))
    out = total.crossJoin(chance)
    observed, expected = S.ratio(F.col("same"), F.col("total")), F.coalesce("chance",
        F.lit(0.0)) / (F.col("total").cast("double") * F.col("total"))
    return out.select(F.col("total").alias("n"), observed.alias("accuracy"),
        F.when(expected < 1, (observed - expected) / (1 - expected)).alias("kappa"))


def match_three_passes(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """gold, predicted (doc_id, ord, subject, predicate, obj) -> doc_id, predicate, kind, gold_ord, predicted_ord.

    Per document: exact matches first, then same subject and predicate, then same predicate and object. In
    each pass the k-th left over of a key on one side meets the k-th on the other, in file order. What is
    left is missing or spurious. Each pass is an equi-join.
    """
    outs = []
    for kind, key in (("correct", ["doc_id", "predicate", "subject", "obj"]), ("wrong_value", ["doc_id", "predicate", "subject"]),
        ("wrong_entity", ["doc_id", "predicate", "obj"])):
        w = Window.partitionBy(*key).orderBy("ord")
        g, p = gold.withColumn("k", F.row_number().over(w)), predicted.withColumn("k", F.row_number().over(w))
        hit = g.select(*key, "k", F.col("ord").alias("gold_ord")).join(p.select(*key, "k", F.col("ord").alias("predicted_ord")),
            [*key, "k"])
        hit = cut(hit.select("doc_id", "predicate", F.lit(kind).alias("kind"), "gold_ord", "predicted_ord"))
        outs.append(hit)
        # what is left over is read by every later pass: planned once
        gold = cut(gold.join(hit.select("doc_id", F.col("gold_ord").alias("ord")), ["doc_id", "ord"], "left_anti"))
        predicted = cut(predicted.join(hit.select("doc_id", F.col("predicted_ord").alias("ord")), ["doc_id", "ord"], "left_anti"))
    none = F.lit(None).cast("long")
    outs.append(gold.select("doc_id", "predicate", F.lit("missing").alias("kind"), F.col("ord").alias("gold_ord"),
        none.alias("predicted_ord")))
    outs.append(predicted.select("doc_id", "predicate", F.lit("spurious").alias("kind"), none.alias("gold_ord"),
        F.col("ord").alias("predicted_ord")))
    out = outs[0]
    for o in outs[1:]:
        out = out.unionByName(o)
    return out


def outcome_report(outcomes: DataFrame, by: str) -> DataFrame:
    """Counts of each kind and precision, recall and F1, by predicate and in all (null); a wrong one is a false
    positive and a false negative."""
    kinds = ("correct", "wrong_value", "wrong_entity", "missing", "spurious")
    n = outcomes.rollup(by).agg(*[F.count_if(F.col("kind") == k).alias(k) for k in kinds])
    wrong = F.col("wrong_value") + F.col("wrong_entity")
    p, r, f1 = S.precision_recall_f1(F.col("correct"), wrong + F.col("spurious"), wrong + F.col("missing"))
    return n.select(by, *kinds, p.alias("precision"), r.alias("recall"), f1.alias("f1"))


def reliability(scored: DataFrame, confidence: str, outcome: str) -> DataFrame:
    """Per tenth of confidence: n, mean confidence, share true and their gap."""
    b = scored.groupBy(S.confidence_bin(F.col(confidence)).alias("bin")).agg(F.count(F.lit(1)).alias("n"),
        F.avg(confidence).alias("mean_confidence"),
                                                                            F.avg(F.col(outcome).cast("double")).alias("fraction_true"))
    return b.withColumn("gap", F.abs(F.col("mean_confidence") - F.col("fraction_true")))


def calibration(scored: DataFrame, confidence: str, outcome: str, threshold: float = 0.9) -> DataFrame:
    """One row: n, brier, its baseline, ece, the largest gap, and the share true at the threshold."""
    y = F.col(outcome).cast("double")
    c = F.col(confidence)
    whole = scored.agg(F.count(F.lit(1)).alias("n"), F.avg((c - y) * (c - y)).alias("brier"), F.avg(y).alias("base"),
        F.count_if(c >= threshold).alias("high"),
                       F.avg(F.when(c >= threshold, y)).alias("true_rate_at_threshold"))
    bins = reliability(scored, confidence, outcome).agg(F.sum(F.col("n") * F.col("gap")).alias("weighted"), F.max("gap").alias("max_gap"))
    return whole.crossJoin(bins).select("n", "brier", (F.col("base") * (1 - F.col("base"))).alias("brier_baseline"),
        S.ratio(F.col("weighted"), F.col("n")).alias("ece"),
                                        "max_gap", F.col("high").alias("scored_at_threshold"), "true_rate_at_threshold")


def b_cubed(items: DataFrame, gold: str, found: str) -> DataFrame:
    """items (one row each) -> precision, recall and F1, averaged over items: three group-bys, no pairs."""
    cell = items.groupBy(gold, found).agg(F.count(F.lit(1)).alias("n"))
    a, b = items.groupBy(gold).agg(F.count(F.lit(1)).alias("ng")), items.groupBy(found).agg(F.count(F.lit(1)).alias("nf"))
    both = cell.join(a, gold).join(b, found).agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.col("n") / F.col("nf")).alias("p"),
        F.sum(F.col("n") * F.col("n") / F.col("ng")).alias("r"))
    p, r = F.col("p") / F.col("total"), F.col("r") / F.col("total")
    return both.select(p.alias("precision"), r.alias("recall"), (2 * p * r / (p + r)).alias("f1"))


def pairwise(items: DataFrame, gold: str, found: str) -> DataFrame:
    """Pairwise precision, recall and F1 of a clustering, from cell sizes."""
    def pairs(df: DataFrame, key: list[str], name: str) -> DataFrame:
        n = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
        return n.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias(name))

    out = pairs(items, [gold, found], "tp").crossJoin(pairs(items, [found], "pred")).crossJoin(pairs(items, [gold], "gold"))
    p, r, f1 = S.precision_recall_f1(F.col("tp"), F.col("pred") - F.col("tp"), F.col("gold") - F.col("tp"))
    return out.select(p.alias("precision"), r.alias("recall"), f1.alias("f1"))


def _drawn(spark, items: DataFrame, resamples: int, seed: int) -> DataFrame:
    """items by resample, with the weight w of each item in it."""
    draws = spark.range(resamples).withColumnRenamed("id", "resample")
    u = (F.pmod(F.xxhash64(F.lit(seed), "resample", "i"), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    cdf, p, total = [], 0.36787944117144233, 0.0
    for k in range(12):
        total += p
        cdf.append(total)
        p /= k + 1
    w = F.lit(0)
    for c in cdf:
        w = w + F.when(u > c, 1).otherwise(0)
    return items.crossJoin(F.broadcast(draws)).withColumn("w", w)


def bootstrap(spark, items: DataFrame, statistic, resamples: int = 2000, seed: int = 0, level: float = 0.95) -> DataFrame:
    """Percentile interval of a statistic of items (i from 0 to n - 1, columns): low, high, draws.

    Each draw gives item i a weight: the number of times that hash draws hit it. Weights come from a
    Poisson(1) draw of (seed, resample, i), so no draw table is gathered; a statistic is an aggregate
    expression over the column w. Undefined draws are left out.
    """
    got = _drawn(spark, items, resamples, seed).groupBy("resample").agg(statistic.alias("x")).where("x IS NOT NULL")
    tail = (1 - level) / 2
    return got.agg(F.percentile("x", F.lit(tail)).alias("low"), F.percentile("x", F.lit(1 - tail)).alias("high"),
        F.count(F.lit(1)).alias("draws"))


def share(run: str):
    """Weighted share of the items that pass."""
    return F.try_divide(F.sum(F.col(run) * F.col("w")).cast("double"), F.sum("w"))


def paired_bootstrap(spark, items: DataFrame, metric=share, resamples: int = 2000, seed: int = 0, alpha: float = 0.05,
    power: float = 0.8) -> DataFrame:
    """items (i, a, b: the outcome of one item under each run) -> one row: both values, their difference b - a with its
    percentile interval, flips, the detection limit and a verdict (better, worse, inconclusive).

    Both runs meet the same draws. metric gives the aggregate of a run's column ("a" or "b") over the weights w; a
    and b may be structs of counts. For shares of passes the exact McNemar p must be below alpha too. No verdict if
    a run's value is undefined or fewer than two draws are.
    """
    passes = F.col("a").isin(0, 1) & F.col("b").isin(0, 1) if metric is share else F.lit(False)
    a, b = F.col("a"), F.col("b")
    gained, lost = (F.count_if((b > a) & passes), F.count_if((a > b) & passes))
    whole = items.withColumn("w", F.lit(1)).agg(F.count(F.lit(1)).alias("items"), metric("a").alias("a_value"),
        metric("b").alias("b_value"), F.count_if(a != b).alias("flips"),
                                                F.bool_and(passes).alias("pass_fail"), gained.alias("gained"), lost.alias("lost"))
    drawn = _drawn(spark, items, resamples, seed).groupBy("resample").agg(metric("a").alias("x"),
        metric("b").alias("y")).where("x IS NOT NULL AND y IS NOT NULL").withColumn("d", F.col("y") - F.col("x"))
    ends = [F.percentile(c, F.lit(q)).alias(f"{name}{end}") for c, name in (("d", ""), ("x", "a_"), ("y", "b_")) for end,
        q in (("low", alpha / 2), ("high", 1 - alpha / 2))]
    out = whole.crossJoin(drawn.agg(*ends, F.stddev_samp("d").alias("spread"), F.count(F.lit(1)).alias("draws")))
    z = S.NormalDist().inv_cdf(1 - alpha / 2) + S.NormalDist().inv_cdf(power)
    limit = F.when(F.col("flips") > 0,
        F.when(F.col("pass_fail"), z * F.sqrt(F.col("flips")) / F.col("items")).otherwise(z * F.col("spread")))
    p = F.when(F.col("pass_fail"), S.mcnemar(F.col("gained"), F.col("lost")))
    verdict = F.when(F.col("a_value").isNull() | F.col("b_value").isNull() | (F.col("draws") < 2), None).when(p >= alpha,
        "inconclusive").when(
        F.col("high") < 0, "worse").when(F.col("low") > 0, "better").otherwise("inconclusive")
    return out.select("items", F.col("a_value").alias("a"), F.col("b_value").alias("b"),
        (F.col("b_value") - F.col("a_value")).alias("difference"), "low", "high", "a_low", "a_high", "b_low", "b_high",
                      "flips", limit.alias("detection_limit"), p.alias("p_value"), verdict.alias("verdict"), "draws")
