"""Reports over scored runs: corroboration effect, ablation, adjudication, lenient score, fixes and their track record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats as S


def _bucket(n: Column) -> Column:
    return F.when(n >= 3, "3+").otherwise(n.cast("string"))


def corroboration_effect(claims: DataFrame, gold: DataFrame) -> DataFrame:
    """claims (edge, support), gold (edge, sources, factual) -> config, bucket, edges, factual, in_gold, gold, found, precision, recall.

    gold lists the edges known to be facts; those with sources are the set's own. off has every claim, on the merged
    ones, on_two_or_more those with two sources; a bucket is a number of sources (of the claim for precision, of the gold fact for recall), or
    null for all. One pass: each claim goes to the configurations that hold it.
    """
    x = claims.groupBy("edge").agg(F.max("support").alias("support")).join(gold, "edge", "left")
    configs = F.array(F.lit("off"), F.lit("on"), F.when(F.col("support") >= 2, F.lit("on_two_or_more")))
    each = x.select("edge", "support", "sources", "factual", F.explode(F.array_compact(configs)).alias("config"))
    right, found = F.coalesce(F.col("factual"), F.lit(False)), F.col("sources").isNotNull()
    made = each.groupBy("config").agg(F.count(F.lit(1)).alias("edges"), F.count_if(right).alias("factual"),
        F.count_if(found).alias("in_gold"))
    by = each.where("sources IS NOT NULL").groupBy("config",
        _bucket(F.col("sources")).alias("bucket")).agg(F.count(F.lit(1)).alias("found"))
    owned = gold.where("sources IS NOT NULL").groupBy(_bucket(F.col("sources")).alias("bucket")).agg(F.count(F.lit(1)).alias("gold"))
    rows = made.crossJoin(F.broadcast(owned)).join(by, ["config", "bucket"], "left").withColumn("found",
        F.coalesce("found", F.lit(0)))  # at most three buckets
    return rows.select("config", "bucket", "edges", "factual", "in_gold", "gold", "found",
        S.ratio(F.col("factual"), F.col("edges")).alias("precision"), S.ratio(F.col("found"), F.col("gold")).alias("recall"))


def ablation(facts: DataFrame, gold_size: int) -> DataFrame:
    """facts (correct, verdict, outcome) of one extraction and one grounding -> config, kept, correct, precision, recall:
    everything extracted, what grounding left, what corroboration left of that. One scan: a fact counts in each
    configuration that keeps it."""
    grounded = F.col("verdict").isin("supported", "unchecked")
    stands = grounded & (F.coalesce("outcome", F.lit("")) != "lost")
    configs = F.array_compact(F.array(F.lit("extraction"), F.when(grounded, F.lit("+ grounding")),
        F.when(stands, F.lit("+ corroboration"))))
    each = facts.select("correct", F.explode(configs).alias("config"))
    out = each.groupBy("config").agg(F.count(F.lit(1)).alias("kept"), F.count_if("correct").alias("correct"))
    return out.withColumn("precision", S.ratio(F.col("correct"), F.col("kept"))).withColumn("recall",
        S.ratio(F.col("correct"), F.lit(gold_size)))


def adjudicated_precision(facts: DataFrame, votes: DataFrame, needed: int = 2) -> DataFrame:
    """facts (fact, correct), votes (fact, run, verdict) -> facts, strict, adjudicated (precision): a fact that the gold lacks
    counts as a hit if `needed` runs of the judge or more find it supported."""
    said = votes.groupBy("fact").agg(F.count_if(F.col("verdict") == "supported").alias("for"))
    x = facts.join(said, "fact", "left")
    hit = F.col("correct") | (F.coalesce("for", F.lit(0)) >= needed)
    out = x.agg(F.count(F.lit(1)).alias("facts"), F.count_if("correct").alias("strict"), F.count_if(hit).alias("hits"))
    return out.select("facts", S.ratio(F.col("strict"), F.col("facts")).alias("strict"),
        S.ratio(F.col("hits"), F.col("facts")).alias("adjudicated"))


def lenient_score(outcomes: DataFrame, decisions: DataFrame) -> DataFrame:
    """outcomes (gold_ord, predicted_ord, kind, doc_id), decisions (doc_id, gold_ord, predicted_ord, same) of pairs that were
    missing and spurious -> strict and lenient precision and recall. A pair judged the same counts once: the
    smallest predicted fact of each gold one, then the smallest gold fact of each predicted one."""
    taken = decisions.where("same").groupBy("doc_id", "gold_ord").agg(F.min("predicted_ord").alias("predicted_ord"))
    taken = taken.groupBy("doc_id", "predicted_ord").agg(F.min("gold_ord").alias("gold_ord"))
    more = taken.agg(F.count(F.lit(1)).alias("pairs"))
    n = outcomes.agg(F.count_if(F.col("kind") == "correct").alias("hits"), F.count("gold_ord").alias("gold"),
        F.count("predicted_ord").alias("predicted")).crossJoin(more)
    both = F.col("hits") + F.col("pairs")
    return n.select("hits", "pairs", S.ratio(F.col("hits"), F.col("predicted")).alias("precision"),
        S.ratio(F.col("hits"), F.col("gold")).alias("recall"),
                    S.ratio(both, F.col("predicted")).alias("lenient_precision"), S.ratio(both, F.col("gold")).alias("lenient_recall"))


# What can be done about each cause of a miss, and which rate prices it.
REMEDIES = [
    ("offer-relations", ["never_offered"], "offered"),
    ("audit-refusals", ["refused"], "exact"),
    ("relation-descriptions", ["wrong_relation"], "overall"),
    ("inverses", ["inverse"], "exact"),
    ("normalise-names", ["surface_form"], "judge"),
    ("check-details", ["scored_apart"], "overall"),
    ("wider-context", ["cross_sentence"], "same_sentence"),
    ("smaller-chunks", ["saturation"], "short"),
    ("every-relation", ["linked_other"], "overall"),
    ("reextract", ["entity_missing", "not_linked"], "overall"),
]


def price_fixes(causes: DataFrame, rates: DataFrame, judged: bool = False) -> DataFrame:
    """causes (cause, n), rates (rate, hits, total; `gold` has the number of gold facts as its total) -> fix, misses, expected, ceiling, exact,
    rank: what each remedy would add to recall, the largest expected gain first.

    A miss comes back at the run's own rate on facts like it; refused facts and declared inverses come back exactly;
    near names only count once a judge has confirmed them. All inputs are a row per cause or rate.
    """
    spark = causes.sparkSession
    catalogue = spark.createDataFrame([(k, fix, cause, rate) for k, (fix, buckets, rate) in enumerate(REMEDIES) for cause in buckets],
        "place int, fix string, cause string, rate string")
    misses = catalogue.join(causes, "cause").groupBy("place", "fix", "rate").agg(F.sum("n").alias("misses")).where("misses > 0")
    gold = rates.where("rate = 'gold'").select(F.col("total").alias("gold"))
    overall = rates.where("rate = 'overall'").select(F.try_divide("hits", "total").alias("overall"))
    own = rates.where("total > 0").select("rate", (F.col("hits") / F.col("total")).alias("own"))
    x = misses.join(own, "rate", "left").crossJoin(gold).crossJoin(overall)
    share = F.when(F.col("rate") == "exact", 1.0).when(F.col("rate") == "judge",
        F.lit(1.0 if judged else 0.0)).otherwise(F.coalesce("own", "overall", F.lit(0.0)))
    exact = (F.col("rate") == "exact") | ((F.col("rate") == "judge") & F.lit(judged))
    out = x.where("gold > 0").select("fix", "misses", (F.col("misses") * share / F.col("gold")).alias("expected"),
        (F.col("misses") / F.col("gold")).alias("ceiling"), exact.alias("exact"), "place")
    from pyspark.sql import Window

    return out.withColumn("rank",
        F.row_number().over(Window.orderBy(F.desc("expected"), F.desc("ceiling"), "place"))).drop("place")  # ten rows at most


def run_id(outcomes: DataFrame) -> str:
    """An id of a run from its per-document outcomes, whatever their order."""
    from ..sinks.writers import digest

    return digest(outcomes.select(*sorted(outcomes.columns)))[:16]


def measured_fixes(predicted: DataFrame, applied: DataFrame, compared: DataFrame) -> DataFrame:
    """predicted (run, fix, expected, ceiling), applied (run, against, fix), compared (run, against, difference, low, high, verdict)
    -> one row per applied fix that was predicted, with what it was expected to give and what the comparison measured."""
    x = applied.join(predicted, ["run", "fix"]).join(compared, ["run", "against"])
    return x.select("run", "against", "fix", "expected", "ceiling", F.col("difference").alias("measured"), "low", "high", "verdict")


def job_counts(stages: DataFrame) -> DataFrame:
    """stages (stage, facts_in, facts_out, refused, merged, linked, review) of batches -> their sums by stage, and for all (null)."""
    sums = [F.sum(c).alias(c) for c in ("facts_in", "facts_out", "refused", "merged", "linked", "review")]
    return stages.rollup("stage").agg(*sums)


def eval_report(rows: DataFrame, title: str) -> DataFrame:
    """rows (name, section, metric, value, low, high) -> one row a name: schema_version, title, name, sections (JSON).

    Sections and metrics are in order of their names, so equal inputs give equal reports."""
    metric = F.struct("metric", F.struct("value", "low", "high").alias("v"))
    by = rows.groupBy("name", "section").agg(F.sort_array(F.collect_list(metric)).alias("metrics"))
    out = by.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("section", "metrics"))).alias("found"))
    sections = F.map_from_entries(F.transform("found", lambda x: F.struct(x["section"], F.map_from_entries(x["metrics"]))))
    return out.withColumn("sections", F.to_json(sections)).select(F.lit("1.0").alias("schema_version"), F.lit(title).alias("title"), "name",
        "sections")


def standing(cards: DataFrame, least_agreement: float = 0.6, least_n: int = 50) -> DataFrame:
    """cards (stage, model, n, kappa) -> stage, model, standing: no card, too few labels, below the agreement asked for, or in good standing."""
    state = (F.when(F.col("n").isNull(), "no card").when(F.col("n") < least_n,
        "too few labels").when(F.coalesce("kappa", F.lit(-1.0)) < least_agreement, "below agreement")
             .otherwise("in good standing"))
    return cards.select("stage", "model", state.alias("standing"))


#: A metric as a function of column totals and the number of items, for means, ratios and bootstraps alike.
METRICS = {
    "share": lambda t, n: F.try_divide(t["hits"], n),
    "ratio": lambda t, n: F.try_divide(t["hits"], t["total"]),
    "f1": lambda t, n: F.try_divide(2.0 * t["hits"], t["predicted"] + t["gold"]),
    "mean": lambda t, n: F.try_divide(t["value"], n),
}


def metric(items: DataFrame, name: str, columns: dict[str, str], by: list[str] | None = None) -> DataFrame:
    """A metric of METRICS over items: columns gives the item column of each total. One aggregation, by groups if asked."""
    totals = {k: F.sum(F.col(c).cast("double")) for k, c in columns.items()}
    return items.groupBy(*(by or [])).agg(METRICS[name](totals, F.count(F.lit(1)).cast("double")).alias(name))


def read_labels(spark, path: str, schema: str) -> DataFrame:
    """JSON lines by a schema; a line that is no JSON, or lacks a field, is an error that names the file and quotes the line."""
    lines = spark.read.text(path).where(F.trim("value") != "").select("value", F.col("_metadata.file_path").alias("_file"))
    row = F.from_json("value", schema, {"mode": "PERMISSIVE"})
    names = [f.name for f in spark.createDataFrame([], schema).schema]
    bad = row.isNull()
    for n in names:
        bad = bad | row[n].isNull()
    checked = F.when(bad, F.raise_error(F.concat(F.col("_file"), F.lit(": not a label row: "), F.left("value", F.lit(80))))).otherwise(row)
    return lines.select(checked.alias("r")).select("r.*")


def score_harness(gold: DataFrame, facts: DataFrame) -> DataFrame:
    """Any pipeline's facts (doc_id, subject, predicate, obj) against a corpus's gold (the same): the three-pass outcomes' report, for all and by predicate."""
    from pyspark.sql import Window

    from .metrics import match_three_passes, outcome_report

    def numbered(df: DataFrame) -> DataFrame:
        return df.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("subject", "predicate", "obj")))

    return outcome_report(match_three_passes(numbered(gold), numbered(facts)), "predicate")
