"""How far a judge can be trusted: cards, link scores, dataset metrics, and label sheets to fill by hand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats as S
from ..sinks.writers import transaction_groups


def judge_card(items: DataFrame, bands: tuple[int, ...] = (200, 1000)) -> DataFrame:
    """items (gold, judged: verdicts; planted boolean; flipped boolean; length) -> a row per length band and one for all
    (null): n, agreement, kappa of keep or refuse, fail_recall (bad facts refused), false_refusals (good facts
    refused), planted_catch, flip_rate. A share of nothing is null."""
    good, kept = F.col("gold") == "supported", F.col("judged") == "supported"
    band = F.lit(f">{bands[-1]}")
    for b in reversed(bands):
        band = F.when(F.col("length") <= b, f"<={b}").otherwise(band)
    x = items.select(band.alias("band"), good.alias("good"), kept.alias("kept"), F.coalesce("planted", F.lit(False)).alias("planted"),
        F.coalesce("flipped", F.lit(False)).alias("flipped"))
    n = x.rollup("band").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("good") == F.col("kept")).alias("same"),
        F.count_if("good").alias("g"), F.count_if("kept").alias("k"),
                             F.count_if(~F.col("good") & ~F.col("kept")).alias("caught"),
                             F.count_if(F.col("good") & ~F.col("kept")).alias("lost"), F.count_if("planted").alias("p"),
                             F.count_if(F.col("planted") & ~F.col("kept")).alias("pc"), F.count_if("flipped").alias("f"))
    po = F.col("same") / F.col("n")
    pe = (F.col("g") * F.col("k") + (F.col("n") - F.col("g")) * (F.col("n") - F.col("k"))) / (F.col("n") * F.col("n"))
    return n.select("band", "n", po.alias("agreement"), F.when(pe < 1, (po - pe) / (1 - pe)).alias("kappa"),
        S.ratio(F.col("caught"), F.col("n") - F.col("g")).alias("fail_recall"),
                    S.ratio(F.col("lost"), F.col("g")).alias("false_refusals"), S.ratio(F.col("pc"), F.col("p")).alias("planted_catch"),
                    S.ratio(F.col("f"), F.col("n")).alias("flip_rate"))


def link_scores(links: DataFrame, ids: DataFrame) -> DataFrame:
    """links (a, b, kind, decider), ids (key, id) -> kind, decider, right, wrong, uncheckable. A link that joins is right if
    its ends have one id, a `different` link if they have two; without both ids it cannot be checked."""
    x = links.join(ids.select(F.col("key").alias("a"), F.col("id").alias("ia")), "a",
        "left").join(ids.select(F.col("key").alias("b"), F.col("id").alias("ib")), "b", "left")
    right = F.when(F.col("kind") == "different", F.col("ia") != F.col("ib")).otherwise(F.col("ia") == F.col("ib"))
    return x.groupBy("kind", "decider").agg(F.count_if(right).alias("right"), F.count_if(~right).alias("wrong"),
        F.count_if(right.isNull()).alias("uncheckable"))


def micro_macro(units: DataFrame, by: str) -> DataFrame:
    """units (by, tp, fp, fn) -> pooled and mean precision, recall and F1; a share of nothing is 0 here, as data sets count it."""
    def prf(tp: Column, fp: Column, fn: Column) -> list[Column]:
        return [F.coalesce(S.ratio(tp, tp + fp), F.lit(0.0)), F.coalesce(S.ratio(tp, tp + fn), F.lit(0.0)),
            F.coalesce(S.ratio(2 * tp, 2 * tp + fp + fn), F.lit(0.0))]

    names = ("precision", "recall", "f1")
    each = units.select(by, "tp", "fp", "fn", *[c.alias(n) for n, c in zip(names, prf(F.col("tp"), F.col("fp"), F.col("fn")))])
    pooled = each.groupBy(by).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")], *[F.avg(c).alias(f"macro_{c}") for c in names])
    return pooled.select(by, *[c.alias(f"micro_{n}") for n, c in zip(names, prf(F.col("tp"), F.col("fp"), F.col("fn")))],
        *[f"macro_{n}" for n in names])


def make_sheets(items: DataFrame, choices: list[str], per_sheet: int = 50) -> DataFrame:
    """items (id, question) -> sheet (from 0), text: Markdown with a box for each choice; order is by a hash of id."""
    boxes = "".join(f"- [ ] {c}\n" for c in choices)
    x = items.select("id", "question", F.xxhash64("id").alias("h"))
    x = transaction_groups(x, ["h", "id"], per_sheet)
    entry = F.concat(F.lit("## "), F.col("id").cast("string"), F.lit("\n\n"), F.regexp_replace("question", r"(?m)^(?=##? |- \[)", r"\\\\"),
        F.lit("\n\n"), F.lit(boxes), F.lit("\n"))
    parts = x.groupBy("transaction").agg(F.sort_array(F.collect_list(F.struct("h", "id",
        entry.alias("e")))).alias("es"))  # at most per_sheet entries
    return parts.select(F.col("transaction").alias("sheet"), F.array_join(F.transform("es", lambda e: e["e"]), "").alias("text"))


def read_sheets(sheets: DataFrame) -> DataFrame:
    """sheets (sheet, text) -> id, label, problem: the one ticked choice, else `no tick` or `several ticks`."""
    blocks = sheets.select(F.explode(F.regexp_extract_all(F.concat(F.lit("\n"), "text"), F.lit(r"(?s)\n## (.*?)(?=\n## |\z)"),
        F.lit(1))).alias("b"))
    ticks = F.regexp_extract_all("b", F.lit(r"(?m)^- \[[xX]\] (.*?)\s*$"), F.lit(1))
    x = blocks.select(F.substring_index("b", "\n", 1).alias("id"), ticks.alias("t"))
    return x.select("id", F.when(F.size("t") == 1, F.get("t", F.lit(0))).alias("label"),
        F.when(F.size("t") == 0, "no tick").when(F.size("t") > 1, "several ticks").alias("problem"))


def by_card(gated: DataFrame, card: DataFrame, gate: str = "gate", least_kappa: float = 0.6) -> DataFrame:
    """gated facts (gate struct of action, reason, review) under a judge's card: where its kappa over all items is null or
    below the bar, what the judge alone refused is kept and marked for review; schema refusals stand. The card is one row."""
    bar = card.where("band IS NULL").agg(F.coalesce(F.max("kappa"), F.lit(-1.0)).alias("_kappa"))
    kept = F.struct(F.lit("accept").alias("action"), F.col(f"{gate}.reason").alias("reason"), F.lit("judge").alias("review"))
    weak = (F.col("_kappa") < least_kappa) & (F.col(f"{gate}.action") == "refuse") & ~F.startswith(F.col(f"{gate}.reason"),
        F.lit("schema: "))
    return gated.crossJoin(F.broadcast(bar)).withColumn(gate, F.when(weak, kept).otherwise(F.col(gate))).drop("_kappa")
