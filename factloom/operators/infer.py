"""Schema inference: record profiles, inclusion dependencies, coverage of mentions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import literal_kind, literal_range


def record_profile(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: rows, values, distinct values, range and whether it names each row (key)."""
    long = rows.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], columns, "column", "value")
    p = long.groupBy("column").agg(F.count(F.lit(1)).alias("rows"), F.count("value").alias("values"),
        F.count_distinct("value").alias("distinct"),
                                   F.array_sort(F.collect_set(literal_kind(F.col("value")))).alias("kinds"))
    return p.select("column", "rows", "values", "distinct", literal_range(F.col("kinds")).alias("range"),
        ((F.col("distinct") == F.col("rows")) & (F.col("rows") > 0)).alias("key"))


def inclusion_dependencies(columns: dict[str, DataFrame], least: float = 0.5) -> DataFrame:
    """columns {name: one-column DataFrame} -> a, b, share: at least `least` of a's distinct values occur in b."""
    long = None
    for name, df in columns.items():
        x = df.select(F.lit(name).alias("c"), F.col(df.columns[0]).cast("string").alias("v")).where("v IS NOT NULL").distinct()
        long = x if long is None else long.union(x)
    sizes = long.groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    sets = long.groupBy("v").agg(F.collect_set("c").alias("cs"))  # at most one entry per column
    common = sets.select(F.explode("cs").alias("a"), "cs").select("a", F.explode("cs").alias("b")).where("a != b").groupBy("a",
        "b").agg(F.count(F.lit(1)).alias("k"))
    return common.join(F.broadcast(sizes.withColumnRenamed("c", "a")), "a").select("a", "b",
        (F.col("k") / F.col("n")).alias("share")).where(F.col("share") >= least)


def importance(support: DataFrame) -> DataFrame:
    """support (name, support) with importance: ln(1 + support) over that of the largest, 3 places."""
    top = support.agg(F.max("support").alias("top"))
    return support.crossJoin(F.broadcast(top)).withColumn("importance",
        F.coalesce(F.bround(F.try_divide(F.log1p("support"), F.log1p("top")), 3), F.lit(0.0))).drop("top")


def mentions(sentences: DataFrame, names: DataFrame, longest: int = 4) -> DataFrame:
    """sentences (doc_id, pos, text), names (name: words joined by a space) -> doc_id, pos, name, at, words: known names over
    word n-grams, the longest first, none overlapping a longer one that starts at or before it."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    x = sentences.select("doc_id", "pos", words.alias("w")).where(F.size("w") > 0)
    grams = x.select("doc_id", "pos", F.posexplode("w").alias("at", "first"), "w").select(
        "doc_id", "pos", "at", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.size("w") - F.col("at"))),
        lambda n: F.struct(
            n.alias("n"), F.array_join(F.slice("w", F.col("at") + 1, n), " ").alias("g")))).alias("x")).select("doc_id", "pos", "at", "x.n",
            F.col("x.g").alias("name"))
    hits = grams.join(names.select("name").distinct(), "name")
    best = hits.groupBy("doc_id", "pos", "at").agg(F.max(F.struct("n", "name")).alias("x")).select("doc_id", "pos", "at", "x.n", "x.name")
    w = Window.partitionBy("doc_id", "pos").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    return best.withColumn("covered", F.max(F.col("at") + F.col("n")).over(w)).where("covered IS NULL OR at >= covered").select("doc_id",
        "pos", "name", "at", F.col("n").alias("words"))


def uncovered_sentences(sentences: DataFrame, found: DataFrame, cited: DataFrame) -> DataFrame:
    """Sentences (doc_id, pos, start, end) that name two or more known names and overlap no cited span (doc_id, start, end)."""
    two = found.groupBy("doc_id", "pos").agg(F.count_distinct("name").alias("names")).where("names >= 2")
    s = sentences.join(two, ["doc_id", "pos"])
    c = cited.select(F.col("doc_id").alias("d"), F.col("start").alias("cs"), F.col("end").alias("ce"))
    return s.join(c, (F.col("doc_id") == F.col("d")) & (F.col("start") < F.col("ce")) & (F.col("cs") < F.col("end")), "left_anti")


_NAME = r"\p{Lu}[\p{L}\p{N}-]*(?: \p{Lu}[\p{L}\p{N}-]*)*"


def proposed_types(sentences: DataFrame) -> DataFrame:
    """sentences (doc_id, text) -> type, instance, support (distinct documents): from "towns such as Ulm, Bonn and Kiel"
    and "Ulm is a town"; a plural type loses its s."""
    listed = rf"(\p{{Ll}}[\p{{Ll}}-]*),? such as ({_NAME}(?:, {_NAME})*(?:,? (?:and|or) {_NAME})?)"
    copula = rf"({_NAME}) (?:is|was) an? (\p{{Ll}}[\p{{Ll}}-]*)"

    def found(pattern: str, of: int, what: int):
        return sentences.select("doc_id",
            F.explode(F.arrays_zip(F.regexp_extract_all("text", F.lit(pattern), F.lit(of)).alias("t"),
            F.regexp_extract_all("text", F.lit(pattern), F.lit(what)).alias("i"))).alias("x"))

    a = found(listed, 1, 2).select("doc_id", F.regexp_replace("x.t", "s$", "").alias("type"),
        F.explode(F.split("x.i", r",? (?:and|or) |, ")).alias("instance"))
    b = found(copula, 2, 1).select("doc_id", F.col("x.t").alias("type"), F.col("x.i").alias("instance"))
    return a.union(b).groupBy("type", "instance").agg(F.count_distinct("doc_id").alias("support"))
