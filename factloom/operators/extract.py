"""Deterministic extraction: records, pipe tables, key-value blocks and triples become facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold


def unpivot_facts(rows: DataFrame, key: Column, type_name: str, columns: list[str]) -> DataFrame:
    """Wide rows -> s_key, s_type, predicate, value: one fact per column that is not null; no key, no facts."""
    wide = rows.select(key.alias("s_key"), *[F.col(c).cast("string").alias(c) for c in columns]).where("s_key IS NOT NULL")
    return wide.unpivot("s_key", columns, "predicate", "value").where("value IS NOT NULL").select("s_key", F.lit(type_name).alias("s_type"),
        "predicate", "value")


def match_predicates(facts: DataFrame, names: DataFrame) -> DataFrame:
    """facts (predicate as written) with the declared predicate of names (form, name, priority: name before label
    before alias) whose folded form is the same; facts without one are left out. names is an ontology's."""
    best = names.withColumn("f", fold(F.col("form"))).groupBy("f").agg(F.min(F.struct("priority", "name"))["name"].alias("name"))
    return facts.withColumn("f", fold(F.col("predicate"))).join(F.broadcast(best), "f").drop("f", "predicate").withColumnRenamed("name",
        "predicate")


def render_record(columns: list[str]) -> tuple[Column, Column]:
    """`path: value` lines of a flat record, and where each value stands: fields map name -> (start, end)."""
    present = F.filter(F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).cast("string").alias("v")) for c in columns]),
        lambda x: x["v"].isNotNull())
    text = F.array_join(F.transform(present, lambda x: F.concat(x["k"], F.lit(": "), x["v"])), "\n")
    start = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<struct<k:string,start:int,end:int>>)").alias("out"))
    fields = F.aggregate(present, start, lambda acc, x: F.struct(
        (acc["at"] + F.length(x["k"]) + F.length(x["v"]) + 3).alias("at"),
        F.array_append(acc["out"], F.struct(x["k"].alias("k"), (acc["at"] + F.length(x["k"]) + 2).alias("start"),
                                            (acc["at"] + F.length(x["k"]) + 2 + F.length(x["v"])).alias("end"))).alias("out")),
                                            lambda acc: acc["out"])
    return text, fields


def _lines(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


def table_facts(documents: DataFrame) -> DataFrame:
    """Pipe tables -> doc_id, table (its header's line), row, column, value, as table_cells has them."""
    return table_cells(documents).drop("k")


def table_cells(documents: DataFrame) -> DataFrame:
    """Pipe tables -> doc_id, table (its header's line), row, k (the column's place), column, value. A header is a line of cells above a rule
    line of dashes; rows go on while lines are cells; an escaped pipe stays in its cell."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    is_row, is_rule = F.col("line").rlike(r"^\s*\|.*\|\s*$"), F.col("line").rlike(r"^\s*\|(?:\s*:?-+:?\s*\|)+\s*$")
    x = _lines(documents).withColumn("row", is_row).withColumn("rule", is_rule).withColumn("head",
        is_row & ~is_rule & F.coalesce(F.lead("rule").over(w), F.lit(False)))
    x = x.withColumn("start", F.last(F.when(F.col("head") | ~F.col("row"), F.when(F.col("head"), F.col("pos")).otherwise(-1)),
        ignorenulls=True).over(w)).where("start >= 0 AND NOT rule")
    cells = F.transform(F.split(F.regexp_replace(F.regexp_replace("line", r"^\s*\|", ""), r"\|\s*$", ""), r"(?<!\\)\|"),
        lambda c: F.replace(F.btrim(c), F.lit(r"\|"), F.lit("|")))
    x = x.select("doc_id", F.col("start").alias("table"), "pos", "head", cells.alias("cells"))
    names = x.where("head").select("doc_id", "table", F.col("cells").alias("names"))
    body = x.where("NOT head").join(names, ["doc_id", "table"])
    return body.select("doc_id", "table", (F.col("pos") - F.col("table") - 2).alias("row"), F.posexplode("cells").alias("k", "value"),
        "names").where(
        (F.col("value") != "") & (F.col("k") < F.size("names"))).select("doc_id", "table", "row", "k",
        F.get("names", F.col("k")).alias("column"), "value")


def key_value_facts(documents: DataFrame) -> DataFrame:
    """Runs of `Key: value` lines -> doc_id, block (its first line), heading (the last one above), key, value."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    pattern = r"^\s*([\p{L}][\p{L}\p{N} _/-]{0,40}):\s+(\S.*?)\s*$"
    x = _lines(documents).withColumn("kv", F.col("line").rlike(pattern)).withColumn("heading",
        F.last(F.when(F.col("line").rlike(r"^#{1,6} "), F.regexp_replace("line", r"^#+ +", "")), ignorenulls=True).over(w))
    x = x.withColumn("new", (F.col("kv") & ~F.coalesce(F.lag("kv").over(w), F.lit(False))).cast("int"))
    x = x.withColumn("block", F.last(F.when(F.col("new") == 1, F.col("pos")), ignorenulls=True).over(w)).where("kv")
    return x.select("doc_id", "block", "heading", F.regexp_extract("line", pattern, 1).alias("key"),
        F.regexp_extract("line", pattern, 2).alias("value"))


def headings(documents: DataFrame) -> DataFrame:
    """Markdown headings: doc_id, pos (line), level, title, path (titles above it, joined)."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    x = _lines(documents).where(F.col("line").rlike(r"^#{1,6}\s+\S")).select("doc_id", "pos",
        F.length(F.regexp_extract("line", r"^(#+)", 1)).alias("level"), F.btrim(F.regexp_replace("line", r"^#+\s+", "")).alias("title"))
    for k in range(1, 7):  # the last heading of each level, forgotten when a higher one comes
        x = x.withColumn(f"h{k}", F.last(F.when(F.col("level") == k, F.struct("title", "pos")), ignorenulls=True).over(w))
    last_higher = [F.greatest(F.lit(-1),
        *[F.coalesce(F.col(f"h{j}")["pos"], F.lit(-1)) for j in range(1, k)]) if k > 1 else F.lit(-1) for k in range(1, 7)]
    parts = [F.when((F.col("level") >= k) & (F.col(f"h{k}")["pos"] > last_higher[k - 1]), F.col(f"h{k}")["title"]) for k in range(1, 7)]
    return x.select("doc_id", "pos", "level", "title", F.concat_ws(" > ", *parts).alias("path"))


def triples_to_facts(triples: DataFrame, documents: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """triples (doc, subject, predicate, object, subject_type, object_type, start, end, quote, confidence) joined to
    documents (doc_id, text) by id: facts with their evidence span and its origin. Given offsets are cited, a quote
    found in the text is cited, else the whole text is context. types (alias, name) resolves type names."""
    x = triples.join(documents.select(F.col("doc_id").cast("string").alias("doc"), "text"), "doc", "left")
    if types is not None:
        for side in ("subject_type", "object_type"):
            names = types.select(F.lower("alias").alias("_a"), F.col("name").alias("_n"))
            x = x.withColumn("_a", F.lower(side)).join(F.broadcast(names), "_a", "left").withColumn(side, F.coalesce("_n", side)).drop("_a",
                "_n")
    found = F.when(F.col("quote") != "", F.expr("locate(quote, text)"))
    origin = F.when(F.col("text").isNull(), None).when(F.col("start").isNotNull(), "cited").when(found > 0, "cited").otherwise("context")
    start = F.when(F.col("start").isNotNull(), F.col("start")).when(found > 0, found - 1).otherwise(0)
    end = F.when(F.col("end").isNotNull(), F.col("end")).when(found > 0, found - 1 + F.length("quote")).otherwise(F.length("text"))
    return x.select("doc", F.concat(F.coalesce("subject_type", F.lit("Thing")), F.lit(":"), F.lower("subject")).alias("s_key"),
        F.coalesce("subject_type", F.lit("Thing")).alias("s_type"),
                    "predicate", F.when(F.col("object_type").isNotNull(), "entity").otherwise("value").alias("o_kind"),
                    F.col("object").alias("o_repr"), "object_type",
                    F.when(origin.isNotNull(), start).cast("int").alias("start"), F.when(origin.isNotNull(), end).cast("int").alias("end"),
                    origin.alias("origin"),
                    F.coalesce("confidence", F.lit(0.5)).alias("confidence"))


def best_per_claim(facts: DataFrame, key: list[str]) -> DataFrame:
    """One fact per claim of several extractors: the most confident, the first of a tie (ord)."""
    others = [c for c in facts.columns if c not in key]
    return facts.groupBy(*key).agg(F.max_by(F.struct(*others), F.struct("confidence", -F.col("ord"))).alias("x")).select(*key, "x.*")
