"""Names that are nearly one, names inside longer ones, the text around a citation, and values in canonical form as a stage."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import values as V

NEAR = 0.85


def near_names(pairs: DataFrame, a: str, b: str, name: str = "near") -> DataFrame:
    """pairs (a, b: names) with a boolean: their keys are equal, or one is inside the other as whole words (four letters or
    more), or they are alike by NEAR. The string ratio, the one slow part, is only computed where the cheap rules fail."""
    ka, kb = X.name_key(F.col(a)), X.name_key(F.col(b))
    x = pairs.withColumn("_a", ka).withColumn("_b", kb)
    short, long = (F.when(F.length("_a") <= F.length("_b"), F.col(p)).otherwise(F.col(q)) for p, q in (("_a", "_b"), ("_b", "_a")))
    inside = (F.length(short) >= 4) & F.contains(F.concat(F.lit(" "), long, F.lit(" ")), F.concat(F.lit(" "), short, F.lit(" ")))
    sure = F.when((F.col("_a") == "") | (F.col("_b") == ""), F.lit(False)).when((F.col("_a") == F.col("_b")) | inside, F.lit(True))
    x = x.withColumn("_sure", sure)
    ratio = _ratio()(F.when(F.col("_sure").isNull(), F.col("_a")), F.when(F.col("_sure").isNull(), F.col("_b")))
    return x.withColumn(name, F.coalesce("_sure", ratio >= NEAR, F.lit(False))).drop("_a", "_b", "_sure")


def _ratio():
    from difflib import SequenceMatcher

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype=float)

    return run


def part_of_longer_name(words: DataFrame, matches: DataFrame) -> DataFrame:
    """words (doc_id, sentence, pos, word, joined: only blanks or hyphens before it), matches (doc_id, sentence, first, last) ->
    matches with extends: a capitalised word is joined on to the match, so that it is part of a longer name.

    A word that the name key drops (a legal form, a leading article) does not extend it, and the first word of a sentence, which is
    capitalised whatever it is, does not either.
    """
    w = Window.partitionBy("doc_id", "sentence").orderBy("pos")
    capital = F.col("word").rlike(r"^\p{Lu}")
    x = words.select("doc_id", "sentence", "pos", "word", "joined", capital.alias("capital"), F.lead("joined").over(w).alias("next_joined"))
    key = ["doc_id", "sentence"]
    inside = matches.join(x, key).where((F.col("pos") >= F.col("first")) & (F.col("pos") <= F.col("last")))
    names = inside.groupBy(*key, "first",
        "last").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda e: e["word"]),
        " ").alias("name"),
                                                      F.max_by("joined", -F.col("pos")).alias("first_joined"))
    before = x.select(*key, (F.col("pos") + 1).alias("first"), F.col("word").alias("w0"),
        (F.col("capital") & (F.col("pos") > 0)).alias("c0"))
    after = x.select(*key, (F.col("pos") - 1).alias("last"), F.col("word").alias("w1"), (F.col("capital") & F.col("joined")).alias("c1"))
    y = names.join(before, [*key, "first"], "left").join(after, [*key, "last"], "left")
    own = X.name_key(F.col("name"))
    longer0 = F.col("c0") & F.col("first_joined") & (X.name_key(F.concat_ws(" ", "w0", "name")) != own)
    longer1 = F.col("c1") & (X.name_key(F.concat_ws(" ", "name", "w1")) != own)
    return y.select(*key, "first", "last", (F.coalesce(longer0, F.lit(False)) | F.coalesce(longer1, F.lit(False))).alias("extends"))


def cited_context(mentions: DataFrame, sentences: DataFrame, around: int = 1) -> DataFrame:
    """mentions (key, doc_id, start), sentences (doc_id, pos, start, end, text) -> key, context: the sentence of an entity's first
    mention (by doc_id, then place) with `around` sentences before and behind it."""
    s = sentences.select("doc_id", "pos", F.col("start").alias("from"), F.col("end").alias("to"), "text")
    first = mentions.groupBy("key").agg(F.min(F.struct("doc_id", "start")).alias("m")).select("key", "m.*")
    at = first.join(s, "doc_id").where("start >= from AND start < to").select("key", "doc_id", F.col("pos").alias("at"))
    near = at.join(s.select("doc_id", "pos", "text"), "doc_id").where(F.abs(F.col("pos") - F.col("at")) <= around)
    return near.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda e: e["text"]),
        " ").alias("context"))


def normalise_values(facts: DataFrame, intervals: list[str], day_first: bool | None = None) -> DataFrame:
    """facts (o_kind, o_repr, qualifiers map<string,string>, source_form map<string,string>) in canonical form: the object if
    it is a value, and every qualifier; those in `intervals` are dates. The spelling before is kept in source_form, the
    first one if a fact is normalised again, which changes nothing more.
    """
    quantity = V.normalize_quantity()

    def canonical(c: Column, date: bool = False) -> Column:
        got = V.normalize_date(c, day_first)
        return F.coalesce(got, c) if date else got

    value = F.when(F.col("o_kind") != "entity",
        F.coalesce(canonical(F.col("o_repr")), quantity(F.col("o_repr")), F.col("o_repr"))).otherwise(F.col("o_repr"))
    none = F.create_map().cast("map<string,string>")
    x = facts.withColumn("_value", value).withColumn("qualifiers", F.coalesce("qualifiers", none)).withColumn("source_form",
        F.coalesce("source_form", none))
    bound = F.transform_values("qualifiers", lambda k,
        v: F.when(k.isin(*intervals) if intervals else F.lit(False), canonical(v, True)).otherwise(F.coalesce(canonical(v), v)))
    x = x.withColumn("_bound", bound)
    changed = F.map_filter("qualifiers", lambda k, v: ~v.eqNullSafe(F.col("_bound")[k]))
    own = F.when(~F.col("o_repr").eqNullSafe(F.col("_value")), F.create_map(F.lit("object"), F.col("o_repr"))).otherwise(none)
    forms = F.map_concat(F.map_filter(F.map_concat(own, changed), lambda k, v: ~F.map_contains_key("source_form", k)), F.col("source_form"))
    return x.withColumn("source_form", forms).withColumn("o_repr", F.col("_value")).withColumn("qualifiers", F.col("_bound")).drop("_value",
        "_bound")


def document_key(text: Column, title: Column) -> Column:
    """An identity of a document from its content, whatever it was loaded as."""
    return F.sha2(F.concat_ws(chr(0), F.coalesce(title, F.lit("")), F.coalesce(text, F.lit(""))), 256)
