"""Public relation-extraction sets as documents, gold facts and an ontology. Files are given: nothing is downloaded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import pascal, snake

DOCRED = ("title string, sents array<array<string>>, vertexSet array<array<struct<name:string,type:string,sent_id:int,pos:array<int>>>>, "
          "labels array<struct<h:int,t:int,r:string,evidence:array<int>>>")
TREX = ("docid string, title string, text string, triples array<struct<subject:struct<uri:string,surfaceform:string>,predicate:struct<uri:string>,"
        "object:struct<uri:string,surfaceform:string>,annotator:string>>")
SENTENCES = "id string, sent string, triples array<struct<sub:string,rel:string,obj:string>>"


def squashed(c: Column) -> Column:
    """Letters and digits only, lower case: the form in which a set compares names."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")


def unspaced(c: Column) -> Column:
    """Without blanks and underscores, lower case."""
    return F.regexp_replace(F.lower(c), r"[\s_]+", "")


def detokenize(sentences: Column) -> Column:
    """Tokens joined to readable text: no blank before closing marks and clitics, or behind opening ones."""
    text = F.array_join(F.flatten(sentences), " ")
    for pattern, with_ in ((r" ([,.;:!?)\]}%])", "$1"), (r"([(\[{$]) ", "$1"), (r" (n't|'s|'re|'ve|'ll|'d|'m)\b", "$1")):
        text = F.regexp_replace(text, pattern, with_)
    return text


def docred(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A file that is one JSON array, or one object a line -> documents (doc_id, text, title) and gold (doc_id, ord, subject, s_type, relation,
    object, o_type, evidence: sentence numbers). An entity is its first mention."""
    x = spark.read.schema(DOCRED).option("multiLine", True).json(path).withColumn("doc_id", F.concat(F.lit("docred:"), "title"))
    facts = x.select("doc_id", "vertexSet", F.posexplode("labels").alias("ord", "l"))

    def first(side: str) -> Column:
        return F.get(F.get(F.col("vertexSet"), F.col(f"l.{side}")), F.lit(0))

    gold = facts.select("doc_id", "ord", first("h")["name"].alias("subject"), first("h")["type"].alias("s_type"),
        F.col("l.r").alias("relation"),
                        first("t")["name"].alias("object"), first("t")["type"].alias("o_type"), F.col("l.evidence").alias("evidence"))
    return x.select("doc_id", detokenize(F.col("sents")).alias("text"), "title"), gold


def trex(spark: SparkSession, path: str, annotators: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Abstracts with aligned triples -> documents and gold; of triples only those that one of `annotators` made, if given, and whose both ends are named."""
    x = spark.read.schema(TREX).option("multiLine", True).json(path).withColumn("doc_id", F.concat(F.lit("trex:"), "docid"))
    t = x.select("doc_id", F.posexplode("triples").alias("ord",
        "t")).where("t.subject.surfaceform IS NOT NULL AND t.object.surfaceform IS NOT NULL")
    if annotators is not None:
        t = t.where(F.col("t.annotator").isin(*annotators))
    gold = t.select("doc_id", "ord", F.col("t.subject.surfaceform").alias("subject"), F.col("t.subject.uri").alias("s_id"),
        F.element_at(F.split("t.predicate.uri", "/"), -1).alias("relation"),
                    F.col("t.object.surfaceform").alias("object"), F.col("t.object.uri").alias("o_id"))
    return x.select("doc_id", "text", "title"), gold


def sentence_set(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A sentence a line with its triples -> documents and gold."""
    x = spark.read.schema(SENTENCES).json(path)
    gold = x.select(F.col("id").alias("doc_id"), F.posexplode("triples").alias("ord", "t")).select(
        "doc_id", "ord", F.col("t.sub").alias("subject"), F.col("t.rel").alias("relation"), F.col("t.obj").alias("object"))
    return x.select(F.col("id").alias("doc_id"), F.col("sent").alias("text"), F.lit(None).cast("string").alias("title")), gold


def observed_predicates(gold: DataFrame) -> DataFrame:
    """gold (relation, s_type, o_type) -> relation, predicate, domain (sorted subject types), range (the commonest object type, ties to
    the smaller name), seen, importance: how often the relation is used, on a logarithmic scale from 0.05 to 1."""
    ranges = gold.groupBy("relation", "o_type").agg(F.count(F.lit(1)).alias("n"))
    best = ranges.groupBy("relation").agg(F.min_by("o_type", F.struct((-F.col("n")).alias("n"), "o_type")).alias("range"))
    seen = gold.groupBy("relation").agg(F.array_sort(F.collect_set("s_type")).alias("domain"), F.count(F.lit(1)).alias("seen"))
    most = seen.agg(F.max("seen").alias("most"))
    weight = F.round(F.lit(0.05) + F.lit(0.95) * F.log1p("seen") / F.log1p("most"), 4)
    return seen.join(best, "relation").crossJoin(F.broadcast(most)).select("relation", snake(F.col("relation")).alias("predicate"),
        "domain", "range", "seen", weight.alias("importance"))


def observed_ontology(gold: DataFrame, name: str) -> dict:
    """The ontology that gold facts show: a row a relation comes to the driver."""
    rows = observed_predicates(gold).orderBy("relation").collect()
    kinds = sorted({t for r in rows for t in [*r["domain"], r["range"]] if t})
    return {"name": name, "version": name, "types": {t: {} for t in kinds},
            "predicates": {r["predicate"]: {"domain": list(r["domain"]), "range": r["range"], "aliases": [r["relation"]],
            "importance": r["importance"]} for r in rows}}


def seeded_selection(documents: DataFrame, by: str, n: int, seed: int = 0) -> DataFrame:
    """n documents of each value of `by` (all, if fewer), drawn by a seeded hash of doc_id."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(by).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id"))
    return documents.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")




def type_of(label: Column) -> Column:
    """A concept's label as a type name."""
    return pascal(label)
