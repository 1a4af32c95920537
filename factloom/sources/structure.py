"""Paths into records, N-Triples, ontologies declared in RDF, and maps from text back to its source."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_STEP = re.compile(r"""\.?([^.\[\]"]+)|\[(\d+)\]|\[(\*)\]|\["((?:[^"\\]|\\.)*)"\]""")

# fixed values: vocabularies of RDF, RDFS, OWL, SKOS and XML Schema
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
SKOS = "http://www.w3.org/2004/02/skos/core#"
XSD = "http://www.w3.org/2001/XMLSchema#"
XSD_RANGES = {"string": "string", "integer": "integer", "int": "integer", "long": "integer", "decimal": "number", "double": "number",
    "float": "number",
              "boolean": "boolean", "date": "date", "dateTime": "datetime"}


def parse_path(path: str) -> list[str | int | None]:
    """Steps of a path such as a.b[0]["x y"][*]: a name, an index, or None for every element."""
    steps: list[str | int | None] = []
    at = 0
    while at < len(path):
        m = _STEP.match(path, at)
        if not m or (at and m[1] is not None and path[at] != ".") or (not at and path[at] == "."):
            raise ValueError(f"path {path!r}: cannot read it from character {at}")
        name, index, every, quoted = m.groups()
        steps.append(name if name is not None else int(index) if index is not None else None if every else re.sub(r"\\(.)", r"\1", quoted))
        at = m.end()
    return steps


def at_path(rows: DataFrame, json: str, path: str) -> DataFrame:
    """rows with pos (the place in each [*], outermost first) and value (JSON text, strings bare) of every value at a
    path of a JSON column; rows without one go. Stays in the JVM."""
    out = rows.withColumn("_v", F.col(json)).withColumn("pos", F.array().cast("array<int>"))
    chunk = "$"
    for s in [*parse_path(path), "\0"]:
        if isinstance(s, str) and s != "\0":
            chunk += f"['{s}']" if "'" not in s else f".{s}"
        elif isinstance(s, int):
            chunk += f"[{s}]"
        else:
            if chunk != "$":
                out = out.withColumn("_v", F.get_json_object("_v", chunk))
            chunk = "$"
            if s is None:
                keep = [c for c in out.columns if c not in ("_v", "pos")]
                out = out.select(*keep, "pos", F.posexplode(F.from_json("_v", "array<string>")).alias("_i", "_v"))
                out = out.withColumn("pos", F.array_append("pos", F.col("_i"))).drop("_i")
    return out.where("_v IS NOT NULL").withColumnRenamed("_v", "value")


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """s, p, o, literal (o is a literal's text), tag (its language or datatype). Comments and blank lines go; a line that is
    no triple is an error."""
    form = r'^\s*(?:<([^>]*)>|(_:\S+))\s+<([^>]*)>\s+(?:<([^>]*)>|(_:[^\s.]+)|"((?:[^"\\]|\\.)*)"(?:@([A-Za-z0-9-]+)|\^\^<([^>]*)>)?)\s*\.\s*(?:#.*)?$'
    x = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#|$)"))
    line = F.when(F.col("value").rlike(form), F.col("value")).otherwise(F.raise_error(F.concat(F.lit("no triple: "), F.col("value"))))
    x = x.select(line.alias("value")).select(*[F.regexp_extract("value", form, k).alias(f"g{k}") for k in range(1, 9)],
        F.col("value").rlike(r'^\s*\S+\s+<[^>]*>\s+"').alias("literal"))
    text = F.col("g6")
    for a, b in (("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ('\\"', '"'), ("\\\\", "\\")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return x.select(F.concat("g1", "g2").alias("s"), F.col("g3").alias("p"),
        F.when(F.col("literal"), text).otherwise(F.concat("g4", "g5")).alias("o"), "literal", F.concat("g7", "g8").alias("tag"))


def local_name(iri: Column) -> Column:
    return F.regexp_extract(iri, r"([^/#:]*)[/#]?$", 1)


def ontology_from_rdf(triples: DataFrame) -> dict:
    """Classes, sub-classes, domains, ranges, functional and symmetric properties, inverses and labels -> an ontology
    dictionary. Only declarations reach the driver; statements about instances are filtered out before."""
    kinds = [RDFS + "Class", OWL + "Class", SKOS + "Concept", RDF + "Property", OWL + "ObjectProperty", OWL + "DatatypeProperty",
        OWL + "FunctionalProperty", OWL + "SymmetricProperty"]
    links = [RDFS + "subClassOf", SKOS + "broader", RDFS + "domain", RDFS + "range", OWL + "inverseOf"]
    names = [RDFS + "label", SKOS + "prefLabel", SKOS + "altLabel"]
    declared = triples.where((F.col("p").isin(links)) | ((F.col("p") == RDF + "type") & F.col("o").isin(kinds)))
    about = triples.where(F.col("p").isin(names)).join(declared.select("s").distinct(), "s", "left_semi")
    rows = declared.union(about).select("s", "p", "o").distinct().orderBy("s", "p", "o").collect()
    out: dict = {"types": {}, "predicates": {}}

    def short(iri: str) -> str:
        return re.search(r"([^/#:]*)[/#]?$", iri)[1]

    def is_class(r) -> bool:
        return r["p"] == RDF + "type" and r["o"] in kinds[:3] or r["p"] in links[:2]

    for r in rows:
        if is_class(r):
            out["types"].setdefault(short(r["s"]), {"parents": [], "aliases": []})
        elif r["p"] in links[2:] or r["p"] == RDF + "type":
            out["predicates"].setdefault(short(r["s"]), {"domain": [], "range": "string", "cardinality": "multi", "aliases": []})
    for r in rows:
        s, p, o = short(r["s"]), r["p"], r["o"]
        if p in links[:2]:
            out["types"][s]["parents"].append(short(o))
        elif p == RDFS + "domain":
            out["predicates"][s]["domain"].append(short(o))
        elif p == RDFS + "range":
            out["predicates"][s]["range"] = XSD_RANGES.get(short(o), "string") if o.startswith(XSD) else short(o)
        elif p == OWL + "inverseOf":
            out["predicates"][s]["inverse_of"] = short(o)
        elif o == OWL + "FunctionalProperty":
            out["predicates"][s]["cardinality"] = "single"
        elif o == OWL + "SymmetricProperty":
            out["predicates"][s]["symmetric"] = True
        elif p in names:
            for section in ("types", "predicates"):
                if s in out[section] and o != s:
                    out[section][s]["aliases"].append(o)
    return out


def source_places(parts: Column, start: Column, end: Column) -> Column:
    """parts array of struct(start, end, unit, from): where pieces of a source's units went in the text -> array of
    struct(unit, start, end): the places in the source that a span of the text covers."""
    hit = F.filter(parts, lambda p: (p["start"] < end) & (p["end"] > start))
    return F.transform(hit, lambda p: F.struct(p["unit"].alias("unit"),
        (p["from"] + F.greatest(start - p["start"], F.lit(0))).alias("start"),
                                               (p["from"] + F.least(end, p["end"]) - p["start"]).alias("end")))
