"""Readers: files of any form become documents.

Every reader returns doc_id, text, uri, title, modality, tier, metadata (JSON) in the columns that it
knows. Files are listed and read by Spark, so any file system it knows will do.
"""

from __future__ import annotations

import json
import re
from io import BytesIO
from zipfile import ZipFile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import stem_of_path
from ..schema import TRIPLES, struct
from .html import html_text

DOCUMENT = "doc_id string, text string, uri string, title string, modality string, tier string, metadata string"


def _as_documents(df: DataFrame, tier: str, modality: str = "unstructured") -> DataFrame:
    have = set(df.columns)
    fill = {"title": F.lit(None).cast("string"), "modality": F.lit(modality), "tier": F.lit(tier), "metadata": F.lit(None).cast("string")}
    for c, v in fill.items():
        if c not in have:
            df = df.withColumn(c, v)
    return df.select(F.col("doc_id").cast("string").alias("doc_id"), "text", "uri", "title", "modality", "tier", "metadata")


def _whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("value").alias("text"),
        F.col("_metadata.file_path").alias("uri"))


def read_text(spark: SparkSession, path: str, tier: str = "unverified") -> DataFrame:
    """A file as written is one document, its path the id."""
    return _as_documents(_whole(spark, path).withColumn("doc_id", F.col("uri")), tier)


def read_markdown(spark: SparkSession, path: str, tier: str = "unverified") -> DataFrame:
    """As text, with the headings (level, text, start) as metadata and the first as title."""
    x = _whole(spark, path).withColumn("doc_id", F.col("uri"))
    found = F.regexp_extract_all("text", F.lit(r"(?m)^(#{1,6}[ \t]+\S.*?)[ \t]*$"), F.lit(1))
    heads = F.transform(found, lambda h: F.struct(F.length(F.regexp_extract(h, r"^(#+)", 1)).alias("level"),
        F.regexp_replace(h, r"^#+\s+", "").alias("text")))
    x = x.withColumn("title", F.get(heads, F.lit(0))["text"]).withColumn("metadata", F.to_json(F.struct(heads.alias("headings"))))
    return _as_documents(x, tier)


def read_html(spark: SparkSession, path: str, tier: str = "unverified", strip_boilerplate: bool = False) -> DataFrame:
    def run(batches):
        for b in batches:
            got = [html_text(h, strip_boilerplate) for h in b["text"]]
            yield pd.DataFrame({"doc_id": b["uri"], "text": [g[0] for g in got], "uri": b["uri"], "title": [g[1] for g in got],
                "modality": [g[2] for g in got]})

    return _as_documents(_whole(spark, path).mapInPandas(run, "doc_id string, text string, uri string, title string, modality string"),
        tier)


def docx_text(content: bytes) -> tuple[str, str | None, str]:
    """Paragraphs and tables in order, heading styles as #."""
    import xml.etree.ElementTree as ET

    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with ZipFile(BytesIO(content)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(f"{w}body")

    def words(e) -> str:
        return "".join(t.text or "" for t in e.iter(f"{w}t"))

    lines, title, tables = [], None, False
    for e in body if body is not None else ():
        if e.tag == f"{w}p" and (text := words(e).strip()):
            style = e.find(f"{w}pPr/{w}pStyle")
            level = re.fullmatch(r"[Hh]eading ?([1-6])", style.get(f"{w}val") or "") if style is not None else None
            title = title or (text if level else None)
            lines.append(("#" * int(level[1]) + " " if level else "") + text)
        elif e.tag == f"{w}tbl":
            tables = True
            rows = [[words(c).strip().replace("|", r"\|") for c in r.iter(f"{w}tc")] for r in e.iter(f"{w}tr")]
            if rows:
                lines += [f"| {' | '.join(rows[0])} |", "|" + " --- |" * len(rows[0]), *(f"| {' | '.join(r)} |" for r in rows[1:])]
    return "\n".join(lines), title, "semi_structured" if tables else "unstructured"


def read_docx(spark: SparkSession, path: str, tier: str = "unverified") -> DataFrame:
    def run(batches):
        for b in batches:
            got = [docx_text(c) for c in b["content"]]
            yield pd.DataFrame({"doc_id": b["path"], "text": [g[0] for g in got], "uri": b["path"], "title": [g[1] for g in got],
                "modality": [g[2] for g in got]})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    return _as_documents(files.mapInPandas(run, "doc_id string, text string, uri string, title string, modality string"), tier)


def read_pdf(spark: SparkSession, path: str, tier: str = "unverified", separator: str = "\n\n") -> DataFrame:
    """Page texts joined. Needs pypdf on the executors."""

    def run(batches):
        from pypdf import PdfReader

        for b in batches:
            text = [separator.join(p.extract_text() or "" for p in PdfReader(BytesIO(c)).pages) for c in b["content"]]
            yield pd.DataFrame({"doc_id": b["path"], "text": text, "uri": b["path"]})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    return _as_documents(files.mapInPandas(run, "doc_id string, text string, uri string"), tier)


def record_documents(rows: DataFrame, uri, tier: str = "unverified", ordinal=None) -> DataFrame:
    """Rows -> documents of `path: value` lines, nested records flattened, the record as JSON metadata.

    Strings stand bare unless empty, padded or of several lines; then they are JSON. Offsets of the values
    are in metadata under fields.
    """
    payload = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})

    def run(batches):
        for b in batches:
            got = [render(json.loads(r)) for r in b["record"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "uri": b["uri"], "text": [t for t, _ in got],
                                "metadata": [json.dumps({"row": json.loads(r), "fields": f}, ensure_ascii=False) for r,
                                (_, f) in zip(b["record"], got)]})

    place = ordinal if ordinal is not None else F.sha2(payload, 256)
    x = rows.select(F.concat_ws("#", uri, place.cast("string")).alias("doc_id"), uri.alias("uri"), payload.alias("record"))
    return _as_documents(x.mapInPandas(run, "doc_id string, uri string, text string, metadata string"), tier, "structured")


def leaves(value, path: str = "") -> list[tuple[str, object]]:
    """Depth first: (path, value) of each scalar and each empty container. Keys that are no plain names are quoted."""
    if isinstance(value, dict) and value:
        out = []
        for k, v in value.items():
            step = k if re.fullmatch(r"\w+", k) else f"[{json.dumps(k, ensure_ascii=False)}]"
            out += leaves(v, f"{path}.{step}" if path and not step.startswith("[") else path + step)
        return out
    if isinstance(value, list) and value:
        return [x for k, v in enumerate(value) for x in leaves(v, f"{path}[{k}]")]
    return [(path, value)]


def render(record: dict) -> tuple[str, dict[str, list[int]]]:
    lines, fields, at = [], {}, 0
    for path, v in leaves(record):
        plain = isinstance(v, str) and v and v == v.strip() and "\n" not in v and "\r" not in v
        text = v if plain else json.dumps(v, ensure_ascii=False)
        fields[path] = [at + len(path) + 2, at + len(path) + 2 + len(text)]
        lines.append(f"{path}: {text}")
        at += len(lines[-1]) + 1
    return "\n".join(lines), fields


def read_csv(spark: SparkSession, path: str, sep: str = ",", tier: str = "unverified") -> DataFrame:
    """A document per row. Duplicate column names and rows of more fields than the header are errors."""
    first = spark.read.text(path).first()
    names = [n.strip('"') for n in (first[0].lstrip("﻿").split(sep) if first else [])]
    if len(set(names)) < len(names):
        raise ValueError(f"{path}: duplicate column names {sorted({n for n in names if names.count(n) > 1})}")
    rows = spark.read.csv(path, sep=sep, header=True, mode="FAILFAST", multiLine=True, enforceSchema=False)
    rows = rows.dropna("all")
    return record_documents(rows, F.lit(path), tier)


def read_tsv(spark: SparkSession, path: str, tier: str = "unverified") -> DataFrame:
    return read_csv(spark, path, "\t", tier)


def read_jsonl(spark: SparkSession, path: str, tier: str = "unverified", schema: StructType | str | None = None) -> DataFrame:
    """A document per line; blank lines are skipped, a line that is no JSON is an error that quotes it."""
    lines = spark.read.text(path).where(F.trim("value") != "").select(F.col("_metadata.file_path").alias("uri"), "value")
    ok = F.when(F.expr("try_parse_json(value)").isNull(),
        F.raise_error(F.concat(F.col("uri"), F.lit(": not JSON: "), F.left("value", F.lit(80))))).otherwise(F.col("value"))

    def run(batches):
        for b in batches:
            rows = [json.loads(v) for v in b["value"]]
            got = [render(r) if isinstance(r, dict) else render({"value": r}) for r in rows]
            yield pd.DataFrame({"doc_id": b["doc_id"], "uri": b["uri"], "text": [t for t, _ in got],
                "metadata": [json.dumps({"row": r, "fields": f}, ensure_ascii=False) for r, (_, f) in zip(rows, got)]})

    x = lines.select(F.concat_ws("#", "uri", F.sha2("value", 256)).alias("doc_id"), "uri", ok.alias("value"))
    return _as_documents(x.mapInPandas(run, "doc_id string, uri string, text string, metadata string"), tier, "structured")


def read_json(spark: SparkSession, path: str, records: str | None = None, tier: str = "unverified") -> DataFrame:
    """An array is a document per element, an object one; `records` (a JSON path such as $.items) selects a nested array."""
    whole = _whole(spark, path).select("uri",
        F.expr(f"parse_json({'get_json_object(text, ' + repr(records) + ')' if records else 'text'})").alias("v"))
    whole.createOrReplaceTempView("_factloom_json")
    arrays = spark.sql("SELECT uri, pos, to_json(value) AS value FROM _factloom_json, LATERAL variant_explode(CASE WHEN schema_of_variant(v) LIKE 'ARRAY%' THEN v END)")
    single = whole.where("schema_of_variant(v) NOT LIKE 'ARRAY%'").selectExpr("uri", "0 AS pos", "to_json(v) AS value")

    def run(batches):
        for b in batches:
            rows = [json.loads(v) for v in b["value"]]
            got = [render(r) if isinstance(r, dict) else render({"value": r}) for r in rows]
            yield pd.DataFrame({"doc_id": [f"{u}#{p}" for u, p in zip(b["uri"], b["pos"])], "uri": b["uri"], "text": [t for t, _ in got],
                                "metadata": [json.dumps({"row": r, "fields": f}, ensure_ascii=False) for r, (_, f) in zip(rows, got)]})

    return _as_documents(arrays.union(single).mapInPandas(run, "doc_id string, uri string, text string, metadata string"), tier,
        "structured")


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None, tier: str = "unverified") -> DataFrame:
    """A document per row; only the named columns are read."""
    rows = spark.read.parquet(path)
    return record_documents(rows.select(*columns) if columns else rows, F.lit(path), tier)


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """Interchange triples. Offsets come in pairs, confidence is within 0..1, a newer major version is refused: the first
    line that breaks a rule is an error. object keeps its JSON spelling."""
    x = spark.read.schema(struct(TRIPLES)).option("mode", "FAILFAST").json(path)
    bad = (F.when(F.coalesce(F.split_part("schema_version", F.lit("."), F.lit(1)), F.lit("1")) != "1", "newer major version")
           .when(F.col("doc").isNull() | F.col("subject").isNull() | F.col("predicate").isNull() | F.col("object").isNull(),
           "missing field")
           .when(F.col("start").isNull() != F.col("end").isNull(), "start without end").when(~F.col("confidence").between(0, 1),
           "confidence out of range"))
    return x.withColumn("doc", F.when(bad.isNotNull(),
        F.raise_error(F.concat(F.lit("triple "), F.coalesce("doc", F.lit("?")), F.lit(": "), bad))).otherwise(F.col("doc")))


def from_graph_documents(rows: DataFrame) -> DataFrame:
    """Graph documents (source struct with page_content, relationships array of source, target, type) -> triples, each
    with the whole document as context."""
    r = rows.select(F.sha2("source.page_content", 256).alias("doc"), F.explode("relationships").alias("r"))
    return r.select("doc", F.col("r.source.id").alias("subject"), F.col("r.type").alias("predicate"), F.col("r.target.id").alias("object"),
        F.col("r.source.type").alias("subject_type"),
                    F.col("r.target.type").alias("object_type"))


def from_annotated(rows: DataFrame) -> DataFrame:
    """Annotated documents (document_id, extractions of text, attributes map, char_interval) -> a triple per attribute."""
    e = rows.select(F.col("document_id").alias("doc"), F.explode("extractions").alias("e"))
    return e.select("doc", F.col("e.extraction_text").alias("subject"), F.explode("e.attributes").alias("predicate", "object"),
        F.col("e.extraction_class").alias("subject_type"),
                    F.col("e.char_interval.start_pos").alias("start"), F.col("e.char_interval.end_pos").alias("end"),
                    F.when(F.col("e.alignment_status") == "match_exact", F.col("e.extraction_text")).alias("quote"))


def from_lexical_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes (id, name, label, chunks array) and edges (source, target, type) -> triples; a relation whose ends share one
    chunk is evidenced by it, else by the document."""
    s = nodes.select(F.col("id").alias("source"), F.col("name").alias("subject"), F.col("label").alias("subject_type"),
        F.col("chunks").alias("cs"))
    t = nodes.select(F.col("id").alias("target"), F.col("name").alias("object"), F.col("label").alias("object_type"),
        F.col("chunks").alias("ct"))
    x = edges.join(s, "source").join(t, "target").withColumn("both", F.array_intersect("cs", "ct"))
    return x.select("subject", F.col("type").alias("predicate"), "object", "subject_type", "object_type",
        F.when(F.size("both") == 1, F.get("both", F.lit(0))).alias("chunk"))


READERS = {"txt": read_text, "md": read_markdown, "html": read_html, "htm": read_html, "csv": read_csv, "tsv": read_tsv, "json": read_json,
    "jsonl": read_jsonl, "parquet": read_parquet,
           "docx": read_docx, "pdf": read_pdf}


def read_directory(spark: SparkSession, path: str, tier: str = "unverified", readers: dict | None = None) -> DataFrame:
    """Every file below a folder by the reader of its suffix; files of other suffixes are left out. Only the list of
    suffixes comes to the driver."""
    readers = {**READERS, **(readers or {})}
    names = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    found = sorted(r[0] for r in names.select(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))).distinct().collect())
    out = spark.createDataFrame([], struct(DOCUMENT))
    for suffix in found:
        if suffix in readers:
            files = [r[0] for r in names.where(F.lower("path").endswith(f".{suffix}")).collect()] if suffix in ("csv", "tsv") else None
            for p in files or [f"{path.rstrip('/')}/**/*.{suffix}", f"{path.rstrip('/')}/*.{suffix}"][1:]:
                out = out.unionByName(readers[suffix](spark, p, tier=tier))
    return out


def with_path_ids(documents: DataFrame, root: str) -> DataFrame:
    """Stable ids: the path below root."""
    return documents.withColumn("doc_id", F.regexp_replace("uri", f"^(?:file:)?/*{re.escape(root.strip('/'))}/", ""))


def join_by_stem(triples: DataFrame, documents: DataFrame) -> DataFrame:
    """triples (doc) with doc_id: the document of that id, else the first (by ord, or by uri
    where there is none) whose file stem it is."""
    by_id = documents.select(F.col("doc_id").alias("doc"), F.col("doc_id").alias("_id"))
    stems = documents.withColumn("doc",
        stem_of_path(F.col("uri"))).groupBy("doc").agg(F.min_by("doc_id", "ord" if "ord" in documents.columns else "uri").alias("_stem"))
    return triples.join(by_id, "doc", "left").join(stems, "doc", "left").withColumn("doc_id", F.coalesce("_id", "_stem")).drop("_id",
        "_stem")
