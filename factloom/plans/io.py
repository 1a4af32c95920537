"""Round trips: driver tables written as files, read back by a reader or a store, and compared with themselves."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from .. import manifest, run
from ..operators import claims
from ..shared import fresh_path
from ..sinks import writers
from ..sources import readers
from ..sources.tables import table
from ..streaming import runs


def _text(c: str):
    return F.col(c).cast("string")


def _nation_files(spark, d, suffix: str, body) -> str:
    """A file for each nation, below a folder a nation, with the given content."""
    where = fresh_path(spark, f"files-{suffix}")
    n = table(spark, d, "nation").repartition(25, "n_nationkey")
    n.select(body.alias("value"), F.col("n_nationkey").alias("k")).write.partitionBy("k").text(f"{where}/parts")
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(f"{where}/parts")
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for folder in fs.listStatus(root):
        if folder.isDirectory():
            for part in fs.listStatus(folder.getPath()):
                name = part.getPath().getName()
                if name.startswith("part-"):
                    fs.mkdirs(jvm.org.apache.hadoop.fs.Path(f"{where}/docs"))
                    fs.rename(part.getPath(),
                        jvm.org.apache.hadoop.fs.Path(f"{where}/docs/n{folder.getPath().getName().split('=')[1]}.{suffix}"))
    return f"{where}/docs"


def text_files(spark, d):
    """Nations as text files, read back one document a file."""
    where = _nation_files(spark, d, "txt", F.concat(F.col("n_name"), F.lit("\nregion "), _text("n_regionkey")))
    return readers.read_text(spark, where).select(F.regexp_extract("uri", r"/(n\d+)\.txt$", 1).alias("name"),
        F.regexp_replace("text", r"\n$", "").alias("text"), "modality", "tier")


TEXT = "SELECT 'n' || n_nationkey AS name, n_name || chr(10) || 'region ' || n_regionkey AS text, 'unstructured' AS modality, 'unverified' AS tier FROM nation"


def markdown_files(spark, d):
    """Nations as Markdown: the first heading is the title, and all are listed."""
    where = _nation_files(spark, d, "md",
        F.concat(F.lit("# "), F.col("n_name"), F.lit("\n\nText.\n\n## Region "), _text("n_regionkey"), F.lit("\n")))
    x = readers.read_markdown(spark, where)
    return x.select(F.regexp_extract("uri", r"/(n\d+)\.md$", 1).alias("name"), "title",
        F.get_json_object("metadata", "$.headings[1].text").alias("second"))


MARKDOWN = "SELECT 'n' || n_nationkey AS name, n_name AS title, 'Region ' || n_regionkey AS second FROM nation"


def html_files(spark, d):
    """Nations as pages: text without markup, title from the head."""
    where = _nation_files(spark, d, "html",
        F.concat(F.lit("<html><head><title>"), F.col("n_name"), F.lit("</title></head><body><p>region <b>"), _text("n_regionkey"),
        F.lit("</b></p></body></html>")))
    return readers.read_html(spark, where).select(F.regexp_extract("uri", r"/(n\d+)\.html$", 1).alias("name"), F.trim("text").alias("text"),
        "title")


HTML = "SELECT 'n' || n_nationkey AS name, 'region ' || n_regionkey AS text, n_name AS title FROM nation"


def mixed_folder(spark, d):
    """A folder of JSON lines, TSV and files of no known kind, by the reader of each suffix."""
    where = _nation_files(spark, d, "jsonl", F.to_json(F.struct("n_nationkey", "n_name")))
    spark.createDataFrame([("n_name\tn_regionkey\nATLANTIS\t9",)], "value string").coalesce(1).write.mode("overwrite").text(f"{where}-tsv")
    return readers.read_directory(spark, where).select("modality", F.get_json_object("metadata", "$.row.n_name").alias("name"),
        F.get_json_object("metadata", "$.row.n_nationkey").cast("int").alias("k"))


MIXED = "SELECT 'structured' AS modality, n_name AS name, n_nationkey AS k FROM nation"


def _nation_table(spark, d):
    return table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")


def _rows(docs):
    return docs.select(F.get_json_object("metadata", "$.row.n_nationkey").cast("int").alias("k"),
        F.get_json_object("metadata", "$.row.n_name").alias("name"), "modality")


NATIONS = "SELECT n_nationkey AS k, n_name AS name, 'structured' AS modality FROM nation"


def _one_file(spark, df, kind: str, **options) -> str:
    where = fresh_path(spark, f"one-{kind}")
    w = df.coalesce(1).write
    for k, v in options.items():
        w = w.option(k, v)
    getattr(w, "csv" if kind == "tsv" else kind)(where)
    return where


def csv_rows(spark, d):
    return _rows(readers.read_csv(spark, _one_file(spark, _nation_table(spark, d), "csv", header=True)))


def tsv_rows(spark, d):
    return _rows(readers.read_tsv(spark, _one_file(spark, _nation_table(spark, d), "tsv", header=True, sep="\t")))


def jsonl_rows(spark, d):
    return _rows(readers.read_jsonl(spark, _one_file(spark, _nation_table(spark, d), "json")))


def parquet_rows(spark, d):
    """All orders: only the named columns are read."""
    where = fresh_path(spark, "orders")
    table(spark, d, "orders").write.parquet(where)
    x = readers.read_parquet(spark, where, ["o_orderkey", "o_orderstatus"])
    return x.select(F.get_json_object("metadata", "$.row.o_orderkey").cast("long").alias("k"),
        F.get_json_object("metadata", "$.row.o_orderstatus").alias("status"), "modality")


PARQUET = "SELECT o_orderkey AS k, o_orderstatus AS status, 'structured' AS modality FROM orders"


def json_array(spark, d):
    """Nations as one JSON array below a key, an element a document."""
    n = _nation_table(spark, d).agg(F.to_json(F.struct(F.sort_array(F.collect_list(F.struct("n_nationkey",
        "n_name"))).alias("items"))).alias("value"))
    where = fresh_path(spark, "array")
    n.coalesce(1).write.text(where)
    return _rows(readers.read_json(spark, where, "$.items"))


def triples_scan(spark, d):
    """Orders as rows of another extractor: read with the fixed schema, absent fields are null."""
    o = table(spark, d, "orders").select(F.concat(F.lit("doc"), _text("o_custkey")).alias("doc"), _text("o_orderkey").alias("subject"),
        F.lit("status").alias("predicate"), F.col("o_orderstatus").alias("object"))
    where = fresh_path(spark, "triples")
    o.write.json(where)
    return readers.read_triples(spark, where).select("doc", "subject", "predicate", "object",
        F.coalesce("object_type", F.lit("none")).alias("object_type"))


TRIPLES = "SELECT 'doc' || o_custkey AS doc, CAST(o_orderkey AS VARCHAR) AS subject, 'status' AS predicate, o_orderstatus AS object, 'none' AS object_type FROM orders"


def store_append_and_replace(spark, d):
    """Facts appended in two batches, links replaced once: what was not written is carried over, and counts add."""
    store = writers.JsonLinesStore(spark, fresh_path(spark, "store"))
    o = table(spark, d, "orders").select(_text("o_orderkey").alias("sig"), "o_orderstatus")
    store.replace(facts=o.where("o_orderstatus = 'F'"), links=_nation_table(spark, d).select(F.col("n_name").alias("source_key")))
    store.append(facts=o.where("o_orderstatus = 'O'"))
    store.append(facts=o.where("o_orderstatus = 'P'"))
    n = store.counts()
    facts = store.read("facts", "sig string, o_orderstatus string")
    return facts.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("facts")).crossJoin(
        store.read("links", "source_key string").agg(F.count(F.lit(1)).alias("links"))).withColumn("counted",
        F.lit(n["facts"]).cast("long"))


APPENDED = "SELECT o_orderstatus, count(*) AS facts, (SELECT count(*) FROM nation) AS links, (SELECT count(*) FROM orders) AS counted FROM orders GROUP BY o_orderstatus"


def store_round_trip(spark, d):
    """All orders as facts through a JSON lines store, merged with a later batch of changed ones."""
    store = writers.JsonLinesStore(spark, fresh_path(spark, "store"))
    o = table(spark, d, "orders").select(_text("o_orderkey").alias("sig"), F.col("o_orderstatus").alias("value"))
    store.replace(facts=o)
    store.merge(facts=o.where("CAST(sig AS BIGINT) % 3 = 0").withColumn("value", F.lit("changed")))
    return store.read("facts", "sig string, value string")


ROUND = "SELECT CAST(o_orderkey AS VARCHAR) AS sig, CASE WHEN o_orderkey % 3 = 0 THEN 'changed' ELSE o_orderstatus END AS value FROM orders"


def _facts(spark, d):
    o = table(spark, d, "orders")
    key = F.concat(F.lit("Order:"), _text("o_orderkey"))
    edge = o.select(claims.signature(key, F.lit("placed_by"), _text("o_custkey")).alias("sig"), key.alias("s_key"),
        F.lit("Order").alias("s_type"), F.lit("placed_by").alias("predicate"), F.lit("entity").alias("o_kind"),
                    F.concat(F.lit("Customer:"), _text("o_custkey")).alias("o_key"), F.lit("Customer").alias("o_type"),
                    F.lit(None).cast("string").alias("o_repr"))
    value = o.select(claims.signature(key, F.lit("status"), F.col("o_orderstatus")), key, F.lit("Order"), F.lit("status"), F.lit("value"),
        F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("o_orderstatus"))
    return edge.union(value).withColumn("confidence", F.lit(0.5)).withColumn("polarity", F.lit("asserted")).withColumn("qualifiers",
        F.create_map().cast("map<string,string>")).withColumn("outcome", F.lit("")).withColumn("retired_at", F.lit(None).cast("string"))


def ntriples_lines(spark, d):
    """Facts as N-Triples: five lines of a reified statement and the plain triple, by what they say."""
    x = writers.ntriples(_facts(spark, d)).select(F.regexp_extract("value", r"^(\S+) <([^>]*)>", 2).alias("p"))
    return x.groupBy(F.regexp_extract("p", r"([^#:/]+)$", 1).alias("predicate")).agg(F.count(F.lit(1)).alias("n"))


NTRIPLES = """WITH n AS (SELECT count(*) AS n FROM orders) SELECT unnest(['type', 'subject', 'predicate', 'object', 'confidence', 'placed_by', 'status']) AS predicate, unnest([2 * n, 2 * n, 2 * n, 2 * n, 2 * n, n, n]) AS n FROM n"""


def cypher_lines(spark, d):
    x = writers.cypher(_facts(spark, d))
    return x.groupBy(F.col("value").contains("-[:").alias("edge"),
        F.col("value").contains(" SET ").alias("sets")).agg(F.count(F.lit(1)).alias("n"))


CYPHER = "SELECT true AS edge, false AS sets, count(*) AS n FROM orders UNION ALL SELECT false, true, count(*) FROM orders"


def graph_csv(spark, d):
    """Nodes and relations as CSV folders, read back."""
    where = fresh_path(spark, "csv")
    c = table(spark, d, "customer").select(F.lit("Customer").alias("type"), F.concat(F.lit("Customer:"), _text("c_custkey")).alias("key"),
        F.col("c_name").alias("label"), F.lit(None).cast("string").alias("external_id"), F.col("c_custkey").alias("ord"))
    writers.write_graph_csv(c, _facts(spark, d), where)
    nodes, relations = spark.read.option("header", True).csv(f"{where}/nodes"), spark.read.option("header", True).csv(f"{where}/relations")
    return nodes.groupBy(F.col("type").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("key").alias("keys")).union(
        relations.groupBy(F.col("predicate").alias("name")).agg(F.count(F.lit(1)), F.count_distinct("start")))


GRAPH_CSV = "SELECT 'Customer' AS name, count(*) AS n, count(*) AS keys FROM customer UNION ALL SELECT 'placed_by', count(*), count(*) FROM orders"


def transactions(spark, d):
    """Orders packed by key into transactions of 500."""
    x = writers.transaction_groups(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 500)
    return x.groupBy("transaction").agg(F.count(F.lit(1)).alias("rows"), F.min("o_orderkey").alias("first"),
        F.max("o_orderkey").alias("last"))


TRANSACTIONS = "SELECT t AS transaction, count(*) AS rows, min(o_orderkey) AS first, max(o_orderkey) AS last FROM (SELECT o_orderkey, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) // 500 AS BIGINT) AS t FROM orders) GROUP BY t"


def manifest_replay(spark, d):
    """A manifest of a run over orders and nations, written, read and checked against the same inputs, fewer rows, and another ontology."""
    inputs = {"orders": table(spark, d, "orders"), "nation": table(spark, d, "nation")}
    path = fresh_path(spark, "manifest")
    manifest.write(spark, manifest.run_manifest("validate", {"a": 1}, inputs, {"facts": 3}, {"types": {}}, {"p@1": "hash"}), path)
    m = manifest.read(spark, path)
    tried = {"same": manifest.replay_problems(m, {k: v.repartition(7) for k, v in inputs.items()}, {"types": {}}),
             "fewer rows": manifest.replay_problems(m, inputs | {"nation": inputs["nation"].where("n_nationkey > 0")}, {"types": {}}),
             "ontology": manifest.replay_problems(m, inputs, {"types": {"X": {}}})}
    return spark.createDataFrame([(k, "; ".join(v)) for k, v in tried.items()], "tried string, problems string")


REPLAY = "SELECT * FROM (VALUES ('same', ''), ('fewer rows', 'input nation: changed'), ('ontology', 'ontology: changed')) v(tried, problems)"


def streamed_equals_whole(spark, d):
    """Order statuses as triples over customers as documents, validated file by file: the facts of one whole run."""
    docs = table(spark, d, "customer").select(_text("c_custkey").alias("doc_id"),
        F.concat(F.col("c_name"), F.lit(" ordered F or O or P.")).alias("text"), F.lit("file:///x").alias("uri"),
        F.lit("curated").alias("tier"))
    o = table(spark, d, "orders").select(_text("o_custkey").alias("doc"),
        F.concat(F.lit("N"), (F.col("o_custkey") % 50).cast("string")).alias("subject"), F.lit("status").alias("predicate"),
        F.col("o_orderstatus").alias("object"))
    where = fresh_path(spark, "streamed")
    o.repartition(4).write.json(f"{where}/in")
    config = run.Config(documents={"path": ""}, triples={"path": ""}, output={"path": ""})
    schema = readers.read_triples(spark, f"{where}/in").schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{where}/in")
    v = runs.StreamedValidation(spark, config, docs, f"{where}/store", 8)
    totals = v.run(rows, f"{where}/ck")
    v.run(rows, f"{where}/ck2")  # another stream over the same files adds nothing new
    kept, _ = v.facts()
    return kept.select("s_key", "predicate", "o_repr", "documents", "verdict").withColumn("rows", F.lit(totals["rows"]).cast("long"))


STREAMED = """SELECT 'Thing:n' || o_custkey % 50 AS s_key, 'status' AS predicate, o_orderstatus AS o_repr, count(DISTINCT o_custkey) AS documents, 'unchecked' AS verdict, (SELECT count(*) FROM orders) AS rows
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 3"""


def streamed_identities(spark, d):
    """Parts of even size are stored; those of odd size come as a batch and take the stored key of the same id."""
    p, k = table(spark, d, "part"), F.col("p_partkey")
    e = p.select(F.concat(F.lit("P"), F.lpad(k.cast("string"), 8, "0")).alias("key"), F.lit("Part").alias("type"),
        F.concat(F.lit("part"), k.cast("string")).alias("label"), F.array().cast("array<string>").alias("aliases"),
                 F.concat(F.lit("reg:"), F.floor(k / 2).cast("string")).alias("external_id"),
                 F.create_map().cast("map<string,string>").alias("attributes"), k.alias("k"))
    out = runs.identities(e.where("k % 2 = 1").drop("k"), e.where("k % 2 = 0").drop("k"), 100)
    return out


IDENTITIES = "SELECT 'P' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS key, 'P' || lpad(CAST(CASE WHEN p_partkey - 1 IN (SELECT p_partkey FROM part) THEN p_partkey - 1 ELSE p_partkey END AS VARCHAR), 8, '0') AS canonical FROM part WHERE p_partkey % 2 = 1"


def ontology_statements(spark, d):
    """The sink's statements of an ontology of nations, counted by kind."""
    from ..sinks import schema_text

    names = [r[0] for r in table(spark, d, "region").select("r_name").orderBy("r_name").collect()]  # five rows
    o = {"types": {n.title().replace(" ", ""): {"keys": ["name"]} for n in names}, "predicates": {}}
    return spark.createDataFrame([(json.dumps(x)[:6],) for x in schema_text.ddl(o)],
        "start string").groupBy("start").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "text_files": (text_files, TEXT), "markdown_files": (markdown_files, MARKDOWN), "html_files": (html_files, HTML),
    "mixed_folder": (mixed_folder, MIXED), "csv_rows": (csv_rows, NATIONS), "tsv_rows": (tsv_rows, NATIONS),
    "jsonl_rows": (jsonl_rows, NATIONS), "parquet_rows": (parquet_rows, PARQUET), "json_array": (json_array, NATIONS),
    "triples_scan": (triples_scan, TRIPLES), "store_append_and_replace": (store_append_and_replace, APPENDED),
    "store_round_trip": (store_round_trip, ROUND), "ntriples_lines": (ntriples_lines, NTRIPLES), "cypher_lines": (cypher_lines, CYPHER),
    "graph_csv": (graph_csv, GRAPH_CSV), "transactions": (transactions, TRANSACTIONS),
    "manifest_replay": (manifest_replay, REPLAY), "streamed_equals_whole": (streamed_equals_whole, STREAMED),
    "streamed_identities": (streamed_identities, IDENTITIES), "ontology_statements": (ontology_statements, None),
}
