"""Queries over documents, pages, benchmark passages and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import source_of
from ..operators import near_text, spans
from ..operators.components import connected_components
from ..shared import cut
from ..sources import html
from ..sources.tables import table


def _docs(spark, d):
    return table(spark, d, "documents")


def independent_support(spark, d):
    """Sources and documents behind each text that occurs more than once."""
    out = _docs(spark, d).groupBy(F.sha2("text", 256).alias("sig")).agg(F.count_distinct("source").alias("support"),
        F.count(F.lit(1)).alias("documents"), F.min("doc_id").alias("first"))
    return out.where("documents > 1").select("first", "support", "documents")


INDEPENDENT = "SELECT min(doc_id) AS first, count(DISTINCT source) AS support, count(*) AS documents FROM documents GROUP BY text HAVING count(*) > 1"


def repeated_line_support(spark, d):
    """Lines over 20 characters that two or more documents state, with their sources."""
    lines = _docs(spark, d).select("doc_id", "source", F.explode(F.split("text", "\n")).alias("line")).where("length(line) > 20")
    return lines.groupBy("line").agg(F.count_distinct("doc_id").alias("documents"),
        F.count_distinct("source").alias("support")).where("documents > 1")


REPEATED = """SELECT line, count(DISTINCT doc_id) AS documents, count(DISTINCT source) AS support
FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE length(line) > 20 GROUP BY line HAVING count(DISTINCT doc_id) > 1"""


def shingle_jaccard_pairs(spark, d):
    pairs = near_text.shingle_pairs(_docs(spark, d), 0.8)
    return pairs.select("a", "b", F.round("jaccard", 6).alias("jaccard"))


PAIRS_SQL = r"""
rep AS (SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text),
w AS (SELECT doc_id, regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{L}\p{N}_]+') AS w FROM rep),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) > 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
pairs AS (SELECT a, b, k / (p.n + q.n - k) AS jaccard FROM common JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE k / (p.n + q.n - k) >= 0.8)"""
PAIRS = f"WITH {PAIRS_SQL} SELECT a, b, round(jaccard, 6) AS jaccard FROM pairs"


def near_dup_components(spark, d):
    """Class of every document that has a near-duplicate or copy, and its number of links to other texts."""
    docs = _docs(spark, d)
    pairs = cut(near_text.shingle_pairs(docs, 0.8).select("a", "b"))
    parts = connected_components(pairs)
    links = pairs.select("a").union(pairs.select(F.col("b"))).groupBy("a").agg(F.count(F.lit(1)).alias("links"))
    classes = near_text.text_classes(docs)
    out = classes.join(parts.withColumnRenamed("node", "rep"), "rep", "left").join(links.withColumnRenamed("a", "rep"), "rep", "left")
    return out.select("doc_id", F.coalesce("component", "rep").alias("component"), F.coalesce("links", F.lit(0)).alias("links"))


COMPONENTS = f"""WITH RECURSIVE {PAIRS_SQL},
e AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
r(node, reach) AS (SELECT doc_id, doc_id FROM rep UNION SELECT r.node, e.b FROM r JOIN e ON r.reach = e.a),
c AS (SELECT node, min(reach) AS component FROM r GROUP BY node),
l AS (SELECT a, count(*) AS links FROM e GROUP BY a)
SELECT d.doc_id, component, coalesce(links, 0) AS links FROM documents d JOIN rep USING (text) JOIN c ON node = rep.doc_id LEFT JOIN l ON l.a = rep.doc_id"""


def benchmark_quote_located(spark, d):
    quotes = table(spark, d, "benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"))
    return spans.locate_quotes(_docs(spark, d), quotes).withColumnRenamed("quote_id", "item_id").select("doc_id", "item_id",
        F.col("start").cast("long"), F.col("end").cast("long"))


QUOTES = """SELECT doc_id, item_id, CAST(instr(d.text, b.text) - 1 AS BIGINT) AS start, CAST(instr(d.text, b.text) - 1 + length(b.text) AS BIGINT) AS "end"
FROM documents d JOIN benchmark b ON contains(d.text, b.text) WHERE b.text <> ''"""


def _spans(docs):
    """A good, a shifted, an empty, an out-of-range, a foreign and a missing span for every document."""
    n = F.length("text")
    start, end = F.floor(n / 4).cast("int"), F.floor(n / 2).cast("int")
    quote = F.substr("text", start + 1, end - start)
    kinds = [(start, end, quote, "doc_id"), (start + 1, end + 1, quote, "doc_id"), (start, start, F.lit(""), "doc_id"),
        (start, n + 5, quote, "doc_id"),
             (start, end, quote, "other"), (F.lit(None).cast("int"), F.lit(None).cast("int"), quote, "doc_id")]
    return docs.withColumn("other", F.col("doc_id") + 1).select("doc_id", "text", F.explode(F.array(*[
        F.struct(F.lit(k).alias("k"), s.alias("start"), e.alias("end"), q.alias("quote"), F.col(o).alias("span_doc")) for k,
        (s, e, q, o) in enumerate(kinds)])).alias("s")).select("doc_id", "text", "s.*")


def span_check_status(spark, d):
    s = _spans(_docs(spark, d))
    return s.select("doc_id", "k",
        spans.span_status(F.col("span_doc"), F.col("doc_id"), F.col("text"), F.col("start"), F.col("end"), F.col("quote")).alias("status"))


SPANS_SQL = """
b AS (SELECT doc_id, text, length(text) AS n, CAST(floor(length(text) / 4) AS INT) AS s, CAST(floor(length(text) / 2) AS INT) AS e FROM documents),
q AS (SELECT *, substring(text, s + 1, e - s) AS quote FROM b),
sp AS (SELECT doc_id, text, n, 0 AS k, s AS st, e AS en, quote, doc_id AS sd FROM q UNION ALL SELECT doc_id, text, n, 1, s + 1, e + 1, quote, doc_id FROM q
 UNION ALL SELECT doc_id, text, n, 2, s, s, '', doc_id FROM q UNION ALL SELECT doc_id, text, n, 3, s, n + 5, quote, doc_id FROM q
 UNION ALL SELECT doc_id, text, n, 4, s, e, quote, doc_id + 1 FROM q UNION ALL SELECT doc_id, text, n, 5, NULL, NULL, quote, doc_id FROM q)"""
SPAN_CASE = """CASE WHEN st IS NULL OR en IS NULL THEN 'no_span' WHEN sd <> doc_id THEN 'foreign' WHEN st < 0 OR en > n OR st > en THEN 'out_of_range'
 WHEN st = en THEN 'empty' WHEN substring(text, st + 1, en - st) <> quote THEN 'quote_mismatch' ELSE 'located' END"""
SPANS = f"WITH {SPANS_SQL} SELECT doc_id, k, {SPAN_CASE} AS status FROM sp"


def span_grounding(spark, d):
    """One fact per document, with the spans of span_check_status as evidence for every second document."""
    docs = _docs(spark, d)
    ev = _spans(docs.where("doc_id % 2 = 0")).where("span_doc = doc_id AND k > 0 OR doc_id % 4 = 0 AND k = 0").select(F.col("doc_id").alias("fact_id"),
        "doc_id", "start", "end", "quote")
    facts = docs.select(F.col("doc_id").alias("fact_id"),
        F.when(F.col("doc_id") % 5 == 0, "supported").otherwise("unchecked").alias("verdict"))
    return spans.ground_by_span(facts, ev, docs)


GROUND = f"""WITH {SPANS_SQL}, c AS (SELECT doc_id, {SPAN_CASE} AS status FROM sp WHERE doc_id % 2 = 0 AND (sd = doc_id AND k > 0 OR doc_id % 4 = 0 AND k = 0)),
g AS (SELECT doc_id, count(*) FILTER (status = 'located') AS located, count(*) FILTER (status IN ('out_of_range', 'empty', 'quote_mismatch')) AS rejected FROM c GROUP BY doc_id)
SELECT d.doc_id AS fact_id, CASE WHEN d.doc_id % 5 = 0 THEN 'supported' WHEN coalesce(located, 0) = 0 THEN 'not_found' ELSE 'unchecked' END AS verdict,
 coalesce(located, 0) AS located, coalesce(rejected, 0) AS rejected FROM documents d LEFT JOIN g ON g.doc_id = d.doc_id"""


def span_width_by_verdict(spark, d):
    """Widths of the middle quarter of each text by its label: n, quartiles (inclusive, linear), extremes."""
    w = _docs(spark, d).join(table(spark, d, "labels"), "doc_id").select("quality",
        (F.floor(F.length("text") / 2) - F.floor(F.length("text") / 4)).alias("w"))
    p = F.percentile("w", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return w.groupBy("quality").agg(F.count(F.lit(1)).alias("n"), F.min("w").alias("low"), p.alias("p"), F.max("w").alias("high")).select(
        "quality", "n", "low", *[F.col("p")[k].alias(x) for k, x in enumerate(("p25", "median", "p75"))], "high")


WIDTHS = """WITH w AS (SELECT quality, CAST(floor(length(text) / 2) - floor(length(text) / 4) AS BIGINT) AS w FROM documents JOIN labels USING (doc_id))
SELECT quality, count(*) AS n, min(w) AS low, quantile_cont(w, 0.25) AS p25, quantile_cont(w, 0.5) AS median, quantile_cont(w, 0.75) AS p75, max(w) AS high FROM w GROUP BY quality"""


def chunk_pack(spark, d):
    """Sentence-aware chunks of at most 200 words."""
    c = spans.chunks(_docs(spark, d))
    return c.select("doc_id", "idx", "start", "end", F.size(F.split("text", r"(?U)\s+")).cast("long").alias("words"))


def sentence_split(spark, d):
    return spans.sentences(_docs(spark, d)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("sentences"), F.max("words").alias("longest"),
        F.count_if("opens").alias("paragraphs"))


def html_to_text(spark, d):
    return html.html_documents(table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.col("url").alias("uri"), "html")).select(
        "doc_id", "title", "modality", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def html_links_headings(spark, d):
    """Links, paragraphs and the first heading of each page, by pattern."""
    p = table(spark, d, "pages")
    return p.select("page_id", F.regexp_count("html", F.lit(r"<a\s")).cast("long").alias("links"),
        F.regexp_count("html", F.lit(r"<p>")).cast("long").alias("paragraphs"),
                    F.regexp_extract("html", r"<h1>([^<]*)</h1>", 1).alias("heading"))


LINKS = r"""SELECT page_id, CAST(len(regexp_extract_all(html, '<a\s')) AS BIGINT) AS links, CAST(len(regexp_extract_all(html, '<p>')) AS BIGINT) AS paragraphs, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS heading FROM pages"""


def url_domain_blocks(spark, d):
    """Pages of each host without www.: the source that independent support counts."""
    p = table(spark, d, "pages").select(source_of(F.col("url"), F.col("page_id")).alias("source"), "page_id")
    return p.groupBy("source").agg(F.count(F.lit(1)).alias("pages"), F.min("page_id").alias("first"))


HOSTS = r"""SELECT coalesce(nullif(regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)', 1)), '^www\.', ''), ''), 'doc:' || page_id) AS source, count(*) AS pages, min(page_id) AS first FROM pages GROUP BY 1"""


def conversation_turn_routes(spark, d):
    """Turns of a conversation as chunks; a system turn after the first stops the document."""
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("idx"),
                                                F.when(F.length("text") > 700, "skip").otherwise("extract").alias("action"),
                                                F.when((F.length("text") > 700) & (F.col("role") == "user"),
                                                "document").otherwise("chunk").alias("scope"))
    return spans.route_chunks(c)


ROUTES = """WITH c AS (SELECT conv_id AS doc_id, turn AS idx, CASE WHEN length(text) > 700 THEN 'skip' ELSE 'extract' END AS action,
 CASE WHEN length(text) > 700 AND role = 'user' THEN 'document' ELSE 'chunk' END AS scope FROM conversations)
SELECT c.* FROM c LEFT JOIN (SELECT doc_id, min(idx) AS stop FROM c WHERE scope = 'document' AND action <> 'extract' GROUP BY doc_id) s USING (doc_id) WHERE stop IS NULL OR idx <= stop"""


def interleave_order(spark, d):
    """Round robin over languages, then sources, then documents by a content hash: the place of each document."""
    docs = _docs(spark, d).select("doc_id", "lang", "source", F.sha2("text", 256).alias("k"))
    within = docs.withColumn("a", F.row_number().over(Window.partitionBy("lang", "source").orderBy("k", "doc_id")))
    return within.withColumn("b", F.row_number().over(Window.partitionBy("lang").orderBy("a", "source"))).select("doc_id", "lang", "a", "b")


INTERLEAVE = """WITH w AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY sha256(text), doc_id) AS a FROM documents)
SELECT doc_id, lang, a, row_number() OVER (PARTITION BY lang ORDER BY a, source) AS b FROM w"""


def stratified_quota_sample(spark, d):
    """80 documents in proportion to the languages, by largest remainder; in a language by content hash."""
    docs = _docs(spark, d).select("doc_id", "lang", F.sha2("text", 256).alias("k"))
    sizes = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    total = sizes.agg(F.sum("n").alias("total"))
    q = sizes.crossJoin(F.broadcast(total)).withColumn("exact", F.lit(80.0) * F.col("n") / F.col("total")).withColumn("base",
        F.floor("exact"))
    left = q.agg((F.lit(80) - F.sum("base")).alias("left"))
    q = q.withColumn("place", F.row_number().over(Window.orderBy(F.desc(F.col("exact") - F.col("base")),
        "lang"))).crossJoin(F.broadcast(left))
    quota = q.select("lang", (F.col("base") + F.when(F.col("place") <= F.col("left"), 1).otherwise(0)).alias("quota"))
    ranked = docs.withColumn("rn", F.row_number().over(Window.partitionBy("lang").orderBy("k", "doc_id")))
    return ranked.join(F.broadcast(quota), "lang").where("rn <= quota").select("lang", "doc_id", F.col("quota").cast("long").alias("quota"))


QUOTA = """WITH s AS (SELECT lang, count(*) AS n, 80.0::DOUBLE * count(*) / (SELECT count(*) FROM documents) AS exact FROM documents GROUP BY lang),
b AS (SELECT *, floor(exact) AS base, row_number() OVER (ORDER BY exact - floor(exact) DESC, lang) AS place FROM s),
q AS (SELECT lang, CAST(base + CASE WHEN place <= 80 - (SELECT sum(base) FROM b) THEN 1 ELSE 0 END AS BIGINT) AS quota FROM b),
r AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256(text), doc_id) AS rn FROM documents)
SELECT lang, doc_id, quota FROM r JOIN q USING (lang) WHERE rn <= quota"""


def pool_relative_recall(spark, d):
    """Each source as a run and each repeated line as a claim: share of the pool and claims of one run only."""
    claims = _docs(spark, d).select("source", F.explode(F.split("text", "\n")).alias("line")).where("length(line) > 20").distinct()
    runs = claims.groupBy("line").agg(F.count(F.lit(1)).alias("runs"))
    pool = runs.agg(F.count(F.lit(1)).alias("pool"))
    return claims.join(runs, "line").groupBy("source").agg(F.count(F.lit(1)).alias("found"),
        F.count_if(F.col("runs") == 1).alias("only_here")).crossJoin(
        F.broadcast(pool)).select("source", "found", "only_here", F.round(F.col("found") / F.col("pool"), 6).alias("share"))


POOL = """WITH c AS (SELECT DISTINCT source, line FROM (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE length(line) > 20),
r AS (SELECT line, count(*) AS runs FROM c GROUP BY line)
SELECT source, count(*) AS found, count(*) FILTER (runs = 1) AS only_here, round(count(*) / (SELECT count(*) FROM r), 6) AS share FROM c JOIN r USING (line) GROUP BY source"""


def spread_examples(spark, d):
    """First five distinct lines of each language, one per document before any second."""
    lines = _docs(spark, d).select("lang", "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = lines.withColumn("turn", F.row_number().over(Window.partitionBy("lang", "doc_id").orderBy("pos")))
    firsts = lines.groupBy("lang", "line").agg(F.min(F.struct("turn", "doc_id")).alias("x"))
    ranked = firsts.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("x.turn", "x.doc_id", "line")))
    return ranked.where("place <= 5").select("lang", "place", F.col("x.doc_id").alias("doc_id"), "line")


SPREAD = """WITH l AS (SELECT lang, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS turn FROM documents),
f AS (SELECT lang, line, min((turn, doc_id)) AS x FROM l GROUP BY lang, line),
r AS (SELECT lang, line, x[2] AS doc_id, row_number() OVER (PARTITION BY lang ORDER BY x[1], x[2], line) AS place FROM f)
SELECT lang, place, doc_id, line FROM r WHERE place <= 5"""

QUERIES = {
    "independent_support": (independent_support, INDEPENDENT),
    "repeated_line_support": (repeated_line_support, REPEATED),
    "shingle_jaccard_pairs": (shingle_jaccard_pairs, PAIRS),
    "near_dup_components": (near_dup_components, COMPONENTS),
    "benchmark_quote_located": (benchmark_quote_located, QUOTES),
    "span_check_status": (span_check_status, SPANS),
    "span_grounding": (span_grounding, GROUND),
    "span_width_by_verdict": (span_width_by_verdict, WIDTHS),
    "chunk_pack": (chunk_pack, None),
    "sentence_split": (sentence_split, None),
    "html_to_text": (html_to_text, None),
    "html_links_headings": (html_links_headings, LINKS),
    "url_domain_blocks": (url_domain_blocks, HOSTS),
    "conversation_turn_routes": (conversation_turn_routes, ROUTES),
    "interleave_order": (interleave_order, INTERLEAVE),
    "stratified_quota_sample": (stratified_quota_sample, QUOTA),
    "pool_relative_recall": (pool_relative_recall, POOL),
    "spread_examples": (spread_examples, SPREAD),
}
