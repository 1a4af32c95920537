"""Names, blocks, links and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import resolve as R
from ..sources.tables import table


def name_keys(spark, d):
    """Name key and entity key of every supplier and customer, with a legal form stuck on."""
    form = F.element_at(F.array(*map(F.lit, (" Inc", ", Ltd.", " GmbH & Co", ""))), (F.col("k") % 4 + 1).cast("int"))
    s = table(spark, d, "supplier").select(F.lit("Supplier").alias("t"), F.col("s_suppkey").alias("k"), F.col("s_name").alias("n"))
    c = table(spark, d, "customer").select(F.lit("Customer").alias("t"), F.col("c_custkey").alias("k"), F.col("c_name").alias("n"))
    x = s.union(c).withColumn("name", F.concat(F.lit("The "), F.col("n"), form))
    return x.select("t", "k", X.name_key(F.col("name")).alias("name_key"), X.legal_form(F.col("name")).alias("legal_form"),
        X.entity_key(F.col("t"), F.col("name")).alias("entity_key"))


NAME_KEYS = r"""WITH x AS (SELECT 'Supplier' AS t, s_suppkey AS k, s_name AS n FROM supplier UNION ALL SELECT 'Customer', c_custkey, c_name FROM customer),
y AS (SELECT t, k, 'The ' || n || [' Inc', ', Ltd.', ' GmbH & Co', ''][k % 4 + 1] AS name FROM x),
z AS (SELECT *, array_to_string(regexp_extract_all(replace(replace(lower(strip_accents(name)), 'ß', 'ss'), '&', ' and '), '[\p{L}\p{N}]+'), ' ') AS w FROM y)
SELECT t, k, regexp_replace(regexp_replace(w, '^the (.)', '\1'), '( (inc|ltd|gmbh|co))+$', '') AS name_key, CASE k % 4 WHEN 0 THEN 'inc' WHEN 1 THEN 'ltd' WHEN 2 THEN 'co' END AS legal_form,
t || ':' || regexp_replace(lower(name), '[^\p{L}\p{N}]+$', '') AS entity_key FROM z"""


def _people(spark, d):
    """Part names as entities with an id, a host and a country for some."""
    p = table(spark, d, "part").select(F.concat(F.lit("Part:"), F.col("p_partkey").cast("string")).alias("key"),
        F.col("p_brand").alias("type"), F.col("p_name").alias("label"), "p_partkey", "p_size")
    k = F.col("p_partkey")
    return p.select("key", "type", "label",
        F.when(k % 50 == 0, F.array(F.concat(F.lit("https://www.brand"), (k % 7).cast("string"),
        F.lit(".example.com/")))).otherwise(F.array().cast("array<string>")).alias("aliases"),
                    F.when(k % 40 == 0, F.concat(F.lit("reg: "), (k % 60).cast("string"))).alias("external_id"),
                    F.create_map(F.lit("country"), (F.col("p_size") % 5).cast("string")).alias("attributes"))


def blocked_pairs_names(spark, d):
    """Pairs of entities that share a block, with the rule for blocks of more than 100 rows."""
    return R.candidate_pairs(R.profiles(_people(spark, d)))


BLOCKS = r"""WITH e AS (SELECT 'Part:' || p_partkey AS key, p_brand AS type, p_partkey AS k, array_to_string(regexp_extract_all(lower(p_name), '[\p{L}\p{N}]+'), ' ') AS w, CAST(p_size % 5 AS VARCHAR) AS country FROM part),
b AS (SELECT key, type, country, 'name' AS kind, unnest(list_distinct([string_split(w, ' ')[1], string_split(w, ' ')[-1]])) AS block FROM e
 UNION ALL SELECT key, type, country, 'domain', 'brand' || k % 7 || '.example.com' FROM e WHERE k % 50 = 0 UNION ALL SELECT key, type, country, 'id', 'reg:' || k % 60 FROM e WHERE k % 40 = 0),
s AS (SELECT *, count(*) OVER (PARTITION BY type, kind, block) AS n, min(key) OVER (PARTITION BY type, kind, block) AS first, count(*) OVER (PARTITION BY type, kind, block, country) AS m FROM b),
r AS (SELECT type, kind, block, '' AS part, key FROM s WHERE n <= 100 UNION ALL SELECT type, kind, block, '=' || country, key FROM s WHERE n > 100 AND kind = 'name' AND m <= 100)
SELECT DISTINCT x.key AS a, y.key AS b FROM r x JOIN r y USING (type, kind, block, part) WHERE x.key < y.key
UNION SELECT first, key FROM s WHERE n > 100 AND kind <> 'name' AND key <> first"""


def token_overlap_scores(spark, d):
    """Word overlap of the distinct part names with each other."""
    n = table(spark, d, "part").select(X.name_key(F.col("p_name")).alias("n")).distinct()
    a, b = n.select(F.col("n").alias("a")), n.select(F.col("n").alias("b"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.round(X.token_overlap(F.col("a"), F.col("b")), 6).alias("overlap"))


OVERLAP = r"""WITH n AS (SELECT DISTINCT array_to_string(regexp_extract_all(lower(p_name), '[\p{L}\p{N}]+'), ' ') AS n FROM part),
p AS (SELECT x.n AS a, y.n AS b, string_split(x.n, ' ') AS u, string_split(y.n, ' ') AS v FROM n x JOIN n y ON x.n < y.n)
SELECT a, b, round(len(list_intersect(u, v)) / (len(u) + len(v) - len(list_intersect(u, v))), 6) AS overlap FROM p"""


def _links(spark, d):
    p = R.profiles(_people(spark, d))
    return R.judge(R.candidate_pairs(p), p), p


def name_similarity_links(spark, d):
    links, _ = _links(spark, d)
    return links.where("kind IS NOT NULL")


def resolve_rekey(spark, d):
    """Line items' parts re-keyed to the canonical part of their component, and how many lines each then has."""
    links, p = _links(spark, d)
    mapping = R.merge_components(links, p)
    facts = table(spark, d, "lineitem").select(F.concat(F.lit("Part:"), F.col("l_partkey").cast("string")).alias("s_key"),
        F.lit("").alias("o_key"))
    return R.rekey(facts, mapping).groupBy("s_key").agg(F.count(F.lit(1)).alias("facts"))


def nearest_vectors_k(spark, d):
    """The five nearest by cosine, of one label, for every row whose id is divisible by 20."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("v"), "label")
    return R.nearest_vectors(v, v.where("key % 20 = 0"), 5, ["label"]).select("probe", "key", F.col("rank").cast("long").alias("rank"),
        F.round("cosine", 6).alias("cosine"))


NEAREST = """WITH p AS (SELECT a.vec_id AS probe, b.vec_id AS key, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS c FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY c DESC, key) AS rank FROM p) SELECT probe, key, rank, round(c, 6) AS cosine FROM r WHERE rank <= 5"""


def context_cosine_gate(spark, d):
    """Cosine of each vector with the next id's; pairs below 0.1 stay two."""
    from ..functions.values import cosine

    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    n = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("e2"))
    c = cosine(F.col("embedding"), F.col("e2"))
    return v.join(n, "vec_id").select("vec_id", F.round(c, 6).alias("cosine"), (c >= 0.1).alias("kept"))


GATE = """SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.1 AS kept
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"""

QUERIES = {
    "name_keys": (name_keys, NAME_KEYS), "blocked_pairs_names": (blocked_pairs_names, BLOCKS),
    "token_overlap_scores": (token_overlap_scores, OVERLAP),
    "name_similarity_links": (name_similarity_links, None), "resolve_rekey": (resolve_rekey, None),
    "nearest_vectors_k": (nearest_vectors_k, NEAREST),
    "context_cosine_gate": (context_cosine_gate, GATE),
}
