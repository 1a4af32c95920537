"""Line deduplication by a log-template tree.

The tree has a fixed depth. Its first level is a line's token count, the next DEPTH levels are its leading tokens, in
which every token with a digit is the variable <*>. A leaf holds templates: a line of MIN_WILD tokens or more
joins a template of its leaf when all but one of SEGMENTS contiguous parts of the remaining tokens agree, which is a
similarity of at least (SEGMENTS - 1) / SEGMENTS of the tokens below the prefix; the part that differs becomes the
template's variable field, <*>. Shorter lines join the template of their masked tokens.

Instead of growing templates one line at a time, which is one task a leaf, each line looks up the SEGMENTS
templates that it could join: the path in the tree (count, leading tokens), the part that is variable and the tokens of
the others, together one key of 128 bits. Two lines share a key exactly when both lie in one leaf and fit one
template, so an aggregation by key is the tree, spread over all tasks. templates() gives the templates themselves.

A template seen in two or more documents recurs: it stays in the document with the smallest doc_id
and is dropped from the others. Statistics per template are a smallest and a largest doc_id, so
partial aggregation absorbs a line that a third of all rows share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table, written

DEPTH, SEGMENTS, MIN_WILD = 3, 4, 8


def masked(lines: DataFrame) -> DataFrame:
    """lines (line, others) with w: its tokens, each with a digit as <*>, joined by single spaces, and
    n, their number; without blank lines. A step is a column of its own, so that each is computed once."""
    out = lines.withColumn("w", F.trim("line")).drop("line")
    out = out.withColumn("w", F.when(F.rlike("w", F.lit(r"[\t\r\x0b\f]|  ")),
        F.trim(F.regexp_replace("w", r"\s+", " "))).otherwise(F.col("w"))).where("w != ''")
    out = out.withColumn("w", F.when(F.rlike("w", F.lit(r"\d")),
        F.regexp_replace("w", r"(?<!\S)[^\s\d]*+\d\S*", "<*>")).otherwise(F.col("w")))
    return out.withColumn("n", F.length("w") - F.length(F.replace("w", F.lit(" "), F.lit(""))) + 1)


def _parts(lines: DataFrame) -> DataFrame:
    """lines (w, n, others) with the tokens before each part, p0.., and behind it, s0..; null for short lines."""
    n = F.col("n")

    def bound(s: int) -> Column:
        return F.lit(DEPTH) + F.floor((n - DEPTH) * s / SEGMENTS).cast("int")

    def tokens(count: Column) -> Column:  # the first tokens, or the last if negative
        return F.call_function("substring_index", F.col("w"), F.lit(" "), count)

    long = n >= MIN_WILD
    rest = [c for c in lines.columns if c not in ("w", "n")]
    return lines.select(*rest, "w", "n", *[F.when(long, tokens(bound(s))).alias(f"p{s}") for s in range(SEGMENTS)],
                        *[F.when(long, tokens(bound(s + 1) - n)).alias(f"s{s}") for s in range(SEGMENTS - 1)])


def _sides(s: int) -> list[str]:
    return [f"p{s}", *([f"s{s}"] if s < SEGMENTS - 1 else [])]


def template_keys(lines: DataFrame) -> DataFrame:
    """lines (w, n, others) -> a row for each template that a line can belong to, keys k1 and k2.

    Lines of MIN_WILD tokens or more have a key for each part left out; equal lines share them all.
    """
    n = F.col("n")

    def key(kind: int, *parts) -> Column:
        return F.struct(*(F.xxhash64(F.lit(seed), n, F.lit(kind), *parts).alias(k) for k, seed in (("k1", 1), ("k2", 2))))

    rest = [c for c in lines.columns if c not in ("w", "n")]
    wild = F.array(*[key(s, *_sides(s)) for s in range(SEGMENTS)])
    return _parts(lines).select(*rest,
        F.explode(F.when(n >= MIN_WILD, wild).otherwise(F.array(key(SEGMENTS, "w")))).alias("k")).select(*rest, "k.k1", "k.k2")


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, h (a hash of the text: rows of one id need not be alike), pos, line; rows without doc_id are left out."""
    return docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64("text").alias("h"),
        F.posexplode(F.split("text", "\n")).alias("pos", "line"))


def templates(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, others) -> the templates that recur: tokens (their number), template (<*> for tokens with a digit
    and for the part that differs), first_doc, last_doc, lines. A template whose lines are all alike is written out whole."""
    lines = _parts(masked(_lines(docs)))
    wild = [F.struct(F.lit(s).alias("kind"),
        F.concat_ws(" ", f"p{s}", F.lit("<*>"), *(_sides(s)[1:])).alias("general")) for s in range(SEGMENTS)]
    short = F.array(F.struct(F.lit(SEGMENTS).alias("kind"), F.col("w").alias("general")))
    each = lines.select("doc_id", "n", "w", F.explode(F.when(F.col("n") >= MIN_WILD, F.array(*wild)).otherwise(short)).alias("t"))
    found = each.groupBy("n", "t").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"),
        F.count(F.lit(1)).alias("lines"),
                                       F.min("w").alias("low"), F.max("w").alias("high")).where("first_doc < last_doc")
    out = found.select(F.col("n").alias("tokens"),
        F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.col("t.general")).alias("template"),
                       "first_doc", "last_doc", "lines")
    return out.distinct()


def dropped_lines(docs: DataFrame) -> DataFrame:
    """doc_id, h (of the text), dropped: array of the positions (from 0) of the lines to drop; only where some are.

    The keys are read twice, for the statistics and for the lines, so they are written once, as a
    table in the shared folder.
    """
    keys = written(template_keys(masked(_lines(docs))), "line-keys")
    recurring = keys.groupBy("k1", "k2").agg(F.min("doc_id").alias("first"),
        F.max("doc_id").alias("last")).where("first < last").drop("last")
    return (keys.join(recurring, ["k1", "k2"]).where("doc_id > first").groupBy("doc_id", "h")
            .agg(F.sort_array(F.collect_set("pos")).alias("dropped")))


def line_dedup(docs: DataFrame) -> DataFrame:
    """All columns of docs (doc_id, text, others) with recurring lines cut out of text, and
    n_lines, n_dropped (columns of docs by these names are replaced).

    Lines end at \\n; the others stay byte for byte and in order. Blank lines are never dropped.
    Null text stays null with no lines; rows with a null doc_id stay as they are. Rows that repeat
    a doc_id count as one document: their lines do not recur by that alone; each row loses its own lines only. An
    empty table gives no rows.
    """
    docs = docs.drop("n_lines", "n_dropped")
    dropped = dropped_lines(docs.select("doc_id", "text")).select("doc_id", F.col("h").alias("_fl_h"),
        F.col("dropped").alias("_fl_dropped"))
    out = docs.withColumn("_fl_h", F.xxhash64("text")).join(dropped, ["doc_id", "_fl_h"], "left").withColumn("_fl_lines",
        F.split("text", "\n"))
    out = out.withColumn("_fl_n", F.when(F.col("text").isNull(), 0).otherwise(F.size("_fl_lines")))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.col("_fl_n") - 1), F.col("_fl_dropped")), lambda i: F.get("_fl_lines", i))
    text = F.when(F.col("_fl_dropped").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return out.select(*[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns],
        F.col("_fl_n").cast("long").alias("n_lines"),
                      F.when(F.col("_fl_dropped").isNull(), 0).otherwise(F.size("_fl_dropped")).cast("long").alias("n_dropped"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its recurring lines: counts and digest of what is left."""
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars_kept"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS pos FROM d),
t AS (SELECT doc_id, pos, regexp_split_to_array(regexp_replace(regexp_replace(line, '^\s+|\s+$', '', 'g'), '\S*\d\S*', '<*>', 'g'), '\s+') AS w FROM l WHERE regexp_matches(line, '\S')),
s AS (SELECT doc_id, pos, w, len(w) AS n, unnest(CASE WHEN len(w) >= 8 THEN [0, 1, 2, 3] ELSE [4] END) AS kind FROM t),
b AS (SELECT *, 3 + CAST(floor((n - 3) * kind / 4.0) AS INT) AS lo, 3 + CAST(floor((n - 3) * (kind + 1) / 4.0) AS INT) AS hi FROM s),
k AS (SELECT doc_id, pos, n || ' ' || kind || ' ' || CASE WHEN kind = 4 THEN array_to_string(w, ' ')
        ELSE array_to_string(list_slice(w, 1, lo), ' ') || ' | ' || array_to_string(list_slice(w, hi + 1, n), ' ') END AS key FROM b),
r AS (SELECT key, min(doc_id) AS first FROM k GROUP BY key HAVING min(doc_id) < max(doc_id)),
x AS (SELECT DISTINCT doc_id, pos FROM k JOIN r USING (key) WHERE doc_id > first),
o AS (SELECT l.doc_id, count(*) AS n_lines, count(x.pos) AS n_dropped, string_agg(CASE WHEN x.pos IS NULL THEN line END, chr(10) ORDER BY l.pos) AS kept
      FROM l LEFT JOIN x ON l.doc_id = x.doc_id AND l.pos = x.pos GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, length(coalesce(kept, '')) AS n_chars_kept, sha256(coalesce(kept, '')) AS text_sha256
FROM d LEFT JOIN o USING (doc_id)
"""
