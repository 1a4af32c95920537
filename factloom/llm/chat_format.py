"""Chat formatting with a grammar round trip.

Grammar of the output, for each turn in order:

    turn := "<s>[" label mark "] " body "</s>"      mark := "" | "!"      body holds neither "<s>[" nor "</s>"

A turn is rendered raw first. A deterministic parser (one regular expression) reads every turn back
from the rendered text; where a conversation does not come back identical, the texts that hold a control string
(the start of a turn or its end) are escaped (mark "!") and it is rendered and parsed again; should it still
differ, all its turns are escaped. Escaping writes ~ < [ as ~0 ~1 ~2, so an escaped body holds no control string,
and the third rendering is identical for any text. Labels are always escaped (~3 ~4 for ] !).

Everything is DataFrame functions over one array of turns per conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

START, END = "<s>[", "</s>"
#: The possessive group runs in a loop, whatever the length of a body.
PARSER = r"<s>\[([^\]!]*)(!?)\] ((?:[^<]++|<(?!s>\[|/s>))*+)</s>"
_BODY = (("~", "~0"), ("<", "~1"), ("[", "~2"))
_LABEL = (*_BODY, ("]", "~3"), ("!", "~4"))


def _escape(c: Column, pairs=_BODY) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _unescape(c: Column, pairs=_BODY) -> Column:
    for a, b in reversed(pairs):
        c = F.replace(c, F.lit(b), F.lit(a))
    return c


def _turn(t: Column, escaped: Column) -> Column:
    return F.concat(F.lit("<s>["), _escape(t["role"], _LABEL), F.when(escaped, F.lit("!] ")).otherwise(F.lit("] ")),
                    F.when(escaped, _escape(t["text"])).otherwise(t["text"]), F.lit(END))


def _render(escaped) -> Column:
    return F.array_join(F.transform("turns", lambda t: _turn(t, escaped(t))), "")


def _parse(text: str) -> Column:
    """Array of struct(role, text, escaped, body, at): at counts the code points before the body."""
    label, mark, body = (F.regexp_extract_all(text, F.lit(PARSER), F.lit(k)) for k in (1, 2, 3))
    return F.transform(F.arrays_zip(label.alias("l"), mark.alias("m"), body.alias("b")), lambda x: F.struct(
        _unescape(x["l"], _LABEL).alias("role"),
        F.when(x["m"] == "!", _unescape(x["b"])).otherwise(x["b"]).alias("text"),
        (x["m"] == "!").alias("escaped"), x["b"].alias("body"),
        (F.length(x["l"]) + F.length(x["m"]) + F.lit(6)).alias("lead")))


def _same(parsed: str) -> Column:
    return F.transform(parsed, lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))) == F.col("turns")


def format_chat(rows: DataFrame, mask_role: str = "assistant") -> DataFrame:
    """Rows (conv_id, turn, role, text, any other columns) -> one row per conversation: conv_id,
    formatted, turns read back (role, text, escaped), loss_spans (start, length in code points of
    each mask_role body in formatted), level (0 raw, 1 conflicts escaped, 2 all escaped).

    Turns are ordered by (turn, role, text), nulls first; repeated rows are turns of their own.
    Null role or text is the empty string; a null conv_id is a conversation of its own. An empty
    table gives no rows, other columns do not matter, and texts of any length are kept whole. A conversation is one
    output value, so its turns meet in one task.
    """
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(
        "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))).alias("t"))
    turns = turns.select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))
    no, conflict, yes = (lambda t: F.lit(False)), (lambda t: F.contains(t["text"], F.lit(START)) | F.contains(t["text"],
        F.lit(END))), (lambda t: F.lit(True))
    step = turns.withColumn("f0", _render(no)).withColumn("p0", _parse("f0")).withColumn("ok0", _same("p0"))
    # a later rendering is made only for conversations that need it
    step = step.withColumn("f1", F.when(~F.col("ok0"), _render(conflict))).withColumn("p1", F.when(~F.col("ok0"), _parse("f1")))
    step = step.withColumn("ok1", F.coalesce(_same("p1"), F.lit(False)))
    last = ~F.col("ok0") & ~F.col("ok1")
    step = step.withColumn("f2", F.when(last, _render(yes))).withColumn("p2", F.when(last, _parse("f2")))

    def pick(x: str) -> Column:
        return F.when(F.col("ok0"), F.col(f"{x}0")).when(F.col("ok1"), F.col(f"{x}1")).otherwise(F.col(f"{x}2"))

    out = step.select("conv_id", pick("f").alias("formatted"), pick("p").alias("parsed"),
                      F.when(F.col("ok0"), 0).when(F.col("ok1"), 1).otherwise(2).alias("level"))
    # starts are running lengths: "<s>[" + label + mark + "] " + body + "</s>"
    places = F.aggregate("parsed",
        F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<struct<start:int,length:int>>)").alias("spans")),
                         lambda acc, x: F.struct(
                             (acc["at"] + x["lead"] + F.length(x["body"]) + F.lit(len(END))).alias("at"),
                             F.when(x["role"] == mask_role, F.array_append(acc["spans"], F.struct(
                                 (acc["at"] + x["lead"]).alias("start"),
                                 F.length(x["body"]).alias("length")))).otherwise(acc["spans"]).alias("spans")),
                         lambda acc: acc["spans"])
    return out.withColumn("loss_spans", places).select(
        "conv_id", "formatted",
        F.transform("parsed", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"),
        x["escaped"].alias("escaped"))).alias("turns"),
        "loss_spans", "level")


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and conversation -1 whose texts hold control strings, formatted and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql("""SELECT CAST(-1 AS BIGINT) AS conv_id, CAST(t AS BIGINT) AS turn, r AS role, '</s>[INST] ok [/INST]' AS text
                         FROM VALUES (0, 'user'), (1, 'assistant') AS v(t, r)""")
    out = format_chat(rows.unionByName(extra))
    masked = F.filter("turns", lambda t: t["role"] == "assistant")
    # the masked text itself, cut out of the formatted text at the spans
    loss = F.array_join(F.transform("loss_spans", lambda s, i: F.when(
        F.element_at(F.col("masked"), i + 1)["escaped"], _unescape(F.substr("formatted", s["start"] + 1, s["length"])))
        .otherwise(F.substr("formatted", s["start"] + 1, s["length"]))), "")
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.withColumn("masked", masked).withColumn("loss", loss).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


SQL = """
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
t AS (
  SELECT *, contains(text, '</s>') OR contains(text, '<s>[') AS esc, length(text) - length(replace(replace(replace(text, '~', ''), '<', ''), '[', '')) AS extra,
    length(role) + length(role) - length(replace(replace(replace(replace(replace(role, '~', ''), '<', ''), '[', ''), ']', ''), '!', '')) AS label
  FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(10 + label + length(text) + CASE WHEN esc THEN 1 + extra ELSE 0 END) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
