"""Operators on small fixtures: edge cases that the tables do not hold."""

import difflib
import json

import pytest
from pyspark.sql import functions as F

from factloom.eval import metrics as M
from factloom.functions import stats as S
from factloom.functions import text as X
from factloom.functions import values as V
from factloom.operators import claims as C
from factloom.operators import extract as E
from factloom.operators import infer as I
from factloom.operators import ontology as O
from factloom.operators import resolve as R
from factloom.operators import spans
from factloom.operators.components import connected_components
from factloom.operators.near_text import shingle_pairs


def values(spark, texts, *exprs):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    return [tuple(r)[1:] for r in df.select("k", *exprs).orderBy("k").collect()]


@pytest.mark.parametrize("text, key, form", [
    ("Acme, Inc.", "acme", "inc"), ("ACME Corporation Ltd", "acme", "ltd"), ("The Limited", "limited", "ltd"),
    ("Société Générale S.A.", "societe generale", "sa"),
    ("Smith & Sons", "smith and sons", None), ("Straße GmbH", "strasse", "gmbh"), ("I.B.M. Company", "ibm", "co"), ("", "", None)])
def test_names(spark, text, key, form):
    assert values(spark, [text], X.name_key(F.col("t")), X.legal_form(F.col("t"))) == [(key, form)]


def test_person_names(spark):
    got = values(spark, ["Lovelace, Ada", "Dr. J. Smith Jr.", "Sir"], X.name_key(F.col("t"), person=True))
    assert got == [("ada lovelace",), ("j smith",), ("sir",)]


@pytest.mark.parametrize("text, want", [
    ("https://www.acme.com/", "acme.com"), ("acme.com", "acme.com"), ("https://www.linkedin.com/in/alice", None),
    ("ACME.co.uk:8080", "acme.co.uk"), ("no domain", None), ("-a.com", None)])
def test_domain(spark, text, want):
    assert values(spark, [text], X.domain_of(F.col("t"))) == [(want,)]


@pytest.mark.parametrize("text, want", [
    ("10 December 1815", "1815-12-10"), ("Dec. 10th, 1815", "1815-12-10"), ("1815/12/10", "1815-12-10"), ("03/04/2020", None),
    ("31/12/2020", "2020-12-31"), ("05/05/2020", "2020-05-05"),
    ("31 February 2020", None), ("2020-13", None), ("2020-7", "2020-07"), ("May 1999", "1999-05"), ("Foo 1999", None),
    ("2020-01-02 03:04", "2020-01-02T03:04"), ("", None), ("soon", None)])
def test_dates(spark, text, want):
    assert values(spark, [text], V.normalize_date(F.col("t"))) == [(want,)]


def test_day_first(spark):
    assert values(spark, ["03/04/2020"], V.normalize_date(F.col("t"), True),
        V.normalize_date(F.col("t"), False)) == [("2020-04-03", "2020-03-04")]


@pytest.mark.parametrize("text, want", [
    ("1,234", "1234"), ("5 km", "5000 m"), ("12.5 percent", "12.5 %"), ("€1.2bn", "1200000000 EUR"), ("$1.2bn", "1200000000 $"),
    ("1.5 GiB", "1610612736 B"), ("0123", None), ("1,5 km", None),
    ("5 m", "5 m"), ("5 million", "5000000"), ("USD 5", "5 USD"), ("5 Mb", None), ("3 lbs", "1.36077711 kg"), ("", None), (None, None),
    ("US$5", "5 USD"), ("5 k", None), ("5 k EUR", "5000 EUR")])
def test_quantities(text, want):
    assert V.quantity(text) == want


def test_shingles_and_overlap(spark):
    got = values(spark, ["a b c d e f", "a b", "", "Straße x"], F.size(X.shingles(F.col("t"))), F.array_join(X.shingles(F.col("t")), "|"))
    assert got == [(2, "a b c d e|b c d e f"), (1, "a b"), (0, ""), (1, "strasse x")]
    df = spark.createDataFrame([("j smith", "john smith"), ("a b", "b a"), ("", "x"), ("a a", "a")], "a string, b string")
    assert [round(r[0], 4) for r in df.select(X.token_overlap(F.col("a"), F.col("b"))).collect()] == [0.6, 1.0, 0.0, 0.5]
    want = [max(difflib.SequenceMatcher(None, "j smith", "john smith", autojunk=False).ratio(), 0.6)]
    assert [r[0] for r in df.limit(1).select(X.name_similarity()(F.col("a"), F.col("b"))).collect()] == want


def test_other_names(spark):
    df = spark.createDataFrame([("bornInCity", "/a/b%20c.tar.gz", "bolt://me:pw@h/x", "wikidata: Q 95")],
        "n string, p string, u string, i string")
    r = df.select(X.snake(F.col("n")), X.pascal(F.col("n")), X.stem_of_path(F.col("p")), X.without_password(F.col("u")),
        X.identifier_scheme(F.col("i")), X.identifier_value(F.col("i"))).first()
    assert tuple(r) == ("born_in_city", "BornInCity", "b c.tar", "bolt://me:***@h/x", "wikidata", "q95")
    assert values(spark, ["robert iii 1902", "mix civil"], X.name_numbers(F.col("t"))) == [(["1902", "iii"],), ([],)]


def test_sentences():
    text = "Dr. Smith met J. R. Tolkien. He left! \"Why?\" she asked.\n\nA new paragraph without end"
    got = [text[s:e] for s, e, _ in spans.split_sentences(text)]
    assert got == ["Dr. Smith met J. R. Tolkien.", "He left!", "\"Why?\"", "she asked.", "A new paragraph without end"]
    assert [o for _, _, o in spans.split_sentences(text)] == [True, False, False, False, True]
    assert list(spans.split_sentences("")) == [] and list(spans.split_sentences(" \n ")) == []


def test_packing_of_sentences():
    rows = [(0, 1, k in (0, 3), n) for k, n in enumerate((5, 5, 5, 5, 30, 5))]
    assert list(spans.pack_sentences(rows, 20)) == [(0, 3), (3, 4), (4, 5), (5, 6)]
    assert all(j > i for i, j in spans.pack_sentences(rows, 12, overlap=1))


def test_chunks_cover_the_text(spark):
    docs = spark.createDataFrame([(1, "One two. Three four five.\n\nSix."), (2, None), (3, "")], "doc_id long, text string")
    got = spans.chunks(docs, 3).orderBy("doc_id", "idx").collect()
    assert [r["text"] for r in got] == ["One two.", "Three four five.", "Six."]
    assert all(r["text"] == "One two. Three four five.\n\nSix."[r["start"]:r["end"]] for r in got)


def test_contest_ties_and_single(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 1.0), ("b", 1, 2.0), ("c", 1, 2.0), ("c", 2, 1.0), ("c", 3, 0.5)],
        "g string, v int, rank double")
    got = {(r["g"], r["v"]): (r["outcome"], r["ratio"]) for r in C.contest(df, ["g"], "v").collect()}
    assert got == {("a", 1): ("tied", None), ("a", 2): ("tied", None), ("b", 1): (None, None), ("c", 1): ("won", None),
        ("c", 2): ("lost", 0.5), ("c", 3): ("lost", 0.25)}


def test_interval_overlap(spark):
    df = spark.sql("""SELECT * FROM VALUES ('x', 'p', 1, timestamp'2019-01-01', timestamp'2024-01-01'), ('x', 'q', 2, timestamp'2024-01-01', NULL), ('x', 'r', 3, NULL, timestamp'2020-01-01')
                      AS t(g, v, i, valid_from, valid_to)""")
    assert sorted(map(tuple, C.overlapping_rivals(df, ["g"], "v", "i").select("a", "b").collect())) == [(1, 3), (3, 1)]


def test_rebase_and_upsert(spark):
    def t(*rows):
        return spark.createDataFrame(rows, "k int, a int, b int")

    out = C.rebase(t((1, 9, 2)), t((1, 1, 2)), t((1, 1, 7), (2, 5, 5)), ["k"], ["a", "b"])
    assert sorted(map(tuple, out.collect())) == [(1, 9, 7), (2, 5, 5)]
    assert sorted(map(tuple, C.upsert(t((1, 1, 1), (2, 2, 2)), t((2, 3, 3), (4, 4, 4)), ["k"]).collect())) == [(1, 1, 1), (2, 3, 3),
        (4, 4, 4)]


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, 101), (102, 101), (7, 7)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {k: 1 for k in range(1, 41)} | {100: 100, 101: 100, 102: 100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_pairs(spark):
    base = [f"w{k}" for k in range(60)]
    near = base[:30] + ["other"] + base[31:]
    docs = spark.createDataFrame([(1, " ".join(base), "a"), (2, " ".join(near), "b"), (3, " ".join(base), "c"), (4, "x y z", "a"),
        (5, None, "b")], "doc_id long, text string, source string")
    got = shingle_pairs(docs, 0.8).collect()
    assert [(r["a"], r["b"]) for r in got] == [(1, 2)] and got[0]["jaccard"] == pytest.approx(51 / 61)


def test_resolution_refusals(spark):
    schema = "key string, type string, label string, aliases array<string>, external_id string, attributes map<string,string>"
    rows = [("a", "T", "Acme Inc", ["acme.com"], "reg:1", {}), ("b", "T", "Acme Ltd", ["acme.com"], None, {}),
        ("c", "T", "Acme", ["acme.com"], "reg:2", {}), ("d", "T", "Zeta", [], None, {})]
    p = R.profiles(spark.createDataFrame(rows, schema))
    links = R.judge(R.candidate_pairs(p), p)
    kinds = {(r["a"], r["b"]): r["kind"] for r in links.collect()}
    assert kinds == {("a", "b"): "same_as", ("a", "c"): "different", ("b", "c"): "same_as"}
    merged = dict(map(tuple, R.merge_components(links, p).collect()))
    assert merged["a"] == merged["b"] == "a" and merged["c"] == "c"  # two ids never meet


def test_statistics(spark):
    one = spark.range(1)
    assert one.select(S.mcnemar(F.lit(1), F.lit(7))).first()[0] == pytest.approx(2 * 9 / 256)
    assert one.select(S.mcnemar(F.lit(0), F.lit(0))).first()[0] == 1.0
    low, high = one.select(*S.wilson(F.lit(0), F.lit(10))).first()
    assert low == 0.0 and high == pytest.approx(0.2775, abs=1e-3)
    assert tuple(one.select(*S.wilson(F.lit(0), F.lit(0))).first()) == (None, None)
    assert tuple(one.select(*S.precision_recall_f1(F.lit(0), F.lit(0), F.lit(0))).first()) == (None, None, None)
    assert tuple(one.select(*S.precision_recall_f1(F.lit(0), F.lit(2), F.lit(0))).first()) == (0.0, None, 0.0)


def test_matching_consumes_pairs(spark):
    schema = "doc_id long, ord long, subject string, predicate string, obj string"
    gold = spark.createDataFrame([(1, 1, "a", "p", "x"), (1, 2, "a", "p", "y"), (1, 3, "b", "p", "z"), (1, 4, "c", "q", "v")], schema)
    pred = spark.createDataFrame([(1, 1, "a", "p", "x"), (1, 2, "a", "p", "w"), (1, 3, "d", "p", "z"), (1, 4, "e", "r", "u")], schema)
    got = sorted((r["kind"], r["gold_ord"], r["predicted_ord"]) for r in M.match_three_passes(gold,
        pred).collect() if r["gold_ord"] and r["predicted_ord"])
    assert got == [("correct", 1, 1), ("wrong_entity", 3, 3), ("wrong_value", 2, 2)]


def test_ontology_rules(spark):
    with pytest.raises(ValueError, match="did you mean 'domain'"):
        O.load(json.dumps({"predicates": {"p": {"domian": ["A"]}}}))
    assert O.diagnostics({"types": {"A": {}}, "predicates": {"p": {"domain": ["A"]}}}) == []
    empty = O.schema_problems(spark, spark.createDataFrame([("p", "A", None)], "predicate string, s_type string, o_type string"), {})
    assert empty.first()["problem"] is None


def test_extraction(spark):
    doc = "# Team\nName: Ada\nRole: lead\n\ntext\n| a | b |\n| --- | --- |\n| 1 | x \\| y |\n| 2 |  |\n## Sub\nEnd: 1"
    docs = spark.createDataFrame([(1, doc), (2, "no structure"), (3, None)], "doc_id long, text string")
    assert sorted(tuple(r) for r in E.key_value_facts(docs).select("heading", "key", "value").collect()) == [("Sub", "End", "1"),
        ("Team", "Name", "Ada"), ("Team", "Role", "lead")]
    assert sorted(tuple(r) for r in E.table_facts(docs).select("row", "column", "value").collect()) == [(0, "a", "1"), (0, "b", "x | y"),
        (1, "a", "2")]
    assert [r["path"] for r in E.headings(docs).orderBy("pos").collect()] == ["Team", "Team > Sub"]


def test_mentions(spark):
    s = spark.createDataFrame([(1, 0, "New York City and York are old")], "doc_id long, pos int, text string")
    names = spark.createDataFrame([("new york",), ("new york city",), ("york",), ("city and",)], "name string")
    assert sorted((r["at"], r["name"]) for r in I.mentions(s, names).collect()) == [(0, "new york city"), (4, "york")]


def test_overlapping_rivals_against_all_pairs(spark):
    """Short, long, open and empty intervals: every overlapping pair once in each order."""
    import datetime
    import random

    from factloom.operators import claims

    r = random.Random(5)
    day = lambda n: None if n is None else datetime.datetime(2020, 1, 1) + datetime.timedelta(days=n)
    rows = []
    for k in range(120):
        start = r.choice([None, *range(0, 900, 7)])
        end = r.choice([None, 0 if start is None else start + r.choice([0, 1, 20, 40, 3000])])
        rows.append((r.choice("gh"), r.choice("xyz"), k, day(start), day(end)))
    got = claims.overlapping_rivals(spark.createDataFrame(rows, "g string, v string, i int, valid_from timestamp, valid_to timestamp"), ["g"], "v", "i")
    far = datetime.datetime(9999, 1, 1)
    want = sorted((a[0], a[2], b[2]) for a in rows for b in rows if a[0] == b[0] and a[1] != b[1]
                  and not (a[4] or far) <= (b[3] or datetime.datetime.min) and not (b[4] or far) <= (a[3] or datetime.datetime.min))
    assert sorted(tuple(x) for x in got.collect()) == want and len(want) > 100
