"""Queries whose work once grew faster than their tables: the rows that their plans shuffle and make, and the same results."""

import pyarrow as pa
from conftest import SF
from pyspark.sql import functions as F

from factloom.operators import lookup, near_text, resolve, spans, verify
from factloom.plans import prices


def plan_rows(df, metric="shuffleRecordsWritten"):
    """Rows by operator of the plan that ran for df.collect()."""
    out, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        kind = p.getClass().getSimpleName()
        todo += [p.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [p.plan()] if kind.endswith("QueryStageExec") else []
        todo += [p.children().apply(k) for k in range(p.children().size())]
        if (m := p.metrics().get(metric)).isDefined():
            out.append((kind, m.get().value()))
    return out


def shuffled(df):
    return sum(n for _, n in plan_rows(df))


def _people(spark, n):
    """One type, four names of the same first word."""
    k = F.col("id")
    return resolve.profiles(spark.range(n).select(F.format_string("k%05d", k).alias("key"), F.lit("T").alias("type"),
        F.concat(F.lit("red "), F.element_at(F.array(*map(F.lit, ("bolt", "ring", "gear", "nut"))), (k % 4 + 1).cast("int"))).alias("label"),
        F.array().cast("array<string>").alias("aliases"), F.lit(None).cast("string").alias("external_id"),
        F.create_map(F.lit("country"), F.lit("1")).alias("attributes")))


def test_f1_nearest_names_are_ranked_once_for_each_name(spark):
    p = _people(spark, 2000)
    df = lookup.store_candidates(p.where("substring(key, 6) = '0'"), p, 3)
    got = {(r["a"], r["b"]) for r in df.collect()}
    want = {(f"k{a:05d}", f"k{b:05d}") for a in range(0, 2000, 10) for b in [x for x in range(a % 4, 2000, 4) if x != a][:3]}
    assert got == want
    assert max(n for _, n in plan_rows(df, "numOutputRows")) < 50_000  # 200 x 2,500 pairs of one block were made and scored before


def test_f2_no_pair_of_candidates_is_shuffled(spark):
    p = _people(spark, 2000)
    df = lookup.store_candidates(p.where("substring(key, 6) = '0'"), p, 100_000)
    assert len(set(map(tuple, df.collect()))) == df.count() == 200 * 1999
    df.collect()
    assert shuffled(df) < 50_000  # 500,000 pairs were shuffled to drop those of two blocks before


def test_f3_votes_are_counted_where_they_arise(spark):
    p = spark.range(300).select((F.col("id") % 100).alias("item"), F.concat(F.lit("p"), F.col("id") % 3).alias("predicate"))
    d = spark.range(120).select(F.concat(F.lit("p"), F.col("id") % 3).alias("predicate"), F.format_string("t%02d", F.floor(F.col("id") / 3)).alias("type"))
    d = d.where("NOT (type = 't00' AND predicate = 'p2')").union(spark.createDataFrame([("p0", None)], "predicate string, type string"))
    df = verify.best_type(p.union(p.where("item = 7")), d)
    # 300 rows: item k has p(k), p(k + 1), p(k + 2) modulo 3, so every type but t00 has three votes, and t01 is the first of them
    assert sorted(map(tuple, df.collect())) == [(k, "t01", 6 if k == 7 else 3) for k in range(100)]
    assert shuffled(df) < 1_000  # 12,000 votes were shuffled before


def test_f9_documents_are_matched_in_one_pass_of_a_task(spark):
    n = 3000
    predicted = spark.range(2 * n).select(F.floor(F.col("id") / 2).alias("doc"), (F.col("id") % 2).alias("ord"), F.lit("A").alias("subject"),
        F.lit("r").alias("relation"), F.lit("B").alias("object"))
    names = spark.range(n).select(F.col("id").alias("doc"), F.explode(F.expr("from_json('[{\"name\":\"a\",\"id\":\"x\"},{\"name\":\"a\",\"id\":\"y\"},{\"name\":\"b\",\"id\":\"z\"}]', 'array<struct<name:string,id:string>>')")).alias("n")).select("doc", "n.*")
    gold = names.where("id <> 'z' AND (id = 'x' OR doc % 3 = 0)").select("doc", F.col("id").alias("s"), F.lit("r").alias("relation"), F.lit("z").alias("o"))
    df = lookup.match_by_ids(predicted, names, gold)
    # a second prediction takes the other reading of the name, where that is gold too
    assert {(r["doc"], r["ord"]) for r in df.collect() if not r["matched"]} == {(k, 1) for k in range(n) if k % 3} and df.count() == 2 * n
    assert "FlatMapGroupsInPandas" not in df._jdf.queryExecution().toString()  # a call of pandas for each document before


def test_f7_f8_an_id_that_occurs_twice_is_one_document(spark):
    words = [" ".join(f"w{k}x{j}" for j in range(60)) for k in range(3)]
    docs = [(1, words[0], "a"), (1, words[0], "a"), (2, words[0] + " end", "b"), (3, words[1], "a"), (3, words[2], "b"), (4, words[1] + " end", "c")]
    pairs = near_text.shingle_pairs(spark.createDataFrame(docs, "doc_id long, text string, source string"))
    assert [(r["a"], r["b"], round(r["jaccard"], 6)) for r in pairs.collect()] == [(1, 2, round(56 / 57, 6))]  # 3 holds two texts: 56 of 113


def test_f11_sentences_are_handed_on_in_parts():
    text = "One two three. Four five.\n\nSix. " * 40
    docs = pa.table({"doc_id": list(range(700)), "text": [None if k % 7 == 0 else text for k in range(700)]}).to_batches()
    got = list(spans._sentence_batches(iter(docs)))
    assert [b.num_rows for b in got] == [120 * (256 - 37), 120 * (256 - 37), 120 * (188 - 26)]  # one batch of all rows before
    assert got[0].to_pylist()[:3] == [{"doc_id": 1, "pos": k, "start": s, "end": e, "opens": k != 1, "words": n} for k, (s, e, n) in enumerate([(0,
        14, 3), (15, 25, 2), (27, 31, 1)])]


def test_f6_only_vectors_near_the_kth_are_compared_exactly(spark):
    v = [(k, [float((k * 7 + j * j * (k % 5)) % 11) - 5 for j in range(8)], k % 2) for k in range(400)]
    v += [(500, None, 0), (501, [1.0, None], 0), (502, [0.0] * 8, 0), (503, [1.0, 2.0], 1), (504, [1.0] * 8, None)]
    t = spark.createDataFrame(v, "key long, v array<double>, label int")
    df = resolve.nearest_vectors(t, t.where("key % 20 = 0 OR key >= 500"), 5, ["label"])
    got = sorted((r["probe"], r["rank"], r["key"], r["cosine"]) for r in df.collect())

    def cos(x, y):
        if x is None or y is None or len(x) != len(y) or None in x or None in y or not any(x) or not any(y):
            return 0.0
        return round(sum(p * q for p, q in zip(x, y)) / (sum(p * p for p in x) ** 0.5 * sum(q * q for q in y) ** 0.5), 9)

    want = []
    for k, x, g in v:
        if (k % 20 == 0 or k >= 500) and g is not None:
            best = sorted((-cos(x, y), j) for j, y, h in v if h == g and j != k)[:5]
            want += [(k, n + 1, j, -c) for n, (c, j) in enumerate(best)]
    assert [r[:3] for r in got] == [r[:3] for r in sorted(want)]
    assert max(abs(r[3] - q[3]) for r, q in zip(got, sorted(want))) < 2e-9
    assert not [n for p, n in plan_rows(df, "numOutputRows") if "Join" in p and n > 3_000]  # 24 x 200 pairs were compared before


def test_f15_ranks_of_a_contest_are_worked_out_once(spark):
    df = prices.price_contest(spark, SF)
    df.collect()
    assert not [k for k, _ in plan_rows(df, "numFiles")]  # the lines were read for each of its four uses before
