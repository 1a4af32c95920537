"""Streamed runs, versioned stores, graph plans, manifests, control and stages on fixtures made here."""

import json

import pytest
from pyspark.sql import functions as F

from factloom import control, manifest, run, stages
from factloom.eval import equivalence, reports
from factloom.operators import cluster, fold, naming, ordering
from factloom.operators import resolve as R
from factloom.sinks import graph, writers
from factloom.sources import datasets
from factloom.streaming import micro, runs

CONFIG = run.Config(documents={"path": ""}, triples={"path": ""}, output={"path": ""})
TRIPLE = "doc string, subject string, predicate string, object string"


def docs_of(spark, n=4):
    rows = [(f"d{k}", f"Ann{k} lives in Ulm and Bonn.", f"https://h{k % 2}.org/d{k}", "curated") for k in range(n)]
    return spark.createDataFrame(rows, "doc_id string, text string, uri string, tier string")


def triples_of(spark, rows):
    from factloom.sources.readers import read_triples  # noqa: F401  the schema of triples
    from factloom.schema import TRIPLES, struct

    full = spark.createDataFrame([], struct(TRIPLES))
    return full.unionByName(spark.createDataFrame(rows, TRIPLE), allowMissingColumns=True)


def say(facts):
    return sorted((r["s_key"], r["predicate"], r["o_repr"], r["support"], r["documents"]) for r in facts.collect())


def test_batches_give_what_a_whole_run_gives(spark, tmp_path):
    rows = [(f"d{k % 4}", f"Ann{k % 3}", "lives_in", "Ulm" if k % 2 else "Bonn") for k in range(24)]
    whole = runs.StreamedValidation(spark, CONFIG, docs_of(spark), str(tmp_path / "whole"), 4)
    whole.batch(triples_of(spark, rows))
    parts = runs.StreamedValidation(spark, CONFIG, docs_of(spark), str(tmp_path / "parts"), 4)
    for k in range(0, 24, 5):
        parts.batch(triples_of(spark, rows[k:k + 5]), "stream", k)
    parts.batch(triples_of(spark, rows[:5]), "stream", 0)  # a batch that runs again is not applied twice
    parts.batch(triples_of(spark, rows[3:9]), "another", 0)  # another stream goes on from what is stored
    assert say(parts.facts()[0]) == say(whole.facts()[0]) and len(say(whole.facts()[0])) > 3
    assert parts.store.totals()["batches"] == 6 and parts.store.totals()["rows"] == 30


def test_update_takes_back_what_a_document_said(spark, tmp_path):
    v = runs.StreamedValidation(spark, CONFIG, docs_of(spark), str(tmp_path / "s"), 4)
    v.batch(triples_of(spark, [("d0", "Ann", "lives_in", "Ulm"), ("d1", "Ann", "lives_in", "Ulm"), ("d1", "Ann", "born_in", "Bonn")]))
    v.batch(triples_of(spark, [("d1", "Ann", "lives_in", "Bonn")]), update=True)
    assert [(p, o) for _, p, o, _, _ in say(v.facts()[0])] == [("lives_in", "Bonn"), ("lives_in", "Ulm")]
    v.withdraw(docs_of(spark).select("doc_id"))
    assert v.facts()[0].count() == 0


def test_store_touches_only_its_buckets(spark, tmp_path):
    s = micro.VersionedStore(spark, str(tmp_path / "s"), ["k"], 8)
    rows = spark.range(100).select(F.col("id").alias("k"), F.lit(0).alias("v"))
    s.upsert(rows, lambda before, new: new)
    first = s.versions.note()["buckets"]
    s.upsert(rows.where("k = 7").withColumn("v", F.lit(1)), lambda before, new: before.where("k <> 7").union(new))
    second = s.versions.note()["buckets"]
    assert sum(first[b] != second[b] for b in second) == 1 and s.version() == 1
    assert s.read().count() == 100 and s.read().where("v = 1").count() == 1
    with pytest.raises(FileExistsError):
        s.versions.commit(1, {})


def test_a_new_checkpoint_keeps_what_is_stored(spark, tmp_path):
    rows = spark.range(20).select((F.col("id") % 5).alias("claim"), F.col("id").cast("string").alias("source"))
    rows.repartition(2).write.parquet(str(tmp_path / "in"))
    s = micro.VersionedStore(spark, str(tmp_path / "store"), ["claim"], 4)
    for checkpoint in ("a", "b"):
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        micro.upsert_stream(stream, s, micro.merge_counts(["claim"]), str(tmp_path / checkpoint))
    assert s.read().count() == 20


def test_writes_carry_other_tables_over(spark, tmp_path):
    s = writers.JsonLinesStore(spark, str(tmp_path / "s"))
    rows = spark.createDataFrame([("a", "1")], "sig string, v string")
    s.replace(facts=rows, links=rows.withColumnRenamed("sig", "kind"))
    s.merge(facts=spark.createDataFrame([("b", "2")], rows.schema))
    assert s.read("facts", "sig string, v string").count() == 2 and s.read("links", "kind string, v string").count() == 1
    s.append(facts=rows)
    assert s.counts() == {"facts": 3, "links": 1}


def test_guarded_merge_settles(spark, tmp_path):
    """Another writer changes one column of a row that I read; both changes end up stored."""
    state = {"rows": spark.createDataFrame([("a", 1, "x", "y"), ("b", 1, "x", "y")], "k string, version long, p string, q string")}
    mine = spark.createDataFrame([("a", 1, "mine", "y"), ("b", 1, "mine", "y")], "k string, read_version long, p string, q string")
    calls = {"n": 0}

    def read():
        calls["n"] += 1
        if calls["n"] == 2:  # between my read and my write
            state["rows"] = spark.createDataFrame([("a", 2, "x", "theirs"), ("b", 1, "x", "y")],
                "k string, version long, p string, q string")
        return state["rows"]

    def write(df):
        state["rows"] = spark.createDataFrame(df.collect(), "k string, version long, p string, q string")

    assert graph.merge_until_settled(read, write, mine, ["k"]) == 2
    assert sorted(tuple(r) for r in state["rows"].collect()) == [("a", 3, "mine", "theirs"), ("b", 2, "mine", "y")]


def test_plan_is_the_same_whatever_the_order(spark):
    facts = spark.createDataFrame([("s1", "A:x", "A", "knows", "entity", "B:y", "B", None, 0.5, 1, "asserted", None, "", None),
        ("s2", "A:x", "A", "age", "value", None, None, "7", 0.5, 2, "asserted", None, "", None),
                                   ("s3", "A:x", "A", "age", "value", None, None, "8", 0.9, 1, "asserted", None, "", None),
                                   ("s4", "A:x", "A", "tag", "value", None, None, "t", 0.9, 1, "denied", None, "", None)],
                                  "sig string, s_key string, s_type string, predicate string, o_kind string, o_key string, o_type string, o_repr string, confidence double, support long, polarity string, qualifiers map<string,string>, outcome string, retired_at string")
    entities = spark.createDataFrame([("A", "A:x", "X")], "type string, key string, label string")
    links = spark.createDataFrame([], "source_key string, target_key string, kind string, score double, reason string")
    rows = [tuple(r) for r in graph.write_plan(entities, facts, links).orderBy("stage", "grp", "key").collect()]
    again = [tuple(r) for r in graph.write_plan(entities, facts.orderBy(F.desc("sig")), links).orderBy("stage", "grp", "key").collect()]
    assert rows == again and [r[1] for r in rows] == ["entity"] * 2 + ["edge"] + ["claim"] * 3 + ["projection"]
    assert json.loads(rows[-1][4])["value"] == ["7"]  # the best supported, not the most confident
    both = [json.loads(r[4])["value"] for r in graph.write_plan(entities, facts, links,
        multi=["age"]).where("kind = 'projection'").collect()]
    assert both == [["7", "8"]]
    text = {r["kind"]: r["statement"] for r in graph.statements(graph.write_plan(entities, facts, links)).collect()}
    assert "MERGE (s)-[f:`knows` {signature: r.signature}]->(o)" in text["edge"] and "tenant" in text["entity"]


def test_contested_components_only_are_folded(spark):
    e = spark.createDataFrame([("a", None, None), ("b", None, None), ("c", "reg", "1"), ("d", "reg", "2"), ("x", None, None),
        ("y", "reg", "9"), ("z", None, None)], "key string, scheme string, id_value string")
    links = spark.createDataFrame([("a", "b", "same_as", 0.9), ("b", "c", "same_as", 0.8), ("c", "d", "same_as", 0.7),
        ("x", "y", "same_as", 0.9), ("y", "z", "same_as", 0.5), ("a", "d", "different", 1.0)],
        "a string, b string, kind string, score double")
    got = dict(map(tuple, R.merge_components(links, e).collect()))
    assert got == {"a": "c", "b": "c", "c": "c", "d": "d", "x": "y", "y": "y", "z": "y"}


def test_manifest_versions(spark, tmp_path):
    m = manifest.run_manifest("run", {"b": 1, "a": 2}, {"t": spark.range(3).toDF("x")}, {"facts": 1})
    assert manifest.run_manifest("run", {"a": 2, "b": 1}, {"t": spark.range(3).orderBy(F.desc("id")).toDF("x")}, {"facts": 1}) == m
    assert manifest.readable({"manifest_version": "1.7", "command": "x", "later": 1},
        {"manifest_version", "command"}) == {"manifest_version": "1.7", "command": "x"}
    with pytest.raises(ValueError, match="cannot be read"):
        manifest.newer_minor("2.0", "1.0")
    with pytest.raises(ValueError, match="unknown fields: later"):
        manifest.readable({"manifest_version": "1.0", "later": 1}, {"manifest_version"})


def test_budget_stops_at_the_first_that_does_not_fit(spark):
    calls = spark.createDataFrame([(1, 10, 0, 1.0), (2, 10, 0, None), (3, 100, 0, 1.0), (4, 1, 0, 1.0)],
        "k long, input_tokens long, output_tokens long, usd double")
    got = {r["k"]: r["allowed"] for r in control.within_budget(calls, ["k"], tokens_limit=50).collect()}
    assert got == {1: True, 2: True, 3: False, 4: False}
    assert all(r["allowed"] for r in control.within_budget(calls, ["k"]).collect())
    assert control.within_budget(calls.limit(0), ["k"], 1).count() == 0


def test_text_batches_keep_texts_whole(spark):
    rows = spark.createDataFrame([(f"t{k // 7}", k) for k in range(70)] + [("t3", 1000 + k) for k in range(60)], "text string, k long")
    got = ordering.text_batches(rows, "text", ["k"], 10).collect()
    assert len(got) == 130
    by_text = {}
    for r in got:
        by_text.setdefault(r["text"], set()).add(r["batch"])
    assert all(len(b) == 1 for t, b in by_text.items() if t != "t3") and len(by_text["t3"]) == 4
    with pytest.raises(ValueError):
        ordering.text_batches(rows, "text", ["k"], 0)


def test_stage_names_and_options():
    for stage, use, options, message in (("chunker", "wrods", {}, "did you mean 'words'"), ("chunk", "words", {}, "no such stage"),
        ("chunker", "words", {"size": 3}, "chunker words"), ("gate", "json:nothing", {}, "has no nothing")):
        with pytest.raises(ValueError, match=message):
            stages.build(stage, use, **options)
    assert stages.build("resolver")(None, {}) == {}


def test_user_stage_by_module(spark):
    t = stages.run(stages.Context(spark), docs_of(spark).withColumn("modality", F.lit("unstructured")),
        {"chunker": {"use": "test_runs_and_graph:upper"}})
    assert [r["text"] for r in t["chunks"].orderBy("doc_id").collect()][0].startswith("ANN0")


def upper():
    return lambda context, t: {"chunks": t["documents"].select("doc_id", F.lit(0).alias("idx"), F.upper("text").alias("text"))}


def test_near_names(spark):
    rows = [("Acme, Inc.", "ACME Corporation"), ("Bank of Ulm", "Ulm Bank"), ("Ulm", "Ulmer"), ("Johnathan Smith", "Jonathan Smith"),
        ("", "x"), ("Ulm Trading", "Trading")]
    got = [r["near"] for r in naming.near_names(spark.createDataFrame(rows, "a string, b string").coalesce(1), "a", "b").collect()]
    assert got == [True, False, False, True, False, True]


def test_clusters_respect_refusals(spark):
    c = spark.createDataFrame([("1", "Town", ["City"], 0), ("2", "City", [], 1), ("3", "towns", [], 2), ("4", "Settlement", [], 3)],
        "id string, name string, aliases array<string>, rank int")
    e = spark.createDataFrame([("1", "s", "v"), ("1", "t", "w"), ("4", "s", "v"), ("4", "t", "w")],
        "id string, subject string, value string")
    links = cluster.candidate_links(c, e)
    assert {(r["a"], r["b"], r["reason"]) for r in links.collect()} >= {("1", "2", "alias"), ("1", "3", "same name"),
        ("1", "4", "shared evidence")}
    one = {r["id"]: r["name"] for r in cluster.clusters(c, links, links.select("a", "b").limit(0)).collect()}
    assert set(one.values()) == {"Town"}
    refused = cluster.refusals(links, spark.createDataFrame([("1", "4")], "id string, ancestor string"))
    apart = {r["id"]: r["name"] for r in cluster.clusters(c, links, refused).collect()}
    assert apart == {"1": "Town", "2": "Town", "3": "Town", "4": "Settlement"}


def test_datasets(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps([{"title": "T",
        "sents": [["Ann", "lives", "here", "."], ["It", "'s", "(", "in", ")", "Ulm", "."]],
                                                  "vertexSet": [[{"name": "Ann", "type": "PER", "sent_id": 0, "pos": [0, 1]}],
                                                  [{"name": "Ulm", "type": "LOC", "sent_id": 1, "pos": [5, 6]}]],
                                                  "labels": [{"h": 0, "t": 1, "r": "P551", "evidence": [0, 1]}]}]))
    docs, gold = datasets.docred(spark, str(tmp_path / "d.json"))
    assert docs.first()["text"] == "Ann lives here. It's (in) Ulm."
    assert tuple(gold.select("subject", "relation", "object", "o_type").first()) == ("Ann", "P551", "Ulm", "LOC")
    o = datasets.observed_ontology(gold, "set")
    assert o["predicates"]["p551"] == {"domain": ["PER"], "range": "LOC", "aliases": ["P551"], "importance": 1.0}
    (tmp_path / "t.json").write_text(json.dumps([{"docid": "1", "title": "T", "text": "x", "triples": [
        {"subject": {"uri": "u1", "surfaceform": "A"}, "predicate": {"uri": "http://w/P1"}, "object": {"uri": "u2", "surfaceform": "B"},
        "annotator": "good"},
        {"subject": {"uri": "u1", "surfaceform": "A"}, "predicate": {"uri": "http://w/P2"}, "object": {"uri": "u2", "surfaceform": None},
        "annotator": "good"}]}]))
    assert [tuple(r) for r in datasets.trex(spark, str(tmp_path / "t.json"), ["good"])[1].select("relation", "object").collect()] == [("P1",
        "B")]
    (tmp_path / "s.jsonl").write_text(json.dumps({"id": "i", "sent": "S.", "triples": [{"sub": "a", "rel": "r", "obj": "b"}]}))
    assert datasets.sentence_set(spark, str(tmp_path / "s.jsonl"))[1].count() == 1


def test_equivalence_passage_and_repeats(spark):
    pairs = spark.createDataFrame([("d", 1, 2, ["Ann", "Ulm"])], "doc_id string, gold long, predicted long, names array<string>")
    s = spark.createDataFrame([("d", 0, "Ann is here."), ("d", 1, "Then ann went to Ulm."), ("d", 2, "Ulm and Ann.")],
        "doc_id string, pos int, text string")
    assert equivalence.passages(pairs, s).first()["passage"] == "Then ann went to Ulm."
    assert equivalence.repeats(spark.createDataFrame([("p",)], "prompt string"), 3).select("cache_key").distinct().count() == 3


def test_price_fixes_confirmed_names(spark):
    causes = spark.createDataFrame([("surface_form", 4), ("linked_other", 0)], "cause string, n long")
    rates = spark.createDataFrame([("gold", 0, 10), ("overall", 5, 10)], "rate string, hits long, total long")
    assert [(r["fix"], r["expected"], r["exact"]) for r in reports.price_fixes(causes, rates).collect()] == [("normalise-names", 0.0,
        False)]
    assert [(r["expected"], r["exact"]) for r in reports.price_fixes(causes, rates, judged=True).collect()] == [(0.4, True)]
    a = spark.createDataFrame([("d1", 1), ("d2", 2)], "doc string, hits long")
    assert reports.run_id(a) == reports.run_id(a.orderBy(F.desc("doc"))) and len(reports.run_id(a)) == 16


def test_merge_entities_first_claimant(spark):
    e = spark.createDataFrame([("b", "T", "Beta", ["x y"], None, {"p": "b", "q": "b"}),
        ("a", "T", "Alpha", ["X-Y", "beta"], "reg:1", {"p": "a", "r": "a"})],
                              "key string, type string, label string, aliases array<string>, external_id string, attributes map<string,string>")
    got = fold.merge_entities(e, spark.createDataFrame([("a", "b"), ("b", "b")], "key string, canonical string")).first()
    assert (got["key"], got["label"], got["aliases"], got["external_id"], got["attributes"]) == ("b", "Beta", ["x y", "Alpha"], "reg:1",
        {"p": "b", "q": "b", "r": "a"})
