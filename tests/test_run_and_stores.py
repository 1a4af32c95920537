"""Lookups, judges, sheets, RDF ontologies, record paths and whole runs on fixtures made here."""

import json

import pytest

from factloom import run
from factloom.eval import judges as J
from factloom.operators import lookup as L
from factloom.operators import ontology as O
from factloom.sinks import schema_text as D
from factloom.sources import structure as S


def test_paths():
    assert S.parse_path('a.b[0]["x y"][*]') == ["a", "b", 0, "x y", None]
    for bad in (".a", "a..b", "a[", "a[x]", "ab]c"):
        with pytest.raises(ValueError, match="cannot read"):
            S.parse_path(bad)


def test_at_path(spark):
    df = spark.createDataFrame([(1, '{"a": [{"b": 1}, {"c": 2}, {"b": {"d": null}}]}'), (2, "{}"), (3, None), (4, "not json")],
        "id long, j string")
    assert [(r["id"], r["pos"], r["value"]) for r in S.at_path(df, "j", "a[*].b").orderBy("pos").collect()] == [(1, [0], "1"),
        (1, [2], '{"d":null}')]
    assert S.at_path(df, "j", "a[1].c").first()["value"] == "2"


def test_rdf_ontology(spark, tmp_path):
    x = "http://e.org/v#"
    lines = [f"<{x}Town> <{S.RDFS}subClassOf> <{x}Place> .", f"<{x}Place> <{S.RDF}type> <{S.OWL}Class> .",
        f'<{x}Place> <{S.RDFS}label> "spot \\"x\\""@en .',
             f"<{x}in> <{S.RDFS}domain> <{x}Town> .", f"<{x}in> <{S.RDFS}range> <{x}Place> .", f"<{x}in> <{S.OWL}inverseOf> <{x}holds> .",
             f"<{x}holds> <{S.RDF}type> <{S.OWL}ObjectProperty> .",
             f"<{x}size> <{S.RDFS}range> <{S.XSD}int> .", f"<{x}size> <{S.RDF}type> <{S.OWL}FunctionalProperty> .", "# note", "",
             f'<{x}t1> <{x}size> "5"^^<{S.XSD}int> .']
    (tmp_path / "o.nt").write_text("\n".join(lines))
    o = S.ontology_from_rdf(S.read_ntriples(spark, str(tmp_path / "o.nt")))
    assert o["types"] == {"Town": {"parents": ["Place"], "aliases": []}, "Place": {"parents": [], "aliases": ['spot "x"']}}
    assert o["predicates"]["in"] == {"domain": ["Town"], "range": "Place", "cardinality": "multi", "aliases": [], "inverse_of": "holds"}
    assert o["predicates"]["size"]["range"] == "integer" and o["predicates"]["size"]["cardinality"] == "single"
    (tmp_path / "bad.nt").write_text("no triple here\n")
    with pytest.raises(Exception, match="no triple"):
        S.read_ntriples(spark, str(tmp_path / "bad.nt")).collect()


def test_source_places(spark):
    r = spark.sql("SELECT array(named_struct('start', 0, 'end', 5, 'unit', 'h1', 'from', 10), named_struct('start', 6, 'end', 9, 'unit', 'p', 'from', 30)) AS parts, 3 AS s, 8 AS e")
    got = r.select(S.source_places(r["parts"], r["s"], r["e"]).alias("x")).first()["x"]
    assert [tuple(x) for x in got] == [("h1", 13, 15), ("p", 30, 32)]


def test_match_by_ids_takes_each_gold_once(spark):
    p = spark.createDataFrame([("d", 1, "Ann", "r", "B"), ("d", 2, "ann", "r", "b"), ("d", 3, "X", "r", "B")],
        "doc string, ord long, subject string, relation string, object string")
    n = spark.createDataFrame([("d", "Ann", "1"), ("d", "ann", "2"), ("d", "b", "9")], "doc string, name string, id string")
    g = spark.createDataFrame([("d", "1", "r", "9"), ("d", "2", "r", "9")], "doc string, s string, relation string, o string")
    assert [r["matched"] for r in L.match_by_ids(p, n, g).orderBy("ord").collect()] == [True, True, False]
    assert [r["matched"] for r in L.match_by_ids(p, n, g.limit(1)).orderBy("ord").collect()] == [True, False, False]


def test_sheets_round_trip(spark):
    items = spark.createDataFrame([("a", "## x\n- [x] y"), ("b", ""), ("c", "q")], "id string, question string")
    s = J.make_sheets(items, ["yes", "no"], 2).collect()
    assert sorted(t["text"].count("\n## ") + t["text"].startswith("## ") for t in s) == [1, 2]
    filled = spark.createDataFrame([(0, "".join(t["text"] for t in s).replace("- [ ] yes", "- [X] yes", 2))], "sheet long, text string")
    got = {r["id"]: (r["label"], r["problem"]) for r in J.read_sheets(filled).collect()}
    assert set(got) == {"a", "b", "c"} and sorted(map(str, got.values())) == ["('yes', None)", "('yes', None)", "(None, 'no tick')"]


def test_ontology_texts():
    o = {"types": {"T": {"keys": ["n"]}, "U": {"parents": ["T"]}},
        "predicates": {"n": {"domain": ["T"], "importance": 0.2}, "r": {"domain": ["U"], "range": "T", "importance": 0.9},
        "z": {"domain": ["V"]}}}
    assert O.snippet(o, "U", 1) == {"type": "U", "predicates": ["r"], "truncated": True} and O.snippet(o, "T") == {"type": "T",
        "predicates": ["n"], "truncated": False}
    assert D.ddl(o) == ["CREATE CONSTRAINT IF NOT EXISTS FOR (n:`T`) REQUIRE n.key IS UNIQUE;",
        "CREATE CONSTRAINT IF NOT EXISTS FOR (n:`U`) REQUIRE n.key IS UNIQUE;",
                        "CREATE INDEX IF NOT EXISTS FOR (n:`T`) ON (n.`n`);", "CREATE INDEX IF NOT EXISTS FOR ()-[r:`r`]-() ON (r.sig);"]


def test_config_errors():
    ok = {"documents": {"path": "d"}, "triples": {"path": "t"}, "output": {"path": "/o"}}
    c = run.load_config(json.dumps(ok), "/base")
    assert c.documents["path"] == "/base/d" and c.output["path"] == "/o"
    for broken, message in (({**ok, "documnts": {}}, "did you mean 'documents'"),
        ({**ok, "gate": {"marks": 1}}, "gate.marks: unknown key, did you mean 'mark'"), ({**ok, "output": {}}, "output.path: missing")):
        with pytest.raises(ValueError, match=message):
            run.load_config(json.dumps(broken))


def test_whole_run_and_reconcile(spark, tmp_path, capsys):
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "a.txt").write_text("Ann lives in Rome.")
    (docs / "b.txt").write_text("Ann is in Rome, not Oslo.")
    rows = [{"doc": d, "subject": "Ann", "predicate": "lives_in", "object": o, "subject_type": "Person", "object_type": "City",
        "confidence": 0.8, **more}
            for d, o, more in (("a", "Rome", {"start": 0, "end": 17}), ("b", "Rome", {"quote": "in Rome"}), ("b", "Oslo", {}),
            ("a", "Bern", {"start": 5, "end": 500}))]
    rows.append({"doc": "a", "subject": "Ann", "predicate": "owns", "object": "Rome", "subject_type": "Person", "object_type": "City"})
    (tmp_path / "t.jsonl").write_text("\n".join(map(json.dumps, rows)))
    (tmp_path / "o.json").write_text(json.dumps({"types": {"Person": {}, "City": {}},
        "predicates": {"lives_in": {"domain": ["Person"], "range": "City"}}}))
    (tmp_path / "v.jsonl").write_text(json.dumps({"doc": "b.txt", "s_key": "Person:ann", "predicate": "lives_in", "o_repr": "Oslo",
        "verdict": "contradicted"}))
    (tmp_path / "c.json").write_text(json.dumps({"documents": {"path": "docs"}, "triples": {"path": "t.jsonl"}, "ontology": "o.json",
        "verdicts": {"path": "v.jsonl"}, "gate": {"refuse_not_found": True}, "output": {"path": "out"}}))
    assert run.main(["validate", str(tmp_path / "c.json")], spark) == 0
    counts = json.loads(capsys.readouterr().out)
    assert counts == {"facts": 1, "entities": 1, "evidence": 2, "refused": 3}
    refused = {r["o_repr"]: r["reason"] for r in spark.read.json(str(tmp_path / "out" / "refused")).where("predicate = 'lives_in'").collect()}
    assert refused == {"Oslo": "the text contradicts it", "Bern": "the text does not state it"}
    store = str(tmp_path / "out")
    first = run.reconcile(spark, store, ["a.txt"], "2024-01-01")
    assert (first["cited"], first["retired"], first["evidence"]) == (1, 0, 1)
    second = run.reconcile(spark, store, ["b.txt", "a.txt"], "2024-01-02")
    assert (second["cited"], second["retired"], second["facts"]) == (1, 1, 1)
    assert run.reconcile(spark, store, ["b.txt"], "2024-01-03")["retired"] == 0
    assert run.reconcile(spark, store, ["b.txt"], "2024-01-03", True)["facts"] == 0


def test_eval_command(spark, tmp_path, capsys):
    gold = [{"doc_id": "d", "ord": 0, "subject": "a", "predicate": "p", "obj": "x"},
        {"doc_id": "d", "ord": 1, "subject": "a", "predicate": "q", "obj": "y"}]
    (tmp_path / "g.jsonl").write_text("\n".join(map(json.dumps, gold)))
    (tmp_path / "p.jsonl").write_text(json.dumps(gold[0]))
    run.main(["eval", str(tmp_path / "g.jsonl"), str(tmp_path / "p.jsonl")], spark)
    lines = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert [(x["predicate"], x["correct"], x["missing"]) for x in lines] == [(None, 1, 1), ("p", 1, 0), ("q", 0, 1)]
