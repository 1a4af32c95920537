"""Readers, writers, incremental runs and the provider on files made here."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from factloom import provider as P
from factloom.sinks import writers as W
from factloom.sources import html
from factloom.sources import readers as R
from factloom.streaming import micro


def test_text_and_markdown(spark, tmp_path):
    (tmp_path / "a.md").write_text("# Title\n\nBody\n## Two\n")
    r = R.read_markdown(spark, str(tmp_path)).first()
    assert r["title"] == "Title" and json.loads(r["metadata"])["headings"][1] == {"level": 2, "text": "Two"}
    assert R.read_text(spark, str(tmp_path)).first()["text"] == "# Title\n\nBody\n## Two\n"


def test_html_forms():
    text, title, modality = html.html_text("<title>T</title><h2>H</h2><p>a&amp;b<br>c<ul><li>x</ul><table><tr><th>k<td>v</table><dl><dt>t<dd>d</dl><script>no</script>")
    assert title == "T" and modality == "semi_structured" and text.split("\n")[:4] == ["## H", "a&b", "c", "- x"] and "no" not in text
    assert html.html_text("<table><tr><th>K</th><td>V</td></tr></table>")[0] == "K: V"
    assert html.html_text("<table><tr><td>a|b</td><td>c</td></tr><tr><td>d</td></tr></table>")[0] == "| a\\|b | c |\n| --- | --- |\n| d |  |"
    assert html.html_text(None) == ("", None, "unstructured") and html.html_text("<nav>n</nav>x", True)[0] == "x"


def test_records(spark, tmp_path):
    assert R.render({"a": {"b": [1, " x"]}, "c": [], "d e": None})[0] == 'a.b[0]: 1\na.b[1]: " x"\nc: []\n["d e"]: null'
    text, fields = R.render({"name": "Ada", "n": 3})
    assert all(text[s:e] == v for (s, e), v in zip(fields.values(), ("Ada", "3")))
    (tmp_path / "x.csv").write_text("a,b\n1,2\n\n3,4\n")
    assert sorted(r["text"] for r in R.read_csv(spark, str(tmp_path / "x.csv")).collect()) == ["a: 1\nb: 2", "a: 3\nb: 4"]
    (tmp_path / "dup.csv").write_text("a,a\n1,2\n")
    with pytest.raises(ValueError, match="duplicate"):
        R.read_csv(spark, str(tmp_path / "dup.csv"))
    (tmp_path / "x.json").write_text('[{"a": 1}, {"a": 2}]')
    assert sorted(r["text"] for r in R.read_json(spark, str(tmp_path / "x.json")).collect()) == ["a: 1", "a: 2"]
    (tmp_path / "y.json").write_text('{"items": [{"a": 1}], "b": 2}')
    assert [r["text"] for r in R.read_json(spark, str(tmp_path / "y.json"), "$.items").collect()] == ["a: 1"]
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{"a": "x"}\n')
    assert sorted(r["text"] for r in R.read_jsonl(spark, str(tmp_path / "x.jsonl")).collect()) == ["a: 1", "a: x"]
    (tmp_path / "bad.jsonl").write_text('{"a": 1\n')
    with pytest.raises(Exception, match="not JSON"):
        R.read_jsonl(spark, str(tmp_path / "bad.jsonl")).collect()


def test_docx(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = ('<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>Text</w:t></w:r></w:p>'
            '<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl>')
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    r = R.read_docx(spark, str(tmp_path)).first()
    assert r["text"] == "# Head\nText\n| a | b |\n| --- | --- |" and r["title"] == "Head" and r["modality"] == "semi_structured"


def test_triples_are_checked(spark, tmp_path):
    good = {"doc": "d", "subject": "s", "predicate": "p", "object": "o", "start": 0, "end": 3, "confidence": 0.5}
    (tmp_path / "t.jsonl").write_text(json.dumps(good))
    assert R.read_triples(spark, str(tmp_path / "t.jsonl")).first()["doc"] == "d"
    for change in ({"end": None}, {"confidence": 2.0}, {"schema_version": "2.0"}, {"object": None}):
        (tmp_path / "b.jsonl").write_text(json.dumps({**good, **change}))
        with pytest.raises(Exception, match="triple d"):
            R.read_triples(spark, str(tmp_path / "b.jsonl")).collect()


def test_store_is_idempotent(spark, tmp_path):
    store = W.JsonLinesStore(spark, str(tmp_path / "s"))
    e = spark.createDataFrame([("T", "a", "A"), ("T", "b", "B")], "type string, key string, label string")
    assert store.replace(entities=e) == {"entities": 2}
    new = spark.createDataFrame([("T", "b", "B2"), ("T", "c", "C")], "type string, key string, label string")
    assert store.merge(entities=new) == {"entities": 3} == store.merge(entities=new)
    assert {r["key"]: r["label"] for r in store.read("entities", e.schema).collect()} == {"a": "A", "b": "B2", "c": "C"}


def test_exports(spark, tmp_path):
    facts = spark.createDataFrame([("s1", "a", "T", "knows", "entity", "b", "T", None, "asserted", {}, None, None, 0.9),
        ("s2", "a", "T", "size", "value", None, None, 'it\'s "5"', "denied", {}, None, None, 0.5)],
                                  "sig string, s_key string, s_type string, predicate string, o_kind string, o_key string, o_type string, o_repr string, polarity string, qualifiers map<string,string>, "
                                  "outcome string, retired_at timestamp, confidence double")
    lines = [r[0] for r in W.ntriples(facts).collect()]
    assert len(lines) == 11 and sum(x.startswith("<") for x in lines) == 1 and any('\\"5\\"' in x for x in lines)
    assert any("\\'s" in r[0] for r in W.cypher(facts).collect())
    assert W.digest(facts) == W.digest(facts.orderBy(F.desc("sig"))) != W.digest(facts.limit(1))
    groups = W.transaction_groups(spark.range(25), ["id"], 10).groupBy("transaction").count()
    assert sorted(tuple(r) for r in groups.collect()) == [(0, 10), (1, 10), (2, 5)]


def test_incremental_equals_whole(spark, tmp_path):
    rows = spark.createDataFrame([(k % 5, k % 3) for k in range(60)], "claim long, source long")
    rows.repartition(6).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    store = micro.VersionedStore(spark, str(tmp_path / "store"))
    micro.upsert_stream(stream, store, micro.merge_counts(["claim"]), str(tmp_path / "ck"))
    assert store.version() == 2 and sorted(map(tuple, store.read().collect())) == sorted(map(tuple, rows.distinct().collect()))


def test_provider(spark):
    req = spark.createDataFrame([("d1", "x"), ("d2", "boom")], "doc_id string, prompt string").withColumn("cache_key",
        P.cache_key(F.col("prompt")))
    recorded = spark.createDataFrame([], P.ANSWERS)

    def model(prompt):
        if prompt == "boom":
            raise RuntimeError("no")
        return prompt.upper(), 1, 1

    got = P.answered(req, recorded, model)
    assert sorted((r["doc_id"], r["answer"], r["error"]) for r in got.collect()) == [("d1", "X", None), ("d2", None, "RuntimeError: no")]
    assert [r["doc_id"] for r in P.without_failed_documents(req, got).collect()] == ["d1"]
    assert P.answered(req, recorded).where("answer IS NOT NULL").count() == 0
