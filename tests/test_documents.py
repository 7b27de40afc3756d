"""Strict documents, documents inside text, writers and registered generators."""

import json

import pytest
from pyspark.sql import functions as F

from lumatab.operators import assess, generate
from lumatab.plans.model import ColumnPlan
from lumatab.sources import documents, json_paths, readers, writers


def test_records():
    assert documents.records('{"response": {"header": {}, "body": {"items": [{"a": 1}], "totalCount": 1}}}', "json") == [{"a": 1}]
    assert documents.records('{"meta": {"n": 1}, "data": [{"a": 1}, {"a": 2}]}', "json") == [{"a": 1}, {"a": 2}]
    assert documents.records('{"name": "x", "tags": [{"t": 1}]}', "json") == [{"name": "x", "tags": [{"t": 1}]}]  # one record with a list of its own
    assert documents.records('{"a": [{"x": 1}], "b": [{"y": 1}]}', "json", "/b") == [{"y": 1}]
    assert documents.records("<response><body><items><item><a>1</a></item><item><a>2</a></item></items></body></response>", "xml") == [{"a": "1"}, {"a": "2"}]
    for bad, kind in (('{"a": 1, "a": 2}', "json"), ('{"a": NaN}', "json"), ('{"a": [{"x": 1}], "b": [{"y": 1}]}', "json"), ("[1, 2]", "json"), ("<!DOCTYPE x><a/>", "xml"), ("<a>t<b/></a>", "xml")):
        with pytest.raises(ValueError):
            documents.records(bad, kind)
    with pytest.raises(ValueError):
        documents.records('{"data": [{"a": 1}]}', "json", max_cells=0)


def test_flat_xml():
    rows = documents.xml_rows('<rows><row id="7"><t>a</t><t>b</t><p><x>1</x></p><p><x>2</x></p><n xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance" xsi:nil="true"/></row></rows>')
    assert rows == [{"@id": "7", "t": "a | b", "p[0].x": "1", "p[1].x": "2", "n": None}]
    assert documents.xml_rows('<records><record><field name="a b">1</field></record></records>') == [{"a b": "1"}]


def test_documents_in_text(spark):
    text = 'Answer: {"resultCode": "00", "items": [{"n": 1, "d": "2024-01-02"}]} then {broken and <response><header><code>00</code></header><body><items><item><v>3.5</v></item></items></body></response> end'
    got = documents.embedded_cells(spark.createDataFrame([(1, text), (2, None), (3, "no {data} <here>")], "k int, t string"), "k", "t").collect()
    cells = {(r.document_no, r.kind, r.part, r.field, r.value, r.value_kind) for r in got}
    assert cells == {(0, "json", "meta", "resultCode", "00", "integer"), (0, "json", "record", "n", "1", "integer"), (0, "json", "record", "d", "2024-01-02", "string"), (1, "xml", "meta", "code", "00", "integer"), (1, "xml", "record", "v", "3.5", "number")}


def test_document_table(spark):
    df = spark.createDataFrame([(json.dumps({"data": [{"a": 1, "b": {"c": True}}, {"a": None}]}),), (None,)], "j string")
    assert [tuple(r) for r in documents.document_table(df, "j", "json", ["a", "b"]).collect()] == [("1", '{"c": true}'), (None, None)]


def test_written_tables_read_back(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q", x\ty', True), (2, None, False)], "n int, s string, b boolean")
    for kind in ("csv", "tsv", "jsonl", "parquet"):
        writers.write_table(df, f"{tmp_path}/t.{kind}", kind)
        back = readers.load_table(spark, f"{tmp_path}/t.{kind}") if kind != "csv" else spark.read.option("header", True).option("escape", '"').csv(f"{tmp_path}/t.{kind}")
        assert [r.s for r in back.orderBy(F.col("n").cast("int")).collect()] == ['a "q", x\ty', None], kind
    for kind in ("xml", "sql"):
        writers.write_table(df, f"{tmp_path}/t.{kind}", kind)
        assert spark.read.text(f"{tmp_path}/t.{kind}").count() == 2
    with pytest.raises(ValueError):
        writers.write_table(df, f"{tmp_path}/x", "doc")


def test_generators_by_name(spark):
    df = spark.range(200).select((F.col("id") % 3).cast("string").alias("g"), (F.col("id") % 17).cast("double").alias("x"), (F.col("id") % 5).cast("double").alias("y"))
    plan = ColumnPlan(("g",), ("x", "y"))
    for name in ("statistical", "gaussian_copula", "bootstrap"):
        made = generate.generate(name, df, 50, plan)
        assert made.count() == 50 and set(made.columns) == {"row_id", "g", "x", "y"}
    with pytest.raises(ValueError):
        generate.generate("none", df, 5, plan)
    with pytest.raises(ValueError):
        generate.register("bootstrap")(print)


def test_attention(spark):
    docs = [json.dumps({"total": 1, "status_flag": "ok", "note": ""}), json.dumps({"total": 2, "status_flag": "bad"})]
    got = {(r.path, r.note): r.share for r in assess.attention(json_paths.path_statistics(spark.createDataFrame([(d,) for d in docs], "j string"), "j")).collect()}
    assert got == {("/total", "may_be_derived"): None, ("/status_flag", "may_be_flag"): None, ("/note", "missing"): 1.0}
