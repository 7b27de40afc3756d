"""Readers on whole files: encodings, delimiters, workbooks, definitions, deep nesting."""

import io
import random
import time
import unicodedata
import zipfile

import pytest
from pyspark.sql import functions as F

from lumatab.functions import masking, text_quality, text_rules
from lumatab.operators import generate, personal_data, quantiles, running, survey
from lumatab.sources import documents, json_paths, readers, writers


def test_encoding_is_chosen_by_all_bytes(spark, tmp_path):
    lines = ["id,word", *(f"{i},plain" for i in range(9000)), "9000,한글"]
    (tmp_path / "late.csv").write_bytes("\n".join(lines).encode("cp949"))
    got = readers.load_table(spark, str(tmp_path / "late.csv"))
    assert got.count() == 9001 and got.where("id = 9000").first().word == "한글"
    (tmp_path / "odd.txt").write_bytes("a;b\n1;x,y,z\n2;p,q\n".encode())
    assert readers.load_table(spark, str(tmp_path / "odd.txt")).columns == ["a", "b"]
    (tmp_path / "quoted.csv").write_bytes('a,b\n1,"x;y;z,w"\n2,"p\nq"\n'.encode())
    assert [tuple(r) for r in readers.load_table(spark, str(tmp_path / "quoted.csv")).orderBy("a").collect()] == [(1, "x;y;z,w"), (2, "p\nq")]
    (tmp_path / "none.csv").write_bytes(b"a,b\n\xff\xff\xff,1\n")
    with pytest.raises(ValueError):
        readers.load_table(spark, str(tmp_path / "none.csv"))


def workbook(rows):
    """A workbook with shared and inline strings, a date, a boolean, a gap."""
    cell = lambda at, kind, value: f'<c r="{at}" {kind}>{value}</c>'
    words = ["이름", "when", "ok", "n", "가 & 나"]
    body = "".join(f"<row>{''.join(cell(*c) for c in row)}</row>" for row in rows)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns:r="r"><sheets><sheet name="s" r:id="rId7"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId7" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", "<sst>" + "".join(f"<si><t>{w.replace('&', '&amp;')}</t></si>" for w in words) + "</sst>")
        z.writestr("xl/styles.xml", '<styleSheet><numFmts><numFmt numFmtId="170" formatCode="yyyy&quot;년&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet><sheetData>{body}</sheetData></worksheet>")
    return out.getvalue()


def test_workbooks(spark, tmp_path):
    head = [(f"{c}1", 't="s"', f"<v>{i}</v>") for i, c in enumerate("ABCD")]
    (tmp_path / "w.xlsx").write_bytes(
        workbook([head, [("A2", 't="s"', "<v>4</v>"), ("B2", 's="1"', "<v>45292</v>"), ("C2", 't="b"', "<v>1</v>"), ("D2", "", "<v>2.50</v>")], [("A3", 't="inlineStr"', "<is><t>in</t></is>"), ("B3", 's="2"', "<v>45292.5</v>"), ("D3", "", "<v>7.0</v>")]])
    )
    got = readers.load_table(spark, str(tmp_path / "w.xlsx"))
    assert got.columns == ["이름", "when", "ok", "n"]
    assert [tuple(r) for r in got.orderBy("when").collect()] == [("가 & 나", "2024-01-01", "true", "2.50"), ("in", "2024-01-01 12:00:00", None, "7")]


def test_definitions():
    ddl = """-- users, with a comma
    CREATE TABLE IF NOT EXISTS app."users" (id BIGSERIAL PRIMARY KEY, "e,mail" VARCHAR(80) NOT NULL UNIQUE DEFAULT 'a, b', age INT CHECK (age BETWEEN -1 AND 99), score DECIMAL(5, 2) CHECK (score >= 0 AND score < 10.5));
    create table orders (no int, user_id int, note text, constraint pk primary key (no, user_id), foreign key (user_id) references users (id), unique (note));"""
    got = readers.import_schema("ddl", ddl)
    users, orders = got["tables"]
    assert [c["name"] for c in users["columns"]] == ["id", "e,mail", "age", "score"] and [c["type"] for c in users["columns"]] == ["bigint", "string", "bigint", "double"]
    assert users["columns"][0]["primary_key"] and not users["columns"][1]["nullable"] and users["columns"][1]["unique"]
    assert (users["columns"][2]["min"], users["columns"][2]["max"]) == (-1.0, 99.0) and (users["columns"][3]["min"], users["columns"][3]["max"]) == (0.0, 10.5)
    assert [c["primary_key"] for c in orders["columns"]] == [True, True, False] and orders["columns"][2]["unique"]
    assert got["links"] == [{"parent_table": "users", "child_table": "orders", "parent_key": "id", "child_key": "user_id"}]


def test_deep_nesting_is_passed_over(spark):
    deep = "[" * 100_000
    rows = [(1, deep), (2, '{"a": 1}'), (3, deep + "]" * 100_000), (4, '{"x":' * 50_000), (5, "<a>" * 20_000), (6, deep + ' {"b": 2}')]
    df = spark.createDataFrame(rows, "id long, t string")
    began = time.process_time()
    cells = documents.embedded_cells(df, "id", "t").collect()
    assert sorted((c.id, c.field, c.value) for c in cells) == [(2, "a", "1"), (6, "b", "2")]
    assert {r.path: r.kinds for r in json_paths.path_statistics(df, "t").collect()} == {"$": "invalid,object", "/a": "integer"}
    assert time.process_time() - began < 60
    list(documents.embedded("<a>" * 100_000))
    with pytest.raises(Exception):
        documents.document_table(df.where("id = 1"), "t", "json", ["a"]).collect()


def test_names_and_packages():
    assert writers.safe_name("a/b: c?.csv") == "a_b_c_.csv" and writers.safe_name("../..") == "table"
    data = writers.package({"r/1.txt": b"one", "r:1.txt": b"two"})
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert {n: z.read(n) for n in z.namelist()} == {"r_1.txt": b"one", "r_1_2.txt": b"two"}
    assert data == writers.package({"r/1.txt": b"one", "r:1.txt": b"two"})


def test_whole_text_masks(spark):
    rows = [("담당자: 홍길동 900101-1** abc", "담당자: 홍*동 900101-1******abc"), ("[RRN Omitted by law] 남궁민 씨", "[주민등록번호-****] 남궁* 씨"), ("9001011** x", "900101-1******x"), (None, None), ("홍길동 went home", "홍길동 went home")]
    df = spark.createDataFrame(rows, "t string, want string")
    got = df.select(masking.inline(F.col("t"), personal_data.names_masked).alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]
    nfd = unicodedata.normalize("NFD", "é한글")
    assert spark.createDataFrame([(nfd,)], "t string").select(text_quality.normalised(F.col("t")).alias("x")).first().x == "é한글"


def test_replacement_lists(spark):
    items = [("Kim1", "Lee2"), ("Kim1", "Lee3"), ("Ann", "Bob"), ("Anna", "Kate"), ("x", "x"), ("Joe9", "Annx"), ("long", "short")]
    got = text_rules.replacement_faults(spark.createDataFrame(items, "a string, b string"), "a", "b").collect()
    found = {(r.original, r.fault) for r in got}
    assert {("Kim1", "repeated"), ("Anna", "overlap"), ("x", "blank"), ("x", "leak"), ("Joe9", "leak"), ("long", "length")} <= found
    assert not any(o == "Ann" for o, _ in found)


def test_originals_inside_other_texts(spark):
    """Against plain loops, with originals looked up in tasks, by the join, and both; and without pairs of all texts that share their rarest characters."""
    r = random.Random(4)
    words = ["".join(r.choice("abé홍1 ") for _ in range(r.choice([1, 2, 3, 4, 5, 7, 8, 9, 17, 70]))) for _ in range(150)]
    items = [(w, r.choice(words) + r.choice(["", "x", r.choice(words)])) for w in words] + [(None, words[0]), ("", words[1]), (words[3], None)]
    originals = {a for a, _ in items if a}
    want = {(a, b, "leak") for a, b in items if b and any(o in b for o in originals)} | {(a, b, "overlap") for a, b in items if a and any(o != a and o in a for o in originals)}
    df = spark.createDataFrame(items, "a string, b string")
    for shortest in (0, 20, 8192):
        got = [tuple(x) for x in text_rules.replacement_faults(df, "a", "b", shortest).collect() if x.fault in ("leak", "overlap")]
        assert len(got) == len(set(got)) and set(got) == want
    alike = spark.range(20_000, 40_000).select(F.concat(F.lit("Order 1"), F.col("id").cast("string")).alias("a"), F.lit("y").alias("b"))
    for shortest in (0, 8192):
        faults = text_rules.replacement_faults(alike.unionByName(spark.createDataFrame([("r 1200", "y")], "a string, b string")), "a", "b", shortest).where("fault = 'overlap'")
        assert faults.count() == 100
        assert "Contains" not in faults._jdf.queryExecution().optimizedPlan().toString()  # no pairs to try


def test_holdout_is_exact(spark):
    df = spark.range(107)
    fit, control = generate.holdout(df, "id")
    assert (fit.count(), control.count()) == (86, 21) and fit.join(control, "id").count() == 0
    assert [x.count() for x in generate.holdout(spark.range(20), "id")] == [20, 0]


def test_people_agree_with_their_rows(spark):
    df = spark.createDataFrame([(i, i % 80, "여" if i % 2 else "male", "부산광역시" if i % 3 else None) for i in range(200)], "id long, age int, sex string, place string")
    for r in generate.fake_people(df, {"ssn": "ssn", "tel": "phone", "who": "name"}, "id", "2024-06-30", "age", "sex", "place").collect():
        year = int(r.ssn[:2]) + (2000 if r.ssn[7] in "34" else 1900)
        born = (year, int(r.ssn[2:4]), int(r.ssn[4:6]))
        assert 2024 - year - (born[1:] > (6, 30)) == r.age and (r.ssn[7] in "24") == (r.sex == "여")
        assert r.tel.startswith("051-" if r.place else "010-") and len(r.who) == 3


def test_modules_that_do_not_match(spark):
    a = spark.createDataFrame([(1, "x", 1), (2, "y", 2)], "k int, c string, p int")
    b = spark.createDataFrame([(1, "x", 1), (2, "z", 2)], "k int, c string, q int")
    got = {r.module: (r.missing_keys, r.aligned) for r in survey.inspect({"a": a, "b": b, "c": a.where("k = 1")}, "k").collect()}
    assert got == {"a": (0, True), "b": (0, False), "c": (1, False)}


def test_many_ranges(spark):
    """Running totals over more ranges than one tree of comparisons takes."""
    df = spark.range(5000).select(F.lit("g").alias("g"), F.col("id").cast("double").alias("v"), F.lit(1).alias("n"))
    got = running.running_totals(df, "g", "v", {"upto": "n"}, "after", parts=300)
    assert got.where("upto <> v + 1 OR NOT (after <=> IF(v < 4999, v + 1, NULL))").count() == 0
    assert quantiles.quantiles(df, {"v": F.col("v")}, [0.0, 0.25, 1.0]) == {"v": [0.0, 1249.75, 4999.0]}
