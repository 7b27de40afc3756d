"""Masks, tokens, text measures, JSON paths, readers, writers, generators, surveys, streams."""

import hashlib
import hmac
import json
import re

import pytest
from pyspark.sql import functions as F

from lumatab.functions import masking, text_quality
from lumatab.operators import generate, personal_data, profile, survey
from lumatab.plans.model import ColumnPlan, Relationship
from lumatab.sources import json_paths, readers, writers

MASKED = [
    ("ssn", "900101-1234567", "900101-1******"), ("ssn", "9001011234567", "9001011******"), ("ssn", "900101-1***", "900101-1******"),
    ("phone", "010-1234-5678", "010-****-5678"), ("phone", "02-123-4567", "02-***-4567"), ("phone", "01012345678", "010****5678"),
    ("email", "honggildong@domain.com", "hon*****@domain.com"), ("email", "abc@domain.com", "ab*@domain.com"), ("email", "a@domain.com", "*@domain.com"),
    ("address", "서울특별시 강남구 테헤란로 152 23층", "서울특별시 강남구 테헤란로 *** ***"), ("account", "110-123-456789", "110-***-456789"), ("account", "352-1234-5678-03", "352-****-****-03"),
    ("credit_card", "1234-5678-9012-3456", "1234-56**-****-3456"), ("business_number", "123-45-67890", "123-45-*****"), ("corporate_number", "123456-1234567", "123456-*******"),
    ("car_plate", "12가 3456", "12가 ****"), ("driver_license", "11-20-123456-78", "11-20-******-**"), ("passport", "m12345678", "M********"), ("ip_address", "192.168.1.100", "192.168.1.***"),
    ("date", "1990-05-21", "1990-05-**"), ("date", "1990.5.2", "1990-05-**"), ("mac_address", "00:1A:2B:3C:4D:5E", "00:1A:2B:**:**:**"), ("uuid", "123e4567-e89b-12d3-a456-426614174000", "123e4567-****-****-****-************"),
    ("tracking_no", "6521-1234-5678", "6521-****-5678"), ("order_no", "20260908-0001234", "20260908-*******"), ("health_insurance", "1-123456789-0", "1-12345****-*"), ("military_no", "23-71012345", "23-71******"),
    ("parcel_number", "1168010100101230001", "11680101001********"), ("patient_id", "PT-2024-001234", "PT-2024-******"), ("student_id", "2023123456", "202312****"), ("employee_id", "EMP-2023-0145", "EMP-2023-****"), ("employee_id", "E2024001", "E202****"),
    ("name", "홍길동", "홍*동"), ("name", "김철", "김*"), ("name", "황보연", "황보*"), ("name", "남궁민수", "남궁*수"), ("name", "신사임당", "신**당"), ("name", "홍길동 연구원", "홍*동 연구원"), ("name", "김철수 박사(책임)", "김*수 박사(책임)"),
    ("name", "홍길동, 김철수", "홍*동, 김*수"), ("name", "홍 길 동", "홍 * 동"), ("name", "John Doe", "J**n D*e"), ("name", "성명: 홍길동", "성명: 홍*동"),
    ("generic", "a", "*"), ("generic", "ab", "a*"), ("generic", "abc", "a*c"), ("generic", "abcd", "a**d"), ("generic", "abcdef", "ab***f"), ("generic", "abcdefghij", "abc****hij"),
]


def test_masks(spark):
    df = spark.createDataFrame(MASKED, "kind string, value string, want string")
    kinds = sorted({k for k, *_ in MASKED})
    got = F.lit(None).cast("string")
    for k in kinds:
        got = F.when(F.col("kind") == k, masking.mask(F.col("value"), k)).otherwise(got)
    wrong = [tuple(r) for r in df.withColumn("got", got).where("NOT got <=> want").collect()]
    assert not wrong


def test_unknown_values_stay(spark):
    df = spark.createDataFrame([("hello",), (None,), (" ",), ("010-1234-5678",), ("call 010-1234-5678 now",)], "v string")
    assert [r[0] for r in df.select(masking.mask(F.col("v"))).collect()] == ["hello", None, " ", "010-****-5678", "call 010-****-5678 now"]


def test_inline(spark):
    cases = [
        ("id 900101-1234567.", "id 900101-1******."), ("jinwoo.park84@mockmail.kr", "jin*****@mockmail.kr"), ("ab@x.org", "a*@x.org"), ("11-19-284719-01", "11-19-******-01"), ("M38491827", "M38****27"),
        ("1234-5678-9012-3456", "1234-56**-****-3456"), ("482901-01-382910", "482901-**-38****"), ("02-412-8823", "02-****-8823"), ("서울시 송파구 올림픽로 300 102동", "서울시 송파구 ********"), ("nothing here", "nothing here"),
    ]
    got = [r[0] for r in spark.createDataFrame(cases, "t string, w string").select(masking.inline(F.col("t"))).collect()]
    assert got == [w for _, w in cases]


def test_tokens(spark):
    df = spark.createDataFrame([(" kim ",), (None,), ("",)], "v string")
    tok = lambda *a: [r[0] for r in df.select(masking.token(F.col("v"), *a)).collect()]
    want = "CUST-" + hmac.new(b"s3", b"v1\x1fp\x1fcust_id\x1fkim", hashlib.sha256).hexdigest()[:20].upper()
    assert tok(b"s3", "p", "cust_id") == [want, None, ""]
    assert tok(b"s3", "p2", "cust_id") != tok(b"s3", "p", "cust_id") and tok(b"k" * 100, "p", "c")[0] == "C-" + hmac.new(b"k" * 100, b"v1\x1fp\x1fc\x1fkim", hashlib.sha256).hexdigest()[:20].upper()
    with pytest.raises(ValueError):
        masking.token(F.col("v"), b"", "p", "c")


def test_plan_and_scan(spark):
    df = spark.createDataFrame([(f"user{i}@x.org", "secret", f"010-1234-{i:04d}", i, "A") for i in range(20)], "contact string, `성명` string, line string, n int, other string")
    out = personal_data.apply_plan(df, ColumnPlan(pii={"contact": "mask", "성명": "drop", "line": "hash"}))
    assert out.columns == ["contact", "line", "n", "other"] and out.where("contact LIKE '%user%'").count() == 0
    got = {r.column_name: (r.kind, r.source) for r in personal_data.scan(df).collect()}
    assert got == {"contact": ("email", "value"), "성명": ("name", "name"), "line": ("phone_number", "value"), "n": (None, None), "other": (None, None)}


def test_entities(spark):
    rows = [(1, "담당자: 홍길동 입니다"), (2, "김철수 과장은 한국은행에 갔다"), (3, "사과가 맛있다"), (4, None), (5, "서울특별시 공고")]
    got = {(r.id, r.kind, r.entity, r.start, r.stop) for r in personal_data.entities(spark.createDataFrame(rows, "k int, t string"), "k", "t").collect()}
    assert (1, "PERSON_NAME", "홍길동", 5, 8) in got and (2, "PERSON_NAME", "김철수", 0, 3) in got and (5, "LOCATION", "서울특별시", 0, 5) in got
    assert not any(i in (3, 4) for i, *_ in got)


def test_error_rates(spark):
    df = spark.createDataFrame([("abc", "abd"), ("", ""), ("", "x"), ("a b c", "a c")], "a string, b string")
    got = [tuple(r) for r in df.select(text_quality.character_error_rate(F.col("a"), F.col("b")), text_quality.word_error_rate("a", "b"), text_quality.sequence_ratio("a", "b")).collect()]
    assert [r[0] for r in got] == pytest.approx([1 / 3, 0, 1, 2 / 5]) and [r[1] for r in got] == pytest.approx([1, 0, 1, 1 / 3]) and got[0][2] == pytest.approx(2 / 3)


def test_text_measures(spark):
    one = lambda text, *cols: spark.createDataFrame([(text,)], "t string").select(*cols).first()
    t = F.col("t")
    assert one("aaab", text_quality.repeated(t))[0] == pytest.approx(0.25) and one("가나ab", text_quality.share(t, text_quality.HANGUL))[0] == 0.5
    assert one("----------", text_quality.is_noise(t))[0] and not one("hello there", text_quality.is_noise(t))[0]
    assert one("정책 데이터 분석을 위한 계획은 필요하다", text_quality.prose_quality(t))[0] > 0.6 and one("", text_quality.prose_quality(t))[0] == 0 and one("abc", text_quality.prose_quality(t))[0] == 0.35
    assert one("2O24 - O1 - l5", text_quality.digits_repaired(t))[0] == "2024-01-15" and one("Ol", text_quality.digits_repaired(t))[0] == "Ol"
    assert one("a\r\nb\x07", text_quality.normalised(t))[0] == "a\nb" and one("x?token=abc&y=1", text_quality.redacted(t))[0] == "x?token=[REDACTED]&y=1"
    assert one("가나", text_quality.needs_second_look(t, F.lit(0.9)))[0] is False and one("", text_quality.needs_second_look(t, F.lit(0.9)))[0]
    assert one("aabc", text_quality.coverage(t, F.lit("abx")))[0] == 0.5


def test_json_paths(spark):
    docs = [json.dumps({"a": 1, "b": {"c": ""}, "l": [1, 0]}), json.dumps({"a": None, "b": {}, "l": []}), json.dumps({"x/y": False}), "oops", None]
    got = {r.path: r for r in json_paths.path_statistics(spark.createDataFrame([(d,) for d in docs], "j string"), "j").collect()}
    assert (got["/a"].kinds, got["/a"].nulls, got["/a"].missing) == ("integer,null", 1, None)  # the root is no object everywhere
    assert (got["/l/*"].occurrences, got["/l/*"].zeros) == (2, 1) and got["/b/c"].empties == 1 and got["/b/c"].missing == 1 and got["/x~1y"].falses == 1
    assert json_paths.pointer({"a/b": [{"c": 3}]}, "/a~1b/0/c") == 3 and json_paths.record_lists({"r": {"items": [{}]}, "n": [1]}) == [("/r/items", 1)]


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("이름;값\n가;1\n나;2\n".encode("cp949"))
    assert [tuple(r) for r in readers.load_table(spark, str(tmp_path / "a.csv")).orderBy("값").collect()] == [("가", 1), ("나", 2)]
    (tmp_path / "b.json").write_text(json.dumps({"items": [{"x": 1}, {"x": 2}]}))
    assert readers.load_table(spark, str(tmp_path / "b.json")).count() == 2
    (tmp_path / "c.jsonl").write_text('{"x": 1}\n{"x": 2}\n')
    assert readers.load_table(spark, str(tmp_path / "c.jsonl")).count() == 2
    (tmp_path / "d.md").write_text("# T\n\none\n\n\ntwo\n")
    assert [r.text for r in readers.load_table(spark, str(tmp_path / "d.md")).orderBy("paragraph").collect()] == ["# T", "one", "two"]
    (tmp_path / "e.csv").write_text("a,A\n1,2\n")
    with pytest.raises(ValueError):
        readers.read_delimited(spark, str(tmp_path / "e.csv"), strict=True)
    with pytest.raises(ValueError):
        readers.load_table(spark, "x.exe")
    (tmp_path / "r.json").write_text(json.dumps({"response": {"header": {}, "body": {"items": [{"x": 1}]}}}))
    assert readers.load_table(spark, str(tmp_path / "r.json")).columns == ["x"]


def test_schema_import():
    ddl = "CREATE TABLE users (id INT PRIMARY KEY, email VARCHAR(50) UNIQUE NOT NULL, age INT, CHECK (age BETWEEN 18 AND 99)); CREATE TABLE orders (id INT, user_id INT, amount DECIMAL(10,2), PRIMARY KEY (id), FOREIGN KEY (user_id) REFERENCES users(id));"
    got = readers.import_schema("ddl", ddl)
    assert [t["name"] for t in got["tables"]] == ["users", "orders"] and len(got["links"]) == 1
    age = next(c for c in got["tables"][0]["columns"] if c["name"] == "age")
    assert (age["min"], age["max"]) == (18.0, 99.0) and readers.spark_schema(got["tables"][1]) == "`id` bigint NOT NULL, `user_id` bigint, `amount` double"
    assert readers.import_schema("json-schema", json.dumps({"title": "t", "properties": {"a": {"type": "integer", "minimum": 1}}, "required": ["a"]}))["tables"][0]["columns"][0]["min"] == 1
    with pytest.raises(ValueError):
        readers.import_schema("ddl", "SELECT 1")


def test_writers(spark):
    df = spark.createDataFrame([(1, "it's \\ ok", True, 1.5), (2, None, False, float("nan"))], "n int, s string, b boolean, d double")
    assert [r[0] for r in df.orderBy("n").select(writers.insert_rows(df)).collect()] == ["(1, 'it''s \\\\ ok', TRUE, 1.5)", "(2, NULL, FALSE, NULL)"]
    many = spark.range(1203).select(F.col("id").alias("n"))
    got = writers.insert_statements(many, "t;", ["n"]).orderBy("statement_no").collect()
    assert [s.statement.count("\n  (") for s in got] == [500, 500, 203] and got[1].statement.startswith("INSERT INTO `t` (`n`) VALUES\n  (500)")
    assert writers.markdown(df.select("n", "s"), ["n"]).splitlines()[-1] == "| 2 |  |"
    assert "<td>1</td>" in writers.html(df, ["n"])
    page = json.loads(writers.envelope_pages(many.limit(25).orderBy("n"), "n", 10).orderBy("page_no").collect()[2].body)
    assert page["response"]["body"]["totalCount"] == 25 and page["response"]["body"]["numOfRows"] == 5
    tree = {"a": [1, 2.5, None, True], "b": {}, "c": "<x & y>", "d": ""}
    assert writers.from_typed_xml(writers.typed_xml(tree)) == tree
    assert writers.checksum(df).first().checksum == writers.checksum(df.repartition(3)).first().checksum
    assert writers.conversion(".CSV", "markdown") == ("csv", "md")
    for bad in ({"n": "n"}, {"n": "a", "s": "A", "b": "b", "d": "d"}):
        with pytest.raises(ValueError):
            writers.renamed(df, bad)


def test_profile(spark):
    df = spark.createDataFrame([(i, f"name{i}", "남" if i % 2 else "여", float(i % 40), None if i % 5 == 0 else "x") for i in range(50)], "`고객ID` int, `성명` string, `성별` string, `연령` double, note string")
    kinds = {r.column_name: r.kind for r in profile.infer_kinds(df).collect()}
    assert kinds["연령"] == "numerical" and kinds["성별"] == "categorical"
    stats = {r.column_name: r for r in profile.column_profile(df).collect()}
    assert stats["note"].nulls == 10 and stats["고객ID"].distinct_values == 50 and stats["연령"].max_value == 39.0
    assert profile.completeness(df).first().missing_cells == 10 and profile.completeness(df.where("false")).first().completeness_score is None
    assert [c for c in profile.key_pairs({"customer": ["c_custkey"], "orders": ["o_orderkey", "o_custkey"]}) if c[3] == "o_custkey"] == [("customer", "c_custkey", "orders", "o_custkey")]


def test_temporal_summary(spark):
    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 01:00:00"), (1, "2024-01-01 01:00:00"), (1, "2024-01-01 02:00:00"), (1, "2024-01-03 02:00:00"), (2, None), (3, "2024-05-01 00:00:00")]
    df = spark.createDataFrame(rows, "e int, t string").select("e", F.col("t").cast("timestamp").alias("t"))
    got = {r.e: r for r in profile.temporal_summary(df, "t", ["e"]).collect()}
    assert (got[1].valid, got[1].repeated, got[1].modal_interval, got[1].gaps) == (5, 1, 3600.0, 1) and got[3].modal_interval is None and 2 not in got
    assert profile.temporal_summary(df, "t").first().distinct_moments == 5


def test_generated_columns(spark):
    spec = {"n": {"type": "number_range", "min": 1.2, "max": 4.8, "integer": True}, "c": {"type": "choice", "values": ["a", "b"], "weights": [9, 1], "unique": True}, "p": {"type": "pattern", "format": "?#-x"}}
    df = generate.dummy_table(spark, 300, spec)
    assert {r.n for r in df.select("n").distinct().collect()} == {2, 3, 4} and df.select("c").distinct().count() == 300
    assert all(re.fullmatch(r"[A-Z]\d-x", r.p) for r in df.collect())
    assert df.orderBy("row_id").collect() == generate.dummy_table(spark, 300, spec).repartition(7).orderBy("row_id").collect()
    with pytest.raises(ValueError):
        generate.rule_column({"type": "number_range", "min": 0.2, "max": 0.8, "integer": True}, 1, "x")
    edge = {r.row_id: r for r in generate.dummy_table(spark, 100, spec, scenario="mixed").collect()}
    assert edge[0].n == 4.8 + 4.8 + 1 and sum(r.p is None for r in edge.values()) == 5


def test_tables_with_links(spark):
    users = spark.createDataFrame([(i, f"u{i}", 20 + i % 30) for i in range(25)], "user_id int, user_name string, age int")
    orders = spark.createDataFrame([(i, i % 25, float(i)) for i in range(75)], "order_id int, user_id int, order_amount double")
    made = generate.relational_sample({"users": users, "orders": orders}, [Relationship("users", "orders", "user_id", "user_id")], {"users": "user_id", "orders": "order_id"}, 2.0)
    assert made["users"].count() == 50 and made["orders"].select("order_id").distinct().count() == 150
    assert profile.containment(made["users"], "user_id", made["orders"], "user_id").first().orphan_rows == 0


def test_panel_and_samples(spark):
    df = spark.createDataFrame([("a", "2024-01-01", 1), ("a", "2024-01-02", 2), ("b", "2024-01-01", 5), ("b", "2024-01-02", 6)], "member_id string, date string, value int").withColumn("date", F.col("date").cast("timestamp"))
    got = generate.panel_sample(df, "member_id", "date", 3)
    assert got.count() == 6 and got.select("member_id").distinct().count() == 3
    base = spark.range(400).select(F.col("id"), (F.col("id") % 10).cast("double").alias("x"), (F.col("id") % 10 * 2.0).alias("y"), (F.col("id") % 4).cast("string").alias("g"))
    made = generate.marginal_sample(base, 500, ["g"], ["x"], {"g": "1"})
    assert made.count() == 500 and made.select("g").distinct().collect()[0].g == "1"
    assert generate.copula_sample(base, 400, ["x", "y"]).select(F.corr("x", "y")).first()[0] > 0.9
    fit, control = generate.holdout(base, "id")
    assert fit.count() + control.count() == 400 and 40 < control.count() < 120 and generate.holdout(base.limit(10), "id")[1].count() == 0
    noisy = generate.laplace_noise(base, ["x"], "id")
    assert noisy.where("x <> floor(x)").count() == 0 and generate.laplace_noise(base, ["x"], "id", 0).exceptAll(base).count() == 0
    with pytest.raises(RuntimeError):
        generate.accepted_sample(base, lambda n, i: base.limit(n), 5, ["id", "x", "y", "g"], policy="strict", max_attempts=2)


def test_survey(spark):
    scale = ["매우 불만족", "불만족", "보통", "만족", "매우 만족"]
    df = spark.createDataFrame([(i, (scale + ["미응답"])[i % 6], "아니오" if i % 2 else "예", "미응답" if i % 2 else "좋음") for i in range(60)], "i int, r string, took string, why string")
    found = survey.likert_columns(df, ["r", "took", "why"], [scale]).collect()
    assert [(f.column_name, f.overlap, f.has_unanswered) for f in found] == [("r", 5, True)]
    back = survey.decode_likert(survey.encode_likert(df, {"r": scale}), {"r": scale})
    assert back.exceptAll(df).count() == 0
    rules = [(r.condition_column, r.condition_value, r.target_column) for r in survey.skip_rules(df, ["r", "took", "why"]).collect()]
    assert rules == [("took", "아니오", "why")]
    broken = df.withColumn("why", F.lit("좋음"))
    assert survey.skip_compliance(broken, rules).first().status == "REVIEW" and survey.skip_compliance(survey.apply_skips(broken, rules), rules).first().status == "PASS"
    assert survey.skip_compliance(df, [("took", "없는 답", "why")]).first().status == "NOT_EVALUATED"
    fused = survey.fuse({"a": df.select("i", "r"), "b": df.select("i", "took", "why")}, "i", [])
    assert survey.split(fused, ["a", "b"], "i")["b"].exceptAll(df.select("i", "took", "why")).count() == 0


def test_stream(spark, tmp_path):
    from lumatab.streaming.observe import windowed_observations

    spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 05:00:00", "a", None), ("2024-01-02 00:00:00", "a", 0.0)], "ts string, k string, v double").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, k string, v double").parquet(str(tmp_path / "in"))
    run = windowed_observations(stream, "ts", "k", "v").writeStream.outputMode("complete").format("memory").queryName("observed").trigger(availableNow=True).start()
    run.awaitTermination()
    assert [(r.seen, r.nulls, r.zeros) for r in spark.table("observed").orderBy("window_start").collect()] == [(2, 1, 0), (1, 0, 1)]


def test_statement_numbers_over_many_ranges(spark):
    """Numbers without gaps or repeats when ranges are cut from a sample and no partition is merged, against plain sorting."""
    from lumatab.operators.running import row_numbers

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        many = spark.range(0, 60_000, 1, 7).select((F.col("id") * 7919 % 60_000).alias("n"))
        got = writers.insert_statements(many, "t", ["n"], 500).orderBy("statement_no").collect()
        assert [r.statement_no for r in got] == list(range(120))
        assert all(r.statement == "INSERT INTO `t` (`n`) VALUES\n" + ",\n".join(f"  ({n})" for n in range(i * 500, i * 500 + 500)) + ";" for i, r in enumerate(got))
        rows = [(None if i % 11 == 0 else f"k{i % 97}", None if i % 13 == 0 else float(i % 7), i) for i in range(3000)]
        want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or 0.0, r[2]))
        mixed = spark.createDataFrame(rows, "a string, b double, i int").repartition(5, "i")
        for part_rows in (10, 100, 10_000):
            numbered = row_numbers(mixed, ["a", "b"], ["i"], "at", part_rows).orderBy("at").collect()
            assert [tuple(r) for r in numbered] == [(*r, at) for at, r in enumerate(want)]
        assert row_numbers(mixed.where("i < 0"), ["a"], ["i"], "at").count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
