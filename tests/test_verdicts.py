"""Verdicts, column roles, escapes from copies, replacements that keep their form."""

import math

import pytest
from pyspark.sql import functions as F

from lumatab.functions import masking, text_rules
from lumatab.operators import assess, disclosure, generate, shape
from lumatab.plans.model import ColumnPlan, Relationship


def test_composite(spark):
    rows = [(0.2, 0.5, 0.9), (0.2, None, 0.9), (None, float("nan"), None)]
    got = [r[0] for r in spark.createDataFrame(rows, "j double, w double, c double").select(assess.composite(F.col("j"), F.col("w"), F.col("c"))).collect()]
    assert got[0] == pytest.approx(0.8 * 0.4 + 0.5 * 0.3 + 0.9 * 0.3) and got[1] == pytest.approx((0.8 * 0.4 + 0.9 * 0.3) / 0.7) and got[2] is None


def test_status(spark):
    df = spark.createDataFrame([(0.01,), (0.1,), (0.9,), (None,), (math.inf,), (math.nan,)], "v double")
    assert [r[0] for r in df.select(assess.status(F.col("v"), 0.05, 0.2)).collect()] == ["PASS", "REVIEW", "FAIL", "REVIEW", "REVIEW", "REVIEW"]


def test_assessment(spark):
    """Scores, issues and status, worked out by hand from the penalties."""
    good = {"singling_out_risk": 0.01, "linkability_risk": 0.0, "inference_risk": 0.05, "memorization_risk_rate": 0.05, "composite": 0.8}

    def verdict(metrics, numerical=True):
        found = spark.createDataFrame([*metrics.items()], "metric string, value double")
        return tuple(assess.assessment(assess.assessment_checks(found, numerical)).first())

    assert verdict(good) == (100, True, True, "", "PASS")
    assert verdict(good | {"correlation": 0.69, "pmse_ratio": 3.0, "spearman_score": None}) == (90, True, False, "correlation", "REVIEW")
    assert verdict(good | {"composite": math.nan}) == (85, True, False, "composite", "REVIEW")
    assert verdict({k: v for k, v in good.items() if k != "linkability_risk"}) == (None, False, True, "linkability_risk", "REVIEW")
    assert verdict({k: v for k, v in good.items() if k != "memorization_risk_rate"}) == (None, False, True, "memorization_risk_rate", "REVIEW")
    assert verdict({k: v for k, v in good.items() if k != "memorization_risk_rate"}, numerical=False) == (100, True, True, "", "PASS")
    assert verdict(good | {"inference_advantage": None, "subspace_pass": None}) == (90, False, True, "inference_advantage,subspace_pass", "REVIEW")
    bad = {"singling_out_risk": 0.2, "linkability_risk": 0.2, "memorization_risk_rate": 0.2, "subspace_pass": 0.0}
    assert verdict(good | bad) == (50, False, True, "linkability_risk,memorization_risk_rate,singling_out_risk,subspace_pass", "FAIL")
    assert verdict({k: 9.0 if k.endswith(("risk", "rate", "ratio", "advantage")) and "preservation" not in k else 0.0 for k, *_ in assess.CHECKS})[0] == 0


def test_evaluate(spark):
    df = spark.range(300).select(F.col("id"), (F.col("id") % 23).cast("double").alias("age"), (F.hash("id") % 1000).cast("double").alias("cost"), (F.col("id") % 4).cast("string").alias("g"), (F.col("id") % 3).cast("string").alias("h"))
    plan = ColumnPlan(("g", "h"), ("age", "cost"))
    copied = {r.metric: r for r in assess.evaluate(df, df, plan, ["g"], "h", "id", "id").collect()}
    assert copied["composite"].status == "PASS" and copied["exact_duplicate_rate"].status == "FAIL" and copied["overall"].status == "FAIL"
    assert copied["attack_simulation"].value is None and copied["attack_simulation"].status == "NOT_EVALUATED"
    board = assess.leaderboard(df, {"same": df, "none": None, "worse": df.withColumn("age", F.lit(1.0))}, plan).orderBy("place").collect()
    assert [b.candidate for b in board] == ["same", "worse", "none"] and board[2].status == "failed"
    assert assess.statistical_fidelity(df, df, plan).first().verdict == "EXCELLENT"


def test_metric_delta(spark):
    a, b = spark.createDataFrame([("cer", 0.4), ("old", 1.0)], "metric string, value double"), spark.createDataFrame([("cer", 0.1), ("new", 2.0)], "metric string, value double")
    got = {r.metric: r for r in assess.metric_delta(a, b, {"cer": ("reduction", 0.5)}).collect()}
    assert got["cer"].delta == pytest.approx(-0.3) and got["cer"].met and got["old"].after is None and got["new"].met is None


def test_escape_from_copies(spark):
    raw = spark.createDataFrame([(1, 50.0, "r1"), (2, 10.0, "r2"), (3, 20.0, "r2")], "id int, amount double, region string")
    made = spark.createDataFrame([(1, 50.0, "r1"), (2, 99.0, "r9")], "id int, amount double, region string")
    out = disclosure.escape_copies(raw, made, "id", ["amount", "region"], bounds={"amount": (0, 100)}).orderBy("id").collect()
    assert len(out) == 2 and out[0].amount != 50.0 and 0 <= out[0].amount <= 100 and tuple(out[1]) == (2, 99.0, "r9")
    wide = disclosure.escape_copies(raw, made, "id", ["amount", "region"], quasi=["region"]).orderBy("id").collect()
    assert wide[0].region == "GENERALIZED" and wide[1].region == "r9"
    fixed = raw.select("id", "region")
    assert disclosure.escape_copies(fixed, fixed, "id", ["region"]).count() == 0  # nothing can be moved


def test_escapes_keep_equal_rows_and_stay_narrow(spark):
    """Equal rows are all kept, the search by joins finds what the broadcast one does, and that one moves only the original's rows."""
    raw = spark.range(400).select((F.col("id") % 5).cast("int").alias("n"), F.when(F.col("id") % 7 > 0, (F.col("id") % 7).cast("double")).alias("x"), (F.col("id") % 3).cast("string").alias("g"))
    made = raw.withColumn("id", F.monotonically_increasing_id().cast("string")).unionByName(spark.createDataFrame([("twin", 1, 2.0, "1")] * 3 + [("new", 9, 9.0, "z"), ("odd", None, None, None)], "id string, n int, x double, g string"))
    for quasi in (None, ["n", "g"]):
        few = disclosure.escape_copies(raw, made, "id", ["n", "x", "g"], quasi=quasi)
        many = disclosure.escape_copies(raw, made, "id", ["n", "x", "g"], quasi=quasi, small=0)
        assert sorted(map(str, few.collect())) == sorted(map(str, many.collect()))
    out = disclosure.escape_copies(raw, made, "id", ["n", "x", "g"])
    assert out.where("id = 'twin'").count() == 3 and out.where("id IN ('new', 'odd')").count() == 2
    assert out.join(raw, [out[c].eqNullSafe(raw[c]) for c in ("n", "x", "g")], "left_semi").count() == 0
    unlike = made.select("id", F.col("n").cast("long"), F.when(F.col("x") == 3, -0.0).when(F.col("x") == 4, math.nan).otherwise(F.col("x")).cast("float").alias("x"), "g")
    same = raw.withColumn("x", F.when(F.col("x") == 3, 0.0).when(F.col("x") == 4, math.nan).otherwise(F.col("x")))
    few, many = (disclosure.escape_copies(same, unlike, "id", ["n", "x", "g"], small=size).orderBy("id", "x").collect() for size in (32 << 20, 0))
    assert list(map(str, few)) == list(map(str, many))
    finite = lambda rows: sorted(r.id for r in rows if r.x is not None and not math.isnan(r.x))
    assert finite(few) == finite(unlike.collect())
    taken = {(r.n, r.x, r.g) for r in same.collect()}
    assert not any((r.n, r.x, r.g) in taken for r in few if r.x is None or not math.isnan(r.x))  # -0.0 is 0.0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "SortMergeJoin" not in plan and "min_by" not in plan


def test_temporal_roles(spark):
    df = spark.createDataFrame([("1990-01-01", "2015-01-01", "2020-01-01", "2016-01-01", "2018-01-01", "x")], "`생년월일` string, `입사일` string, `퇴사일` string, `가입일` string, `탈퇴일` string, memo string")
    got = shape.temporal_constraints(df)
    assert {(c["before"], c["after"]) for c in got if c["type"] == "date_order"} == {("입사일", "퇴사일"), ("가입일", "탈퇴일")}
    assert next(c for c in got if c["type"] == "age_at_least" and c["reference"] == "입사일")["min_years"] == 15


def test_plans_and_profiles(spark):
    df = spark.createDataFrame([(f"u{i}@x.org", "m" if i % 2 else "f", float(i), f"note {i}") for i in range(60)], "contact string, kind string, score double, remark string")
    plan = shape.column_plan(df, {"remark": "hash"})
    assert plan.categorical == ("kind",) and plan.numerical == ("score",) and plan.pii == {"contact": "mask", "remark": "hash"}
    profiles = {"loans": ["loan_id", "amount", "start date"], "people": ["name", "age"]}
    assert shape.match_profile(["Loan ID", "amount", "x"], profiles) == "loans" and shape.match_profile(["zz"], profiles) is None and shape.match_profile([], profiles, "people 2024") == "people"
    assert shape.match_preset(["a", "b", "c"], {"one": ["a"], "two": ["a", "b"], "no": ["d"]}) == "two"
    assert shape.infer_domain("Order_Amount")[0] == "amount" and shape.infer_domain("전화")[0] == "phone" and shape.infer_domain("zzz")[0] == "text"


def test_forms_are_kept(spark):
    assert text_rules.fault("010-1234", "010-9999") is None and text_rules.fault("010-1234", "010 9999") == "literal" and text_rules.fault("ab", "a-") == "insertion"
    assert text_rules.fault("홍길동", "김*수") is None and text_rules.fault("홍", "a") == "hangul" and text_rules.fault("1", "*") == "digit" and text_rules.fault("Ab", "aB") == "case" and text_rules.fault("a", "bc") == "length" and text_rules.fault("１", "2") == "width"
    assert text_rules.restored("０１-ａ", "23x4") == "２３-４" and text_rules.view("Ａ　–①") == "A -1"
    assert text_rules.list_faults([("kim", "lee"), ("kim", "kix")]) == ["repeated"] and "overlap" in text_rules.list_faults([("kim", "lee"), ("kimm", "leee")])
    df = spark.createDataFrame([("Ａ–", "b-"), (None, "x")], "a string, b string")
    assert [tuple(r) for r in df.select(text_rules.detection_view("a"), text_rules.restore_format("a", "b"), text_rules.format_fault("a", "b")).collect()][0][:2] == ("A-", "ｂ–")


def test_whitelist(spark):
    df = spark.createDataFrame([("mail kim@x.org and lee@x.org now",), ("nothing",), (None,)], "t string")
    got = [r[0] for r in df.select(masking.inline_except(F.col("t"), ["kim@x.org"])).collect()]
    assert got == ["mail kim@x.org and l**@x.org now", "nothing", None]
    assert text_rules.whitelist([" Kim ", "", "KIM"]) == {"kim"}


def test_linked_dummies_and_repeats(spark):
    made = generate.dummy_tables(spark, {"p": (7, {"k": {"type": "sequence", "prefix": "P"}}), "c": (40, {"k": {"type": "constant", "value": ""}, "v": {"type": "choice", "values": [1, 2]}})}, [Relationship("p", "c", "k", "k")])
    assert made["c"].count() == 40 and made["c"].join(made["p"], "k", "left_anti").count() == 0
    source = spark.createDataFrame([("a",), ("b",), ("c",)], "name string")
    out = generate.repeated_output(spark.range(7).withColumn("name", F.lit("?")), source, ["name"], "id", ["name"])
    assert sorted(out.groupBy("name").count().collect(), key=lambda r: r["count"])[-1]["count"] == 3 and out.count() == 7
