"""Groups, copies, distances and inference, with verdicts that never pass unmeasured."""

import pytest

from lumatab.operators import disclosure


def test_klt(spark):
    rows = [("20s", "A", "flu"), ("20s", "A", "cold"), ("30s", "B", "flu"), ("30s", "B", "cold")]
    got = disclosure.klt(spark.createDataFrame(rows, "age_band string, region string, diagnosis string"), ["age_band", "region"], ["diagnosis"], k=2).first()
    assert (got.k, got.l, got.t, got.group_count, got.status) == (2, 2, 0.0, 2, "PASS")


def test_klt_counts_null_as_value_and_never_passes_without_groups(spark):
    df = spark.createDataFrame([(None, "x"), (None, None), ("a", "x")], "q string, s string")
    got = disclosure.klt(df, ["q"], ["s"]).first()
    assert (got.k, got.l, got.status) == (1, 1, "REVIEW")
    assert got.t == pytest.approx(1 / 3, abs=1e-6)
    assert disclosure.klt(df, [], ["s"]).first().status == "NOT_EVALUATED"
    assert disclosure.klt(df.where("false"), ["q"], ["s"]).first().status == "REVIEW"


def test_duplicates(spark):
    people = spark.createDataFrame([(i, f"n{i}", i % 3 or None) for i in range(50)], "id int, name string, g int")
    got = disclosure.duplicate_report(people, people.where("id < 10")).first()
    assert (got.exact_duplicates, got.unique_duplicates, got.status) == (10, 10, "FAIL")
    assert disclosure.without_copies(people, people.where("id < 10")).count() == 0
    assert disclosure.duplicate_report(people, people.where("false")).first().status == "NOT_EVALUATED"


def test_copies_of_unique_rows_only(spark):
    raw = spark.createDataFrame([("a",)] * 10 + [("b",)] * 10 + [("rare",)], "c string")
    made = spark.createDataFrame([("a",), ("b",), ("rare",)], "c string")
    assert sorted(r.c for r in disclosure.without_copies(raw, made, unique_only=True).collect()) == ["a", "b"]
    assert disclosure.without_copies(raw, made).count() == 0


def test_rare_groups(spark):
    first = spark.createDataFrame([(c,) for c in "aabbc"], "cohort string")
    second = spark.createDataFrame([("a",)] * 5, "cohort string")
    assert disclosure.rare_groups(first, ["cohort"]).first().rare_groups == 3
    assert disclosure.rare_groups(second, ["cohort"]).first().rare_groups == 0


def test_rare_labels(spark):
    df = spark.createDataFrame([("a",)] * 60 + [("b",)] * 45 + [("c",), (None,)], "g string")
    got = {r.g for r in disclosure.group_rare_labels(df, ["g"], 0.02).distinct().collect()}
    assert got == {"a", "b", "OTHER", None}


def test_subspace_distance_finds_copies(spark):
    raw = spark.createDataFrame([(i, float(i % 9), "r%d" % (i % 4)) for i in range(50)], "id int, age double, region string")
    got = disclosure.subspace_distance(raw, raw.where("id < 10"), ["age"], ["region"], "id", "id").first()
    assert got.exact_qi_match_rate == 1.0 and got.status == "FAIL"
    assert disclosure.subspace_distance(raw, raw.where("false"), ["age"], ["region"], "id", "id").first().status == "NOT_EVALUATED"


def test_subspace_distance_against_a_holdout(spark):
    kind = "id int, age double, region string"
    raw = spark.createDataFrame([(i, float(10 * i), "a") for i in range(20)], kind)
    near, far = (spark.createDataFrame([(i, 10.0 * i + gap, "a") for i in range(20)], kind) for gap in (1.5, 4.0))
    empty = raw.where("false")
    plain = disclosure.subspace_distance(raw, far, ["age"], ["region"], "id", "id").first()
    assert plain.status == "PASS" and "relative_privacy_risk" not in plain.asDict()
    got = disclosure.subspace_distance(raw, far, ["age"], ["region"], "id", "id", holdout=far).first()
    assert got.relative_privacy_risk == 1.0 and got.status == "PASS" and got.holdout_dcr_median == got.dcr_median
    off = spark.createDataFrame([(i, 10.0 * i + 4, "b") for i in range(20)], kind)
    got = disclosure.subspace_distance(raw, far, ["age"], ["region"], "id", "id", holdout=off).first()
    assert got.relative_privacy_risk < 0.5 and got.status == "REVIEW" and got.dcr_median == plain.dcr_median
    assert disclosure.subspace_distance(raw, near, ["age"], ["region"], "id", "id", holdout=off).first().status == "FAIL"
    got = disclosure.subspace_distance(raw, far, ["age"], ["region"], "id", "id", holdout=empty).first()
    assert got.relative_privacy_risk is None and got.status == "PASS"


def test_distances(spark):
    raw = spark.createDataFrame([(i, float(i)) for i in range(11)], "id int, x double")
    made = spark.createDataFrame([(1, 2.5), (2, 20.0)], "id int, x double")
    got = {(r.side, r.id): (r.d1, r.d2) for r in disclosure.closest_records(raw, made, ["x"], "id", "id").collect()}
    assert got[1, "1"] == pytest.approx((0.05, 0.05)) and got[1, "2"] == pytest.approx((1.0, 1.1))
    assert got[0, "5"] == pytest.approx((0.1, 0.1))
    assert disclosure.distance_report(disclosure.closest_records(raw, made.where("false"), ["x"], "id", "id")).first().status == "NOT_EVALUATED"


def test_attribute_inference(spark):
    raw = spark.createDataFrame([("a", "x")] * 6 + [("b", "y")] * 4, "q string, s string")
    same = disclosure.attribute_inference(raw, raw, ["q"], "s").first()
    assert (same.cap, same.baseline_cap, same.status) == (1.0, 0.6, "FAIL")
    none = disclosure.attribute_inference(raw, raw.where("false"), ["q"], "s").first()
    assert (none.cap, none.matches_found_rate, none.status) == (0.6, 0.0, "PASS")


def test_singling_out(spark):
    raw = spark.createDataFrame([("a", float(i)) for i in range(20)], "g string, x double")
    made = spark.createDataFrame([("a", 3.0), ("b", 3.0), ("a", None)], "g string, x double")
    assert disclosure.singling_out(raw, made, ["g"], ["x"]).first().matched_rows == 1
