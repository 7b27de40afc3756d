"""Rules: predicates, repairs, order, discovery, constraints."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lumatab.operators import rules
from lumatab.plans.model import ColumnPlan, Rule, RuleKind, RunConfig, resolve_column
from lumatab.plans.rule_graph import resolve


def values(df, column):
    return [r[column] for r in df.orderBy("i").collect()]


def test_missing_values_in_predicates(spark):
    df = spark.createDataFrame([(1, None), (2, 0.0), (3, 4.0)], "i int, x double")
    check = lambda *a, **k: [r[0] for r in df.orderBy("i").select(rules.predicate(df, "x", *a, **k)).collect()]
    assert check("not_zero") == [True, False, True]
    assert check("not_in", [4.0]) == [True, True, False]
    assert check("gt", 1) == [False, False, True]
    assert check("is_null") == [True, False, False]
    assert check("equals", "4", numeric=True) == [False, False, True]
    with pytest.raises(ValueError):
        rules.predicate(df, "x", "nearly")


def test_calculated_field(spark):
    df = spark.createDataFrame([(1, 5.0, 2.0, 0.0), (2, 10.0, 5.0, 1.0)], "i int, base_value double, factor double, derived double")
    rule = Rule("d", RuleKind.CALCULATED, ("derived", "base_value", "factor"), {"calculation": "product"})
    assert rules.audit(df, [rule]).first().violations == 2
    assert values(rules.apply_rule(df, rule), "derived") == [10.0, 50.0]


def test_sums_and_expressions(spark):
    df = spark.createDataFrame([(1, None, 2.0), (2, None, None), (3, 0.0, 5.0)], "i int, a double, b double")
    assert [r[0] for r in df.orderBy("i").select(rules.row_sum(df, ["a", "b"])).collect()] == [2.0, None, 5.0]
    assert [r[0] for r in df.orderBy("i").select(rules.expression(df, {"op": "divide", "args": ["b", "a"]})).collect()] == [None, None, None]
    assert [r[0] for r in df.orderBy("i").select(rules.expression(df, {"op": "round", "args": [{"op": "divide", "args": ["b", {"literal": 2}]}]})).collect()] == [1.0, None, 2.0]


def test_conditional_targets(spark):
    df = spark.createDataFrame([(1, 0, "Y", 7), (2, 2, "Y", 7)], "i int, count int, flag string, amount int")
    rule = Rule("none", RuleKind.CUSTOM, ("count", "flag", "amount"), {"value": 0, "values": {"flag": "N", "amount": 0}})
    assert [tuple(r) for r in rules.apply_rule(df, rule).orderBy("i").select("flag", "amount").collect()] == [("N", 0), ("Y", 7)]


def test_binning_and_bounds(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 7.0), (3, 14.0), (4, None)], "i int, measure double")
    assert values(rules.apply_rule(df, Rule("b", RuleKind.RARE_CATEGORY, ("measure",), {"bin_size": 5})), "measure") == [0.0, 5.0, 10.0, None]
    assert values(rules.apply_rule(df, Rule("m", RuleKind.MIN_MAX, ("measure",), {"min": 2, "max": 10})), "measure") == [2.0, 7.0, 10.0, None]
    smooth = values(rules.apply_rule(df, Rule("m", RuleKind.MIN_MAX, ("measure",), {"max": 10, "repair": "smooth"}), key="i"), "measure")
    assert smooth[:2] == [1.0, 7.0] and 9.5 <= smooth[2] < 10


def test_strict_order_is_strict(spark):
    df = spark.createDataFrame([(1, 5.0, 5.0), (2, 0.0, 0.0), (3, 1.0, 2.0), (4, -3.0, -3.0)], "i int, a double, b double")
    fixed = rules.apply_rule(df, Rule("s", RuleKind.LESS, ("a", "b")))
    assert fixed.where("a >= b").count() == 0 and values(fixed, "a")[2] == 1.0
    whole = rules.apply_rule(df.selectExpr("i", "cast(a as int) a", "cast(b as int) b"), Rule("s", RuleKind.GREATER, ("a", "b")))
    assert values(whole, "a") == [6, 1, 3, -2]


def test_chain_settles(spark):
    df = spark.createDataFrame([(1, 5.0, 3.0, 1.0)], "i int, a double, b double, c double")
    chain, aside = resolve([Rule("a_le_b", RuleKind.LESS_EQUAL, ("a", "b")), Rule("b_le_c", RuleKind.LESS_EQUAL, ("b", "c"))])
    row = rules.settle(df, chain).first()
    assert row.a <= row.b <= row.c and not aside


def test_cycles():
    soft = [Rule(f"{a}_le_{b}", RuleKind.LESS_EQUAL, (a, b)) for a, b in ("ab", "bc", "ca")]
    order, _ = resolve(soft)
    assert [r.kind for r in order] == [RuleKind.EQUALITY] and order[0].columns == ("a", "b", "c")
    hard = [Rule("a_lt_b", RuleKind.LESS, ("a", "b"), confidence=1.0), Rule("b_lt_c", RuleKind.LESS, ("b", "c"), confidence=0.999), Rule("c_lt_a", RuleKind.LESS, ("c", "a"), confidence=0.996)]
    order, aside = resolve(hard)
    assert {r.name for r in order} == {"a_lt_b", "b_lt_c"} and [r.name for r in aside] == ["c_lt_a"]
    assert resolve([Rule("x", RuleKind.LESS, ("a", "b"), confidence=0.9)])[1][0].name == "x"


def test_dates_are_repaired_in_their_own_format(spark):
    schema = "i int, `입사일` string, `퇴사일` string"
    df = spark.createDataFrame([(1, "2024-05-01", "2024-04-01"), (2, "20240501", "20240401")], schema)
    rule = Rule("d", RuleKind.DATE_ORDER, ("입사일", "퇴사일"), {"min_days": 1, "max_days": 1})
    assert values(rules.apply_rule(df, rule, key="i"), "퇴사일") == ["2024-05-02", "20240502"]


def test_sampled_lags(spark):
    day = dt.datetime(2024, 1, 1)
    known = spark.createDataFrame([(i, day, day + dt.timedelta(days=2 + i % 9)) for i in range(40)], "i int, opened timestamp, closed timestamp")
    broken = known.withColumn("closed", F.col("opened") - F.expr("interval 3 days"))
    fixed = rules.apply_rule(broken, Rule("d", RuleKind.DATE_ORDER, ("opened", "closed")), reference=known, key="i")
    lags = [(r.closed - r.opened).days for r in fixed.collect()]
    assert min(lags) >= 2 and max(lags) <= 10 and len(set(lags)) > 3
    none = known.limit(0)
    spread = [r[0] for r in broken.select(rules.sampled_lag(broken, none, "opened", "closed", "i")).collect()]
    again = [r[0] for r in broken.repartition(3).orderBy("i").select(rules.sampled_lag(broken, none, "opened", "closed", "i")).collect()]
    assert all(1 <= x <= 60 for x in spread) and sorted(spread) == sorted(again)


def test_age(spark):
    df = spark.createDataFrame([(1, "2015-01-01", "2024-01-01"), (2, "1850-01-01", "2024-01-01")], "i int, b string, h string")
    assert values(rules.aged(df, "b", "h", 15, 120), "b") == ["2009-01-01", "1904-01-01"]
    assert rules.aged(df, "b", "h", 15, 120, drop=True).count() == 0
    leap = spark.createDataFrame([(1, "2024-03-01", "2024-02-29")], "i int, b string, h string")
    assert values(rules.aged(leap, "b", "h", 1), "b") == ["2023-02-28"]


def test_date_forms(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["2024-03-05", "20240305", "2024년 3월 5일", "2024/3/5", "2024.03.05(화)", "2024-03-05 10:00:00", "soon", None])], "i int, d string")
    got = values(df.select("i", rules.moment(df, "d").alias("m")), "m")
    assert [m.date() if m else None for m in got] == [dt.date(2024, 3, 5)] * 6 + [None, None]


def test_projection(spark):
    df = spark.createDataFrame([(1, 1.2, -100.0, "a"), (2, 2.8, 100.0, "z"), (3, None, None, None)], "i int, count double, value double, kind string")
    out, report = rules.projected(df, {"count": {"min": 0, "max": 10, "integer": True}, "kind": {"allowed_values": ["a", "b"]}})
    assert values(out, "count") == [1, 3, None] and values(out, "value") == [-100.0, 100.0, None] and values(out, "kind") == ["a", "a", None]
    assert {r.column_name: (r.violations_before, r.violations_after) for r in report.collect()} == {"count": (0, 0), "kind": (1, 0)}


def test_discovery(spark):
    df = spark.createDataFrame([(i, i + 1.0 + i % 2, i + 2.0, None if i % 2 else 3.0, "N" if i % 2 else "Y", 0 if i % 2 else 5, 0 if i % 2 else 6) for i in range(200)], "i int, a double, b double, p double, s string, n int, m int")
    got = {(r["lower"], r.higher) for r in rules.discover_orders(df, ["a", "b"]).collect()}
    assert got == {("a", "b")}
    nulls = rules.discover_conditional_nulls(df, ["s"], ["p", "a"]).collect()
    assert [(r.condition_column, r.condition_value, r.target_column, r.support) for r in nulls] == [("s", "N", "p", 0.5)]
    zeros = {(r.condition_column, r.target_column, r.target_value) for r in rules.discover_zero_implications(df, ["n", "m"], ["s"]).collect()}
    assert zeros == {("n", "m", "0"), ("m", "n", "0"), ("n", "s", "N"), ("m", "s", "N")}


def test_audit_never_passes_unmeasured(spark):
    df = spark.createDataFrame([], "i int, a double")
    got = {r.rule: r.status for r in rules.audit(df, [Rule("r", RuleKind.MIN_MAX, ("a",), {"min": 0}), Rule("gone", RuleKind.REQUIRED, ("zz",))]).collect()}
    assert got == {"r": "NOT_EVALUATED", "gone": "NOT_EVALUATED"}


def test_null_indicator_round(spark):
    df = spark.createDataFrame([(1, None), (2, 5.0)], "i int, x double")
    marked = rules.null_indicator(df, "x", "has_x")
    mixed = marked.withColumn("x", F.lit(1.0))
    assert values(rules.enforce_null_indicator(mixed, "x", "has_x"), "x") == [None, 1.0]
    assert values(rules.median_filled(df, ["x"]), "x") == [5.0, 5.0]


def test_extremes(spark):
    df = spark.createDataFrame([(i, 0.0 if i < 60 else float(i)) for i in range(100)], "i int, x double")
    spread = rules.apply_rule(df, Rule("s", RuleKind.EXTREME_VALUE, ("x",), {"spike_value": 0.0}), key="i")
    assert spread.where("x = 0").count() < 10 and spread.where("i >= 60").select(F.sum("x")).first()[0] == sum(range(60, 100))
    capped = rules.apply_rule(df, Rule("q", RuleKind.EXTREME_VALUE, ("x",), {"quantile": 0.5}))
    assert capped.agg(F.max("x")).first()[0] == 0.0


def test_names_and_settings():
    columns = ["customer_id", "총 자산", "order date"]
    assert resolve_column(columns, "Customer-ID") == "customer_id" and resolve_column(columns, "OrderDate") == "order date"
    assert resolve_column(columns, "총가액", {"총가액": "총 자산"}) == "총 자산" and resolve_column(columns, "zip") is None
    with pytest.raises(ValueError):
        RunConfig(k=0)
    with pytest.raises(ValueError):
        RunConfig(duplicate_policy="maybe")
    assert ColumnPlan().rules == ()
