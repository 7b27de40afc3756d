"""Queries of rules, constraints and discovery."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumatab.operators import rules
from lumatab.plans.model import Rule, RuleKind
from lumatab.plans.rule_graph import resolve
from lumatab.queries import query, rounded, table, union
from lumatab.queries_content import GRID, draw_sql

_PREDICATES = [
    ("p_is_null", "o_orderpriority", "is_null", None, False, "o_orderpriority IS NULL"),
    ("p_not_null", "o_orderpriority", "not_null", None, False, "o_orderpriority IS NOT NULL"),
    ("p_not_zero", "o_custkey", "not_zero", None, False, "NOT coalesce(o_custkey = 0, false)"),
    ("p_in", "o_orderstatus", "in", ["F", "O"], False, "coalesce(o_orderstatus IN ('F', 'O'), false)"),
    ("p_not_in", "o_orderstatus", "not_in", ["F"], False, "NOT coalesce(o_orderstatus IN ('F'), false)"),
    ("p_gt", "o_totalprice", "gt", 100000, False, "coalesce(o_totalprice > 100000, false)"),
    ("p_lte", "o_totalprice", "lte", 50000, False, "coalesce(o_totalprice <= 50000, false)"),
    ("p_equals", "o_orderstatus", "equals", " O ", False, "coalesce(trim(o_orderstatus) = 'O', false)"),
    ("p_equals_number", "o_custkey", "equals", "7", True, "coalesce(o_custkey = 7, false)"),
]


@query("predicates", f"SELECT o_orderkey, {', '.join(f'{sql} AS {n}' for n, *_, sql in _PREDICATES)} FROM orders")
def _(spark, sf):
    df = table(spark, sf, "orders")
    return df.select("o_orderkey", *(rules.predicate(df, c, k, v, n).alias(name) for name, c, k, v, n, _ in _PREDICATES))


@query("expression_tree", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) * (1 + l_tax) / nullif(l_quantity, 0) AS unit_charge, CASE WHEN l_quantity > 30 THEN 30.0 WHEN l_quantity < 5 THEN 5.0 ELSE l_quantity END AS limited FROM lineitem")
def _(spark, sf):
    df = table(spark, sf, "lineitem")
    one = {"literal": 1.0}
    tree = {"op": "divide", "args": [{"op": "multiply", "args": ["l_extendedprice", {"op": "subtract", "args": [one, "l_discount"]}, {"op": "add", "args": [one, "l_tax"]}]}, "l_quantity"]}
    return df.select("l_orderkey", "l_linenumber", rules.expression(df, tree).alias("unit_charge"), rules.expression(df, {"op": "clip", "args": ["l_quantity"], "min": 5.0, "max": 30.0}).alias("limited"))


@query("row_sum", "SELECT l_orderkey, l_linenumber, round(CASE WHEN coalesce(l_discount, l_tax) IS NOT NULL THEN coalesce(l_discount, 0) + coalesce(l_tax, 0) END, 9) AS total FROM lineitem")
def _(spark, sf):
    df = table(spark, sf, "lineitem")
    return df.select("l_orderkey", "l_linenumber", F.round(rules.row_sum(df, ["l_discount", "l_tax"]), 9).alias("total"))


@query("conditional_assign", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'CLOSED' ELSE o_orderpriority END AS o_orderpriority, CASE WHEN o_orderstatus = 'F' THEN 0.0 ELSE o_totalprice END AS o_totalprice FROM orders")
def _(spark, sf):
    df = table(spark, sf, "orders")
    rule = Rule("closed", RuleKind.CUSTOM, ("o_orderstatus", "o_orderpriority", "o_totalprice"), {"value": "F", "values": {"o_orderpriority": "CLOSED", "o_totalprice": 0.0}})
    return rules.apply_rule(df, rule).select("o_orderkey", "o_orderpriority", "o_totalprice")


@query("nullable_if", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderdate END AS o_orderdate FROM orders")
def _(spark, sf):
    return rules.apply_rule(table(spark, sf, "orders"), Rule("open", RuleKind.NULLABLE_IF, ("o_orderstatus", "o_orderdate"), {"value": "O"})).select("o_orderkey", "o_orderdate")


@query("calculated_field", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * l_discount, 6) AS l_tax FROM lineitem")
def _(spark, sf):
    rule = Rule("tax", RuleKind.CALCULATED, ("l_tax", "l_extendedprice", "l_discount"), {"calculation": "product"})
    return rounded(rules.apply_rule(table(spark, sf, "lineitem"), rule).select("l_orderkey", "l_linenumber", "l_tax"))


@query("elapsed_months", "SELECT o_orderkey, ((2000 - year(o_orderdate)) * 12 + (6 - month(o_orderdate)))::DOUBLE AS o_totalprice FROM orders")
def _(spark, sf):
    rule = Rule("months", RuleKind.CALCULATED, ("o_totalprice", "o_orderdate"), {"calculation": "elapsed_months", "as_of": "2000-06-15"})
    return rules.apply_rule(table(spark, sf, "orders"), rule).select("o_orderkey", "o_totalprice")


@query("apply_min_max", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0.0 WHEN c_acctbal > 5000 THEN 5000.0 ELSE c_acctbal END AS c_acctbal FROM customer")
def _(spark, sf):
    return rules.apply_rule(table(spark, sf, "customer"), Rule("balance", RuleKind.MIN_MAX, ("c_acctbal",), {"min": 0.0, "max": 5000.0})).select("c_custkey", "c_acctbal")


@query("apply_inequality", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount > l_tax THEN l_tax ELSE l_discount END AS l_discount, l_tax FROM lineitem")
def _(spark, sf):
    return rules.apply_rule(table(spark, sf, "lineitem"), Rule("d_le_t", RuleKind.LESS_EQUAL, ("l_discount", "l_tax"))).select("l_orderkey", "l_linenumber", "l_discount", "l_tax")


@query("swap_inequality", "SELECT l_orderkey, l_linenumber, CASE WHEN l_tax < l_discount THEN l_tax ELSE l_discount END AS l_discount, CASE WHEN l_tax < l_discount THEN l_discount ELSE l_tax END AS l_tax FROM lineitem")
def _(spark, sf):
    return rules.ordered_pair(table(spark, sf, "lineitem"), "l_discount", "l_tax").select("l_orderkey", "l_linenumber", "l_discount", "l_tax")


@query("bin_numeric", "SELECT l_orderkey, l_linenumber, floor(l_quantity / 5) * 5 AS l_quantity FROM lineitem")
def _(spark, sf):
    df = rules.apply_rule(table(spark, sf, "lineitem"), Rule("bins", RuleKind.RARE_CATEGORY, ("l_quantity",), {"bin_size": 5}))
    return df.select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("l_quantity"))


@query("cap_quantile", "SELECT o_orderkey, least(o_totalprice, (SELECT quantile_cont(o_totalprice, 0.95) FROM orders)) AS o_totalprice FROM orders")
def _(spark, sf):
    return rules.apply_rule(table(spark, sf, "orders"), Rule("cap", RuleKind.EXTREME_VALUE, ("o_totalprice",), {"quantile": 0.95})).select("o_orderkey", "o_totalprice")


@query("equality_copy", "SELECT l_orderkey, l_linenumber, l_discount, l_discount AS l_tax FROM lineitem")
def _(spark, sf):
    return rules.apply_rule(table(spark, sf, "lineitem"), Rule("same", RuleKind.EQUALITY, ("l_discount", "l_tax"))).select("l_orderkey", "l_linenumber", "l_discount", "l_tax")


@query("implication", "SELECT c_custkey, CASE WHEN trim(c_mktsegment) = 'BUILDING' THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer")
def _(spark, sf):
    return rules.implied(table(spark, sf, "customer"), "c_mktsegment", "BUILDING", "c_acctbal", 0.0).select("c_custkey", "c_acctbal")


def _joined(spark, sf):
    items, orders = table(spark, sf, "lineitem"), table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return items.join(orders, items["l_orderkey"] == orders["o_orderkey"])


_JOIN = "SELECT * FROM lineitem JOIN (SELECT o_orderkey, o_orderdate, o_totalprice FROM orders) ON l_orderkey = o_orderkey"


@query("date_range_filter", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate <= TIMESTAMP '1996-12-31'")
def _(spark, sf):
    return rules.in_date_range(table(spark, sf, "orders"), "o_orderdate", "1995-01-01", "1996-12-31", drop=True).select("o_orderkey", "o_orderdate")


@query("date_range_clip", "SELECT o_orderkey, least(greatest(o_orderdate, TIMESTAMP '1995-01-01'), TIMESTAMP '1996-12-31') AS o_orderdate FROM orders")
def _(spark, sf):
    return rules.in_date_range(table(spark, sf, "orders"), "o_orderdate", "1995-01-01", "1996-12-31").select("o_orderkey", "o_orderdate")


@query("age_rule", f"SELECT l_orderkey, l_linenumber, CASE WHEN o_orderdate > (l_shipdate - INTERVAL 1 YEAR)::DATE::TIMESTAMP THEN (l_shipdate - INTERVAL 1 YEAR)::DATE::TIMESTAMP ELSE o_orderdate END AS o_orderdate FROM ({_JOIN})")
def _(spark, sf):
    return rules.aged(_joined(spark, sf), "o_orderdate", "l_shipdate", min_years=1).select("l_orderkey", "l_linenumber", "o_orderdate")


@query("shift_years", "SELECT o_orderkey, CAST((o_orderdate - INTERVAL 3 YEAR)::DATE AS VARCHAR) AS shifted FROM orders")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", rules.shifted_years(F.col("o_orderdate"), -3).cast("string").alias("shifted"))


@query("lag_days", f"SELECT l_orderkey, l_linenumber, round((epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 86400000000.0, 6) AS lag FROM ({_JOIN})")
def _(spark, sf):
    return _joined(spark, sf).select("l_orderkey", "l_linenumber", F.round(rules.lag_days(F.col("o_orderdate"), F.col("l_shipdate")), 6).alias("lag"))


@query("date_parse", "SELECT o_orderkey, strptime(strftime(o_orderdate, '%Y%m%d'), '%Y%m%d') AS a, strptime(strftime(o_orderdate, '%Y-%m-%d'), '%Y-%m-%d') AS b, strptime(strftime(o_orderdate, '%Y-%m-%d'), '%Y-%m-%d') AS c FROM orders")
def _(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyyMMdd").alias("a"), F.date_format("o_orderdate", "yyyy년 M월 d일").alias("b"), F.date_format("o_orderdate", "yyyy.M.d").alias("c"))
    return df.select("o_orderkey", *(rules.moment(df, c).alias(c) for c in "abc"))


_LAG = "(epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 86400000000.0::DOUBLE"


@query(
    "date_order_repair",
    f"""WITH j AS ({_JOIN}), g AS (SELECT quantile_cont(lag, {GRID}) AS q, quantile_cont(lag, 0.995) AS top FROM (SELECT {_LAG} AS lag FROM j) WHERE lag > 0),
    s AS (SELECT l_orderkey, l_linenumber, o_orderdate, CASE WHEN l_linenumber = 1 THEN o_orderdate - to_days(400) ELSE l_shipdate END AS l_shipdate, {draw_sql("(l_orderkey || ':' || l_linenumber)", 'lag:o_orderdate:l_shipdate')} * 200 AS pos FROM j),
    e AS (SELECT *, least(q[floor(pos)::INT + 1], top) AS lo, least(q[least(floor(pos)::INT + 1, 200) + 1], top) AS hi FROM s, g),
    d AS (SELECT *, greatest(1, round_even(round(greatest(lo + (pos - floor(pos)) * (hi - lo), 1), 3), 0))::INT AS days FROM e)
    SELECT l_orderkey, l_linenumber, o_orderdate, CASE WHEN l_shipdate < o_orderdate THEN o_orderdate + to_days(days) ELSE l_shipdate END AS l_shipdate FROM d""",
)
def _(spark, sf):
    df = _joined(spark, sf).withColumn("row_key", F.concat_ws(":", "l_orderkey", "l_linenumber"))
    swapped = df.withColumn("l_shipdate", F.when(F.col("l_linenumber") == 1, F.col("o_orderdate") - F.make_dt_interval(F.lit(400))).otherwise(F.col("l_shipdate")))
    rule = Rule("shipped", RuleKind.DATE_ORDER, ("o_orderdate", "l_shipdate"))
    return rules.apply_rule(swapped, rule, reference=df, key="row_key").select("l_orderkey", "l_linenumber", "o_orderdate", "l_shipdate")


@query("null_indicator", "SELECT c_custkey, CASE WHEN c_acctbal > 9000 THEN NULL ELSE c_acctbal END AS c_acctbal, CASE WHEN c_acctbal > 9000 THEN 'ABSENT' ELSE 'PRESENT' END AS has_balance FROM customer")
def _(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_acctbal") <= 9000, F.col("c_acctbal")).alias("c_acctbal"))
    return rules.null_indicator(df, "c_acctbal", "has_balance")


@query("median_imputation", "WITH c AS (SELECT c_custkey, CASE WHEN c_acctbal <= 9000 THEN c_acctbal END AS b FROM customer) SELECT c_custkey, round(coalesce(b, (SELECT median(b) FROM c)), 6) AS c_acctbal FROM c")
def _(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_acctbal") <= 9000, F.col("c_acctbal")).alias("c_acctbal"))
    return rounded(rules.median_filled(df, ["c_acctbal"]))


_SPECS = {"p_size": {"min": 5, "max": 40, "integer": True}, "p_retailprice": {"allowed_values": [900.0, 1000.0, 1200.0, 1500.0]}}


@query(
    "domain_projection",
    "SELECT p_partkey, least(greatest(p_size, 5), 40)::BIGINT AS p_size, CASE WHEN p_retailprice IS NOT NULL THEN list_sort(list_transform([900.0::DOUBLE, 1000.0, 1200.0, 1500.0], lambda a: {'d': abs(a - p_retailprice), 'a': a}))[1].a END AS p_retailprice FROM part",
)
def _(spark, sf):
    return rules.projected(table(spark, sf, "part"), _SPECS)[0].select("p_partkey", "p_size", "p_retailprice")


@query("domain_projection_report", "SELECT 'p_size' AS column_name, count(*) FILTER (p_size < 5 OR p_size > 40) AS violations_before, 0::BIGINT AS violations_after, 'PASS' AS status FROM part UNION ALL SELECT 'p_retailprice', 0, 0, 'PASS'")
def _(spark, sf):
    return rules.projected(table(spark, sf, "part"), _SPECS)[1]


# --- discovery and audit --------------------------------------------------------------------------------------

_NUMS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


def _orders_sql(source: str, columns: list[str], strict_equal: bool) -> str:
    from itertools import combinations

    one = lambda a, b: f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS v, count(*) FILTER ({a} <= {b}) AS f, count(*) FILTER ({b} <= {a}) AS r, count(*) FILTER ({a} = {b}) AS e FROM ({source})"
    extra = "AND e < v" if strict_equal else ""
    return f"SELECT CASE WHEN f / v >= 0.995 THEN a ELSE b END AS lower, CASE WHEN f / v >= 0.995 THEN b ELSE a END AS higher, round(CASE WHEN f / v >= 0.995 THEN f / v ELSE r / v END, 6) AS confidence, round(v / n, 6) AS support FROM ({union([one(a, b) for a, b in combinations(columns, 2)])}) WHERE v > 0 {extra} AND (f / v >= 0.995 OR r / v >= 0.995)"


@query("discover_inequalities", _orders_sql("SELECT * FROM lineitem", _NUMS, True))
def _(spark, sf):
    return rules.discover_orders(table(spark, sf, "lineitem"), _NUMS)


@query("discover_date_orders", _orders_sql(f"SELECT *, l_shipdate + to_days(l_linenumber) AS received FROM ({_JOIN})", ["l_shipdate", "o_orderdate", "received"], False))
def _(spark, sf):
    df = _joined(spark, sf).withColumn("received", F.col("l_shipdate") + F.make_dt_interval(F.col("l_linenumber")))
    return rules.discover_orders(df, ["l_shipdate", "o_orderdate", "received"], dates=True)


_HOLED = "SELECT o_orderkey, o_orderstatus, o_orderpriority, CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_totalprice END AS closed_price, CASE WHEN o_orderstatus = 'O' OR o_totalprice > 200000 THEN NULL ELSE o_custkey END AS closed_by FROM orders"


@query(
    "discover_conditional_nulls",
    "WITH t AS (" + _HOLED + "), u AS (" + union([f"SELECT '{c}' AS c, trim(CAST({c} AS VARCHAR)) AS v, '{t}' AS t, count(*) AS n, count(*) FILTER ({t} IS NULL) AS k FROM t GROUP BY 2" for c in ("o_orderstatus", "o_orderpriority") for t in ("closed_price", "closed_by")])
    + ") SELECT c AS condition_column, v AS condition_value, t AS target_column, round(k / n, 6) AS confidence, round(n / (SELECT count(*) FROM t), 6) AS support FROM u WHERE k / n >= 0.995 AND (CASE t WHEN 'closed_price' THEN (SELECT count(*) FROM t WHERE closed_price IS NULL) ELSE (SELECT count(*) FROM t WHERE closed_by IS NULL) END) > 0",
)
def _(spark, sf):
    o = table(spark, sf, "orders")
    open_ = F.col("o_orderstatus") == "O"
    df = o.select("o_orderkey", "o_orderstatus", "o_orderpriority", F.when(open_, None).otherwise(F.col("o_totalprice")).alias("closed_price"), F.when(open_ | (F.col("o_totalprice") > 200000), None).otherwise(F.col("o_custkey")).alias("closed_by"))
    return rules.discover_conditional_nulls(df, ["o_orderstatus", "o_orderpriority"], ["closed_price", "closed_by"])


_ZEROS = "SELECT l_discount, l_tax, l_discount * l_extendedprice AS saved, CASE WHEN l_discount = 0 THEN 'N' ELSE 'Y' END AS reduced FROM lineitem"


@query(
    "discover_zero_implications",
    f"""WITH t AS ({_ZEROS}), p AS ({union([f"SELECT '{a}' AS a, '{b}' AS b, '0' AS v, count(*) FILTER ({a} = 0 AND {b} = 0) / nullif(count(*) FILTER ({a} = 0), 0) AS c, count(*) FILTER ({a} = 0) / count(*) AS s FROM t" for a in ("l_discount", "l_tax", "saved") for b in ("l_discount", "l_tax", "saved") if a != b])}
    UNION ALL {union([f"SELECT '{a}', 'reduced', r, n / sum(n) OVER (), z / (SELECT count(*) FROM t) FROM (SELECT reduced AS r, count(*) AS n, sum(count(*)) OVER () AS z FROM t WHERE {a} = 0 GROUP BY 1) QUALIFY row_number() OVER (ORDER BY n DESC) = 1" for a in ("l_discount", "l_tax", "saved")])})
    SELECT a AS condition_column, b AS target_column, v AS target_value, round(c, 6) AS confidence, round(s, 6) AS support FROM p WHERE c >= 0.99 AND (b <> 'reduced' OR v IN ('N', '0'))""",
)
def _(spark, sf):
    df = table(spark, sf, "lineitem").select("l_discount", "l_tax", (F.col("l_discount") * F.col("l_extendedprice")).alias("saved"), F.when(F.col("l_discount") == 0, "N").otherwise("Y").alias("reduced"))
    return rules.discover_zero_implications(df, ["l_discount", "l_tax", "saved"], ["reduced"])


_AUDIT = [
    (Rule("discount_le_tax", RuleKind.LESS_EQUAL, ("l_discount", "l_tax")), "l_discount > l_tax"),
    (Rule("tax_lt_quantity", RuleKind.LESS, ("l_tax", "l_quantity")), "l_tax >= l_quantity"),
    (Rule("quantity_range", RuleKind.MIN_MAX, ("l_quantity",), {"min": 5, "max": 45}), "l_quantity < 5 OR l_quantity > 45"),
    (Rule("shipped_after_order", RuleKind.DATE_ORDER, ("o_orderdate", "l_shipdate")), "l_shipdate < o_orderdate"),
    (Rule("known_flags", RuleKind.ALLOWED_VALUES, ("l_returnflag",), {"values": ["A", "N"]}), "l_returnflag NOT IN ('A', 'N')"),
    (Rule("ship_window", RuleKind.DATE_RANGE, ("l_shipdate",), {"min": "1993-01-01", "max": "1997-12-31"}), "l_shipdate < TIMESTAMP '1993-01-01' OR l_shipdate > TIMESTAMP '1997-12-31'"),
    (Rule("has_part", RuleKind.REQUIRED, ("l_partkey",)), "l_partkey IS NULL"),
]


@query(
    "audit_rules",
    f"WITH t AS ({_JOIN}) " + union([f"SELECT '{r.name}' AS rule, '{r.kind.value}' AS kind, count(*) AS rows, count(*) FILTER ({v}) AS violations, round(count(*) FILTER ({v}) / count(*), 6) AS rate, CASE WHEN count(*) FILTER ({v}) = 0 THEN 'PASS' ELSE 'REVIEW' END AS status FROM t" for r, v in _AUDIT]),
)
def _(spark, sf):
    return rules.audit(_joined(spark, sf), [r for r, _ in _AUDIT])


@query("settle_rules", "SELECT l_orderkey, l_linenumber, least(l_discount, l_tax, l_quantity) AS l_discount, least(l_tax, l_quantity) AS l_tax, l_quantity FROM lineitem")
def _(spark, sf):
    chain = [Rule("tax_le_quantity", RuleKind.LESS_EQUAL, ("l_tax", "l_quantity")), Rule("discount_le_tax", RuleKind.LESS_EQUAL, ("l_discount", "l_tax"))]
    ordered, _ = resolve(chain)
    return rules.settle(table(spark, sf, "lineitem"), ordered).select("l_orderkey", "l_linenumber", "l_discount", "l_tax", "l_quantity")
