"""Named queries over the star tables and their DuckDB SQL. Comparisons take line items of the two statuses as the two tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumatab.operators import association, disclosure, divergence, profile

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Registers (spark, sf_dir) -> DataFrame under a name."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    items = table(spark, sf_dir, "lineitem")
    return items.where("l_linestatus = 'F'"), items.where("l_linestatus = 'O'")


def union(parts: list[str]) -> str:
    return " UNION ALL ".join(f"({p})" for p in parts)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """df with its doubles rounded, for comparison across engines."""
    return df.withColumns({c: F.round(c, digits) for c, kind in df.dtypes if kind == "double"})


NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
CAT = ["l_returnflag", "l_linenumber"]
_SIDES = "SELECT *, CASE WHEN l_linestatus = 'F' THEN 0 ELSE 1 END AS side FROM lineitem WHERE l_linestatus IN ('F', 'O')"

# --- profiling ------------------------------------------------------------------------------------------------

_LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *NUM, "l_returnflag", "l_linestatus", "l_shipdate"]
_LINE_NUM = _LINE[:8]


def _profile_sql(table_name: str, columns: list[str], numeric: list[str]) -> str:
    def one(c: str) -> str:
        n = c in numeric
        stats = ", ".join(f"round({f}(CAST({c} AS DOUBLE)), 4)" if n else "CAST(NULL AS DOUBLE)" for f in ("min", "max", "avg", "stddev"))
        a, b, d, e = stats.split(", round(") if n else stats.split(", ")
        if n:
            b, d, e = ("round(" + x for x in (b, d, e))
        return f"SELECT '{c}' AS column_name, count(*) AS rows, count(*) FILTER ({c} IS NULL) AS nulls, count(DISTINCT {c}) AS distinct_values, {a} AS min_value, {b} AS max_value, {d} AS mean, {e} AS stddev FROM {table_name}"

    return union([one(c) for c in columns])


@query("profile_columns", _profile_sql("lineitem", _LINE, _LINE_NUM))
def _(spark, sf):
    return profile.column_profile(table(spark, sf, "lineitem"))


_TOP = ["l_returnflag", "l_linestatus", "l_linenumber", "l_discount"]


@query(
    "topk_categories",
    union([f"SELECT '{c}' AS column_name, row_number() OVER (ORDER BY n DESC, value NULLS FIRST) AS place, value, n FROM (SELECT CAST({c} AS VARCHAR) AS value, count(*) AS n FROM lineitem GROUP BY 1) QUALIFY place <= 10" for c in _TOP]),
)
def _(spark, sf):
    return profile.top_values(table(spark, sf, "lineitem"), _TOP, 10)


_NUMBER = "^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$"
_KINDS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


@query(
    "infer_columns",
    union(
        [
            f"SELECT '{c}' AS column_name, round(a, 6) AS numeric_ratio, round(b, 6) AS unique_ratio, CASE WHEN a >= 0.9 AND b > 0.05 THEN 'numerical' ELSE 'categorical' END AS kind FROM "
            f"(SELECT count(*) FILTER (regexp_matches(trim(v), '{_NUMBER}')) / count(*) AS a, count(DISTINCT v) / count(*) AS b FROM (SELECT CAST({c} AS VARCHAR) AS v FROM orders) WHERE v IS NOT NULL)"
            for c in _KINDS
        ]
    ),
)
def _(spark, sf):
    return profile.infer_kinds(table(spark, sf, "orders"), _KINDS)


_CUST = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


@query(
    "completeness",
    f"SELECT rows, rows * 5 AS cells, missing_cells, empty_cells, round(100 * (rows * 5 - missing_cells) / (rows * 5), 4) AS completeness_score FROM (SELECT count(*) AS rows, sum({' + '.join(f'({c} IS NULL)::BIGINT' for c in _CUST)})::BIGINT AS missing_cells, sum((c_name = '')::BIGINT + (c_mktsegment = '')::BIGINT)::BIGINT AS empty_cells FROM customer)",
)
def _(spark, sf):
    return profile.completeness(table(spark, sf, "customer"))


@query(
    "observations",
    union(
        [
            f"SELECT '{c}' AS column_name, count(*) AS seen, count(*) FILTER ({c} IS NULL) AS nulls, {e} AS empties, {z} AS zeros, 0::BIGINT AS falses, {n} AS numbers, round({g}, 6) AS mean, round({lo}, 6) AS min_value, round({hi}, 6) AS max_value FROM events"
            for c, e, z, n, g, lo, hi in (
                ("value", "0::BIGINT", "count(*) FILTER (value = 0)", "count(value)", "avg(value)", "min(value)", "max(value)"),
                ("user_id", "0::BIGINT", "count(*) FILTER (user_id = 0)", "count(user_id)", "avg(user_id)", "min(user_id)::DOUBLE", "max(user_id)::DOUBLE"),
                ("event_type", "count(*) FILTER (event_type = '')", "0::BIGINT", "0::BIGINT", "NULL::DOUBLE", "NULL::DOUBLE", "NULL::DOUBLE"),
            )
        ]
    ),
)
def _(spark, sf):
    return rounded(profile.observations(table(spark, sf, "events"), ["value", "user_id", "event_type"]))


def _temporal_sql(by: str) -> str:
    g, on = (f"{by}, ", f"USING ({by})") if by else ("", "ON true")
    part = f"PARTITION BY {by} " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""WITH m AS (SELECT {g}ts, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY ALL),
    s AS (SELECT {g}ts, n, (epoch_us(ts) - epoch_us(lag(ts) OVER ({part}ORDER BY ts))) / 1e6 AS step FROM m),
    u AS (SELECT {g}step, count(*) AS c FROM s WHERE step IS NOT NULL GROUP BY ALL),
    mo AS (SELECT {g}step AS modal_interval FROM u QUALIFY row_number() OVER ({part}ORDER BY c DESC, step) = 1),
    b AS (SELECT {g}min(ts) AS "start", max(ts) AS "end", sum(n)::BIGINT AS valid, count(*) AS distinct_moments FROM s {group}),
    gp AS (SELECT {g}sum(c)::BIGINT AS gaps FROM u JOIN mo {on} WHERE step > modal_interval {group})
    SELECT {g}"start", "end", valid, distinct_moments, valid - distinct_moments AS repeated, modal_interval, coalesce(gaps, 0) AS gaps
    FROM b LEFT JOIN mo {on} LEFT JOIN gp {on}"""


@query("temporal_summary", _temporal_sql(""))
def _(spark, sf):
    return profile.temporal_summary(table(spark, sf, "events"), "ts")


@query("temporal_summary_by_user", _temporal_sql("user_id"))
def _(spark, sf):
    return profile.temporal_summary(table(spark, sf, "events"), "ts", ["user_id"])


_STAR = {
    "region": ["r_regionkey", "r_name"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "customer": _CUST,
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
}


@query(
    "pk_inference",
    union([f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS rows, count(DISTINCT {c}) AS distinct_values, count(*) - count({c}) AS nulls, count({c}) = count(*) AND count(*) > 0 AND count(DISTINCT {c}) = count(*) AS is_key FROM {t}" for t, cs in _STAR.items() for c in cs]),
)
def _(spark, sf):
    return profile.key_candidates({t: table(spark, sf, t) for t in _STAR})


_PAIRS = [("nation", "n_nationkey", "customer", "c_nationkey"), ("nation", "n_nationkey", "supplier", "s_nationkey"), ("region", "r_regionkey", "nation", "n_regionkey"), ("customer", "c_custkey", "orders", "o_custkey"), ("orders", "o_orderkey", "lineitem", "l_orderkey"), ("part", "p_partkey", "lineitem", "l_partkey"), ("supplier", "s_suppkey", "lineitem", "l_suppkey"), ("supplier", "s_suppkey", "customer", "c_custkey")]


def _contained(pt: str, pk: str, ct: str, ck: str) -> str:
    return (
        f"SELECT count(*) AS child_values, count(p) AS contained_values, round(count(p) / count(*), 6) AS containment, coalesce(sum(n) FILTER (p IS NULL), 0)::BIGINT AS orphan_rows FROM "
        f"(SELECT {ck} AS v, count(*) AS n FROM {ct} WHERE {ck} IS NOT NULL GROUP BY 1) LEFT JOIN (SELECT DISTINCT {pk} AS p FROM {pt}) ON v = p"
    )


@query("fk_inference", union([f"SELECT '{a}' AS parent_table, '{b}' AS parent_key, '{c}' AS child_table, '{d}' AS child_key, containment, orphan_rows, containment >= 0.8 AS is_foreign_key FROM ({_contained(a, b, c, d)})" for a, b, c, d in _PAIRS]))
def _(spark, sf):
    names = {n for p in _PAIRS for n in (p[0], p[2])}
    return profile.foreign_keys({n: table(spark, sf, n) for n in names}, _PAIRS)


@query("fk_orphans", _contained("customer", "c_custkey", "orders", "o_custkey"))
def _(spark, sf):
    return profile.containment(table(spark, sf, "customer"), "c_custkey", table(spark, sf, "orders"), "o_custkey")


@query(
    "quasi_identifier_classes",
    union(
        [
            f"SELECT '{c}' AS column_name, round(d / n, 6) AS unique_ratio, round(m / n, 6) AS largest_share, CASE WHEN d / n >= 0.8 AND n >= 20 THEN 'identifier' WHEN d > 1 THEN 'quasi_identifier' ELSE 'attribute' END AS part "
            f"FROM (SELECT sum(k) AS n, count(*) AS d, max(k) AS m FROM (SELECT count(*) AS k FROM customer WHERE {c} IS NOT NULL GROUP BY {c}))"
            for c in _CUST
        ]
    ),
)
def _(spark, sf):
    return profile.quasi_identifier_classes(table(spark, sf, "customer"))


# --- disclosure -----------------------------------------------------------------------------------------------

_KLT = """WITH r AS (SELECT coalesce(CAST(o_orderstatus AS VARCHAR), '<NULL>') AS a, coalesce(CAST(o_orderpriority AS VARCHAR), '<NULL>') AS b, coalesce(CAST(year(o_orderdate) AS VARCHAR), '<NULL>') AS s FROM orders),
g AS (SELECT a, b, count(*) AS n FROM r GROUP BY a, b), tot AS (SELECT s, count(*) / (SELECT count(*) FROM r) AS share FROM r GROUP BY s),
c AS (SELECT a, b, s, count(*) AS m FROM r GROUP BY a, b, s),
d AS (SELECT g.a, g.b, 0.5 * sum(abs(coalesce(m, 0) / n - share)) AS t, count(m) AS l FROM g CROSS JOIN tot LEFT JOIN c ON c.a = g.a AND c.b = g.b AND c.s = tot.s GROUP BY g.a, g.b),
x AS (SELECT min(n) AS k, count(*) AS group_count, round(avg((n = 1)::INT), 6) AS unique_group_rate FROM g), y AS (SELECT min(l) AS l, round(max(t), 6) AS t FROM d)
SELECT k, l, t, group_count, unique_group_rate, CASE WHEN k >= 5 AND l >= 2 AND t <= 0.2 THEN 'PASS' ELSE 'REVIEW' END AS status FROM x, y"""


@query("klt", _KLT)
def klt(spark, sf):
    orders = table(spark, sf, "orders").withColumn("o_year", F.year("o_orderdate"))
    return disclosure.klt(orders, ["o_orderstatus", "o_orderpriority"], ["o_year"])


@query(
    "rare_groups",
    "SELECT count(*) AS groups, count(*) FILTER (n < 5) AS rare_groups, count(*) FILTER (n < 5) / count(*) AS rare_group_ratio, coalesce(sum(n) FILTER (n < 5), 0)::BIGINT AS rows_in_rare_groups FROM (SELECT count(*) AS n FROM customer GROUP BY c_nationkey, c_mktsegment)",
)
def _(spark, sf):
    return disclosure.rare_groups(table(spark, sf, "customer"), ["c_nationkey", "c_mktsegment"])


@query(
    "rare_label_grouping",
    "SELECT p_partkey, CASE WHEN p_type IS NULL OR count(*) OVER (PARTITION BY p_type) >= 0.01 * count(*) OVER () THEN p_type ELSE 'OTHER' END AS p_type, CASE WHEN p_brand IS NULL OR count(*) OVER (PARTITION BY p_brand) >= 0.01 * count(*) OVER () THEN p_brand ELSE 'OTHER' END AS p_brand FROM part",
)
def _(spark, sf):
    return disclosure.group_rare_labels(table(spark, sf, "part").select("p_partkey", "p_type", "p_brand"), ["p_type", "p_brand"])


_COPY = ["l_linenumber", "l_quantity", "l_discount", "l_tax"]
_COPIES = f"""WITH s AS ({_SIDES}), o AS (SELECT {', '.join(_COPY)}, count(*) AS c FROM s WHERE side = 0 GROUP BY ALL),
m AS (SELECT s.*, coalesce(c, 0) AS copies FROM s LEFT JOIN o ON {' AND '.join(f's.{c} IS NOT DISTINCT FROM o.{c}' for c in _COPY)} WHERE side = 1)"""


@query(
    "exact_duplicates",
    _COPIES + " SELECT rows, e AS exact_duplicates, round(e / rows, 4) AS exact_duplicate_rate, u AS unique_duplicates, round(u / rows, 4) AS unique_duplicate_rate, CASE WHEN u > 0 THEN 'FAIL' WHEN e / rows <= 0.01 THEN 'PASS' WHEN e / rows <= 0.05 THEN 'REVIEW' ELSE 'FAIL' END AS status FROM (SELECT count(*) AS rows, count(*) FILTER (copies > 0) AS e, count(*) FILTER (copies = 1) AS u FROM m)",
)
def _(spark, sf):
    return disclosure.duplicate_report(*halves(spark, sf), _COPY)


@query("without_copies", _COPIES + " SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax FROM m WHERE copies = 0")
def _(spark, sf):
    return disclosure.without_copies(*halves(spark, sf), _COPY).select("l_orderkey", *_COPY)


@query("without_unique_copies", _COPIES + " SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax FROM m WHERE copies <> 1")
def _(spark, sf):
    return disclosure.without_copies(*halves(spark, sf), _COPY, unique_only=True).select("l_orderkey", *_COPY)


@query(
    "singleout_rate",
    f"""WITH s AS ({_SIDES}), q AS (SELECT list_sort(list_distinct(quantile_cont(l_extendedprice, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1]))) AS e, list_sort(list_distinct(quantile_cont(l_tax, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1]))) AS f FROM s WHERE side = 0),
k AS (SELECT side, concat_ws('||', l_returnflag, CAST(l_quantity AS VARCHAR), len(list_filter(e[2:-2], lambda x: x < l_extendedprice)), len(list_filter(f[2:-2], lambda x: x < l_tax))) AS key FROM s, q)
SELECT count(*) AS rows, count(*) FILTER (key IN (SELECT key FROM k WHERE side = 0)) AS matched_rows, count(*) FILTER (key IN (SELECT key FROM k WHERE side = 0)) / count(*) AS singleout_rate FROM k WHERE side = 1""",
)
def _(spark, sf):
    return disclosure.singling_out(*halves(spark, sf), ["l_returnflag", "l_quantity"], ["l_extendedprice", "l_tax"])


@query(
    "cap",
    f"""WITH s AS ({_SIDES}), r AS (SELECT l_linenumber AS a, l_quantity AS b, l_discount AS x FROM s WHERE side = 0 AND l_linenumber IS NOT NULL AND l_quantity IS NOT NULL AND l_discount IS NOT NULL),
g AS (SELECT a, b, guess FROM (SELECT l_linenumber AS a, l_quantity AS b, l_discount AS guess, count(*) AS n FROM s WHERE side = 1 GROUP BY 1, 2, 3) QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY n DESC, guess) = 1),
u AS (SELECT l_discount AS usual FROM s WHERE side = 0 GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
j AS (SELECT avg((coalesce(guess, usual) = x)::INT) AS cap, avg((x = usual)::INT) AS base, avg((guess IS NOT NULL)::INT) AS hit FROM r LEFT JOIN g USING (a, b), u)
SELECT round(cap, 4) AS cap, round(base, 4) AS baseline_cap, round(cap - base, 4) AS inference_advantage, round(hit, 4) AS matches_found_rate, CASE WHEN cap - base > 0.15 THEN 'FAIL' WHEN cap - base > 0.05 THEN 'REVIEW' ELSE 'PASS' END AS status FROM j""",
)
def _(spark, sf):
    return disclosure.attribute_inference(*halves(spark, sf), ["l_linenumber", "l_quantity"], "l_discount")


def _as_customers(spark, sf) -> DataFrame:
    return table(spark, sf, "supplier").selectExpr("s_suppkey AS id", "s_acctbal AS c_acctbal", "s_nationkey AS c_nationkey")


_NEAR = """WITH a AS (SELECT CAST(c_custkey AS VARCHAR) AS id, c_acctbal AS x, c_nationkey::DOUBLE AS y FROM customer WHERE c_acctbal IS NOT NULL AND c_nationkey IS NOT NULL ORDER BY md5(CAST(c_custkey AS VARCHAR)), 1 LIMIT 500),
b AS (SELECT CAST(s_suppkey AS VARCHAR) AS id, s_acctbal AS x, s_nationkey::DOUBLE AS y FROM supplier WHERE s_acctbal IS NOT NULL AND s_nationkey IS NOT NULL ORDER BY md5(CAST(s_suppkey AS VARCHAR)), 1 LIMIT 500),
l AS (SELECT min(x) AS lx, CASE WHEN max(x) = min(x) THEN 1 ELSE max(x) - min(x) END AS wx, min(y) AS ly, CASE WHEN max(y) = min(y) THEN 1 ELSE max(y) - min(y) END AS wy FROM a),
p AS (SELECT 0 AS side, p.id, sqrt(((p.x - o.x) / wx) * ((p.x - o.x) / wx) + ((p.y - o.y) / wy) * ((p.y - o.y) / wy)) AS d FROM a AS p JOIN a AS o ON p.id <> o.id, l
    UNION ALL SELECT 1, p.id, sqrt(((p.x - o.x) / wx) * ((p.x - o.x) / wx) + ((p.y - o.y) / wy) * ((p.y - o.y) / wy)) FROM b AS p, a AS o, l),
n AS (SELECT side, id, list_sort(list(d))[1] AS d1, list_sort(list(d))[2] AS d2 FROM p GROUP BY side, id)"""


@query("closest_records", _NEAR + " SELECT side, id, round(d1, 9) AS d1, round(d2, 9) AS d2 FROM n")
def _(spark, sf):
    return rounded(disclosure.closest_records(table(spark, sf, "customer"), _as_customers(spark, sf), ["c_acctbal", "c_nationkey"], "c_custkey", "id"), 9)


@query(
    "dcr_nndr",
    _NEAR
    + """, s AS (SELECT median(d1) FILTER (side = 1) AS m, min(d1) FILTER (side = 1) AS lo, quantile_cont(d1, 0.05) FILTER (side = 1) AS p5, median(d1) FILTER (side = 0) AS rm, quantile_cont(d1, 0.05) FILTER (side = 0) AS r5,
    median(d1 / (d2 + 1e-9)) FILTER (side = 1) AS nm, avg((d1 / (d2 + 1e-9) < 0.2)::INT) FILTER (side = 1) AS nr, avg((d1 < 0.05)::INT) FILTER (side = 1) AS near FROM n),
r AS (SELECT s.*, greatest(near, CASE WHEN r5 > 0 THEN (SELECT avg((d1 < r5 / 2)::INT) FROM n WHERE side = 1) ELSE near END) AS risk FROM s)
SELECT round(m, 4) AS median_dcr, round(lo, 4) AS min_dcr, round(p5, 4) AS dcr_5th_percentile, round(rm, 4) AS raw_internal_dcr_median, round(r5, 4) AS raw_internal_dcr_5th_percentile, round(nm, 4) AS nndr_median, round(nr, 4) AS nndr_risk_rate, round(risk, 4) AS memorization_risk_rate,
CASE WHEN lo < 1e-4 OR risk > 0.15 OR nr > 0.15 THEN 'FAIL' WHEN risk <= 0.05 AND nr <= 0.05 THEN 'PASS' ELSE 'REVIEW' END AS status FROM r""",
)
def _(spark, sf):
    return disclosure.distance_report(disclosure.closest_records(table(spark, sf, "customer"), _as_customers(spark, sf), ["c_acctbal", "c_nationkey"], "c_custkey", "id"))


@query(
    "subspace_dcr",
    """WITH a AS (SELECT c_acctbal AS x, CAST(c_nationkey AS VARCHAR) AS y FROM customer ORDER BY md5(CAST(c_custkey AS VARCHAR)), CAST(c_custkey AS VARCHAR) LIMIT 500),
b AS (SELECT CAST(s_suppkey AS VARCHAR) AS id, s_acctbal AS x, CAST(s_nationkey AS VARCHAR) AS y FROM supplier ORDER BY md5(CAST(s_suppkey AS VARCHAR)), 1 LIMIT 500),
m AS (SELECT median(x) AS mid, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS q FROM a), sc AS (SELECT mid, greatest(q / 1.349, 1.4826 * (SELECT median(abs(x - mid)) FROM a, m), 1e-9) AS s FROM m),
p AS (SELECT id, sqrt((((coalesce(b.x, mid) - coalesce(a.x, mid)) / s) * ((coalesce(b.x, mid) - coalesce(a.x, mid)) / s) + (a.y <> b.y)::INT::DOUBLE) / 2) AS d FROM a, b, sc),
n AS (SELECT list_sort(list(d))[1] AS d1, coalesce(list_sort(list(d))[2], 1) AS d2 FROM p GROUP BY id),
f AS (SELECT quantile_cont(d1, 0.05) AS a, median(d1) AS b, quantile_cont(d1 / greatest(d2, 1e-12), 0.05) AS c, median(d1 / greatest(d2, 1e-12)) AS d, avg((d1 / greatest(d2, 1e-12) < 0.2)::INT) AS e, avg((d1 <= 1e-12)::INT) AS g FROM n)
SELECT round(a, 6) AS dcr_p05, round(b, 6) AS dcr_median, round(c, 6) AS nndr_p05, round(d, 6) AS nndr_median, round(e, 6) AS nndr_low_ratio, round(g, 6) AS exact_qi_match_rate, CASE WHEN g > 0 OR a <= 1e-12 OR e > 0.15 THEN 'FAIL' WHEN e > 0.05 THEN 'REVIEW' ELSE 'PASS' END AS status FROM f""",
)
def _(spark, sf):
    return disclosure.subspace_distance(table(spark, sf, "customer"), _as_customers(spark, sf), ["c_acctbal"], ["c_nationkey"], "c_custkey", "id")


@query(
    "subspace_dcr_holdout",
    """WITH a AS (SELECT c_acctbal AS x, CAST(c_nationkey AS VARCHAR) AS y FROM customer WHERE c_mktsegment <> 'BUILDING' ORDER BY md5(CAST(c_custkey AS VARCHAR)), CAST(c_custkey AS VARCHAR) LIMIT 500),
b AS ((SELECT 1 AS made, CAST(s_suppkey AS VARCHAR) AS id, s_acctbal AS x, CAST(s_nationkey AS VARCHAR) AS y FROM supplier ORDER BY md5(CAST(s_suppkey AS VARCHAR)), 2 LIMIT 500)
    UNION ALL (SELECT 0, CAST(c_custkey AS VARCHAR), c_acctbal, CAST(c_nationkey AS VARCHAR) FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY md5(CAST(c_custkey AS VARCHAR)), 2 LIMIT 500)),
m AS (SELECT median(x) AS mid, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS q FROM a), sc AS (SELECT mid, greatest(q / 1.349, 1.4826 * (SELECT median(abs(x - mid)) FROM a, m), 1e-9) AS s FROM m),
p AS (SELECT made, id, sqrt((((coalesce(b.x, mid) - coalesce(a.x, mid)) / s) * ((coalesce(b.x, mid) - coalesce(a.x, mid)) / s) + (a.y <> b.y)::INT::DOUBLE) / 2) AS d FROM a, b, sc),
n AS (SELECT made, list_sort(list(d))[1] AS d1, coalesce(list_sort(list(d))[2], 1) AS d2 FROM p GROUP BY made, id),
f AS (SELECT quantile_cont(d1, 0.05) AS a, median(d1) AS b, quantile_cont(d1 / greatest(d2, 1e-12), 0.05) AS c, median(d1 / greatest(d2, 1e-12)) AS d, avg((d1 / greatest(d2, 1e-12) < 0.2)::INT) AS e, avg((d1 <= 1e-12)::INT) AS g FROM n WHERE made = 1),
h AS (SELECT median(d1) AS hm, quantile_cont(d1, 0.05) AS h5 FROM n WHERE made = 0)
SELECT round(a, 6) AS dcr_p05, round(b, 6) AS dcr_median, round(c, 6) AS nndr_p05, round(d, 6) AS nndr_median, round(e, 6) AS nndr_low_ratio, round(g, 6) AS exact_qi_match_rate, round(hm, 6) AS holdout_dcr_median, round(h5, 6) AS holdout_dcr_p05, round(b / greatest(hm, 1e-12), 6) AS relative_privacy_risk,
CASE WHEN g > 0 OR a <= 1e-12 OR e > 0.15 THEN 'FAIL' WHEN b / greatest(hm, 1e-12) < 0.5 OR e > 0.05 THEN 'REVIEW' ELSE 'PASS' END AS status FROM f, h""",
)
def _(spark, sf):
    customers = table(spark, sf, "customer")
    return disclosure.subspace_distance(customers.where("c_mktsegment <> 'BUILDING'"), _as_customers(spark, sf), ["c_acctbal"], ["c_nationkey"], "c_custkey", "id", holdout=customers.where("c_mktsegment = 'BUILDING'"))


# --- fidelity -------------------------------------------------------------------------------------------------


def _counts(c: str, cast: str) -> str:
    return f"SELECT CAST({c} AS {cast}) AS v, count(*) FILTER (side = 0) AS n0, count(*) FILTER (side = 1) AS n1 FROM ({_SIDES}) GROUP BY 1"


def _cat_sql(c: str) -> str:
    return f"""SELECT '{c}' AS column_name, round(0.5 * sum(abs(n0 / t0 - n1 / t1)), 6) AS tvd, round(sum((a * ln(a / ((a + b) / 2)) + b * ln(b / ((a + b) / 2))) / 2), 6) AS jsd FROM
    (SELECT *, (n0 / t0 + 1e-12) / (1 + k * 1e-12) AS a, (n1 / t1 + 1e-12) / (1 + k * 1e-12) AS b FROM (SELECT *, sum(n0) OVER () AS t0, sum(n1) OVER () AS t1, count(*) OVER () AS k FROM ({_counts(c, 'VARCHAR')})))"""


@query("categorical_divergence", union([_cat_sql(c) for c in CAT]))
def _(spark, sf):
    return rounded(divergence.categorical_divergence(*halves(spark, sf), CAT))


def _hist(c: str, bins: int = 20) -> str:
    edges = " + ".join(f"(v >= {i}.0 * step + low)::INT" for i in range(1, bins))
    return f"""WITH s AS (SELECT CAST({c} AS DOUBLE) AS v, side FROM ({_SIDES})), m AS (SELECT min(v) AS low, max(v) AS high, (max(v) - min(v)) / {bins} AS step FROM s),
    b AS (SELECT CASE WHEN v IS NULL THEN 0 WHEN low = high THEN 1 ELSE 1 + {edges} END AS bin, side FROM s, m),
    n AS (SELECT bin, count(*) FILTER (side = 0) AS n0, count(*) FILTER (side = 1) AS n1 FROM b GROUP BY bin),
    f AS (SELECT unnest(generate_series(0, CASE WHEN low < high THEN {bins} ELSE 1 END)) AS bin, low, high, step FROM m),
    h AS (SELECT f.bin::INT AS bin, CASE WHEN f.bin > 0 THEN (f.bin - 1) * step + low END AS bin_low, CASE WHEN f.bin > 0 THEN f.bin * step + low END AS bin_high, coalesce(n0, 0) AS n0, coalesce(n1, 0) AS n1,
        (SELECT sum(n0) FROM n)::BIGINT AS t0, (SELECT sum(n1) FROM n)::BIGINT AS t1 FROM f LEFT JOIN n USING (bin))"""


@query(
    "jsd_numerical",
    union([_hist(c) + f" SELECT '{c}' AS column_name, round(sum((a * ln(a / ((a + b) / 2)) + b * ln(b / ((a + b) / 2))) / 2), 6) AS jsd FROM (SELECT (n0 + 1e-12) / (t0 + k * 1e-12) AS a, (n1 + 1e-12) / (t1 + k * 1e-12) AS b FROM (SELECT *, count(*) OVER () AS k FROM h))" for c in NUM]),
)
def _(spark, sf):
    return rounded(divergence.numerical_jsd(*halves(spark, sf), NUM))


_PCT = "round(100 * n0 / t0, 2) AS original_pct, round(100 * n1 / t1, 2) AS derived_pct, round(round(100 * n1 / t1, 2) - round(100 * n0 / t0, 2), 2) AS diff_pct"


@query("distribution_bins", union([_hist(c) + f" SELECT '{c}' AS column_name, bin, round(bin_low, 3) AS bin_low, round(bin_high, 3) AS bin_high, n0 AS original_count, n1 AS derived_count, {_PCT} FROM h WHERE bin > 0 OR n0 + n1 > 0" for c in NUM]))
def _(spark, sf):
    return divergence.distribution_table(*halves(spark, sf), NUM)


@query(
    "top12_compare",
    union(
        [
            f"SELECT '{c}' AS column_name, place, v AS label, n0 AS original_count, n1 AS derived_count, {_PCT} FROM (SELECT *, sum(n0) OVER () AS t0, sum(n1) OVER () AS t1, row_number() OVER (ORDER BY n0 + n1 DESC, v NULLS FIRST) AS place FROM ({_counts(c, 'VARCHAR')})) WHERE place <= 12"
            for c in ("l_returnflag", "l_linenumber", "l_partkey")
        ]
    ),
)
def _(spark, sf):
    return divergence.top_categories(*halves(spark, sf), ["l_returnflag", "l_linenumber", "l_partkey"])


@query(
    "wasserstein_ks",
    union(
        [
            f"""SELECT '{c}' AS column_name, round(w, 6) AS wasserstein, round(1 / (1 + w), 6) AS similarity, round(ks, 6) AS ks FROM (SELECT coalesce(sum(gap * (nxt - v)), 0) AS w, max(gap) AS ks FROM
        (SELECT v, lead(v) OVER (ORDER BY v) AS nxt, abs(sum(n0) OVER (ORDER BY v) / sum(n0) OVER () - sum(n1) OVER (ORDER BY v) / sum(n1) OVER ()) AS gap FROM ({_counts(c, 'DOUBLE')}) WHERE v IS NOT NULL))"""
            for c in NUM
        ]
    ),
)
def _(spark, sf):
    return rounded(divergence.distribution_distance(*halves(spark, sf), NUM))


@query(
    "chi2_fit",
    union(
        [
            f"SELECT '{c}' AS column_name, round(sum((o - e) * (o - e) / e), 6) AS chi2, count(*) - 1 AS dof, round(1 - 0.5 * sum(abs(n0 / t0 - n1 / t1)), 6) AS tvd_fidelity FROM (SELECT *, n0 * least(t0, t1) / t0 + 1e-5 AS e, n1 * least(t0, t1) / t1 + 1e-5 AS o FROM (SELECT *, sum(n0) OVER () AS t0, sum(n1) OVER () AS t1 FROM ({_counts(c, 'VARCHAR')})))"
            for c in CAT
        ]
    ),
)
def _(spark, sf):
    return rounded(divergence.goodness_of_fit(*halves(spark, sf), CAT))


def _corr_sql(columns: list[str], rank: bool) -> str:
    from itertools import combinations

    src = f"SELECT {', '.join(columns)}, side FROM ({_SIDES}) WHERE {' AND '.join(f'{c} IS NOT NULL' for c in columns)}"
    if rank:
        ranked = ", ".join(f"rank() OVER (PARTITION BY side ORDER BY {c}) + (count(*) OVER (PARTITION BY side, {c}) - 1) / 2.0 AS {c}" for c in columns)
        src = f"SELECT {ranked}, side FROM ({src})"
    one = lambda a, b: f"SELECT '{a} x {b}' AS pair, coalesce(corr({a}, {b}) FILTER (side = 0), 0) AS o, coalesce(corr({a}, {b}) FILTER (side = 1), 0) AS d FROM s"
    return f"WITH s AS ({src}), c AS ({union([one(a, b) for a, b in combinations(columns, 2)])})"


_PAIR_OUT = " SELECT pair, round(o, 6) AS original_r, round(d, 6) AS derived_r, round(abs(o - d), 6) AS absolute_error, round(greatest(0, 1 - abs(o - d) / 2), 6) AS preservation FROM c"
_SCORE_OUT = " SELECT round(avg(abs(o - d)), 6) AS mae, round(greatest(0, least(1, 1 - avg(abs(o - d)) / 2)), 6) AS score, count(*) AS pairs_evaluated FROM c"


@query("pearson_preservation", _corr_sql(NUM, False) + _PAIR_OUT)
def _(spark, sf):
    return rounded(association.correlation_preservation(*halves(spark, sf), NUM))


@query("pearson_score", _corr_sql(NUM, False) + _SCORE_OUT)
def _(spark, sf):
    return rounded(association.correlation_score(association.correlation_preservation(*halves(spark, sf), NUM)))


@query("spearman_preservation", _corr_sql(NUM, True) + _PAIR_OUT)
def _(spark, sf):
    return rounded(association.correlation_preservation(*halves(spark, sf), NUM, spearman=True))


@query("spearman_score", _corr_sql(NUM, True) + _SCORE_OUT)
def _(spark, sf):
    return rounded(association.correlation_score(association.correlation_preservation(*halves(spark, sf), NUM, spearman=True)))


@query("frobenius_fidelity", _corr_sql(NUM, False) + " SELECT round(sqrt(2 * sum((o - d) * (o - d))), 6) AS distance, round(greatest(0, 1 - sqrt(2 * sum((o - d) * (o - d))) / 8), 6) AS fidelity FROM c")
def _(spark, sf):
    return rounded(association.frobenius_fidelity(*halves(spark, sf), NUM))


_ASSOC = ["l_returnflag", "l_linenumber", "l_discount", "l_ship_year"]


def _v_sql(source: str, columns: list[str]) -> str:
    from itertools import combinations

    def one(a: str, b: str) -> str:
        o = f"SELECT coalesce(CAST({a} AS VARCHAR), '-') AS x, coalesce(CAST({b} AS VARCHAR), '-') AS y, count(*) AS o FROM ({source}) GROUP BY 1, 2"
        return f"""SELECT '{a} x {b}' AS pair, CASE WHEN r > 1 AND k > 1 AND n > 1 AND least(k - (k - 1) * (k - 1) / (n - 1) - 1, r - (r - 1) * (r - 1) / (n - 1) - 1) > 0
        THEN sqrt(greatest(0, phi2 - (k - 1) * (r - 1) / (n - 1)) / least(k - (k - 1) * (k - 1) / (n - 1) - 1, r - (r - 1) * (r - 1) / (n - 1) - 1)) ELSE 0 END AS v FROM
        (SELECT sum(o) AS n, count(DISTINCT x) AS r, count(DISTINCT y) AS k, sum(o * o / (rx * cy)) - 1 AS phi2 FROM (SELECT *, sum(o) OVER (PARTITION BY x) AS rx, sum(o) OVER (PARTITION BY y) AS cy FROM ({o})))"""

    return union([one(a, b) for a, b in combinations(columns, 2)])


_YEARED = "SELECT *, year(l_shipdate) AS l_ship_year FROM lineitem"


@query("cramers_v", f"SELECT pair, round(v, 6) AS v FROM ({_v_sql(_YEARED, [*_ASSOC, 'l_linestatus'])})")
def _(spark, sf):
    return rounded(association.cramers_v(table(spark, sf, "lineitem").withColumn("l_ship_year", F.year("l_shipdate")), [*_ASSOC, "l_linestatus"]))


_V2 = f"WITH a AS ({_v_sql(_YEARED + chr(32) + 'WHERE l_linestatus = ' + chr(39) + 'F' + chr(39), _ASSOC)}), b AS ({_v_sql(_YEARED + chr(32) + 'WHERE l_linestatus = ' + chr(39) + 'O' + chr(39), _ASSOC)}), j AS (SELECT pair, a.v AS o, b.v AS d, a.v >= 0.15 AS sure, a.v >= 0.15 AND b.v >= greatest(0.08, 0.4 * a.v) AS kept FROM a JOIN b USING (pair))"


def _with_year(spark, sf):
    return (df.withColumn("l_ship_year", F.year("l_shipdate")) for df in halves(spark, sf))


@query("significant_pairs", _V2 + " SELECT pair, round(o, 6) AS original_v, round(d, 6) AS derived_v, round(abs(o - d), 6) AS difference, sure AS significant, kept AS preserved FROM j")
def _(spark, sf):
    return rounded(association.association_preservation(*_with_year(spark, sf), _ASSOC))


@query("association_score", _V2 + " SELECT round(avg(abs(o - d)), 6) AS mae, round(greatest(0, least(1, 1 - avg(abs(o - d)))), 6) AS score, count(*) FILTER (sure) AS significant_pairs, count(*) FILTER (kept) AS preserved_pairs, round(CASE WHEN count(*) FILTER (sure) > 0 THEN count(*) FILTER (kept) / count(*) FILTER (sure) ELSE 1 END, 6) AS preservation_rate FROM j")
def _(spark, sf):
    return rounded(association.association_score(association.association_preservation(*_with_year(spark, sf), _ASSOC)))


@query("propensity")
def _(spark, sf):
    return association.propensity(*halves(spark, sf), NUM, CAT)
