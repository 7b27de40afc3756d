"""Queries of verdicts, roles of columns and escapes from copies."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumatab.functions import masking, text_rules
from lumatab.operators import assess, disclosure, generate, shape
from lumatab.plans.model import ColumnPlan, Relationship
from lumatab.queries import CAT, NUM, SQL, _v_sql, halves, query, rounded, table
from lumatab.queries_content import draw_sql, drawn_category_sql, notes, numbered_sql
from lumatab.sources import documents, json_paths

PLAN = ColumnPlan(tuple(CAT), tuple(NUM))

_METRICS = f"""SELECT column_name, 'jsd' AS metric, jsd AS value FROM ({SQL['categorical_divergence']}) UNION ALL SELECT column_name, 'tvd', tvd FROM ({SQL['categorical_divergence']}) UNION ALL SELECT column_name, 'jsd', jsd FROM ({SQL['jsd_numerical']})
UNION ALL SELECT column_name, 'wasserstein', wasserstein FROM ({SQL['wasserstein_ks']}) UNION ALL SELECT column_name, 'similarity', similarity FROM ({SQL['wasserstein_ks']})"""


@query("distribution_metrics", _METRICS)
def _(spark, sf):
    return rounded(assess.distribution_metrics(*halves(spark, sf), PLAN))


@query("metric_means", f"SELECT metric, round(avg(value), 4) AS value FROM ({_METRICS}) GROUP BY metric")
def _(spark, sf):
    return rounded(assess.metric_means(assess.distribution_metrics(*halves(spark, sf), PLAN)), 4)


_PAIR = " WHERE l_linestatus = "
_ASSOC = f"SELECT 1 - avg(abs(a.v - b.v)) AS score FROM ({_v_sql('SELECT * FROM lineitem' + _PAIR + chr(39) + 'F' + chr(39), CAT)}) AS a JOIN ({_v_sql('SELECT * FROM lineitem' + _PAIR + chr(39) + 'O' + chr(39), CAT)}) AS b USING (pair)"
_QUALITY = f"""WITH m AS ({_METRICS}), q AS (SELECT avg(value) FILTER (metric = 'jsd') AS jsd, avg(value) FILTER (metric = 'similarity') AS similarity, ((SELECT score FROM ({SQL['pearson_score']})) + ({_ASSOC})) / 2 AS correlation FROM m)
SELECT *, 0.4 * (1 - jsd) + 0.3 * similarity + 0.3 * correlation AS composite FROM q"""


@query("composite_score", f"SELECT round(jsd, 3) AS jsd, round(similarity, 3) AS similarity, round(correlation, 3) AS correlation, round(composite, 3) AS composite, CASE WHEN composite >= 0.8 THEN 'PASS' WHEN composite >= 0.6 THEN 'REVIEW' ELSE 'FAIL' END AS status FROM ({_QUALITY})")
def _(spark, sf):
    return rounded(assess.quality(*halves(spark, sf), PLAN), 3)


@query(
    "statistical_fidelity",
    f"""WITH u AS (SELECT avg(s) AS u FROM (SELECT 100 * (1 - ks) AS s FROM ({SQL['wasserstein_ks']}) UNION ALL SELECT 100 * tvd_fidelity FROM ({SQL['chi2_fit']}))), c AS (SELECT 100 * fidelity AS c FROM ({SQL['frobenius_fidelity']}))
    SELECT round(u, 2) AS univariate, round(c, 2) AS correlation, round(0.6 * u + 0.4 * c, 2) AS overall, CASE WHEN 0.6 * u + 0.4 * c >= 85 THEN 'EXCELLENT' WHEN 0.6 * u + 0.4 * c >= 70 THEN 'GOOD' ELSE 'FAIR' END AS verdict FROM u, c""",
)
def _(spark, sf):
    return rounded(assess.statistical_fidelity(*halves(spark, sf), PLAN), 2)


@query("evaluate")
def _(spark, sf):
    a, b = (df.withColumn("row_key", F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey")) for df in halves(spark, sf))
    return rounded(assess.evaluate(a, b, PLAN, ["l_linenumber", "l_returnflag"], "l_discount", "row_key", "row_key"))


def _measured(spark, sf):
    """Metrics of the two halves of lineitem; attacks are not simulated."""
    a, b = halves(spark, sf)
    parts = [
        assess.quality(a, b, PLAN).select(F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.round(c, 3).alias("value")) for c in ("composite", "correlation")))).alias("m")).select("m.*"),
        disclosure.attribute_inference(a, b, ["l_linenumber", "l_quantity"], "l_discount").select(F.lit("inference_advantage").alias("metric"), F.col("inference_advantage").alias("value")),
    ]
    return parts[0].unionByName(parts[1])


_CHECKS = f"""WITH v AS (SELECT round(composite, 3) AS composite, round(correlation, 3) AS correlation, (SELECT inference_advantage FROM ({SQL['cap']})) AS cap FROM ({_QUALITY})),
c AS (SELECT 'singling_out_risk' AS metric, 'privacy' AS area, NULL::DOUBLE AS value, 0.05::DOUBLE AS threshold, 'unmeasured' AS state, 0 AS penalty UNION ALL SELECT 'linkability_risk', 'privacy', NULL, 0.05, 'unmeasured', 0
    UNION ALL SELECT 'inference_risk', 'privacy', NULL, 0.05, 'unmeasured', 0 UNION ALL SELECT 'memorization_risk_rate', 'privacy', NULL, 0.05, 'unmeasured', 0
    UNION ALL SELECT 'inference_advantage', 'privacy', cap, 0.05, CASE WHEN cap > 0.05 THEN 'issue' ELSE 'ok' END, CASE WHEN cap > 0.05 THEN 10 ELSE 0 END FROM v UNION ALL SELECT 'subspace_pass', 'privacy', NULL, 1, 'ok', 0
    UNION ALL SELECT 'composite', 'quality', composite, 0.8, CASE WHEN composite < 0.8 THEN 'issue' ELSE 'ok' END, CASE WHEN composite < 0.8 THEN 15 ELSE 0 END FROM v
    UNION ALL SELECT 'correlation', 'quality', correlation, 0.7, CASE WHEN correlation < 0.7 THEN 'issue' ELSE 'ok' END, CASE WHEN correlation < 0.7 THEN 10 ELSE 0 END FROM v
    UNION ALL SELECT 'pmse_ratio', 'quality', NULL, 3, 'ok', 0 UNION ALL SELECT 'spearman_score', 'quality', NULL, 0.8, 'ok', 0 UNION ALL SELECT 'significant_preservation_rate', 'quality', NULL, 0.8, 'ok', 0)
SELECT metric, area, value, threshold, state, penalty FROM c"""


@query("assessment_checks", _CHECKS)
def _(spark, sf):
    return assess.assessment_checks(_measured(spark, sf))


@query(
    "assessment",
    f"""SELECT NULL::INT AS score, bool_and(state = 'ok') FILTER (area = 'privacy') AS privacy_ok, bool_and(state = 'ok') FILTER (area = 'quality') AS quality_ok,
    string_agg(metric, ',' ORDER BY metric) FILTER (state <> 'ok') AS issues, 'REVIEW' AS status FROM ({_CHECKS})""",
)
def _(spark, sf):
    return assess.assessment(assess.assessment_checks(_measured(spark, sf))).withColumn("score", F.col("score").cast("int"))


@query("leaderboard")
def _(spark, sf):
    orders = table(spark, sf, "orders")
    plan = ColumnPlan(("o_orderstatus", "o_orderpriority"), ("o_totalprice",))
    made = generate.marginal_sample(orders, 2000, list(plan.categorical), list(plan.numerical))
    return rounded(assess.leaderboard(orders, {"marginal": made, "bootstrap": generate.bootstrap(orders, 2000, ["o_orderkey"]), "broken": None}, plan))


@query(
    "metric_delta",
    f"WITH a AS (SELECT metric, round(avg(value), 4) AS value FROM ({_METRICS}) GROUP BY metric) SELECT metric, value AS before, value AS after, 0.0::DOUBLE AS delta FROM a",
)
def _(spark, sf):
    means = rounded(assess.metric_means(assess.distribution_metrics(*halves(spark, sf), PLAN)), 4)
    return assess.metric_delta(means, means).drop("met")


@query("escape_copies")
def _(spark, sf):
    a, b = halves(spark, sf)
    columns = ["l_linenumber", "l_quantity", "l_discount", "l_tax"]
    keyed = b.withColumn("row_key", F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey")).select("row_key", *columns)
    return disclosure.escape_copies(a, keyed, "row_key", columns)


@query("date_columns", "SELECT 'o_orderdate' AS column_name, 1.0::DOUBLE AS parse_ratio UNION ALL SELECT 'o_orderstatus', 0.0")
def _(spark, sf):
    return shape.date_columns(table(spark, sf, "orders"), ["o_orderdate", "o_orderstatus"])


@query("value_samples", "SELECT 'c_mktsegment' AS column_name, count(*) FILTER (c_mktsegment IS NULL) AS nulls, count(DISTINCT c_mktsegment) AS distinct_values, array_to_string(list_sort(list(DISTINCT c_mktsegment)), '|') AS samples FROM customer")
def _(spark, sf):
    return shape.value_samples(table(spark, sf, "customer"), ["c_mktsegment"]).withColumn("samples", F.array_join("samples", "|"))


@query("search_terms", "SELECT p_partkey, name FROM (SELECT p_partkey, p_name AS name, p_type AS description, p_brand AS category FROM part) WHERE (contains(lower(name), 'a') OR contains(lower(description), 'a')) AND regexp_matches(upper(trim(name)), '^[A-Z]')")
def _(spark, sf):
    terms = table(spark, sf, "part").selectExpr("p_partkey", "p_name AS name", "p_type AS description", "p_brand AS category")
    return shape.search_terms(terms, "A", initial="A-Z").select("p_partkey", "name")


@query(
    "json_attention",
    "SELECT '/total_price' AS path, 'may_be_derived' AS note, NULL::DOUBLE AS share UNION ALL SELECT '/status', 'may_be_flag', NULL UNION ALL SELECT '/note', 'missing', (SELECT round(count(*) FILTER (o_orderkey % 3 <> 1) / count(*), 6) FROM orders)",
)
def _(spark, sf):
    """Notes: a name of a sum, a name of a flag, and a field that is absent or empty in two rows of three."""
    key = F.col("o_orderkey")
    note = F.when(key % 3 == 0, F.lit("")).otherwise(F.lit(',"note":""'))
    text = F.concat(F.lit('{"id":'), key.cast("string"), F.lit(',"total_price":1.5,"status":"x"'), F.when(key % 3 == 1, F.lit(',"note":"seen"')).otherwise(note), F.lit("}"))
    return assess.attention(json_paths.path_statistics(table(spark, sf, "orders").select(text.alias("body")), "body"))


@query(
    "embedded_records",
    """SELECT o_orderkey AS id, 0 AS document_no, 'json' AS kind, 'meta' AS part, NULL::INT AS record_no, 'totalCount' AS field, '2' AS value, 'integer' AS value_kind FROM orders
    UNION ALL SELECT o_orderkey, 0, 'json', 'record', i, f, CASE f WHEN 'key' THEN (o_orderkey + i)::VARCHAR ELSE o_orderstatus END, CASE f WHEN 'key' THEN 'integer' ELSE 'string' END FROM orders, (VALUES (0), (1)) AS r(i), (VALUES ('key'), ('status')) AS c(f)
    UNION ALL SELECT o_orderkey, 1, 'xml', 'record', i, f, CASE f WHEN 'day' THEN '2024-01-0' || (i + 1) ELSE o_orderkey || '.5' END, CASE f WHEN 'day' THEN 'date' ELSE 'number' END FROM orders, (VALUES (0), (1)) AS r(i), (VALUES ('day'), ('price')) AS c(f)""",
)
def _(spark, sf):
    """Two documents inside a sentence, after brackets that are none and before one that is cut off."""
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    item = lambda i: F.concat(F.lit('{"key":'), (key + i).cast("string"), F.lit(',"status":"'), status, F.lit('"}'))
    row = lambda i: F.concat(F.lit(f"<row><day>2024-01-0{i + 1}</day><price>"), key.cast("string"), F.lit(".5</price></row>"))
    text = F.concat(F.lit('see [1] {not json} {"totalCount":2,"items":['), item(0), F.lit(","), item(1), F.lit("]} and <p>then <rows>"), row(0), row(1), F.lit('</rows> and {"cut":['))
    return documents.embedded_cells(table(spark, sf, "orders").select("o_orderkey", text.alias("body")), "o_orderkey", "body")


@query("embedded_in_pages")
def _(spark, sf):
    return documents.embedded_cells(table(spark, sf, "pages"), "page_id", "html")


@query(
    "mask_with_whitelist",
    "SELECT c_custkey, '담당자: ' || ['홍길동', '남궁민수', '김서연', '박준'][c_custkey % 4 + 1] || ', 한국은행 소속. 전화 010-****-' || four || ' 메일 ' || CASE WHEN four IN ('0001', '0010') THEN 'user' || four ELSE 'use*****' END || '@example.com 번호 900101-1 , 카드 1234-56**-****-' || four || ' 주소 서울시 중구 ********' AS masked FROM (SELECT c_custkey, lpad((c_custkey % 10000)::VARCHAR, 4, '0') AS four FROM customer)",
)
def _(spark, sf):
    return notes(spark, sf).select("c_custkey", masking.inline_except(F.col("note"), ["USER0001@example.com", "user0010@example.com"]).alias("masked"))


@query("whitelist_in_documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(masking.inline_except(F.col("text"), ["example.com", "license"])).alias("masked"))


@query("detection_view", "SELECT conv_id, turn, regexp_replace(regexp_replace(text, '[\\t\\x0B\\x0C\\x{A0}]', ' ', 'g'), '[‐‑‒–−－]', '-', 'g') AS seen FROM conversations")
def _(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", text_rules.detection_view("text").alias("seen"))


@query("format_faults", "SELECT c_custkey, [NULL, 'literal', 'length', 'digit', 'case'][c_custkey % 5 + 1] AS fault FROM customer")
def _(spark, sf):
    """Replacements of Customer#000000001: itself, with its mark starred, cut, with letters for digits, and in lower case."""
    name = F.col("c_name")
    put = F.element_at(F.array(name, F.translate(name, "#", "*"), F.substring(name, 1, 5), F.translate(name, "0123456789", "abcdefghij"), F.lower(name)), (F.col("c_custkey") % 5 + 1).cast("int"))
    return table(spark, sf, "customer").select("c_custkey", text_rules.format_fault("c_name", put).alias("fault"))


@query(
    "replacement_faults",
    """SELECT 'Order ' || o_orderkey AS original, 'Order ' || o_orderkey AS replacement, 'blank' AS fault FROM orders WHERE o_orderkey % 4 = 0 UNION ALL SELECT 'Order ' || o_orderkey, 'Xrder', 'length' FROM orders WHERE o_orderkey % 4 = 1 UNION ALL SELECT 'Order ' || o_orderkey, 'Order ' || o_orderkey, 'leak' FROM orders WHERE o_orderkey % 4 = 0
    UNION ALL SELECT DISTINCT 'Order ' || b.o_orderkey, CASE b.o_orderkey % 4 WHEN 0 THEN 'Order ' || b.o_orderkey WHEN 1 THEN 'Xrder' ELSE 'Xxxxx ' || repeat('1', length(b.o_orderkey::VARCHAR)) END, 'overlap' FROM orders AS b JOIN orders AS a ON a.o_orderkey <> b.o_orderkey AND starts_with(b.o_orderkey::VARCHAR, a.o_orderkey::VARCHAR)""",
)
def _(spark, sf):
    key = F.col("o_orderkey").cast("string")
    name = F.concat(F.lit("Order "), key)
    put = F.when(F.col("o_orderkey") % 4 == 0, name).when(F.col("o_orderkey") % 4 == 1, F.lit("Xrder")).otherwise(F.concat(F.lit("Xxxxx "), F.repeat(F.lit("1"), F.length(key))))
    return text_rules.replacement_faults(table(spark, sf, "orders").select(name.alias("a"), put.alias("b")), "a", "b")


@query("dummy_tables", f"SELECT range AS row_id, (range + 1)::VARCHAR AS order_id, (1000 + floor({draw_sql('range', 'amount')} * 999001))::BIGINT AS amount, 'U' || (floor({draw_sql('range', 'orders.user_id')} * 100)::BIGINT + 1) AS user_id FROM range(300)")
def _(spark, sf):
    made = generate.dummy_tables(
        spark, {"users": (100, {"user_id": {"type": "sequence", "prefix": "U"}}), "orders": (300, {"order_id": {"type": "sequence"}, "user_id": {"type": "constant", "value": ""}, "amount": shape.infer_domain("order_amount")[1]})},
        [Relationship("users", "orders", "user_id", "user_id")],
    )
    return made["orders"]


@query(
    "repeated_output",
    f"SELECT m.row_id, o_orderstatus, c_name FROM ({drawn_category_sql('orders', 'o_orderstatus', 500)}) AS m JOIN ({numbered_sql('customer', 'c_custkey')}) ON m.row_id % (SELECT count(*) FROM customer) = _n",
)
def _(spark, sf):
    made = generate.marginal_sample(table(spark, sf, "orders"), 500, ["o_orderstatus"], [])
    return generate.repeated_output(made, table(spark, sf, "customer"), ["c_name"], "row_id", ["c_custkey"])
