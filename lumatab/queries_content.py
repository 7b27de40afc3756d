"""Queries of personal data, text, semi-structured records, conversions and made-up tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from lumatab.functions import masking, text_quality
from lumatab.operators import disclosure, generate, personal_data, survey
from lumatab.plans.model import ColumnPlan, Relationship
from lumatab.queries import SQL, query, rounded, table, union
from lumatab.sources import json_paths, readers, writers
from lumatab.streaming.observe import windowed_observations

# --- masks ----------------------------------------------------------------------------------------------------

_GENERIC = "CASE WHEN length(t) <= 1 THEN '*' WHEN length(t) = 2 THEN t[1] || '*' WHEN length(t) = 3 THEN t[1] || '*' || t[3] WHEN length(t) = 4 THEN t[1] || '**' || t[4] WHEN length(t) <= 8 THEN t[1:2] || repeat('*', length(t) - 3) || t[-1] ELSE t[1:3] || repeat('*', length(t) - 6) || right(t, 3) END"


@query("mask_generic", f"SELECT c_custkey, {_GENERIC} AS masked FROM (SELECT c_custkey, trim(c_name) AS t FROM customer)")
def _(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", masking.generic(F.col("c_name")).alias("masked"))


_MAIL = "lower(replace(c_name, '#', '.')) || c_custkey || '@' || lower(c_mktsegment) || '.com'"


@query("mask_email", f"SELECT c_custkey, CASE WHEN length(u) = 1 THEN '*' WHEN length(u) = 2 THEN u[1] || '*' WHEN length(u) <= 5 THEN u[1:2] || repeat('*', length(u) - 2) ELSE u[1:3] || repeat('*', least(length(u) - 3, 5)) END || '@' || d AS masked FROM (SELECT c_custkey, split_part(m, '@', 1) AS u, split_part(m, '@', 2) AS d FROM (SELECT c_custkey, {_MAIL} AS m FROM customer))")
def _(spark, sf):
    mail = F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.col("c_custkey").cast("string"), F.lit("@"), F.lower("c_mktsegment"), F.lit(".com"))
    return table(spark, sf, "customer").select("c_custkey", masking.email(mail).alias("masked"))


@query("mask_phone", "SELECT c_custkey, '010-****-' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') AS masked FROM customer")
def _(spark, sf):
    last = F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0")
    return table(spark, sf, "customer").select("c_custkey", masking.phone(F.concat(F.lit("010-2345-"), last)).alias("masked"))


@query("mask_credit_card", "SELECT c_custkey, lpad((c_custkey % 10000)::VARCHAR, 4, '0') || '-12**-****-7890' AS masked FROM customer")
def _(spark, sf):
    first = F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0")
    return table(spark, sf, "customer").select("c_custkey", masking.credit_card(F.concat(first, F.lit("-1234-5678-7890"))).alias("masked"))


def _inline_sql(column: str) -> str:
    out = column
    for pattern, put in masking.INLINE:
        to = put.replace("$", "\\")
        out = f"regexp_replace({out}, '{pattern}', '{to}', 'g')"
    return out


@query("mask_inline", f"SELECT doc_id, md5({_inline_sql('text')}) AS masked FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(masking.inline(F.col("text"))).alias("masked"))


@query("mask_inline_turns", f"SELECT conv_id, turn, {_inline_sql('text')} AS masked FROM conversations")
def _(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", masking.inline(F.col("text")).alias("masked"))


_KINDS = {"email": r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b", "ip": r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "card": r"\b\d{16}\b"}


@query("inline_pii_counts", union([f"SELECT '{k}' AS kind, sum(len(regexp_extract_all(text, '{p}')))::BIGINT AS hits, count(*) FILTER (regexp_matches(text, '{p}')) AS rows_with_hits FROM documents" for k, p in _KINDS.items()]))
def _(spark, sf):
    return personal_data.inline_counts(table(spark, sf, "documents"), "text", _KINDS)


@query("pii_replacements", union([f"SELECT '{k}' AS kind, found, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '{p}')) AS found FROM documents) GROUP BY found" for k, p in _KINDS.items()]))
def _(spark, sf):
    return personal_data.replacements(table(spark, sf, "documents"), "text", _KINDS).select("kind", "found", "n")


@query(
    "pii_scan",
    "SELECT 'c_name' AS column_name, 'name' AS kind, 'name' AS source, 0.0::DOUBLE AS share UNION ALL SELECT 'contact', 'email', 'value', avg(regexp_matches('user' || c_custkey || '@example.com', '^[^@]+@[^@]+[.][^@]+$')::INT) FROM customer UNION ALL SELECT unnest(['c_custkey', 'c_nationkey', 'c_acctbal', 'c_mktsegment']), NULL, NULL, 0.0",
)
def _(spark, sf):
    return personal_data.scan(table(spark, sf, "customer").withColumn("contact", F.concat(F.lit("user"), F.col("c_custkey").cast("string"), F.lit("@example.com"))))


_PEOPLE = "['홍길동', '남궁민수', '김서연', '박준']"


def notes(spark, sf):
    """A sentence a customer: a labelled name, an organisation, a number of each kind, an address."""
    k = F.col("c_custkey")
    name = F.element_at(F.array(*map(F.lit, ["홍길동", "남궁민수", "김서연", "박준"])), (k % 4 + 1).cast("int"))
    four = F.lpad((k % 10000).cast("string"), 4, "0")
    note = F.concat(F.lit("담당자: "), name, F.lit(", 한국은행 소속. 전화 010-1234-"), four, F.lit(" 메일 user"), four, F.lit("@example.com 번호 900101-1 "), F.lit(", 카드 1234-5678-9012-"), four, F.lit(" 주소 서울시 중구 세종대로 "), (k % 100).cast("string"))
    return table(spark, sf, "customer").select("c_custkey", note.alias("note"))


@query("named_entities", f"SELECT c_custkey AS id, 'PERSON_NAME' AS kind, {_PEOPLE}[c_custkey % 4 + 1] AS entity, 5 AS start, 5 + length({_PEOPLE}[c_custkey % 4 + 1])::INT AS stop FROM customer UNION ALL SELECT c_custkey, 'ORGANIZATION', '한국은행', 7 + length({_PEOPLE}[c_custkey % 4 + 1])::INT, 11 + length({_PEOPLE}[c_custkey % 4 + 1])::INT FROM customer")
def _(spark, sf):
    return personal_data.entities(notes(spark, sf), "c_custkey", "note")


@query(
    "mask_full_text",
    "SELECT c_custkey, '담당자: ' || ['홍*동', '남궁*수', '김*연', '박*'][c_custkey % 4 + 1] || ', 한국은행 소속. 전화 010-****-' || four || ' 메일 use*****@example.com 번호 900101-1 , 카드 1234-56**-****-' || four || ' 주소 서울시 중구 ********' AS masked FROM (SELECT c_custkey, lpad((c_custkey % 10000)::VARCHAR, 4, '0') AS four FROM customer)",
)
def _(spark, sf):
    return notes(spark, sf).select("c_custkey", masking.inline(F.col("note"), personal_data.names_masked).alias("masked"))


@query("entities_in_documents")
def _(spark, sf):
    return personal_data.entities(table(spark, sf, "documents"), "doc_id", "text")


@query("sha256_pseudonym", "SELECT c_custkey, sha256(c_name) AS c_name FROM customer")
def _(spark, sf):
    return personal_data.apply_plan(table(spark, sf, "customer"), ColumnPlan(pii={"c_name": "hash"})).select("c_custkey", "c_name")


#: Of the example queries only; an application passes its own.
_SECRET = b"example queries"


def _blob(data: bytes) -> str:
    return "'" + "".join(f"\\x{b:02X}" for b in data) + "'::BLOB"


def _token_sql(column: str, scope: bytes) -> str:
    inner, outer = (bytes(b ^ x for b in _SECRET.ljust(64, b"\0")) for x in (0x36, 0x5C))
    return f"upper(substr(sha256({_blob(outer)} || unhex(sha256({_blob(inner + scope)} || encode(trim({column}))))), 1, 20))"


_SCOPE = b"v1\x1fdemo\x1fc_name\x1f"


@query("keyed_token", f"SELECT c_custkey, 'CNAM-' || {_token_sql('c_name', _SCOPE)} AS token FROM customer")
def _(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", masking.token(F.col("c_name"), _SECRET, "demo", "c_name").alias("token"))


# --- text -----------------------------------------------------------------------------------------------------

_TURNS = "SELECT conv_id, turn, text, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS before FROM conversations"


def _turns(spark, sf):
    from pyspark.sql import Window

    return table(spark, sf, "conversations").withColumn("before", F.coalesce(F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit("")))


@query("script_ratios", "SELECT doc_id, round(len(regexp_extract_all(text, '[가-힣]')) / nullif(length(text), 0), 6) AS hangul, round(len(regexp_extract_all(text, '[0-9]')) / nullif(length(text), 0), 6) AS digits, round(len(regexp_extract_all(text, '[�□]')) / nullif(length(text), 0), 6) AS unknown FROM documents")
def _(spark, sf):
    t = F.col("text")
    return rounded(table(spark, sf, "documents").select("doc_id", text_quality.share(t, text_quality.HANGUL).alias("hangul"), text_quality.share(t, "[0-9]").alias("digits"), text_quality.share(t, text_quality.UNKNOWN).alias("unknown")))


@query("cer", "SELECT p_partkey, round(CASE WHEN p_name = '' THEN (p_type <> '')::INT::DOUBLE ELSE levenshtein(p_name, p_type) / length(p_name) END, 6) AS cer FROM part")
def _(spark, sf):
    return rounded(table(spark, sf, "part").select("p_partkey", text_quality.character_error_rate(F.col("p_name"), F.col("p_type")).cast("double").alias("cer")))


@query("cer_turns")
def _(spark, sf):
    return rounded(_turns(spark, sf).select("conv_id", "turn", text_quality.character_error_rate(F.col("before"), F.col("text")).cast("double").alias("cer")))


@query("wer")
def _(spark, sf):
    return _turns(spark, sf).select("conv_id", "turn", text_quality.word_error_rate("before", "text").alias("wer"))


@query("sequence_similarity")
def _(spark, sf):
    return _turns(spark, sf).select("conv_id", "turn", text_quality.sequence_ratio("before", "text").alias("ratio"))


@query("char_coverage", f"""WITH t AS (SELECT row_number() OVER () AS rid, * FROM ({_TURNS})), a AS (SELECT rid, c, count(*) AS n FROM (SELECT rid, unnest(string_split(before, '')) AS c FROM t) WHERE NOT regexp_matches(c, '^\\s*$') GROUP BY ALL),
b AS (SELECT rid, c, count(*) AS n FROM (SELECT rid, unnest(string_split(text, '')) AS c FROM t) WHERE NOT regexp_matches(c, '^\\s*$') GROUP BY ALL),
m AS (SELECT a.rid, sum(a.n) AS total, sum(least(a.n, coalesce(b.n, 0))) AS common FROM a LEFT JOIN b USING (rid, c) GROUP BY a.rid)
SELECT conv_id, turn, round(coalesce(common / total, 1), 6) AS coverage FROM t LEFT JOIN m USING (rid)""")
def _(spark, sf):
    return rounded(_turns(spark, sf).select("conv_id", "turn", text_quality.coverage(F.col("before"), F.col("text")).cast("double").alias("coverage")))


_KNOWN = "".join("\\" + c if c in "[]\\^-/" else c for c in text_quality.PUNCTUATION).replace("'", "''")


@query(
    "text_quality",
    f"""WITH t AS (SELECT doc_id, text, trim(text, ' ') AS t, regexp_replace(text, '[\\s\\x0B\\x85\\p{{Z}}]', '', 'g') AS solid, string_split(text, '') AS c FROM documents)
    SELECT doc_id, round(coalesce(len(regexp_extract_all(solid, '[^\\p{{L}}\\p{{N}}_{_KNOWN}]')) / nullif(length(solid), 0), 0), 6) AS special, round(coalesce(len(list_filter(range(3, len(c) + 1), lambda i: c[i] = c[i - 1] AND c[i] = c[i - 2])) / nullif(length(text), 0), 0), 6) AS repeated,
    CASE WHEN length(solid) > 0 AND regexp_matches(t, '[A-Za-z0-9]') THEN 0.35::DOUBLE ELSE 0 END AS prose, t = '' OR (length(t) >= 8 AND (NOT regexp_matches(t, '[가-힣A-Za-z0-9]') OR length(regexp_replace(t, '[.\\-_=~·ㆍ…\\s]', '', 'g')) <= 1)) AS noise FROM t""",
)
def _(spark, sf):
    t = F.col("text")
    return rounded(table(spark, sf, "documents").select("doc_id", text_quality.special_ratio(t).alias("special"), text_quality.repeated(t).alias("repeated"), text_quality.prose_quality(t).alias("prose"), text_quality.is_noise(t).alias("noise")))


@query("normalised_text", "SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g'), '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')) AS cleaned FROM (SELECT doc_id, nfc_normalize(text) AS text FROM documents)")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(text_quality.normalised(F.col("text"), keep_spaces=False)).alias("cleaned"))


@query("redacted_urls", "SELECT page_id, regexp_replace(url || '?token=' || page_id, '([?&](?:serviceKey|apiKey|token|signature)=)[^&\\s]+', '\\1[REDACTED]', 'gi') AS url FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", text_quality.redacted(F.concat("url", F.lit("?token="), F.col("page_id").cast("string"))).alias("url"))


# --- semi-structured and conversions --------------------------------------------------------------------------


@query(
    "json_path_stats",
    """WITH k AS (SELECT unnest(json_keys(props)) AS key, props FROM events WHERE props IS NOT NULL), v AS (SELECT '/' || key AS path, json_type(json_extract(props, '$."' || key || '"')) AS t, json_extract_string(props, '$."' || key || '"') AS x FROM k),
    n AS (SELECT path, CASE t WHEN 'VARCHAR' THEN 'string' WHEN 'UBIGINT' THEN 'integer' WHEN 'BIGINT' THEN 'integer' WHEN 'DOUBLE' THEN 'number' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' WHEN 'ARRAY' THEN 'array' ELSE 'object' END AS kind, x FROM v)
    SELECT path, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, count(*) AS occurrences, count(*) FILTER (kind NOT IN ('object', 'array')) AS scalars, count(*) FILTER (kind = 'null') AS nulls, count(*) FILTER (kind = 'string' AND x = '') AS empties,
    count(*) FILTER (kind IN ('integer', 'number') AND TRY_CAST(x AS DOUBLE) = 0) AS zeros, count(*) FILTER (kind = 'boolean' AND x = 'false') AS falses, greatest((SELECT count(*) FROM events WHERE props IS NOT NULL) - count(*), 0) AS missing FROM n GROUP BY path
    UNION ALL SELECT '$', 'object', count(*), 0, 0, 0, 0, 0, NULL FROM events WHERE props IS NOT NULL""",
)
def _(spark, sf):
    return json_paths.path_statistics(table(spark, sf, "events"), "props")


@query("json_completeness", f"SELECT sum(scalars)::BIGINT AS cells, sum(nulls + empties)::BIGINT AS missing, round(100 * (sum(scalars) - sum(nulls + empties)) / sum(scalars), 2) AS score FROM ({SQL['json_path_stats']}) WHERE scalars > 0")
def _(spark, sf):
    return json_paths.leaf_completeness(json_paths.path_statistics(table(spark, sf, "events"), "props"))


@query("sql_inserts", "SELECT s_suppkey, '(' || s_suppkey || ', ''' || replace(replace(s_name, '\\', '\\\\'), '''', '''''') || ''', ' || s_nationkey || ')' AS row_text FROM supplier")
def _(spark, sf):
    df = table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    return df.select("s_suppkey", writers.insert_rows(df).alias("row_text"))


@query("sql_insert_statements", "SELECT floor((n - 1) / 500)::BIGINT AS statement_no, 'INSERT INTO `parts` (`p_partkey`, `p_size`) VALUES' || chr(10) || string_agg('  (' || p_partkey || ', ' || p_size || ')', ',' || chr(10) ORDER BY n) || ';' AS statement FROM (SELECT *, row_number() OVER (ORDER BY p_partkey) AS n FROM part) GROUP BY 1")
def _(spark, sf):
    return writers.insert_statements(table(spark, sf, "part").select("p_partkey", "p_size"), "parts", ["p_partkey"])


@query("xml_records", "SELECT '<record><field name=\"n_nationkey\">' || n_nationkey || '</field><field name=\"n_name\">' || n_name || '</field></record>' AS record FROM nation")
def _(spark, sf):
    return writers.xml_records(table(spark, sf, "nation").select("n_nationkey", "n_name"))


@query(
    "envelope_pages",
    """SELECT floor(n_nationkey / 10)::BIGINT AS page_no, '{"response":{"header":{"resultMsg":"NORMAL_CODE","resultCode":"00"},"body":{"totalCount":' || (SELECT count(*) FROM nation) || ',"pageNo":' || floor(n_nationkey / 10)::BIGINT || ',"numOfRows":' || count(*) || ',"items":['
    || string_agg('{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}', ',' ORDER BY n_nationkey) || ']}}}' AS body FROM nation GROUP BY 1""",
)
def _(spark, sf):
    return writers.envelope_pages(table(spark, sf, "nation"), "n_nationkey", 10)


def _folder(spark) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset, on one machine only, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lumatab-")
    return f"{base.rstrip('/')}/lumatab/{spark.sparkContext.applicationId}/trip-{uuid.uuid4().hex}"


def _trip(kind: str):
    """Orders written in a format and read back by the dispatcher, as text columns."""

    def run(spark, sf):
        path = f"{_folder(spark)}.{kind}"
        df = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.concat(F.col("o_orderstatus"), F.lit(' "é", <'), F.col("o_orderpriority"), F.lit(">")).alias("label"))
        writers.write_table(df, path, kind)
        back = readers.load_table(spark, path)
        if kind == "xml":
            cell = lambda name: F.element_at(F.filter("field", lambda x: x["_name"] == name), 1)["_VALUE"]
            back = back.select(*(cell(c).alias(c) for c in df.columns))
        return back.select(*(F.col(c).cast("string") for c in df.columns))

    return run


for _kind in ("csv", "tsv", "json", "jsonl", "parquet", "xml"):
    query(f"round_trip_{_kind}", "SELECT o_orderkey::VARCHAR AS o_orderkey, o_custkey::VARCHAR AS o_custkey, o_orderstatus || ' \"é\", <' || o_orderpriority || '>' AS label FROM orders")(_trip(_kind))


@query("frame_checksum", "SELECT count(*) AS rows, CAST(sum(('0x' || substr(sha256(length(CAST(n_nationkey AS VARCHAR)) || ':' || n_nationkey || '|' || length(n_name) || ':' || n_name), 1, 15))::BIGINT::HUGEINT) AS VARCHAR) AS checksum FROM nation")
def _(spark, sf):
    return writers.checksum(table(spark, sf, "nation").select("n_nationkey", "n_name"))


# --- questionnaires -------------------------------------------------------------------------------------------

#: A five-point scale and what stands for no answer.
_SCALE = ["매우 불만족", "불만족", "보통", "만족", "매우 만족"]


def _answers(spark, sf):
    item = F.element_at(F.array(*map(F.lit, [*_SCALE, "미응답"])), (F.col("l_linenumber") % 6 + 1).cast("int"))
    took = F.when(F.col("l_returnflag") == "N", "아니오").otherwise("예")
    why = F.when(F.col("l_returnflag") == "N", "미응답").otherwise(F.col("l_linestatus"))
    return table(spark, sf, "lineitem").select(F.concat_ws(":", "l_orderkey", "l_linenumber").alias("row_key"), item.alias("rating"), took.alias("took_part"), why.alias("reason"))


_ANSWERS = "SELECT l_orderkey || ':' || l_linenumber AS row_key, ['매우 불만족', '불만족', '보통', '만족', '매우 만족', '미응답'][l_linenumber % 6 + 1] AS rating, CASE WHEN l_returnflag = 'N' THEN '아니오' ELSE '예' END AS took_part, CASE WHEN l_returnflag = 'N' THEN '미응답' ELSE l_linestatus END AS reason FROM lineitem"


@query("likert_columns", "SELECT 'rating' AS column_name, 0 AS scale, 5::BIGINT AS overlap, true AS has_unanswered")
def _(spark, sf):
    return survey.likert_columns(_answers(spark, sf), ["rating", "took_part", "reason"], [_SCALE])


@query("likert_encode", f"SELECT row_key, coalesce(nullif(list_position(['매우 불만족', '불만족', '보통', '만족', '매우 만족'], rating), 0), 3)::DOUBLE AS rating, rating = '미응답' AS rating_unanswered FROM ({_ANSWERS})")
def _(spark, sf):
    return survey.encode_likert(_answers(spark, sf), {"rating": _SCALE}).select("row_key", "rating", "rating_unanswered")


@query("likert_round_trip", f"SELECT row_key, rating FROM ({_ANSWERS})")
def _(spark, sf):
    scales = {"rating": _SCALE}
    return survey.decode_likert(survey.encode_likert(_answers(spark, sf), scales), scales).select("row_key", "rating")


@query("skip_rules", f"SELECT 'took_part' AS condition_column, '아니오' AS condition_value, 'reason' AS target_column, 1.0::DOUBLE AS confidence, count(*) AS support FROM ({_ANSWERS}) WHERE took_part = '아니오'")
def _(spark, sf):
    return survey.skip_rules(_answers(spark, sf), ["rating", "took_part", "reason"])


@query("skip_compliance", f"SELECT 'took_part=예 -> rating' AS rule, count(*) AS applicable_rows, count(*) FILTER (rating <> '미응답') AS violations, round(1 - count(*) FILTER (rating <> '미응답') / count(*), 4) AS compliance_rate, CASE WHEN count(*) = 0 THEN 'NOT_EVALUATED' WHEN count(*) FILTER (rating <> '미응답') = 0 THEN 'PASS' ELSE 'REVIEW' END AS status FROM ({_ANSWERS}) WHERE took_part = '예'")
def _(spark, sf):
    return survey.skip_compliance(_answers(spark, sf), [("took_part", "예", "rating")])


@query("qi_frequency_join", "SELECT coalesce(a.c_nationkey, b.c_nationkey) AS c_nationkey, coalesce(x, 0) AS original_count, coalesce(y, 0) AS derived_count, coalesce(y, 0) - coalesce(x, 0) AS difference FROM (SELECT coalesce(CAST(c_nationkey AS VARCHAR), '<NULL>') AS c_nationkey, count(*) AS x FROM customer GROUP BY 1) AS a FULL JOIN (SELECT coalesce(CAST(s_nationkey AS VARCHAR), '<NULL>') AS c_nationkey, count(*) AS y FROM supplier GROUP BY 1) AS b ON a.c_nationkey = b.c_nationkey")
def _(spark, sf):
    return survey.group_frequencies(table(spark, sf, "customer"), table(spark, sf, "supplier").withColumnRenamed("s_nationkey", "c_nationkey"), ["c_nationkey"])


@query("survey_fuse", "SELECT c_custkey, c_mktsegment AS first__c_mktsegment, c_nationkey AS second__c_nationkey, c_acctbal AS second__c_acctbal FROM customer")
def _(spark, sf):
    a = table(spark, sf, "customer")
    return survey.fuse({"first": a.select("c_custkey", "c_mktsegment"), "second": a.select("c_custkey", "c_nationkey", "c_acctbal")}, "c_custkey", [])


# --- made-up tables -------------------------------------------------------------------------------------------


def draw_sql(key: str, salt: str, seed: int = 42) -> str:
    """A draw of (0, 1) as its specification has it: 52 bits of the md5 of key, seed and salt."""
    return f"((('0x' || substr(md5(CAST({key} AS VARCHAR) || ':{seed}:{salt}'), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)"


def normal_sql(key: str, salt: str, seed: int = 42) -> str:
    return f"(sqrt(-2 * ln({draw_sql(key, salt + ':r', seed)})) * cos(2 * pi() * {draw_sql(key, salt + ':a', seed)}))"


def numbered_sql(table_name: str, key: str, seed: int = 42) -> str:
    """Rows numbered from 0 in the order of the md5 of key and seed."""
    return f"SELECT *, row_number() OVER (ORDER BY md5(CAST({key} AS VARCHAR) || ':{seed}'), {key}) - 1 AS _n FROM {table_name}"


def drawn_category_sql(source: str, column: str, rows: int) -> str:
    """(row_id, column): values whose cumulated shares, in the order of their md5, hold the draw."""
    return f"""SELECT row_id, {column} FROM (SELECT range AS row_id, {draw_sql('range', column)} AS u FROM range({rows})) AS d JOIN (SELECT {column}, n, sum(n) OVER (ORDER BY md5({column}), {column}) AS upto, sum(n) OVER () AS total
    FROM (SELECT {column}, count(*) AS n FROM {source} GROUP BY 1)) AS s ON u > (upto - n)::DOUBLE / total::DOUBLE AND u <= upto::DOUBLE / total::DOUBLE"""


def between_sql(grid: str, draw: str, steps: int = 200) -> str:
    low = f"least(floor({draw} * {steps}), {steps - 1})::INT"
    return f"({grid}[{low} + 1] + ({draw} * {steps} - {low}) * ({grid}[{low} + 2] - {grid}[{low} + 1]))"




GRID = "[" + ", ".join(repr(i / 200) for i in range(201)) + "]"


@query(
    "marginal_sample",
    f"""WITH o AS (SELECT * FROM orders WHERE o_orderstatus = 'O'), g AS (SELECT quantile_cont(o_totalprice, {GRID}) AS q FROM o)
    SELECT row_id, 'O' AS o_orderstatus, o_orderpriority, round({between_sql('q', draw_sql('row_id', 'o_totalprice'))}, 4) AS o_totalprice FROM ({drawn_category_sql('o', 'o_orderpriority', 1000)}), g""",
)
def _(spark, sf):
    return rounded(generate.marginal_sample(table(spark, sf, "orders"), 1000, ["o_orderstatus", "o_orderpriority"], ["o_totalprice"], {"o_orderstatus": "O"}), 4)


@query("copula_sample")
def _(spark, sf):
    return generate.copula_sample(table(spark, sf, "lineitem"), 1000, ["l_quantity", "l_extendedprice", "l_discount"])


@query("bootstrap", f"SELECT row_id, c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM (SELECT range AS row_id, floor({draw_sql('range', 'boot')} * (SELECT count(*) FROM customer))::BIGINT AS pick FROM range(1000)) JOIN ({numbered_sql('customer', 'c_custkey')}) ON pick = _n")
def _(spark, sf):
    return generate.bootstrap(table(spark, sf, "customer"), 1000, ["c_custkey"])


@query(
    "relational_sample",
    f"""WITH n AS (SELECT greatest(1, floor((SELECT count(*) FROM customer) * 0.5)::BIGINT) AS a, greatest(1, floor((SELECT count(*) FROM orders) * 0.5)::BIGINT) AS b),
    c AS (SELECT range + 1 AS c_custkey, c_mktsegment FROM range((SELECT a FROM n)) JOIN ({numbered_sql('customer', 'c_custkey')}) ON floor({draw_sql('range', 'rel:customer')} * (SELECT count(*) FROM customer))::BIGINT = _n),
    o AS (SELECT range AS row_id, o_totalprice FROM range((SELECT b FROM n)) JOIN ({numbered_sql('orders', 'o_orderkey')}) ON floor({draw_sql('range', 'rel:orders')} * (SELECT count(*) FROM orders))::BIGINT = _n),
    m AS (SELECT row_id + 1 AS o_orderkey, floor({draw_sql('row_id', 'orders.o_custkey')} * (SELECT a FROM n))::BIGINT + 1 AS o_custkey, round(o_totalprice + {normal_sql('row_id', 'orders.o_totalprice')} * 0.05 * (SELECT stddev(o_totalprice) FROM orders), 2) AS o_totalprice FROM o)
    SELECT o_orderkey, o_custkey, c_mktsegment, round(o_totalprice, 1) AS o_totalprice FROM m JOIN c ON o_custkey = c_custkey""",
)
def _(spark, sf):
    made = generate.relational_sample({"customer": table(spark, sf, "customer"), "orders": table(spark, sf, "orders")}, [Relationship("customer", "orders", "c_custkey", "o_custkey")], {"customer": "c_custkey", "orders": "o_orderkey"}, 0.5)
    return made["orders"].join(made["customer"], F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_custkey", "c_mktsegment", F.round("o_totalprice", 1).alias("o_totalprice"))


@query(
    "panel_bootstrap",
    f"""WITH e AS (SELECT * FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL), w AS (SELECT DISTINCT user_id FROM e), k AS (SELECT count(*) AS k FROM w),
    d AS (SELECT range AS row_id, user_id AS old, (floor({draw_sql('range', 'shift')} * 731) - 365)::INT AS days FROM range((SELECT k FROM k)) JOIN ({numbered_sql('w', 'user_id')}) ON floor({draw_sql('range', 'panel')} * (SELECT k FROM k))::BIGINT = _n)
    SELECT 'SYN-' || lpad((row_id + 1)::VARCHAR, 6, '0') AS user_id, ts + to_days(days) AS ts, event_type, round(value + {normal_sql("(row_id || ':' || epoch_us(ts))", 'value')} * (0.03 * (SELECT stddev(value) FROM events)), 4) AS value FROM d JOIN e ON old = user_id""",
)
def _(spark, sf):
    return rounded(generate.panel_sample(table(spark, sf, "events").select("user_id", "ts", "event_type", "value"), "user_id", "ts"), 4)


def _pattern_sql(form: str, column: str) -> str:
    draw = lambda i: draw_sql("row_id", f"{column}:{i}")
    return " || ".join(f"floor({draw(i)} * 10)::INT::VARCHAR" if c == "#" else f"chr(65 + floor({draw(i)} * 26)::INT)" if c == "?" else f"'{c}'" for i, c in enumerate(form))


@query(
    "dummy_columns",
    f"""WITH t AS (SELECT range AS row_id, * FROM range(1000)), p AS (SELECT row_id, {_pattern_sql('??-####', 'code')} AS code FROM t), u AS (SELECT row_id, code || CASE WHEN k > 1 THEN '-' || k ELSE '' END AS code FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY row_id) AS k FROM p))
    SELECT row_id, CASE WHEN row_id = 0 THEN '' ELSE code END AS code, CASE WHEN row_id = 0 THEN '' WHEN {draw_sql('row_id', 'city')} <= 0.5 THEN 'a' WHEN {draw_sql('row_id', 'city')} <= 0.8 THEN 'b' ELSE 'c' END AS city, 'N' || (10 + row_id * 5) AS no,
    CASE row_id WHEN 0 THEN 1.2::DOUBLE WHEN 1 THEN 4.8::DOUBLE ELSE (2 + floor({draw_sql('row_id', 'amount')} * 3))::DOUBLE END AS amount, strftime(DATE '2024-01-01' + floor({draw_sql('row_id', 'day')} * 366)::INT, '%Y-%m-%d') AS day, 'x' AS fixed FROM u""",
)
def _(spark, sf):
    spec = {
        "code": {"type": "pattern", "format": "??-####", "unique": True}, "city": {"type": "choice", "values": ["a", "b", "c"], "weights": [5, 3, 2]}, "no": {"type": "sequence", "prefix": "N", "start": 10, "step": 5},
        "amount": {"type": "number_range", "min": 1.2, "max": 4.8, "integer": True}, "day": {"type": "date_between", "start": "2024-01-01", "end": "2024-12-31"}, "fixed": {"type": "constant", "value": "x"},
    }
    return generate.dummy_table(spark, 1000, spec, scenario="boundary")


@query(
    "laplace_noise",
    f"""WITH s AS (SELECT (quantile_cont(c_acctbal, 0.75) - quantile_cont(c_acctbal, 0.25)) / sqrt(count(*)) AS b FROM customer), u AS (SELECT c_custkey, c_acctbal, {draw_sql('c_custkey', 'c_acctbal')} - 0.5 AS u FROM customer)
    SELECT c_custkey, round(c_acctbal - b * sign(u) * ln(1 - 2 * abs(u)), 6) AS c_acctbal FROM u, s""",
)
def _(spark, sf):
    return rounded(generate.laplace_noise(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"], "c_custkey"))


@query("accepted_sample")
def _(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderstatus", "o_orderpriority", "o_totalprice")
    draw = lambda n, attempt: generate.marginal_sample(orders, n, ["o_orderstatus", "o_orderpriority"], ["o_totalprice"], seed=100 + attempt).drop("row_id")
    return generate.accepted_sample(orders, draw, 500, ["o_orderstatus", "o_orderpriority", "o_totalprice"], F.col("o_totalprice") > 50000)


@query("holdout_split", f"SELECT c_custkey, CASE WHEN _n < (SELECT floor(count(*) * 0.2) FROM customer) THEN 'control' ELSE 'fit' END AS part FROM ({numbered_sql('customer', 'c_custkey')})")
def _(spark, sf):
    fit, control = generate.holdout(table(spark, sf, "customer"), "c_custkey")
    return fit.select("c_custkey", F.lit("fit").alias("part")).unionByName(control.select("c_custkey", F.lit("control").alias("part")))


def _digits_sql(column: str, n: int, salt: str) -> str:
    return f"lpad(floor({draw_sql('c_custkey', f'{column}:{salt}')} * {10**n})::BIGINT::VARCHAR, {n}, '0')"


def _pick_sql(column: str, words: list[str], salt: str) -> str:
    return f"[{', '.join(repr(w) for w in words)}][floor({draw_sql('c_custkey', f'{column}:{salt}')} * {len(words)})::INT + 1]"


_FAKE = {
    "name": " || ".join(_pick_sql("name", w.split(), s) for w, s in (("김 이 박 최 정 강 조 윤", "s"), ("민 서 지 하 도 예", "a"), ("준 연 우 은 호 아", "b"))),
    "phone": f"'010-' || {_digits_sql('phone', 4, 'a')} || '-' || {_digits_sql('phone', 4, 'b')}",
    "email": f"'user' || {_digits_sql('email', 6, 'a')} || '@example.' || {_pick_sql('email', ['com', 'net', 'org'], 'd')}",
    "ssn": f"strftime(DATE '1950-01-01' + floor({draw_sql('c_custkey', 'd')} * 18250)::INT, '%y%m%d') || '-' || {_pick_sql('ssn', ['1', '2'], 'g')} || {_digits_sql('ssn', 6, 'a')}",
    "account": " || '-' || ".join(_digits_sql("account", n, s) for n, s in ((3, "a"), (4, "b"), (6, "c"))),
    "credit_card": " || '-' || ".join(_digits_sql("credit_card", 4, s) for s in "abcd"),
    "business_number": " || '-' || ".join(_digits_sql("business_number", n, s) for n, s in ((3, "a"), (2, "b"), (5, "c"))),
    "ip_address": f"'192.0.2.' || floor({draw_sql('c_custkey', 'ip')} * 256)::INT",
    "car_plate": f"{_digits_sql('car_plate', 2, 'a')} || {_pick_sql('car_plate', ['가', '나', '다', '라', '마'], 'h')} || ' ' || {_digits_sql('car_plate', 4, 'b')}",
    "address": f"{_pick_sql('address', ['서울특별시 중구', '부산광역시 남구', '대전광역시 서구'], 'c')} || ' ' || {_pick_sql('address', ['중앙로', '시청로', '공원로'], 'r')} || ' ' || {_digits_sql('address', 2, 'n')}",
}


@query("fake_values", "SELECT c_custkey, " + ", ".join(f"{v} AS {k}" for k, v in _FAKE.items()) + " FROM customer")
def _(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey")
    for kind in ("name", "phone", "email", "ssn", "account", "credit_card", "business_number", "ip_address", "car_plate", "address"):
        df = generate.fake_values(df, kind, kind, "c_custkey")
    return df


_REGIONS = {"서울": "02", "경기": "031", "부산": "051", "제주": "064"}


@query(
    "fake_people",
    f"""WITH c AS (SELECT c_custkey, (c_custkey % 90)::INT AS age, CASE WHEN c_custkey % 3 = 0 THEN '여' WHEN c_custkey % 3 = 1 THEN 'M' END AS gender, ['서울시', '경기도', '부산', '제주도', 'elsewhere'][c_custkey % 5 + 1] AS region FROM customer),
    d AS (SELECT *, CASE WHEN gender = '여' THEN true WHEN gender = 'M' THEN false ELSE {draw_sql('c_custkey', 'ssn:g')} < 0.5 END AS woman, (DATE '2024-06-30' - to_months(12 * age))::DATE - floor({draw_sql('c_custkey', 'ssn:d')} * 365)::INT AS day,
    CASE c_custkey % 5 WHEN 0 THEN '02' WHEN 1 THEN '031' WHEN 2 THEN '051' WHEN 3 THEN '064' ELSE '010' END AS code FROM c)
    SELECT c_custkey, age, gender, region, strftime(day, '%y%m%d') || '-' || CASE WHEN year(day) < 2000 THEN CASE WHEN woman THEN '2' ELSE '1' END ELSE CASE WHEN woman THEN '4' ELSE '3' END END || {_digits_sql('ssn', 6, 'n')} AS ssn,
    code || '-' || CASE WHEN code = '010' THEN {_digits_sql('phone', 4, 'a')} ELSE (floor({draw_sql('c_custkey', 'phone:a')} * 8) + 2)::INT::VARCHAR || {_digits_sql('phone', 2, 'b')} END || '-' || {_digits_sql('phone', 4, 'e')} AS phone FROM d""",
)
def _(spark, sf):
    k = F.col("c_custkey")
    people = table(spark, sf, "customer").select(
        k, (k % 90).cast("int").alias("age"), F.when(k % 3 == 0, "여").when(k % 3 == 1, "M").alias("gender"), F.element_at(F.array(*map(F.lit, ["서울시", "경기도", "부산", "제주도", "elsewhere"])), (k % 5 + 1).cast("int")).alias("region")
    )
    return generate.fake_people(people, {"ssn": "ssn", "phone": "phone"}, "c_custkey", "2024-06-30", "age", "gender", "region")


@query("survey_inspect", "SELECT * FROM (SELECT 'first' AS module, count(*) AS rows, 3 AS columns, 'c_nationkey' AS common, 0::BIGINT AS missing_keys, true AS aligned FROM customer UNION ALL SELECT 'second', count(*), 3, 'c_nationkey', 0, true FROM customer UNION ALL SELECT 'third', count(*) FILTER (c_custkey % 7 <> 0), 2, 'c_nationkey', count(*) FILTER (c_custkey % 7 = 0), false FROM customer)")
def _(spark, sf):
    a = table(spark, sf, "customer")
    third = a.where("c_custkey % 7 <> 0").select("c_custkey", "c_nationkey")
    return survey.inspect({"first": a.select("c_custkey", "c_nationkey", "c_mktsegment"), "second": a.select("c_custkey", "c_nationkey", "c_acctbal"), "third": third}, "c_custkey")


@query("without_clones", "SELECT s_nationkey AS c_nationkey, s_acctbal AS c_acctbal FROM supplier WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_nationkey IS NOT DISTINCT FROM s_nationkey AND c_acctbal IS NOT DISTINCT FROM s_acctbal)")
def _(spark, sf):
    mine = table(spark, sf, "supplier").selectExpr("s_nationkey AS c_nationkey", "s_acctbal AS c_acctbal")
    return disclosure.without_copies(table(spark, sf, "customer"), mine, ["c_nationkey", "c_acctbal"])


@query(
    "stream_observations",
    "SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS seen, count(*) FILTER (value IS NULL) AS nulls, count(*) FILTER (value = 0) AS zeros, round(avg(value), 6) AS mean, round(min(value), 6) AS min_value, round(max(value), 6) AS max_value FROM events GROUP BY ALL",
)
def _(spark, sf):
    """The stream's windows, gathered by a query that reads the table as a stream and ends with it."""
    schema = table(spark, sf, "events").schema
    name = f"observed_{uuid.uuid4().hex}"
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("basePath", sf).parquet(f"{sf}/events.parquet*")
    run = windowed_observations(stream, "ts", "event_type", "value").writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    run.awaitTermination()
    return rounded(spark.table(name))
