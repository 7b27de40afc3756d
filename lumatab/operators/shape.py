"""What kind of table this is: date roles, declared profiles, column plans, domains; and a search over terms."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumatab.operators import personal_data, profile
from lumatab.operators.rules import moment
from lumatab.plans.model import ColumnPlan, resolve_column

# Words in names of date columns, and what they stand for.
DATE_NAME = "(일자|날짜|일시|년월일|생년|출생|입사|퇴사|퇴직|채용|임용|가입|탈퇴|등록|해지|시작|종료|만료|계약|date|datetime|birth|dob|hire|join|start|begin|from|leave|resign|retire|end|finish|until|expire)"
BIRTH = "(생년|출생|birth|dob)"
STARTS = {"employment": "(입사|채용|임용|근무.?시작|hire|employ)", "membership": "(가입|등록|개설|join|signup|register)", "contract": "(계약.?시작|계약일|contract.?start)", "generic": "(시작|개시|from|start|begin)"}
ENDS = {"employment": "(퇴사|퇴직|퇴임|resign|retire|leave)", "membership": "(탈퇴|해지|withdraw|unregister|cancel)", "contract": "(계약.?종료|만료|contract.?end|expire)", "generic": "(종료|마감|to|end|finish|until)"}


def date_columns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column_name, parse_ratio): share of present values that read as dates."""
    columns = columns or df.columns
    one = df.agg(*(x for i, c in enumerate(columns) for x in (F.count(c).alias(f"n{i}"), F.count(moment(df, c)).alias(f"d{i}"))))
    cells = [F.struct(F.lit(c).alias("column_name"), F.round(F.col(f"d{i}") / F.nullif(F.col(f"n{i}"), F.lit(0)), 6).alias("parse_ratio")) for i, c in enumerate(columns)]
    return one.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def temporal_constraints(df: DataFrame, columns: list[str] | None = None, at_least: float = 0.6) -> list[dict]:
    """date_order constraints between starts and ends of one group, age_at_least between births and both; 15 years for employment, 120 at most."""
    columns = columns or df.columns
    dates = {r["column_name"] for r in date_columns(df, columns).where(F.col("parse_ratio") >= at_least).collect()}  # a row a column
    roles: dict[str, tuple[str, str]] = {}
    for c in columns:
        if c not in dates and not re.search(DATE_NAME, c, re.I):
            continue
        if re.search(BIRTH, c, re.I):
            roles[c] = ("birth", "person")
            continue
        for role, patterns in (("start", STARTS), ("end", ENDS)):
            group = next((g for g, p in patterns.items() if re.search(p, c, re.I)), None)
            if group:
                roles[c] = (role, group)
                break
    of = lambda role: [c for c, (r, _) in roles.items() if r == role]
    out = []
    for s in of("start"):
        ends = [e for e in of("end") if roles[e][1] == roles[s][1]]
        if not ends and len(of("start")) == len(of("end")) == 1:
            ends = of("end")
        out += [{"type": "date_order", "before": s, "after": e} for e in ends]
    for b in of("birth"):
        out += [{"type": "age_at_least", "birth": b, "reference": r, "min_years": 15 if roles[r][1] == "employment" else 0, "max_years": 120} for r in [*of("start"), *of("end")]]
    return out


def column_plan(df: DataFrame, overrides: dict[str, str] | None = None) -> ColumnPlan:
    """A plan from what columns hold: personal data is masked, columns of distinct text ignored, the rest categorical or numerical. overrides: column to categorical, numerical, ignored or a personal-data action."""
    kinds = {r["column_name"]: r["kind"] for r in profile.infer_kinds(df).collect()}
    personal = {r["column_name"]: r["kind"] for r in personal_data.scan(df).where("kind IS NOT NULL").collect()}
    parts = {r["column_name"]: r["part"] for r in profile.quasi_identifier_classes(df).collect()}
    use = {}
    for c in df.columns:
        if c in personal:
            use[c] = "mask"
        elif kinds.get(c) == "numerical":
            use[c] = "numerical"
        else:
            use[c] = "ignored" if parts.get(c) == "identifier" else "categorical"
    use |= overrides or {}
    pick = lambda k: tuple(c for c in df.columns if use[c] == k)
    return ColumnPlan(pick("categorical"), pick("numerical"), pick("ignored"), {c: u for c, u in use.items() if u in ("drop", "mask", "hash", "token")})


def match_profile(columns: list[str], profiles: dict[str, list[str]], hint: str = "") -> str | None:
    """The declared profile meant by a name, else the one with most columns found in the table, two at least."""
    plain = lambda s: "".join(ch for ch in s.casefold() if ch.isalnum())
    if hint:
        scored = [(3 if plain(p) == plain(hint) else 2 if plain(p) in plain(hint) else 1 if plain(hint) in plain(p) else 0, len(plain(p)), p) for p in profiles]
        best = max(scored, default=(0, 0, None))
        if best[0]:
            return best[2]
    counts = {p: sum(resolve_column(columns, c) is not None for c in cols) for p, cols in profiles.items()}
    best = max(counts, key=lambda p: counts[p], default=None)
    return best if best is not None and counts[best] >= 2 else None


def match_preset(columns: list[str], presets: dict[str, list[str]]) -> str | None:
    """The preset with most columns of those whose columns are all there."""
    fits = [p for p, cols in presets.items() if set(cols) <= set(columns)]
    return max(fits, key=lambda p: len(presets[p]), default=None)


#: A small dictionary of domains: names that columns of a kind have, and how to make up values.
DOMAINS: dict[str, tuple[tuple[str, ...], dict]] = {
    "person_name": (("name", "username", "customername", "이름", "성명"), {"type": "fake", "kind": "name"}),
    "phone": (("phone", "mobile", "tel", "전화", "연락처"), {"type": "fake", "kind": "phone"}),
    "email": (("email", "mail", "이메일"), {"type": "fake", "kind": "email"}),
    "address": (("address", "addr", "주소"), {"type": "fake", "kind": "address"}),
    "amount": (("price", "amount", "cost", "금액", "가격", "비용"), {"type": "number_range", "min": 1000, "max": 1000000, "integer": True}),
    "quantity": (("count", "qty", "quantity", "수량", "건수", "개수"), {"type": "number_range", "min": 1, "max": 100, "integer": True}),
    "date": (("date", "time", "일자", "일시", "날짜"), {"type": "date_between", "start": "2020-01-01", "end": "2025-12-31"}),
    "age": (("age", "나이", "연령"), {"type": "number_range", "min": 0, "max": 100, "integer": True}),
    "gender": (("gender", "sex", "성별"), {"type": "choice", "values": ["M", "F"]}),
    "identifier": (("id", "no", "code", "번호", "코드"), {"type": "sequence", "prefix": "ID", "start": 1}),
}


def infer_domain(column: str) -> tuple[str, dict]:
    """The domain whose name a column has, or the longest one inside its name; else plain text."""
    plain = re.sub(r"[\s_\-.()]+", "", column.casefold())
    for name, (aliases, rule) in DOMAINS.items():
        if plain in aliases:
            return name, rule
    found = max(((len(a), n) for n, (aliases, _) in DOMAINS.items() for a in aliases if a in plain), default=None)
    return (found[1], DOMAINS[found[1]][1]) if found else ("text", {"type": "pattern", "format": "????????"})


def search_terms(df: DataFrame, text: str | None = None, in_columns: tuple[str, ...] = ("name", "description"), category: str | None = None, initial: str | None = None) -> DataFrame:
    """Terms whose name or description has a text, of a category, with an initial (A-Z, 0-9 or a letter of its own column)."""
    out = df
    if text and text.strip():
        want = text.strip().lower()
        hit = F.lit(False)
        for c in in_columns:
            hit = hit | F.coalesce(F.contains(F.lower(c), F.lit(want)), F.lit(False))
        out = out.where(hit)
    if category:
        out = out.where(F.col("category") == category)
    if initial == "A-Z":
        out = out.where(F.upper(F.trim("name")).rlike("^[A-Z]"))
    elif initial == "0-9":
        out = out.where(F.trim("name").rlike("^[0-9]"))
    elif initial:
        out = out.where(F.col("initial") == initial)
    return out


def value_samples(df: DataFrame, columns: list[str], limit: int = 200) -> DataFrame:
    """(column_name, nulls, distinct_values, samples): the smallest distinct values as text, a bounded list a column."""
    from pyspark.sql import Window

    values = profile._values(df, columns)
    place = F.row_number().over(Window.partitionBy("column_name").orderBy(F.asc_nulls_last("value")))
    few = values.where("value IS NOT NULL").withColumn("p", place).where(F.col("p") <= limit).groupBy("column_name").agg(F.array_sort(F.collect_list("value")).alias("samples"))
    counts = values.groupBy("column_name").agg(F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("nulls"), F.count("value").alias("distinct_values"))
    return counts.join(few, "column_name", "left")
