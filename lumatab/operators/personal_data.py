"""Finding and treating personal data in tables."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumatab.functions import masking
from lumatab.plans.model import ColumnPlan


def scan(df: DataFrame, columns: list[str] | None = None, hits: float = 0.3) -> DataFrame:
    """(column_name, kind, source, share): the kind of personal data a column holds, by its name, else by the share of values of a shape, else by inline hits; null if none.

    All values count, in one aggregation.
    """
    columns = columns or df.columns
    values = {c: F.regexp_replace(F.col(c).cast("string"), r"\s+", "") for c in columns}
    aggs = []
    for i, c in enumerate(columns):
        for j, pattern in enumerate(masking.VALUE_PATTERNS.values()):
            aggs.append(F.avg(values[c].rlike(pattern).cast("double")).alias(f"v{i}_{j}"))
        text = F.col(c).cast("string")
        aggs.append(F.count_if(text.rlike(masking.ANY_INLINE)).alias(f"h{i}"))
    one = df.agg(*aggs)
    rows = []
    for i, c in enumerate(columns):
        named = next((k for k, p in masking.NAME_PATTERNS.items() if re.search(p, c, re.I)), None)
        ranked = F.array_max(F.array(*(F.struct(F.coalesce(f"v{i}_{j}", F.lit(0.0)).alias("share"), F.lit(-j).alias("order"), F.lit(k).alias("kind")) for j, k in enumerate(masking.VALUE_PATTERNS))))
        found = F.when(ranked["share"] >= hits, ranked["kind"]).when(F.col(f"h{i}") > 0, F.lit("inline"))
        kind, source = (F.lit(named), F.lit("name")) if named else (found, F.when(ranked["share"] >= hits, "value").when(F.col(f"h{i}") > 0, "inline"))
        rows.append(F.struct(F.lit(c).alias("column_name"), kind.alias("kind"), source.alias("source"), F.round(ranked["share"], 6).alias("share")))
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def inline_counts(df: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    """(kind, hits, rows_with_hits) of patterns in running text; one pass."""
    one = df.agg(*(x for i, p in enumerate(patterns.values()) for x in (F.coalesce(F.sum(F.regexp_count(text, F.lit(p))), F.lit(0)).alias(f"n{i}"), F.count_if(F.col(text).rlike(p)).alias(f"r{i}"))))
    cells = [F.struct(F.lit(k).alias("kind"), F.col(f"n{i}").cast("bigint").alias("hits"), F.col(f"r{i}").alias("rows_with_hits")) for i, k in enumerate(patterns)]
    return one.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def apply_plan(df: DataFrame, plan: ColumnPlan, kinds: dict[str, str] | None = None, secret: bytes = b"", project: str = "default") -> DataFrame:
    """df with each planned column dropped, masked, hashed or replaced by a token."""
    out, gone = {}, []
    for c, action in plan.pii.items():
        if c not in df.columns:
            continue
        if action == "drop":
            gone.append(c)
        elif action == "mask":
            out[c] = masking.mask(F.col(c), (kinds or {}).get(c))
        elif action == "hash":
            out[c] = masking.pseudonym(F.col(c))
        elif action == "token":
            out[c] = masking.token(F.col(c), secret, project, c)
        else:
            raise ValueError(f"unknown action {action} for {c}")
    return df.withColumns(out).drop(*gone) if out else df.drop(*gone)


def replacements(df: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    """(kind, found, replacement, n): distinct strings that patterns find, with their masks and how often they stand in the text."""
    parts = [df.select(F.lit(k).alias("kind"), F.explode(F.regexp_extract_all(text, F.lit(f"({p})"))).alias("found")) for k, p in patterns.items()]
    return reduce(DataFrame.unionByName, parts).groupBy("kind", "found").agg(F.count("*").alias("n")).select("kind", "found", masking.inline(F.col("found")).alias("replacement"), "n")


# Words before and after a person's name, and endings of organisations.
NAME_PREFIXES = ("성명", "이름", "담당자", "환자명", "환자", "수검자", "피험자", "작성자", "확인자", "승인자", "수취인", "예금주", "의뢰인", "대표자", "연구책임자", "보호자", "검토자")
NAME_SUFFIXES = ("씨", "님", "연구원", "연구책임자", "박사", "교수", "원장", "부장", "과장", "팀장", "대리", "사원", "주임", "의사", "약사", "간호사", "주무관", "사무관", "서기관", "심사관", "조사관", "위원", "대표", "귀하", "선생님", "대표이사")
ORGANIZATION_ENDINGS = (
    "은행", "뱅크", "카드", "증권", "보험", "생명", "화재", "캐피탈", "금고", "저축은행", "신협", "농협", "수협", "회사", "주식회사", "기업", "그룹", "법인", "병원", "의원", "약국", "보건소", "클리닉", "센터", "처", "청", "재단", "연구소", "연구원", "공사", "공단", "본부", "지사", "지점", "대학교", "학교", "협회", "학회",
)


def _finder(ignored: tuple[str, ...] = ()):
    """A function from a text to its (kind, entity, start, stop), in order."""
    long_first = lambda words: "|".join(sorted(map(re.escape, words), key=len, reverse=True))
    edge, gap = r"(?<![가-힣\w])", r"[^\S\r\n]*"
    labelled = re.compile(rf"{edge}(?:{long_first(NAME_PREFIXES)}){gap}[:：]{gap}(?P<name>[가-힣]{{2,4}})(?![가-힣])")
    titled = re.compile(rf"{edge}(?P<name>[가-힣]{{2,4}}?){gap}(?:{long_first(NAME_SUFFIXES)})(?=$|[^가-힣\w]|(?:은|는|이|가|께|의|에게|을|를)(?=$|\s))")
    organisation = re.compile(rf"{edge}[가-힣A-Za-z0-9·&]+?(?:{long_first(ORGANIZATION_ENDINGS)})(?=$|[^가-힣\w]|(?:은|는|이|가|의|에서|으로|와|과)(?=$|\s))")
    place = re.compile(rf"{edge}[가-힣]{{2,}}(?:특별시|광역시|특별자치시|특별자치도)(?![가-힣])")
    skip = {w.casefold() for w in ignored}

    def found(t: str | None) -> list[tuple[str, str, int, int]]:
        if not t:
            return []
        orgs = [(m.start(), m.end(), m.group()) for m in organisation.finditer(t)]
        out = [("ORGANIZATION", w, a, b) for a, b, w in orgs] + [("LOCATION", m.group(), m.start(), m.end()) for m in place.finditer(t)]
        names = {m.span("name"): m["name"] for p in (titled, labelled) for m in p.finditer(t)}
        out += [("PERSON_NAME", w, a, b) for (a, b), w in names.items() if not w.endswith(ORGANIZATION_ENDINGS) and not any(a < y and b > x for x, y, _ in orgs)]
        return sorted((e for e in out if e[1].casefold() not in skip), key=lambda e: e[2:])

    return found


def entities(df: DataFrame, id_col: str, text: str, ignored: tuple[str, ...] = ()) -> DataFrame:
    """(id, kind, entity, start, stop) of persons, organisations and places in Korean text, in character offsets.

    A name counts only with a label before it or a title after it, never inside an organisation. Offsets need
    look-around and overlap tests inside one text, so this is one Arrow pass over the rows.
    """
    import pyarrow as pa

    found = _finder(ignored)

    def run(batches):
        for b in batches:
            rows = [(k, *e) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for e in found(t)]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [b.schema.field(0).type, pa.string(), pa.string(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["id", "kind", "entity", "start", "stop"])

    return df.select(F.col(id_col).alias("id"), F.col(text)).mapInArrow(run, f"id {df.schema[id_col].dataType.simpleString()}, kind string, entity string, start int, stop int")


def _hangul_name(name: str) -> str:
    """As masking.name masks a name of syllables."""
    shown = 2 if len(name) > 2 and name.startswith(masking.COMPOUND_SURNAMES) else 1
    if len(name) == 2:
        return name if name.startswith(masking.COMPOUND_SURNAMES) else name[0] + "*"
    hidden = max(1, len(name) - shown - 1)
    return name[:shown] + "*" * hidden + name[shown + hidden :]


@F.pandas_udf(T.StringType())
def names_masked(text: pd.Series) -> pd.Series:
    """Persons' names masked where they stand in their context, and nowhere else: `masking.inline(text, names_masked)` masks all of a text."""
    found = _finder()

    def masked(t: str | None) -> str | None:
        for kind, name, a, b in reversed(found(t)):
            if kind == "PERSON_NAME":
                t = t[:a] + _hangul_name(name) + t[b:]
        return t

    return text.map(masked)
