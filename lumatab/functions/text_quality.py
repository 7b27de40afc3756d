"""Measures of text: error rates against a truth, ratios of characters, cleaning."""

from __future__ import annotations

import difflib
import unicodedata
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def character_error_rate(truth: Column, read: Column) -> Column:
    """Edit distance over the truth's length; against an empty truth 0 for nothing read, else 1."""
    return F.when(truth == "", (read != "").cast("double")).otherwise(F.levenshtein(truth, read) / F.length(truth))


def _word_errors(a: str, b: str) -> float:
    x, y = a.split(), b.split()
    if not x:
        return float(bool(y))
    row = list(range(len(y) + 1))
    for i, w in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, v in enumerate(y, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (w != v))
    return row[-1] / len(x)


@F.pandas_udf(T.DoubleType())
def word_error_rate(truth: pd.Series, read: pd.Series) -> pd.Series:
    """Edit distance of word lists over the truth's number of words; no built-in compares lists."""
    return pd.Series([None if a is None or b is None else _word_errors(a, b) for a, b in zip(truth, read)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of characters in matching runs, longest run first; unlike edit distance."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in zip(a, b)], dtype="float64")


def share(text: Column, pattern: str, empty: float = 0.0) -> Column:
    """Characters that match a class, over all."""
    n = F.length(text)
    return F.when(n == 0, F.lit(empty)).otherwise(F.regexp_count(text, F.lit(pattern)) / n)


HANGUL, UNKNOWN, INVALID = "[가-힣]", "[�□]", "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]"


def repeated(text: Column) -> Column:
    """Characters that continue a run of the same one, from the third on, over all."""
    n = F.length(text)
    runs = F.regexp_extract_all(text, F.lit(r"(?s)((.)\2{2,})"), F.lit(1))
    beyond = F.aggregate(runs, F.lit(0), lambda a, r: a + F.length(r) - 2)
    return F.when(n == 0, F.lit(0.0)).otherwise(beyond / n)


# Punctuation that is no noise.
PUNCTUATION = ".,:;!?()[]/%+-_'\"·ㆍ※℃℉°㎎㎏㎖㎗㎘㎜㎝㎞㎡㎥μµ≤≥≠±×÷。、「」！？（）【】《》①②③④⑤⑥⑦⑧⑨⑩○●◎□■☑✓"


def special_ratio(text: Column) -> Column:
    """Characters other than letters, digits, underscores and known punctuation, over all that are no white space."""
    known = "".join("\\" + c if c in "[]\\^-/" else c for c in PUNCTUATION)
    solid = F.regexp_replace(text, r"(?U)\s", "")
    n = F.length(solid)
    return F.when(n == 0, F.lit(0.0)).otherwise(F.regexp_count(solid, F.lit(rf"[^\p{{L}}\p{{N}}_{known}]")) / n)


def is_noise(text: Column) -> Column:
    """Blank, or eight characters and more with no letter or digit, or with nothing but rules and dots."""
    t = F.trim(text)
    long = F.length(t) >= 8
    return (t == "") | (long & ~t.rlike("[가-힣A-Za-z0-9]")) | (long & (F.length(F.regexp_replace(t, r"[.\-_=~·ㆍ…\s]", "")) <= 1))


# Words and endings of Korean administrative prose.
TERMS = (
    "가공", "가능", "개선", "경제", "계획", "공유", "국민", "기관", "다양", "대응", "대책", "데이터", "문제", "문화", "발굴", "배경", "범위", "분석", "분야", "비교", "사회", "서비스",
    "수립", "수요", "안전", "예상", "예측", "요소", "원인", "위험", "이용", "절차", "정책", "제공", "제거", "제시", "질병", "충분", "충족", "필요", "행정", "혁신", "활용", "효율",
)
ENDINGS = ("하기", "하고", "하며", "하여", "하는", "되는", "있는", "등이", "등을", "등에", "등의", "위한", "위하여", "대한", "통해", "또는", "거나", "가", "을", "를", "은", "는", "에", "의")

# Where the prose score starts, what each measure adds to it or takes from it (sign, weight, at most), and the score of text without Hangul.
PROSE_START, PROSE_LATIN = 0.18, 0.35
PROSE = (("hangul", 1, 0.26, 0.26), ("terms", 1, 0.055, 0.32), ("endings", 1, 0.025, 0.18), ("lone", -1, 0.16, 0.16), ("special", -1, 0.5, 0.2), ("bare", -1, 0.16, 0.16))
# Share of odd characters and prose score that call for a second look, confidences that settle it, and how few syllables are short.
LOOK = {"special": 0.18, "latin": 0.55, "sure": 0.85, "few": 6, "prose": 0.52}


def prose_quality(text: Column) -> Column:
    """0 to 1: how much a text looks like Korean prose, by its share of Hangul, known words, endings, lone syllables, noise and long words without an ending."""
    t = F.trim(text)
    solid = F.length(F.regexp_replace(t, r"(?U)\s", ""))
    hangul = F.regexp_count(t, F.lit(HANGUL))
    tokens = F.regexp_extract_all(t, F.lit("([가-힣A-Za-z0-9]+)"))
    found = lambda words: sum((F.contains(t, F.lit(w)).cast("int") for w in words), F.lit(0))
    lone = F.size(F.filter(tokens, lambda w: w.rlike("^[가-힣]$"))) / F.greatest(F.size(tokens), F.lit(1))
    long = F.filter(tokens, lambda w: w.rlike("^[가-힣]{5,}$"))
    bare = F.size(F.filter(long, lambda w: ~w.rlike("|".join(ENDINGS)))) / F.greatest(F.size(long), F.lit(1))
    parts = {"hangul": hangul / F.greatest(solid, F.lit(1)), "terms": found(TERMS), "endings": found(ENDINGS), "lone": lone, "special": special_ratio(t), "bare": bare}
    score = sum((F.lit(sign) * F.least(F.lit(weight) * parts[name], F.lit(most)) for name, sign, weight, most in PROSE), F.lit(PROSE_START))
    plain = F.when(t.rlike("[A-Za-z0-9]"), F.lit(PROSE_LATIN)).otherwise(F.lit(0.0))
    return F.when(solid == 0, F.lit(0.0)).when(hangul == 0, plain).otherwise(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)))


def needs_second_look(text: Column, confidence: Column) -> Column:
    t, c = F.trim(text), F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence))
    hangul = F.regexp_count(t, F.lit(HANGUL))
    return (
        F.when((t == "") | F.contains(t, F.lit("�")) | (special_ratio(t) >= LOOK["special"]), F.lit(True)).when(hangul == 0, c < LOOK["latin"])
        .when((c >= LOOK["sure"]) & (hangul < LOOK["few"]), F.lit(False)).otherwise(prose_quality(t) < LOOK["prose"])
    )


@F.pandas_udf(T.StringType())
def composed(text: pd.Series) -> pd.Series:
    """Canonical composition (NFC); no built-in composes characters."""
    return text.map(lambda t: None if t is None else t if t.isascii() else unicodedata.normalize("NFC", t))


def normalised(text: Column, keep_spaces: bool = True) -> Column:
    """Composed characters, line ends as LF, no control characters; with keep_spaces off, runs of blanks are one and blank lines at most one."""
    out = F.regexp_replace(F.regexp_replace(composed(text), "\r\n?", "\n"), INVALID, "")
    if not keep_spaces:
        out = F.regexp_replace(F.regexp_replace(out, "[ \t]+", " "), "\n{3,}", "\n\n")
    return out


def digits_repaired(token: Column) -> Column:
    """In what looks like a date or an amount, letters that are misread digits become digits and separators lose their blanks."""
    amount = token.rlike(r"원|KRW|₩|￦") | token.rlike(r"\d[\dOolI|SsbB]*(?:,\d{3})+")
    day = (F.regexp_count(token, F.lit("[./-]")) >= 2) & token.rlike(r"\d")
    fixed = F.translate(token, "OoDIl|SsB", "000111558")
    return F.when(day, F.regexp_replace(fixed, r"\s*([./-])\s*", "$1")).when(amount, fixed).otherwise(token)


def redacted(text: Column) -> Column:
    """Secrets in query strings replaced."""
    return F.regexp_replace(text, r"(?i)([?&](?:serviceKey|apiKey|token|signature)=)[^&\s]+", "$1[REDACTED]")


@F.pandas_udf(T.DoubleType())
def coverage(source: pd.Series, kept: pd.Series) -> pd.Series:
    """Share of the source's characters, white space aside, that the other text has too, each as often as both have it. Characters are counted once a side."""

    def one(a: str | None, b: str | None) -> float | None:
        if a is None or b is None:
            return None
        x, y = Counter("".join(a.split())), Counter(b)
        return sum(min(n, y[c]) for c, n in x.items()) / x.total() if x else 1.0

    return pd.Series([one(a, b) for a, b in zip(source, kept)], dtype="float64")
