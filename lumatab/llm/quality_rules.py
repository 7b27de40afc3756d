"""Line-first cleaning (operator 1).

Punctuation, navigation and boilerplate rules judge each line; failing lines go, and a document that
lost too much of its text goes with them. Work is one pass over the rows: no shuffle, no state.

Defined cases: a null text has no words and is rejected; an empty text likewise; repeated rows and tied
ids are judged one by one; an empty table gives an empty table; a column of the input that has the name
of an output column never clashes, since only the id and the text are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Lines with one of these (lower-cased) and at most `boiler_words` words are boilerplate.
BOILERPLATE = (
    "all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service",
    "licensed under", "click here", "subscribe to our", "sign up for", "enable javascript",
    "share this article", "read more", "accept cookies",
)


@dataclass(frozen=True)
class LineRules:
    """Limits of the rules. Percentages are of a line's words, but for max_lost, of a text's word characters."""

    separators_per_100: int = 25
    min_separators: int = 3
    symbols_per_100: int = 50
    shouts_per_100: int = 33
    unpunctuated_words: int = 40
    boiler_words: int = 25
    max_lost: int = 50
    min_words: int = 50
    max_repeated: int = 50
    boilerplate: tuple[str, ...] = field(default=BOILERPLATE)


_MARKS = re.compile("[.,;:!?…。，！？]")
_SEPARATORS = re.compile("[|»›•·]")


def line_fails(line: str, rules: LineRules = LineRules()) -> str | None:
    """The rule that removes a line with words (punctuation, navigation, boilerplate), or None."""
    n = len(line.encode().split())
    separators = len(_SEPARATORS.findall(line)) if not line.isascii() or "|" in line else 0
    if separators >= rules.min_separators and 100 * separators >= rules.separators_per_100 * n:
        return "navigation"
    if 100 * sum(map(line.count, SYMBOLS)) >= rules.symbols_per_100 * n:
        return "punctuation"
    if 100 * line.count("!!") >= rules.shouts_per_100 * n:
        return "punctuation"
    if n >= rules.unpunctuated_words and not _MARKS.search(line):
        return "punctuation"
    if n <= rules.boiler_words:
        low = line.lower()
        if any(x in low for x in rules.boilerplate):
            return "boilerplate"
    return None


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more."""
    n = len(words)
    ids = dict.fromkeys(words)
    v = len(ids)
    if n < 4 or v == n:
        return 0
    for i, w in enumerate(ids):
        ids[w] = i
    a = np.fromiter(map(ids.__getitem__, words), np.int64, n)
    if v < 1 << 20:
        key = (a[:-2] * v + a[1:-1]) * v + a[2:]
    else:  # the product could pass 64 bits
        key = np.unique(a[:-2] * v + a[1:-1], return_inverse=True)[1] * v + a[2:]
    order = np.argsort(key, kind="stable")
    same = np.diff(key[order]) == 0
    twice = np.zeros(n - 2, bool)
    twice[order[:-1][same]] = True
    twice[order[1:][same]] = True
    inside = np.zeros(n, bool)
    inside[:-2] |= twice
    inside[1:-1] |= twice
    inside[2:] |= twice
    return int(inside.sum())


def judge(text: str | None, rules: LineRules = LineRules()) -> tuple[int, int, int, int, int, bool, bool, int, str]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lost_chars, cleaned text."""
    text = text or ""
    words = text.encode().split()  # of bytes: splits at exactly the six ASCII spaces
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACES))
    seen: set[str] = set()
    filled, lost, stay = 0, 0, []
    for line in text.split("\n"):
        if not line.strip(SPACES):
            stay.append(line)
            continue
        filled += 1
        seen.add(line)
        if line_fails(line, rules):
            lost += len(line) - sum(map(line.count, SPACES))
        else:
            stay.append(line)
    repeats = repeated_words(words)
    base_failed = n < rules.min_words or 100 * repeats > rules.max_repeated * n
    kept = not base_failed and 100 * lost <= rules.max_lost * chars
    return n, chars, sum(map(text.count, SYMBOLS)), filled - len(seen), repeats, base_failed, kept, lost, "\n".join(stay)


def line_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: LineRules = LineRules(), with_text: bool = False) -> DataFrame:
    """Per row: its id, the counts, base_failed, kept, lost_chars, and with with_text the cleaned text (null for a null text)."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars"]
    kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            rows = [judge(t, rules) for t in texts]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 9
            out = [b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=False))]
            if with_text:
                out.append(pa.array([c if t is not None else None for c, t in zip(cols[8], texts, strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays(out, [id_col, *names, *(["cleaned"] * with_text)])

    schema = f"`{id_col}` {kind}, " + ", ".join(f"{x} {'bigint' if k == pa.int64() else 'boolean'}" for x, k in zip(names, kinds, strict=True)) + ", cleaned string" * with_text
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)


def cleaned_documents(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars", rules: LineRules = LineRules()) -> DataFrame:
    """The documents that pass, without their failing lines; chars_col, where it exists, gets the new length in code points."""
    at = docs.columns.index(text_col)
    counted = docs.columns.index(chars_col) if chars_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(i, row[8]) for i, t in enumerate(b.column(at).to_pylist()) if (row := judge(t, rules))[6]]
            out = b.take(pa.array([i for i, _ in found], pa.int64()))
            cols = list(out.columns)
            cols[at] = pa.array([t for _, t in found], b.schema.field(at).type)
            if counted is not None:
                cols[counted] = pa.array([len(t) for _, t in found], b.schema.field(counted).type)
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return docs.mapInArrow(run, docs.schema)


_LINE_SQL = " OR ".join(f"contains(lower(line), '{x}')" for x in BOILERPLATE)
#: The same in DuckDB SQL, with the limits of LineRules().
SQL = f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM t),
pos AS (SELECT rid, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM w WHERE len(ws) >= 3),
tri AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, ws[i], ws[i + 1], ws[i + 2]) AS c FROM pos),
cover AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM tri WHERE c > 1) GROUP BY rid),
raw AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM t),
lines AS (SELECT rid, line, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS n,
    length(regexp_replace(line, '[\\x20\\x09-\\x0D]', '', 'g')) AS chars,
    len(regexp_extract_all(line, '[|»›•·]')) AS seps, len(regexp_extract_all(line, '[#*$%&|<>]')) AS syms,
    (length(line) - length(replace(line, '!!', ''))) // 2 AS shouts FROM raw WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
judged AS (SELECT rid, line, chars, (seps >= 3 AND 100 * seps >= 25 * n) OR 100 * syms >= 50 * n OR 100 * shouts >= 33 * n
    OR (n >= 40 AND NOT regexp_matches(line, '[.,;:!?…。，！？]')) OR (n <= 25 AND ({_LINE_SQL})) AS fails FROM lines),
by_doc AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines, sum(CASE WHEN fails THEN chars ELSE 0 END) AS lost FROM judged GROUP BY rid),
base AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0)::BIGINT AS lost_chars
    FROM t JOIN w USING (rid) LEFT JOIN cover USING (rid) LEFT JOIN by_doc USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * lost_chars <= 50 * word_chars AS kept, lost_chars
FROM base
"""
