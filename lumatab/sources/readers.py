"""Tables from files by their ending, and schemas from their definitions."""

from __future__ import annotations

import io
import itertools
import json
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Encodings tried, in order, and keys under which a JSON document may hold its records.
ENCODINGS = ("utf-8", "cp949", "euc-kr")
CONTAINERS = ("data", "records", "items", "rows", "values")
#: Spark's names of the encodings, and Python's for text that may open with a mark.
_SPARK_NAMES = {"utf-8": "UTF-8", "cp949": "x-windows-949", "euc-kr": "EUC-KR"}
MARKS = (",", "\t", ";", "|")


def _ending(path: str) -> str:
    return path.rstrip("/").rsplit(".", 1)[-1].lower()


def text_form(spark: SparkSession, path: str) -> tuple[str, str]:
    """(encoding, delimiter) of a delimited text, from all of its bytes.

    The encoding is the first that reads every line. The delimiter is the mark that stands equally often, and most often,
    on all lines, what stands in quotes aside; else the one with the highest least number. Lines are checked where
    they lie; one row a batch comes together.
    """
    names = [*(f"bad_{i}" for i in range(len(ENCODINGS))), *(f"{k}_{i}" for k in ("low", "high") for i in range(len(MARKS)))]

    def run(batches):
        quoted = re.compile(rb'"[^"]*"')
        for b in batches:
            bad, low, high = [False] * len(ENCODINGS), [1 << 30] * len(MARKS), [0] * len(MARKS)
            for line in b.column(0).to_pylist():
                if not line.isascii():
                    for i, e in enumerate(ENCODINGS):
                        if not bad[i]:
                            try:
                                line.decode(e)
                            except UnicodeDecodeError:
                                bad[i] = True
                if line.strip():
                    line = quoted.sub(b"", line) if b'"' in line else line
                    for i, mark in enumerate(MARKS):
                        n = line.count(mark.encode())
                        low[i], high[i] = min(low[i], n), max(high[i], n)
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*bad, *low, *high)], names)

    lines = spark.read.text(path).select(F.col("value").cast("binary").alias("line")).where("line IS NOT NULL")
    kinds = ", ".join(f"{n} {'boolean' if n.startswith('bad') else 'bigint'}" for n in names)
    one = lines.mapInArrow(run, kinds).agg(*((F.min if n.startswith("low") else F.max)(n).alias(n) for n in names)).first()
    good = [e for i, e in enumerate(ENCODINGS) if not one[f"bad_{i}"]]
    if not good:
        raise ValueError("the file's encoding is unknown")
    spread = [(one[f"low_{i}"] or 0, one[f"high_{i}"] or 0, -i) for i in range(len(MARKS))] if one["low_0"] is not None else []
    even = [(low, i) for low, high, i in spread if low == high and 0 < low < 1 << 30]
    some = [(low, i) for low, high, i in spread if 0 < low < 1 << 30]
    any_line = [(high, i) for _, high, i in spread if high]  # records that go over several lines
    best = max(even or some or any_line, default=(0, 0))
    return good[0], MARKS[-best[1]]


def checked_names(names: list[str]) -> list[str]:
    """Column names that are neither blank nor equal, whatever their case."""
    if any(not n or not n.strip() for n in names):
        raise ValueError("a column has no name")
    if len({n.strip().casefold() for n in names}) != len(names):
        raise ValueError("two columns have the same name")
    return names


def read_delimited(spark: SparkSession, path: str, delimiter: str | None = None, strict: bool = False) -> DataFrame:
    """A CSV, TSV or TXT table, all columns text or, if not strict, of inferred kind; strict refuses ragged rows and bad headers. Encoding and delimiter are chosen by all bytes."""
    code, found = text_form(spark, path)
    mark = delimiter or ("\t" if _ending(path) == "tsv" else found)
    if code != "utf-8":
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")  # Korean encodings are not on Spark's short list; stays on, since reading is lazy
    reader = spark.read.option("header", True).option("sep", mark).option("encoding", _SPARK_NAMES[code]).option("multiLine", True).option("escape", '"')
    if strict:
        head = spark.read.option("sep", mark).option("encoding", _SPARK_NAMES[code]).option("multiLine", True).option("escape", '"').csv(path).first()  # as it stands: a reader of headers tells equal names apart
        names = checked_names([(c or "").lstrip("\ufeff") for c in head or ()])
        return reader.option("mode", "FAILFAST").option("enforceSchema", False).schema(", ".join(f"`{n}` string" for n in names)).csv(path)
    df = reader.option("inferSchema", True).csv(path)
    return df.withColumnRenamed(df.columns[0], df.columns[0].lstrip("\ufeff")) if df.columns else df


def _xlsx_rows(content: bytes) -> Iterator[list[str | None]]:
    """The cells of a workbook's first sheet, row by row, as text: shared and inline strings, numbers, booleans, and dates by their number formats."""
    book = zipfile.ZipFile(io.BytesIO(content))
    tag = lambda e: e.tag.rsplit("}", 1)[-1]
    words = lambda e: "".join(t.text or "" for t in e.iter() if tag(t) == "t")
    tree = lambda name: ET.fromstring(book.read(name))
    shared = [words(e) for e in tree("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in book.namelist() else []
    dates: list[bool] = []
    if "xl/styles.xml" in book.namelist():
        styles = tree("xl/styles.xml")
        own = {e.get("numFmtId"): e.get("formatCode", "") for e in styles.iter() if tag(e) == "numFmt"}
        is_date = lambda i: 14 <= int(i) <= 22 or bool(re.search("[yd]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", own.get(i, "")), re.I))
        dates = [is_date(x.get("numFmtId", "0")) for e in styles if tag(e) == "cellXfs" for x in e]
    first = next(e for e in tree("xl/workbook.xml").iter() if tag(e) == "sheet")
    link = next(v for k, v in first.attrib.items() if k.endswith("}id"))
    target = next(e.get("Target") for e in tree("xl/_rels/workbook.xml.rels") if e.get("Id") == link)
    with book.open(target.lstrip("/") if target.startswith("/") else f"xl/{target}") as f:
        for _, e in ET.iterparse(f):
            if tag(e) != "row":
                continue
            row: list[str | None] = []
            for c in (x for x in e if tag(x) == "c"):
                letters = re.match("[A-Z]+", c.get("r", ""))
                at = 0
                for ch in letters[0] if letters else "":
                    at = at * 26 + ord(ch) - 64
                row += [None] * ((at or len(row) + 1) - 1 - len(row))
                value = next((v.text for v in c if tag(v) == "v"), None)
                kind, style = c.get("t", "n"), int(c.get("s", "0"))
                if kind == "s" and value is not None:
                    value = shared[int(value)]
                elif kind == "inlineStr":
                    value = words(c)
                elif kind == "b":
                    value = "true" if value == "1" else "false"
                elif kind == "n" and value is not None and style < len(dates) and dates[style]:
                    day = datetime(1899, 12, 30) + timedelta(days=float(value))
                    value = day.strftime("%Y-%m-%d" if float(value).is_integer() else "%Y-%m-%d %H:%M:%S")
                elif kind == "n" and value is not None and value.endswith(".0"):
                    value = value[:-2]
                row.append(value)
            yield row
            e.clear()


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet of a workbook (or of all workbooks of a folder, with one header) as text columns under its first row. A workbook is one value, read in one task."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    head = files.orderBy("path").limit(1).select("content").mapInArrow(lambda bs: (pa.RecordBatch.from_arrays([pa.array([[c or "" for c in next(_xlsx_rows(x), [])] for x in b.column(0).to_pylist()], pa.list_(pa.string()))], ["names"]) for b in bs), "names array<string>")
    found = head.first()  # one row
    names = checked_names([c.strip() for c in found["names"]]) if found and found["names"] else []
    if not names:
        return spark.createDataFrame([], "value string").drop("value")

    def run(batches):
        for b in batches:
            for content in b.column(0).to_pylist():
                rows = _xlsx_rows(content)
                if [(c or "").strip() for c in next(rows, [])] != names:
                    raise ValueError("the workbooks have different headers")
                while part := list(itertools.islice(rows, 10_000)):
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] if i < len(r) else None for r in part if any(c is not None for c in r)], pa.string()) for i in range(len(names))], names)

    return files.select("content").mapInArrow(run, ", ".join(f"`{n}` string" for n in names))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines, an array of records, or an object with its records under a known key or in a response envelope.

    A .json file or folder is one of lines if it has several and each is an object by itself.
    """
    line = F.trim("value")
    if _ending(path) in ("jsonl", "ndjson"):
        return spark.read.json(path)
    lines = spark.read.text(path).where(line != "").agg(F.count("*").alias("n"), F.count_if(~(line.startswith("{") & line.endswith("}"))).alias("other")).first()
    if lines["n"] > 1 and not lines["other"]:
        return spark.read.json(path)
    df = spark.read.option("multiLine", True).json(path)
    kind = dict(df.dtypes)
    if kind.get("response", "").startswith("struct") and "items" in kind["response"]:
        return df.select(F.inline("response.body.items"))
    for key in CONTAINERS:
        if kind.get(key, "").startswith("array<struct"):
            return df.select(F.inline(key))
    return df


def read_xml(spark: SparkSession, path: str, row_tag: str = "record") -> DataFrame:
    return spark.read.option("rowTag", row_tag).xml(path)


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, booleans as true and false."""
    put = {}
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        if kind in ("struct", "array", "map"):
            put[f.name] = F.to_json(f"`{f.name}`")
        elif kind == "boolean":
            put[f.name] = F.col(f"`{f.name}`").cast("string")
    return df.withColumns(put) if put else df


def read_paragraphs(spark: SparkSession, path: str) -> DataFrame:
    """(paragraph, text) of a text or Markdown file: blocks between blank lines, numbered within the file."""
    whole = spark.read.option("wholetext", True).text(path)
    return whole.select(F.posexplode(F.filter(F.split("value", r"\r?\n\s*\r?\n"), lambda x: F.trim(x) != "")).alias("paragraph", "text")).select((F.col("paragraph") + 1).alias("paragraph"), F.trim("text").alias("text"))


def load_table(spark: SparkSession, path: str) -> DataFrame:
    kind = _ending(path)
    if kind in ("csv", "tsv", "txt"):
        return read_delimited(spark, path)
    if kind in ("json", "jsonl", "ndjson"):
        return read_json(spark, path)
    if kind in ("parquet", "pq"):
        return spark.read.parquet(path)
    if kind == "xml":
        return read_xml(spark, path)
    if kind == "md":
        return read_paragraphs(spark, path)
    if kind == "xlsx":
        return read_xlsx(spark, path)
    raise ValueError(f"no reader for .{kind}")


_DDL_TOKEN = re.compile(r"""--[^\n]*|/\*.*?\*/|'(?:[^']|'')*'|`[^`]*`|"[^"]*"|\[[^\]]*\]|\d+(?:\.\d+)?(?![\w가-힣])|[\w가-힣]+|[^\s]""", re.S)
# Kinds of numbers in definitions.
_WHOLE, _FRACTION = ("INT", "SERIAL"), ("DECIMAL", "NUMERIC", "FLOAT", "DOUBLE", "REAL")


class _Words:
    """Words of a definition, read from the left; a name may stand in quotes."""

    def __init__(self, words: list[str]) -> None:
        self.words, self.at = words, 0

    def more(self) -> bool:
        return self.at < len(self.words)

    def take(self) -> str:
        self.at += 1
        return self.words[self.at - 1]

    def name(self) -> str:
        """A name, without the schemas before it."""
        found = self.take()
        while self.accept("."):
            found = self.take()
        return found.strip("`\"[]")

    def accept(self, *wanted: str) -> bool:
        if [w.upper() for w in self.words[self.at : self.at + len(wanted)]] != list(wanted):
            return False
        self.at += len(wanted)
        return True

    def bracket(self) -> list[str]:
        """What stands in the bracket that opens here, to its end."""
        if not self.accept("("):
            return []
        start, depth = self.at, 1
        while self.more() and depth:
            depth += {"(": 1, ")": -1}.get(self.take(), 0)
        return self.words[start : self.at - 1] if not depth else self.words[start:]

    def names(self) -> list[str]:
        return [w.strip("`\"[]") for w in self.bracket() if w != ","]


def _limits(words: list[str], by_name: dict[str, dict[str, Any]]) -> None:
    """Bounds from a check: column BETWEEN a AND b, or comparisons with numbers joined by AND."""
    for i, w in enumerate(words):
        column = by_name.get(w.strip("`\"[]"))
        rest = [x.upper() for x in words[i + 1 : i + 8]]
        number = lambda x: float(x) if re.fullmatch(r"-?\d+(\.\d+)?", x) else None
        joined = re.sub(r"([<>=]) =", r"\1=", " ".join(rest)).replace("- ", "-").split(" ")
        if column is None or len(joined) < 2:
            continue
        if joined[0] == "BETWEEN" and len(joined) >= 4 and joined[2] == "AND":
            column["min"], column["max"] = number(joined[1]), number(joined[3])
        elif joined[0] in (">=", ">") and number(joined[1]) is not None:
            column["min"] = number(joined[1])
        elif joined[0] in ("<=", "<") and number(joined[1]) is not None:
            column["max"] = number(joined[1])


def _definition(words: list[str], table: str, columns: dict[str, dict[str, Any]], links: list[dict[str, str]], checks: list[list[str]]) -> None:
    """One part of a table's body: a constraint of the table, or a column with clauses."""
    w = _Words(words)
    if w.accept("CONSTRAINT"):
        w.name()
    if w.accept("PRIMARY", "KEY"):
        for c in w.names():
            columns.get(c, {}).update(primary_key=True, nullable=False)
    elif w.accept("FOREIGN", "KEY"):
        child = w.names()
        if w.accept("REFERENCES"):
            parent = w.name()
            links += [{"parent_table": parent, "child_table": table, "parent_key": p, "child_key": c} for c, p in zip(child, w.names(), strict=False)]
    elif w.accept("CHECK"):
        checks.append(w.bracket())
    elif w.accept("UNIQUE"):
        for c in w.names():
            columns.get(c, {}).update(unique=True)
    elif not (w.accept("KEY") or w.accept("INDEX")) and len(words) > 1:
        name = w.name()
        sql = w.take().upper()
        w.bracket()
        kind = "bigint" if any(k in sql for k in _WHOLE) else "double" if any(k in sql for k in _FRACTION) else "string"
        column = columns[name] = {"name": name, "type": kind, "nullable": True, "primary_key": False, "unique": False, "min": None, "max": None}
        while w.more():
            if w.accept("NOT", "NULL"):
                column["nullable"] = False
            elif w.accept("PRIMARY", "KEY"):
                column.update(primary_key=True, nullable=False)
            elif w.accept("UNIQUE"):
                column["unique"] = True
            elif w.accept("CHECK"):
                checks.append(w.bracket())
            elif w.accept("REFERENCES"):
                parent = w.name()
                links += [{"parent_table": parent, "child_table": table, "parent_key": p, "child_key": name} for p in w.names()]
            else:
                w.take()


def _from_ddl(text: str) -> dict[str, Any]:
    words = _Words([m for m in _DDL_TOKEN.findall(text) if not m.startswith(("--", "/*"))])
    tables, links = [], []
    while words.more():
        if not words.accept("CREATE", "TABLE"):
            words.take()
            continue
        words.accept("IF", "NOT", "EXISTS")
        name = words.name()
        body, parts, depth = words.bracket(), [[]], 0
        for x in body:
            depth += {"(": 1, ")": -1}.get(x, 0)
            if x == "," and not depth:
                parts.append([])
            else:
                parts[-1].append(x)
        columns: dict[str, dict[str, Any]] = {}
        checks: list[list[str]] = []
        for part in filter(None, parts):
            _definition(part, name, columns, links, checks)
        for check in checks:
            _limits(check, columns)
        tables.append({"name": name, "columns": list(columns.values())})
    if not tables:
        raise ValueError("no CREATE TABLE statement")
    return {"tables": tables, "links": links}


def import_schema(kind: str, text: str) -> dict[str, Any]:
    """{"tables": [{"name", "columns": [{"name", "type", "nullable", "primary_key", "unique", "min", "max"}]}], "links": [...]} from DDL, JSON Schema or OpenAPI."""
    if kind == "ddl":
        return _from_ddl(text)
    if kind not in ("json-schema", "openapi"):
        raise ValueError("kind is ddl, json-schema or openapi")
    doc = json.loads(text)
    found = doc.get("components", {}).get("schemas") or doc.get("definitions") or {doc.get("title", "table"): doc}
    tables = [{"name": n, "columns": [_json_column(c, s, c in o.get("required", [])) for c, s in o.get("properties", {}).items()]} for n, o in found.items() if o.get("type", "object") == "object"]
    if not tables:
        raise ValueError("no object schema")
    return {"tables": tables, "links": []}


def _json_column(name: str, spec: dict[str, Any], required: bool) -> dict[str, Any]:
    kind = {"integer": "bigint", "number": "double", "boolean": "boolean"}.get(spec.get("type"), "string")
    return {"name": name, "type": kind, "nullable": not required, "primary_key": False, "unique": False, "min": spec.get("minimum"), "max": spec.get("maximum"), "values": spec.get("enum"), "format": spec.get("format")}


def spark_schema(table: dict[str, Any]) -> str:
    return ", ".join(f"`{c['name']}` {c['type']}" + ("" if c["nullable"] else " NOT NULL") for c in table["columns"])
