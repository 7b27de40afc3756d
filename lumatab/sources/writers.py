"""Tables as text of other systems. Row texts are column expressions; only previews and envelopes make one string."""

from __future__ import annotations

import io
import math
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumatab.operators.running import row_numbers

#: Allowed conversions of tables: from a format to others.
CONVERSIONS = {"csv": ("tsv", "json", "jsonl", "xml", "parquet", "sql", "md", "html"), "tsv": ("csv", "json", "jsonl", "xml", "parquet", "sql", "md", "html"), "json": ("csv", "tsv", "jsonl", "xml", "parquet", "sql", "md", "html"), "jsonl": ("csv", "tsv", "json", "xml", "parquet", "sql", "md", "html"), "xml": ("csv", "tsv", "json", "jsonl", "parquet", "sql", "md", "html"), "parquet": ("csv", "tsv", "json", "jsonl", "xml", "sql", "md", "html")}
ALIASES = {"pq": "parquet", "ndjson": "jsonl", "markdown": "md", "htm": "html", "txt": "csv"}


def conversion(source: str, target: str) -> tuple[str, str]:
    a, b = (ALIASES.get(x.lower().lstrip("."), x.lower().lstrip(".")) for x in (source, target))
    if b not in CONVERSIONS.get(a, ()):
        raise ValueError(f"no conversion from {a} to {b}")
    return a, b


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """df with every column renamed; names must be complete, valid and distinct whatever their case."""
    if set(names) != set(df.columns):
        raise ValueError("every column needs one name")
    new = [names[c] for c in df.columns]
    if any(not n.isidentifier() or not n.isascii() for n in new) or len({n.lower() for n in new}) != len(new):
        raise ValueError("a name is invalid or used twice")
    return df.withColumnsRenamed(names)


def _literal(col: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.BooleanType):
        text = F.when(col, "TRUE").otherwise("FALSE")
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        text = F.when(F.isnan(col) | (F.abs(col) == math.inf), "NULL").otherwise(col.cast("string"))
    elif isinstance(kind, T.NumericType):
        text = col.cast("string")
    else:
        text = F.concat(F.lit("'"), F.replace(F.replace(col.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("''")), F.lit("'"))
    return F.when(col.isNull(), "NULL").otherwise(text)


def insert_rows(df: DataFrame, booleans: bool = True) -> Column:
    """A row as (value, ...) of an INSERT."""
    return F.concat(F.lit("("), F.concat_ws(", ", *(_literal(F.col(f"`{f.name}`"), f.dataType if booleans or not isinstance(f.dataType, T.BooleanType) else T.StringType()) for f in df.schema.fields)), F.lit(")"))


def insert_statements(df: DataFrame, table: str, order: list[str], rows_per_statement: int = 500, part_rows: int = 250_000) -> DataFrame:
    """(statement_no, statement) with so many rows each, in order: rows are numbered in ranges of about `part_rows` rows, no task sorts all."""
    safe = table.replace("`", "").replace(";", "").replace("'", "").strip() or "converted_data"
    columns = ", ".join("`" + c.strip().replace("`", "") + "`" for c in df.columns)
    keys = [f"_o{i}" for i in range(len(order))]
    texts = df.select(*(F.col(f"`{c}`").alias(k) for c, k in zip(order, keys, strict=True)), insert_rows(df).alias("_row"))
    numbered = row_numbers(texts, keys, ["_row"], "_at", part_rows)
    group = F.floor(F.col("_at") / rows_per_statement)
    lines = numbered.groupBy(group.alias("statement_no")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_row"))), lambda r: F.concat(F.lit("  "), r["_row"])), ",\n").alias("v"))  # `rows_per_statement` rows a group
    return lines.select("statement_no", F.concat(F.lit(f"INSERT INTO `{safe}` ({columns}) VALUES\n"), F.col("v"), F.lit(";")).alias("statement"))


def markdown(df: DataFrame, order: list[str], limit: int = 500) -> str:
    """The first rows as a Markdown table: a preview of bounded size."""
    clean = lambda c: F.coalesce(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col(f"`{c}`").cast("string"), "\r", ""), "\n", " "), r"\|", r"\\|"), F.lit(""))
    rows = df.orderBy(*order).limit(limit).select(F.concat_ws(" | ", *(clean(c) for c in df.columns)).alias("r")).collect()
    head = "| " + " | ".join(df.columns) + " |"
    return "\n".join([head, "| " + " | ".join(["---"] * len(df.columns)) + " |", *(f"| {r['r']} |" for r in rows)])


def html(df: DataFrame, order: list[str], limit: int = 1000) -> str:
    """The first rows as an HTML table: a preview of bounded size."""
    import html as h

    rows = df.orderBy(*order).limit(limit).select(*(F.col(f"`{c}`").cast("string") for c in df.columns)).collect()
    cells = lambda tag, values: "".join(f"<{tag}>{h.escape('' if v is None else v)}</{tag}>" for v in values)
    return f"<table><thead><tr>{cells('th', df.columns)}</tr></thead><tbody>" + "".join(f"<tr>{cells('td', r)}</tr>" for r in rows) + "</tbody></table>"


def _escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def xml_records(df: DataFrame) -> DataFrame:
    """(record) <record><field name="...">...</field></record> per row; null is an empty field."""
    import html as h

    fields = [F.concat(F.lit(f'<field name="{h.escape(c)}">'), F.coalesce(_escaped(F.col(f"`{c}`").cast("string")), F.lit("")), F.lit("</field>")) for c in df.columns]
    return df.select(F.concat(F.lit("<record>"), *fields, F.lit("</record>")).alias("record"))


def _rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A part's records, the first one after a root's opening tag and the last one before its end, so that every part file is a document and a line is still a record."""
    held, opening = None, '<?xml version="1.0" encoding="UTF-8"?><records>'
    for b in batches:
        if b.num_rows:
            if held is not None:
                yield pa.RecordBatch.from_arrays([held], ["record"])
            held = pa.array([opening + b.column(0)[0].as_py(), *b.column(0)[1:].to_pylist()], pa.string()) if opening else b.column(0)
            opening = ""
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([*held[:-1].to_pylist(), held[-1].as_py() + "</records>"], pa.string())], ["record"])


def envelope_pages(df: DataFrame, order: str, rows_per_page: int = 1000) -> DataFrame:
    """(page_no, body) responses of a public API, a page of bounded size a row: header, totalCount, pageNo, numOfRows, items. `order` numbers rows from 0 without gaps or is a unique number."""
    total = df.agg(F.count("*").alias("_total"))
    page = F.floor(F.col(order) / rows_per_page)
    items = df.groupBy(page.alias("page_no")).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_k"), F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_v")))).alias("i"))
    body = F.struct(
        F.struct(F.lit("NORMAL_CODE").alias("resultMsg"), F.lit("00").alias("resultCode")).alias("header"),
        F.struct(F.col("_total").alias("totalCount"), F.col("page_no").alias("pageNo"), F.size("i").alias("numOfRows"), F.transform("i", lambda x: x["_v"]).alias("items")).alias("body"),
    )
    return items.join(F.broadcast(total), how="cross").select("page_no", F.to_json(F.struct(body.alias("response")), {"ignoreNullFields": "false"}).alias("body"))  # against one row


def typed_xml(value, name: str = "value") -> str:
    """A JSON value as XML that keeps its kinds: attributes say number, boolean, null, and whether a list or object is empty."""
    import html as h

    kind = "null" if value is None else "boolean" if isinstance(value, bool) else "number" if isinstance(value, (int, float)) else "string" if isinstance(value, str) else "array" if isinstance(value, list) else "object"
    if kind == "object":
        inner = "".join(typed_xml(v, "member").replace("<member", f'<member key="{h.escape(k)}"', 1) for k, v in value.items())
    elif kind == "array":
        inner = "".join(typed_xml(v, "item") for v in value)
    else:
        inner = "" if value is None else h.escape(str(value).lower() if kind == "boolean" else repr(value) if kind == "number" else value)
    return f'<{name} type="{kind}">{inner}</{name}>'


def from_typed_xml(text: str):
    """Back from typed_xml."""
    import json
    import xml.etree.ElementTree as ET

    def build(e):
        kind = e.get("type")
        if kind == "object":
            return {m.get("key"): build(m) for m in e}
        if kind == "array":
            return [build(m) for m in e]
        if kind == "null":
            return None
        return json.loads(e.text) if kind in ("number", "boolean") else e.text or ""

    if "<!DOCTYPE" in text.upper() or "<!ENTITY" in text.upper():
        raise ValueError("document types and entities are not read")
    return build(ET.fromstring(text))


def checksum(df: DataFrame) -> DataFrame:
    """One row: rows, checksum. A sum of row hashes, so the order of rows and partitions plays no part."""
    cells = [F.coalesce(F.concat(F.length(F.col(f"`{c}`").cast("string")).cast("string"), F.lit(":"), F.col(f"`{c}`").cast("string")), F.lit("-")) for c in df.columns]
    part = F.conv(F.substring(F.sha2(F.concat_ws("|", *cells), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(part), F.lit(0)).cast("string").alias("checksum"))


def write_table(df: DataFrame, path: str, kind: str) -> None:
    """A table as csv, tsv, jsonl, json, parquet, xml or sql, one part file a task. CSV is UTF-8 without a byte-order mark; json parts are lines."""
    from lumatab.sources.readers import flat

    out = df.write.mode("errorifexists")
    if kind in ("csv", "tsv"):
        flat(df).write.mode("errorifexists").option("header", True).option("sep", "," if kind == "csv" else "\t").option("escape", '"').csv(path)
    elif kind in ("json", "jsonl"):
        out.option("ignoreNullFields", False).json(path)
    elif kind == "parquet":
        out.parquet(path)
    elif kind == "xml":
        xml_records(flat(df)).mapInArrow(_rooted, "record string").write.mode("errorifexists").text(path)
    elif kind == "sql":
        df.select(F.concat(F.lit("INSERT INTO `converted_data` VALUES "), insert_rows(df), F.lit(";")).alias("line")).write.mode("errorifexists").text(path)
    else:
        raise ValueError(f"no writer for {kind}")


def safe_name(name: str, fallback: str = "table") -> str:
    """A file name without separators, marks or control characters, of at most 100 characters."""
    out = re.sub(r"[^\w가-힣.-]+", "_", name.strip()).strip("._")
    return out[:100] or fallback


def package(files: dict[str, bytes]) -> bytes:
    """A zip archive of small finished files (reports, previews, schemas) under safe names; equal names are numbered. Tables are written as folders, never packed on the driver."""
    out, taken = io.BytesIO(), set()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in files.items():
            stem, dot, ending = safe_name(name).rpartition(".")
            at, n = safe_name(name), 2
            while at in taken:
                at, n = f"{stem or ending}_{n}{dot + ending if stem else ''}", n + 1
            taken.add(at)
            z.writestr(zipfile.ZipInfo(at, (1980, 1, 1, 0, 0, 0)), data)
    return out.getvalue()
