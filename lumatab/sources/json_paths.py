"""What a column of JSON holds, path by path. Nothing is inferred from a sample: every document is walked."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def kind_of(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int):
        return "integer"
    if isinstance(value, float):
        return "number"
    if isinstance(value, str):
        return "string"
    return "object" if isinstance(value, dict) else "array"


def escaped(name: str) -> str:
    return name.replace("~", "~0").replace("/", "~1").replace("*", "~2")


def walk(value) -> Iterator[tuple[str, str, object]]:
    """(path, kind, value) of a tree's nodes, parents first; array members share the path /*."""
    stack = [("$", value)]
    while stack:
        path, v = stack.pop()
        yield path, kind_of(v), v
        base = "" if path == "$" else path
        if isinstance(v, dict):
            stack += [(f"{base}/{escaped(k)}", x) for k, x in reversed(v.items())]
        elif isinstance(v, list):
            stack += [(f"{base}/*", x) for x in reversed(v)]


def flatten(df: DataFrame, column: str) -> DataFrame:
    """(path, kind, value) of every node of every document; containers have null values. Text that is no JSON has kind invalid at path $."""

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                rows = []
                for text in b.column(0).slice(i, 1000).to_pylist():
                    if text is None:
                        continue
                    try:
                        tree = json.loads(text)
                    except (ValueError, RecursionError):  # no JSON, or nested beyond the parser's depth
                        rows.append(("$", "invalid", text))
                        continue
                    rows += [(p, k, None if k in ("object", "array", "null") else v if isinstance(v, str) else json.dumps(v)) for p, k, v in walk(tree)]
                cols = list(zip(*rows, strict=True)) or [()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], ["path", "kind", "value"])

    return df.select(F.col(column).cast("string")).mapInArrow(run, "path string, kind string, value string")


def path_statistics(df: DataFrame, column: str) -> DataFrame:
    """(path, kinds, occurrences, scalars, nulls, empties, zeros, falses, missing): missing is how often the parent object lacks it, null where the parent is no object everywhere."""
    nodes = flatten(df, column)
    is_number = F.col("kind").isin("integer", "number")
    per = nodes.groupBy("path").agg(
        F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"), F.count("*").alias("occurrences"), F.count_if(~F.col("kind").isin("object", "array")).alias("scalars"), F.count_if(F.col("kind") == "null").alias("nulls"),
        F.count_if((F.col("kind") == "string") & (F.col("value") == "")).alias("empties"), F.count_if(is_number & (F.col("value").try_cast("double") == 0)).alias("zeros"), F.count_if((F.col("kind") == "boolean") & (F.col("value") == "false")).alias("falses"),
    )
    above = F.when(F.instr(F.substring("path", 2, 1 << 30), "/") > 0, F.regexp_extract("path", "^(.*)/[^/]*$", 1)).otherwise(F.lit("$"))
    parent = per.select(F.col("path").alias("_p"), F.col("kinds").alias("_k"), F.col("occurrences").alias("_o"))
    joined = per.withColumn("_up", F.when(F.col("path") != "$", above)).join(parent, F.col("_up") == F.col("_p"), "left")  # a row a path; keys that are ids give many
    return joined.select(*per.columns, F.when(F.col("_k") == "object", F.greatest(F.col("_o") - F.col("occurrences"), F.lit(0))).alias("missing"))


def leaf_completeness(statistics: DataFrame) -> DataFrame:
    """One row: cells, missing, score over scalar values at leaves."""
    leaf = statistics.where("scalars > 0")
    one = leaf.agg(F.coalesce(F.sum("scalars"), F.lit(0)).alias("cells"), F.coalesce(F.sum(F.col("nulls") + F.col("empties")), F.lit(0)).alias("missing"))
    return one.select("cells", "missing", F.when(F.col("cells") > 0, F.round(100 * (F.col("cells") - F.col("missing")) / F.col("cells"), 2)).alias("score"))


def compare_trees(left: DataFrame, right: DataFrame) -> DataFrame:
    """(path, left_kinds, right_kinds, same) of two tables of path statistics."""
    a, b = left.select("path", F.col("kinds").alias("left_kinds")), right.select("path", F.col("kinds").alias("right_kinds"))
    return a.join(b, "path", "full_outer").withColumn("same", F.col("left_kinds").eqNullSafe(F.col("right_kinds")))


def pointer(tree, path: str):
    """The value at a JSON pointer (/a/b, ~1 for /, ~0 for ~)."""
    at = tree
    for part in path.split("/")[1:] if path not in ("", "/") else []:
        part = part.replace("~1", "/").replace("~0", "~")
        at = at[int(part)] if isinstance(at, list) else at[part]
    return at


def record_lists(tree) -> list[tuple[str, int]]:
    """(pointer, length) of arrays of objects not inside another array."""
    out, stack = [], [("", tree)]
    while stack:
        path, v = stack.pop(0)
        if isinstance(v, list):
            if v and all(isinstance(x, dict) for x in v):
                out.append((path or "/", len(v)))
        elif isinstance(v, dict):
            stack += [(f"{path}/{k.replace('~', '~0').replace('/', '~1')}", x) for k, x in v.items()]
    return out
