"""Running totals over an ordered column without one task holding the order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def part_of(value: Column, cuts: list[float], first: int = 0) -> Column:
    """How many cuts lie below a value, as a tree of comparisons: a few of them a row, all in generated code."""
    if not cuts:
        return F.lit(first)
    mid = len(cuts) // 2
    return F.when(value <= cuts[mid], part_of(value, cuts[:mid], first)).otherwise(part_of(value, cuts[mid + 1 :], first + mid + 1))


def _range_of(value: Column, cuts: list[float], width: int = 64) -> Column:
    """How many cuts lie below a value. Many cuts are looked up in two steps: a tree over every `width`-th one, then a count in the list between two of them."""
    if len(cuts) <= width:
        return part_of(value, cuts)
    tops = cuts[width - 1 :: width]
    lists = [cuts[i : i + width] for i in range(0, len(cuts), width)]
    top = part_of(value, tops)
    return top * width + F.size(F.filter(F.coalesce(F.get(F.lit(lists), top), F.array().cast("array<double>")), lambda c: c < value))


def running_totals(df: DataFrame, group: str, order: str, totals: dict[str, str], following: str | None = None, parts: int | None = None, part_rows: int = 250_000) -> DataFrame:
    """df, one row per (group, order), with running sums: totals maps a new column to the one it adds up, its own row included.

    With `following` a column of that name has the group's next larger value, null for the last. Groups are
    few (columns of a table). The order is cut into ranges at approximate quantiles, as many that one has about `part_rows`
    rows (64 to 4,096 a group); a window is one range, and what lies before it comes from a table of groups x ranges.
    """
    def found(k: int):
        at = F.percentile_approx(order, [i / k for i in range(1, k)], max(1000, 8 * k))
        return df.groupBy(group).agg(F.count("*").alias("n"), at.alias("c")).collect()  # a row a group

    rows = found(parts or 64)
    largest = max((r["n"] for r in rows), default=0) // part_rows
    if parts is None and largest > 64:
        rows = found(min(4096, largest))
    cuts = {r[group]: sorted(set(r["c"] or [])) for r in rows}
    part = F.lit(0)
    for name, at in cuts.items():
        part = F.when(F.col(group) == name, _range_of(F.col(order), at)).otherwise(part)
    cut = df.withColumn("_part", part)
    sums = cut.groupBy(group, "_part").agg(F.min(order).alias("_first"), *(F.sum(v).alias(f"_s_{k}") for k, v in totals.items()))
    earlier = Window.partitionBy(group).orderBy("_part")
    sums = sums.select(group, "_part", F.lead("_first").over(earlier).alias("_after"), *((F.sum(f"_s_{k}").over(earlier) - F.col(f"_s_{k}")).alias(f"_b_{k}") for k in totals))
    inner = Window.partitionBy(group, "_part").orderBy(order)
    inside = cut.withColumns({"_next": F.lead(order).over(inner)} | {f"_w_{k}": F.sum(v).over(inner) for k, v in totals.items()})
    joined = inside.join(F.broadcast(sums), [group, "_part"])  # at most groups x parts rows
    extra = [F.coalesce("_next", "_after").alias(following)] if following else []
    return joined.select(*df.columns, *((F.col(f"_w_{k}") + F.col(f"_b_{k}")).alias(k) for k in totals), *extra)


def row_numbers(df: DataFrame, order: list[str], ties: list[str], name: str, part_rows: int = 250_000) -> DataFrame:
    """df with a column of row numbers from 0 in the order of some columns, nulls first, then of `ties`; one task holds a range of the order.

    The ranges are cut at literals found once from a sample of keys, so that rows and the counts of ranges see the same ones;
    the sample decides how even the ranges are, not the numbers. Equal keys share a range.
    """
    rows = df.count()
    parts, width = min(4096, rows // part_rows + 1), 64
    kinds = [df.schema[c].dataType for c in order]
    key = F.struct(*(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(order)))
    part = F.lit(0)
    if parts > 1:
        some = df.select(key.alias("k")).sample(min(1.0, 50 * parts / rows), seed=0).agg(F.array_sort(F.collect_list("k")).alias("k"))
        at = F.transform(F.sequence(F.lit(1), F.lit(parts - 1)), lambda i: F.get("k", F.floor(i * F.size("k") / parts).cast("int")))
        found = some.select(F.array_distinct(F.array_compact(at))).first()[0]  # a key a range
        cuts = [F.struct(*(F.lit(bytes(v) if isinstance(v, bytearray) else v).cast(t).alias(f"k{i}") for i, (v, t) in enumerate(zip(c, kinds, strict=True)))) for c in found]
        if len(cuts) <= width:
            part = part_of(key, cuts)
        else:
            top = part_of(key, cuts[width - 1 :: width])
            lists = F.array(*(F.array(*cuts[i : i + width]) for i in range(0, len(cuts), width)))
            part = top * width + F.coalesce(F.size(F.filter(F.get(lists, top), lambda c: c < key)), F.lit(0))
    cut = df.withColumn("_part", part)
    before = cut.groupBy("_part").count().select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_before"))  # a row a range
    inside = cut.withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy(*(f"`{c}`" for c in [*order, *ties]))))
    return inside.join(F.broadcast(before), "_part").select(*(f"`{c}`" for c in df.columns), (F.col("_before") + F.col("_n") - 1).alias(name))
