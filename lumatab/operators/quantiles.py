"""Exact quantiles of whole columns, found where they lie instead of gathering all values in one task."""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumatab.operators.running import running_totals


def quantiles(df: DataFrame, values: dict[str, Column], shares: list[float]) -> dict[str, list[float] | None]:
    """For each named value its quantiles with linear interpolation, None without values.

    Distinct values are counted once and kept while they are asked, their running counts found range by range, and only the
    few values that stand at a wanted rank come back: at most two a quantile.
    """
    cells = F.explode(F.array(*(F.struct(F.lit(k).alias("name"), v.cast("double").alias("v")) for k, v in values.items())))
    counts = df.select(cells.alias("p")).select("p.*").where("v IS NOT NULL").groupBy("name", "v").agg(F.count("*").alias("n")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _at_ranks(counts, list(values), shares)
    finally:
        counts.unpersist()


def _at_ranks(counts: DataFrame, values: list[str], shares: list[float]) -> dict[str, list[float] | None]:
    known = {r["name"]: (r["n"], r["k"]) for r in counts.groupBy("name").agg(F.sum("n").alias("n"), F.count("*").alias("k")).collect()}  # a row a value
    if not known:
        return dict.fromkeys(values)
    sizes, parts = {k: n for k, (n, _) in known.items()}, min(4096, max(64, max(k for _, k in known.values()) // 250_000))
    at = {k: [s * (n - 1) for s in shares] for k, n in sizes.items()}
    wanted = {k: sorted({x for p in ps for x in (math.floor(p), math.ceil(p))}) for k, ps in at.items()}
    hit = F.lit(False)
    for k, ranks in wanted.items():
        near = F.exists(F.array(*(F.lit(r).cast("bigint") for r in ranks)), lambda r: (r < F.col("upto")) & (r >= F.col("upto") - F.col("n")))
        hit = hit | ((F.col("name") == k) & near)
    found = running_totals(counts, "name", "v", {"upto": "n"}, parts=parts).where(hit).collect()
    out: dict[str, list[float] | None] = dict.fromkeys(values)
    for k, ps in at.items():
        spans = sorted((r["upto"] - r["n"], r["upto"], r["v"]) for r in found if r["name"] == k)
        value = lambda rank: next(v for a, b, v in spans if a <= rank < b)  # noqa: B023, E731
        out[k] = [value(math.floor(p)) + (p - math.floor(p)) * (value(math.ceil(p)) - value(math.floor(p))) for p in ps]
    return out
