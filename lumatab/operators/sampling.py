"""Bounded samples that depend on keys alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def smallest(df: DataFrame, digest: Column, ties: list[str], size: int, rows: int | None = None) -> DataFrame:
    """The `size` rows with the smallest hexadecimal digest: a random sample that order and partitions do not change.

    Most rows are filtered out by a bound on the digest first, twice as high as needed, so that what meets in one
    task is about twice the sample however many tasks read the table.
    """
    n = df.count() if rows is None else rows
    if n > 4 * size:
        bound = format(2 * size * 16**13 // n, "013x")
        df = df.where(F.substring(digest, 1, 13) < bound)
    return df.orderBy(digest, *ties).limit(size)
