"""What a table holds: counts, ranges, kinds of columns, gaps in time, keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumatab.functions.coerce import number


def _values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, value as text, n): one pass, added up before the shuffle."""
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns)))
    return df.select(cells.alias("p")).select("p.*").groupBy("column_name", "value").agg(F.count("*").alias("n"))


def column_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column_name, rows, nulls, distinct_values, min_value, max_value, mean, stddev); the last four for numbers only, rounded to 4 places."""
    columns = columns or df.columns
    values = _values(df, columns)
    counts = values.groupBy("column_name").agg(F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("nulls"), F.count("value").alias("distinct_values"))
    numeric = [c for c in columns if isinstance(df.schema[c].dataType, T.NumericType)]
    if not numeric:
        return counts.withColumns({c: F.lit(None).cast("double") for c in ("min_value", "max_value", "mean", "stddev")})
    sums = df.agg(*(f(number(F.col(c), df.schema[c].dataType)).alias(f"{k}_{i}") for i, c in enumerate(numeric) for k, f in (("lo", F.min), ("hi", F.max), ("avg", F.avg), ("sd", F.stddev))))
    cells = [F.struct(F.lit(c).alias("column_name"), F.round(f"lo_{i}", 4).alias("min_value"), F.round(f"hi_{i}", 4).alias("max_value"), F.round(f"avg_{i}", 4).alias("mean"), F.round(f"sd_{i}", 4).alias("stddev")) for i, c in enumerate(numeric)]
    return counts.join(F.broadcast(sums.select(F.explode(F.array(*cells)).alias("p")).select("p.*")), "column_name", "left")  # a row a column


def top_values(df: DataFrame, columns: list[str], k: int = 10) -> DataFrame:
    """(column_name, place, value, n) of the k most frequent values, ties by value, null first among equals."""
    place = F.row_number().over(Window.partitionBy("column_name").orderBy(F.desc("n"), F.asc_nulls_first("value")))
    return _values(df, columns).withColumn("place", place).where(F.col("place") <= k).select("column_name", "place", "value", "n")


def infer_kinds(df: DataFrame, columns: list[str] | None = None, numeric_ratio: float = 0.9, unique_ratio: float = 0.05) -> DataFrame:
    """(column_name, numeric_ratio, unique_ratio, kind): numerical if nearly all values read as numbers and enough of them differ."""
    columns = columns or df.columns
    reads = _values(df, columns).where("value IS NOT NULL").withColumn("reads", number(F.col("value"), T.StringType()).isNotNull())
    found = reads.groupBy("column_name").agg(F.sum("n").alias("rows"), F.sum(F.when(F.col("reads"), F.col("n")).otherwise(0)).alias("numbers"), F.count("*").alias("distinct_values"))
    a, b = F.col("numbers") / F.col("rows"), F.col("distinct_values") / F.col("rows")
    return found.select("column_name", F.round(a, 6).alias("numeric_ratio"), F.round(b, 6).alias("unique_ratio"), F.when((a >= numeric_ratio) & (b > unique_ratio), "numerical").otherwise("categorical").alias("kind"))


def completeness(df: DataFrame) -> DataFrame:
    """One row: rows, cells, missing_cells, empty_cells, completeness_score (0 to 100, null without cells)."""
    missing = reduce(lambda a, b: a + b, (F.col(c).isNull().cast("bigint") for c in df.columns))
    empty = reduce(lambda a, b: a + b, (F.coalesce(F.col(f.name) == "", F.lit(False)).cast("bigint") for f in df.schema.fields if isinstance(f.dataType, T.StringType)), F.lit(0).cast("bigint"))
    found = df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(missing), F.lit(0)).alias("missing_cells"), F.coalesce(F.sum(empty), F.lit(0)).alias("empty_cells"))
    cells = F.col("rows") * len(df.columns)
    return found.select("rows", cells.alias("cells"), "missing_cells", "empty_cells", F.when(cells > 0, F.round(100 * (cells - F.col("missing_cells")) / cells, 4)).alias("completeness_score"))


def observations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, seen, nulls, empties, zeros, falses, numbers, mean, min_value, max_value): missing, empty, zero and false kept apart."""
    out = []
    for i, c in enumerate(columns):
        kind = df.schema[c].dataType
        v = F.lit(None).cast("double") if isinstance(kind, T.BooleanType) else number(F.col(c), kind)
        text = F.col(c) == "" if isinstance(kind, T.StringType) else F.lit(False)
        false = ~F.col(c) if isinstance(kind, T.BooleanType) else F.lit(False)
        out += [F.count("*").alias(f"a{i}"), F.count_if(F.col(c).isNull()).alias(f"b{i}"), F.count_if(text).alias(f"c{i}"), F.count_if(v == 0).alias(f"d{i}"), F.count_if(false).alias(f"e{i}"), F.count(v).alias(f"f{i}"), F.avg(v).alias(f"g{i}"), F.min(v).alias(f"h{i}"), F.max(v).alias(f"i{i}")]
    names = dict(zip("abcdefghi", ("seen", "nulls", "empties", "zeros", "falses", "numbers", "mean", "min_value", "max_value"), strict=True))
    cells = [F.struct(F.lit(c).alias("column_name"), *(F.col(f"{k}{i}").alias(v) for k, v in names.items())) for i, c in enumerate(columns)]
    return df.agg(*out).select(F.explode(F.array(*cells)).alias("p")).select("p.*")


def steps(df: DataFrame, time: str, by: list[str] | None = None) -> DataFrame:
    """Distinct moments (by entity) with the seconds since the one before, null for the first.

    With entities a window is an entity's. Without them moments are cut into days, so that no task orders all.
    """
    by = by or []
    moments = df.where(F.col(time).isNotNull()).groupBy(*by, F.col(time).alias("_t")).agg(F.count("*").alias("_n"))
    micros = F.unix_micros(F.col("_t").cast("timestamp"))
    if by:
        return moments.withColumn("_step", (micros - F.lag(micros).over(Window.partitionBy(*by).orderBy("_t"))) / 1e6)
    moments = moments.withColumn("_day", F.to_date("_t"))
    lasts = moments.groupBy("_day").agg(F.max("_t").alias("_last"))
    lasts = lasts.select("_day", F.lag("_last").over(Window.orderBy("_day")).alias("_before"))  # a row a day
    inner = F.lag("_t").over(Window.partitionBy("_day").orderBy("_t"))
    return moments.withColumn("_in", inner).join(lasts, "_day").withColumn("_step", (micros - F.unix_micros(F.coalesce("_in", "_before").cast("timestamp"))) / 1e6).drop("_in", "_before", "_day")


def temporal_summary(df: DataFrame, time: str, by: list[str] | None = None) -> DataFrame:
    """A row (an entity): first and last moment, valid, distinct and repeated ones, the most frequent step (smallest on ties) and the steps above it."""
    by = by or []
    found = steps(df, time, by)
    usual = found.where("_step IS NOT NULL").groupBy(*by, "_step").agg(F.count("*").alias("_m"))
    modal = usual.groupBy(*by).agg(F.max_by("_step", F.struct("_m", -F.col("_step"))).alias("modal_interval"), F.sum("_m").alias("intervals"))
    base = found.groupBy(*by).agg(F.min("_t").alias("start"), F.max("_t").alias("end"), F.sum("_n").alias("valid"), F.count("*").alias("distinct_moments"))
    if by:
        both = base.join(modal, by, "left")
        gaps = usual.join(modal.select(*by, "modal_interval"), by).where(F.col("_step") > F.col("modal_interval")).groupBy(*by).agg(F.sum("_m").alias("gaps"))
        both = both.join(gaps, by, "left")
    else:
        both = base.join(modal, how="cross")  # one row each
        gaps = usual.join(F.broadcast(modal.select("modal_interval")), F.col("_step") > F.col("modal_interval")).agg(F.sum("_m").alias("gaps"))
        both = both.join(gaps, how="cross")
    return both.select(*by, "start", "end", "valid", "distinct_moments", (F.col("valid") - F.col("distinct_moments")).alias("repeated"), "modal_interval", F.coalesce("gaps", F.lit(0)).alias("gaps"))


def key_candidates(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, column_name, rows, distinct_values, nulls, is_key): a key has no nulls and no value twice."""
    parts = []
    for name, df in tables.items():
        counts = column_profile(df, df.columns).select("column_name", "rows", "distinct_values", "nulls")
        parts.append(counts.select(F.lit(name).alias("table_name"), "*", ((F.col("nulls") == 0) & (F.col("rows") > 0) & (F.col("distinct_values") == F.col("rows"))).alias("is_key")))
    return reduce(DataFrame.unionByName, parts)


def containment(parent: DataFrame, parent_key: str, child: DataFrame, child_key: str) -> DataFrame:
    """One row: distinct child values, those the parent has, their share; child rows without a parent. Compared as text, null children left out."""
    values = child.where(F.col(child_key).isNotNull()).groupBy(F.col(child_key).cast("string").alias("v")).agg(F.count("*").alias("n"))
    keys = parent.where(F.col(parent_key).isNotNull()).select(F.col(parent_key).cast("string").alias("p")).distinct()
    found = values.join(keys, F.col("v") == F.col("p"), "left").agg(F.count("*").alias("child_values"), F.count("p").alias("contained_values"), F.coalesce(F.sum(F.when(F.col("p").isNull(), F.col("n"))), F.lit(0)).alias("orphan_rows"))
    return found.select("child_values", "contained_values", F.when(F.col("child_values") > 0, F.round(F.col("contained_values") / F.col("child_values"), 6)).alias("containment"), "orphan_rows")


def foreign_keys(tables: dict[str, DataFrame], pairs: list[tuple[str, str, str, str]], at_least: float = 0.8) -> DataFrame:
    """(parent_table, parent_key, child_table, child_key, containment, orphan_rows, is_foreign_key) of candidate pairs."""
    parts = []
    for pt, pk, ct, ck in pairs:
        one = containment(tables[pt], pk, tables[ct], ck)
        parts.append(one.select(F.lit(pt).alias("parent_table"), F.lit(pk).alias("parent_key"), F.lit(ct).alias("child_table"), F.lit(ck).alias("child_key"), "containment", "orphan_rows", F.coalesce(F.col("containment") >= at_least, F.lit(False)).alias("is_foreign_key")))
    return reduce(DataFrame.unionByName, parts)


def key_pairs(tables: dict[str, list[str]]) -> list[tuple[str, str, str, str]]:
    """Candidate (parent, key, child, column) by name: the child's column ends like the parent's key, prefixes aside, and the key names its table."""
    bare = lambda c: c.split("_", 1)[-1].casefold()
    out = []
    for pt, pcols in tables.items():
        for pk in pcols:
            stem = bare(pk).removesuffix("key").removesuffix("id").strip("_")
            if bare(pk) == stem or not stem or not (pt.casefold().startswith(stem) or stem.startswith(pt.casefold())):
                continue
            out += [(pt, pk, ct, c) for ct, cols in tables.items() if ct != pt for c in cols if bare(c) == bare(pk)]
    return out


def quasi_identifier_classes(df: DataFrame, columns: list[str] | None = None, unique: float = 0.8, rows: int = 20) -> DataFrame:
    """(column_name, unique_ratio, largest_share, part): identifier if nearly all values differ, quasi-identifier if few rows share a value, else attribute."""
    values = _values(df, columns or df.columns).where("value IS NOT NULL")
    found = values.groupBy("column_name").agg(F.sum("n").alias("rows"), F.count("*").alias("d"), F.max("n").alias("m"))
    u = F.col("d") / F.col("rows")
    part = F.when((u >= unique) & (F.col("rows") >= rows), "identifier").when(F.col("d") > 1, "quasi_identifier").otherwise("attribute")
    return found.select("column_name", F.round(u, 6).alias("unique_ratio"), F.round(F.col("m") / F.col("rows"), 6).alias("largest_share"), part.alias("part"))
