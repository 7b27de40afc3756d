"""How far the columns of two tables lie apart: an original and one derived from it.

Every operator takes the two tables and column names and gives a row a column. Values are counted once per
side; the work after that is on distinct values or bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumatab.functions.coerce import number
from lumatab.operators.running import running_totals

EPS = 1e-12


def _tall(original: DataFrame, derived: DataFrame, columns: list[str], numeric: bool) -> DataFrame:
    """(column_name, value, side) with side 0 for the original and 1 for the derived table."""

    def one(df: DataFrame, side: int) -> DataFrame:
        read = [number(F.col(c), df.schema[c].dataType) if numeric else F.col(c).cast("string") for c in columns]
        pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), x.alias("value")) for c, x in zip(columns, read, strict=True))))
        return df.select(pairs.alias("p")).select("p.column_name", "p.value", F.lit(side).alias("side"))

    return one(original, 0).unionByName(one(derived, 1))


def value_counts(original: DataFrame, derived: DataFrame, columns: list[str], numeric: bool = False) -> DataFrame:
    """(column_name, value, n0, n1, t0, t1): counts a side, null a value like any other, and totals a side."""
    counts = _tall(original, derived, columns, numeric).groupBy("column_name", "value").agg(F.count_if(F.col("side") == 0).alias("n0"), F.count_if(F.col("side") == 1).alias("n1"))
    totals = counts.groupBy("column_name").agg(F.sum("n0").alias("t0"), F.sum("n1").alias("t1"))
    return counts.join(F.broadcast(totals), "column_name")  # a row a column


def _jsd(p: Column, q: Column, sp: Column, sq: Column) -> Column:
    """One cell's share of the Jensen-Shannon divergence; EPS is added to each probability and the sums renormalised."""
    a, b = (p + EPS) / sp, (q + EPS) / sq
    m = (a + b) / 2
    return (a * F.ln(a / m) + b * F.ln(b / m)) / 2


def categorical_divergence(original: DataFrame, derived: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, tvd, jsd)."""
    cells = value_counts(original, derived, columns)
    p, q = F.col("n0") / F.col("t0"), F.col("n1") / F.col("t1")
    size = cells.groupBy("column_name").agg(F.count("*").alias("cells"))
    cells = cells.join(F.broadcast(size), "column_name")
    norm = 1 + F.col("cells") * EPS
    return cells.groupBy("column_name").agg((F.sum(F.abs(p - q)) / 2).alias("tvd"), F.sum(_jsd(p, q, norm, norm)).alias("jsd"))


def histogram(original: DataFrame, derived: DataFrame, columns: list[str], bins: int = 20) -> DataFrame:
    """(column_name, bin, bin_low, bin_high, n0, n1, t0, t1) for all bins, also empty ones; bin 0 holds nulls, the last bin its upper edge.

    A value's bin is the number of edges low + i * step at or below it, the form in which different engines
    agree: a guess by division is moved by one edge where rounding put it wrong. Ranges, two numbers a
    column, are found first; rows are then counted without a shuffle before the partial sums.
    """
    spark = original.sparkSession
    ends = [df.agg(*(f(number(F.col(c), df.schema[c].dataType)).alias(f"{k}{i}") for i, c in enumerate(columns) for k, f in (("l", F.min), ("h", F.max)))).first() for df in (original, derived)]
    low = {c: min((e[f"l{i}"] for e in ends if e[f"l{i}"] is not None), default=None) for i, c in enumerate(columns)}
    high = {c: max((e[f"h{i}"] for e in ends if e[f"h{i}"] is not None), default=None) for i, c in enumerate(columns)}

    def bin_of(v: Column, c: str) -> Column:
        if low[c] is None or low[c] == high[c]:
            return F.when(v.isNull(), 0).otherwise(1)
        step = (high[c] - low[c]) / bins
        edge = lambda k: k * step + low[c]
        k = F.least(F.floor((v - low[c]) / step).cast("double"), F.lit(bins - 1.0))
        moved = k + ((k < bins - 1) & (v >= edge(k + 1))).cast("int") - ((k > 0) & (v < edge(k))).cast("int")
        return F.when(v.isNull(), 0).otherwise(moved.cast("int") + 1)

    def counted(df: DataFrame, side: int) -> DataFrame:
        cells = F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), bin_of(number(F.col(c), df.schema[c].dataType), c).alias("bin")) for c in columns)))
        n = df.select(cells.alias("p")).groupBy("p.column_name", "p.bin").agg(F.count("*").alias("n"))
        return n.select("column_name", "bin", F.when(F.lit(side == 0), F.col("n")).otherwise(0).alias("n0"), F.when(F.lit(side == 1), F.col("n")).otherwise(0).alias("n1"))

    frame = []
    for c in columns:
        flat = low[c] is None or low[c] == high[c]
        step = 0.0 if flat else (high[c] - low[c]) / bins
        frame += [(c, b, None if b == 0 or low[c] is None else (b - 1) * step + low[c], None if b == 0 or low[c] is None else high[c] if flat else b * step + low[c], 0, 0) for b in range(2 if flat else bins + 1)]
    empty = spark.createDataFrame(frame, "column_name string, bin int, bin_low double, bin_high double, n0 bigint, n1 bigint")
    found = counted(original, 0).unionByName(counted(derived, 1)).withColumns({"bin_low": F.lit(None).cast("double"), "bin_high": F.lit(None).cast("double")})
    cells = empty.unionByName(found).groupBy("column_name", "bin").agg(F.max("bin_low").alias("bin_low"), F.max("bin_high").alias("bin_high"), F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    per = Window.partitionBy("column_name")  # a row a bin
    return cells.withColumns({"t0": F.sum("n0").over(per), "t1": F.sum("n1").over(per)})


def numerical_jsd(original: DataFrame, derived: DataFrame, columns: list[str], bins: int = 20) -> DataFrame:
    """(column_name, jsd) over equal-width bins and a bucket for nulls."""
    cells = histogram(original, derived, columns, bins).withColumn("cells", F.count("*").over(Window.partitionBy("column_name")))
    # EPS is added to counts here, before they are made shares
    p, q = F.col("n0").cast("double"), F.col("n1").cast("double")
    return cells.groupBy("column_name").agg(F.sum(_jsd(p, q, F.col("t0") + F.col("cells") * EPS, F.col("t1") + F.col("cells") * EPS)).alias("jsd"))


def distribution_table(original: DataFrame, derived: DataFrame, columns: list[str], bins: int = 20) -> DataFrame:
    """The histogram with percentages and their difference; the null bucket only where there are nulls."""
    pct = lambda n, t: F.round(100 * F.col(n) / F.col(t), 2)
    rows = histogram(original, derived, columns, bins).where("bin > 0 OR n0 + n1 > 0")
    rows = rows.select("column_name", "bin", F.round("bin_low", 3).alias("bin_low"), F.round("bin_high", 3).alias("bin_high"), F.col("n0").alias("original_count"), F.col("n1").alias("derived_count"), pct("n0", "t0").alias("original_pct"), pct("n1", "t1").alias("derived_pct"))
    return rows.withColumn("diff_pct", F.round(F.col("derived_pct") - F.col("original_pct"), 2))


def top_categories(original: DataFrame, derived: DataFrame, columns: list[str], top: int = 12) -> DataFrame:
    """The values most frequent in both tables together, ties by value (null first), with counts and percentages a side."""
    cells = value_counts(original, derived, columns)
    place = F.row_number().over(Window.partitionBy("column_name").orderBy(F.desc(F.col("n0") + F.col("n1")), F.asc_nulls_first("value")))
    pct = lambda n, t: F.round(100 * F.col(n) / F.col(t), 2)
    rows = cells.withColumn("place", place).where(F.col("place") <= top)
    rows = rows.select("column_name", "place", F.col("value").alias("label"), F.col("n0").alias("original_count"), F.col("n1").alias("derived_count"), pct("n0", "t0").alias("original_pct"), pct("n1", "t1").alias("derived_pct"))
    return rows.withColumn("diff_pct", F.round(F.col("derived_pct") - F.col("original_pct"), 2))


def distribution_distance(original: DataFrame, derived: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, wasserstein, similarity, ks): area and largest gap between the two distribution functions, null without values on a side."""
    cells = value_counts(original, derived, columns, numeric=True).where("value IS NOT NULL").drop("t0", "t1")
    totals = cells.groupBy("column_name").agg(F.sum("n0").alias("t0"), F.sum("n1").alias("t1"))
    ordered = running_totals(cells, "column_name", "value", {"c0": "n0", "c1": "n1"}, following="next")
    gap = F.abs(F.col("c0") / F.nullif(F.col("t0"), F.lit(0)) - F.col("c1") / F.nullif(F.col("t1"), F.lit(0)))
    found = ordered.join(F.broadcast(totals), "column_name").groupBy("column_name").agg(F.sum(gap * (F.col("next") - F.col("value"))).alias("w"), F.max(gap).alias("ks"), F.max(gap.isNull()).alias("none"))
    distance = F.when(~F.col("none"), F.coalesce("w", F.lit(0.0)))
    return found.select("column_name", distance.alias("wasserstein"), (1 / (1 + distance)).alias("similarity"), "ks")


def ks_p_value(statistic: float, n: int, m: int) -> float:
    """Asymptotic two-sided p-value by the alternating series of the Kolmogorov distribution."""
    import math

    x = statistic * math.sqrt(n * m / (n + m))
    if x < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (j - 1) * math.exp(-2 * j * j * x * x) for j in range(1, 101))))


def goodness_of_fit(original: DataFrame, derived: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, chi2, dof, tvd_fidelity): both sides scaled to the smaller total, 1e-5 added to each expected and observed count."""
    cells = value_counts(original, derived, columns)
    small = F.least("t0", "t1")
    e, o = F.col("n0") * small / F.col("t0") + 1e-5, F.col("n1") * small / F.col("t1") + 1e-5
    tvd = F.sum(F.abs(F.col("n0") / F.col("t0") - F.col("n1") / F.col("t1"))) / 2
    return cells.groupBy("column_name").agg(F.sum((o - e) * (o - e) / e).alias("chi2"), (F.count("*") - 1).alias("dof"), (1 - tvd).alias("tvd_fidelity"))
