"""How columns hang together, and how much of that a derived table keeps."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumatab.functions.coerce import number
from lumatab.operators.running import running_totals


def _complete(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns as numbers, rows without a missing one."""
    return df.select(*(number(F.col(c), df.schema[c].dataType).alias(c) for c in columns)).dropna()


def pearson(df: DataFrame, columns: list[str], name: str = "r") -> DataFrame:
    """(pair, r) of all pairs over complete rows, 0 where a column is constant; one aggregation for all pairs."""
    pairs = list(combinations(columns, 2))
    # not corr(), which divides by zero for a constant column
    r = lambda a, b: F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))
    one = _complete(df, columns).agg(*(r(a, b).alias(f"p{i}") for i, (a, b) in enumerate(pairs)))
    cells = F.explode(F.array(*(F.struct(F.lit(f"{a} x {b}").alias("pair"), F.coalesce(F.nanvl(f"p{i}", F.lit(None).cast("double")), F.lit(0.0)).alias(name)) for i, (a, b) in enumerate(pairs))))
    return one.select(cells.alias("c")).select("c.*")


def ranks(df: DataFrame, columns: list[str]) -> DataFrame:
    """Average ranks of every column over complete rows, ties sharing their mean rank."""
    rows = _complete(df, columns)
    tall = rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("v")) for c in columns))).alias("p")).select("p.name", "p.v")
    counts = tall.groupBy("name", "v").agg(F.count("*").alias("n"))
    place = running_totals(counts, "name", "v", {"upto": "n"}).select("name", "v", (F.col("upto") - (F.col("n") - 1) / 2).alias("rank"))
    out = rows
    for c in columns:  # a join a column on its distinct values
        one = place.where(F.col("name") == c).select(F.col("v").alias(f"_v_{c}"), F.col("rank").alias(f"_r_{c}"))
        out = out.join(one, F.col(c) == F.col(f"_v_{c}"))
    return out.select(*(F.col(f"_r_{c}").alias(c) for c in columns))


def correlation_preservation(original: DataFrame, derived: DataFrame, columns: list[str], spearman: bool = False) -> DataFrame:
    """(pair, original_r, derived_r, absolute_error, preservation) per pair."""
    a, b = (ranks(df, columns) if spearman else df for df in (original, derived))
    both = pearson(a, columns, "original_r").join(pearson(b, columns, "derived_r"), "pair")
    gap = F.abs(F.col("original_r") - F.col("derived_r"))
    return both.select("pair", "original_r", "derived_r", gap.alias("absolute_error"), F.greatest(F.lit(0.0), 1 - gap / 2).alias("preservation"))


def correlation_score(pairs: DataFrame) -> DataFrame:
    """(mae, score, pairs_evaluated) of correlation_preservation."""
    mae = F.avg("absolute_error")
    return pairs.agg(mae.alias("mae"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - mae / 2)).alias("score"), F.count("*").alias("pairs_evaluated"))


def frobenius_fidelity(original: DataFrame, derived: DataFrame, columns: list[str]) -> DataFrame:
    """(distance, fidelity): Frobenius norm of the difference of the correlation matrices, and 1 - norm over the largest it can be, 0 at least."""
    gap = correlation_preservation(original, derived, columns)
    norm = F.sqrt(2 * F.sum(F.col("absolute_error") * F.col("absolute_error")))
    return gap.agg(norm.alias("distance"), F.greatest(F.lit(0.0), 1 - norm / (2 * len(columns))).alias("fidelity"))


def _v(n: Column, phi2: Column, r: Column, k: Column) -> Column:
    """Bias-corrected Cramer's V from chi-square over n and the numbers of categories."""
    better = F.greatest(F.lit(0.0), phi2 - (k - 1) * (r - 1) / (n - 1))
    rows, cols = r - (r - 1) * (r - 1) / (n - 1), k - (k - 1) * (k - 1) / (n - 1)
    room = F.least(rows - 1, cols - 1)
    return F.when((r > 1) & (k > 1) & (n > 1) & (room > 0), F.sqrt(better / room)).otherwise(F.lit(0.0))


def cramers_v(df: DataFrame, columns: list[str], name: str = "v") -> DataFrame:
    """(pair, v) of all pairs; null is a category.

    chi-square / n = sum of observed^2 / (row total * column total) - 1 needs observed cells only, although
    it is over all of them, since expected counts add up to n.
    """
    pairs = list(combinations(columns, 2))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\0null"))
    cells = F.explode(F.array(*(F.struct(F.lit(f"{a} x {b}").alias("pair"), text(a).alias("x"), text(b).alias("y")) for a, b in pairs)))
    observed = df.select(cells.alias("c")).select("c.*").groupBy("pair", "x", "y").agg(F.count("*").alias("o"))
    rows = observed.groupBy("pair", "x").agg(F.sum("o").alias("rx"))
    cols = observed.groupBy("pair", "y").agg(F.sum("o").alias("cy"))
    size = rows.groupBy("pair").agg(F.sum("rx").alias("n"), F.count("*").alias("r")).join(cols.groupBy("pair").agg(F.count("*").alias("k")), "pair")
    phi = observed.join(rows, ["pair", "x"]).join(cols, ["pair", "y"]).groupBy("pair").agg((F.sum(F.col("o") * F.col("o") / (F.col("rx").cast("double") * F.col("cy"))) - 1).alias("phi2"))
    return size.join(phi, "pair").select("pair", _v(F.col("n"), F.col("phi2"), F.col("r"), F.col("k")).alias(name))


def association_preservation(original: DataFrame, derived: DataFrame, columns: list[str], significant: float = 0.15) -> DataFrame:
    """(pair, original_v, derived_v, difference, significant, preserved): a pair above `significant` is kept if its V stays at 0.08 and 40 %."""
    both = cramers_v(original, columns, "original_v").join(cramers_v(derived, columns, "derived_v"), "pair")
    sure = F.col("original_v") >= significant
    kept = sure & (F.col("derived_v") >= F.greatest(F.lit(0.08), 0.4 * F.col("original_v")))
    return both.select("pair", "original_v", "derived_v", F.abs(F.col("original_v") - F.col("derived_v")).alias("difference"), sure.alias("significant"), kept.alias("preserved"))


def association_score(pairs: DataFrame) -> DataFrame:
    """(mae, score, significant_pairs, preserved_pairs, preservation_rate) of association_preservation."""
    mae = F.avg("difference")
    sure, kept = F.count_if("significant"), F.count_if("preserved")
    return pairs.agg(mae.alias("mae"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - mae)).alias("score"), sure.alias("significant_pairs"), kept.alias("preserved_pairs"), F.when(sure > 0, kept / sure).otherwise(F.lit(1.0)).alias("preservation_rate"))


def propensity(original: DataFrame, derived: DataFrame, numerical: list[str], categorical: list[str], max_categories: int = 10) -> DataFrame:
    """(pmse, expected_pmse, pmse_ratio, features, rows, status): how well a logistic regression tells the tables apart.

    Numbers are standardised, missing ones at the median; categories beyond the most frequent ones are one.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
    from pyspark.ml.functions import vector_to_array


    def side(df: DataFrame, label: float) -> DataFrame:
        return df.select(*(number(F.col(c), df.schema[c].dataType).alias(c) for c in numerical), *(F.coalesce(F.col(c).cast("string"), F.lit("missing")).alias(c) for c in categorical), F.lit(label).alias("label"))

    rows = side(original, 0.0).unionByName(side(derived, 1.0))
    for c in categorical:
        common = [r[c] for r in rows.groupBy(c).count().orderBy(F.desc("count"), c).limit(max_categories - 1).collect()]  # at most max_categories short rows
        rows = rows.withColumn(c, F.when(F.col(c).isin(common), F.col(c)).otherwise(F.lit("\0other")))
    stages: list = [Imputer(inputCols=numerical, outputCols=[f"{c}_i" for c in numerical], strategy="median"), VectorAssembler(inputCols=[f"{c}_i" for c in numerical], outputCol="num"), StandardScaler(inputCol="num", outputCol="scaled", withMean=True)] if numerical else []
    if categorical:
        stages += [StringIndexer(inputCols=categorical, outputCols=[f"{c}_x" for c in categorical]), OneHotEncoder(inputCols=[f"{c}_x" for c in categorical], outputCols=[f"{c}_h" for c in categorical], dropLast=False)]
    stages.append(VectorAssembler(inputCols=(["scaled"] if numerical else []) + [f"{c}_h" for c in categorical], outputCol="features"))
    ready = Pipeline(stages=stages).fit(rows).transform(rows)
    size = rows.count()
    fitted = LogisticRegression(maxIter=300, regParam=1.0 / max(size, 1), standardization=False).fit(ready)
    k = max(1, fitted.numFeatures)
    scored = fitted.transform(ready).select("label", vector_to_array("probability")[1].alias("p"))
    share = scored.agg(F.avg("label").alias("c"), F.count("*").alias("n")).first()
    c, n = share["c"], share["n"]
    expected = k * (1 - c) ** 2 * c / max(n, 1)
    found = scored.agg(F.avg((F.col("p") - c) ** 2).alias("pmse"))
    ratio = F.col("pmse") / expected if expected else F.lit(1.0)
    status = F.when(ratio <= 3, "PASS").when(ratio <= 5, "REVIEW").otherwise("FAIL")
    return found.select("pmse", F.lit(expected).alias("expected_pmse"), ratio.alias("pmse_ratio"), F.lit(k).alias("features"), F.lit(n).alias("rows"), status.alias("status"))
