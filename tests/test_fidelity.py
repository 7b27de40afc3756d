"""Literal frames with known distances, and laws that hold for any tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumatab.operators import association, divergence


def frame(spark, schema, rows):
    return spark.createDataFrame(rows, schema)


def test_wasserstein_shift(spark):
    a, b = frame(spark, "x double", [(0.0,), (1.0,), (2.0,)]), frame(spark, "x double", [(1.0,), (2.0,), (3.0,)])
    row = divergence.distribution_distance(a, b, ["x"]).first()
    assert row.wasserstein == pytest.approx(1.0) and row.similarity == pytest.approx(0.5) and row.ks == pytest.approx(1 / 3)


def test_tvd(spark):
    a, b = frame(spark, "g string", [("A",), ("A",), ("B",), ("C",)]), frame(spark, "g string", [("A",), ("B",), ("B",), ("B",)])
    assert divergence.categorical_divergence(a, b, ["g"]).first().tvd == pytest.approx(0.5)


def test_null_is_a_category_and_no_number(spark):
    a, b = frame(spark, "g string, x double", [(None, None), ("A", 1.0)]), frame(spark, "g string, x double", [("A", 1.0), ("A", float("nan"))])
    assert divergence.categorical_divergence(a, b, ["g"]).first().tvd == pytest.approx(0.5)
    assert divergence.distribution_distance(a, b, ["x"]).first().wasserstein == 0.0
    empty = divergence.distribution_distance(a.where("false"), b, ["x"]).first()
    assert empty.wasserstein is None and empty.similarity is None


def test_jsd_matches_a_direct_sum(spark):
    r = np.random.default_rng(1)
    x, y = r.normal(size=300), r.normal(0.3, 1.2, size=200)
    a = frame(spark, "x double", [(float(v),) for v in x] + [(None,)] * 11)
    b = frame(spark, "x double", [(float(v),) for v in y])
    edges = np.linspace(min(x.min(), y.min()), max(x.max(), y.max()), 21)
    p = np.append(np.histogram(x, edges)[0], 11) + 1e-12
    q = np.append(np.histogram(y, edges)[0], 0) + 1e-12
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    want = (np.sum(p * np.log(p / m)) + np.sum(q * np.log(q / m))) / 2
    assert divergence.numerical_jsd(a, b, ["x"]).first().jsd == pytest.approx(want, abs=1e-9)
    table = divergence.distribution_table(a, b, ["x"])
    assert table.count() == 21 and table.where("bin = 0").first().original_count == 11


def test_one_value_only(spark):
    a, b = frame(spark, "x double", [(2.0,), (2.0,), (None,)]), frame(spark, "x double", [(2.0,)])
    got = divergence.histogram(a, b, ["x"]).orderBy("bin").collect()
    assert [(r.bin, r.n0, r.n1) for r in got] == [(0, 1, 0), (1, 2, 1)]


def test_self_comparison_is_perfect(spark):
    df = spark.range(500).select((F.col("id") % 7).cast("double").alias("x"), (F.col("id") * 3 % 11).cast("double").alias("y"), (F.col("id") % 3).cast("string").alias("g"), (F.col("id") % 5).cast("string").alias("h"))
    again = df.repartition(5)
    assert divergence.categorical_divergence(df, again, ["g"]).first().jsd == pytest.approx(0, abs=1e-9)
    assert divergence.numerical_jsd(df, again, ["x"]).first().jsd == pytest.approx(0, abs=1e-9)
    assert divergence.distribution_distance(df, again, ["x"]).first().wasserstein == 0
    for spearman in (False, True):
        assert association.correlation_score(association.correlation_preservation(df, again, ["x", "y"], spearman)).first().score == pytest.approx(1)
    assert association.association_score(association.association_preservation(df, again, ["g", "h"])).first().score == pytest.approx(1)


def test_spearman_ranks_share_ties(spark):
    df = frame(spark, "x double, y double", [(1.0, 1.0), (1.0, 5.0), (2.0, 7.0), (9.0, 7.0), (3.0, None)])
    got = sorted(map(tuple, association.ranks(df, ["x", "y"]).collect()))
    assert got == [(1.5, 1.0), (1.5, 2.0), (3.0, 3.5), (4.0, 3.5)]


def test_cramers_v(spark):
    df = spark.range(40).select((F.col("id") % 4).cast("string").alias("a"), (F.col("id") % 4).cast("string").alias("b"), F.lit("k").alias("c"))
    got = {r.pair: r.v for r in association.cramers_v(df, ["a", "b", "c"]).collect()}
    assert got["a x b"] >= 0.99 and got["a x c"] == 0 and len(got) == 3


def test_ks_p_value():
    assert divergence.ks_p_value(0.0, 100, 100) == 1.0
    assert divergence.ks_p_value(0.5, 200, 200) < 1e-9
    assert divergence.ks_p_value(0.136, 200, 200) == pytest.approx(0.05, abs=0.01)


def test_propensity_of_alike_and_unlike_tables(spark):
    df = spark.range(400).select((F.hash("id") % 100).cast("double").alias("x"), (F.col("id") % 3).cast("string").alias("g"))
    same = association.propensity(df, df, ["x"], ["g"]).first()
    far = association.propensity(df, df.withColumn("x", F.col("x") + 400), ["x"], ["g"]).first()
    assert same.status == "PASS" and far.status == "FAIL" and math.isfinite(far.pmse)


def test_top_categories(spark):
    a, b = frame(spark, "g string", [("x",)] * 3 + [("y",)] * 2 + [(None,)]), frame(spark, "g string", [("y",)] * 2 + [("z",)])
    got = [(r.place, r.label, r.original_count, r.derived_count) for r in divergence.top_categories(a, b, ["g"], 3).orderBy("place").collect()]
    assert got == [(1, "y", 2, 2), (2, "x", 3, 0), (3, None, 1, 0)]
