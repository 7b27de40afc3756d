"""Bounded samples."""

from pyspark.sql import functions as F

from lumatab.operators.sampling import smallest


def test_smallest_is_the_same_with_and_without_the_bound(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("k"))
    want = [r.k for r in df.orderBy(F.md5("k")).limit(50).collect()]
    assert [r.k for r in smallest(df.repartition(7), F.md5("k"), ["k"], 50).collect()] == want
    assert smallest(df.limit(10), F.md5("k"), ["k"], 50).count() == 10
