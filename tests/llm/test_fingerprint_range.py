import pytest
from pyspark.sql import functions as F

from passagekit.llm import fingerprint as P


@pytest.mark.parametrize("n", [9_000, 20_000, 70_000])
def test_likeness_of_a_line_repeated_very_often(spark, n):
    df = spark.createDataFrame([("same\n" * n, "same\n" * (n * 2 // 3), "same\n" * (n - n * 2 // 3))], "a string, b string, c string")
    for c in df.columns:
        df = P.with_fingerprint(df, c, f"f{c}").withColumn(f"p{c}", P._projections(F.col(f"f{c}")))
    r = df.select(P.likeness(F.col("fa"), F.col("fb"), F.col("pa"), F.col("pb")).alias("near"), P.combine(F.col("fb"), F.col("fc")).alias("sum"), P.remove(F.col("fa"), F.col("fc")).alias("rest"), "fa", "fb").first()
    assert abs(r.near - 12 / 13) < 0.01
    assert r.sum == r.fa and r.rest == r.fb
