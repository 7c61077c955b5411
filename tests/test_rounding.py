"""Rounding of query results."""

from pyspark.sql import functions as F

from vicinity.queries.roles import rounded


def test_rounding_is_that_of_decimals(spark):
    """Ties, large and missing values included; where no tie is near, whole numbers do it."""
    some = spark.range(60_000).select(((F.rand(1) - 0.5) * F.pow(F.lit(10.0), F.rand(2) * 24 - 8)).alias("v"))
    ties = spark.range(-3000, 3000).select(((F.col("id") * 2 + 1) / 16).alias("v")).unionByName(
        spark.range(-3000, 3000).select((F.col("id") / F.lit(2e6)).alias("v")))
    odd = spark.createDataFrame([(float(v),) for v in ("nan", "inf", "-inf", "-0.0", "1e300", "5e-324")] + [(None,)], "v double")
    df = some.unionByName(ties).unionByName(odd)
    for digits in (0, 3, 6, 7):
        both = rounded(df.withColumn("w", F.round("v", digits)), ["v"], digits)
        assert both.where(~F.col("v").eqNullSafe(F.col("w"))).count() == 0
    plan = rounded(df, ["v"])._jdf.queryExecution().optimizedPlan().toString()
    assert "FLOOR" in plan.upper()
