"""Column profiles, bounds and missing-value checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinity.operators.order_stats import exact_quantiles, known


def bounds(df: DataFrame, column: str) -> DataFrame:
    """``(low, high)`` of one existing column."""
    if column not in df.columns:
        raise ValueError(f"unknown column {column!r}")
    return df.agg(F.min(column).alias("low"), F.max(column).alias("high"))


def null_shares(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Share of missing values (null and NaN) per column, long."""
    columns = columns or df.columns
    wide = df.agg(*[F.avg(known(df, c).isNull().cast("double")).alias(c) for c in columns])
    return wide.unpivot([], columns, "column", "null_share")


def require_complete(df: DataFrame, threshold: float = 0.5, columns: list[str] | None = None) -> DataFrame:
    """Fail with the offending columns when more than ``threshold`` of their values are missing."""
    bad = null_shares(df, columns).where(F.col("null_share") > threshold).orderBy("column").collect()
    if bad:
        raise ValueError("too many missing values: " + ", ".join(f"{r['column']} ({r['null_share']:.2f})" for r in bad))
    return df


def column_profile(df: DataFrame, numeric: list[str], text: list[str]) -> DataFrame:
    """One row per column: count, missing share, distinct, top, freq, mean, std, quartiles, extremes.

    Distinct values are folded per (column, value) before they are counted, so
    frequent values cost one row; quartiles are exact and interpolated. Null and
    NaN are missing everywhere.
    """
    columns = numeric + text
    cells = F.array(*[F.struct(F.lit(c).alias("column"), known(df, c).cast("string").alias("v")) for c in columns])
    values = df.select(F.explode(cells).alias("m")).groupBy("m.column", "m.v").agg(F.count(F.lit(1)).alias("n"))
    held = F.col("v").isNotNull()
    shape = values.groupBy("column").agg(
        F.sum(F.when(held, F.col("n")).otherwise(0)).alias("count"),
        (F.sum(F.when(held, 0).otherwise(F.col("n"))) / F.sum("n")).alias("missing"),
        F.count(F.when(held, 1)).alias("distinct"),
        F.min_by(F.when(held, F.col("v")), F.when(held, F.struct(-F.col("n"), F.col("v")))).alias("top"),
        F.max(F.when(held, F.col("n"))).alias("freq"))
    typed = F.array(*[F.struct(F.lit(c).alias("column"), known(df, c).cast("double").alias("v")) for c in numeric])
    moments = df.select(F.explode(typed).alias("m")).groupBy("m.column").agg(
        F.avg("m.v").alias("mean"), F.stddev_samp("m.v").alias("std"),
        F.min("m.v").alias("min"), F.max("m.v").alias("max"))
    quartiles = exact_quantiles(df, numeric, [0.25, 0.5, 0.75])
    rows = [(c, *quartiles[c]) for c in numeric]
    table = df.sparkSession.createDataFrame(rows, "column string, q25 double, q50 double, q75 double")
    return shape.join(moments, "column", "left").join(table, "column", "left")


def repeated_rows(df: DataFrame) -> DataFrame:
    """Number of surplus equal rows."""
    folded = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    return folded.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long").alias("duplicate_rows"))
