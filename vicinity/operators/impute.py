"""Imputation and scaling; statistics are fitted in one pass and applied as literals."""

from __future__ import annotations

from pyspark.ml.feature import Imputer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinity.operators.order_stats import exact_quantiles, known


def finite(column: str) -> Column:
    """Value with NaN and infinities read as missing."""
    c = F.col(column).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def median_fill(df: DataFrame, columns: list[str], strategy: str = "median") -> DataFrame:
    """Fill missing values (null and NaN) with the column median of the loaded rows (or zero).

    A column without any value stays as it is.
    """
    if strategy == "zero":
        return df.fillna(0, subset=columns)
    medians = exact_quantiles(df, columns, [0.5])
    fills = {c: v[0] for c, v in medians.items() if v[0] is not None}
    return df.withColumns({c: F.coalesce(known(df, c).cast("double"), F.lit(v)) for c, v in fills.items()})


def mean_fill_flagged(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Fill with the mean of the finite values and flag filled rows in ``imputation_<column>``.

    A column without any finite value is an error.
    """
    columns = columns or df.columns
    means = df.agg(*[F.avg(finite(c)).alias(c) for c in columns]).first()
    empty = [c for c in columns if means[c] is None]
    if empty:
        raise ValueError(f"no values to impute from: {', '.join(empty)}")
    out = {}
    for c in columns:
        out[c] = F.coalesce(finite(c), F.lit(means[c]))
        out[f"imputation_{c}"] = finite(c).isNull().cast("int")
    return df.withColumns(out)


def fit_mean_imputer(train: DataFrame, columns: list[str]):
    """Column-mean imputer fitted on the training rows; use ``.transform`` on any rows."""
    doubles = [c for c in columns]
    return Imputer(strategy="mean", inputCols=doubles, outputCols=doubles).fit(
        train.withColumns({c: F.col(c).cast("double") for c in doubles}))


class StandardScale:
    """Centre and divide by the population standard deviation; constant columns are only centred, missing values stay."""

    def __init__(self, columns: list[str]):
        self.columns = columns
        self.stats: dict[str, tuple[float, float]] = {}

    def fit(self, df: DataFrame) -> "StandardScale":
        aggs = []
        for c in self.columns:
            aggs += [F.avg(known(df, c)).alias(f"m_{c}"), F.stddev_pop(known(df, c)).alias(f"s_{c}")]
        row = df.agg(*aggs).first()
        self.stats = {c: (row[f"m_{c}"] or 0.0, row[f"s_{c}"] or 1.0) for c in self.columns}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({
            c: (F.col(c) - F.lit(mean)) / F.lit(std) for c, (mean, std) in self.stats.items()})
