"""Row selection by key. All of these fold map-side, so a hot key stays cheap."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _packed(df: DataFrame, keys: list[str]) -> Column:
    return F.struct(*[F.col(c) for c in df.columns if c not in keys])


def _unpack(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    return df.select(*[F.col(c) if c in keys else F.col("_row").getField(c).alias(c) for c in columns])


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in the given order (make the order total)."""
    folded = df.groupBy(*keys).agg(F.min_by(_packed(df, keys), F.struct(*order)).alias("_row"))
    return _unpack(folded, keys, df.columns)


def last_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the last in the given order, as a latest-interaction lookup needs."""
    folded = df.groupBy(*keys).agg(F.max_by(_packed(df, keys), F.struct(*order)).alias("_row"))
    return _unpack(folded, keys, df.columns)


def only_unrepeated(df: DataFrame, keys: list[str]) -> DataFrame:
    """Drop every row whose key occurs more than once."""
    others = [c for c in df.columns if c not in keys]
    folded = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in others])
    return folded.where(F.col("_n") == 1).select(*df.columns)


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def drop_lowest_of_repeated(df: DataFrame, key: str, serial: str) -> DataFrame:
    """Delete the row with the smallest serial of every repeated key, once."""
    lowest = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.min(serial).alias(serial)) \
        .where(F.col("_n") > 1).select(key, serial)
    return df.join(lowest, [key, serial], "left_anti")


def by_priority(sources: list[DataFrame], keys: list[str], tie: str) -> DataFrame:
    """Union of sources in falling priority, keeping the first row per key; null keys go."""
    tagged = [s.withColumn("_source", F.lit(i)) for i, s in enumerate(sources)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    return first_by(rows, keys, [F.col("_source"), F.col(tie)]).drop("_source")


def not_yet_known(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is absent from ``known`` (null keys of ``known`` never match)."""
    return rows.join(known.select(*keys).dropna().distinct(), keys, "left_anti")


def backfill(rows: DataFrame, lookup: DataFrame, on: list[str], column: str) -> DataFrame:
    """Fill missing values of ``column`` from a lookup with unique keys."""
    found = lookup.select(*on, F.col(column).alias("_found"))
    return rows.join(found, on, "left") \
        .withColumn(column, F.coalesce(F.col(column), F.col("_found"))).drop("_found") \
        .select(*rows.columns)


def single_value_cases(df: DataFrame, case: str, value: str, primary: Column | None = None) -> DataFrame:
    """Cases with exactly one distinct (primary) value: ``(case, value)`` with the value trimmed."""
    rows = df if primary is None else df.where(primary)
    folded = rows.groupBy(case, value).agg(F.count(F.lit(1)).alias("_n")) \
        .groupBy(case).agg(F.count(value).alias("_values"), F.max(value).alias(value))
    return folded.where(F.col("_values") == 1).select(case, F.trim(F.col(value).cast("string")).alias(value))


def one_inspection_per_entity(df: DataFrame, entity: str, when: str, outcome: str) -> DataFrame:
    """Earliest date, any-violation outcome and violation count per entity in one aggregate."""
    count = F.sum(outcome)
    return df.groupBy(entity).agg(
        F.min(when).alias(when), count.cast("long").alias("viol_count"),
        F.when(count > 0, 1).otherwise(0).alias("viol_outcome"))


def inspection_results(df: DataFrame, entity: str, when: str, outcome: str) -> DataFrame:
    """Violations, non-violations and inspections per entity, several on one day counting once."""
    daily = df.groupBy(entity, when).agg(F.max(F.when(F.col(outcome) == 1, 1).otherwise(0)).alias("_o"))
    return daily.groupBy(entity).agg(
        F.sum("_o").alias("violations"), F.sum(1 - F.col("_o")).alias("non_violations"),
        F.count(F.lit(1)).alias("inspections"))


def groups_of(df: DataFrame, key: Column, name: str = "group") -> DataFrame:
    """Rows tagged with the group of a key expression and its size (no group is gathered)."""
    tagged = df.withColumn(name, key)
    sizes = tagged.groupBy(name).agg(F.count(F.lit(1)).alias(f"{name}_size"))
    return tagged.join(sizes, name)


def align_by(df: DataFrame, key: str, period: str, value: str, periods: list, prefix: str) -> DataFrame:
    """Full-outer alignment over periods: one column per period, null where absent."""
    wide = df.groupBy(key).pivot(period, periods).agg(F.max(value))
    return wide.select(key, *[F.col(f"`{p}`").alias(f"{prefix}{p}") for p in periods])
