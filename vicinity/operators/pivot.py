"""Dense and general pivots as one conditional aggregation."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinity.operators.asof import Measure
from vicinity.operators.levels import level_of, top_levels


def clean_name(name: str) -> str:
    """Column name in lower case with blanks as ``_`` and other symbols removed."""
    return "".join(c for c in name.replace(" ", "_").lower() if c.isalnum() or c == "_")


def plain_name(name: str, prefix: str | None = None) -> str:
    """Column name in lower case with runs of other symbols as one ``_``."""
    base = re.sub(r"[^0-9a-zA-Z]+", "_", name).lower()
    return f"{prefix}_{base}" if prefix else base


def with_clean_names(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    keep = keep or []
    return df.toDF(*[c if c in keep else clean_name(c) for c in df.columns])


def level_measures(df: DataFrame, categories: dict[str, Column], n: int = 15) -> list[Measure]:
    """One count per frequent level of each category, named ``<category>_<level>``.

    Levels come from the whole table, so the columns do not depend on which
    events fall into a window.
    """
    out = []
    found = top_levels(df, categories, n)
    for name, level in categories.items():
        kept, rest = found[name]
        for value in sorted(set(kept) | ({"other"} if rest else set())):
            hit = level == F.lit(value)
            if rest and value == "other":
                hit = hit | ~level.isin(kept)
            out.append(Measure(clean_name(f"{name}_{value}"), hit.cast("int")))
    return out


def text_categories(columns: list[str]) -> dict[str, Column]:
    return {c: level_of(c) for c in columns}


# Spark's own limit on the values of a pivot.
MOST_COLUMNS = 10_000


def classes_of(df: DataFrame, cls: Column) -> list[str]:
    """Sorted distinct classes; an unbounded class column is refused, not collected."""
    found = df.select(cls.alias("c")).distinct().limit(MOST_COLUMNS + 1).collect()
    if len(found) > MOST_COLUMNS:
        raise ValueError(f"more than {MOST_COLUMNS} classes to pivot")
    return sorted(r["c"] for r in found)


def count_pivot(df: DataFrame, keys: list[str], columns: list[str], values: list | None = None,
                total: str | None = "total") -> DataFrame:
    """Crosstab of counts, zero-filled, with an optional row total.

    Several class columns are joined by ``_``. Pass ``values`` to skip the pass
    that looks for them.
    """
    cls = F.concat_ws("_", *[F.col(c).cast("string") for c in columns])
    if values is None:
        values = classes_of(df, cls)
    sums = [F.sum((cls == F.lit(v)).cast("long")).alias(clean_name(str(v))) for v in values]
    if total:
        sums.append(F.count(F.lit(1)).alias(total))
    return df.groupBy(*keys).agg(*sums)


def general_pivot(df: DataFrame, keys: list[str], classes: list[str], value: str,
                  values: list[str] | None = None, default=None) -> DataFrame:
    """Wide table with one column per class combination, names joined by ``, ``.

    (key, class) must be unique; a second row for the same cell fails the query.
    """
    cls = F.concat_ws(", ", *[F.col(c).cast("string") for c in classes])
    long = df.groupBy(*keys, cls.alias("_class")).agg(
        F.first(value).alias("_value"), F.count(F.lit(1)).alias("_rows"))
    single = F.assert_true(F.col("_rows") == 1, F.lit("several rows for one pivot cell")).isNull()
    long = long.withColumn("_value", F.when(single, F.col("_value")))
    if values is None:
        values = classes_of(df, cls)
    wide = long.groupBy(*keys).pivot("_class", values).agg(F.first("_value"))
    return wide.fillna(default, subset=values) if default is not None else wide


def dense_join(keys: DataFrame, features: DataFrame, on: list[str], empty: str = "drop",
               zero_columns: list[str] | None = None) -> DataFrame:
    """Features for keys that have any (``drop``) or for all keys with zero counts (``zero``)."""
    if empty == "drop":
        return features
    counts = zero_columns or [c for c in features.columns if c not in on]
    return keys.select(*on).distinct().join(features, on, "left").fillna(0, subset=counts)


def melt(df: DataFrame, keys: list[str], columns: list[str], name: str = "feature", value: str = "value") -> DataFrame:
    typed = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns])
    return typed.unpivot(keys, columns, name, value)


def long_counts(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Counts per (key, ``<column>_<level>``) of several columns in one pass over the rows."""
    cells = F.array(*[F.concat(F.lit(f"{c}_"), level_of(c)) for c in columns])
    return df.select(*keys, F.explode(cells).alias("categ")) \
        .groupBy(*keys, "categ").agg(F.count(F.lit(1)).alias("count"))
