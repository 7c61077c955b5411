"""Frequent levels of a category and fixed-domain dummies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vicinity.operators.order_stats import numbered

TOP_LEVELS = 15


def level_of(column: str, missing: str = "missing") -> Column:
    """Category as text with nulls as their own level."""
    return F.coalesce(F.col(column).cast("string"), F.lit(missing))


def group_code(column: str, pattern: str, missing: str = "missing") -> Column:
    """First capture of ``pattern``, or ``missing`` when the text does not match."""
    matched = F.when(F.col(column).rlike(pattern), F.regexp_extract(F.col(column), pattern, 1))
    return F.coalesce(matched, F.lit(missing))


def top_levels(df: DataFrame, categories: dict[str, Column], n: int = TOP_LEVELS) -> dict[str, tuple[list[str], bool]]:
    """Per category the ``n`` most frequent levels (ties by name) and whether rarer ones exist.

    All categories are counted in one pass; at most ``n + 1`` strings per
    category reach the driver.
    """
    if not categories:
        return {}
    cells = F.array(*[F.struct(F.lit(k).alias("category"), c.alias("level")) for k, c in categories.items()])
    counted = df.select(F.explode(cells).alias("c")).groupBy("c.category", "c.level").agg(F.count(F.lit(1)).alias("n"))
    first = Window.partitionBy("category").orderBy(F.col("n").desc(), F.col("level"))
    kept = counted.withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= n + 1).collect()
    out = {}
    for k in categories:
        mine = [r["level"] for r in sorted((r for r in kept if r["category"] == k), key=lambda r: r["rn"])]
        out[k] = (mine[:n], len(mine) > n)
    return out


def frequent_levels(df: DataFrame, level: Column, n: int = TOP_LEVELS, other: str = "other") -> DataFrame:
    """Level table ``(rnum, raw_level, count, level)`` in falling order of count."""
    counted = df.groupBy(level.alias("raw_level")).agg(F.count(F.lit(1)).alias("count"))
    ranked = numbered(counted, [F.col("count").desc(), F.col("raw_level")], "rnum")
    return ranked.select(
        "rnum", "raw_level", "count",
        F.when(F.col("rnum") <= n, F.col("raw_level")).otherwise(F.lit(other)).alias("level"))


def frequent_groups(df: DataFrame, column: str, pattern: str, n: int = TOP_LEVELS) -> DataFrame:
    """Level table of a regex group, one row per raw code behind each level.

    ``(rnum, raw_level, level, count, raw_code, raw_count)``; codes stay rows,
    so a group with very many codes is never gathered in one place.
    """
    codes = df.groupBy(group_code(column, pattern).alias("raw_level"), F.col(column).alias("raw_code")) \
        .agg(F.count(F.lit(1)).alias("raw_count"))
    counted = codes.groupBy("raw_level").agg(F.sum("raw_count").alias("count"))
    ranked = numbered(counted, [F.col("count").desc(), F.col("raw_level")], "rnum")
    return codes.join(ranked, "raw_level").select(
        "rnum", "raw_level",
        F.when(F.col("rnum") <= n, F.col("raw_level")).otherwise(F.lit("other")).alias("level"),
        "count", "raw_code", "raw_count")


def fixed_dummies(df: DataFrame, column: str, domain: list, names: list[str] | None = None) -> DataFrame:
    """A 0/1 column per allowed value; null stays null in all of them.

    A value outside the domain fails the query when it is read.
    """
    c = F.col(column)
    known = c.isNull() | c.isin(domain)
    checked = F.when(F.assert_true(known, F.concat(F.lit("value outside the domain: "), c.cast("string"))).isNull(), c)
    return df.withColumns({
        name: F.when(checked.isNotNull(), (checked == F.lit(v)).cast("int"))
        for v, name in zip(domain, names or [str(v) for v in domain])
    })
