"""Event rates per area: rolling year and clamped month index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vicinity.functions import dates
from vicinity.operators.asof import Measure, window_totals


def population_by(df: DataFrame, area: str, persons: Column) -> DataFrame:
    return df.groupBy(area).agg(F.sum(persons).alias("population"))


def area_rate_year(asof: DataFrame, events: DataFrame, population: DataFrame, area: str, event_time: str,
                   asof_time: str) -> DataFrame:
    """Events strictly between ``d - 1 year`` and ``d`` per head, for each (area, d) with events.

    As-of dates are days at midnight. The window is read at day grain, so an
    area with a third of all events is one row per day; events at the very
    start of the window are taken out by an equi-join on the moment.
    """
    counted = window_totals(events, asof, area, event_time, asof_time,
                            [Measure("events", F.lit(1))], months=12)
    start = F.col(asof_time) - F.make_interval(years=F.lit(1))
    counted = counted.where(F.col("events") > 0).withColumn("_start", start)
    exact = events.groupBy(area, F.col(event_time).cast("timestamp_ntz").alias("_start")) \
        .agg(F.count(F.lit(1)).alias("_same"))
    rates = counted.join(exact, [area, "_start"], "left") \
        .withColumn("events", F.col("events") - F.coalesce("_same", F.lit(0))) \
        .where(F.col("events") > 0)
    return rates.join(population, area).select(
        area, asof_time, "events",
        F.try_divide(F.col("events").cast("double"), F.col("population").cast("double")).alias("rate"))


def area_rate_months(asof: DataFrame, events: DataFrame, population: DataFrame, area: str, event_time: str,
                     asof_time: str, days: int, first_year: int, months: int) -> DataFrame:
    """Events in whole months ``[index(d - days), index(d))`` per head.

    Month indexes are clamped to ``[0, months - 1]``. Unknown areas count 0
    events, unknown population gives a null rate. Running monthly totals (at
    most ``months`` rows per area) are read at both ends of the window.
    """
    index = lambda c: dates.month_index(c, first_year, months)
    monthly = events.where(F.col(area).isNotNull()).groupBy(area, index(F.col(event_time)).alias("_m")) \
        .agg(F.count(F.lit(1)).alias("_n"))
    grown = Window.partitionBy(area).orderBy("_m").rowsBetween(Window.unboundedPreceding, 0)
    steps = monthly.withColumn("_cum", F.sum("_n").over(grown))
    span = Window.partitionBy(area).orderBy("_m")
    steps = steps.withColumn("_until", F.coalesce(F.lead("_m").over(span), F.lit(months)))
    # one row per (area, month index): total of all months before it
    before = steps.select(
        area, "_cum", F.explode(F.sequence(F.col("_m") + 1, F.col("_until"))).alias("_i"))
    d = F.col(asof_time).cast("timestamp_ntz")
    ends = asof.withColumns({"_lo": index(d - F.make_interval(days=F.lit(days))), "_hi": index(d)})
    at = lambda name: before.select(area, F.col("_i").alias(name), F.col("_cum").alias(f"{name}_cum"))
    counted = ends.join(at("_lo"), [area, "_lo"], "left").join(at("_hi"), [area, "_hi"], "left") \
        .withColumn("events", F.greatest(
            F.coalesce("_hi_cum", F.lit(0)) - F.coalesce("_lo_cum", F.lit(0)), F.lit(0)))
    return counted.join(population, area, "left").select(
        *asof.columns, "events",
        F.try_divide(F.col("events").cast("double"), F.col("population").cast("double")).alias("rate"))
