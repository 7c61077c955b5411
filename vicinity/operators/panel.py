"""Yearly panels: means and changes over the years before an as-of date, flags and owners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinity.operators.asof import prior_years


def _once_a_year(asof: DataFrame, panel: DataFrame, entity: str, asof_time: str, year: str, measures: list[Column],
                 years: int) -> DataFrame:
    """Measures of the prior years per distinct (entity, as-of date), made once per (entity, as-of year)."""
    dates = asof.select(entity, asof_time).distinct().withColumn("_year", F.year(asof_time))
    wanted = asof.select(entity, F.make_date(F.year(asof_time), F.lit(1), F.lit(1)).alias("_new_year")).distinct()
    made = prior_years(wanted, panel, entity, "_new_year", year, years).groupBy(entity, F.year("_new_year").alias("_year")).agg(*measures)
    return dates.join(made, [entity, "_year"]).drop("_year")


def panel_features(asof: DataFrame, panel: DataFrame, entity: str, asof_time: str, year: str,
                   values: dict[str, str], years: int = 3) -> DataFrame:
    """Mean, last-minus-first change and relative change over the prior years.

    ``values`` maps panel columns to output stems. Changes are null when only
    one year is known; a zero first value gives a null relative change.
    """
    single = F.min(year) == F.max(year)
    out = []
    for column, stem in values.items():
        first, last = F.min_by(column, year), F.max_by(column, year)
        out += [
            F.avg(column).alias(f"mean_{stem}"),
            F.when(~single, last - first).alias(f"change_{stem}"),
            F.when(~single, F.try_divide((last - first).cast("double"), first.cast("double")))
            .alias(f"rel_change_{stem}"),
        ]
    return _once_a_year(asof, panel, entity, asof_time, year, out, years)


def flagged_years(asof: DataFrame, panel: DataFrame, entity: str, asof_time: str, year: str, flag: str,
                  name: str, years: int = 3) -> DataFrame:
    """Number of prior years with the flag set."""
    total = F.sum(F.col(flag).cast("int").cast("double")).alias(name)
    return _once_a_year(asof, panel, entity, asof_time, year, [total], years)


# Years an owner count exists for; 2005 to 2007 have no owner data yet.
OWNER_YEARS = range(2007, 2016)
FIRST_COUNTED, LAST_COUNTED = 2008, 2015


def organisation_years(wide: DataFrame, asof_time: str, prefix: str = "owner_",
                       tag: str = "ORGANIZATION", name: str = "owner_ner") -> DataFrame:
    """Years among the prior three with an organisation as owner, by as-of year.

    ``wide`` has one ``owner_<year>`` column per year. The first years use the
    columns that exist; years outside the range give null.
    """
    def hits(year: int) -> Column:
        prior = [y for y in range(year - 3, year) if y in OWNER_YEARS]
        total = F.lit(0)
        for y in prior:
            total = total + F.when(F.col(f"{prefix}{y}") == tag, 1).otherwise(0)
        return total
    asof_year = F.year(asof_time)
    count = F.lit(None).cast("int")
    for y in range(FIRST_COUNTED, LAST_COUNTED + 1):
        count = F.when(asof_year == y, hits(y)).otherwise(count)
    return wide.withColumn(name, count)


def properties_owned(population: DataFrame, holdings: DataFrame, entity: str, owner: str) -> DataFrame:
    """Number of holdings of the owner, for each row of the population and each holding of it."""
    known = holdings.where(F.col(owner).isNotNull())
    counts = known.groupBy(owner).agg(F.count(F.lit(1)).alias("num_properties_owned"))
    return population.join(known.select(entity, owner), entity).join(counts, owner) \
        .select(*population.columns, "num_properties_owned")


def stacked_events(sources: list[tuple[DataFrame, list[tuple[str, str, str]]]], case: str, case_type: str,
                   first_year: int | None = 2013) -> DataFrame:
    """Event timeline ``(case, case_type, date, event)`` from date columns scattered over tables.

    Each source comes with ``(case type, date column, event name)`` entries; its
    columns are turned into rows in one pass over the table. Null dates go, and
    equal rows are kept once.
    """
    parts = []
    for df, entries in sources:
        cells = F.array(*[
            F.when(F.col(case_type) == kind, F.struct(
                F.col(column).cast("timestamp_ntz").alias("date"), F.lit(event).alias("event")))
            for kind, column, event in entries])
        parts.append(
            df.select(case, case_type, F.explode(F.array_compact(cells)).alias("_c"))
            .select(case, case_type, "_c.date", "_c.event").where(F.col("date").isNotNull()))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    if first_year is not None:
        rows = rows.where(F.col("date") >= F.lit(f"{first_year}-01-01").cast("timestamp_ntz"))
    return rows.distinct()


def yearly_union(tables: dict[int, DataFrame], columns: dict[str, Column], year: str = "year") -> DataFrame:
    """Panel from yearly tables: the same projection of each, tagged by year, equal rows once."""
    rows = None
    for y, df in tables.items():
        part = df.select(F.lit(y).alias(year), *[c.alias(n) for n, c in columns.items()])
        rows = part if rows is None else rows.unionByName(part)
    return rows.distinct()
