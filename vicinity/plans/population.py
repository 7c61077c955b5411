"""Who is looked at and when: labels, as-of populations, case maps."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vicinity.functions.dates import year_range
from vicinity.functions.text import display_address, is_residential_report
from vicinity.operators.dedupe import first_by, only_unrepeated

# Case type of inspections and the events that decide the label.
CASE_TYPE = "CBHCODE"
FIRST_EVENT = "Initial inspection"
VIOLATION_EVENTS = ["Orders issued", "Civil 1", "Civil 2", "Final notice", "Pre-prosecution status",
                    "Prosecutor approves"]

KEYS = ["parcel_id", "inspection_date"]


def labels_from_events(events: DataFrame, parcels: DataFrame, case: str = "number_key", parcel: str = "parcel_no",
                       case_type: str | None = CASE_TYPE, first_event: str = FIRST_EVENT,
                       violations: list[str] | None = None) -> DataFrame:
    """``(parcel_id, inspection_date, viol_outcome)`` from an event timeline.

    An inspected case is 1 when it has a violation event, else 0. Violation
    cases without inspection are added as 1 at the violation date. Equal rows
    count once, and keys with conflicting outcomes are dropped.
    """
    violations = violations or VIOLATION_EVENTS
    rows = events if case_type is None else events.where(F.col("comp_type") == case_type)
    rows = rows.where(F.col("event").isin([first_event, *violations])).join(parcels.select(case, parcel), case) \
        .withColumn("_viol", F.col("event") != first_event)
    of_case = Window.partitionBy(case)
    tagged = rows.withColumns({"_any_viol": F.max("_viol").over(of_case), "_any_insp": F.max(~F.col("_viol")).over(of_case)}) \
        .where(~F.col("_viol") | ~F.col("_any_insp"))
    labelled = tagged.select(
        F.col(parcel).alias("parcel_id"), F.col("date").alias("inspection_date"),
        F.col("_any_viol").cast("int").alias("viol_outcome")).distinct()
    return only_unrepeated(labelled, KEYS)


def everyone_at(parcels: DataFrame, parcel: str, when: date | str) -> DataFrame:
    """Every distinct parcel at one as-of date, outcome unknown."""
    return parcels.select(F.col(parcel).alias("parcel_id")).distinct().select(
        "parcel_id", F.lit(str(when)).cast("timestamp_ntz").alias("inspection_date"),
        F.lit(None).cast("int").alias("viol_outcome"))


def field_test_population(inspections: DataFrame, when: date | str | None = None) -> DataFrame:
    """A fixed list of inspections, optionally moved to one as-of date."""
    rows = inspections.select("parcel_id", "inspection_date", "viol_outcome")
    return rows if when is None else rows.withColumn("inspection_date", F.lit(str(when)).cast("timestamp_ntz"))


def with_coordinates(df: DataFrame, parcels: DataFrame, parcel: str = "parcel_id") -> DataFrame:
    return df.join(parcels.select(parcel, "latitude", "longitude"), parcel, "left")


def inspections_in_years(inspections: DataFrame, parcels: DataFrame, first: int, last: int | None = None,
                         violations_only: bool = False) -> DataFrame:
    """Inspections (or violations) of a year range with coordinates."""
    rows = inspections.where(year_range("inspection_date", first, last))
    if violations_only:
        rows = rows.where(F.col("viol_outcome") == 1).drop("viol_outcome")
    return rows.join(parcels.select("parcel_id", "latitude", "longitude"), "parcel_id")


def any_interaction(parcels: DataFrame, events: DataFrame, parcel: str = "parcel_id") -> DataFrame:
    """Flag parcels with at least one event."""
    seen = events.select(parcel).distinct().withColumn("any_interaction", F.lit(True))
    return parcels.join(seen, parcel, "left").fillna(False, subset=["any_interaction"])


def parcel_info(parcels: DataFrame, areas: DataFrame, events: DataFrame) -> DataFrame:
    """Report columns per parcel: residential flag, area columns, display address and last event.

    Of several events on the last day the first by name is kept.
    """
    latest = events.groupBy("parcel_id").agg(F.max("date").alias("date"))
    last = first_by(events.join(latest, ["parcel_id", "date"]), ["parcel_id"], [F.col("event"), F.col("comp_type")]).select(
        "parcel_id", F.col("date").alias("last_interaction"), F.col("comp_type").alias("last_interaction_type"),
        F.col("event").alias("last_interaction_event"))
    placed = areas.withColumn("address", display_address(F.col("addrno"), F.col("addrst"), F.col("addrsf"))) \
        .drop("addrno", "addrst", "addrsf")
    return parcels.select("parcel_id", is_residential_report(F.col("class")).alias("residential")) \
        .join(placed, "parcel_id", "left").join(last, "parcel_id", "left")


def residential_only(df: DataFrame, parcels: DataFrame, rule: Column, parcel: str = "parcel_id") -> DataFrame:
    return df.join(parcels.where(rule).select(parcel).distinct(), parcel, "left_semi")
