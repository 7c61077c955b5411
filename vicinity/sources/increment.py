"""High-water marks: take only what is new, then move the mark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinity.operators.spatial import point_edges


def rows_after_mark(new: DataFrame, target: DataFrame | None, date_column: str) -> DataFrame:
    """Rows later than the last date of the target; everything when there is no target yet."""
    if target is None:
        return new
    mark = target.agg(F.max(date_column)).first()[0]
    return new if mark is None else new.where(F.col(date_column) > F.lit(mark))


def rows_after_id(events: DataFrame, id_column: str, last_id) -> DataFrame:
    return events if last_id is None else events.where(F.col(id_column) > F.lit(last_id))


def read_mark(marks: DataFrame, table: str, name: str = "table_name", value: str = "event_id") -> int:
    """Last processed id of a table; 0 when it has none."""
    return marks.where(F.col(name) == table).agg(F.max(value)).first()[0] or 0


def moved_mark(marks: DataFrame, table: str, events: DataFrame, id_column: str,
               name: str = "table_name", value: str = "event_id") -> DataFrame:
    """Marks with the entry of ``table`` set to the largest id seen."""
    new = events.agg(F.max(id_column).cast("long").alias(value)).select(F.lit(table).alias(name), value)
    both = marks.select(name, F.col(value).cast("long").alias(value)).unionByName(new)
    return both.groupBy(name).agg(F.max(value).alias(value))


def new_edges(parcels: DataFrame, events: DataFrame, parcel_id: str, event_id: str, metres: float, last_id) -> DataFrame:
    """Proximity edges of the events after the mark only, to be appended to the edge table."""
    return point_edges(parcels, rows_after_id(events, event_id, last_id), [parcel_id], [event_id], metres)
