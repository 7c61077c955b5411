"""Point-in-time data sets: temporal split, feature assembly and imputation."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinity.functions.dates import between_days
from vicinity.operators.impute import median_fill
from vicinity.session import stable

KEYS = ["parcel_id", "inspection_date"]
OUTCOME = "viol_outcome"


def parse_day(text: str) -> datetime:
    """``01Jan2015`` style dates of run configurations."""
    return datetime.strptime(text, "%d%b%Y")


def _month_end(day: datetime) -> datetime:
    first_next = (day.replace(day=1) + timedelta(days=32)).replace(day=1)
    return first_next - timedelta(days=1)


def window_end(fake_today: datetime, window: str) -> datetime:
    """End of the validation window: ``6Month`` counts month ends, ``30Day`` counts days.

    The first month end on or after the start is element one of the range, the
    end is the next element, ``n`` months later.
    """
    found = re.match(r"(\d+)(\w+)", window)
    if not found:
        raise ValueError(f"bad validation window {window!r}")
    n, unit = int(found.group(1)), found.group(2).lower()
    if unit == "day":
        return fake_today + timedelta(days=n)
    if unit != "month":
        raise ValueError("validation window units are Month or Day")
    first = _month_end(fake_today)
    month = first.month - 1 + n
    return _month_end(first.replace(year=first.year + month // 12, month=month % 12 + 1, day=1))


@dataclass(frozen=True)
class Split:
    start: datetime
    fake_today: datetime
    end: datetime


def temporal_split(config: dict, last_inspection: datetime) -> Split:
    """Train ``[start, fake_today)``, test ``[fake_today, end)``; fails beyond the last inspection."""
    start = parse_day(config.get("start_date", "01Jan1970"))
    today = parse_day(config["fake_today"])
    end = window_end(today, config["validation_window"])
    if start > last_inspection or end > last_inspection:
        raise ValueError(f"dates go beyond the last inspection {last_inspection:%d%b%Y}")
    return Split(start, today, end)


def split_rows(df: DataFrame, split: Split, when: str = "inspection_date") -> tuple[DataFrame, DataFrame]:
    return (df.where(between_days(when, split.start, split.fake_today)),
            df.where(between_days(when, split.fake_today, split.end)))


def labels_between(population: DataFrame, start, end, parcels: DataFrame | None = None,
                   rule: Column | None = None) -> DataFrame:
    """Keys and outcomes of ``[start, end)``, optionally only parcels that meet ``rule``."""
    rows = population.where(between_days("inspection_date", start, end)).select(*KEYS, OUTCOME)
    if rule is not None:
        rows = rows.join(parcels.where(rule).select("parcel_id").distinct(), "parcel_id", "left_semi")
    return rows


def assemble(labels: DataFrame, tables: dict[str, DataFrame], features: list[tuple[str, str]],
             impute: str | None = "median") -> DataFrame:
    """Left-join the chosen features of every table to the labels, columns named ``table_column``.

    Tables with both keys are joined first and those keyed only by parcel after
    them, so the labels are shuffled at most twice, however many tables there are;
    tables bucketed by their keys are not shuffled (``FeatureStore.set_buckets``). Of rows that repeat a key the
    first in the order of the chosen columns counts, nulls last. Missing values are filled per column from the joined rows.
    """
    grouped: dict[str, list[str]] = {}
    for table, column in features:
        grouped.setdefault(table, []).append(column)
    out = labels
    names = [f"{t}_{c}" for t, columns in grouped.items() for c in columns]
    for table, columns in sorted(grouped.items(), key=lambda g: -len([k for k in KEYS if k in tables[g[0]].columns])):
        df = tables[table]
        keys = [k for k in KEYS if k in df.columns]
        missing = [c for c in columns if c not in df.columns]
        if missing:
            raise ValueError(f"unknown features in {table}: {missing}")
        picked = F.min(F.struct(*[e for c in columns for e in (F.col(c).isNull().alias(f"_n_{c}"), F.col(c).alias(c))])).alias("_p")
        part = df.groupBy(*keys).agg(picked).select(*keys, *[F.col(f"_p.{c}").alias(f"{table}_{c}") for c in columns])
        out = out.join(part, keys, "left")
    out = out.select(*labels.columns, *names)
    if impute == "median":
        # Read by every pass of the exact medians, each of which merges one sketch a task in one place: buckets
        # are many and small, so the tasks that read them are as many as a shuffle has.
        out = stable(out).coalesce(int(out.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return median_fill(out, names, impute) if impute else out


def shuffled(df: DataFrame, seed: int) -> DataFrame:
    """Rows in pseudo-random order; only for the last step before a sink."""
    return df.orderBy(F.xxhash64(*KEYS, F.lit(seed)))


def feature_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in (*KEYS, OUTCOME)]
