"""Readers for delimited, fixed-width and drifting yearly files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from vicinity.functions.text import blank_to_null, sentinel_to_null


def text_schema(columns: list[str]) -> StructType:
    return StructType([StructField(c, StringType()) for c in columns])


def read_csv_text(spark: SparkSession, path: str, columns: list[str], date_columns: dict[str, str] | None = None,
                  header: bool = True) -> DataFrame:
    """CSV with every column as text; only the given date columns are parsed (bad dates are null)."""
    df = spark.read.csv(path, schema=text_schema(columns), header=header, multiLine=False)
    return df.withColumns({
        c: F.try_to_timestamp(F.col(c), F.lit(fmt)).cast("timestamp_ntz") for c, fmt in (date_columns or {}).items()})


def read_csv_header(spark: SparkSession, path: str) -> DataFrame:
    """CSV whose column names come from the file; all text, no inference pass over the data."""
    return spark.read.csv(path, header=True, inferSchema=False)


def slices_from_widths(widths: list[tuple[str, int]]) -> list[tuple[str, int, int]]:
    """``(name, start, length)`` from ``(name, width)``, starts counted from 0."""
    out, at = [], 0
    for name, width in widths:
        out.append((name, at, width))
        at += width
    return out


def split_fixed_width(df: DataFrame, slices: list[tuple[str, int, int]], line: str = "value",
                      sentinels: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """Columns cut out of a text line, trimmed, with blanks and sentinels as null."""
    def cut(start: int, length: int) -> Column:
        c = blank_to_null(F.trim(F.substring(F.col(line), start + 1, length)))
        return sentinel_to_null(c, sentinels) if sentinels else c
    return df.select(*(keep or []), *[cut(s, n).alias(name) for name, s, n in slices])


def read_fixed_width(spark: SparkSession, path: str, slices: list[tuple[str, int, int]],
                     sentinels: list[str] | None = None) -> DataFrame:
    return split_fixed_width(spark.read.text(path), slices, sentinels=sentinels)


def union_drifting(frames: list[DataFrame], renames: dict[str, str] | None = None,
                   drops: list[str] | None = None, defaults: dict[str, str] | None = None) -> DataFrame:
    """Union of files whose columns drift: lower-case, rename, drop, add defaults, fill the rest with null."""
    ready = []
    for df in frames:
        df = df.toDF(*[c.lower() for c in df.columns])
        df = df.withColumnsRenamed({k: v for k, v in (renames or {}).items() if k in df.columns})
        df = df.drop(*(drops or []))
        missing = {k: F.lit(v) for k, v in (defaults or {}).items() if k not in df.columns}
        ready.append(df.withColumns(missing) if missing else df)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ready)


def clean_rows(df: DataFrame, address: str = "address") -> DataFrame:
    """Rows with an address, exact duplicates once, address without surrounding blanks."""
    return df.where(F.col(address).isNotNull()).dropDuplicates().withColumn(address, F.trim(F.col(address)))


def parse_geocoder_lines(df: DataFrame, line: str = "value") -> DataFrame:
    """Matched lines of a batch geocoder answer: id, input, matched address parts and coordinates.

    Lines are quoted fields ``id, input, Match, exactness, "street, city, state, zip", "lon,lat", ...``.
    """
    fields = F.regexp_extract_all(F.col(line), F.lit('"([^"]*)"'), F.lit(1))
    rows = df.select(fields.alias("f")).where(F.try_element_at("f", F.lit(3)) == "Match")
    parts = F.split(F.try_element_at("f", F.lit(5)), ", ")
    place = F.split(F.try_element_at("f", F.lit(6)), ",")
    return rows.select(
        F.element_at("f", 1).alias("id"),
        F.replace(F.element_at("f", 2), F.lit(", "), F.lit(",")).alias("raw_input"),
        *[F.try_element_at(parts, F.lit(i)).alias(n) for i, n in enumerate(("address", "city", "state", "zip"), 1)],
        F.try_element_at(place, F.lit(1)).try_cast("double").alias("longitude"),
        F.try_element_at(place, F.lit(2)).try_cast("double").alias("latitude"))


def with_geocodes(df: DataFrame, matches: DataFrame, parts: list[str]) -> DataFrame:
    """Left-join matched coordinates and address parts (suffix ``_census``) by the comma-joined input."""
    found = matches.dropDuplicates(["raw_input"]).select("raw_input", "latitude", "longitude", *[
        F.col(c).alias(f"{c}_census") for c in ("address", "city", "state", "zip")])
    return df.withColumn("raw_input", F.concat_ws(",", *[F.coalesce(F.col(c), F.lit("")) for c in parts])) \
        .join(found, "raw_input", "left").drop("raw_input")


def fill_coordinates(df: DataFrame, lat: str, lon: str, other_lat: str, other_lon: str) -> DataFrame:
    """Other latitude when either coordinate is missing, then other longitude by the new latitude."""
    df = df.withColumn(lat, F.when(F.col(lat).isNull() | F.col(lon).isNull(), F.col(other_lat)).otherwise(F.col(lat)))
    return df.withColumn(lon, F.when(F.col(lat).isNull() | F.col(lon).isNull(), F.col(other_lon)).otherwise(F.col(lon)))
