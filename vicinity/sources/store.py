"""Feature store: namespaces of parquet tables, pattern selection and result tables."""

from __future__ import annotations

import re
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType,
                               TimestampNTZType)


def namespace(asof: date | datetime | None = None, field_test: bool = False) -> str:
    """``features[_field_test][_ddmonyyyy]``."""
    name = "features_field_test" if field_test else "features"
    return f"{name}_{asof:%d%b%Y}".lower() if asof else name


def table_name(feature: str, metres: int | None = None, months: int | None = None) -> str:
    return feature if metres is None else f"{feature}_{metres}m_{months}months"


def _checked(name: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9_]+", name):
        raise ValueError(f"bad table or namespace name {name!r}")
    return name


KEY_COLUMNS = ("parcel_id", "inspection_date", "viol_outcome")
#: Rows of the population in a bucket, and the property that keeps a namespace's number of buckets.
ROWS_PER_BUCKET, _BUCKETS = 2_000_000, "buckets"


class FeatureStore:
    """Tables in catalog databases, one database per namespace."""

    def __init__(self, spark: SparkSession, space: str):
        self.spark = spark
        self.space = _checked(space)
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {self.space}")

    def set_buckets(self, rows: int, per_bucket: int = ROWS_PER_BUCKET) -> int:
        """Number of buckets of the namespace, from the rows of its population; kept with the namespace.

        From then on tables are bucketed by the keys they have, all in this number, so that they are joined
        with each other and with labels without being shuffled. At least as many as shuffle partitions: Spark
        would shuffle tables in fewer buckets again.
        """
        buckets = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_bucket), 1)
        self.spark.sql(f"ALTER DATABASE {self.space} SET DBPROPERTIES ('{_BUCKETS}' = '{buckets}')")
        return buckets

    def buckets(self) -> int | None:
        """The number set for the namespace, if there is one."""
        rows = self.spark.sql(f"DESCRIBE DATABASE EXTENDED {self.space}").where("info_name = 'Properties'").collect()
        found = re.search(rf"\({_BUCKETS},(\d+)\)", rows[0]["info_value"]) if rows else None
        return int(found.group(1)) if found else None

    def _full(self, table: str) -> str:
        return f"{self.space}.{_checked(table)}"

    def exists(self, table: str) -> bool:
        return self.spark.catalog.tableExists(self._full(table))

    def write(self, df: DataFrame, table: str, bucket_by: str | list[str] | None = None, buckets: int | None = None) -> None:
        """Replace a table.

        With a number of buckets given, or set for the namespace, the table is bucketed by ``bucket_by`` or
        by the keys it has, one file a bucket. Tables bucketed by all keys of a join, in the same number, are
        joined without a shuffle; bucketing by fewer keys does not spare it.
        """
        buckets = buckets or self.buckets()
        keys = [bucket_by] if isinstance(bucket_by, str) else bucket_by or [k for k in KEY_COLUMNS[:2] if k in df.columns]
        if buckets and keys:
            writer = df.repartition(buckets, *keys).write.mode("overwrite").format("parquet").bucketBy(buckets, *keys).sortBy(*keys)
        else:
            writer = df.write.mode("overwrite").format("parquet")
        writer.saveAsTable(self._full(table))

    def drop(self) -> None:
        """Remove the namespace with its tables."""
        self.spark.sql(f"DROP DATABASE IF EXISTS {self.space} CASCADE")

    def build_if_absent(self, table: str, build, **kwargs) -> DataFrame:
        if not self.exists(table):
            self.write(build(), table, **kwargs)
        return self.read(table)

    def read(self, table: str, columns: list[str] | None = None, where=None) -> DataFrame:
        df = self.spark.table(self._full(table))
        if where is not None:
            df = df.where(where)
        return df.select(*columns) if columns else df

    def tables(self) -> list[str]:
        return sorted(t.name for t in self.spark.catalog.listTables(self.space))

    def columns(self, table: str) -> list[str]:
        return [c.name for c in self.spark.catalog.listColumns(self._full(table))]

    def features(self) -> list[tuple[str, str]]:
        return [(t, c) for t in self.tables() for c in self.columns(t)]


def namespaces(spark: SparkSession) -> list[str]:
    return sorted(d.name for d in spark.catalog.listDatabases() if d.name.startswith("features"))


def _like(pattern: str, text: str) -> bool:
    rule = "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in pattern)
    return re.fullmatch(rule, text, re.DOTALL) is not None


def select_features(available: list[tuple[str, str]], patterns: list[str]) -> list[tuple[str, str]]:
    """``(table, column)`` pairs matched by ``table.column_like`` patterns, in pattern order, once each."""
    out: list[tuple[str, str]] = []
    for pattern in patterns:
        table, dot, column = pattern.partition(".")
        if not dot:
            raise ValueError(f"pattern {pattern!r} is not table.column")
        hits = [(t, c) for t, c in available if t == table and c not in KEY_COLUMNS and _like(column, c)]
        if not hits:
            raise ValueError(f"no feature matches {pattern!r}")
        out += [h for h in hits if h not in out]
    return out


def _schema(**fields) -> StructType:
    return StructType([StructField(n, t) for n, t in fields.items()])


_T, _D, _I = StringType(), DoubleType(), IntegerType()

# Result tables of the model review.
RESULT_SCHEMAS = {
    "all_models": _schema(
        model_id=_T, model_name=_T, prec_at_1=_D, prec_at_5=_D, prec_at_10=_D, prec_at_20=_D, test_start=_T,
        validation_precision_at_k=_D, validation_labeled_percent=_D, features=_T, start_date=_T,
        training_window=_T, model_number=_I, parameters=_T),
    "all_top_k": _schema(
        parcel_id=_T, inspection_date=TimestampNTZType(), prediction=_D, inspection_density=_D, violation_rate=_D,
        violations_per_house=_D, model_group=_T, subset=_T),
    "feature_crosstabs": _schema(model_group=_T, quantity=_T, subset=_T, feature=_T, value=_D),
    "feature_importances": _schema(feature=_T, model_group=_T, feature_importance=_D),
    "model_groups": _schema(model_group=_I, model_id=_T),
    "model_reasons": _schema(model_group=_I, reason=_T),
    "parcel_info": _schema(
        parcel_id=_T, address=_T, owner=_T, latitude=_D, longitude=_D, is_residential=BooleanType(),
        last_event=_T, last_event_date=TimestampNTZType(), any_interaction=BooleanType(), houses=LongType()),
}


def create_result_tables(spark: SparkSession, space: str = "model_results") -> None:
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {_checked(space)}")
    for name, schema in RESULT_SCHEMAS.items():
        if not spark.catalog.tableExists(f"{space}.{name}"):
            spark.createDataFrame([], schema).write.format("parquet").saveAsTable(f"{space}.{name}")


def as_result(df: DataFrame, table: str) -> DataFrame:
    """Rows in the column order and types of a result table; absent columns are null."""
    fields = RESULT_SCHEMAS[table].fields
    return df.select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


def write_predictions(df: DataFrame, path: str, model_id: str, as_csv: bool = False) -> None:
    """Predictions of one run in its own partition, replaced as a whole."""
    rows = df.withColumn("model_id", F.lit(model_id))
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model_id")
    if as_csv:
        writer.option("header", "true").csv(path)
    else:
        writer.parquet(path)
