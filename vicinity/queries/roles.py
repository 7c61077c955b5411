"""The test tables in the roles the operators expect, for Spark and for the comparison SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    """Reader with the role views used by the query catalogue."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @staticmethod
    def at(key: str, shift: int = 0) -> list[Column]:
        return [((F.col(key) * 7919 + shift) % 20000).alias("x"), ((F.col(key) * 104729 + shift) % 20000).alias("y")]

    @property
    def parcels(self) -> DataFrame:
        return self.customer.select(F.col("c_custkey").alias("parcel_id"), *self.at("c_custkey"),
                                    F.col("c_nationkey").alias("tract"), "c_acctbal", "c_mktsegment")

    @property
    def addresses(self) -> DataFrame:
        return self.supplier.select(F.col("s_suppkey").alias("address_id"), *self.at("s_suppkey", 3001))

    @property
    def inspections(self) -> DataFrame:
        outcome = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 0)
        return self.orders.select(
            F.col("o_custkey").alias("parcel_id"), F.col("o_orderdate").alias("inspection_date"),
            outcome.alias("viol_outcome"), F.col("o_orderkey").alias("order_id"), F.col("o_totalprice").alias("price"),
            F.col("o_orderpriority").alias("priority"))

    @property
    def scored(self) -> DataFrame:
        return self.documents.select("doc_id", F.col("n_chars").alias("score"), "source", "lang").join(
            self.labels.select("doc_id", F.col("quality").alias("label"), "toxic"), "doc_id", "left")

    @property
    def labelled(self) -> DataFrame:
        return self.scored.where(F.col("label").isNotNull())


PARCELS = ("parcels AS (SELECT c_custkey AS parcel_id, (c_custkey*7919)%20000 AS x, (c_custkey*104729)%20000 AS y, "
           "c_nationkey AS tract, c_acctbal, c_mktsegment FROM customer)")
ADDRESSES = ("addresses AS (SELECT s_suppkey AS address_id, (s_suppkey*7919+3001)%20000 AS x, "
             "(s_suppkey*104729+3001)%20000 AS y FROM supplier)")
INSPECTIONS = ("inspections AS (SELECT o_custkey AS parcel_id, o_orderdate AS inspection_date, "
               "CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS viol_outcome, o_orderkey AS order_id, "
               "o_totalprice AS price, o_orderpriority AS priority FROM orders)")
VISITS = "visits AS (SELECT DISTINCT parcel_id, inspection_date FROM inspections)"
SCORED = ("scored AS (SELECT doc_id, n_chars AS score, source, lang, quality AS label, toxic "
          "FROM documents LEFT JOIN labels USING (doc_id))")
LABELLED = SCORED + ", labelled AS (SELECT * FROM scored WHERE label IS NOT NULL)"


def near(a: str, b: str, metres: float) -> str:
    feet = metres * 3.281
    return f"(({a}.x-{b}.x)*({a}.x-{b}.x)+({a}.y-{b}.y)*({a}.y-{b}.y)) <= {feet * feet!r}"


def edges(metres: float) -> str:
    return (f"edges AS (SELECT p.parcel_id, a.address_id, "
            f"sqrt(CAST((p.x-a.x)*(p.x-a.x)+(p.y-a.y)*(p.y-a.y) AS DOUBLE))/3.281 AS dist_m "
            f"FROM parcels p JOIN addresses a ON {near('p', 'a', metres)})")


def bounds(events: str, when: str, months: int) -> str:
    """Visits inside the dates that the events cover."""
    return f"""span AS (
        SELECT CASE WHEN fe <= fi - INTERVAL {months} MONTH THEN date_trunc('day', fi)
                    ELSE date_trunc('day', fe + INTERVAL {months} MONTH) END AS lo,
               CASE WHEN li <= le THEN date_trunc('day', li) ELSE date_trunc('day', le) END AS hi
        FROM (SELECT min(inspection_date) AS fi, max(inspection_date) AS li FROM inspections) a,
             (SELECT min({when}) AS fe, max({when}) AS le FROM {events}) b),
    bounded AS (SELECT v.* FROM visits v, span WHERE inspection_date BETWEEN lo AND hi)"""


def rounded(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    return df.withColumns({c: _rounded(F.col(c).cast("double"), digits) for c in columns})


def _rounded(value: Column, digits: int) -> Column:
    """``round``, by whole numbers where no tie is near: it goes through decimals, which costs more than a join that makes the row."""
    unit = 10.0 ** digits
    scaled = value * F.lit(unit)
    whole = F.floor(scaled + 0.5)
    sure = (F.abs(scaled) < 1e12) & (F.abs(scaled - whole) < 0.49)
    return F.when(sure, whole / F.lit(unit)).otherwise(F.round(value, digits))


def longs(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})
