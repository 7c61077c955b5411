"""Queries on sources, sinks and incremental jobs: written to a folder of the session and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vicinity.functions import text
from vicinity.plans import census, dataset, features
from vicinity.queries.nearby import METRES, edges
from vicinity.queries.roles import ADDRESSES, INSPECTIONS, PARCELS, Tables
from vicinity.session import checkpoint_dir, stable
from vicinity.sources import files, store
from vicinity.streaming import incremental


def _folder(spark) -> str:
    return f"{checkpoint_dir(spark)}/queries-{uuid.uuid4().hex}"


def csv_scan(spark, folder):
    """Orders written as delimited text and read with one parsed date column; the rest stays text."""
    path = _folder(spark)
    rows = Tables(spark, folder).orders.select(
        F.col("o_orderkey").cast("string").alias("id"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("priority"),
        F.when(F.col("o_orderkey") % 7 == 0, F.lit("unknown")).otherwise(F.date_format("o_orderdate", "MM/dd/yyyy")).alias("day"))
    rows.write.option("header", "true").csv(path)
    return files.read_csv_text(spark, path, ["id", "priority", "day"], {"day": "MM/dd/yyyy"})


CSV_SCAN = """
SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS priority,
  CASE WHEN o_orderkey % 7 <> 0 THEN CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) END AS day FROM orders"""


def feature_store(spark, folder):
    """Two feature tables written, one of them found again, chosen by patterns, read with a predicate and assembled."""
    t = Tables(spark, folder)
    place = store.FeatureStore(spark, f"features_{uuid.uuid4().hex}")
    try:
        visits = t.orders.groupBy(F.col("o_custkey").alias("parcel_id")).agg(
            F.count("*").alias("visits_all"), F.count_if(F.col("o_orderstatus") == "F").alias("visits_bad"))
        place.write(visits, "visits")
        place.build_if_absent("visits", lambda: visits.limit(0))
        place.write(t.parcels.select("parcel_id", F.col("tract").cast("long").alias("tract")), "parc")
        chosen = store.select_features(place.features(), ["visits.visits%", "parc.tract"])
        labels = t.parcels.select("parcel_id")
        tables = {"visits": place.read("visits"), "parc": place.read("parc", where="tract > 3")}
        return stable(dataset.assemble(labels, tables, chosen, impute=None))
    finally:
        place.drop()


FEATURE_STORE = """
SELECT c_custkey AS parcel_id, v.a AS visits_visits_all, v.b AS visits_visits_bad, CASE WHEN c_nationkey > 3 THEN CAST(c_nationkey AS BIGINT) END AS parc_tract
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS a, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS b FROM orders GROUP BY 1) v ON o_custkey = c_custkey"""


def prediction_sink(spark, folder):
    """Predictions of two runs, one of them written twice."""
    path, t = _folder(spark), Tables(spark, folder)
    rows = t.scored.select("doc_id", F.col("score").cast("double").alias("prediction"))
    for model, keep in (("a", F.lit(True)), ("b", F.lit(True)), ("a", F.col("prediction") > 1000)):
        store.write_predictions(rows.where(keep), path, model)
    return spark.read.parquet(path).select("doc_id", "prediction", F.col("model_id").cast("string").alias("model_id"))


PREDICTION_SINK = """
SELECT doc_id, n_chars::DOUBLE AS prediction, 'a' AS model_id FROM documents WHERE n_chars > 1000
UNION ALL SELECT doc_id, n_chars::DOUBLE, 'b' FROM documents"""


def result_tables(spark, folder):
    """Top rows appended to their result table, in its columns and types."""
    space = f"model_results_{uuid.uuid4().hex}"
    store.create_result_tables(spark, space)
    try:
        rows = Tables(spark, folder).inspections.select(
            F.col("parcel_id"), "inspection_date", F.col("price").alias("prediction"), F.lit("all").alias("subset"))
        store.as_result(rows, "all_top_k").write.insertInto(f"{space}.all_top_k")
        return stable(spark.table(f"{space}.all_top_k"))
    finally:
        spark.sql(f"DROP DATABASE {space} CASCADE")


RESULT_TABLES = """
SELECT CAST(o_custkey AS VARCHAR) AS parcel_id, o_orderdate AS inspection_date, o_totalprice AS prediction, NULL AS inspection_density,
  NULL AS violation_rate, NULL AS violations_per_house, NULL AS model_group, 'all' AS subset FROM orders"""


def county_rows(spark, folder):
    rows = Tables(spark, folder).parcels.select("parcel_id", F.lpad(F.col("tract").cast("string"), 3, "0").alias("county"))
    return census.county_rows(rows, "county", "007")


COUNTY_ROWS = "SELECT c_custkey AS parcel_id, '007' AS county FROM customer WHERE c_nationkey = 7"


def shuffled_rows(spark, folder):
    """All rows in pseudo-random order; the comparison takes them without an order."""
    rows = Tables(spark, folder).inspections.select("parcel_id", "inspection_date", "order_id")
    return dataset.shuffled(rows, 3).select("parcel_id", "inspection_date", "order_id")


SHUFFLED_ROWS = f"WITH {INSPECTIONS} SELECT parcel_id, inspection_date, order_id FROM inspections"


def parcel_features(spark, folder):
    """Area, year built and census ratio of each inspected parcel."""
    t = Tables(spark, folder)
    ctx = features.Context(
        population=t.inspections.select("parcel_id", "inspection_date").limit(0).unionByName(
            t.inspections.groupBy("parcel_id").agg(F.max("inspection_date").alias("inspection_date"))),
        tables={"parcels": t.parcels.select("parcel_id", F.col("c_acctbal").alias("area")),
                "buildings": t.parcels.select("parcel_id", (F.col("parcel_id") % 150 + 1850).alias("year_built")),
                "parcel_areas": t.parcels.select("parcel_id", "tract", (F.col("parcel_id") % 3).alias("block_group")),
                "census_features": t.nation.select(F.col("n_nationkey").alias("tract"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("block_group"))
                .withColumn("ratio", (F.col("tract") * 10 + F.col("block_group")).cast("long"))},
        edges=None, metres=400, months=3)
    return features.parc_area(ctx).join(features.parc_year(ctx), "parcel_id").join(features.census_2010(ctx), "parcel_id")


PARCEL_FEATURES = """
SELECT c_custkey AS parcel_id, c_acctbal AS area, c_custkey % 150 + 1850 AS year_built, CAST(c_nationkey * 10 + c_custkey % 3 AS BIGINT) AS ratio
FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)"""


def stream_new_files(spark, folder):
    """A stream that stops when it has read all files, run again when more have come: it reads only those."""
    path, events = _folder(spark), Tables(spark, folder).events
    for early in (True, False):
        events.where((F.col("event_id") % 2 == 0) == early).write.mode("append").parquet(f"{path}/in")
        stream = incremental.stream_files(spark, f"{path}/in", events.schema)
        incremental.load_new_files(stream, f"{path}/rows", f"{path}/mark").awaitTermination()
    return spark.read.parquet(f"{path}/rows").select("event_id", "user_id", "event_type", "value")


STREAM_NEW_FILES = "SELECT event_id, user_id, event_type, value FROM events"


def stream_edges(spark, folder):
    """Edges of a stream of new addresses against the parcels."""
    path, t = _folder(spark), Tables(spark, folder)
    t.supplier.write.parquet(f"{path}/in")
    stream = incremental.stream_files(spark, f"{path}/in", t.supplier.schema).select(
        F.col("s_suppkey").alias("address_id"), *Tables.at("s_suppkey", 3001))
    incremental.extend_edges(stream, t.parcels.select("parcel_id", "x", "y"), "parcel_id", "address_id", METRES, f"{path}/edges",
                             f"{path}/mark", as_sets=True).awaitTermination()
    return incremental.read_edges(spark, f"{path}/edges").select("parcel_id", "address_id")


STREAM_EDGES = f"WITH {PARCELS}, {ADDRESSES}, {edges(METRES)} SELECT parcel_id, address_id FROM edges"


def stream_redelivery(spark, folder):
    """Newer events first, then all events again: back-filled rows stay, repeated ones go; keys are kept in the stream's state."""
    return _delivered_twice(spark, folder, lambda stream, path: incremental.load_new_files(
        incremental.without_redelivery(stream, ["event_id"]), f"{path}/rows", f"{path}/mark"))


def stream_load_once(spark, folder):
    """The same, with keys looked up in the target."""
    return _delivered_twice(spark, folder, lambda stream, path: incremental.load_once(
        stream, ["event_id"], f"{path}/rows", f"{path}/mark", buckets=8))


def _delivered_twice(spark, folder, load):
    path, t = _folder(spark), Tables(spark, folder)
    events = t.events.select("event_id", "ts", "value")
    for name, keep in (("a", F.col("event_id") % 3 == 0), ("b", F.lit(True))):
        # The first delivery's events are moved on by years, so that the second one is older than all of them.
        events.where(keep).withColumn("ts", F.expr(f"ts + INTERVAL {2 if name == 'a' else 0} YEAR")).write.parquet(f"{path}/in/{name}")
        stream = incremental.stream_files(spark, f"{path}/in/*", spark.read.parquet(f"{path}/in/a").schema)
        load(stream, path).awaitTermination()
    return spark.read.parquet(f"{path}/rows").select("event_id", "value", F.year("ts").cast("long").alias("year"))


STREAM_REDELIVERY = """
SELECT event_id, value, year(ts) + CASE WHEN event_id % 3 = 0 THEN 2 ELSE 0 END AS year FROM events"""


def paid_taxes(spark, folder):
    """Yearly tax rows whose paid amount does not begin with a zero."""
    rows = Tables(spark, folder).lineitem.select(
        "l_orderkey", "l_linenumber", F.concat((F.col("l_linenumber") - 1).cast("string"), F.lit(".50")).alias("taxes_paid"))
    return rows.where(text.taxes_are_paid(F.col("taxes_paid")))


PAID_TAXES = """
SELECT l_orderkey, l_linenumber, (l_linenumber - 1) || '.50' AS taxes_paid FROM lineitem WHERE (l_linenumber - 1) || '.50' NOT LIKE '0%'"""


QUERIES = {
    "csv_scan": (csv_scan, CSV_SCAN),
    "feature_store": (feature_store, FEATURE_STORE),
    "prediction_sink": (prediction_sink, PREDICTION_SINK),
    "result_tables": (result_tables, RESULT_TABLES),
    "county_rows": (county_rows, COUNTY_ROWS),
    "shuffled_rows": (shuffled_rows, SHUFFLED_ROWS),
    "parcel_features": (parcel_features, PARCEL_FEATURES),
    "stream_new_files": (stream_new_files, STREAM_NEW_FILES),
    "stream_edges": (stream_edges, STREAM_EDGES),
    "stream_redelivery": (stream_redelivery, STREAM_REDELIVERY),
    "stream_load_once": (stream_load_once, STREAM_REDELIVERY),
    "paid_taxes": (paid_taxes, PAID_TAXES),
}
