from datetime import datetime

import pytest
from pyspark.sql import functions as F

from vicinity.operators import dedupe, profile
from vicinity.sources import files, increment, store
from vicinity.streaming import incremental


def test_csv_stays_text_and_dates_parse(spark, tmp_path):
    (tmp_path / "a.csv").write_text("ID,When,Code\n007,03/05/2015 10:00,12\n008,nonsense,\n")
    df = files.read_csv_text(spark, str(tmp_path), ["id", "at", "code"], {"at": "MM/dd/yyyy HH:mm"})
    assert df.schema["id"].dataType.simpleString() == "string"
    got = {r["id"]: (r["at"], r["code"]) for r in df.collect()}
    assert got == {"007": (datetime(2015, 3, 5, 10), "12"), "008": (None, None)}


def test_fixed_width_file(spark, tmp_path):
    (tmp_path / "w.txt").write_text("201501020300-9999 0012\n201501020400 0031     \n")
    df = files.read_fixed_width(spark, str(tmp_path), [("day", 0, 8), ("hour", 8, 2), ("temp", 12, 5), ("wind", 17, 5)], ["-9999"])
    assert [tuple(r) for r in df.orderBy("hour").collect()] == [
        ("20150102", "03", None, "0012"), ("20150102", "04", "0031", None)]


def test_drifting_union_and_clean_rows(spark):
    a = spark.createDataFrame([("1", " x ", "g")], "ID string, STREET_ADDRESS string, Incident_GUID string")
    b = spark.createDataFrame([("2", None, "9"), ("3", "y", "9"), ("3", "y", "9")], "id string, address string, zip string")
    out = files.clean_rows(files.union_drifting([a, b], {"street_address": "address"}, ["incident_guid"], {"city": "TOWN"}))
    assert sorted(tuple(r) for r in out.select("id", "address", "city", "zip").fillna("-").collect()) == [
        ("1", "x", "TOWN", "-"), ("3", "y", "TOWN", "9")]


def test_geocoder_answers_join_back(spark):
    lines = spark.createDataFrame([('"1","12 Elm St, Town, OH, 45","Match","Exact","12 ELM ST, TOWN, OH, 45211","-84.5,39.1","9","L"',),
                                   ('"2","x, Town, OH, 45","No_Match"',)], "value string")
    df = spark.createDataFrame([("12 Elm St", "Town", "OH", "45"), ("x", "Town", "OH", "45")], "address string, city string, state string, zip string")
    out = files.with_geocodes(df, files.parse_geocoder_lines(lines), ["address", "city", "state", "zip"]).orderBy("address").collect()
    assert [(r["address"], r["latitude"], r["zip_census"]) for r in out] == [("12 Elm St", 39.1, "45211"), ("x", None, None)]


def test_rows_after_mark(spark):
    new = spark.createDataFrame([(datetime(2015, 1, d),) for d in (1, 2, 3)], "t timestamp_ntz")
    assert increment.rows_after_mark(new, None, "t").count() == 3
    assert increment.rows_after_mark(new, new.limit(0), "t").count() == 3
    assert increment.rows_after_mark(new, new.where("day(t) < 3"), "t").count() == 1


def test_marks(spark):
    marks = spark.createDataFrame([("address", 4)], "table_name string, event_id long")
    events = spark.createDataFrame([(3,), (9,)], "id long")
    assert increment.read_mark(marks, "address") == 4 and increment.read_mark(marks, "other") == 0
    got = {r["table_name"]: r["event_id"] for r in increment.moved_mark(marks, "three11", events, "id").collect()}
    assert got == {"address": 4, "three11": 9}


def test_store_roundtrip_and_patterns(spark):
    s = store.FeatureStore(spark, store.namespace(datetime(2015, 12, 31)))
    assert s.space == "features_31dec2015"
    assert store.namespace(field_test=True) == "features_field_test"
    df = spark.createDataFrame([(1, datetime(2015, 12, 31), 2.0, 3)],
                               "parcel_id long, inspection_date timestamp_ntz, avg_a double, total long")
    s.write(df, store.table_name("crime", 400, 3), bucket_by="parcel_id", buckets=2)
    s.write(df.withColumn("total", F.lit(9)), "tax")
    s.build_if_absent("tax", lambda: pytest.fail("must not be built again"))
    assert s.tables() == ["crime_400m_3months", "tax"]
    assert s.read("tax", ["total"], F.col("parcel_id") == 1).first()[0] == 9
    assert "features_31dec2015" in store.namespaces(spark)
    pick = store.select_features(s.features(), ["crime_400m_3months.avg%", "tax.tota_", "tax.%"])
    assert pick == [("crime_400m_3months", "avg_a"), ("tax", "total"), ("tax", "avg_a")]
    with pytest.raises(ValueError):
        store.select_features(s.features(), ["tax.nothing%"])
    with pytest.raises(ValueError):
        store.FeatureStore(spark, "features; drop")


def test_result_tables(spark):
    store.create_result_tables(spark, "model_results_t")
    store.create_result_tables(spark, "model_results_t")
    assert {t.name for t in spark.catalog.listTables("model_results_t")} == set(store.RESULT_SCHEMAS)
    df = store.as_result(spark.createDataFrame([("f", 1.0)], "feature string, feature_importance double"), "feature_importances")
    assert df.columns == ["feature", "model_group", "feature_importance"]


def test_prediction_sink_replaces_one_run(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5)], "parcel_id long, prediction double")
    for run, rows in (("a", df), ("b", df), ("a", df.unionByName(df))):
        store.write_predictions(rows, str(tmp_path / "p"), run)
    got = {r["model_id"]: r["count"] for r in spark.read.parquet(str(tmp_path / "p")).groupBy("model_id").count().collect()}
    assert got == {"a": 2, "b": 1}


def test_stream_catches_up_once(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    day = spark.createDataFrame([(1, datetime(2015, 1, 1))], "id long, t timestamp_ntz")
    day.write.mode("append").parquet(src)
    for expected in (1, 1, 2):
        if expected == 2:
            day.withColumn("id", F.lit(2).cast("long")).write.mode("append").parquet(src)
        incremental.load_new_files(incremental.stream_files(spark, src, day.schema), out, ck).awaitTermination()
        assert spark.read.parquet(out).count() == expected


def test_stream_edges_and_redelivery(spark, tmp_path):
    src = str(tmp_path / "src")
    events = spark.createDataFrame([(i, i * 100, 0, datetime(2015, 1, 1)) for i in range(5)],
                                   "event_id long, x long, y long, t timestamp_ntz")
    events.repartition(1).write.mode("append").parquet(src)
    parcels = spark.createDataFrame([(7, 0, 0)], "parcel_id long, x long, y long")
    stream = incremental.stream_files(spark, src, events.schema)
    incremental.extend_edges(stream, parcels, "parcel_id", "event_id", 62, str(tmp_path / "edges"),
                             str(tmp_path / "ck1")).awaitTermination()
    assert sorted(r[0] for r in spark.read.parquet(str(tmp_path / "edges")).select("event_id").collect()) == [0, 1, 2]

    events.repartition(1).write.mode("append").parquet(src)     # delivered again
    fresh = incremental.without_redelivery(incremental.stream_files(spark, src, events.schema), ["event_id"])
    incremental.load_new_files(fresh, str(tmp_path / "once"), str(tmp_path / "ck2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "once")).count() == 5


@pytest.mark.parametrize("how", ["state", "target"])
def test_back_filled_rows_stay_and_repeated_ones_go(spark, tmp_path, how):
    """Three runs: new rows, then an older one with a repeated one, then all again."""
    src, out, mark = (str(tmp_path / n) for n in ("src", "out", "mark"))
    rows = [[(1, datetime(2024, 1, 1)), (2, datetime(2024, 5, 1)), (2, datetime(2024, 6, 1))],
            [(3, datetime(2023, 1, 1)), (1, datetime(2024, 1, 1)), (None, datetime(2024, 7, 1))],
            [(3, datetime(2023, 1, 1)), (4, datetime(2020, 1, 1)), (None, datetime(2024, 7, 1))]]
    for part in rows:
        new = spark.createDataFrame(part, "id long, t timestamp_ntz").coalesce(1)
        new.write.mode("append").parquet(src)
        stream = incremental.stream_files(spark, src, new.schema)
        if how == "state":
            incremental.load_new_files(incremental.without_redelivery(stream, ["id"]), out, mark).awaitTermination()
        else:
            incremental.load_once(stream, ["id"], out, mark, buckets=4).awaitTermination()
    found = spark.read.parquet(out).select("id", "t").collect()
    assert sorted((r["id"] or 0) for r in found) == [0, 1, 2, 3, 4]
    if how == "target":
        assert {r["id"]: r["t"] for r in found}[2] == datetime(2024, 5, 1)


def test_dedupe_variants(spark, rows):
    df = spark.createDataFrame([(1, 5, "a"), (1, 6, "b"), (2, 7, "c"), (None, 8, "d")], "k int, s int, v string")
    assert rows(dedupe.only_unrepeated(df, ["k"]), "k", "v") == [(None, "d"), (2, "c")]
    assert rows(dedupe.drop_lowest_of_repeated(df, "k", "s"), "s") == [(6,), (7,), (8,)]
    assert rows(dedupe.first_by(df, ["k"], [-F.col("s")]), "s") == [(6,), (7,), (8,)]
    other = spark.createDataFrame([(2, 1, "z"), (3, 1, "z")], "k int, s int, v string")
    assert rows(dedupe.by_priority([df, other], ["k"], "s"), "k", "v") == [(1, "a"), (2, "c"), (3, "z")]
    assert rows(dedupe.not_yet_known(df, other, ["k"]), "s") == [(5,), (6,), (8,)]
    assert rows(dedupe.repeated_keys(df, ["k"])) == [(1, 2)]


def test_single_value_cases(spark, rows):
    df = spark.createDataFrame([("a", " p1", "1"), ("a", " p1", "1"), ("a", "p2", "0"), ("b", "p1", "1"), ("b", "p3", "1"), ("c", None, "1")],
                               "k string, p string, main string")
    assert rows(dedupe.single_value_cases(df, "k", "p", F.col("main") == "1")) == [("a", "p1")]


def test_null_check(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, 1)], "a int, b int")
    assert profile.require_complete(df, 0.7) is df
    with pytest.raises(ValueError, match="b"):
        profile.require_complete(df, 0.5)
    with pytest.raises(ValueError):
        profile.bounds(df, "missing")
