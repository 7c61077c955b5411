from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from vicinity.plans import experiment
from vicinity.sources.store import FeatureStore


@pytest.fixture(scope="module")
def stores(spark):
    past, ahead = FeatureStore(spark, "features_exp"), FeatureStore(spark, "features_exp_31dec2014")
    rows = [(p, datetime(2013, 1, 1) + timedelta(days=11 * i), (p + i) % 2) for p in range(30) for i in range(60)]
    people = spark.createDataFrame(rows, "parcel_id int, inspection_date timestamp_ntz, viol_outcome int")
    past.write(people, "parcels_inspections")
    past.write(people.select("parcel_id", "inspection_date", (F.col("viol_outcome") * 5 + F.col("parcel_id") % 3).alias("total"),
                             F.lit(1).alias("other")), "crime_400m_3months", bucket_by="parcel_id", buckets=4)
    size = people.select("parcel_id", (F.col("parcel_id") * 2.0).alias("area")).distinct()
    future = people.select("parcel_id").distinct().select(
        "parcel_id", F.lit("2014-12-31").cast("timestamp_ntz").alias("inspection_date"), F.lit(None).cast("int").alias("viol_outcome"))
    ahead.write(future, "parcels_inspections")
    ahead.write(future.select("parcel_id", "inspection_date", (F.col("parcel_id") % 7).alias("total")), "crime_400m_3months")
    for s in (past, ahead):
        s.write(size, "parc_area")
    return past, ahead


CONFIG = {"experiment_name": "e1", "start_date": "01Jan2013", "fake_today": "31Dec2013", "validation_window": "6Month",
          "features": ["crime_400m_3months.tot%", "parc_area.%"],
          "models": [{"RandomForestClassifier": {"n_estimators": [3], "max_depth": [2, 3]}}]}


def test_run_and_retrain(spark, stores, tmp_path):
    past, ahead = stores
    runs, preds, tops = (str(tmp_path / n) for n in ("runs", "preds", "tops"))
    ids = experiment.run_experiment(CONFIG, past, runs, preds, future=ahead, top=20, top_path=tops)
    log = spark.read.parquet(runs)
    assert len(ids) == 2 and log.count() == 2 and log.agg(F.min("prec_at_20")).first()[0] == 1.0
    assert {r["count"] for r in spark.read.parquet(tops).groupBy("model_id").count().collect()} == {6}
    window = spark.read.parquet(preds).agg(F.min("inspection_date"), F.max("inspection_date")).first()
    assert datetime(2013, 12, 31) <= window[0] and window[1] < datetime(2014, 6, 30)
    with pytest.raises(ValueError, match="before"):
        experiment.run_experiment(CONFIG, past, runs, preds)
    small = {**CONFIG, "models": [{"LogisticRegression": {"penalty": ["l2"], "C": [1]}}]}
    again = experiment.run_experiment(small, past, runs, preds, overwrite=True, dump_path=str(tmp_path / "dump"))
    assert [r["run_id"] for r in spark.read.parquet(runs).collect()] == again
    assert spark.read.csv(str(tmp_path / "dump" / "e1_train"), header=True).columns[:3] == ["parcel_id", "inspection_date", "viol_outcome"]
    scored, _ = experiment.retrain(CONFIG, "LogisticRegression", {"penalty": "l2", "C": 1}, past, ahead, datetime(2014, 8, 30))
    assert scored.count() == 30
    best = scored.orderBy(F.col("prediction").desc()).first()
    assert best["crime_400m_3months_total"] >= 5
