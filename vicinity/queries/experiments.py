"""Queries on whole experiments: features generated into a store, runs over a grid, retraining, stored pipelines."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import functions as F

from vicinity.operators import evaluate
from vicinity.plans import dataset, experiment, features, models
from vicinity.plans.dataset import KEYS, OUTCOME
from vicinity.plans.features import Context
from vicinity.queries.roles import INSPECTIONS, Tables
from vicinity.queries.stores import _folder
from vicinity.session import stable
from vicinity.sources.store import FeatureStore, select_features

#: Six runs: two forests, two logistic regressions, a linear SVM and boosted trees.
MODELS = [{"RandomForestClassifier": {"n_estimators": [3], "max_depth": [4], "min_samples_split": [2, 60]}},
          {"LogisticRegression": {"penalty": ["l1", "l2"], "C": [1]}}, {"SVC": {"C": [1]}},
          {"GradientBoostingClassifier": {"n_estimators": [2], "max_depth": [2]}}]
CONFIG = {"experiment_name": "grid", "start_date": "01Jan1996", "fake_today": "01Jan2000", "validation_window": "6Month",
          "features": ["spent.%", "parc.%"], "models": MODELS}
SPLIT = dataset.temporal_split(CONFIG, datetime(2001, 8, 1))
AHEAD = "2001-06-30"


def _spent(ctx: Context):
    """A feature of one's own: what was spent on each inspected day, and how often."""
    return ctx.tables["orders"].groupBy(F.col("o_custkey").alias("parcel_id"), F.col("o_orderdate").alias("inspection_date")).agg(
        F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"), F.count(F.lit(1)).alias("n"))


def _filled(spark, t: Tables, people, name: str) -> FeatureStore:
    """A namespace with its population, a generated feature table and one by parcel."""
    store = FeatureStore(spark, name)
    store.set_buckets(people.count(), per_bucket=5_000)
    store.write(people, experiment.POPULATION)
    features.register("spent", _spent)
    try:
        features.generate(store, Context(population=people, tables={"orders": t.orders}), ["spent"])
    finally:
        features.REGISTRY.pop("spent")
    store.write(t.parcels.select("parcel_id", F.round(F.col("c_acctbal") * 100).cast("long").alias("balance"),
                                 F.when(F.col("tract") < 20, F.col("tract")).cast("long").alias("tract")), "parc")
    return store


def _people(t: Tables):
    return t.inspections.groupBy(*KEYS).agg(F.max(OUTCOME).alias(OUTCOME))


def _ahead(t: Tables):
    return t.parcels.select("parcel_id", F.lit(AHEAD).cast("timestamp_ntz").alias("inspection_date"), F.lit(None).cast("int").alias(OUTCOME))


def _with_stores(spark, folder, work):
    t, tag = Tables(spark, folder), uuid.uuid4().hex
    past, ahead = _filled(spark, t, _people(t), f"features_{tag}"), _filled(spark, t, _ahead(t), f"features_{tag}_ahead")
    try:
        return stable(work(t, past, ahead))
    finally:
        past.drop()
        ahead.drop()


_KEYS_SQL = f"keys AS (SELECT parcel_id, inspection_date, max(viol_outcome) AS viol_outcome FROM inspections GROUP BY 1, 2)"


def experiment_grid(spark, folder):
    """Every run of the grid scores the test window: which keys it scored, and whether the scores are probabilities."""
    def work(t, past, ahead):
        path = _folder(spark)
        experiment.run_experiment(CONFIG, past, f"{path}/runs", f"{path}/predictions")
        runs = spark.read.parquet(f"{path}/runs").select("run_id", "name", "parameters")
        scores = spark.read.parquet(f"{path}/predictions").withColumn("run_id", F.col("model_id").cast("string"))
        return scores.join(runs, "run_id").select("name", "parameters", *KEYS, OUTCOME, F.col("prediction").between(0, 1).alias("chance"))
    return _with_stores(spark, folder, work)


_RUNS = models.runnable(models.runs_for(MODELS))
EXPERIMENT_GRID = f"""
WITH {INSPECTIONS}, {_KEYS_SQL}, runs(name, parameters) AS (VALUES {', '.join(f"('{n}', '{models.parameters_text(p)}')" for n, p in _RUNS)})
SELECT name, parameters, parcel_id, inspection_date, viol_outcome, true AS chance FROM keys, runs
WHERE inspection_date >= TIMESTAMP '{SPLIT.fake_today}' AND inspection_date < TIMESTAMP '{SPLIT.end}'"""


def prediction_rows(spark, folder):
    """The population to predict for, with its features and the medians where there are none."""
    def work(t, past, ahead):
        return experiment.load_dataset(ahead, select_features(ahead.features(), CONFIG["features"]))
    return _with_stores(spark, folder, work)


PREDICTION_ROWS = f"""
WITH s AS (SELECT o_custkey, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents, count(*) AS n FROM orders
  WHERE o_orderdate = TIMESTAMP '{AHEAD}' GROUP BY 1),
d AS (SELECT c_custkey AS parcel_id, TIMESTAMP '{AHEAD}' AS inspection_date, NULL::INT AS viol_outcome, cents AS spent_cents, n AS spent_n,
  CAST(round(c_acctbal * 100) AS BIGINT) AS parc_balance, CASE WHEN c_nationkey < 20 THEN c_nationkey END AS parc_tract
  FROM customer LEFT JOIN s ON o_custkey = c_custkey)
SELECT parcel_id, inspection_date, viol_outcome, {', '.join(f"coalesce({c}, (SELECT median({c}) FROM d))::DOUBLE AS {c}"
                                                           for c in ("spent_cents", "spent_n", "parc_balance", "parc_tract"))} FROM d"""


def retrained_scores(spark, folder):
    """A run fitted again on a later window of the same length, over the population to predict for."""
    def work(t, past, ahead):
        scored, _ = experiment.retrain(CONFIG, "RandomForestClassifier", {"n_estimators": 3, "max_depth": 4}, past, ahead, datetime(2001, 1, 1))
        return scored.select(*KEYS, F.col("prediction").between(0, 1).alias("chance"))
    return _with_stores(spark, folder, work)


RETRAINED_SCORES = f"SELECT c_custkey AS parcel_id, TIMESTAMP '{AHEAD}' AS inspection_date, true AS chance FROM customer"


def stored_pipeline(spark, folder):
    """A fitted pipeline written and read again gives the same scores."""
    t, path = Tables(spark, folder), _folder(spark)
    rows = t.inspections.select("order_id", OUTCOME, F.col("price").alias("price"), F.col("parcel_id").cast("double").alias("place"))
    fitted = models.fit(rows, ["price", "place"], "RandomForestClassifier", {"n_estimators": 3, "max_depth": 3})
    models.save(models.PipelineModel(stages=[*fitted[0].stages, fitted[1]]), path)
    direct = models.score(fitted, rows, ["price", "place"], ["order_id"])
    again = models.predict_with_stored(path, rows, ["price", "place"], ["order_id"]).withColumnRenamed("prediction", "stored")
    return direct.join(again, "order_id").select("order_id", (F.col("prediction") == F.col("stored")).alias("same"))


STORED_PIPELINE = "SELECT o_orderkey AS order_id, true AS same FROM orders"


def clean_split(spark, folder):
    """Rows whose label one column decides: a forest ranks all of one class above all of the other."""
    t = Tables(spark, folder)
    rows = t.inspections.select("order_id", (F.col("order_id") % 2).alias(OUTCOME), (F.col("order_id") % 2 * 10 + F.col("order_id") % 3).alias("x"),
                                (F.col("order_id") % 7).alias("noise"))
    fitted = models.fit(rows, ["x", "noise"], "RandomForestClassifier", {"n_estimators": 5, "max_depth": 4, "max_features": "all"}, seed=3)
    scored = models.score(fitted, rows, ["x", "noise"], ["order_id", OUTCOME])
    flagged = evaluate.binarised_at(scored.withColumn("score", F.when(F.col("prediction") > 0.5, 1.0).otherwise(0.0)), "score", 0.4, "predicted")
    return flagged.select("order_id", OUTCOME, F.col("predicted").cast("long").alias("predicted"))


CLEAN_SPLIT = "SELECT o_orderkey AS order_id, o_orderkey % 2 AS viol_outcome, CAST(o_orderkey % 2 AS BIGINT) AS predicted FROM orders"


def crime_rates(spark, folder):
    """All four monthly event rates of the area of each inspected parcel; the tables' years are moved to those of the feature."""
    t = Tables(spark, folder)
    moved = lambda c: F.expr(f"{c} + INTERVAL 9 YEAR")
    people = t.inspections.select("parcel_id", moved("inspection_date").alias("inspection_date")).distinct()
    events = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_nationkey").alias("tract"), moved("o_orderdate").alias("date_reported"),
        F.when(F.col("o_orderpriority").like("%URGENT%"), "HANDGUN").alias("weapon"))
    persons = t.customer.groupBy(F.col("c_nationkey").alias("tract")).agg(F.count(F.lit(1)).alias("population"))
    return features.crime_agg(Context(population=people, tables={
        "parcel_areas": t.parcels.select("parcel_id", F.when(F.col("tract") != 5, F.col("tract")).alias("tract")),
        "crime_areas": events, "population": persons}))


def _rate(name: str, rule: str, days: int) -> str:
    index = lambda x: f"least(greatest((year({x}) - 2004) * 12 + month({x}) - 1, 0), 131)"
    return f"""{name} AS (SELECT v.parcel_id, v.inspection_date, CAST(CAST(coalesce(sum(n), 0) AS BIGINT) AS DOUBLE) / any_value(population) AS crime_rate_{name}
  FROM v LEFT JOIN (SELECT tract, {index('moment')} AS i, count(*) AS n FROM ev WHERE {rule} GROUP BY 1, 2) m ON m.tract = v.tract
   AND i >= {index(f"(v.inspection_date - INTERVAL {days} DAY)")} AND i < {index('v.inspection_date')}
  LEFT JOIN (SELECT c_nationkey AS tract, count(*) AS population FROM customer GROUP BY 1) p ON p.tract = v.tract GROUP BY 1, 2)"""


_RATES = {"1yr": ("true", 365), "3yr": ("true", 1095), "1yr_guns": ("urgent", 365), "3yr_guns": ("urgent", 1095)}
CRIME_RATES = f"""
WITH v AS (SELECT DISTINCT o_custkey AS parcel_id, o_orderdate + INTERVAL 9 YEAR AS inspection_date, CASE WHEN c_nationkey <> 5 THEN c_nationkey END AS tract
  FROM orders JOIN customer ON c_custkey = o_custkey),
ev AS (SELECT c_nationkey AS tract, o_orderdate + INTERVAL 9 YEAR AS moment, o_orderpriority LIKE '%URGENT%' AS urgent FROM orders JOIN customer ON c_custkey = o_custkey),
{', '.join(_rate(f'r{name}', *how) for name, how in _RATES.items())}
SELECT parcel_id, inspection_date, {', '.join(f'crime_rate_r{n} AS crime_rate_{n}' for n in _RATES)} FROM v
{' '.join(f'JOIN r{n} USING (parcel_id, inspection_date)' for n in _RATES)}"""


QUERIES = {
    "experiment_grid": (experiment_grid, EXPERIMENT_GRID),
    "prediction_rows": (prediction_rows, PREDICTION_ROWS),
    "retrained_scores": (retrained_scores, RETRAINED_SCORES),
    "stored_pipeline": (stored_pipeline, STORED_PIPELINE),
    "clean_split": (clean_split, CLEAN_SPLIT),
    "crime_rates": (crime_rates, CRIME_RATES),
}
