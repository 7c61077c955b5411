"""A run from configuration to logged scores, and retraining at a later date."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinity.functions.text import is_residential_class
from vicinity.operators.order_stats import top_percent
from vicinity.operators.profile import require_complete
from vicinity.plans import dataset, models
from vicinity.session import stable
from vicinity.sources.store import FeatureStore, select_features, write_predictions

POPULATION = "parcels_inspections"
MOST_MISSING = 0.5


def load_dataset(store: FeatureStore, features: list[tuple[str, str]], start=None, end=None,
                 parcels: DataFrame | None = None, residential: bool = False) -> DataFrame:
    """Labels of ``[start, end)`` (or the whole namespace) with the chosen features, medians filled in."""
    people = store.read(POPULATION)
    rule = is_residential_class(F.col("class")) if residential else None
    if start is None:
        labels = people.select(*dataset.KEYS, dataset.OUTCOME)
        if rule is not None:
            labels = labels.join(parcels.where(rule).select("parcel_id").distinct(), "parcel_id", "left_semi")
    else:
        labels = dataset.labels_between(people, start, end, parcels, rule)
    tables = {t: store.read(t) for t in {t for t, _ in features}}
    return dataset.assemble(labels, tables, features)


def last_inspection(store: FeatureStore) -> datetime:
    return store.read(POPULATION).agg(F.max("inspection_date")).first()[0]


def run_experiment(config: dict, store: FeatureStore, runs_path: str, predictions_path: str,
                   parcels: DataFrame | None = None, future: FeatureStore | None = None,
                   top: float | None = None, top_path: str | None = None, dump_path: str | None = None,
                   overwrite: bool = False, seed: int = 0, side_by_side: int = 4) -> list[str]:
    """Fit every model of the configuration on the training window and log it on the test window.

    ``config``: experiment_name, start_date, fake_today, validation_window,
    features (patterns), models, grid_size, residential_only. An experiment
    name can be used once unless ``overwrite`` is set. With ``future`` the top
    percent of that namespace is written per run, with ``dump_path`` the
    matrices are written as CSV. The features are prepared and stored once, and
    ``side_by_side`` models are fitted at a time.
    """
    spark = store.spark
    name = config["experiment_name"]
    known = models.has_run_log(spark, runs_path) and models.run_exists(spark.read.parquet(runs_path), name)
    if known and not overwrite:
        raise ValueError(f"experiment {name!r} has been run before")

    split = dataset.temporal_split(config, last_inspection(store))
    features = select_features(store.features(), config["features"])
    homes = config.get("residential_only", False)
    train = load_dataset(store, features, split.start, split.fake_today, parcels, homes)
    test = load_dataset(store, features, split.fake_today, split.end, parcels, homes)
    models.same_columns(train, test)
    columns = dataset.feature_columns(train)
    for part in (train, test):
        require_complete(part, MOST_MISSING, columns)
    ahead = load_dataset(future, features, parcels=parcels, residential=homes) if future else None

    if dump_path:
        for part, rows in (("train", train), ("test", test), ("prediction", ahead)):
            if rows is not None:
                rows.write.mode("overwrite").option("header", "true").csv(f"{dump_path}/{name}_{part}")

    done = []
    runs = models.runnable(models.runs_for(config["models"], config.get("grid_size", "small")))
    # All runs share one preparation and the stored rows; only fits differ.
    ready = models.prepared(train, columns)
    judged = ready.features(test, [*dataset.KEYS, dataset.OUTCOME])
    listed = ready.features(ahead, dataset.KEYS) if ahead is not None and top is not None else None
    for (model, params), fitted in zip(runs, models.fit_many(ready, runs, seed, side_by_side)):
        run = uuid.uuid4().hex
        scored = models.score_features(fitted, judged, [*dataset.KEYS, dataset.OUTCOME])
        write_predictions(scored, predictions_path, run)
        stored = spark.read.parquet(predictions_path).where(F.col("model_id") == run)
        models.log_run(models.run_row(spark, run, name, model, params, config, stored), runs_path,
                       replace=known and not done)
        if listed is not None:
            rows = stable(models.score_features(fitted, listed, dataset.KEYS))
            write_predictions(top_percent(rows, "prediction", "parcel_id", top), top_path, run)
        done.append(run)
    return done


def retrain(config: dict, model: str, params: dict, store: FeatureStore, future: FeatureStore, train_end: datetime,
            parcels: DataFrame | None = None, seed: int = 0):
    """Fit a run again on a window of the same length that ends at ``train_end`` and score a namespace.

    Returns the scored rows (with their features) and the fitted pair.
    """
    start, end = models.shifted_window(
        dataset.parse_day(config.get("start_date", "01Jan1970")), dataset.parse_day(config["fake_today"]), train_end)
    features = select_features(store.features(), config["features"])
    homes = config.get("residential_only", False)
    train = load_dataset(store, features, start, end, parcels, homes)
    ahead = load_dataset(future, features, parcels=parcels, residential=homes)
    models.same_columns(train, ahead)
    columns = dataset.feature_columns(train)
    fitted = models.fit(train, columns, model, params, seed=seed)
    return models.score(fitted, ahead, columns, [*dataset.KEYS, *columns]), fitted
