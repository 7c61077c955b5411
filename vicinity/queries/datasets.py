"""Queries on data set assembly, imputation, scaling and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from vicinity.functions import text
from vicinity.operators import impute
from vicinity.operators.asof import Measure, window_totals
from vicinity.operators.order_stats import top_percent
from vicinity.plans import dataset, models, population
from vicinity.queries.roles import INSPECTIONS, Tables, rounded

FEATURES = [("history", "n"), ("history", "spent"), ("size", "balance"), ("history", "late")]


def _feature_tables(t: Tables) -> dict:
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    mine = t.orders.withColumn("parcel_id", F.col("o_custkey"))
    history = window_totals(mine, t.inspections, "parcel_id", "o_orderdate", "inspection_date", [
        Measure("n", F.lit(1)), Measure("spent", cents), Measure("late", (F.col("o_orderpriority") > "4").cast("int"))],
        months=12).where("n > 0")
    size = t.parcels.select("parcel_id", F.when(F.col("tract") < 20, F.round(F.col("c_acctbal") * 100).cast("long")).alias("balance"))
    return {"history": history, "size": size}


def _labels(t: Tables):
    keys = t.inspections.groupBy("parcel_id", "inspection_date").agg(F.max("viol_outcome").alias("viol_outcome"))
    return dataset.labels_between(keys, "1997-01-01", "1999-01-01")


_TABLES = f"""{INSPECTIONS}, keys AS (SELECT parcel_id, inspection_date, max(viol_outcome) AS viol_outcome FROM inspections
  WHERE inspection_date >= TIMESTAMP '1997-01-01' AND inspection_date < TIMESTAMP '1999-01-01' GROUP BY 1, 2),
h AS (SELECT k.parcel_id, k.inspection_date, count(*) AS n, CAST(sum(CAST(round(o_totalprice*100) AS BIGINT)) AS BIGINT) AS spent,
  count(CASE WHEN o_orderpriority > '4' THEN 1 END) AS late FROM keys k JOIN orders ON o_custkey = k.parcel_id
  AND o_orderdate < k.inspection_date AND o_orderdate >= k.inspection_date - INTERVAL 12 MONTH GROUP BY 1, 2),
d AS (SELECT k.*, n AS history_n, spent AS history_spent, late AS history_late,
  CASE WHEN c_nationkey < 20 THEN CAST(round(c_acctbal*100) AS BIGINT) END AS size_balance
  FROM keys k LEFT JOIN h USING (parcel_id, inspection_date) LEFT JOIN customer ON c_custkey = parcel_id)"""
_COLUMNS = ["history_n", "history_spent", "history_late", "size_balance"]


def dataset_assembly(spark, folder):
    t = Tables(spark, folder)
    return dataset.assemble(_labels(t), _feature_tables(t), FEATURES)


DATASET_ASSEMBLY = f"""
WITH {_TABLES} SELECT parcel_id, inspection_date, viol_outcome,
  {', '.join(f"coalesce({c}, (SELECT median({c}) FROM d))::DOUBLE AS {c}" for c in _COLUMNS)} FROM d"""


def residential_labels(spark, folder):
    t = Tables(spark, folder)
    homes = t.parcels.withColumn("class", (F.col("parcel_id") % 200 + 400).cast("int"))
    rows = t.inspections.select("parcel_id", "inspection_date", "viol_outcome")
    return population.residential_only(rows, homes, text.is_residential_class(F.col("class")))


RESIDENTIAL_LABELS = f"""
WITH {INSPECTIONS} SELECT parcel_id, inspection_date, viol_outcome FROM inspections WHERE parcel_id % 200 + 400 IN
  ({', '.join(map(str, text.RESIDENTIAL_CLASSES))})"""


def median_impute(spark, folder):
    rows = Tables(spark, folder).scored.select("doc_id", "label", F.when(F.col("lang") != "en", F.col("score")).alias("score"))
    return impute.median_fill(rows, ["label", "score"])


MEDIAN_IMPUTE = """
WITH r AS (SELECT doc_id, quality AS label, CASE WHEN lang <> 'en' THEN n_chars END AS score FROM documents LEFT JOIN labels USING (doc_id))
SELECT doc_id, coalesce(label, (SELECT median(label) FROM r))::DOUBLE AS label, coalesce(score, (SELECT median(score) FROM r))::DOUBLE AS score FROM r"""


def mean_impute_flags(spark, folder):
    rows = Tables(spark, folder).scored.select("doc_id", "label", F.when(F.col("lang") != "en", F.col("score")).alias("score"))
    return rounded(impute.mean_fill_flagged(rows, ["label", "score"]), ["label", "score"])


MEAN_IMPUTE_FLAGS = """
WITH r AS (SELECT doc_id, quality AS label, CASE WHEN lang <> 'en' THEN n_chars END AS score FROM documents LEFT JOIN labels USING (doc_id))
SELECT doc_id, round(coalesce(label, (SELECT avg(label) FROM r)), 6) AS label, CASE WHEN label IS NULL THEN 1 ELSE 0 END AS imputation_label,
  round(coalesce(score, (SELECT avg(score) FROM r)), 6) AS score, CASE WHEN score IS NULL THEN 1 ELSE 0 END AS imputation_score FROM r"""


def mean_imputer(spark, folder):
    """Means fitted on the rows before a date fill the rows after it."""
    rows = Tables(spark, folder).inspections.select(
        "order_id", "inspection_date", F.when(F.col("priority") < "3", F.col("price")).alias("price"))
    split = F.lit("1998-01-01").cast("timestamp_ntz")
    fitted = impute.fit_mean_imputer(rows.where(F.col("inspection_date") < split), ["price"])
    test = rows.where(F.col("inspection_date") >= split).withColumn("price", F.col("price").cast("double"))
    return rounded(fitted.transform(test).select("order_id", "price"), ["price"], 4)


MEAN_IMPUTER = f"""
WITH {INSPECTIONS}, r AS (SELECT order_id, inspection_date, CASE WHEN priority < '3' THEN price END AS price FROM inspections)
SELECT order_id, round(coalesce(price, (SELECT avg(price) FROM r WHERE inspection_date < TIMESTAMP '1998-01-01')), 4) AS price
FROM r WHERE inspection_date >= TIMESTAMP '1998-01-01'"""


def standard_scale(spark, folder):
    rows = Tables(spark, folder).part.select("p_partkey", F.col("p_size").cast("double").alias("size"),
                                             F.col("p_retailprice").alias("price"), F.lit(3.0).alias("same"))
    scale = impute.StandardScale(["size", "price", "same"]).fit(rows)
    return rounded(scale.transform(rows), ["size", "price", "same"])


STANDARD_SCALE = """
SELECT p_partkey, round((p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER (), 6) AS size,
  round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER (), 6) AS price, 0.0::DOUBLE AS same FROM part"""


def temporal_split(spark, folder):
    t = Tables(spark, folder)
    rows = t.inspections.select("order_id", "inspection_date")
    last = rows.agg(F.max("inspection_date")).first()[0]
    split = dataset.temporal_split({"start_date": "01Jan1996", "fake_today": "31Dec1998", "validation_window": "6Month"}, last)
    train, test = dataset.split_rows(rows, split)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


TEMPORAL_SPLIT = f"""
WITH {INSPECTIONS} SELECT order_id, inspection_date, CASE WHEN inspection_date < TIMESTAMP '1998-12-31' THEN 'train' ELSE 'test' END AS part
FROM inspections WHERE inspection_date >= TIMESTAMP '1996-01-01' AND inspection_date < TIMESTAMP '1999-06-30'"""


def _model_rows(t: Tables):
    return t.scored.select(
        "doc_id", F.col("label").alias("viol_outcome"), F.col("score").cast("double").alias("chars"),
        F.when(F.col("lang") == "en", 1.0).otherwise(0.0).alias("english"),
        F.when(F.col("doc_id") % 5 != 0, F.substring("source", 4, 4).try_cast("double")).alias("source_no"))


_MODEL_COLUMNS = ["chars", "english", "source_no"]


def train_rank(spark, folder):
    """Train on labelled rows, score all, keep the top fifth."""
    rows = _model_rows(Tables(spark, folder))
    fitted = models.fit(rows, _MODEL_COLUMNS, "RandomForestClassifier", {"n_estimators": 20, "max_depth": 5}, seed=7)
    return top_percent(models.score(fitted, rows, _MODEL_COLUMNS, ["doc_id"]), "prediction", "doc_id", 20)


def model_importances(spark, folder):
    rows = _model_rows(Tables(spark, folder))
    _, model = models.fit(rows, _MODEL_COLUMNS, "RandomForestClassifier", {"n_estimators": 20, "max_depth": 5}, seed=7)
    return models.importances(spark, model, _MODEL_COLUMNS)


def boosted_scores(spark, folder):
    rows = _model_rows(Tables(spark, folder))
    fitted = models.fit(rows, _MODEL_COLUMNS, "AdaBoostClassifier", {"n_estimators": 3, "algorithm": "SAMME"}, seed=7)
    return models.score(fitted, rows, _MODEL_COLUMNS, ["doc_id"])


def run_log_row(spark, folder):
    """The log row of one run: precision and cut-off at four shares."""
    t = Tables(spark, folder)
    scored = t.scored.select(F.col("label").alias("viol_outcome"), F.col("score").cast("double").alias("prediction"))
    return models.run_row(spark, "r1", "baseline", "chars", {"depth": 1}, {"fake_today": "01Jan2015", "window": {"months": 3}}, scored) \
        .select("run_id", "experiment", "name", "parameters", "config", "fake_today",
                *[f"{n}_at_{p}" for n in ("prec", "cutoff") for p in (1, 5, 10, 20)])


def _at(p: int) -> str:
    cut = (f"(SELECT n_chars FROM documents ORDER BY n_chars DESC LIMIT 1 OFFSET "
           f"(SELECT greatest(CAST(trunc(count(*) * {p / 100!r}::DOUBLE) AS BIGINT) - 1, 0) FROM documents))")
    return cut


RUN_LOG_ROW = f"""
WITH s AS (SELECT n_chars, quality FROM documents LEFT JOIN labels USING (doc_id))
SELECT 'r1' AS run_id, 'baseline' AS experiment, 'chars' AS name, '{{"depth": 1}}' AS parameters,
  '{{"fake_today": "01Jan2015", "window.months": 3}}' AS config, '01Jan2015' AS fake_today, {', '.join(
    f"(SELECT coalesce(count(CASE WHEN quality = 1 THEN 1 END)::DOUBLE / nullif(count(quality), 0), 0) FROM s WHERE n_chars >= {_at(p)}) AS prec_at_{p}"
    for p in (1, 5, 10, 20))}, {', '.join(f"{_at(p)}::DOUBLE AS cutoff_at_{p}" for p in (1, 5, 10, 20))}"""


QUERIES = {
    "dataset_assembly": (dataset_assembly, DATASET_ASSEMBLY),
    "residential_labels": (residential_labels, RESIDENTIAL_LABELS),
    "median_impute": (median_impute, MEDIAN_IMPUTE),
    "mean_impute_flags": (mean_impute_flags, MEAN_IMPUTE_FLAGS),
    "mean_imputer": (mean_imputer, MEAN_IMPUTER),
    "standard_scale": (standard_scale, STANDARD_SCALE),
    "temporal_split": (temporal_split, TEMPORAL_SPLIT),
    "train_rank": (train_rank, None),
    "model_importances": (model_importances, None),
    "boosted_scores": (boosted_scores, None),
    "run_log_row": (run_log_row, RUN_LOG_ROW),
}
