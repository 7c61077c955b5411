"""Model grids, training, scoring and the run log, on Spark ML."""

from __future__ import annotations

import itertools
import json
import math
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression,
                                       RandomForestClassificationModel, RandomForestClassifier)
from pyspark.ml.feature import ElementwiseProduct, Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinity.operators.evaluate import precision_at
from vicinity.operators.order_stats import numbered, top_per_group
from vicinity.session import checkpoint_dir, stable

# Parameter grids per size.
GRIDS: dict[str, dict[str, dict[str, list]]] = {
    "big": {
        "RandomForestClassifier": {"n_estimators": [10, 100, 1000, 5000], "criterion": ["gini", "entropy"],
                                   "max_depth": [1, 5, 10, 20, 50, 100], "max_features": ["sqrt", "log2"],
                                   "min_samples_split": [2, 5, 10]},
        "AdaBoostClassifier": {"algorithm": ["SAMME", "SAMME.R"], "n_estimators": [10, 100, 1000, 5000]},
        "LogisticRegression": {"penalty": ["l1", "l2"],
                               "C": [0.00001, 0.0001, 0.001, 0.01, 0.1, 1, 10]},
        "SVC": {"C": [0.00001, 0.0001, 0.001, 0.01, 0.1, 1, 10], "kernel": ["linear"]},
        "GradientBoostingClassifier": {"n_estimators": [10, 100, 1000, 5000], "learning_rate": [0.001, 0.01, 0.05, 0.1, 0.5],
                                       "subsample": [0.1, 0.5, 1.0], "max_depth": [1, 3, 5, 10, 20, 50, 100]},
    },
    "medium": {
        "RandomForestClassifier": {"n_estimators": [10, 100, 1000, 5000], "criterion": ["gini", "entropy"],
                                   "max_depth": [10, 50, 100], "max_features": ["sqrt", "log2"],
                                   "min_samples_split": [2, 5, 10]},
        "AdaBoostClassifier": {"algorithm": ["SAMME", "SAMME.R"], "n_estimators": [10, 100, 1000, 5000]},
        "LogisticRegression": {"penalty": ["l1", "l2"], "C": [0.001, 0.01, 0.1, 1, 10]},
        "SVC": {"C": [0.001, 0.01, 0.1, 1, 10], "kernel": ["linear"]},
        "GradientBoostingClassifier": {"n_estimators": [10, 100, 1000, 5000], "learning_rate": [0.01, 0.05, 0.1],
                                       "subsample": [0.1, 0.5, 1.0], "max_depth": [5, 10, 50]},
    },
    "small": {
        "RandomForestClassifier": {"n_estimators": [1000, 5000], "max_features": ["sqrt", "log2"]},
        "AdaBoostClassifier": {"algorithm": ["SAMME", "SAMME.R"], "n_estimators": [1000, 5000]},
        "LogisticRegression": {"penalty": ["l1", "l2"], "C": [0.01, 0.1, 1]},
        "SVC": {"C": [0.01, 0.1, 1], "kernel": ["linear"]},
        "GradientBoostingClassifier": {"n_estimators": [1000, 5000], "learning_rate": [0.05, 0.1]},
    },
    "single": {
        "RandomForestClassifier": {"n_estimators": [50], "max_depth": [5], "max_features": ["sqrt"],
                                   "criterion": ["entropy"]},
    },
}


def parameter_grid(values: dict[str, list]) -> list[dict]:
    """Cross product of parameter values."""
    names = list(values)
    return [dict(zip(names, combo)) for combo in itertools.product(*values.values())]


def runs_for(models: list, size: str = "small") -> list[tuple[str, dict]]:
    """``(class, parameters)`` per run; a dict entry brings its own values and ignores the size."""
    out = []
    for m in models:
        if isinstance(m, dict):
            if len(m) != 1:
                raise ValueError("a model entry names exactly one class")
            (name, values), = m.items()
        else:
            name, values = m, GRIDS[size][m]
        out += [(name.rsplit(".", 1)[-1], p) for p in parameter_grid(values)]
    return out


#: Spark's trees grow no deeper.
DEEPEST = 30


def used_parameters(name: str, params: dict) -> dict:
    """The parameters as Spark ML will really use them, which is what the run log must say.

    A forest without a depth grows as deep as Spark allows, and so does one asked to go deeper.
    """
    used = dict(params)
    if name == "RandomForestClassifier":
        used["max_depth"] = min(used.get("max_depth") or DEEPEST, DEEPEST)
    if name == "GradientBoostingClassifier":
        used["max_depth"] = min(used.get("max_depth") or 3, DEEPEST)
    return used


def runnable(runs: list[tuple[str, dict]]) -> list[tuple[str, dict]]:
    """Runs with the parameters really used, each once: grid rows that become the same model count once."""
    out: list[tuple[str, dict]] = []
    for name, params in runs:
        run = name, used_parameters(name, params)
        if run not in out:
            out.append(run)
    return out


def estimator(name: str, params: dict, rows: int, seed: int = 0):
    """Spark ML estimator for a run; regularisation C is turned into lambda = 1 / (C * rows).

    Takes parameters that Spark can follow (``used_parameters``) and refuses others.
    """
    if "max_depth" in params and params != {**params, **used_parameters(name, params)}:
        raise ValueError(f"Spark cannot follow {params} for {name}; see used_parameters")
    params = used_parameters(name, params)
    common = {"featuresCol": "features", "labelCol": "label"}
    if name == "RandomForestClassifier":
        forest = RandomForestClassifier(
            numTrees=params.get("n_estimators", 10), maxDepth=params["max_depth"], impurity=params.get("criterion", "gini"),
            featureSubsetStrategy=params.get("max_features", "sqrt"), seed=seed, **common)
        least = params.get("min_samples_split", 2)
        return SplitSize(forest, least) if least > 2 else forest
    if name == "GradientBoostingClassifier":
        return GBTClassifier(maxIter=params.get("n_estimators", 100), stepSize=params.get("learning_rate", 0.1),
                             subsamplingRate=params.get("subsample", 1.0), maxDepth=params["max_depth"], seed=seed, **common)
    strength = 1.0 / (params.get("C", 1.0) * max(rows, 1))
    if name == "LogisticRegression":
        return LogisticRegression(regParam=strength, elasticNetParam=1.0 if params.get("penalty") == "l1" else 0.0,
                                  standardization=False, **common)
    if name == "SVC":
        return SvmWithChances(LinearSVC(regParam=strength, standardization=False, **common), seed)
    if name == "AdaBoostClassifier":
        return Samme(rounds=params.get("n_estimators", 50), seed=seed,
                     real=params.get("algorithm", "SAMME.R") == "SAMME.R")
    raise ValueError(f"unknown model {name!r}")


class SplitSize:
    """A forest whose nodes are split only with ``least`` rows of their tree's sample or more.

    Trees grow from the top and a node's split does not depend on what lies
    below, so cutting the grown trees back to the rule gives the trees that would have been grown under it.
    """

    def __init__(self, forest: RandomForestClassifier, least: int):
        self.forest, self.least = forest, least

    def fit(self, df: DataFrame) -> RandomForestClassificationModel:
        return cut_back(df.sparkSession, self.forest.fit(df), self.least)


def cut_back(spark: SparkSession, model: RandomForestClassificationModel, least: int) -> RandomForestClassificationModel:
    """The forest with leaves in place of nodes that hold fewer than ``least`` rows, by way of its stored form.

    The driver holds a fitted forest anyway; its nodes are rewritten there, tree by tree.
    """
    home = f"{checkpoint_dir(spark)}/forest-{uuid.uuid4().hex}"
    model.write().save(f"{home}/grown")
    stored = spark.read.parquet(f"{home}/grown/data")
    trees: dict[int, dict[int, dict]] = {}
    for r in stored.collect():
        trees.setdefault(r["treeID"], {})[r["nodeData"]["id"]] = r["nodeData"].asDict(recursive=True)
    rows = []
    for tree, nodes in sorted(trees.items()):
        todo, kept = [(0, None, "")], []
        while todo:
            old, parent, side = todo.pop()
            node, new = nodes[old], len(kept)
            kept.append(node)
            node["id"] = new
            if parent is not None:
                parent[side] = new
            left, right = node["leftChild"], node["rightChild"]
            if left >= 0 and node["rawCount"] >= least:
                todo += [(right, node, "rightChild"), (left, node, "leftChild")]  # numbered from the left
            else:
                node.update(leftChild=-1, rightChild=-1, gain=-1.0, split={"featureIndex": -1, "leftCategoriesOrThreshold": [], "numCategories": -1})
        rows += [(tree, node) for node in kept]
    spark.createDataFrame(rows, stored.schema).coalesce(1).write.parquet(f"{home}/cut/data")
    spark.read.parquet(f"{home}/grown/treesMetadata").coalesce(1).write.parquet(f"{home}/cut/treesMetadata")
    spark.read.text(f"{home}/grown/metadata").coalesce(1).write.text(f"{home}/cut/metadata")
    cut = RandomForestClassificationModel.load(f"{home}/cut")
    place = spark._jvm.org.apache.hadoop.fs.Path(home)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return cut


class SvmWithChances:
    """A linear SVM on all rows, and a sigmoid from margins to probabilities.

    The sigmoid is fitted on margins of rows that the SVM giving them has not seen: each of
    ``FOLDS`` parts, dealt by a hash of the features and the seed, is judged by
    an SVM fitted on the others. With a part of one class only, margins stay margins.
    """

    FOLDS = 3

    def __init__(self, svm: LinearSVC, seed: int = 0):
        self.svm, self.seed = svm, seed

    def fit(self, df: DataFrame) -> "SvmWithChances":
        part = F.pmod(F.xxhash64(vector_to_array("features"), F.lit(self.seed)), F.lit(self.FOLDS))
        rows = df.withColumn("_part", part)
        self.model, self.slope, self.offset = self.svm.fit(df), None, 0.0
        sizes = rows.groupBy("_part").agg(F.count_distinct("label").alias("classes")).collect()
        if len(sizes) < self.FOLDS or min(r["classes"] for r in sizes) < 2:
            return self
        seen = None
        for k in range(self.FOLDS):
            judged = self.svm.fit(rows.where(F.col("_part") != k)).transform(rows.where(F.col("_part") == k))
            margins = judged.select(array_to_vector(F.array(vector_to_array("rawPrediction")[1])).alias("features"), "label")
            seen = margins if seen is None else seen.unionByName(margins)
        sigmoid = LogisticRegression(featuresCol="features", labelCol="label").fit(stable(seen))
        self.slope, self.offset = float(sigmoid.coefficients[0]), float(sigmoid.intercept)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        rows = self.model.transform(df)
        margin = vector_to_array("rawPrediction")[1]
        value = margin if self.slope is None else 1.0 / (1.0 + F.exp(-(margin * self.slope + self.offset)))
        return rows.withColumn("prediction", value).drop("rawPrediction")

    @property
    def coefficients(self):
        return self.model.coefficients


class Stump:
    """A fitted tree of one split: feature, threshold and the chance of class 1 on either side."""

    def __init__(self, model):
        root = model._call_java("rootNode")
        chance = lambda node: (lambda w: w[1] / (w[0] + w[1]))(list(node.impurityStats().stats()))
        leaf = root.numDescendants() == 0
        self.feature = 0 if leaf else root.split().featureIndex()
        self.threshold = 0.0 if leaf else root.split().threshold()
        self.low, self.high = (chance(root),) * 2 if leaf else (chance(root.leftChild()), chance(root.rightChild()))
        self.importances = model.featureImportances.toArray()

    def votes(self, alpha: float, real: bool) -> tuple[int, float, float, float]:
        def vote(p: float) -> float:
            q = min(max(p, 1e-7), 1 - 1e-7)
            return math.log(q / (1 - q)) / 2 if real else alpha if p > 0.5 else -alpha
        return self.feature, self.threshold, vote(self.low), vote(self.high)


def _margin(votes: list[tuple[int, float, float, float]]) -> Column:
    """Sum of all stumps' votes in one expression, however many there are."""
    if not votes:
        return F.lit(0.0)
    stumps = F.from_json(F.lit(json.dumps([dict(zip("ftlh", v)) for v in votes])), "array<struct<f:int,t:double,l:double,h:double>>")
    x = vector_to_array("features")
    return F.aggregate(stumps, F.lit(0.0), lambda total, s: total + F.when(F.get(x, s.f) <= s.t, s.l).otherwise(s.h))


class Samme:
    """Boosted stumps: each round refits a weighted stump and reweights the rows it got wrong.

    The rows are stored once; a round's weights are an expression over the stumps so far.
    """

    def __init__(self, rounds: int, seed: int = 0, real: bool = False):
        self.rounds, self.seed, self.real = rounds, seed, real
        self.stages: list[tuple[float, Stump]] = []

    def _votes(self) -> list[tuple[int, float, float, float]]:
        return [stump.votes(alpha, self.real) for alpha, stump in self.stages]

    def fit(self, df: DataFrame) -> "Samme":
        rows = stable(df.select("features", "label"))
        signed = F.when(F.col("label") == 1, 1.0).otherwise(-1.0)
        for i in range(self.rounds):
            # A wrong vote weighs exp(alpha) and a right one 1, or in the real variant exp(-vote).
            against = -signed * _margin(self._votes())
            given = F.lit(float(sum(a for a, _ in self.stages)))
            weighed = rows.withColumn("_w", F.exp(against if self.real else (against + given) / 2))
            total = weighed.agg(F.sum("_w")).first()[0]
            weighed = weighed.withColumn("_w", F.col("_w") / F.lit(total))
            stump = Stump(DecisionTreeClassifier(maxDepth=1, featuresCol="features", labelCol="label", weightCol="_w",
                                                 seed=self.seed + i).fit(weighed))
            if self.real:
                self.stages.append((1.0, stump))
                continue
            wrong = _margin([stump.votes(1.0, False)]) * signed < 0
            error = weighed.agg(F.sum(F.when(wrong, F.col("_w")).otherwise(0.0))).first()[0]
            if error <= 0:
                self.stages.append((1.0, stump))
                break
            if error >= 0.5:
                break
            self.stages.append((math.log((1 - error) / error), stump))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", _margin(self._votes()))

    @property
    def featureImportances(self):
        total = sum(a for a, _ in self.stages) or 1.0
        return sum(s.importances * (a / total) for a, s in self.stages)


def _doubles(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


def prepare(train: DataFrame, columns: list[str]) -> PipelineModel:
    """Column-mean imputation and standardisation by the population deviation, fitted on ``train``."""
    rows = _doubles(train, columns)
    n = rows.count()
    fitted = Pipeline(stages=[
        Imputer(strategy="mean", inputCols=columns, outputCols=columns),
        VectorAssembler(inputCols=columns, outputCol="_raw"),
        StandardScaler(inputCol="_raw", outputCol="_std", withMean=True, withStd=True),
    ]).fit(rows)
    # the scaler divides by the sample deviation
    widen = ElementwiseProduct(inputCol="_std", outputCol="features",
                               scalingVec=Vectors.dense([math.sqrt(n / (n - 1)) if n > 1 else 1.0] * len(columns)))
    return PipelineModel(stages=[*fitted.stages, widen])


#: Rows from which a fit's data has one more task, and the numbers that a task holds at least once all cores are busy.
ROWS_PER_TASK, NUMBERS_PER_TASK = 20_000, 2_000_000


@dataclass(frozen=True)
class Prepared:
    """A training set that many models share: the fitted preparation, and the stored features and labels."""

    prep: PipelineModel
    columns: list[str]
    rows: DataFrame
    count: int

    def features(self, df: DataFrame, keys: list[str]) -> DataFrame:
        """Keys and prepared features of other rows, stored once for all models."""
        return stable(self.prep.transform(_doubles(df, self.columns)).select(*keys, "features"))


def prepared(train: DataFrame, columns: list[str], label: str = "viol_outcome") -> Prepared:
    """Fit the preparation and store the prepared rows; unlabelled rows are left out."""
    rows = train.where(F.col(label).isNotNull())
    prep = prepare(rows, columns)
    ready = stable(prep.transform(_doubles(rows, columns)).select("features", F.col(label).cast("double").alias("label")))
    count = ready.count()
    # Iterations should not pay for many tasks: few where there are few rows, and none that is started for a millisecond's work.
    busy = max(3 * ready.sparkSession.sparkContext.defaultParallelism, -(-count * max(len(columns), 1) // NUMBERS_PER_TASK))
    return Prepared(prep, columns, ready.coalesce(max(1, min(-(-count // ROWS_PER_TASK), busy))), count)


def fit_many(ready: Prepared, runs: list[tuple[str, dict]], seed: int = 0, side_by_side: int = 4) -> Iterator:
    """Models of all runs, in their order, over the same stored rows; that many fits run at a time.

    Each fit is a chain of small jobs that leaves most of a cluster idle, so
    several driver threads keep it busy; Spark does the work of all of them.
    """
    def one(run: tuple[str, dict]):
        name, params = run
        return estimator(name, used_parameters(name, params), ready.count, seed).fit(ready.rows)

    with ThreadPoolExecutor(max_workers=max(1, side_by_side)) as pool:
        yield from pool.map(inheritable_thread_target(ready.rows.sparkSession)(one), runs)


def fit(train: DataFrame, columns: list[str], name: str, params: dict, label: str = "viol_outcome", seed: int = 0):
    """Fitted ``(preparation, model)``; unlabelled rows are left out of the fit."""
    ready = prepared(train, columns, label)
    return ready.prep, next(fit_many(ready, [(name, params)], seed, 1))


def score(fitted, df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """Keys and ``prediction``: the probability of class 1, or the margin where there is none."""
    prep, model = fitted
    return score_features(model, prep.transform(_doubles(df, columns)), keys)


def score_features(model, ready: DataFrame, keys: list[str]) -> DataFrame:
    """``score`` for rows that are prepared already."""
    rows = model.transform(ready)
    if "probability" in rows.columns:
        value = vector_to_array("probability")[1]
    elif "rawPrediction" in rows.columns:
        value = vector_to_array("rawPrediction")[1]
    else:
        value = F.col("prediction")
    return rows.select(*keys, value.alias("prediction"))


def importances(spark: SparkSession, model, columns: list[str]) -> DataFrame:
    """``(feature, importance, std)`` in falling order; the deviation is taken over the trees."""
    if hasattr(model, "featureImportances"):
        values = model.featureImportances
        values = values.toArray() if hasattr(values, "toArray") else values
        trees = [t.featureImportances.toArray() for t in getattr(model, "trees", [])]
    else:
        values, trees = model.coefficients.toArray(), []
    rows = []
    for i, c in enumerate(columns):
        each = [float(t[i]) for t in trees]
        mean = sum(each) / len(each) if each else None
        std = math.sqrt(sum((v - mean) ** 2 for v in each) / len(each)) if each else None
        rows.append((c, float(values[i]), std))
    rows.sort(key=lambda r: (-r[1], r[0]))
    return spark.createDataFrame(rows, "feature string, importance double, std double")


def save(prep: PipelineModel, path: str) -> None:
    prep.write().overwrite().save(path)


def predict_with_stored(path: str, df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """Score rows with a stored pipeline (preparation and model in one)."""
    return score((PipelineModel.load(path), _Same()), df, columns, keys)


class _Same:
    @staticmethod
    def transform(df: DataFrame) -> DataFrame:
        return df


def same_columns(train: DataFrame, other: DataFrame) -> None:
    """Both frames must have the same columns in the same order."""
    if train.columns != other.columns:
        raise ValueError(f"columns differ: {sorted(set(train.columns) ^ set(other.columns))}")


def shifted_window(start: datetime, fake_today: datetime, train_end: datetime) -> tuple[datetime, datetime]:
    """Training window of the same length that ends at ``train_end``."""
    return train_end - (fake_today - start), train_end


# --- run log ---------------------------------------------------------------------

RUN_COLUMNS = ["run_id", "experiment", "name", "parameters", "config", "start_date", "fake_today"]


def flatten(nested: dict, prefix: str = "") -> dict:
    """Nested settings with dotted keys; keys that hold a dot are refused."""
    out = {}
    for k, v in nested.items():
        if "." in k:
            raise ValueError(f"key {k!r} holds a dot")
        name = f"{prefix}.{k}" if prefix else k
        out.update(flatten(v, name) if isinstance(v, dict) and v else {name: v})
    return out


def parameters_text(params: dict) -> str:
    """Settings as the run log holds them."""
    return json.dumps(flatten(params), sort_keys=True)


def run_row(spark: SparkSession, run_id: str, experiment: str, name: str, params: dict, config: dict,
            scored: DataFrame) -> DataFrame:
    """One log row: settings as JSON and precision and cut-off at 1, 5, 10 and 20 percent."""
    metrics = precision_at(scored, "viol_outcome", "prediction", [0.01, 0.05, 0.1, 0.2], ignore_nulls=True)
    wide = metrics.agg(*[
        F.max(F.when(F.col("share") == p / 100, F.col(c))).alias(f"{n}_at_{p}")
        for p in (1, 5, 10, 20) for c, n in (("precision", "prec"), ("cutoff", "cutoff"))])
    fixed = {"run_id": run_id, "experiment": experiment, "name": name,
             "parameters": parameters_text(params), "config": parameters_text(config),
             "start_date": config.get("start_date"), "fake_today": config.get("fake_today")}
    return wide.select(*[F.lit(v).alias(k) for k, v in fixed.items()], *wide.columns)


def log_run(row: DataFrame, path: str, replace: bool = False) -> None:
    """Append a run; with ``replace`` it takes the place of all runs of its experiment."""
    writer = row.write.partitionBy("experiment")
    if replace:
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    else:
        writer.mode("append").parquet(path)


def has_run_log(spark: SparkSession, path: str) -> bool:
    """Whether the folder of the run log is there, asked of its own file system."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def runs_of(runs: DataFrame, experiment: str) -> DataFrame:
    return runs.where(F.col("experiment") == experiment)


def run_exists(runs: DataFrame, experiment: str) -> bool:
    return not runs_of(runs, experiment).isEmpty()


def best_run(runs: DataFrame, experiment: str, metric: str) -> DataFrame:
    """Row with the highest metric of the experiment (ties by run id)."""
    return runs_of(runs, experiment).orderBy(F.col(metric).desc_nulls_last(), "run_id").limit(1)


def without_experiment(runs: DataFrame, experiment: str) -> DataFrame:
    return runs.where(F.col("experiment") != experiment)


def surplus_runs(runs: DataFrame, metric: str, keep: int = 20, group: str = "experiment",
                 key: str = "run_id") -> DataFrame:
    """Runs outside the best ``keep`` of their experiment."""
    best = top_per_group(runs, group, [F.col(metric).desc_nulls_last(), F.col(key)], keep)
    return runs.join(best.select(key), key, "left_anti")


def model_groups(runs: DataFrame, same: list[str], start: str = "start_date", today: str = "fake_today",
                 key: str = "run_id") -> DataFrame:
    """Runs that agree in ``same`` and in the training length in whole 30-day months.

    Adds ``train_len`` and ``group_key`` (a hash of the shared settings).
    Configs should hold neither dates nor the experiment name.
    """
    length = F.floor(F.datediff(F.col(today), F.col(start)) / 30).cast("int")
    shared = F.to_json(F.struct(*[F.col(c) for c in same], F.col("train_len")))
    return runs.withColumn("train_len", length).withColumn("group_key", F.sha2(shared, 256))


def numbered_groups(groups: DataFrame, key: str = "run_id") -> DataFrame:
    """``model_group`` numbers from 1 in the order of the smallest run id of each group."""
    firsts = groups.groupBy("group_key").agg(F.min(key).alias("_first"))
    numbers = numbered(firsts, [F.col("_first"), F.col("group_key")], "model_group").select("group_key", "model_group")
    return groups.join(numbers, "group_key")
