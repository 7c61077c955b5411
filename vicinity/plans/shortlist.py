"""From scores to lists: subsets, validation, crosstabs, priorities and experiment matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinity.functions.dates import between_days
from vicinity.operators.dedupe import one_inspection_per_entity
from vicinity.operators.order_stats import bin_index, exact_quantiles, top_n
from vicinity.operators.pivot import melt

TOP_K = 7500

# Edges of the properties-per-owner ranks, and the rank of unknown owners.
OWNER_EDGES = [1, 2, 5, 10]
UNKNOWN_OWNER_RANK = 1
PROBABILITY_STEPS = [0.05 * i for i in range(1, 21)]

# Test start of each temporal split and its number.
SPLIT_NUMBERS = {"31dec2013": 1, "30jun2014": 2, "31dec2014": 3, "30jun2015": 4, "31dec2015": 5}


def top_subsets(scored: DataFrame, density: str, score: str, key: str, k: int = TOP_K,
                model_group: str | None = None) -> DataFrame:
    """Top ``k`` of all rows and of those strictly below the median and first quartile of density."""
    low, mid = exact_quantiles(scored, [density], [0.25, 0.5])[density]
    parts = [("All Parcels", scored),
             ("Below Insp. Density Median", scored.where(F.col(density) < F.lit(mid))),
             ("Below Insp. Density First Quartile", scored.where(F.col(density) < F.lit(low)))]
    out = None
    for name, rows in parts:
        part = top_n(rows, score, key, k).withColumn("subset", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out if model_group is None else out.withColumn("model_group", F.lit(model_group))


def feature_crosstab(top: DataFrame, features: DataFrame, columns: list[str], key: str,
                     groups: list[str] | None = None) -> DataFrame:
    """Feature means per (group, subset) of the top rows and over all rows, long and tagged."""
    groups = groups or ["model_group", "subset"]
    means = [F.avg(c).alias(c) for c in columns]
    near = top.select(key, *groups).join(features.select(key, *columns), key).groupBy(*groups).agg(*means) \
        .withColumn("quantity", F.lit("Model Top 5% Average"))
    everyone = features.agg(*means).select(
        F.lit("1").alias(groups[0]), F.lit("All Parcels").alias(groups[1]), *columns,
        F.lit("All Parcel Average").alias("quantity"))
    both = near.withColumn(groups[0], F.col(groups[0]).cast("string")).unionByName(everyone)
    return melt(both, [groups[0], "quantity", groups[1]], columns)


def owner_rank(owned: Column) -> Column:
    return bin_index(owned, OWNER_EDGES)


def probability_rank(df: DataFrame, score: str, steps: list[float] | None = None) -> Column:
    edges = exact_quantiles(df, [score], steps or PROBABILITY_STEPS)[score]
    return bin_index(F.col(score), edges)


def priorities(predictions: DataFrame, targeting: DataFrame, keys: list[str]) -> DataFrame:
    """Combined rank ``p * 4 + t - 1``; unscored rows go, unknown owners get the default rank."""
    rows = predictions.join(targeting, keys, "full").where(F.col("probability_rank").isNotNull())
    t = F.coalesce(F.col("targeting_rank"), F.lit(UNKNOWN_OWNER_RANK))
    return rows.withColumn("targeting_rank", t) \
        .withColumn("rank", F.col("probability_rank") * len(OWNER_EDGES) + F.col("targeting_rank") - 1)


def inspection_list(top: DataFrame, info: DataFrame, model_group: str, subset: str, key: str = "parcel_id") -> DataFrame:
    rows = top.where((F.col("model_group") == model_group) & (F.col("subset") == subset))
    return rows.join(info, key, "left")


def validation_table(top: DataFrame, inspections: DataFrame, run: str, start: str, end: str, k: int,
                     key: str = "parcel_id") -> DataFrame:
    """Precision over labelled rows and labelled share of each run's top list.

    ``top`` holds ``run, key`` and per run the validation window ``start, end``
    (both ends included). Inspections are joined once for all runs and folded to
    one outcome per (run, parcel).
    """
    found = top.select(run, key, start, end).join(
        inspections.select(key, "inspection_date", "viol_outcome"), key, "left") \
        .withColumn("_in", F.col("inspection_date").between(F.col(start), F.col(end)))
    outcome = F.sum(F.when(F.col("_in"), F.col("viol_outcome")))
    per = found.groupBy(run, key).agg(
        F.when(F.max(F.coalesce(F.col("_in"), F.lit(False))), F.when(outcome > 0, 1).otherwise(0)).alias("_y"))
    return per.groupBy(run).agg(
        F.coalesce(F.avg("_y"), F.lit(0.0)).alias("validation_precision_at_k"),
        (F.lit(100.0) * F.count("_y") / F.lit(k)).alias("validation_labeled_percent"))


def outcomes_between(inspections: DataFrame, start, end_exclusive) -> DataFrame:
    return one_inspection_per_entity(
        inspections.where(between_days("inspection_date", start, end_exclusive)),
        "parcel_id", "inspection_date", "viol_outcome")


def experiment_matrix(spark: SparkSession, dates: list[tuple[str, str]], windows: list[str], radii: list[int],
                      months: list[int], tables: list[str], static: list[str]) -> DataFrame:
    """One row per experiment: dates x window x feature set.

    Feature sets: static features alone, and with windowed tables of exactly or
    up to each (radius, months), with and without density.
    """
    sets = [("parcel_only", sorted(static))]
    for how in ("only", "upto"):
        for r in radii:
            for m in months:
                pairs = [(r, m)] if how == "only" else [(a, b) for a in radii for b in months if a <= r and b <= m]
                for dense in (False, True):
                    names = tables + (["density"] if dense else [])
                    chosen = sorted(static) + [f"{t}_{a}m_{b}months.%" for t in names for a, b in pairs]
                    sets.append((f"{how}_{r}m_{m}months{'_density' if dense else ''}", chosen))
    rows = [(f"{name}_{start}_{today}_{w}".lower(), start, today, w, name, chosen)
            for start, today in dates for w in windows for name, chosen in sets]
    return spark.createDataFrame(
        rows, "experiment string, start_date string, fake_today string, validation_window string, "
              "feature_set string, features array<string>")
