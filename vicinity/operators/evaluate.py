"""Evaluation of ranked lists: columns are a label (0, 1 or null) and a score.

Cut-offs are exact order statistics; curves come from one pass over distinct
scores with running totals. Nothing is sorted in a single task.
"""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinity.functions.geo import great_circle_km
from vicinity.operators.impute import median_fill
from vicinity.operators.order_stats import cumulative_by_value, known, kth_smallest, top_n, with_known


def cut_index(rows: int, share: float) -> int:
    """Zero-based place of the cut-off row; at least the first row."""
    return max(int(rows * share) - 1, 0)


def cutoffs(df: DataFrame, score: str, shares: list[float], index=cut_index) -> dict[float, float | None]:
    """Score at the cut-off row of each share of all rows, largest scores first, missing ones last.

    None where the row has no score: everything is at or above such a cut-off.
    """
    n, scored = df.agg(F.count(F.lit(1)), F.count(known(df, score))).first()
    ranks = {p: scored - index(n, p) for p in shares}
    found = kth_smallest(df, {score: list(ranks.values())})
    return {p: found.get((score, k)) for p, k in ranks.items()}


def at_or_above(df: DataFrame, score: str, cut: Column) -> Column:
    return F.coalesce(known(df, score) >= cut, cut.isNull())


def _per_share(df: DataFrame, cuts: dict[float, float], measures) -> DataFrame:
    """One output row per share from a single aggregate over the rows."""
    aggs, fields = [], []
    for i, (share, cut) in enumerate(cuts.items()):
        parts = measures(F.lit(cut).cast("double"))
        aggs += [e.alias(f"{n}_{i}") for n, e in parts.items()]
        fields.append(F.struct(
            F.lit(float(share)).alias("share"), F.lit(cut).cast("double").alias("cutoff"),
            *[F.col(f"{n}_{i}").alias(n) for n in parts]))
    return df.agg(*aggs).select(F.explode(F.array(*fields)).alias("r")).select("r.*")


def precision_at(df: DataFrame, label: str, score: str, shares: list[float], ignore_nulls: bool = False,
                 index=cut_index) -> DataFrame:
    """``(share, cutoff, precision)``: rows at or above the cut-off are predicted positive.

    With ``ignore_nulls`` unlabelled rows leave the fraction after the cut-off
    is set; otherwise an unlabelled row is an error.
    """
    y = F.col(label)
    if not ignore_nulls:
        clean = F.assert_true(y.isNotNull(), F.lit("unlabelled rows: use ignore_nulls")).isNull()
        y = F.when(clean, y)
    picked = lambda cut: at_or_above(df, score, cut) & y.isNotNull()
    counted = _per_share(df, cutoffs(df, score, shares, index), lambda cut: {
        "hits": F.count(F.when(picked(cut) & (y == 1), 1)), "picked": F.count(F.when(picked(cut), 1))})
    return counted.select("share", "cutoff", F.coalesce(
        F.try_divide(F.col("hits").cast("double"), F.col("picked")), F.lit(0.0)).alias("precision"))


def precision_at_share(df: DataFrame, label: str, score: str, shares: list[float]) -> DataFrame:
    """Variant whose cut-off row is ``min(int(n * share), n - 1)``, one further down."""
    return precision_at(df, label, score, shares, index=lambda n, p: min(int(n * p), n - 1))


def binarised_at(df: DataFrame, score: str, share: float, name: str = "predicted") -> DataFrame:
    cut = cutoffs(df, score, [share])[share]
    return df.withColumn(name, at_or_above(df, score, F.lit(cut).cast("double")).cast("int"))


def confusion_at(df: DataFrame, label: str, score: str, shares: list[float]) -> DataFrame:
    """True and false positives and negatives per share; unlabelled rows are in none."""
    y = F.col(label)
    above = lambda cut: at_or_above(df, score, cut)
    return _per_share(df, cutoffs(df, score, shares), lambda cut: {
        "tp": F.count(F.when(above(cut) & (y == 1), 1)), "fp": F.count(F.when(above(cut) & (y == 0), 1)),
        "tn": F.count(F.when(~above(cut) & (y == 0), 1)), "fn": F.count(F.when(~above(cut) & (y == 1), 1))})


def labels_at(df: DataFrame, label: str, score: str, key: str, share: float, normalize: bool = False) -> DataFrame:
    """Labelled rows among exactly the first ``cut_index + 1`` rows (ties by key)."""
    n, labelled = df.agg(F.count(F.lit(1)), F.count(label)).first()
    head = top_n(df.select(key, label, score), score, key, cut_index(n, share) + 1)
    count = F.count(label)
    return head.agg((F.try_divide(count.cast("double"), F.lit(labelled)) if normalize else count).alias("labels")) \
        .select(F.lit(float(share)).alias("share"), "labels")


def precision_curve(df: DataFrame, label: str, score: str, shares: list[float] | None = None) -> DataFrame:
    """Precision at many shares from one pass: ``(share, cutoff, precision)``."""
    shares = shares or [0.01 * i for i in range(1, 101)]
    df = with_known(df, score)
    positive = F.sum(F.when(F.col(label) == 1, 1).otherwise(0))
    n, scored, positives = df.agg(F.count(F.lit(1)), F.count(score), positive).first()
    steps = cumulative_by_value(df, score, {"n": F.count(F.lit(1)), "pos": positive}, descending=True)
    places = F.array(*[F.struct(F.lit(p).alias("share"), F.lit(cut_index(n, p) + 1).alias("place")) for p in shares])
    here = F.filter(places, lambda s: (s.place > F.col("cum_n") - F.col("n")) & (s.place <= F.col("cum_n")))
    curve = steps.select(F.explode(here).alias("s"), F.col(score).cast("double").alias("cutoff"), "cum_n", "cum_pos") \
        .select("s.share", "cutoff", (F.col("cum_pos") / F.col("cum_n")).alias("precision"))
    beyond = [(float(p), None, positives / n) for p in shares if n and cut_index(n, p) + 1 > scored]
    return curve.unionByName(df.sparkSession.createDataFrame(beyond, curve.schema)) if beyond else curve


# --- classification summaries ----------------------------------------------------

def confusion_counts(df: DataFrame, label: str, predicted: str, normalize: bool = False) -> DataFrame:
    """``(label, predicted, n)``, as a share of the label's rows when normalized."""
    counts = df.groupBy(F.col(label).alias("label"), F.col(predicted).alias("predicted")) \
        .agg(F.count(F.lit(1)).alias("n"))
    if not normalize:
        return counts
    rows = counts.groupBy("label").agg(F.sum("n").alias("_rows"))
    return counts.join(rows, "label").select("label", "predicted", (F.col("n") / F.col("_rows")).alias("n"))


def class_report(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support per class, computed from the confusion counts."""
    counts = confusion_counts(df, label, predicted)
    hits = counts.where(F.col("label") == F.col("predicted")).select(F.col("label").alias("class"), F.col("n").alias("hit"))
    actual = counts.groupBy(F.col("label").alias("class")).agg(F.sum("n").alias("support"))
    guessed = counts.groupBy(F.col("predicted").alias("class")).agg(F.sum("n").alias("guessed"))
    per = actual.join(guessed, "class", "full").join(hits, "class", "left") \
        .fillna(0, subset=["support", "guessed", "hit"])
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    precision = zero(F.try_divide(F.col("hit").cast("double"), F.col("guessed")))
    recall = zero(F.try_divide(F.col("hit").cast("double"), F.col("support")))
    return per.select("class", precision.alias("precision"), recall.alias("recall"),
                      zero(F.try_divide(2 * precision * recall, precision + recall)).alias("f1"), "support")


def accuracy(df: DataFrame, label: str, predicted: str) -> DataFrame:
    return df.agg(F.avg((F.col(label) == F.col(predicted)).cast("double")).alias("accuracy"))


def balance_classes(df: DataFrame, label: str, order: Column, key: str) -> DataFrame:
    """Equal number of 0 and 1 rows: the larger class keeps the first rows of a pseudo-random order.

    ``order`` is an integer hash of the row key (ties by ``key``). The cut is an
    exact order statistic, not a window over a whole class.
    """
    sizes = {r[0]: r[1] for r in df.where(F.col(label).isin(0, 1)).groupBy(label).count().collect()}
    if set(sizes) != {0, 1}:
        raise ValueError("both classes are needed to balance them")
    small, large = sorted(sizes, key=lambda k: (sizes[k], k))
    crowd = df.where(F.col(label) == large).withColumn("_h", F.bitwise_not(order.cast("long")))
    kept = top_n(crowd, "_h", key, sizes[small]).drop("_h")
    return df.where(F.col(label) == small).unionByName(kept)


# --- curves ----------------------------------------------------------------------

def _steps(df: DataFrame, label: str, score: str, groups: list[str] | None = None) -> DataFrame:
    y = F.col(label)
    return cumulative_by_value(df.where(y.isNotNull()), score, {
        "pos": F.sum(F.when(y == 1, 1).otherwise(0)), "neg": F.sum(F.when(y == 1, 0).otherwise(1))},
        groups=groups, descending=True)


def _with_totals(steps: DataFrame, groups: list[str]) -> DataFrame:
    totals = steps.groupBy(*groups).agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    if groups:
        return steps.join(totals, groups)
    row = totals.first()
    return steps.withColumns({"_p": F.lit(row["_p"]), "_n": F.lit(row["_n"])})


def roc_points(df: DataFrame, label: str, score: str, groups: list[str] | None = None) -> DataFrame:
    """One point per distinct score: ``(threshold, fpr, tpr)``; the start (0, 0) is implied."""
    groups = groups or []
    rows = _with_totals(_steps(df, label, score, groups), groups)
    return rows.select(*groups, F.col(score).alias("threshold"),
                       F.try_divide(F.col("cum_neg").cast("double"), F.col("_n")).alias("fpr"),
                       F.try_divide(F.col("cum_pos").cast("double"), F.col("_p")).alias("tpr"))


def roc_auc(df: DataFrame, label: str, score: str, groups: list[str] | None = None) -> DataFrame:
    """Trapezoid area; each step needs only its own and the running totals."""
    groups = groups or []
    steps = _steps(df, label, score, groups)
    slab = F.col("neg") * (F.col("cum_pos") - F.col("pos") / 2)
    return steps.groupBy(*groups).agg(
        F.try_divide(F.sum(slab), (F.sum("pos") * F.sum("neg")).cast("double")).alias("auc"))


def pr_points(df: DataFrame, label: str, score: str, groups: list[str] | None = None) -> DataFrame:
    """``(threshold, precision, recall)`` per distinct score up to full recall."""
    groups = groups or []
    rows = _with_totals(_steps(df, label, score, groups), groups)
    useful = F.col("cum_pos") - F.col("pos") < F.col("_p")
    return rows.where(useful).select(
        *groups, F.col(score).alias("threshold"),
        (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).alias("precision"),
        F.try_divide(F.col("cum_pos").cast("double"), F.col("_p")).alias("recall"))


def average_precision(df: DataFrame, label: str, score: str, groups: list[str] | None = None) -> DataFrame:
    """Area under the precision-recall points: trapezoid (with the start at precision 1) and step sum."""
    groups = groups or []
    rows = _with_totals(_steps(df, label, score, groups), groups)
    here = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    seen_p, seen_n = F.col("cum_pos") - F.col("pos"), F.col("cum_neg") - F.col("neg")
    before = F.coalesce(F.try_divide(seen_p.cast("double"), seen_p + seen_n), F.lit(1.0))
    width = F.try_divide(F.col("pos").cast("double"), F.col("_p"))
    return rows.groupBy(*groups).agg(
        F.sum(width * (here + before) / 2).alias("pr_auc"), F.sum(width * here).alias("average_precision"))


def per_class(df: DataFrame, label: str, scores: dict) -> DataFrame:
    """One-vs-rest rows ``(class, label, score)`` for every class plus ``micro`` over all of them."""
    cells = F.array(*[
        F.struct(F.lit(str(k)).alias("class"), (F.col(label) == F.lit(k)).cast("int").alias("label"),
                 F.col(c).cast("double").alias("score")) for k, c in scores.items()])
    long = df.where(F.col(label).isNotNull()).select(F.explode(cells).alias("c")).select("c.*")
    both = F.array(F.col("class"), F.lit("micro"))
    return long.select(F.explode(both).alias("class"), "label", "score")


def top_flags(df: DataFrame, label: str, score: str) -> DataFrame:
    """Flags for the top 1 and 10 percent and their true and false positives.

    The cut-off is one of all rows; rows without a score (null or NaN) are not at or above a score.
    """
    cuts = cutoffs(df, score, [0.01, 0.1])
    out = {}
    for name, share in (("top_1", 0.01), ("top_10", 0.1)):
        top = at_or_above(df, score, F.lit(cuts[share]).cast("double"))
        out[name] = top.cast("int")
        out[f"tp_{name}"] = (top & (F.col(label) == 1)).cast("int")
        out[f"fp_{name}"] = (top & (F.col(label) == 0)).cast("int")
    return df.withColumns(out)


def density_rsquare(df: DataFrame, density: str, rate: str, prediction: str = "prediction") -> DataFrame:
    """R2 of ``prediction`` on density, rate and their product (gaps filled by the median first)."""
    rows = df.select(density, rate, prediction).where(F.col(prediction).isNotNull())
    rows = median_fill(rows, [density, rate]).withColumn("_both", F.col(density) * F.col(rate))
    wide = VectorAssembler(inputCols=[density, rate, "_both"], outputCol="_x").transform(rows)
    model = LinearRegression(featuresCol="_x", labelCol=prediction, predictionCol="_fitted",
                             solver="normal").fit(wide)
    return df.sparkSession.createDataFrame([(float(model.summary.r2),)], "r2 double")


def mean_pair_distance(df: DataFrame, lat: str, lon: str, group: list[str] | None = None,
                       block_rows: int = 500) -> DataFrame:
    """Mean great-circle distance over all pairs of rows of a group that have both coordinates.

    Rows with a null or NaN coordinate are left out and not counted; a group with
    fewer than two rows left has no mean.
    Equal places are folded to one weighted place. Places are packed into blocks
    of about ``block_rows``; block pairs meet by an equi-join and each adds only
    its own sum, so no pair becomes a row.
    """
    named, group = bool(group), group or ["_all"]
    if not named:
        df = df.withColumn("_all", F.lit(0))
    df = df.withColumns({"_lat": known(df, lat), "_lon": known(df, lon)})
    held = df.where("_lat IS NOT NULL AND _lon IS NOT NULL")
    places = held.groupBy(*group, F.col("_lat").alias(lat), F.col("_lon").alias(lon)).agg(F.count(F.lit(1)).cast("double").alias("w"))
    # Each group has its own number of blocks, so that a small group is not repeated for the blocks of a large one.
    many = places.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("_blocks"))
    packed = places.join(many, group).withColumn("_b", F.pmod(F.xxhash64(lat, lon), F.col("_blocks")).cast("int")) \
        .groupBy(*group, "_blocks", "_b").agg(F.collect_list(F.struct(
            F.col(lat).alias("lat"), F.col(lon).alias("lon"), "w")).alias("ps"))
    left = packed.withColumn("_to", F.explode(F.sequence(F.col("_b"), F.col("_blocks") - 1)))
    right = packed.select(*group, F.col("_b").alias("_to"), F.col("ps").alias("qs"))
    summed = lambda a: F.aggregate(a, F.lit(0.0), lambda t, v: t + v)
    total = summed(F.transform("ps", lambda p: summed(F.transform("qs", lambda q: F.when(
        (p.lat == q.lat) & (p.lon == q.lon), F.lit(0.0)).otherwise(
        p.w * q.w * great_circle_km(p.lat, p.lon, q.lat, q.lon))))))
    # a block met with itself sees each pair twice
    part = F.when(F.col("_b") == F.col("_to"), total / 2).otherwise(total)
    sums = left.join(right, [*group, "_to"]).groupBy(*group).agg(F.sum(part).alias("_d"))
    sizes = df.groupBy(*group).agg(F.count(F.when(F.col("_lat").isNotNull() & F.col("_lon").isNotNull(), 1)).cast("double").alias("_k"))
    same = [F.col(f"_g{i}").eqNullSafe(F.col(g)) for i, g in enumerate(group)]
    sums = sums.toDF(*[f"_g{i}" for i in range(len(group))], "_d")
    return sizes.join(sums, same, "left").select(*(group if named else []), F.try_divide(
        F.when(F.col("_k") > 1, F.col("_d")), F.col("_k") * (F.col("_k") - 1) / 2).alias("mean_km"))
