"""Queries on scored rows with missing labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from vicinity.operators import evaluate, impute, profile
from vicinity.queries.roles import LABELLED, SCORED, Tables, rounded

_SHARES = [0.01, 0.05, 0.1, 0.2, 0.5, 1.0]


def _cuts(source: str, index: str, shares=_SHARES) -> str:
    """Cut-off per share; ``index`` is the zero-based place for share ``p`` of ``n`` rows."""
    values = ", ".join(f"({p!r}::DOUBLE)" for p in shares)
    return f"""sh AS (SELECT * FROM (VALUES {values}) s(p)), cnt AS (SELECT count(*) AS n FROM {source}),
rk AS (SELECT score, row_number() OVER (ORDER BY score DESC) AS r FROM {source}),
cut AS (SELECT p, CAST(score AS DOUBLE) AS c FROM sh, cnt, rk WHERE r = {index} + 1)"""


_INDEX = "greatest(CAST(trunc(n * p) AS BIGINT) - 1, 0)"
_INDEX_B = "least(CAST(trunc(n * p) AS BIGINT), n - 1)"


def precision_at(spark, folder):
    return evaluate.precision_at(Tables(spark, folder).labelled, "label", "score", _SHARES)


def _precision_sql(base: str, source: str, index: str) -> str:
    return f"""
WITH {base}, {_cuts(source, index)}
SELECT p AS share, c AS cutoff, coalesce(count(CASE WHEN label = 1 THEN 1 END)::DOUBLE / nullif(count(label), 0), 0) AS precision
FROM cut JOIN {source} ON score >= c GROUP BY 1, 2"""


def precision_at_ignore_nas(spark, folder):
    return evaluate.precision_at(Tables(spark, folder).scored, "label", "score", _SHARES, ignore_nulls=True)


def precision_at_share(spark, folder):
    return evaluate.precision_at_share(Tables(spark, folder).labelled, "label", "score", _SHARES)


def confusion_at(spark, folder):
    return evaluate.confusion_at(Tables(spark, folder).scored, "label", "score", _SHARES)


CONFUSION_AT = f"""
WITH {SCORED}, {_cuts('scored', _INDEX)}
SELECT p AS share, c AS cutoff, count(CASE WHEN score >= c AND label = 1 THEN 1 END) AS tp,
  count(CASE WHEN score >= c AND label = 0 THEN 1 END) AS fp, count(CASE WHEN score < c AND label = 0 THEN 1 END) AS tn,
  count(CASE WHEN score < c AND label = 1 THEN 1 END) AS fn FROM cut, scored GROUP BY 1, 2"""


def binarised_at(spark, folder):
    rows = Tables(spark, folder).scored.select("doc_id", "score")
    return evaluate.binarised_at(rows, "score", 0.1)


BINARISED_AT = f"""
WITH {SCORED}, {_cuts('scored', _INDEX, [0.1])} SELECT doc_id, score, CASE WHEN score >= c THEN 1 ELSE 0 END AS predicted
FROM scored, cut"""


def labels_at(spark, folder):
    rows = Tables(spark, folder).scored
    parts = [evaluate.labels_at(rows, "label", "score", "doc_id", p).withColumn("labels", F.col("labels").cast("double"))
             .withColumn("kind", F.lit("count")) for p in (0.01, 0.1, 0.5)]
    parts.append(evaluate.labels_at(rows, "label", "score", "doc_id", 0.2, normalize=True).withColumn("kind", F.lit("share")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


LABELS_AT = f"""
WITH {SCORED}, cnt AS (SELECT count(*) AS n, count(label) AS known FROM scored),
rk AS (SELECT label, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM scored),
sh AS (SELECT * FROM (VALUES (0.01::DOUBLE, 'count'), (0.1, 'count'), (0.5, 'count'), (0.2, 'share')) s(p, kind))
SELECT p AS share, kind, count(label)::DOUBLE / CASE WHEN kind = 'share' THEN max(known) ELSE 1 END AS labels
FROM sh, cnt, rk WHERE r <= {_INDEX} + 1 GROUP BY 1, 2"""


def precision_curve(spark, folder):
    return evaluate.precision_curve(Tables(spark, folder).labelled, "label", "score")


PRECISION_CURVE = _precision_sql(LABELLED, "labelled", _INDEX).replace(
    _cuts("labelled", _INDEX), _cuts("labelled", _INDEX, [0.01 * i for i in range(1, 101)]))


def _predicted(t: Tables):
    return t.labelled.select("doc_id", "label", (F.col("score") >= 1000).cast("int").alias("predicted"))


_PRED = LABELLED + ", pred AS (SELECT label, CASE WHEN score >= 1000 THEN 1 ELSE 0 END AS predicted FROM labelled)"


def class_report(spark, folder):
    return evaluate.class_report(_predicted(Tables(spark, folder)), "label", "predicted")


CLASS_REPORT = f"""
WITH {_PRED}, k AS (SELECT * FROM (VALUES (0), (1)) v("class")),
c AS (SELECT "class", count(CASE WHEN label = "class" AND predicted = "class" THEN 1 END) AS hit,
  count(CASE WHEN label = "class" THEN 1 END) AS support, count(CASE WHEN predicted = "class" THEN 1 END) AS guessed
  FROM k, pred GROUP BY 1),
r AS (SELECT "class", coalesce(hit::DOUBLE / nullif(guessed, 0), 0) AS precision,
  coalesce(hit::DOUBLE / nullif(support, 0), 0) AS recall, support FROM c)
SELECT "class", precision, recall, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1, support FROM r"""


def confusion_matrix(spark, folder):
    return evaluate.confusion_counts(_predicted(Tables(spark, folder)), "label", "predicted", normalize=True)


CONFUSION_MATRIX = f"""
WITH {_PRED} SELECT label, predicted, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY label) AS n FROM pred GROUP BY 1, 2"""


def accuracy(spark, folder):
    return evaluate.accuracy(_predicted(Tables(spark, folder)), "label", "predicted")


ACCURACY = f"WITH {_PRED} SELECT avg(CASE WHEN label = predicted THEN 1 ELSE 0 END) AS accuracy FROM pred"

_STEPS = f"""{LABELLED}, st AS (SELECT score, count(CASE WHEN label = 1 THEN 1 END) AS pos,
  count(CASE WHEN label <> 1 THEN 1 END) AS neg FROM labelled GROUP BY 1),
cu AS (SELECT *, sum(pos) OVER (ORDER BY score DESC)::BIGINT AS cp, sum(neg) OVER (ORDER BY score DESC)::BIGINT AS cn,
  sum(pos) OVER ()::BIGINT AS p, sum(neg) OVER ()::BIGINT AS n FROM st)"""


def roc_points(spark, folder):
    return evaluate.roc_points(Tables(spark, folder).labelled, "label", "score")


ROC_POINTS = f"WITH {_STEPS} SELECT score AS threshold, cn::DOUBLE / n AS fpr, cp::DOUBLE / p AS tpr FROM cu"


def roc_auc(spark, folder):
    return rounded(evaluate.roc_auc(Tables(spark, folder).labelled, "label", "score"), ["auc"], 9)


ROC_AUC = f"WITH {_STEPS} SELECT round(sum(neg * (cp - pos / 2)) / (max(p) * max(n)), 9) AS auc FROM cu"


def pr_points(spark, folder):
    return evaluate.pr_points(Tables(spark, folder).labelled, "label", "score")


PR_POINTS = f"""
WITH {_STEPS} SELECT score AS threshold, cp / (cp + cn) AS precision, cp::DOUBLE / p AS recall FROM cu WHERE cp - pos < p"""


def average_precision(spark, folder):
    return rounded(evaluate.average_precision(Tables(spark, folder).labelled, "label", "score"),
                   ["pr_auc", "average_precision"], 9)


AVERAGE_PRECISION = f"""
WITH {_STEPS}, pts AS (SELECT pos / p AS w, cp / (cp + cn) AS here,
  CASE WHEN cp - pos + cn - neg = 0 THEN 1 ELSE (cp - pos) / (cp - pos + cn - neg) END AS before FROM cu)
SELECT round(sum(w * (here + before) / 2), 9) AS pr_auc, round(sum(w * here), 9) AS average_precision FROM pts"""


_CLASSES = 10   # all labels of the embeddings table


def _classes(t: Tables):
    rows = t.embeddings.select("label", *[
        F.element_at("embedding", i + 1).alias(f"s{i}") for i in range(_CLASSES)])
    return evaluate.per_class(rows, "label", {i: f"s{i}" for i in range(_CLASSES)})


def class_curves(spark, folder):
    """One-vs-rest and micro-averaged areas for a many-class score."""
    long = _classes(Tables(spark, folder))
    roc = evaluate.roc_auc(long, "label", "score", ["class"])
    pr = evaluate.average_precision(long, "label", "score", ["class"])
    return rounded(roc.join(pr, "class"), ["auc", "pr_auc", "average_precision"], 9)


CLASS_CURVES = f"""
WITH lo AS ({' UNION ALL '.join(
    f"SELECT '{i}' AS c, CASE WHEN label = {i} THEN 1 ELSE 0 END AS label, embedding[{i + 1}]::DOUBLE AS score FROM embeddings WHERE label IS NOT NULL"
    for i in range(_CLASSES))}),
al AS (SELECT * FROM lo UNION ALL SELECT 'micro', label, score FROM lo),
st AS (SELECT c, score, count(CASE WHEN label = 1 THEN 1 END) AS pos, count(CASE WHEN label = 0 THEN 1 END) AS neg FROM al GROUP BY 1, 2),
cu AS (SELECT *, sum(pos) OVER (PARTITION BY c ORDER BY score DESC)::BIGINT AS cp, sum(neg) OVER (PARTITION BY c ORDER BY score DESC)::BIGINT AS cn,
  sum(pos) OVER (PARTITION BY c)::BIGINT AS p, sum(neg) OVER (PARTITION BY c)::BIGINT AS n FROM st),
pts AS (SELECT *, pos / p AS w, cp / (cp + cn) AS here,
  CASE WHEN cp - pos + cn - neg = 0 THEN 1 ELSE (cp - pos) / (cp - pos + cn - neg) END AS before FROM cu)
SELECT c AS "class", round(sum(neg * (cp - pos / 2)) / (max(p) * max(n)), 9) AS auc,
  round(sum(w * (here + before) / 2), 9) AS pr_auc, round(sum(w * here), 9) AS average_precision FROM pts GROUP BY 1"""


def flags_top(spark, folder):
    rows = Tables(spark, folder).scored.select("doc_id", "label", "score")
    flagged = evaluate.top_flags(rows, "label", "score")
    return flagged.select("doc_id", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in flagged.columns if "top_" in c])


FLAGS_TOP = f"""
WITH {SCORED}, {_cuts('scored', _INDEX, [0.01, 0.1])}, w AS (SELECT (SELECT c FROM cut WHERE p < 0.05) AS c1, (SELECT c FROM cut WHERE p > 0.05) AS c10)
SELECT doc_id, {', '.join(f"(score >= {c})::INT AS {n}, coalesce((score >= {c} AND label = 1)::INT, 0) AS tp_{n}, coalesce((score >= {c} AND label = 0)::INT, 0) AS fp_{n}"
                          for c, n in (("c1", "top_1"), ("c10", "top_10")))} FROM scored, w"""


def balance_5050(spark, folder):
    rows = Tables(spark, folder).labelled.select("doc_id", "label")
    return evaluate.balance_classes(rows, "label", (F.col("doc_id") * 7919 + 13) % 1009, "doc_id")


BALANCE_5050 = f"""
WITH {LABELLED}, h AS (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY (doc_id * 7919 + 13) % 1009, doc_id) AS r FROM labelled)
SELECT doc_id, label FROM h WHERE r <= (SELECT min(n) FROM (SELECT count(*) AS n FROM labelled GROUP BY label))"""


def _density_rows(t: Tables):
    return t.part.select(
        F.when(F.col("p_partkey") % 7 != 0, F.col("p_size").cast("double")).alias("density"),
        (F.col("p_partkey") % 13).cast("double").alias("rate"),
        (F.col("p_retailprice") + F.col("p_size") * (F.col("p_partkey") % 13)).alias("prediction"))


def density_rsquare(spark, folder):
    return rounded(evaluate.density_rsquare(_density_rows(Tables(spark, folder)), "density", "rate"), ["r2"], 5)


# normal equations for three centred regressors, solved by Cramer's rule
DENSITY_RSQUARE = """
WITH r AS (SELECT CASE WHEN p_partkey % 7 <> 0 THEN CAST(p_size AS DOUBLE) END AS d, CAST(p_partkey % 13 AS DOUBLE) AS v,
  p_retailprice + p_size * (p_partkey % 13) AS y FROM part),
f AS (SELECT coalesce(d, (SELECT median(d) FROM r)) AS a, v AS b, y FROM r), g AS (SELECT a, b, a * b AS c, y FROM f),
s AS (SELECT var_pop(a) AS aa, var_pop(b) AS bb, var_pop(c) AS cc, covar_pop(a, b) AS ab, covar_pop(a, c) AS ac,
  covar_pop(b, c) AS bc, covar_pop(a, y) AS ay, covar_pop(b, y) AS by_, covar_pop(c, y) AS cy, var_pop(y) AS yy FROM g),
t AS (SELECT *, aa*(bb*cc-bc*bc) - ab*(ab*cc-bc*ac) + ac*(ab*bc-bb*ac) AS det FROM s)
SELECT round((ay * (ay*(bb*cc-bc*bc) - ab*(by_*cc-bc*cy) + ac*(by_*bc-bb*cy))
  + by_ * (aa*(by_*cc-bc*cy) - ay*(ab*cc-bc*ac) + ac*(ab*cy-by_*ac))
  + cy * (aa*(bb*cy-by_*bc) - ab*(ab*cy-by_*ac) + ay*(ab*bc-bb*ac))) / det / yy, 5) AS r2 FROM t"""


#: Prices with gaps: every 11th is null, every 13th NaN.
_GAPPED = """gapped AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS label,
  CASE WHEN o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0 THEN o_totalprice END AS score FROM orders)"""


def _gapped(t: Tables):
    key = F.col("order_id")
    score = F.when(key % 11 == 0, None).when(key % 13 == 0, F.lit(float("nan"))).otherwise(F.col("price"))
    return t.inspections.select(key.alias("id"), F.col("viol_outcome").alias("label"), score.alias("score"))


def flags_missing(spark, folder):
    flagged = evaluate.top_flags(_gapped(Tables(spark, folder)), "label", "score").drop("score", "label")
    return flagged.select("id", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in flagged.columns if c != "id"])


FLAGS_MISSING = f"""
WITH {_GAPPED}, n AS (SELECT count(*) AS n FROM gapped), r AS (SELECT score, row_number() OVER (ORDER BY score DESC NULLS LAST) - 1 AS i FROM gapped),
c AS (SELECT max(CASE WHEN i = greatest(n * 1 // 100 - 1, 0) THEN score END) AS c1, max(CASE WHEN i = greatest(n * 1 // 10 - 1, 0) THEN score END) AS c10 FROM r, n)
SELECT id, {', '.join(f"coalesce((score >= {c})::INT, 0) AS {n}, coalesce((score >= {c} AND label = 1)::INT, 0) AS tp_{n}, coalesce((score >= {c} AND label = 0)::INT, 0) AS fp_{n}"
                      for c, n in (("c1", "top_1"), ("c10", "top_10")))} FROM gapped, c"""


def medians_missing(spark, folder):
    return impute.median_fill(_gapped(Tables(spark, folder)), ["label", "score"])


MEDIANS_MISSING = f"""
WITH {_GAPPED} SELECT id, coalesce(label, (SELECT median(label) FROM gapped))::DOUBLE AS label,
  coalesce(score, (SELECT median(score) FROM gapped))::DOUBLE AS score FROM gapped"""


def profile_missing(spark, folder):
    out = profile.column_profile(_gapped(Tables(spark, folder)), ["score", "label"], [])
    return rounded(rounded(out.drop("top", "freq"), ["mean", "std", "missing"], 3), ["q25", "q50", "q75"], 5)


PROFILE_MISSING = f"""
WITH {_GAPPED} {' UNION ALL '.join(f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg(({c} IS NULL)::INT), 3) AS missing,
  count(DISTINCT {c}) AS "distinct", round(avg({c}), 3) AS mean, round(stddev_samp({c}), 3) AS std, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max,
  round(quantile_cont({c}, 0.25)::DOUBLE, 5) AS q25, round(quantile_cont({c}, 0.5)::DOUBLE, 5) AS q50, round(quantile_cont({c}, 0.75)::DOUBLE, 5) AS q75 FROM gapped""" for c in ("score", "label"))}"""


def distance_missing(spark, folder):
    """Customers of each segment, some without a latitude or with a longitude that is not a number."""
    key = F.col("c_custkey")
    rows = Tables(spark, folder).customer.select(
        "c_mktsegment", F.when(key % 11 != 0, F.col("c_nationkey") * 3.0 - 30).alias("lat"),
        F.when(key % 13 == 0, F.lit(float("nan"))).otherwise(F.col("c_nationkey") * 7.0 % 50 - 25).alias("lon"))
    return rounded(evaluate.mean_pair_distance(rows, "lat", "lon", ["c_mktsegment"]), ["mean_km"], 5)


def pairwise_distance(spark, folder):
    """Mean distance between the customers of each segment, placed by their nation."""
    t = Tables(spark, folder)
    rows = t.customer.select("c_mktsegment", (F.col("c_nationkey") * 3.0 - 30).alias("lat"),
                             (F.col("c_nationkey") * 7.0 % 50 - 25).alias("lon"))
    return rounded(evaluate.mean_pair_distance(rows, "lat", "lon", ["c_mktsegment"]), ["mean_km"], 5)


_HAVERSINE = ("pow(sin(radians(b.lat - a.lat) / 2), 2) "
              "+ cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)")
PAIRWISE_DISTANCE = f"""
WITH c AS (SELECT c_mktsegment, c_nationkey * 3.0::DOUBLE - 30 AS lat, (c_nationkey * 7.0::DOUBLE) % 50 - 25 AS lon, count(*) AS w
  FROM customer GROUP BY ALL),
d AS (SELECT a.c_mktsegment, sum(a.w * b.w * 2 * 6373.0 * asin(sqrt(least({_HAVERSINE}, 1.0)))) AS t FROM c a JOIN c b
  ON a.c_mktsegment = b.c_mktsegment AND (a.lat, a.lon) < (b.lat, b.lon) GROUP BY 1)
SELECT c_mktsegment, round(t / (n * (n - 1) / 2), 5) AS mean_km FROM d
JOIN (SELECT c_mktsegment, count(*)::DOUBLE AS n FROM customer GROUP BY 1) USING (c_mktsegment)"""


DISTANCE_MISSING = PAIRWISE_DISTANCE.replace("FROM customer GROUP", "FROM customer WHERE c_custkey % 11 <> 0 AND c_custkey % 13 <> 0 GROUP")


QUERIES = {
    "flags_missing": (flags_missing, FLAGS_MISSING),
    "medians_missing": (medians_missing, MEDIANS_MISSING),
    "profile_missing": (profile_missing, PROFILE_MISSING),
    "distance_missing": (distance_missing, DISTANCE_MISSING),
    "precision_at": (precision_at, _precision_sql(LABELLED, "labelled", _INDEX)),
    "precision_at_ignore_nas": (precision_at_ignore_nas, _precision_sql(SCORED, "scored", _INDEX)),
    "precision_at_share": (precision_at_share, _precision_sql(LABELLED, "labelled", _INDEX_B)),
    "confusion_at": (confusion_at, CONFUSION_AT),
    "binarised_at": (binarised_at, BINARISED_AT),
    "labels_at": (labels_at, LABELS_AT),
    "precision_curve": (precision_curve, PRECISION_CURVE),
    "class_report": (class_report, CLASS_REPORT),
    "confusion_matrix": (confusion_matrix, CONFUSION_MATRIX),
    "accuracy": (accuracy, ACCURACY),
    "roc_points": (roc_points, ROC_POINTS),
    "roc_auc": (roc_auc, ROC_AUC),
    "pr_points": (pr_points, PR_POINTS),
    "average_precision": (average_precision, AVERAGE_PRECISION),
    "class_curves": (class_curves, CLASS_CURVES),
    "flags_top": (flags_top, FLAGS_TOP),
    "balance_5050": (balance_5050, BALANCE_5050),
    "density_rsquare": (density_rsquare, DENSITY_RSQUARE),
    "pairwise_distance": (pairwise_distance, PAIRWISE_DISTANCE),
}
