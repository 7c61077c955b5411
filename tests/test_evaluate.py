import pytest
from pyspark.sql import functions as F

from vicinity.operators import evaluate as E

TEN = [1.0, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1]


def frame(spark, labels, scores=TEN):
    return spark.createDataFrame(list(zip(range(len(scores)), labels, scores)), "id long, y double, s double")


@pytest.mark.parametrize("share,cut", [(0.1, 1.0), (0.5, 0.6), (1.0, 0.1), (0.01, 1.0)])
def test_cutoffs(spark, share, cut):
    assert E.cutoffs(frame(spark, [None] * 10), "s", [share])[share] == cut


@pytest.mark.parametrize("share,picked", [(0.1, 1), (0.5, 5), (1.0, 10)])
def test_binarised(spark, share, picked):
    assert E.binarised_at(frame(spark, [1.0] * 10), "s", share).agg(F.sum("predicted")).first()[0] == picked


def test_precision(spark):
    df = frame(spark, [1.0] * 5 + [0.0] * 5)
    got = {r["share"]: (r["precision"], r["cutoff"]) for r in E.precision_at(df, "y", "s", [0.1, 1.0]).collect()}
    assert got == {0.1: (1.0, 1.0), 1.0: (0.5, 0.1)}


def test_precision_without_labels_in_reach(spark):
    df = frame(spark, [None, 1.0, None, 1.0, 1.0, None, None, 0.0, 0.0, 0.0])
    got = {r["share"]: r["precision"] for r in E.precision_at(df, "y", "s", [0.1, 1.0], ignore_nulls=True).collect()}
    assert got == {0.1: 0.0, 1.0: 0.5}
    with pytest.raises(Exception, match="unlabelled"):
        E.precision_at(df, "y", "s", [1.0]).collect()


def test_ties_are_all_picked(spark):
    df = frame(spark, [1.0, 0.0, 0.0, 1.0], [5.0, 5.0, 5.0, 1.0])
    assert E.precision_at(df, "y", "s", [0.25]).first()["precision"] == pytest.approx(1 / 3)


@pytest.mark.parametrize("labels,share,normalize,want", [
    ([None] * 10, 0.5, False, 0), ([1.0] + [None] * 9, 0.1, False, 1), ([1.0] + [None] * 9, 0.1, True, 1.0),
    ([1.0, None, 0.0, None] + [None] * 6, 0.3, False, 2), ([1.0, None, None, 0.0] + [None] * 6, 0.3, True, 0.5),
])
def test_labels_at(spark, labels, share, normalize, want):
    assert E.labels_at(frame(spark, labels), "y", "s", "id", share, normalize).first()["labels"] == want


def test_confusion(spark):
    df = frame(spark, [1.0, 0.0, None, 1.0, 0.0, 0.0, 1.0, None, 0.0, 0.0])
    r = E.confusion_at(df, "y", "s", [0.5]).first()
    assert (r["tp"], r["fp"], r["tn"], r["fn"]) == (2, 2, 3, 1)


def test_curve_agrees_with_single_points(spark):
    df = frame(spark, [1.0, 0.0, 1.0, 1.0, 0.0, 0.0, 1.0, 0.0, 0.0, 1.0], [9.0, 9.0, 7.0, 6.0, 6.0, 6.0, 3.0, 2.0, 2.0, 0.5])
    shares = [0.1, 0.3, 0.45, 0.8, 1.0]
    one = {r["share"]: r["precision"] for r in E.precision_at(df, "y", "s", shares).collect()}
    many = {r["share"]: r["precision"] for r in E.precision_curve(df, "y", "s", shares).collect()}
    assert many == pytest.approx(one)


def test_auc_of_perfect_and_constant_scores(spark):
    assert E.roc_auc(frame(spark, [1.0] * 5 + [0.0] * 5), "y", "s").first()[0] == 1.0
    assert E.roc_auc(frame(spark, [1.0, 0.0], [2.0, 2.0]), "y", "s").first()[0] == 0.5


def test_balance(spark):
    df = frame(spark, [1.0, 1.0, 1.0, 1.0, 1.0, 0.0, 0.0, 0.0, None, None]).withColumn("y", F.col("y").cast("int"))
    got = E.balance_classes(df, "y", F.col("id") * 7 % 5, "id").groupBy("y").count().collect()
    assert {r["y"]: r["count"] for r in got} == {0: 3, 1: 3}
    with pytest.raises(ValueError):
        E.balance_classes(df.where("y = 1"), "y", F.col("id"), "id")


def test_mean_distance_against_brute_force(spark):
    import itertools, math
    pts = [(39.1, -84.5), (39.2, -84.4), (39.1, -84.5), (38.9, -84.9), (39.3, -84.1)]

    def km(a, b):
        p, q = math.radians(90 - a[0]), math.radians(90 - b[0])
        c = math.sin(p) * math.sin(q) * math.cos(math.radians(a[1] - b[1])) + math.cos(p) * math.cos(q)
        return math.acos(max(-1.0, min(1.0, c))) * 6373.0
    want = sum(km(a, b) for a, b in itertools.combinations(pts, 2)) / 10
    df = spark.createDataFrame(pts, "lat double, lon double")
    for size in (1, 2, 500):
        assert E.mean_pair_distance(df, "lat", "lon", block_rows=size).first()[0] == pytest.approx(want, rel=1e-6)
