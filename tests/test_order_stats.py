import bisect
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vicinity.operators import order_stats as O


@pytest.fixture
def skewed(spark):
    """A third of all rows share one value."""
    rng = random.Random(3)
    values = [7.5 if i % 3 == 0 else rng.random() * 100 for i in range(3000)] + [None] * 20
    return values, spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, v double").repartition(4)


def test_quantiles_are_exact(skewed):
    values, df = skewed
    probs = [0.0, 0.01, 0.25, 0.333, 0.5, 0.9, 1.0]
    want = np.quantile([v for v in values if v is not None], probs)
    assert O.exact_quantiles(df, ["v"], probs)["v"] == pytest.approx(list(want))


def test_quantiles_of_empty_and_integer_columns(spark):
    df = spark.createDataFrame([(1, None), (2, None), (4, None)], "a int, b double")
    assert O.exact_quantiles(df, ["a", "b"], [0.25, 0.5]) == {"a": [1.5, 2.0], "b": [None, None]}


def test_ranks_share_ties(skewed):
    values, df = skewed
    got = {r["id"]: r["v_rank"] for r in O.with_ranks(df, ["v"]).collect()}
    kept = sorted(v for v in values if v is not None)
    first = {}
    for i, v in enumerate(kept, 1):
        first.setdefault(v, i)
    assert got == {i: len(kept) + 1 if v is None else first[v] for i, v in enumerate(values)}


def test_nan_is_missing_everywhere(spark):
    rng = random.Random(9)
    values = [float("nan") if i % 7 == 0 else None if i % 11 == 0 else float(rng.randint(0, 60)) for i in range(2000)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, v double").repartition(5)
    kept = sorted(v for v in values if v is not None and v == v)
    assert O.kth_smallest(df, {"v": [1, 900, len(kept), len(kept) + 1]}) == {
        ("v", 1): kept[0], ("v", 900): kept[899], ("v", len(kept)): kept[-1]}
    assert O.exact_quantiles(df, ["v"], [0.5])["v"] == pytest.approx([np.quantile(kept, 0.5)])
    order = sorted(range(2000), key=lambda i: (values[i] is None or values[i] != values[i], -(values[i] or 0), i))
    for n in (700, 1800):
        assert sorted(r["id"] for r in O.top_n(df, "v", "id", n).collect()) == sorted(order[:n])


@pytest.mark.parametrize("n", [1, 700, 1500, 2950, 3010, 5000, 0])
def test_top_n_cuts_inside_ties(skewed, n):
    values, df = skewed
    order = sorted(range(len(values)), key=lambda i: (values[i] is None, -(values[i] or 0), i))
    assert sorted(r["id"] for r in O.top_n(df, "v", "id", n).collect()) == sorted(order[:n])


def test_numbering_is_dense_and_ordered(skewed):
    _, df = skewed
    got = O.numbered(df, [F.col("v").desc(), F.col("id")], "rn", 5).orderBy("rn").collect()
    assert [r["rn"] for r in got] == list(range(5, 5 + len(got)))
    keys = [(-(r["v"]) if r["v"] is not None else float("inf"), r["id"]) for r in got]
    assert keys == sorted(keys)


def test_cumulative_in_groups(spark):
    df = spark.createDataFrame([("a", i % 5, 1) for i in range(50)] + [("b", i, 2) for i in range(30)], "g string, v int, w int")
    got = O.cumulative_by_value(df, "v", {"w": F.sum("w")}, ["g"], descending=True).collect()
    a = {r["v"]: r["cum_w"] for r in got if r["g"] == "a"}
    b = {r["v"]: r["cum_w"] for r in got if r["g"] == "b"}
    assert a == {4: 10, 3: 20, 2: 30, 1: 40, 0: 50}
    assert b == {v: 2 * (30 - v) for v in range(30)}


def test_bins(spark):
    df = spark.createDataFrame([(0,), (1,), (4,), (10,), (None,)], "v int")
    assert [r[0] for r in df.select(O.bin_index(F.col("v"), [1, 2, 5, 10])).collect()] == [0, 1, 2, 4, None]


def test_percentile_of_score(spark):
    df = spark.createDataFrame([(1,), (2,), (2,), (4,)], "v int")
    got = {r["v"]: r["v_percentile"] for r in O.percentile_of_score(df, "v").collect()}
    assert got == {1: 25.0, 2: 62.5, 4: 100.0}


@pytest.mark.parametrize("rows", [1 << 14, 5])
def test_places_by_narrowing(spark, monkeypatch, rows):
    """With small brackets every place is found by sketches and counts, also among hot and few values."""
    monkeypatch.setattr(O, "BRACKET_ROWS", rows)
    monkeypatch.setattr(O, "ACCURACY", 20)
    rng = random.Random(3)
    values = [rng.choice([1.5, 1.5, 2.0, float("nan"), None, rng.expovariate(1e-9), -rng.expovariate(1e6)]) for _ in range(700)]
    whole = [rng.randrange(-3, 3) * 10 ** rng.randrange(18) if rng.random() < 0.9 else None for _ in range(700)]
    df = spark.createDataFrame(list(zip(values, whole)), "v double, w long")
    kept = sorted(v for v in values if v is not None and v == v)
    kept_w = sorted(w for w in whole if w is not None)
    places = [1, 2, 100, 350, len(kept) - 1, len(kept)]
    got = O.kth_smallest(df, {"v": [*places, 0, len(kept) + 1], "w": [1, 300, len(kept_w)]})
    assert got == {**{("v", k): kept[k - 1] for k in places}, **{("w", k): kept_w[k - 1] for k in (1, 300, len(kept_w))}}


def test_places_of_text(spark):
    df = spark.createDataFrame([(c,) for c in "hbxabb"] + [(None,)], "v string")
    assert O.kth_smallest(df, {"v": [1, 4, 9]}) == {("v", 1): "a", ("v", 4): "b"}


def test_ranks_of_runs_over_partitions(spark):
    """A value with most rows lies in several partitions; every row of it has the same rank."""
    rng = random.Random(8)
    rows = [(i, rng.choice([5.0, 5.0, 5.0, 5.0, 1.0, 7.0, None, float("nan"), rng.random() * 10]), rng.randrange(3)) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, v double, w int").repartition(6)
    got = {r["id"]: (r["v_rank"], r["w_rank"]) for r in O.with_ranks(df, ["v", "w"]).collect()}
    key = lambda v: float("inf") if v is None or v != v else v
    vs, ws = sorted(key(v) for _, v, _ in rows), sorted(w for *_, w in rows)
    assert got == {i: (bisect.bisect_left(vs, key(v)) + 1, bisect.bisect_left(ws, w) + 1) for i, v, w in rows}


def test_ranks_bring_no_run_together(spark, rows):
    """One value fills several partitions and Arrow batches; runs are marked where they lie, without a window over them."""
    df = spark.range(4000).select("id", F.when(F.col("id") % 100 == 0, None).when(F.col("id") % 10 < 9, 5.0).otherwise(
        F.when(F.col("id") % 7 == 0, float("nan")).otherwise((F.col("id") % 13).cast("double"))).alias("a"), (F.col("id") % 2).alias("b"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        ranked = O.with_ranks(df, ["a", "b"])
        plan = ranked._jdf.queryExecution().optimizedPlan().toString()
        got = rows(ranked, "id", "a_rank", "b_rank")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "windowspecdefinition(_part" not in plan
    known = {r["id"]: (float("inf") if r["a"] is None or r["a"] != r["a"] else r["a"], r["b"]) for r in df.collect()}
    lower = [sorted(v[i] for v in known.values()) for i in (0, 1)]
    assert got == [(i, *[bisect.bisect_left(lower[k], known[i][k]) + 1 for k in (0, 1)]) for i in range(4000)]
