"""Pairs of visits and events leave blocks as sets; what is shuffled are packs of rows."""

import random
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest
from dateutil.relativedelta import relativedelta

from vicinity.operators import asof as A
from vicinity.operators import packs, spatial, window_sets


def test_packs_give_back_what_they_hold():
    pack, unpack = packs.codec()
    columns = [np.array(c) for c in ([3, 3, 3], [0, 1, 255], [-5, 70000, 2], [1 << 62, -(1 << 62), 0], [1.0, 2.0, -9.0],
                                     [0.1, float("nan"), -0.0], [1e300, 2.0, float("inf")], [-7, -7, -7], [-7.0, -7.0, -7.0])]
    out = unpack(pack([*columns, pa.array(["a", None, "c"])])(np.arange(3)))
    assert all(np.array_equal(np.asarray(v, c.dtype), c, equal_nan=c.dtype.kind == "f") for c, v in zip(columns, out))
    assert out[-1].to_pylist() == ["a", None, "c"]
    assert unpack(pack([*columns, pa.array(["a", None, "c"])])(np.array([2, 0])))[1].tolist() == [255, 0]


def near_points(spark, rng, parcels=30, places=20):
    spot = lambda: (rng.randrange(-900, 900), rng.randrange(-900, 900))
    left = [(p, *spot()) for p in range(parcels)] + [(1, 5, 5), (2, None, 3), (None, 1, 1)]
    right = [(a, *spot()) for a in range(places)] + [(3, 5, 5), (None, 0, 0)]
    near = spatial.NearPoints(spark.createDataFrame(left, "p long, x long, y long"), spark.createDataFrame(right, "a long, x long, y long"), 50)
    return near, left, right


@pytest.mark.parametrize("limits", [{}, {"FEW": 1}, {"FEW": 4, "SET_POINTS": 2, "BATCH": 10}, {"PAIRS_PER_NUMBER": 1e9}])
@pytest.mark.parametrize("crowded", [200_000, 3])
def test_pairs_in_windows_against_brute_force(spark, monkeypatch, rows, limits, crowded):
    """Also in split blocks, with repeated keys, null places, keys and moments, and text ids."""
    for name, value in limits.items():
        monkeypatch.setattr(window_sets, name, value)
    monkeypatch.setattr(A, "BLOCK_ROWS", crowded)
    monkeypatch.setattr(packs, "PACK_ROWS", 64 if limits else packs.PACK_ROWS)
    rng = random.Random(7)
    near, left, right = near_points(spark, rng)
    at = lambda: datetime(2016, 1, 1) + timedelta(days=rng.randrange(90), hours=rng.choice([0, 0, 7]))
    visits = [(rng.randrange(32), at()) for _ in range(120)] + [(1, None), (None, datetime(2016, 2, 1)), (4, datetime(2016, 3, 31))]
    events = [(rng.randrange(22), at(), rng.choice([None, f"e{i}"])) for i in range(400)] + [(1, None, "n"), (None, datetime(2016, 2, 1), "n")]
    v = spark.createDataFrame(visits, "p long, d timestamp_ntz")
    e = spark.createDataFrame(events, "a long, t timestamp_ntz, id string")
    got = rows(A.events_in_window(v, near, e, "p", "a", "id", "t", "d", 1, 50), "p", "d", "id")
    limit = (50 * 3.281) ** 2
    want = [(p, d, i) for p, d in {x for x in visits if None not in x} for q, x, y in left if q == p and x is not None
            for a, u, w in right if a is not None and (x - u) ** 2 + (y - w) ** 2 <= limit
            for b, t, i in events if b == a and t and d - relativedelta(months=1) <= t < d]
    assert got == sorted(want, key=lambda r: tuple((c is not None, c) for c in r)) and len(want) > 50


def test_neither_visits_nor_pairs_are_shuffled_by_cell_and_month(spark):
    near, _, _ = near_points(spark, random.Random(1))
    v = spark.createDataFrame([(1, datetime(2016, 3, 1))], "p long, d timestamp_ntz")
    e = spark.createDataFrame([(1, datetime(2016, 2, 5), 1)], "a long, t timestamp_ntz, id long")
    plan = A.events_in_window(v, near, e, "p", "a", "id", "t", "d", 1, 50)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 3 and "_month" not in plan and "_pack" in plan


def test_crowded_visits_and_events_meet_as_sets():
    """Many visits near many events in one window: the numbers that leave a block are a small part of the pairs."""
    pack, _ = packs.codec()
    rng, day = np.random.default_rng(3), 86_400_000_000
    d = rng.integers(40, 60, 600) * day
    visits = [np.arange(600), d, d - 30 * day, rng.integers(0, 500, 600), rng.integers(0, 500, 600)]
    events = [np.arange(3000), rng.integers(30, 60, 3000) * day, rng.integers(0, 500, 3000), rng.integers(0, 500, 3000)]
    stamp, whole = pa.timestamp("us"), pa.int64()
    kinds = [pa.list_(pa.struct([(n, t) for n, t in zip("pdfxy", [whole, stamp, stamp, whole, whole])])),
             pa.list_(pa.struct([(n, t) for n, t in zip("itxy", [whole, stamp, whole, whole])]))]
    schema = pa.schema([("_left", kinds[0]), ("_right", kinds[1])])
    batch = pa.RecordBatch.from_arrays([*[pa.array([0, 0])] * 6, pa.array([1, 0]), pa.array([pack(events)(np.arange(3000)), pack(visits)(np.arange(600))])],
                                       names=[*packs.ORDER, "_pack"])
    reach = 400.0
    numbers, pairs = 0, set()
    for out in window_sets.kernel(reach, reach * reach, schema)(iter([batch])):
        for left, right in zip(out.column(0).to_pylist(), out.column(1).to_pylist()):
            numbers += len(left) + len(right)
            pairs |= {(v["p"], e["i"]) for v in left for e in right
                      if v["f"] <= e["t"] < v["d"] and (v["x"] - e["x"]) ** 2 + (v["y"] - e["y"]) ** 2 <= reach * reach}
    hit = (events[1] >= visits[2][:, None]) & (events[1] < d[:, None]) \
        & ((visits[3][:, None] - events[2]) ** 2 + (visits[4][:, None] - events[3]) ** 2 <= reach * reach)
    assert pairs == set(zip(*map(lambda r: r.tolist(), np.nonzero(hit)))) and numbers * 5 < len(pairs)
