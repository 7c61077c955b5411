import random
from datetime import datetime, timedelta

import pytest
from dateutil.relativedelta import relativedelta
from pyspark.sql import functions as F

from vicinity.operators import asof as A
from vicinity.operators import area, spatial
from vicinity.operators.asof import Measure
from vicinity.plans import features

START = datetime(2015, 1, 1)


def day(rng, n=500):
    return START + timedelta(days=rng.randrange(n))


def near_events_brute(visits, edges, events, months):
    out = {}
    for p, d in set(visits):
        hits = [v for (q, a) in edges if q == p for (b, t, v) in events if a == b and d - relativedelta(months=months) <= t < d]
        if hits:
            out[(p, d)] = (len(hits), sum(hits), min(hits), max(hits))
    return out


@pytest.mark.parametrize("side", ["place", "entity"])
@pytest.mark.parametrize("hours", [0, 24])
@pytest.mark.parametrize("months", [1, 13])
def test_nearby_totals_against_brute_force(spark, months, hours, side):
    rng = random.Random(months)
    moment = lambda: day(rng) + timedelta(hours=rng.randrange(hours) if hours else 0)
    visits = [(rng.randrange(6), moment()) for _ in range(60)] + [(1, datetime(2016, 3, 31)), (1, datetime(2016, 2, 29))]
    edges = [(p, a) for p in range(6) for a in range(8) if rng.random() < 0.4]
    # one place holds a third of all events
    events = [(0 if rng.random() < 0.33 else rng.randrange(8), day(rng) + timedelta(hours=rng.randrange(24)), rng.randrange(9))
              for _ in range(400)]
    events += [(a, datetime(2016, 2, 29), 1) for a in range(8)]
    got = A.nearby_totals(
        spark.createDataFrame(visits, "parcel_id long, d timestamp_ntz"),
        spark.createDataFrame([(p, a, 1.0) for p, a in edges], "parcel_id long, a long, dist_m double"),
        spark.createDataFrame(events, "a long, t timestamp_ntz, v int"), "parcel_id", "a", "t", "d",
        [Measure("n", F.lit(1)), Measure("s", F.col("v")), Measure("lo", F.col("v"), "min"), Measure("hi", F.col("v"), "max")],
        months, side=side)
    got = {(r["parcel_id"], r["d"]): (r["n"], r["s"], r["lo"], r["hi"]) for r in got.collect()}
    assert got == near_events_brute(visits, edges, events, months)


def test_pairs_agree_with_totals(spark):
    rng = random.Random(5)
    visits = spark.createDataFrame([(rng.randrange(4), day(rng)) for _ in range(30)], "parcel_id long, d timestamp_ntz")
    edges = spark.createDataFrame([(p, a, float(a)) for p in range(4) for a in range(5)], "parcel_id long, a long, dist_m double")
    events = spark.createDataFrame([(i, rng.randrange(5), day(rng)) for i in range(200)], "id long, a long, t timestamp_ntz")
    pairs = A.events_in_window(visits, edges, events, "parcel_id", "a", "id", "t", "d", 2, 3.0)
    totals = A.nearby_totals(visits, edges, events, "parcel_id", "a", "t", "d", [Measure("n", F.lit(1))], 2, 3.0)
    want = {(r["parcel_id"], r["d"]): r["count"] for r in pairs.groupBy("parcel_id", "d").count().collect()}
    assert {(r["parcel_id"], r["d"]): r["n"] for r in totals.collect()} == want


@pytest.mark.parametrize("metres, max_dist", [(50, 50), (50, 20), (20, 50)])
def test_pairs_of_points_are_those_of_edges(spark, monkeypatch, rows, metres, max_dist):
    """Points give the rows of the edge table without making it, also with repeated and null keys, places and dates."""
    rng = random.Random(7)
    spot = lambda: (rng.randrange(-300, 300), rng.randrange(-300, 300))
    visits = spark.createDataFrame([(rng.randrange(9), day(rng)) for _ in range(60)] + [(None, day(rng)), (1, None)], "parcel_id long, d timestamp_ntz")
    parcels = spark.createDataFrame([(p, *spot()) for p in range(8)] + [(1, 0, 0), (2, None, 1), (None, 0, 0)], "parcel_id long, x long, y long")
    places = spark.createDataFrame([(a, *spot()) for a in range(12)] + [(3, 5, 5), (4, None, None), (None, 1, 1)], "a long, x long, y long")
    events = spark.createDataFrame([(i % 380, rng.randrange(13), day(rng)) for i in range(400)] + [(1, None, day(rng)), (2, 3, None), (None, 3, day(rng))],
                                   "id long, a long, t timestamp_ntz")
    near = spatial.NearPoints(parcels, places, metres)
    args = (events, "parcel_id", "a", "id", "t", "d", 2, max_dist)
    want = rows(A.events_in_window(visits, near.edges(["parcel_id"], ["a"]), *args))
    monkeypatch.setattr(spatial, "point_edges", lambda *a: pytest.fail("pairs of places became rows"))
    got = rows(A.events_in_window(visits, near, *args))
    assert len(got) > 100 and got == want


def test_event_edges_agree_with_place_edges(spark):
    rng = random.Random(9)
    visits = spark.createDataFrame([(rng.randrange(4), day(rng)) for _ in range(30)], "parcel_id long, d timestamp_ntz")
    events = spark.createDataFrame([(i, day(rng)) for i in range(80)], "id long, t timestamp_ntz")
    edges = spark.createDataFrame([(p, i, 0.0) for p in range(4) for i in range(80) if rng.random() < 0.5],
                                  "parcel_id long, id long, dist_m double")
    m = [Measure("n", F.lit(1))]
    one = A.nearby_totals(visits, edges, events, "parcel_id", "id", "t", "d", m, 3)
    two = A.nearby_event_totals(visits, edges, events, "parcel_id", "id", "t", "d", m, 3)
    key = lambda df: {(r["parcel_id"], r["d"]): r["n"] for r in df.collect()}
    assert key(one) == key(two)


@pytest.mark.parametrize("split", [50_000, 3])
def test_point_edges_with_hot_cell(spark, split):
    rng = random.Random(1)
    # a third of the points share one cell, some the very same place
    pts = [(i, 10 if i % 6 == 0 else rng.randrange(40) if i % 3 == 0 else rng.randrange(4000), rng.randrange(40 if i % 3 == 0 else 4000))
           for i in range(300)]
    df = spark.createDataFrame(pts, "id long, x long, y long")
    other = df.select(F.col("id").alias("other"), "x", "y")
    got = {(r["id"], r["other"]) for r in spatial.point_edges(df, other, ["id"], ["other"], 50, split).collect()}
    far = (50 * 3.281) ** 2
    want = {(a, b) for a, x, y in pts for b, u, v in pts if (x - u) ** 2 + (y - v) ** 2 <= far}
    assert got == want
    counts = {r["id"]: r["parcels"] for r in spatial.neighbour_counts(df, df, "id", "id", 50, rows_per_split=split).collect()}
    assert counts == {a: max(sum(1 for p, q in want if p == a) - 1, 1) for a, _, _ in pts}


def test_neighbourhood_unique_counts(spark):
    rng = random.Random(2)
    spots = {p: (rng.randrange(300), rng.randrange(300)) for p in range(12)}
    spots[11] = (100000, 100000)
    insp = [(rng.randrange(12), day(rng, 300), rng.choice([0, 1, None])) for _ in range(150)]
    insp += [(3, datetime(2015, 2, 28), 1), (3, datetime(2015, 3, 31), 0), (4, datetime(2015, 3, 31), 1)]
    parcels = spark.createDataFrame([(p, x, y) for p, (x, y) in spots.items()], "parcel_id long, x long, y long")
    table = spark.createDataFrame(insp, "parcel_id long, inspection_date timestamp_ntz, viol_outcome int")
    got = features.neighborhood_score(table.select("parcel_id", "inspection_date"), table, parcels, 50, 1, ranks=False)
    got = {(r["parcel_id"], r["inspection_date"]): tuple(r)[2:] for r in got.collect()}
    far = (50 * 3.281) ** 2
    close = lambda a, b: (spots[a][0] - spots[b][0]) ** 2 + (spots[a][1] - spots[b][1]) ** 2 <= far
    want = {}
    for p, d in {(p, d) for p, d, _ in insp}:
        m = [(q, y) for q, t, y in insp if close(p, q) and d - relativedelta(months=1) <= t < d]
        if m:
            u = set(m)
            want[(p, d)] = (sum(y == 1 for _, y in m), sum(y == 0 for _, y in m), len(m), sum(y == 1 for _, y in u),
                            sum(y == 0 for _, y in u), len({q for q, _ in m}), sum(close(p, q) for q in spots))
    assert got == want


def test_neighbourhood_at_moments(spark):
    """Times of day count on both sides, also where month ends clamp onto one day."""
    rng = random.Random(4)
    spots = {p: (rng.randrange(300), rng.randrange(300)) for p in range(8)}
    at = lambda: day(rng, 120).replace(hour=rng.choice([0, 0, 8, 18]), minute=rng.choice([0, 30]))
    insp = [(rng.randrange(8), at(), rng.choice([0, 1, None])) for _ in range(160)]
    insp += [(p, datetime(2015, 2, 28, h), p % 2) for p in range(4) for h in (0, 6, 12, 23)]
    asks = [(p, datetime(2015, 3, d, h)) for p in range(4) for d in (28, 29, 30, 31) for h in (0, 6, 7, 13)] + [(1, datetime(2015, 4, 1))]
    asks += [(2, datetime(2015, 1, 20, 8)), (2, datetime(2015, 1, 20, 18)), (None, datetime(2015, 1, 1)), (3, None)]
    insp += [(2, datetime(2015, 1, 20, 12), 1), (1, None, 1)]
    parcels = spark.createDataFrame([(p, x, y) for p, (x, y) in spots.items()], "parcel_id long, x long, y long")
    table = spark.createDataFrame(insp, "parcel_id long, inspection_date timestamp_ntz, viol_outcome int")
    people = spark.createDataFrame(asks, "parcel_id long, inspection_date timestamp_ntz")
    got = features.neighborhood_score(people, table, parcels, 50, 1, ranks=False)
    got = {(r["parcel_id"], r["inspection_date"]): tuple(r)[2:] for r in got.collect()}
    far = (50 * 3.281) ** 2
    close = lambda a, b: (spots[a][0] - spots[b][0]) ** 2 + (spots[a][1] - spots[b][1]) ** 2 <= far
    want = {}
    for p, d in {(p, d) for p, d in asks if p is not None and d is not None}:
        m = [(q, y) for q, t, y in insp if t is not None and close(p, q) and d - relativedelta(months=1) <= t < d]
        if m:
            u = set(m)
            want[(p, d)] = (sum(y == 1 for _, y in m), sum(y == 0 for _, y in m), len(m), sum(y == 1 for _, y in u),
                            sum(y == 0 for _, y in u), len({q for q, _ in m}), sum(close(p, q) for q in spots))
    assert got == want
    assert got[2, datetime(2015, 1, 20, 8)] != got[2, datetime(2015, 1, 20, 18)]


def test_totals_around_with_crowded_cells(spark, monkeypatch):
    """Splitting crowded (cell, slice) keys changes nothing."""
    rng = random.Random(6)
    visits = [(i % 7, day(rng, 200), 10 * (i % 7), 5) for i in range(60)]
    events = [(10 * rng.randrange(9), 5, day(rng, 200)) for _ in range(200)] + [(None, 5, day(rng, 200)), (10, 5, None)]
    v = spark.createDataFrame(visits, "id long, d timestamp_ntz, x long, y long")
    e = spark.createDataFrame(events, "x long, y long, t timestamp_ntz")
    ask = lambda: {(r["id"], r["d"]): r["n"] for r in A.totals_around(
        v, e, "id", "d", "t", [Measure("n", F.lit(1))], 2, 6).collect()}
    plain = ask()
    monkeypatch.setattr(A, "split_hot_keys", lambda *a: spatial.split_hot_keys(*a, rows_per_split=3))
    split = ask()
    want = {}
    for i, d, x, _ in set(visits):
        n = sum(1 for u, _, t in events if u is not None and t is not None and abs(u - x) <= 6 * 3.281 and d - relativedelta(months=2) <= t < d)
        if n:
            want[i, d] = n
    assert plain == split == want


def test_lookback_at_moments(spark):
    visits = spark.createDataFrame([(1, datetime(2015, 5, 1, 8)), (2, datetime(2015, 5, 1, 18)), (3, None)], "parcel_id long, d timestamp_ntz")
    series = spark.createDataFrame([(datetime(2015, 5, 1, 12), 4.0), (datetime(2015, 4, 20), 2.0), (datetime(2015, 4, 24, 9), 6.0),
                                    (datetime(2015, 4, 24, 7), 100.0), (datetime(2015, 4, 30), float("nan"))], "t timestamp_ntz, v double")
    got = {r["parcel_id"]: r["m"] for r in A.lookback_average(visits, series, "d", "t", {"m": "v"}, weeks=1).collect()}
    assert got == {1: 6.0, 2: 4.0, 3: None}


def test_date_bounds(spark):
    insp = spark.createDataFrame([(datetime(2015, 1, 10),), (datetime(2015, 12, 31),)], "d timestamp_ntz")
    events = spark.createDataFrame([(datetime(2015, 1, 1),), (datetime(2015, 10, 5, 7),)], "t timestamp_ntz")
    assert A.date_bounds(insp, events, "d", "t", 2) == ("2015-03-01", "2015-10-05")
    wide = spark.createDataFrame([(datetime(2014, 1, 1),), (datetime(2016, 1, 1),)], "t timestamp_ntz")
    assert A.date_bounds(insp, wide, "d", "t", 2) == ("2015-01-10", "2015-12-31")


def rates(spark, days=365, tracts=("a",)):
    events = spark.createDataFrame(
        [("a", datetime(2006, 3, 5))] * 6 + [("a", datetime(2006, 7, 2))] * 4 + [("b", datetime(2005, 1, 9))] * 3
        + [(None, datetime(2006, 1, 1))], "tract string, t timestamp_ntz")
    people = spark.createDataFrame([("a", 10), ("b", 3), ("d", 5)], "tract string, population long")
    visits = spark.createDataFrame(
        [("p1", datetime(2006, 12, 10), "a"), ("p2", datetime(2006, 6, 15), "a"), ("p3", datetime(2006, 12, 10), "c"),
         ("p4", datetime(2006, 12, 10), "d"), ("p5", datetime(2010, 1, 1), "b"), ("p6", datetime(2003, 5, 1), "a"),
         ("p7", datetime(2006, 12, 10), None)],
        "parcel_id string, inspection_date timestamp_ntz, tract string")
    got = area.area_rate_months(visits, events, people, "tract", "t", "inspection_date", days, 2004, 132)
    return {r["parcel_id"]: (r["events"], r["rate"]) for r in got.collect()}


def test_area_rates_by_month(spark):
    got = rates(spark)
    assert got["p1"] == (10, 1.0)
    assert got["p2"] == (6, 0.6)
    assert got["p3"] == (0, None)          # area without population
    assert got["p4"] == (0, 0.0)           # no events
    assert got["p5"] == (0, 0.0)           # all events before the window
    assert got["p6"] == (0, 0.0)           # before the first month
    assert got["p7"] == (0, None)          # missing area


def test_area_rates_half_year(spark):
    assert rates(spark, 180)["p1"] == (4, 0.4)


def test_lookback_keeps_dates_without_series(spark):
    visits = spark.createDataFrame([(1, datetime(2015, 5, 1)), (2, datetime(2015, 5, 1)), (3, datetime(2014, 1, 1))],
                                   "parcel_id long, d timestamp_ntz")
    series = spark.createDataFrame(
        [(datetime(2015, 4, 30, 23), 4.0), (datetime(2015, 3, 20), 2.0), (datetime(2015, 3, 19, 23), 99.0),
         (datetime(2015, 5, 1), 50.0), (datetime(2015, 4, 1), None)], "t timestamp_ntz, v double")
    got = {r["parcel_id"]: r["m"] for r in A.lookback_average(visits, series, "d", "t", {"m": "v"}).collect()}
    assert got == {1: 3.0, 2: 3.0, 3: None}
