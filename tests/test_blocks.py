"""Totals of events near visits, block against block, without rows for pairs."""

import random
import tracemalloc
from datetime import datetime, timedelta

import pyarrow as pa
import pytest
from dateutil.relativedelta import relativedelta
from pyspark.sql import functions as F

from vicinity.operators import asof as A
from vicinity.operators import blocks, spatial
from vicinity.operators.asof import Measure
from vicinity.plans import features

FAR = (50 * 3.281) ** 2


def place(rng):
    return rng.randrange(-900, 900), rng.randrange(-900, 900)


def moment(rng, hours):
    return datetime(2015, 11, 1) + timedelta(days=rng.randrange(200), hours=rng.choice(hours))


@pytest.mark.parametrize("numbers", [blocks.BLOCK_NUMBERS, 100])
@pytest.mark.parametrize("hours", [[0], [0, 6, 7, 23]])
@pytest.mark.parametrize("months", [1, 14])
def test_near_points_against_brute_force(spark, monkeypatch, hours, months, numbers):
    """All kinds of measures; also in split blocks, with repeated keys and null places, keys and moments."""
    monkeypatch.setattr(blocks, "BLOCK_NUMBERS", numbers)
    monkeypatch.setattr(spatial, "point_edges", lambda *a: pytest.fail("pairs became rows"))
    rng = random.Random(months)
    parcels = [(p, *place(rng)) for p in range(12)] + [(1, 0, 0), (2, None, 5), (None, 0, 0)]
    spots = [(a, *place(rng)) for a in range(40)] + [(3, 5, 5), (4, None, None), (None, 1, 1)]
    visits = [(rng.randrange(13), moment(rng, hours)) for _ in range(80)] + [(1, datetime(2016, 3, 31)), (1, None), (None, datetime(2016, 1, 1))]
    events = [(rng.randrange(42), moment(rng, [0, 6, 9]), rng.choice([None, -3, 4, 1 << 52]), rng.choice([None, 0.1, -2.7, 1e10, float("nan")]))
              for _ in range(900)] + [(0, None, 1, 1.0), (None, datetime(2016, 1, 1), 1, 1.0)]
    m = [Measure("n", F.lit(1)), Measure("s", F.col("v")), Measure("f", F.col("w"), "fsum"), Measure("lo", F.col("v"), "min"),
         Measure("hi", F.col("v"), "max"), Measure("top", F.col("w"), "max"), Measure("low", F.col("w"), "min")]
    v = spark.createDataFrame(visits, "id long, d timestamp_ntz")
    e = spark.createDataFrame(events, "a long, t timestamp_ntz, v long, w double")
    near = spatial.NearPoints(spark.createDataFrame(parcels, "id long, x long, y long"), spark.createDataFrame(spots, "a long, x long, y long"), 50)
    got = {(r["id"], r["d"]): tuple(r)[2:] for r in A.nearby_totals(v, near, e, "id", "a", "t", "d", m, months).collect()}
    want = {}
    for p, d in {x for x in visits if None not in x}:
        hits = [(n, w) for q, x, y in parcels if q == p and x is not None for a, u, z in spots if a is not None and u is not None
                and (x - u) ** 2 + (y - z) ** 2 <= FAR for b, t, n, w in events if b == a and t and d - relativedelta(months=months) <= t < d]
        if hits:
            ns, ws = [n for n, _ in hits if n is not None], [w for _, w in hits if w is not None]
            real = [w for w in ws if w == w]
            want[p, d] = (len(hits), sum(ns), sum(real) if real else None, min(ns, default=None), max(ns, default=None),
                          (max(real) if len(real) == len(ws) else "nan") if ws else None, min(real, default="nan" if ws else None))
    plain = lambda r: tuple("nan" if x is not None and x != x else pytest.approx(x, abs=1e-5) if i == 2 and x is not None else x for i, x in enumerate(r))
    assert got.keys() == want.keys() and len(want) > 20
    assert all(plain(got[k]) == want[k] for k in want)


def test_features_from_points_and_from_stored_edges_agree(spark):
    rng = random.Random(3)
    parcels = spark.createDataFrame([(p, *place(rng)) for p in range(8)], "parcel_id long, x long, y long")
    spots = spark.createDataFrame([(a, *place(rng)) for a in range(60)], "address_id long, x long, y long")
    visits = spark.createDataFrame([(rng.randrange(8), moment(rng, [0])) for _ in range(40)], "parcel_id long, inspection_date timestamp_ntz")
    fire = spark.createDataFrame([(rng.randrange(60), t := moment(rng, [0, 9]), t, t + timedelta(minutes=rng.randrange(90)), rng.choice("ab"))
                                  for _ in range(500)], "address_id long, incident_date timestamp_ntz, alarm_date_time timestamp_ntz, "
                                 "unit_clear_date_time timestamp_ntz, incident_type_desc string")
    near = spatial.NearPoints(parcels, spots, 100)
    build = lambda edges: sorted(tuple(r) for r in features.fire(features.Context(
        population=visits, tables={"fire": fire}, edges=edges, metres=100)).collect())
    stored = build(near.edges(["parcel_id"], ["address_id"]))
    assert stored and build(near) == stored


def test_totals_beyond_the_exact_range_of_floats(spark):
    """Sums over 2^53 stay exact, and over 2^63 are an error."""
    t = datetime(2016, 1, 5)
    spots = spark.createDataFrame([(a, a, 0) for a in range(5)], "a long, x long, y long")
    near = spatial.NearPoints(spark.createDataFrame([(1, 0, 0)], "id long, x long, y long"), spots, 50)
    v = spark.createDataFrame([(1, t + timedelta(days=3))], "id long, d timestamp_ntz")
    ask = lambda values: A.nearby_totals(v, near, spark.createDataFrame(
        [(a, t, n) for a, n in enumerate(values)], "a long, t timestamp_ntz, v long"), "id", "a", "t", "d",
        [Measure("n", F.lit(1)), Measure("s", F.col("v"))], 1).first()["s"]
    assert ask([(1 << 60) + 1, (1 << 59) + 3, -(1 << 58) - 5, 7]) == (1 << 60) + (1 << 59) - (1 << 58) + 6
    with pytest.raises(Exception, match="64 bits"):
        ask([1 << 62, 1 << 62, 1 << 62])


def test_neighbourhood_counts_no_pairs(spark, monkeypatch):
    """Visits and events meet in blocks, so their number of join rows does not grow with the pairs."""
    monkeypatch.setattr(A, "split_hot_keys", lambda *a: pytest.fail("visits and events meet row by row"))
    v = spark.createDataFrame([(i, datetime(2016, 1, 5), 5 * i, 0) for i in range(9)], "id long, d timestamp_ntz, x long, y long")
    e = spark.createDataFrame([(10, 5, datetime(2016, 1, 3), datetime(2016, 1, 4)), (10, 5, datetime(2016, 1, 4), None)],
                              "x long, y long, t timestamp_ntz, u timestamp_ntz")
    got = A.totals_around(v, e, "id", "d", "t", [Measure("n", F.lit(1)), Measure("last", F.lit(1), until=F.col("u"))], 1, 20)
    assert sorted(tuple(r)[2:] for r in got.collect()) == [(2, 1)] * 9


def test_polygon_edges_measure_a_place_once(spark, monkeypatch):
    """Fifty points of one place are one distance; what lies outside the grown box is not measured."""
    asked = []
    monkeypatch.setattr(spatial, "with_distance_to", lambda df, real=spatial.with_distance_to: asked.append(df) or real(df))
    square = spark.createDataFrame([("s", [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)])], "name string, ring array<struct<x:double,y:double>>")
    points = [(i, 12, 5) for i in range(50)] + [(50, 5, 5), (51, 40, 40), (52, None, 5), (50, 5, 5)]
    got = spatial.polygon_point_edges(square, spark.createDataFrame(points, "id long, x long, y long"), "name", "id", 2, 100)
    got = sorted((r["id"], round(r["dist_m"], 6)) for r in got.collect())
    assert got == [(i, round(2 / 3.281, 6)) for i in range(50)] + [(50, 0.0)] * 2
    assert asked[0].count() == 2


def test_cells_are_spread_over_all_partitions(spark):
    """Few bytes may be much work: the meeting of cells is not put into one task."""
    df = spark.range(0, 400, 1, 1).selectExpr("id", "id % 20 * 100 AS x", "id * 7 % 20 * 100 AS y")
    met = spatial.point_edges(df, df.selectExpr("id AS other", "x", "y"), ["id"], ["other"], 20)
    assert met.select(F.spark_partition_id().alias("p")).distinct().count() > 1


def walked(visits, events, months, lasts=()):
    """Totals of a block, asked of its function alone: ``{(id, moment): (n, v, ...)}``."""
    stamp = lambda rows, i: pa.array([r[i] for r in rows], pa.timestamp("us"))
    real = lambda rows, i: pa.array([float(r[i]) for r in rows])
    asked = pa.table({"id": pa.array([r[0] for r in visits]), "_x": real(visits, 1), "_y": real(visits, 2), "_d": stamp(visits, 3),
                      "_from": pa.array([r[3] - relativedelta(months=months) for r in visits], pa.timestamp("us"))})
    held = pa.table({"_x": real(events, 0), "_y": real(events, 1), "_t": stamp(events, 2), "n": pa.array([1] * len(events)),
                     "v": pa.array([r[3] for r in events]), **{k: pa.array([1] * len(events)) for k in lasts},
                     **{f"_until_{k}": stamp(events, 4) for k in lasts}})
    names = ["n", "v", *lasts]
    schema = pa.schema([("id", pa.int64()), ("_d", pa.timestamp("us")), *[(k, pa.int64()) for k in names]])
    out = blocks._kernel("id", ["n", "v"], list(lasts), [], FAR, schema)(asked, held)
    return {(r["id"], r["_d"]): tuple(r[k] for k in names) for r in out.to_pylist()}


@pytest.mark.parametrize("moments", ["shared", "own"])
def test_visits_of_one_moment_and_visits_in_parts_of_days(moments):
    """Many visits a day: moments that many share, and moments of their own; also at the clamped ends of months."""
    rng = random.Random(5)
    day = lambda n: datetime(2016, 2, 25) + timedelta(days=n)
    late = lambda: timedelta(seconds=rng.randrange(86_400)) if moments == "own" else timedelta(hours=rng.choice([0, 9, 17]))
    visits = [(i, *place(rng), day(rng.choice([0, 33, 34, 35, 36, 37, 90])) + late()) for i in range(3500)]
    events = [(*place(rng), day(rng.randrange(-40, 95)) + late(), rng.randrange(-5, 1 << 40), None) for _ in range(700)]
    events = [(*e[:4], rng.choice([None, e[2] + timedelta(days=rng.randrange(9)), e[2] + late()])) for e in events]
    got = walked(visits, events, 1, ["last"])
    want = {}
    for i, x, y, d in visits:
        hits = [e for e in events if (x - e[0]) ** 2 + (y - e[1]) ** 2 <= FAR and d - relativedelta(months=1) <= e[2] < d]
        if hits:
            want[i, d] = len(hits), sum(e[3] for e in hits), sum(e[4] is None or d <= e[4] for e in hits)
    assert got == want and len(want) > 1000


@pytest.mark.parametrize("hours", [1, 24])
def test_crowded_days_need_no_table_of_visits_and_events(hours):
    """What a block holds at a time does not grow with the events of a day."""
    start, rng = datetime(2016, 3, 1), random.Random(7)
    visits = [(i, i % 40, i // 40, start + timedelta(days=31, hours=i % hours)) for i in range(1600)]
    events = [(rng.randrange(40), rng.randrange(40), start + timedelta(hours=i % 24), 1, start + timedelta(days=40)) for i in range(30_000)]
    tracemalloc.start()
    got = walked(visits, events, 1, ["last"])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got[0, start + timedelta(days=31)] == (30_000,) * 3 and len(got) == 1600
    assert peak < 60_000_000
