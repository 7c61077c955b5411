"""Polygons that meet: pairs carry both rings and are measured where they meet."""

import math
import random

import pytest
from pyspark.sql import functions as F

from vicinity.operators import ring_pairs, spatial

SCHEMA = "array<struct<x:double,y:double>>"


def polygons(spark, name, rings):
    rows = [(i, [tuple(map(float, p)) for p in ring] if ring else ring) for i, ring in rings]
    return spark.createDataFrame(rows, f"{name} long, ring {SCHEMA}")


def star(rng, corners, size):
    x, y = rng.randrange(400), rng.randrange(400)
    turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(corners))
    ring = [(x + rng.uniform(0.4, 1) * size * math.cos(t), y + rng.uniform(0.4, 1) * size * math.sin(t)) for t in turns]
    return ring[::-1] if rng.random() < 0.5 else ring


def tables(spark):
    rng = random.Random(5)
    left = [(i, star(rng, rng.choice([3, 4, 9]), rng.choice([5, 30, 90]))) for i in range(30)]
    right = [(i, star(rng, rng.choice([3, 5, 12]), rng.choice([10, 60]))) for i in range(30)]
    odd = [(None, left[0][1]), (40, []), (41, None), (42, [(100, 100)]), (43, [(0, 0), (400, 400)])]
    return polygons(spark, "a", left + odd), polygons(spark, "b", right + odd)


def measured(spark, rows, how):
    a, b = tables(spark)
    if how == "overlaps":
        return rows(spatial.polygon_overlaps(a, b, ["a"], ["b"], 50).withColumn("overlap_area", F.round("overlap_area", 6)))
    return rows(spatial.polygon_polygon_edges(a, b, "a", "b", 6, 50).withColumn("dist_m", F.round("dist_m", 6)))


@pytest.mark.parametrize("how", ["overlaps", "edges"])
def test_pairs_are_measured_as_by_their_edges(spark, monkeypatch, rows, how):
    """Rings in pairs, long rings by their edges, and some of each give the same rows."""
    by_edges = "_overlaps_by_strips" if how == "overlaps" else "_edges_apart"
    found = {}
    for corners in (32, 4, 0):
        monkeypatch.setattr(ring_pairs, "SMALL_RING", corners)
        with monkeypatch.context() as m:
            if corners == 32:
                m.setattr(spatial, by_edges, lambda *a: pytest.fail("edges became rows"))
            found[corners] = measured(spark, rows, how)
    assert len(found[0]) > 20
    assert found[32] == found[4] == found[0]


def test_repeated_ids(spark, rows):
    """Polygons of one id are one polygon of several rings for the distance, as before."""
    a = polygons(spark, "a", [(1, [(0, 0), (9, 0), (9, 9)]), (1, [(50, 0), (59, 0), (59, 9)]), (2, [(0, 50), (9, 50), (9, 59)])])
    b = polygons(spark, "b", [(7, [(60, 0), (69, 0), (69, 9)]), (7, [(0, 61), (9, 61), (9, 70)])])
    got = rows(spatial.polygon_polygon_edges(a, b, "a", "b", 1, 50).withColumn("dist_m", F.round(F.col("dist_m") * 3.281, 6)))
    assert got == [(1, 7, 1.0), (2, 7, 2.0)]


def test_exact_areas_of_squares(spark, rows):
    square = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]
    a = polygons(spark, "a", [(i, square(10 * i, 0, 10)) for i in range(4)])
    b = polygons(spark, "b", [(0, square(5, 5, 10)), (1, square(0, 10, 40)), (2, square(31, 1, 2))])
    got = rows(spatial.polygon_overlaps(a, b, ["a"], ["b"], 7))
    assert got == [(0, 0, 100.0, 100.0, 25.0), (1, 0, 100.0, 100.0, 25.0), (3, 2, 100.0, 4.0, 4.0)]


def test_points_meet_few_edges_without_interpretation(spark, rows, monkeypatch):
    """Edges of small rings are written out; the rows are those of the filter over the array."""
    a, _ = tables(spark)
    pts = spark.range(900).selectExpr("id", "(id % 30) * 14.5 AS x", "(id DIV 30) * 14.5 AS y")
    found = {}
    for most in (12, 0):
        monkeypatch.setattr(spatial.geo, "FEW_EDGES", most)
        met = spatial.points_in_polygons(pts, a, ["a"], 50)
        plan = met._jdf.queryExecution().optimizedPlan().toString()
        assert ("filter(_edges" in plan) == (most == 0)
        found[most] = rows(met.select("id", "a"))
    assert found[12] == found[0] and len(found[0]) > 50


def test_distances_are_taken_of_polygons_apart_only(monkeypatch):
    """Of a batch of pairs, those that cross or hold each other are found first and not measured against each edge."""
    import numpy

    kept = []
    monkeypatch.setattr(ring_pairs, "_measured", lambda pairs, measure, *a: kept.append(measure))
    ring_pairs.squared_distances(None, "a", "b", [], "d")

    class Counting:
        rows = 0

        def __getattr__(self, name):
            return getattr(numpy, name)

        def clip(self, values, *ends):
            Counting.rows += len(values)
            return numpy.clip(values, *ends)

    square = lambda x, size: [(x, 0.0), (x + size, 0.0), (x + size, size), (x, size)]
    a = numpy.array([square(0.0, 10.0)] * 4)
    b = numpy.array([square(5.0, 20.0), square(2.0, 3.0), square(-5.0, 40.0), square(13.0, 10.0)])
    assert kept[0](Counting(), a, b).tolist() == [0.0, 0.0, 0.0, 9.0]
    assert Counting.rows == 2  # one pair, from both sides
    assert kept[0](Counting(), a[:2], b[:2]).tolist() == [0.0, 0.0]
