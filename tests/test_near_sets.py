import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from vicinity.operators import spatial
from vicinity.streaming import incremental

FAR = (20 * 3.281) ** 2


def near(left, right):
    return Counter((a, b) for a, x, y in left for b, u, v in right
                   if None not in (x, y, u, v) and (x - u) * (x - u) + (y - v) * (y - v) <= FAR)


def frame(spark, rows, name, kind):
    return spark.createDataFrame(rows, f"{name} long, x {kind}, y {kind}")


@pytest.mark.parametrize("kind", ["long", "int", "double"])
@pytest.mark.parametrize("split", [20_000, 7])
def test_each_near_pair_lies_in_one_row(spark, kind, split):
    """Repeated places, rows and ids, missing ids and places, places at the very limit, negative ones and neighbouring numbers."""
    rng = random.Random(3)
    number = (lambda n: rng.uniform(-n, n)) if kind == "double" else (lambda n: rng.randrange(-n, n))
    left = [(i, number(200), number(200)) for i in range(250)] + [(i, 5, 5) for i in (1, 1, 2, None, 3)] + [(9, None, 1), (9, 1, None)]
    right = [(i, number(200), number(200)) for i in range(60)] + [(i, 5, 5) for i in (1, 1, None)] + [(8, 5, None)]
    if kind == "double":
        left += [(400, math.nan, 1.0), (401, 1.0, math.nextafter(1.0, 2.0)), (402, 1.0, 1.0)]
        right += [(400, math.nan, math.nan), (401, 1.0 - 20 * 3.281, 1.0), (402, 1.0, 1.0 - 20 * 3.281), (403, math.inf, 1.0)]
        left, right = ([(i, *(None if c is None else float(c) for c in at)) for i, *at in rows] for rows in (left, right))
    sets = spatial.near_sets(frame(spark, left, "a", kind), frame(spark, right, "b", kind), ["a"], ["b"], 20, split)
    rows = spatial.set_pairs(sets).collect()
    want = near(left, right)
    assert Counter((r["a"], r["b"]) for r in rows) == want and len(want) > 300
    assert sorted(r["dist_m"] for r in rows) == sorted(
        math.sqrt((x - u) * (x - u) + (y - v) * (y - v)) / 3.281 for _, x, y in left for _, u, v in right if near([(0, x, y)], [(0, u, v)]))


@pytest.mark.parametrize("repeats", [1, 5])
def test_edges_of_a_stream_are_stored_in_fewer_numbers_than_there_are_edges(spark, tmp_path, repeats):
    """Also where no two points share a place."""
    rng = random.Random(6)
    spots = lambda n: [(rng.uniform(0, 150), rng.uniform(0, 150)) for _ in range(n // repeats)] * repeats
    parcels, events = ([(i, *at) for i, at in enumerate(spots(n))] for n in (1200, 900))
    path = {n: str(tmp_path / n) for n in ("in", "edges", "mark")}
    for part in (events[:500], events[500:]):
        new = frame(spark, part, "event_id", "double").coalesce(1)
        new.write.mode("append").parquet(path["in"])
        incremental.extend_edges(incremental.stream_files(spark, path["in"], new.schema), frame(spark, parcels, "parcel_id", "double"),
                                 "parcel_id", "event_id", 20, path["edges"], path["mark"], as_sets=True).awaitTermination()
    edges = incremental.read_edges(spark, path["edges"])
    got = Counter((r["parcel_id"], r["event_id"]) for r in edges.collect())
    assert got == near(parcels, events) and edges.columns == ["parcel_id", "event_id", "dist_m"]
    held = spark.read.parquet(path["edges"]).agg(F.sum(F.size("_left") + F.size("_right"))).first()[0]
    assert held < len(got) / 4


def test_a_crowded_place_is_cut_into_rows_of_few_pairs(spark):
    """Spark keeps all pairs of a row in memory while it makes rows of them."""
    spot = spark.range(0, 3000, 1, 1).selectExpr("id AS a", "5L AS x", "5L AS y")
    sets = spatial.near_sets(spot, spot.where("a < 1500").withColumnRenamed("a", "b"), ["a"], ["b"], 20)
    total, most = sets.agg(F.sum(F.size("_left") * F.size("_right")), F.max(F.size("_left") * F.size("_right"))).first()
    assert total == 3000 * 1500 and most <= 512 * 512
    assert spatial.set_pairs(sets).distinct().count() == total
