"""Totals with many columns: events are handed to the visits, and totals leave their block whole."""

import random
from datetime import datetime

import pytest
from dateutil.relativedelta import relativedelta
from pyspark.sql import functions as F

from test_blocks import FAR, moment, place
from vicinity.operators import asof as A
from vicinity.operators import blocks, packs, spatial
from vicinity.operators.asof import Measure

def many():
    return [Measure(f"k{i}", (F.col("v") % 40 == i).cast("int")) for i in range(40)]


def tables(spark, rng, hours, again):
    parcels = [(p, *place(rng)) for p in range(12)] + ([(1, 0, 0)] if again else []) + [(12, None, 5), (None, 0, 0)]
    spots = [(a, *place(rng)) for a in range(40)] + [(3, 5, 5), (41, None, None), (None, 1, 1)]
    visits = [(rng.randrange(13), moment(rng, hours)) for _ in range(80)] + [(1, datetime(2016, 3, 31)), (1, None), (None, datetime(2016, 1, 1))]
    events = [(rng.randrange(42), moment(rng, [0, 6, 9]), rng.choice([None, -3, 4, 17, 1 << 52]), rng.choice([None, 0.1, -2.7, 1e10, 5.0, float("nan")]))
              for _ in range(900)] + [(0, None, 1, 1.0), (None, datetime(2016, 1, 1), 1, 1.0)]
    near = spatial.NearPoints(spark.createDataFrame(parcels, "id long, x long, y long"), spark.createDataFrame(spots, "a long, x long, y long"), 50)
    v = spark.createDataFrame(visits, "id long, d timestamp_ntz")
    e = spark.createDataFrame(events, "a long, t timestamp_ntz, v long, w double")
    return near, v, e, parcels, spots, visits, events


@pytest.mark.parametrize("numbers, rows", [(100_000_000, 1 << 18), (200, 100)])
@pytest.mark.parametrize("hours", [[0], [0, 6, 7, 23]])
@pytest.mark.parametrize("months, again", [(1, False), (5, True)])
def test_wide_totals_against_brute_force(spark, monkeypatch, hours, months, again, numbers, rows):
    """Also in split blocks and small packs, with repeated keys and null places, keys and moments."""
    monkeypatch.setattr(blocks, "STEP_NUMBERS", numbers)
    monkeypatch.setattr(blocks, "BLOCK_NUMBERS", blocks.BLOCK_NUMBERS if rows > 100 else 500)
    monkeypatch.setattr(packs, "PACK_ROWS", rows)
    rng = random.Random(months)
    near, v, e, parcels, spots, visits, events = tables(spark, rng, hours, again)
    m = [Measure("n", F.lit(1)), Measure("s", F.col("v")), Measure("f", F.col("w"), "fsum"), *many()]
    got = {(r["id"], r["d"]): tuple(r)[2:] for r in A.nearby_totals(v, near, e, "id", "a", "t", "d", m, months).collect()}
    want = {}
    for p, d in {x for x in visits if None not in x}:
        hits = [(n, w) for q, x, y in parcels if q == p and x is not None for a, u, z in spots if a is not None and u is not None
                and (x - u) ** 2 + (y - z) ** 2 <= FAR for b, t, n, w in events if b == a and t and d - relativedelta(months=months) <= t < d]
        if hits:
            ns, ws = [n for n, _ in hits if n is not None], [w for _, w in hits if w is not None and w == w]
            want[p, d] = (len(hits), sum(ns), pytest.approx(sum(ws), abs=1e-5) if ws else None,
                          *[sum(n >= 0 and n % 40 == i for n in ns) for i in range(40)])
    assert got.keys() == want.keys() and len(want) > 20
    assert all(got[k] == want[k] for k in want)


def test_wide_rows_are_not_shuffled(spark):
    """Neither events with all their measures as columns nor totals: exchanges carry packs and keys."""
    near, v, e, *_ = tables(spark, random.Random(1), [0], False)
    plan = A.nearby_totals(v, near, e, "id", "a", "t", "d", [Measure("n", F.lit(1)), *many()], 3)._jdf.queryExecution().executedPlan()
    wide = [line for line in plan.toString().splitlines() if "Aggregate" in line and "k39" in line]
    assert not wide and "_pack" in plan.toString()
