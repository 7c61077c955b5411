"""Queries on distance and time windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from vicinity.operators import asof, spatial
from vicinity.operators.asof import Measure
from vicinity.operators.pivot import clean_name
from vicinity.plans import features
from vicinity.plans.features import Context
from vicinity.queries.roles import (ADDRESSES, INSPECTIONS, PARCELS, VISITS, Tables, bounds, edges, longs, near,
                                    rounded)

METRES, MONTHS = 400, 3


def _edges(t: Tables, metres: float = METRES):
    return spatial.point_edges(t.parcels, t.addresses, ["parcel_id"], ["address_id"], metres)


def _near(t: Tables, metres: float = METRES):
    return spatial.NearPoints(t.parcels, t.addresses, metres)


def near_event_counts(spark, folder):
    t = Tables(spark, folder)
    events = t.lineitem.select(F.col("l_suppkey").alias("address_id"), F.col("l_shipdate").alias("at"))
    return asof.nearby_totals(t.inspections, _near(t), events, "parcel_id", "address_id", "at", "inspection_date",
                              [Measure("total", F.lit(1))], MONTHS)


NEAR_EVENT_COUNTS = f"""
WITH {PARCELS}, {ADDRESSES}, {INSPECTIONS}, {VISITS}, {edges(METRES)}
SELECT v.parcel_id, v.inspection_date, count(*) AS total
FROM visits v JOIN edges USING (parcel_id) JOIN lineitem ON l_suppkey = address_id
 AND l_shipdate >= v.inspection_date - INTERVAL {MONTHS} MONTH AND l_shipdate < v.inspection_date
GROUP BY 1, 2"""


def proximity_edges(spark, folder):
    return rounded(_edges(Tables(spark, folder)), ["dist_m"])


PROXIMITY_EDGES = f"""
WITH {PARCELS}, {ADDRESSES}, {edges(METRES)} SELECT parcel_id, address_id, round(dist_m, 6) AS dist_m FROM edges"""


def neighbor_counts(spark, folder):
    t = Tables(spark, folder)
    return spatial.neighbour_counts(t.parcels, t.parcels, "parcel_id", "parcel_id", METRES)


NEIGHBOR_COUNTS = f"""
WITH {PARCELS}
SELECT p.parcel_id, count(*) AS parcels
FROM parcels p LEFT JOIN parcels q ON p.parcel_id <> q.parcel_id AND {near('p', 'q', METRES)}
GROUP BY 1"""


def nearby_event_pairs(spark, folder):
    t = Tables(spark, folder)
    events = t.lineitem.select(
        F.col("l_suppkey").alias("address_id"), F.col("l_shipdate").alias("at"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))
    pairs = asof.events_in_window(t.inspections, _near(t), events, "parcel_id", "address_id", "id", "at",
                                  "inspection_date", 1, METRES)
    return rounded(pairs, ["dist_m"])


NEARBY_EVENT_PAIRS = f"""
WITH {PARCELS}, {ADDRESSES}, {INSPECTIONS}, {VISITS}, {edges(METRES)}
SELECT v.parcel_id, v.inspection_date, round(dist_m, 6) AS dist_m, l_orderkey*10 + l_linenumber AS id
FROM visits v JOIN edges USING (parcel_id) JOIN lineitem ON l_suppkey = address_id
 AND l_shipdate >= v.inspection_date - INTERVAL 1 MONTH AND l_shipdate < v.inspection_date"""


def cents(column: str):
    """Whole hundredths: sums are exact in any order, so both engines agree to the last bit."""
    return F.round(F.col(column) * 100).cast("long")


def _context(t: Tables, **tables) -> Context:
    return Context(population=t.inspections, tables=tables, edges=_near(t), months=MONTHS, metres=METRES)


def fire_features(spark, folder):
    t = Tables(spark, folder)
    fire = t.lineitem.select(
        F.col("l_suppkey").alias("address_id"), F.col("l_shipdate").alias("incident_date"),
        F.col("l_shipdate").alias("alarm_date_time"), F.col("l_returnflag").alias("incident_type_desc"),
        (F.col("l_shipdate") + F.make_interval(secs=F.col("l_quantity") * 73)).alias("unit_clear_date_time"))
    out = features.fire(_context(t, fire=fire))
    return longs(rounded(out, ["stddev_clear_time_minutes"]),
                 ["max_clear_time_minutes", "min_clear_time_minutes"])


FIRE_FEATURES = f"""
WITH {PARCELS}, {ADDRESSES}, {INSPECTIONS}, {VISITS}, {edges(METRES)}, {bounds('lineitem', 'l_shipdate', MONTHS)},
j AS (SELECT v.parcel_id, v.inspection_date, l_returnflag AS f,
        CAST(floor(CAST(round(l_quantity * 73) AS BIGINT) / 60) AS BIGINT) AS m
      FROM bounded v JOIN edges USING (parcel_id) JOIN lineitem ON l_suppkey = address_id
       AND l_shipdate >= v.inspection_date - INTERVAL {MONTHS} MONTH AND l_shipdate < v.inspection_date)
SELECT parcel_id, inspection_date, count(*) AS total, avg(m) AS avg_clear_time_minutes,
  max(m) AS max_clear_time_minutes, min(m) AS min_clear_time_minutes,
  round(stddev_samp(m), 6) AS stddev_clear_time_minutes,
  CAST(sum(CASE WHEN f = 'A' THEN 1 ELSE 0 END) AS BIGINT) AS incident_type_a,
  CAST(sum(CASE WHEN f = 'N' THEN 1 ELSE 0 END) AS BIGINT) AS incident_type_n,
  CAST(sum(CASE WHEN f = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS incident_type_r
FROM j GROUP BY 1, 2"""


def _sparse_levels(column: str, prefix: str, table: str, level: str, n: int = 15) -> str:
    """Comparison form of the frequent-level table of one category."""
    return f"""{prefix} AS (SELECT {level} AS raw, CASE WHEN row_number() OVER (ORDER BY count(*) DESC, {level}) <= {n}
      THEN {level} ELSE 'other' END AS lev FROM {table} GROUP BY 1)"""


def crime_features(spark, folder):
    """Nearby events by offence group, wide; as (key, group, count) rows with zeros kept for the comparison."""
    t = Tables(spark, folder)
    crime = t.lineitem.select(
        F.col("l_suppkey").alias("address_id"), F.col("l_shipdate").alias("occurred_on"),
        F.when(F.col("l_linenumber") < 7, F.concat(
            F.lit("theft ("), F.col("l_quantity").cast("int").cast("string"), F.lit(") "), F.col("l_returnflag")))
        .alias("orc"))
    wide = features.crime(_context(t, crime=crime))
    names = [c for c in wide.columns if c not in ("parcel_id", "inspection_date", "total")]
    return wide.unpivot(["parcel_id", "inspection_date", "total"], names, "categ", "count")


CRIME_FEATURES = f"""
WITH {PARCELS}, {ADDRESSES}, {INSPECTIONS}, {VISITS}, {edges(METRES)}, {bounds('lineitem', 'l_shipdate', MONTHS)},
crime AS (SELECT l_suppkey AS address_id, l_shipdate AS d, CASE WHEN l_linenumber < 7
            THEN CAST(CAST(l_quantity AS INT) AS VARCHAR) ELSE 'missing' END AS g FROM lineitem),
{_sparse_levels('g', 'lev', 'crime', 'g')},
j AS (SELECT v.parcel_id, v.inspection_date, lev.lev FROM bounded v JOIN edges USING (parcel_id)
      JOIN crime USING (address_id) JOIN lev ON lev.raw = crime.g
      WHERE d >= v.inspection_date - INTERVAL {MONTHS} MONTH AND d < v.inspection_date),
k AS (SELECT parcel_id, inspection_date, count(*) AS total FROM j GROUP BY 1, 2),
c AS (SELECT parcel_id, inspection_date, lev, count(*) AS n FROM j GROUP BY 1, 2, 3)
SELECT k.parcel_id, k.inspection_date, k.total, 'orc_combined_' || l.lev AS categ, coalesce(c.n, 0) AS count
FROM k CROSS JOIN (SELECT DISTINCT lev FROM lev) l
LEFT JOIN c ON c.parcel_id = k.parcel_id AND c.inspection_date = k.inspection_date AND c.lev = l.lev"""


def permits_features(spark, folder):
    t = Tables(spark, folder)
    d, n = F.col("l_shipdate"), F.col("l_linenumber")
    days = lambda c: F.make_interval(days=c.cast("int"))
    permits = t.lineitem.select(
        F.col("l_suppkey").alias("address_id"), d.alias("issueddate"),
        (d - days(F.col("l_quantity"))).alias("applieddate"),
        F.when(F.col("l_linestatus") != "O", d + days(n * 9)).alias("completeddate"),
        F.when(F.col("l_returnflag") != "N", d + days(F.lit(180))).alias("expiresdate"),
        F.when(F.col("l_tax") > 0.02, d).alias("coissueddate"),
        cents("l_extendedprice").alias("totalsqft"), cents("l_discount").alias("estprojectcostdec"),
        F.col("l_quantity").alias("units"),
        F.when(n == 5, F.lit("$none")).otherwise(F.concat(F.lit("$"), (n * 125).cast("string"))).alias("fee"),
        F.when(n == 1, F.lit("OWNER")).otherwise(F.lit("BUILDER")).alias("companyname"),
        F.col("l_returnflag").alias("proposeduse"), F.col("l_linestatus").alias("statuscurrent"),
        F.when(n != 7, F.concat(F.lit("w"), n.cast("string"))).alias("workclass"),
        F.concat(F.lit("c"), (F.col("l_quantity").cast("int") % 20).cast("string")).alias("permitclass"),
        F.lit("t").alias("permittype"))
    return features.permits(_context(t, permits=permits))


def _count_if(rule: str, name: str) -> str:
    return f"CAST(sum(CASE WHEN {rule} THEN 1 ELSE 0 END) AS BIGINT) AS {name}"


# the 15 most frequent of the 20 permit classes depend on the data: both sides list them by rank
PERMITS_FEATURES = f"""
WITH {PARCELS}, {ADDRESSES}, {INSPECTIONS}, {VISITS}, {edges(METRES)}, {bounds('lineitem', 'l_shipdate', MONTHS)},
j AS (SELECT v.parcel_id, v.inspection_date, l_shipdate AS d, l_linenumber AS n, lineitem.*
      FROM bounded v JOIN edges USING (parcel_id) JOIN lineitem ON l_suppkey = address_id
       AND l_shipdate >= v.inspection_date - INTERVAL {MONTHS} MONTH AND l_shipdate < v.inspection_date)
SELECT parcel_id, inspection_date, count(*) AS total,
  avg(CASE WHEN l_linestatus <> 'O' THEN n*9 + CAST(l_quantity AS INT) END) AS avg_days_applied_to_completed,
  avg(CASE WHEN l_linestatus <> 'O' THEN n*9 END) AS avg_days_issued_to_completed,
  avg(CAST(l_quantity AS INT)) AS avg_days_applied_to_issued,
  avg(CASE WHEN l_returnflag <> 'N' THEN 180 END) AS avg_days_issued_to_expires,
  avg(CASE WHEN l_returnflag <> 'N' AND l_linestatus <> 'O' THEN 180 - n*9 END) AS avg_days_completed_to_expires,
  1.0::DOUBLE AS avg_issued, avg(CASE WHEN l_linestatus <> 'O' THEN 1 ELSE 0 END) AS avg_completed,
  avg(CASE WHEN l_returnflag <> 'N' THEN 1 ELSE 0 END) AS avg_expires,
  avg(CAST(round(l_extendedprice*100) AS BIGINT)) AS avg_sqft, avg(CAST(round(l_discount*100) AS BIGINT)) AS avg_estcost,
  avg(l_quantity) AS avg_units, avg(CASE WHEN l_tax > 0.02 THEN 1 ELSE 0 END) AS avg_is_coissued,
  avg(CASE WHEN n <> 5 THEN n*125 END) AS avg_fee,
  avg(CASE WHEN n = 1 THEN 1 ELSE 0 END) AS avg_owner_is_company,
  {', '.join(_count_if(f"l_returnflag = '{v}'", f"proposeduse_{v.lower()}") for v in "ANR")},
  {', '.join(_count_if(f"l_linestatus = '{v}'", f"statuscurrent_{v.lower()}") for v in "FO")},
  {_count_if("n = 7", "workclass_missing")},
  {', '.join(_count_if(f"n = {v}", f"workclass_w{v}") for v in range(1, 7))},
  count(*) AS permittype_t
FROM j GROUP BY 1, 2"""


def permits_features_fixed(spark, folder):
    """Permit features without the rank-dependent class columns, which `permit_class_counts` covers."""
    wide = permits_features(spark, folder)
    return wide.drop(*[c for c in wide.columns if c.startswith("permitclass_")])


def permit_class_counts(spark, folder):
    wide = permits_features(spark, folder)
    names = [c for c in wide.columns if c.startswith("permitclass_")]
    return wide.unpivot(["parcel_id", "inspection_date"], names, "categ", "count")


PERMIT_CLASS_COUNTS = f"""
WITH {PARCELS}, {ADDRESSES}, {INSPECTIONS}, {VISITS}, {edges(METRES)}, {bounds('lineitem', 'l_shipdate', MONTHS)},
ev AS (SELECT l_suppkey AS address_id, l_shipdate AS d, 'c' || (CAST(l_quantity AS INT) % 20) AS g FROM lineitem),
{_sparse_levels('g', 'lev', 'ev', 'g')},
j AS (SELECT v.parcel_id, v.inspection_date, lev.lev FROM bounded v JOIN edges USING (parcel_id)
      JOIN ev USING (address_id) JOIN lev ON lev.raw = ev.g
      WHERE d >= v.inspection_date - INTERVAL {MONTHS} MONTH AND d < v.inspection_date),
c AS (SELECT parcel_id, inspection_date, lev, count(*) AS n FROM j GROUP BY 1, 2, 3)
SELECT k.parcel_id, k.inspection_date, 'permitclass_' || l.lev AS categ, coalesce(c.n, 0) AS count
FROM (SELECT DISTINCT parcel_id, inspection_date FROM j) k CROSS JOIN (SELECT DISTINCT lev FROM lev) l
LEFT JOIN c ON c.parcel_id = k.parcel_id AND c.inspection_date = k.inspection_date AND c.lev = l.lev"""


_SALE_NUMBER_SOURCES = ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_SALE_CATEGORY_SOURCES = ["l_returnflag", "l_linestatus"]


def sales_features(spark, folder):
    t = Tables(spark, folder)
    numbers = {c: _SALE_NUMBER_SOURCES[i % 5] for i, c in enumerate(features.SALE_NUMBERS)}
    texts = {c: _SALE_CATEGORY_SOURCES[i % 2] for i, c in enumerate(features.SALE_CATEGORIES)}
    sales = t.lineitem.select(
        F.col("l_suppkey").alias("address_id"), F.col("l_shipdate").alias("date_of_sale"),
        F.when(F.col("l_linenumber") > 1, F.col("l_linenumber")).alias("use_code"),
        *[cents(s).alias(c) for c, s in numbers.items()], *[F.col(s).alias(c) for c, s in texts.items()])
    return features.sales(_context(t, sales=sales))


SALES_FEATURES = f"""
WITH {PARCELS}, {ADDRESSES}, {INSPECTIONS}, {VISITS}, {edges(METRES)}, {bounds('lineitem', 'l_shipdate', MONTHS)},
j AS (SELECT v.parcel_id, v.inspection_date, lineitem.*
      FROM bounded v JOIN edges USING (parcel_id) JOIN lineitem ON l_suppkey = address_id
       AND l_shipdate >= v.inspection_date - INTERVAL {MONTHS} MONTH AND l_shipdate < v.inspection_date)
SELECT parcel_id, inspection_date, count(*) AS total,
  {', '.join(f"avg(CAST(round({_SALE_NUMBER_SOURCES[i % 5]}*100) AS BIGINT)) AS avg_{c}" for i, c in enumerate(features.SALE_NUMBERS))},
  {_count_if("l_linenumber = 1", "use_code_11111")},
  {', '.join(_count_if(f"l_linenumber = {v}", f"use_code_{v}") for v in range(2, 8))},
  {', '.join(_count_if(f"{s} = '{v}'", clean_name(f"{c}_{v}"))
             for i, c in enumerate(features.SALE_CATEGORIES)
             for s, vs in [(_SALE_CATEGORY_SOURCES[i % 2], "ANR" if i % 2 == 0 else "FO")] for v in vs)}
FROM j GROUP BY 1, 2"""


def three11_features(spark, folder):
    t = Tables(spark, folder)
    calls = t.orders.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("requested_datetime"), *t.at("o_orderkey", 17),
        F.col("o_orderpriority").alias("service_code"),
        F.when(F.col("o_orderstatus") == "F", F.lit(features.WEB_REQUEST)).alias("description"))
    linked = spatial.NearPoints(t.parcels, calls.withColumnRenamed("id", "event_id"), 200)
    ctx = Context(population=t.inspections, tables={"three11": calls}, event_edges=linked, months=2, metres=200)
    return features.three11(ctx)


_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
THREE11_FEATURES = f"""
WITH {PARCELS}, {INSPECTIONS}, {VISITS}, {bounds('orders', 'o_orderdate', 2)},
calls AS (SELECT *, (o_orderkey*7919+17)%20000 AS x, (o_orderkey*104729+17)%20000 AS y FROM orders),
linked AS (SELECT parcel_id, c.* FROM parcels p JOIN calls c ON {near('p', 'c', 200)})
SELECT v.parcel_id, v.inspection_date, count(*) AS total, {_count_if("o_orderstatus = 'F'", "sum_webrequest")},
  avg(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS avg_webrequest,
  {', '.join(_count_if(f"o_orderpriority = '{v}'", clean_name(f"service_code_{v}")) for v in _PRIORITIES)}
FROM bounded v JOIN linked l ON l.parcel_id = v.parcel_id
 AND o_orderdate >= v.inspection_date - INTERVAL 2 MONTH AND o_orderdate < v.inspection_date
GROUP BY 1, 2"""


def density_regularized(spark, folder):
    t = Tables(spark, folder)
    events = t.orders.select(F.col("o_custkey").alias("parcel_id"), F.col("o_orderdate").alias("date"),
                             F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("event"))
    ctx = Context(population=t.inspections, tables={
        "parcels": t.parcels.select("parcel_id", "x", "y"), "events_parcel": events}, months=MONTHS, metres=METRES)
    out = features.density(ctx)
    return rounded(out, [c for c in out.columns if c.endswith("_per_houses")])


_KINDS = {"f": "F", "o": "O", "missing": "P"}
DENSITY_REGULARIZED = f"""
WITH {PARCELS}, {INSPECTIONS}, {VISITS}, {bounds('orders', 'o_orderdate', MONTHS)},
houses AS (SELECT p.parcel_id, count(*) AS parcels FROM parcels p
  LEFT JOIN parcels q ON p.parcel_id <> q.parcel_id AND {near('p', 'q', METRES)} GROUP BY 1),
pairs AS (SELECT p.parcel_id, q.parcel_id AS other FROM parcels p JOIN parcels q ON {near('p', 'q', METRES)}),
c AS (SELECT v.parcel_id, v.inspection_date,
  {', '.join(_count_if(f"o_orderstatus = '{v}'", k) for k, v in _KINDS.items())}
  FROM bounded v JOIN pairs USING (parcel_id) JOIN orders ON o_custkey = other
   AND o_orderdate >= v.inspection_date - INTERVAL {MONTHS} MONTH AND o_orderdate < v.inspection_date
  GROUP BY 1, 2)
SELECT v.parcel_id, v.inspection_date, {', '.join(f"coalesce(c.{k}, 0) AS {k}" for k in _KINDS)},
  {', '.join(f"round((coalesce(c.{k}, 0) + 1.0) / (h.parcels + 5.0), 6) AS {k}_per_houses" for k in _KINDS)}
FROM visits v JOIN houses h USING (parcel_id) LEFT JOIN c USING (parcel_id, inspection_date)"""


def neighborhood_score(spark, folder):
    t = Tables(spark, folder)
    return features.neighborhood_score(
        t.inspections.select("parcel_id", "inspection_date"), t.inspections,
        t.parcels.select("parcel_id", "x", "y"), METRES, MONTHS)


def _scores(metres: float, months: int) -> str:
    return f"""pairs AS (SELECT p.parcel_id, q.parcel_id AS other FROM parcels p JOIN parcels q ON {near('p', 'q', metres)}),
matches AS (SELECT v.parcel_id, v.inspection_date, other, i.viol_outcome
  FROM visits v JOIN pairs USING (parcel_id) JOIN inspections i ON i.parcel_id = other
   AND i.inspection_date >= v.inspection_date - INTERVAL {months} MONTH AND i.inspection_date < v.inspection_date),
counts AS (SELECT parcel_id, inspection_date, {_count_if("viol_outcome = 1", "violations")},
  {_count_if("viol_outcome = 0", "non_violations")}, count(*) AS inspections FROM matches GROUP BY 1, 2),
uniq AS (SELECT parcel_id, inspection_date, {_count_if("viol_outcome = 1", "unique_violations")},
  {_count_if("viol_outcome = 0", "unique_non_violations")}, count(DISTINCT other) AS unique_inspections
  FROM (SELECT DISTINCT parcel_id, inspection_date, other, viol_outcome FROM matches) GROUP BY 1, 2),
houses AS (SELECT parcel_id, count(*) AS houses FROM pairs GROUP BY 1),
scores AS (SELECT counts.*, unique_violations, unique_non_violations, unique_inspections, houses
  FROM counts JOIN uniq USING (parcel_id, inspection_date) JOIN houses USING (parcel_id))"""


_METRICS = ["violations", "non_violations", "inspections", "unique_violations", "unique_non_violations",
            "unique_inspections", "houses"]
NEIGHBORHOOD_SCORE = f"""
WITH {PARCELS}, {INSPECTIONS}, {VISITS}, {_scores(METRES, MONTHS)}
SELECT scores.*, {', '.join(f"rank() OVER (ORDER BY {m}) AS {m}_rank" for m in _METRICS)} FROM scores"""


def _with_hours(inspections):
    """Inspections at a time of day: whole hours by the order's number, midnight included."""
    return inspections.withColumn("inspection_date", F.expr("inspection_date + make_interval(0, 0, 0, 0, CAST(order_id % 24 AS INT))"))


INSPECTIONS_WITH_HOURS = INSPECTIONS.replace("o_orderdate AS", "o_orderdate + to_hours(CAST(o_orderkey % 24 AS INT)) AS")


def neighborhood_moments(spark, folder):
    t = Tables(spark, folder)
    inspections = _with_hours(t.inspections)
    return features.neighborhood_score(
        inspections.select("parcel_id", "inspection_date"), inspections,
        t.parcels.select("parcel_id", "x", "y"), METRES, MONTHS, ranks=False)


NEIGHBORHOOD_MOMENTS = f"""
WITH {PARCELS}, {INSPECTIONS_WITH_HOURS}, {VISITS}, {_scores(METRES, MONTHS)}
SELECT * FROM scores"""


def inspection_metrics(spark, folder):
    t = Tables(spark, folder)
    latest = t.inspections.groupBy("parcel_id").agg(F.max("inspection_date").alias("inspection_date"))
    scores = features.neighborhood_score(latest, t.inspections, t.parcels.select("parcel_id", "x", "y"),
                                         METRES, MONTHS, ranks=False)
    return rounded(features.inspection_metrics(scores),
                   ["inspection_density", "violation_rate", "violations_per_house"])


INSPECTION_METRICS = f"""
WITH {PARCELS}, {INSPECTIONS},
visits AS (SELECT parcel_id, max(inspection_date) AS inspection_date FROM inspections GROUP BY 1), {_scores(METRES, MONTHS)}
SELECT parcel_id, round(unique_inspections / houses, 6) AS inspection_density,
  round(unique_violations / unique_inspections, 6) AS violation_rate,
  round(unique_violations / houses, 6) AS violations_per_house FROM scores"""


def weather_lookback(spark, folder):
    t = Tables(spark, folder)
    days = t.events.select(F.col("user_id").alias("parcel_id"), F.date_trunc("day", "ts").alias("inspection_date")) \
        .distinct()
    series = t.events.select(F.col("ts").alias("date"), "value")
    return rounded(asof.lookback_average(days, series, "inspection_date", "date", {"avg_value": "value"}, weeks=1)
                   .select("parcel_id", "inspection_date", "avg_value"), ["avg_value"])


WEATHER_LOOKBACK = """
WITH days AS (SELECT DISTINCT user_id AS parcel_id, date_trunc('day', ts)::TIMESTAMP AS inspection_date FROM events),
m AS (SELECT inspection_date, avg(value) AS v FROM (SELECT DISTINCT inspection_date FROM days) d
  JOIN events ON ts < inspection_date AND ts >= inspection_date - INTERVAL 7 DAY GROUP BY 1)
SELECT parcel_id, inspection_date, round(v, 6) AS avg_value FROM days LEFT JOIN m USING (inspection_date)"""


def weather_moments(spark, folder):
    t = Tables(spark, folder)
    moments = t.events.select(F.col("user_id").alias("parcel_id"), F.date_trunc("hour", "ts").alias("inspection_date")).distinct()
    series = t.events.select(F.col("ts").alias("date"), F.when(F.col("value") < 5, F.lit(float("nan"))).otherwise(F.round(F.col("value") * 100)).alias("value"))
    return rounded(asof.lookback_average(moments, series, "inspection_date", "date", {"avg_value": "value"}, weeks=1)
                   .select("parcel_id", "inspection_date", "avg_value"), ["avg_value"])


WEATHER_MOMENTS = """
WITH moments AS (SELECT DISTINCT user_id AS parcel_id, date_trunc('hour', ts)::TIMESTAMP AS inspection_date FROM events),
hours AS (SELECT date_trunc('hour', ts)::TIMESTAMP AS h, sum(round(value * 100)) FILTER (value >= 5) AS s, count(*) FILTER (value >= 5) AS c FROM events GROUP BY 1),
m AS (SELECT inspection_date, sum(s) / sum(c) AS v FROM (SELECT DISTINCT inspection_date FROM moments) d
  JOIN hours ON h < inspection_date AND h >= inspection_date - INTERVAL 7 DAY GROUP BY 1)
SELECT parcel_id, inspection_date, round(v, 6) AS avg_value FROM moments LEFT JOIN m USING (inspection_date)"""


def asof_event_features(spark, folder):
    """Own events of each user in the three days before each of their days."""
    t = Tables(spark, folder)
    out = asof.window_totals(
        t.events, t.events.select("user_id", F.date_trunc("day", "ts").alias("seen_on")), "user_id", "ts", "seen_on", [
            Measure("n", F.lit(1)), Measure("cents", cents("value")), Measure("top", F.col("value"), "max"),
            Measure("low", F.col("value"), "min"),
            Measure("clicks", (F.col("event_type") == "click").cast("int"))], days=3)
    return out.where("n > 0")


ASOF_EVENT_FEATURES = """
WITH d AS (SELECT DISTINCT user_id, date_trunc('day', ts)::TIMESTAMP AS seen_on FROM events)
SELECT d.user_id, seen_on, count(*) AS n, CAST(sum(CAST(round(value*100) AS BIGINT)) AS BIGINT) AS cents,
  max(value) AS top, min(value) AS low, CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS BIGINT) AS clicks
FROM d JOIN events e ON e.user_id = d.user_id AND e.ts < seen_on AND e.ts >= seen_on - INTERVAL 3 DAY GROUP BY 1, 2"""


QUERIES = {
    "near_event_counts": (near_event_counts, NEAR_EVENT_COUNTS),
    "proximity_edges": (proximity_edges, PROXIMITY_EDGES),
    "neighbor_counts": (neighbor_counts, NEIGHBOR_COUNTS),
    "nearby_event_pairs": (nearby_event_pairs, NEARBY_EVENT_PAIRS),
    "fire_features": (fire_features, FIRE_FEATURES),
    "crime_features": (crime_features, CRIME_FEATURES),
    "permits_features": (permits_features_fixed, PERMITS_FEATURES),
    "permit_class_counts": (permit_class_counts, PERMIT_CLASS_COUNTS),
    "sales_features": (sales_features, SALES_FEATURES),
    "three11_features": (three11_features, THREE11_FEATURES),
    "density_regularized": (density_regularized, DENSITY_REGULARIZED),
    "neighborhood_score": (neighborhood_score, NEIGHBORHOOD_SCORE),
    "neighborhood_moments": (neighborhood_moments, NEIGHBORHOOD_MOMENTS),
    "inspection_metrics": (inspection_metrics, INSPECTION_METRICS),
    "weather_moments": (weather_moments, WEATHER_MOMENTS),
    "weather_lookback": (weather_lookback, WEATHER_LOOKBACK),
    "asof_event_features": (asof_event_features, ASOF_EVENT_FEATURES),
}
