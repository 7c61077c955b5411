"""Queries on timelines, labels, panels, area rates and frequent levels."""

from __future__ import annotations

from pyspark.sql import functions as F

from vicinity.functions import dates, text
from vicinity.operators import area, levels, panel, pivot
from vicinity.operators.asof import fold_measures
from vicinity.operators.dedupe import align_by, single_value_cases
from vicinity.plans import census, population
from vicinity.queries.roles import INSPECTIONS, Tables, longs


def frequent_levels(spark, folder):
    return levels.frequent_levels(Tables(spark, folder).part, levels.level_of("p_brand"))


FREQUENT_LEVELS = """
SELECT row_number() OVER (ORDER BY count(*) DESC, p_brand) AS rnum, p_brand AS raw_level, count(*) AS count,
  CASE WHEN row_number() OVER (ORDER BY count(*) DESC, p_brand) <= 15 THEN p_brand ELSE 'other' END AS level
FROM part GROUP BY p_brand"""

_HOST = r"^https?://([^/?#]*)"
_ENDING = r"\.([a-z]+)$"


def regex_levels(spark, folder):
    hosts = Tables(spark, folder).pages.select(text.capture(F.col("url"), _HOST).alias("host"))
    return levels.frequent_groups(hosts, "host", _ENDING)


REGEX_LEVELS = rf"""
WITH h AS (SELECT nullif(regexp_extract(url, '{_HOST}', 1), '') AS host FROM pages),
g AS (SELECT coalesce(nullif(regexp_extract(host, '{_ENDING}', 1), ''), 'missing') AS raw_level, host FROM h),
c AS (SELECT raw_level, count(*) AS count, row_number() OVER (ORDER BY count(*) DESC, raw_level) AS rnum FROM g GROUP BY 1),
k AS (SELECT raw_level, host AS raw_code, count(*) AS raw_count FROM g GROUP BY 1, 2)
SELECT rnum, raw_level, CASE WHEN rnum <= 15 THEN raw_level ELSE 'other' END AS level, count, raw_code, raw_count
FROM c JOIN k USING (raw_level)"""

_TYPES = ["click", "error", "purchase", "signup", "view"]


def dense_category_pivot(spark, folder):
    """All customers with zero-filled event counts per type."""
    t = Tables(spark, folder)
    measures = pivot.level_measures(t.events, {"type": levels.level_of("event_type")})
    wide = fold_measures(t.events, [F.col("user_id").alias("parcel_id")], measures)
    keys = t.customer.select(F.col("c_custkey").alias("parcel_id"))
    return pivot.dense_join(keys, wide, ["parcel_id"], empty="zero", zero_columns=[m.name for m in measures])


def _counted(column: str, values: dict[str, str]) -> str:
    return ", ".join(f"CAST(sum(CASE WHEN {column} = '{v}' THEN 1 ELSE 0 END) AS BIGINT) AS {n}" for n, v in values.items())


DENSE_CATEGORY_PIVOT = f"""
SELECT c_custkey AS parcel_id, {_counted('event_type', {f'type_{v}': v for v in _TYPES})}
FROM customer LEFT JOIN events ON user_id = c_custkey GROUP BY 1"""


def multi_category_pivot(spark, folder):
    t = Tables(spark, folder)
    lines = t.lineitem.select("l_suppkey", "l_returnflag", "l_linestatus",
                              F.when(F.col("l_linenumber") < 7, F.col("l_linenumber")).alias("line"))
    return pivot.long_counts(lines, ["l_suppkey"], ["l_returnflag", "l_linestatus", "line"])


MULTI_CATEGORY_PIVOT = """
SELECT l_suppkey, 'l_returnflag_' || l_returnflag AS categ, count(*) AS count FROM lineitem GROUP BY 1, 2
UNION ALL SELECT l_suppkey, 'l_linestatus_' || l_linestatus, count(*) FROM lineitem GROUP BY 1, 2
UNION ALL SELECT l_suppkey, 'line_' || CASE WHEN l_linenumber < 7 THEN l_linenumber::VARCHAR ELSE 'missing' END,
  count(*) FROM lineitem GROUP BY 1, 2"""


def crosstab_total(spark, folder):
    return pivot.count_pivot(Tables(spark, folder).events, ["user_id"], ["event_type"])


CROSSTAB_TOTAL = f"""
SELECT user_id, {_counted('event_type', {v: v for v in _TYPES})}, count(*) AS total FROM events GROUP BY 1"""


def general_pivot(spark, folder):
    t = Tables(spark, folder)
    cells = t.lineitem.groupBy("l_suppkey", "l_returnflag", "l_linestatus").agg(
        F.sum(F.col("l_quantity").cast("long")).alias("qty"))
    return pivot.general_pivot(cells, ["l_suppkey"], ["l_returnflag", "l_linestatus"], "qty", default=0)


_CELLS = [(a, b) for a in "ANR" for b in "FO"]
GENERAL_PIVOT = f"""
SELECT l_suppkey, {', '.join(
    f"CAST(sum(CASE WHEN l_returnflag='{a}' AND l_linestatus='{b}' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT)"
    f" AS \"{a}, {b}\"" for a, b in _CELLS)} FROM lineitem GROUP BY 1"""


# --- timelines and labels ----------------------------------------------------------

def _kind():
    return F.when(F.col("o_orderpriority") < "3", F.lit("CBHCODE")).otherwise(F.lit("LTTR-PR"))


def _timeline(t: Tables, first_year: int | None):
    cases = t.orders.select(
        F.col("o_orderkey").alias("number_key"), _kind().alias("comp_type"), F.col("o_orderdate").alias("date_a"),
        F.when(F.col("o_orderstatus") != "P", F.date_add(F.col("o_orderdate").cast("date"), 5)).alias("date_b"))
    lines = t.lineitem.select(
        F.col("l_orderkey").alias("number_key"), F.lit("CBHCODE").alias("comp_type"),
        F.when(F.col("l_returnflag") == "R", F.col("l_shipdate")).alias("date_c"),
        F.when(F.col("l_linestatus") == "F", F.col("l_shipdate")).alias("date_h"))
    return panel.stacked_events([
        (cases, [("CBHCODE", "date_a", "Reported"), ("CBHCODE", "date_b", "Initial inspection"),
                 ("LTTR-PR", "date_b", "Initial inspection")]),
        (lines, [("CBHCODE", "date_c", "Orders issued"), ("CBHCODE", "date_h", "Civil 1")]),
    ], "number_key", "comp_type", first_year)


def _timeline_sql(first_year: int | None) -> str:
    late = f"WHERE date >= TIMESTAMP '{first_year}-01-01'" if first_year else ""
    return f"""cases AS (SELECT o_orderkey AS number_key, CASE WHEN o_orderpriority < '3' THEN 'CBHCODE' ELSE 'LTTR-PR' END
    AS comp_type, o_orderdate AS date_a, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate + INTERVAL 5 DAY END AS date_b
    FROM orders),
lines AS (SELECT l_orderkey AS number_key, 'CBHCODE' AS comp_type, CASE WHEN l_returnflag = 'R' THEN l_shipdate END AS date_c,
    CASE WHEN l_linestatus = 'F' THEN l_shipdate END AS date_h FROM lineitem),
timeline AS (SELECT * FROM (
  SELECT number_key, comp_type, date_a AS date, 'Reported' AS event FROM cases WHERE comp_type = 'CBHCODE' AND date_a IS NOT NULL
  UNION SELECT number_key, comp_type, date_b, 'Initial inspection' FROM cases WHERE date_b IS NOT NULL
  UNION SELECT number_key, comp_type, date_c, 'Orders issued' FROM lines WHERE date_c IS NOT NULL
  UNION SELECT number_key, comp_type, date_h, 'Civil 1' FROM lines WHERE date_h IS NOT NULL) u {late})"""


def event_timeline(spark, folder):
    return _timeline(Tables(spark, folder), 1997)


EVENT_TIMELINE = f"WITH {_timeline_sql(1997)} SELECT * FROM timeline"


def single_parcel_cases(spark, folder):
    return single_value_cases(Tables(spark, folder).lineitem, "l_orderkey", "l_suppkey", F.col("l_linestatus") == "O")


SINGLE_PARCEL_CASES = """
SELECT l_orderkey, CAST(max(l_suppkey) AS VARCHAR) AS l_suppkey FROM lineitem WHERE l_linestatus = 'O'
GROUP BY 1 HAVING count(DISTINCT l_suppkey) = 1"""


def _case_parcels(t: Tables):
    return t.orders.select(F.col("o_orderkey").alias("number_key"), F.col("o_custkey").alias("parcel_no"))


def label_generation(spark, folder):
    t = Tables(spark, folder)
    return longs(population.labels_from_events(_timeline(t, None), _case_parcels(t)), ["viol_outcome"])


LABEL_GENERATION = f"""
WITH {_timeline_sql(None)},
e AS (SELECT t.*, o_custkey AS parcel_id FROM timeline t JOIN orders ON o_orderkey = number_key WHERE comp_type = 'CBHCODE'),
insp AS (SELECT * FROM e WHERE event = 'Initial inspection'),
viol AS (SELECT * FROM e WHERE event IN ('Orders issued', 'Civil 1', 'Civil 2', 'Final notice',
  'Pre-prosecution status', 'Prosecutor approves')),
l AS (SELECT DISTINCT parcel_id, date AS inspection_date,
        CASE WHEN number_key IN (SELECT number_key FROM viol) THEN 1 ELSE 0 END AS y FROM insp
      UNION SELECT parcel_id, date, 1 FROM viol WHERE number_key NOT IN (SELECT number_key FROM insp))
SELECT parcel_id, inspection_date, CAST(max(y) AS BIGINT) AS viol_outcome FROM l GROUP BY 1, 2 HAVING count(*) = 1"""


def asof_population(spark, folder):
    t = Tables(spark, folder)
    return population.everyone_at(t.orders, "o_custkey", "2001-12-31").withColumn(
        "viol_outcome", F.coalesce(F.col("viol_outcome"), F.lit(-1)))


ASOF_POPULATION = """
SELECT DISTINCT o_custkey AS parcel_id, TIMESTAMP '2001-12-31' AS inspection_date, -1 AS viol_outcome FROM orders"""


def field_test_list(spark, folder):
    t = Tables(spark, folder)
    return population.field_test_population(t.inspections, "2001-06-30").groupBy("parcel_id", "inspection_date").agg(
        F.count("viol_outcome").alias("labelled"), F.count(F.lit(1)).alias("n"))


FIELD_TEST_LIST = f"""
WITH {INSPECTIONS} SELECT parcel_id, TIMESTAMP '2001-06-30' AS inspection_date, count(viol_outcome) AS labelled,
count(*) AS n FROM inspections GROUP BY 1, 2"""


def inspections_of_years(spark, folder):
    t = Tables(spark, folder)
    places = t.parcels.select("parcel_id", F.col("x").alias("latitude"), F.col("y").alias("longitude"))
    rows = t.inspections.select("parcel_id", "inspection_date", "viol_outcome")
    return population.inspections_in_years(rows, places, 1996, 1997, violations_only=True)


INSPECTIONS_OF_YEARS = f"""
WITH {INSPECTIONS} SELECT parcel_id, inspection_date, (parcel_id*7919)%20000 AS latitude, (parcel_id*104729)%20000 AS longitude
FROM inspections JOIN customer ON c_custkey = parcel_id
WHERE viol_outcome = 1 AND year(inspection_date) BETWEEN 1996 AND 1997"""


def any_interaction(spark, folder):
    t = Tables(spark, folder)
    seen = t.orders.where(F.col("o_orderstatus") == "P").select(F.col("o_custkey").alias("parcel_id"))
    return population.any_interaction(t.parcels.select("parcel_id"), seen) \
        .withColumn("any_interaction", F.col("any_interaction").cast("int"))


ANY_INTERACTION = """
SELECT c_custkey AS parcel_id, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')
  THEN 1 ELSE 0 END AS any_interaction FROM customer"""


# --- yearly panels -----------------------------------------------------------------

def _money_panel(t: Tables):
    cents = lambda c: F.sum(F.round(F.col(c) * 100).cast("long"))
    return t.lineitem.groupBy(F.col("l_suppkey").alias("parcel_id"), F.year("l_shipdate").alias("year")).agg(
        cents("l_extendedprice").alias("total"), cents("l_tax").alias("tax"),
        (F.count(F.when(F.col("l_returnflag") == "R", 1)) * 3 > F.count(F.lit(1))).alias("flag"))


_MONEY = """panel AS (SELECT l_suppkey AS parcel_id, year(l_shipdate) AS year,
  CAST(sum(CAST(round(l_extendedprice*100) AS BIGINT)) AS BIGINT) AS total,
  CAST(sum(CAST(round(l_tax*100) AS BIGINT)) AS BIGINT) AS tax,
  count(CASE WHEN l_returnflag = 'R' THEN 1 END) * 3 > count(*) AS flag FROM lineitem GROUP BY 1, 2),
visits AS (SELECT DISTINCT l_suppkey AS parcel_id, l_shipdate AS inspection_date FROM lineitem)"""


def _panel_visits(t: Tables):
    return t.lineitem.select(F.col("l_suppkey").alias("parcel_id"), F.col("l_shipdate").alias("inspection_date"))


def panel_means_changes(spark, folder):
    t = Tables(spark, folder)
    out = panel.panel_features(_panel_visits(t), _money_panel(t), "parcel_id", "inspection_date", "year",
                               {"total": "market_value", "tax": "tax_value"})
    return longs(out, ["change_market_value", "change_tax_value"])


def _changes(c: str, stem: str) -> str:
    first, last = f"min_by({c}, year)", f"max_by({c}, year)"
    many = "CASE WHEN min(year) < max(year) THEN"
    return (f"avg({c}) AS mean_{stem}, {many} {last} - {first} END AS change_{stem}, "
            f"{many} CAST({last} - {first} AS DOUBLE) / nullif(CAST({first} AS DOUBLE), 0) END AS rel_change_{stem}")


PANEL_MEANS_CHANGES = f"""
WITH {_MONEY} SELECT v.parcel_id, v.inspection_date, {_changes('total', 'market_value')}, {_changes('tax', 'tax_value')}
FROM visits v JOIN panel p ON p.parcel_id = v.parcel_id AND year(v.inspection_date) > p.year
 AND year(v.inspection_date) - 3 <= p.year GROUP BY 1, 2"""


def flag_years(spark, folder):
    t = Tables(spark, folder)
    return panel.flagged_years(_panel_visits(t), _money_panel(t), "parcel_id", "inspection_date", "year", "flag",
                               "tax_foreclosure")


FLAG_YEARS = f"""
WITH {_MONEY} SELECT v.parcel_id, v.inspection_date, CAST(sum(CAST(flag AS INT)) AS DOUBLE) AS tax_foreclosure
FROM visits v JOIN panel p ON p.parcel_id = v.parcel_id AND year(v.inspection_date) > p.year
 AND year(v.inspection_date) - 3 <= p.year GROUP BY 1, 2"""


def _owner_panel(t: Tables):
    kind = F.when(F.count(F.when(F.col("o_orderstatus") == "F", 1)) >= 1, F.lit("ORGANIZATION")).otherwise(F.lit("PERSON"))
    return t.orders.groupBy(F.col("o_custkey").alias("parcel_id"),
                            (F.year("o_orderdate") + 12).alias("year")).agg(kind.alias("owner"))


def owners_by_year(spark, folder):
    return align_by(_owner_panel(Tables(spark, folder)), "parcel_id", "year", "owner", list(range(2007, 2014)), "owner_")


_OWNERS = f"""op AS (SELECT o_custkey AS parcel_id, year(o_orderdate) + 12 AS year, CASE WHEN
  count(CASE WHEN o_orderstatus = 'F' THEN 1 END) >= 1 THEN 'ORGANIZATION' ELSE 'PERSON' END AS owner FROM orders GROUP BY 1, 2),
wide AS (SELECT parcel_id, {', '.join(f"max(CASE WHEN year = {y} THEN owner END) AS owner_{y}" for y in range(2007, 2014))}
  FROM op GROUP BY 1)"""
OWNERS_BY_YEAR = f"WITH {_OWNERS} SELECT * FROM wide"


def organisation_years(spark, folder):
    t = Tables(spark, folder)
    wide = owners_by_year(spark, folder).withColumns({"owner_2014": F.lit(None).cast("string")})
    visits = t.orders.select(F.col("o_custkey").alias("parcel_id"),
                             (F.col("o_orderdate") + F.make_interval(years=F.lit(12))).alias("inspection_date")).distinct()
    return panel.organisation_years(visits.join(wide, "parcel_id"), "inspection_date") \
        .select("parcel_id", "inspection_date", F.coalesce("owner_ner", F.lit(-1)).alias("owner_ner"))


def _prior(y: int) -> str:
    years = [p for p in range(y - 3, y) if 2007 <= p <= 2013]
    return " + ".join(f"CASE WHEN owner_{p} = 'ORGANIZATION' THEN 1 ELSE 0 END" for p in years)


ORGANISATION_YEARS = f"""
WITH {_OWNERS}, v AS (SELECT DISTINCT o_custkey AS parcel_id, o_orderdate + INTERVAL 12 YEAR AS inspection_date FROM orders)
SELECT parcel_id, inspection_date, CASE year(inspection_date)
  {' '.join(f"WHEN {y} THEN {_prior(y)}" for y in range(2008, 2016))} ELSE -1 END AS owner_ner
FROM v JOIN wide USING (parcel_id)"""


def owner_counts(spark, folder):
    t = Tables(spark, folder)
    people = t.part.select(F.col("p_partkey").alias("parcel_id"), "p_brand")
    holdings = t.lineitem.select(F.col("l_partkey").alias("parcel_id"), F.col("l_suppkey").alias("owner"))
    return panel.properties_owned(people, holdings, "parcel_id", "owner")


OWNER_COUNTS = """
SELECT p_partkey AS parcel_id, p_brand, n AS num_properties_owned FROM part JOIN lineitem ON l_partkey = p_partkey
JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) USING (l_suppkey)"""


def parcel_info(spark, folder):
    t = Tables(spark, folder)
    parcels = t.customer.select(F.col("c_custkey").alias("parcel_id"), (F.col("c_custkey") % 200 + 400).cast("int").alias("class"))
    areas = t.customer.select(F.col("c_custkey").alias("parcel_id"), F.lower("c_mktsegment").alias("addrst"),
                              F.col("c_nationkey").cast("string").alias("addrno"), F.lit(None).cast("string").alias("addrsf"),
                              F.col("c_nationkey").alias("tract"))
    events = t.orders.select(
        F.col("o_custkey").alias("parcel_id"), F.col("o_orderdate").alias("date"),
        F.col("o_orderstatus").alias("comp_type"), F.col("o_orderpriority").alias("event"))
    return population.parcel_info(parcels, areas, events).withColumn("residential", F.col("residential").cast("int"))


PARCEL_INFO = """
WITH l AS (SELECT o_custkey, o_orderdate, o_orderstatus, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey
  ORDER BY o_orderdate DESC, o_orderpriority) AS rn FROM orders) WHERE rn = 1)
SELECT c_custkey AS parcel_id, CASE WHEN c_custkey % 200 + 400 = 423 OR c_custkey % 200 + 400 >= 500 THEN 1 ELSE 0 END AS residential,
  c_nationkey AS tract, c_nationkey || ' ' || upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) || '  ' AS address,
  o_orderdate AS last_interaction, o_orderstatus AS last_interaction_type, o_orderpriority AS last_interaction_event
FROM customer LEFT JOIN l ON o_custkey = c_custkey"""


def yearly_union(spark, folder):
    """Yearly tables with one projection each, equal rows once."""
    t = Tables(spark, folder)
    first, last = t.lineitem.agg(F.min(F.year("l_shipdate")), F.max(F.year("l_shipdate"))).first()
    tables = {y: t.lineitem.where(dates.year_range("l_shipdate", y)) for y in range(first, last + 1)}
    return panel.yearly_union(tables, {"parcel_id": F.col("l_suppkey"), "class": F.col("l_returnflag"),
                                       "units": F.col("l_linenumber").cast("long")})


YEARLY_UNION = """
SELECT DISTINCT year(l_shipdate)::INT AS year, l_suppkey AS parcel_id, l_returnflag AS class,
  CAST(l_linenumber AS BIGINT) AS units FROM lineitem WHERE l_shipdate IS NOT NULL"""


# --- areas -------------------------------------------------------------------------

def _area_events(t: Tables):
    return t.orders.join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")) \
        .select(F.col("c_nationkey").alias("tract"), F.col("o_orderdate").alias("at"), "o_orderpriority")


def _area_visits(t: Tables):
    return t.lineitem.join(t.supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")) \
        .select(F.col("s_nationkey").alias("tract"), F.col("l_shipdate").alias("inspection_date")).distinct()


def _persons(t: Tables):
    return area.population_by(t.customer.where("c_nationkey <> 3").withColumnRenamed("c_nationkey", "tract"),
                              "tract", F.lit(1))


def area_population(spark, folder):
    return _persons(Tables(spark, folder))


AREA_POPULATION = "SELECT c_nationkey AS tract, count(*) AS population FROM customer WHERE c_nationkey <> 3 GROUP BY 1"

_AREA = """ev AS (SELECT c_nationkey AS tract, o_orderdate AS at_time, o_orderpriority FROM orders JOIN customer ON c_custkey = o_custkey),
vis AS (SELECT DISTINCT s_nationkey AS tract, l_shipdate AS inspection_date FROM lineitem JOIN supplier ON s_suppkey = l_suppkey),
pop AS (SELECT c_nationkey AS tract, count(*) AS population FROM customer WHERE c_nationkey <> 3 GROUP BY 1)"""


def area_rate_year(spark, folder):
    t = Tables(spark, folder)
    return area.area_rate_year(_area_visits(t), _area_events(t), _persons(t), "tract", "at", "inspection_date")


AREA_RATE_YEAR = f"""
WITH {_AREA}, c AS (SELECT v.tract, v.inspection_date, count(*) AS events FROM vis v JOIN ev ON ev.tract = v.tract
 AND at_time < v.inspection_date AND at_time > v.inspection_date - INTERVAL 1 YEAR GROUP BY 1, 2)
SELECT c.*, CAST(events AS DOUBLE) / population AS rate FROM c JOIN pop USING (tract)"""


def area_rate_months(spark, folder):
    t = Tables(spark, folder)
    events = _area_events(t).where(F.col("o_orderpriority").like("%URGENT%"))
    return area.area_rate_months(_area_visits(t), events, _persons(t), "tract", "at", "inspection_date",
                                 365, 1996, 60)


AREA_RATE_MONTHS = f"""
WITH {_AREA}, m AS (SELECT tract, least(greatest((year(at_time)-1996)*12 + month(at_time)-1, 0), 59) AS i, count(*) AS n
  FROM ev WHERE o_orderpriority LIKE '%URGENT%' GROUP BY 1, 2),
b AS (SELECT *, least(greatest((year(inspection_date - INTERVAL 365 DAY)-1996)*12 + month(inspection_date - INTERVAL 365 DAY)-1, 0), 59) AS lo,
  least(greatest((year(inspection_date)-1996)*12 + month(inspection_date)-1, 0), 59) AS hi FROM vis),
c AS (SELECT b.tract, b.inspection_date, CAST(coalesce(sum(n), 0) AS BIGINT) AS events FROM b
  LEFT JOIN m ON m.tract = b.tract AND i >= lo AND i < hi GROUP BY 1, 2)
SELECT c.*, CAST(events AS DOUBLE) / population AS rate FROM c LEFT JOIN pop USING (tract)"""


def census_ratios(spark, folder):
    """All ratios, on counts of customers that stand in for the census columns; some are unknown in some areas."""
    t = Tables(spark, folder)
    counts = {c: F.count_if((F.col("c_custkey") * (i + 3)) % 11 < 5) for i, c in enumerate(_CENSUS_COLUMNS)}
    rows = t.customer.groupBy("c_nationkey").agg(*[
        (F.when(F.col("c_nationkey") % 5 != 0, n) if i % 9 == 4 else n).alias(c) for i, (c, n) in enumerate(counts.items())])
    return census.ratios(rows, ["c_nationkey"])


_CENSUS_COLUMNS = sorted({c for parts, whole in census.RATIOS.values() for c in (*parts, whole)} | {"H0190006"})


def _census_count(i: int, column: str) -> str:
    n = f"count(CASE WHEN (c_custkey * {i + 3}) % 11 < 5 THEN 1 END)"
    return f"{f'CASE WHEN c_nationkey % 5 <> 0 THEN {n} END' if i % 9 == 4 else n} AS {column}"


def _census_share(name: str, parts: list[str], whole: str) -> str:
    skipping = len(parts) > 2 and name != "rate_male_under_18"
    return f"({' + '.join(f'coalesce({p}, 0)' if skipping else p for p in parts)})::DOUBLE / nullif({whole}, 0) AS {name}"


CENSUS_RATIOS = f"""
WITH b AS (SELECT c_nationkey, {', '.join(_census_count(i, c) for i, c in enumerate(_CENSUS_COLUMNS))} FROM customer GROUP BY 1)
SELECT c_nationkey, {', '.join(_census_share(n, p, w) for n, (p, w) in census.RATIOS.items())},
  1.0::DOUBLE - H0190006::DOUBLE / nullif(H0040004, 0) AS rate_renter_occupied_no_children FROM b"""


# --- dummies -----------------------------------------------------------------------

def quarter_dummies(spark, folder):
    rows = Tables(spark, folder).orders.select("o_orderkey", "o_orderdate")
    return dates.quarter_dummies(rows, "o_orderdate")


QUARTER_DUMMIES = f"""
SELECT o_orderkey, o_orderdate, {', '.join(f"CASE WHEN quarter(o_orderdate) = {k} THEN 1 ELSE 0 END AS q{k}" for k in range(1, 5))}
FROM orders"""


def house_type_dummies(spark, folder):
    rows = Tables(spark, folder).part.select("p_partkey", (F.col("p_partkey") % 200 + 400).cast("int").alias("class"))
    wide = text.home_dummies(rows, "class").withColumns({
        "selected": text.is_residential_class(F.col("class")).cast("int"),
        "reported": text.is_residential_report(F.col("class")).cast("int")})
    return pivot.with_clean_names(wide.toDF(*[c.replace("-", "_") for c in wide.columns]))


_HOME = "CASE WHEN class IN ({}) THEN 1 ELSE 0 END AS {}"
HOUSE_TYPE_DUMMIES = f"""
WITH r AS (SELECT p_partkey, CAST(p_partkey % 200 + 400 AS INT) AS class FROM part)
SELECT p_partkey, class, {_HOME.format('510', 'single_family')}, {_HOME.format('520', 'two_family')},
  {_HOME.format('530', 'three_family')}, {_HOME.format('550, 552, 554, 599', 'multi_family')},
  {_HOME.format('423', 'mixed_use')},
  {_HOME.format('401,402,403,404,419,423,431,510,520,530,550,551,552,554,555,560,599,996', 'selected')},
  CASE WHEN class = 423 OR class BETWEEN 500 AND 599 THEN 1 ELSE 0 END AS reported FROM r"""


def fixed_dummies(spark, folder):
    rows = Tables(spark, folder).orders.select(
        "o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("status"))
    return levels.fixed_dummies(rows, "status", ["F", "O", "X"], ["is_f", "is_o", "is_x"])


FIXED_DUMMIES = """
WITH r AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS status FROM orders)
SELECT *, CASE WHEN status IS NOT NULL THEN CAST(status = 'F' AS INT) END AS is_f,
  CASE WHEN status IS NOT NULL THEN CAST(status = 'O' AS INT) END AS is_o,
  CASE WHEN status IS NOT NULL THEN CAST(status = 'X' AS INT) END AS is_x FROM r"""


QUERIES = {
    "frequent_levels": (frequent_levels, FREQUENT_LEVELS),
    "regex_levels": (regex_levels, REGEX_LEVELS),
    "dense_category_pivot": (dense_category_pivot, DENSE_CATEGORY_PIVOT),
    "multi_category_pivot": (multi_category_pivot, MULTI_CATEGORY_PIVOT),
    "crosstab_total": (crosstab_total, CROSSTAB_TOTAL),
    "general_pivot": (general_pivot, GENERAL_PIVOT),
    "event_timeline": (event_timeline, EVENT_TIMELINE),
    "single_parcel_cases": (single_parcel_cases, SINGLE_PARCEL_CASES),
    "label_generation": (label_generation, LABEL_GENERATION),
    "asof_population": (asof_population, ASOF_POPULATION),
    "field_test_list": (field_test_list, FIELD_TEST_LIST),
    "inspections_of_years": (inspections_of_years, INSPECTIONS_OF_YEARS),
    "any_interaction": (any_interaction, ANY_INTERACTION),
    "panel_means_changes": (panel_means_changes, PANEL_MEANS_CHANGES),
    "flag_years": (flag_years, FLAG_YEARS),
    "owners_by_year": (owners_by_year, OWNERS_BY_YEAR),
    "organisation_years": (organisation_years, ORGANISATION_YEARS),
    "owner_counts": (owner_counts, OWNER_COUNTS),
    "parcel_info": (parcel_info, PARCEL_INFO),
    "yearly_union": (yearly_union, YEARLY_UNION),
    "area_population": (area_population, AREA_POPULATION),
    "area_rate_year": (area_rate_year, AREA_RATE_YEAR),
    "area_rate_months": (area_rate_months, AREA_RATE_MONTHS),
    "census_ratios": (census_ratios, CENSUS_RATIOS),
    "quarter_dummies": (quarter_dummies, QUARTER_DUMMIES),
    "house_type_dummies": (house_type_dummies, HOUSE_TYPE_DUMMIES),
    "fixed_dummies": (fixed_dummies, FIXED_DUMMIES),
}
