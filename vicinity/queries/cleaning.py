"""Queries on file parsing, cleaning and incremental loads (the tables rendered to text where needed)."""

from __future__ import annotations

from pyspark.sql import functions as F

from vicinity.functions import dates, text
from vicinity.operators import profile, tagger
from vicinity.queries.roles import ADDRESSES, PARCELS, SCORED, Tables, near, rounded
from vicinity.sources import files, increment
from vicinity.streaming.incremental import not_loaded_before


def fixed_width_parse(spark, folder):
    t = Tables(spark, folder)
    line = F.concat(
        F.lpad(F.col("c_custkey").cast("string"), 10, "0"), F.rpad("c_mktsegment", 12, " "),
        F.lpad(F.when(F.col("c_nationkey") == 7, F.lit("-9999")).otherwise(F.col("c_nationkey").cast("string")), 6, " "),
        F.rpad(F.when(F.col("c_nationkey") < 20, F.col("c_name")).otherwise(F.lit("")), 20, " "))
    slices = files.slices_from_widths([("key", 10), ("segment", 12), ("nation", 6), ("name", 20)])
    return files.split_fixed_width(t.customer.select(line.alias("value")), slices, sentinels=["-9999"]) \
        .select("key", "segment", "nation", F.coalesce("name", F.lit("none")).alias("name"))


FIXED_WIDTH_PARSE = """
SELECT lpad(c_custkey::VARCHAR, 10, '0') AS key, c_mktsegment AS segment, CASE WHEN c_nationkey <> 7 THEN c_nationkey::VARCHAR END AS nation,
  CASE WHEN c_nationkey < 20 THEN c_name ELSE 'none' END AS name FROM customer"""


def clean_addresses(spark, folder):
    t = Tables(spark, folder)
    raw = F.concat(F.lit('"'), (F.col("c_custkey") % 500).cast("string"), F.lit(" Main St"), F.lit(", TOWN - "), F.col("c_mktsegment"), F.lit('" '))
    rows = t.customer.select(F.when(F.col("c_nationkey") != 3, raw).alias("address"), "c_mktsegment")
    cleaned = files.clean_rows(rows).withColumn(
        "street", text.street_part(text.without_quotes(F.col("address")), "TOWN"))
    return cleaned.select("address", "street", "c_mktsegment")


CLEAN_ADDRESSES = """
WITH r AS (SELECT DISTINCT '"' || (c_custkey % 500) || ' Main St, TOWN - ' || c_mktsegment || '" ' AS a, c_mktsegment, c_custkey % 500 AS k
  FROM customer WHERE c_nationkey <> 3)
SELECT trim(a) AS address, k || ' Main St' AS street, c_mktsegment FROM r"""


def parcel_id_normalize(spark, folder):
    t = Tables(spark, folder)
    k = F.col("o_orderkey").cast("string")
    return t.orders.select(
        "o_orderkey", text.wide_parcel_id(k).alias("wide"), text.zero_padded(F.concat(k, F.lit("12345678901"))).alias("long_id"),
        text.zero_padded(k).alias("padded"), text.short_zip(F.concat(k, F.lit("-4521"))).alias("zip"),
        text.block_group(k).alias("block_group"), text.composite_key(["o_orderkey", "o_custkey", "o_orderstatus"]).alias("composite"))


PARCEL_ID_NORMALIZE = """
WITH r AS (SELECT *, o_orderkey::VARCHAR AS k FROM orders)
SELECT o_orderkey, '0' || lpad(k, 11, ' ') AS wide,
  CASE WHEN length(k || '12345678901') < 12 THEN lpad(k || '12345678901', 12, '0') ELSE k || '12345678901' END AS long_id,
  lpad(k, 12, '0') AS padded, substr(k || '-4521', 1, 5) AS zip, substr(k, 1, 1) AS block_group,
  k || o_custkey || o_orderstatus AS composite FROM r"""


def owner_entities(spark, folder):
    """Owner names formatted and tagged; names come from customers and their segments."""
    t = Tables(spark, folder)
    first = F.when(F.col("c_nationkey") == 0, F.lit("STATE  of north")).when(
        F.col("c_nationkey") < 12, F.concat(F.lower("c_mktsegment"), F.lit(" HOLDINGS llc"))).otherwise(
        F.concat(F.lit("SMITH "), F.col("c_mktsegment")))
    second = F.when(F.col("c_custkey") % 3 == 0, F.lit("& WIFE")).when(F.col("c_custkey") % 3 == 1, F.lit("attn desk"))
    rows = t.customer.select("c_custkey", text.owner_name(first, second).alias("owner"))
    return text.owner_entities(rows, "owner", {"State Of North": "STATE"})


OWNER_ENTITIES = """
WITH r AS (SELECT c_custkey, c_nationkey, CASE WHEN c_nationkey = 0 THEN 'State Of North' WHEN c_nationkey < 12
    THEN upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) || ' Holdings Llc'
    ELSE 'Smith ' || upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) END
    || CASE WHEN c_custkey % 3 = 1 THEN ' Attn Desk' ELSE '' END AS owner FROM customer)
SELECT c_custkey, owner, CASE WHEN owner = 'State Of North' THEN 'STATE' WHEN c_nationkey BETWEEN 1 AND 11 THEN 'ORGANIZATION'
  ELSE 'PERSON' END AS entity FROM r"""


def _written_names(t: Tables):
    """A name for every customer, its word tags, and what kind of owner it is; no word tells the kind alone by a list."""
    k = F.col("c_custkey")
    letter = lambda n, signs: F.substring(F.lit(signs), (n % len(signs)).cast("int") + 1, 1)
    stem = lambda a, b: F.concat(F.upper(letter(k * a + b, "bcdfglmnprst")), letter(k * b + a, "aeiou"), letter(k + a * b, "lmnrt"),
                                 letter(k * 5 + b, "aeiou"))
    pick = lambda n, *values: F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values)).cast("int") + 1)
    family, given = F.concat(stem(3, 7), pick(k, "son", "sen", "man")), F.concat(stem(11, 5), pick(F.floor(k / 30), "lia", "kus"))
    house, trade = F.concat(stem(13, 2), pick(k, "tex", "rex", "plex")), pick(k * 3, "Works", "Guild", "Mills", "Lines")
    person, firm = F.lit("PERSON"), F.lit("ORGANIZATION")
    forms = [(F.concat_ws(" ", given, family), F.array(person, person)), (F.concat_ws(" ", house, trade), F.array(firm, firm)),
             (F.concat_ws(" ", F.lit("Estate"), F.lit("Of"), given, family), F.array(F.lit("O"), F.lit("O"), person, person)),
             (F.concat_ws(" ", F.lit("The"), house, trade), F.array(F.lit("O"), firm, firm)), (family, F.array(person))]
    form = k % len(forms)
    choose = lambda i: F.coalesce(*[F.when(form == n, f[i]) for n, f in enumerate(forms)])
    return t.customer.select("c_custkey", choose(0).alias("owner"), choose(1).alias("tags"))


def owner_tags(spark, folder):
    """A tagger learns from a quarter of the names and tags all."""
    names = _written_names(Tables(spark, folder))
    fitted = tagger.fit_tagger(names.where(F.floor(F.col("c_custkey") / 5) % 4 == 1), "owner", "tags")
    return fitted.entities(names.drop("tags"), "owner").select("c_custkey", "entity")


OWNER_TAGS = """
SELECT c_custkey, CASE WHEN c_custkey % 5 IN (0, 2) THEN 'PERSON' WHEN c_custkey % 5 IN (1, 3) THEN 'ORGANIZATION' END AS entity FROM customer"""


def flags_and_fees(spark, folder):
    t = Tables(spark, folder)
    n = F.col("l_linenumber")
    return t.lineitem.select(
        "l_orderkey", n, text.yes_no(F.when(n < 3, F.lit("Y")).when(n < 5, F.lit("N"))).cast("int").alias("flag"),
        text.fee_amount(F.when(n == 5, F.lit("$n/a")).otherwise(F.concat(F.lit("$"), (n * 125).cast("string")))).alias("fee"),
        text.whole_number(F.when(n == 6, F.lit("?")).otherwise(F.concat(n.cast("string"), F.lit(".7")))).alias("value"),
        text.mapped(F.when(n < 4, F.lit("YES")).when(n < 6, F.lit("NONE")).otherwise(F.lit("MAYBE")),
                    {"YES": 1, "NONE": 0}).alias("outcome"))


FLAGS_AND_FEES = """
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber < 3 THEN 1 WHEN l_linenumber < 5 THEN 0 END AS flag,
  CASE WHEN l_linenumber <> 5 THEN CAST(l_linenumber * 125 AS DOUBLE) END AS fee, CASE WHEN l_linenumber <> 6 THEN l_linenumber END AS value,
  CASE WHEN l_linenumber < 4 THEN 1 WHEN l_linenumber < 6 THEN 0 END AS outcome FROM lineitem"""


def location_parse(spark, folder):
    t = Tables(spark, folder)
    cell = F.concat(F.when(F.col("c_nationkey") < 9, F.lit("tn")).otherwise(F.lit("Oak Hill")), F.lit(" "),
                    (F.col("c_custkey") + 45000).cast("string"), F.lit("\n(39."), (F.col("c_custkey") + 100).cast("string"),
                    F.lit(", -84."), (F.col("c_custkey") + 500).cast("string"), F.lit(")"))
    rows = t.customer.select("c_custkey", F.when(F.col("c_nationkey") != 24, cell).otherwise(F.lit("nowhere")).alias("location"))
    parts = text.split_location(F.col("location"), {"TN": "TOWN"})
    city = text.or_default(parts["city"], "TOWN")
    return rows.select("c_custkey", city.alias("city"), *[parts[k].alias(k) for k in ("zip", "delivered_latitude", "delivered_longitude")])


LOCATION_PARSE = """
SELECT c_custkey, CASE WHEN c_nationkey = 24 OR c_nationkey < 9 THEN 'TOWN' ELSE 'OAK HILL' END AS city,
  CASE WHEN c_nationkey <> 24 THEN (c_custkey + 45000)::VARCHAR END AS zip,
  CASE WHEN c_nationkey <> 24 THEN '39.' || (c_custkey + 100) END AS delivered_latitude,
  CASE WHEN c_nationkey <> 24 THEN '-84.' || (c_custkey + 500) END AS delivered_longitude FROM customer"""


def geocoder_lines(spark, folder):
    t = Tables(spark, folder)
    k = F.col("c_custkey").cast("string")
    line = F.concat(
        F.lit('"'), k, F.lit('","'), k, F.lit(' Elm St, Oak Hill,OH, "'), F.when(F.col("c_nationkey") % 2 == 0, F.concat(
            F.lit(',"Match","Exact","'), k, F.lit(" ELM ST, OAK HILL, OH, "), (F.col("c_custkey") + 45000).cast("string"),
            F.lit('","-84.'), k, F.lit(",39."), k, F.lit('","123","L"'))).otherwise(F.lit(',"No_Match"')))
    return files.parse_geocoder_lines(t.customer.select(line.alias("value")))


GEOCODER_LINES = """
SELECT c_custkey::VARCHAR AS id, c_custkey || ' Elm St,Oak Hill,OH,' AS raw_input, c_custkey || ' ELM ST' AS address, 'OAK HILL' AS city, 'OH' AS state, (c_custkey + 45000)::VARCHAR AS zip,
  CAST('-84.' || c_custkey AS DOUBLE) AS longitude, CAST('39.' || c_custkey AS DOUBLE) AS latitude FROM customer WHERE c_nationkey % 2 = 0"""


def coordinate_fallback(spark, folder):
    rows = Tables(spark, folder).part.select(
        "p_partkey", F.when(F.col("p_size") > 10, F.col("p_size")).alias("lat"),
        F.when(F.col("p_size") < 40, F.col("p_size") + 100).alias("lon"),
        F.when(F.col("p_size") % 2 == 0, F.lit(-1)).alias("lat2"), F.lit(-2).alias("lon2"))
    return files.fill_coordinates(rows, "lat", "lon", "lat2", "lon2").select("p_partkey", "lat", "lon")


COORDINATE_FALLBACK = """
WITH r AS (SELECT p_partkey, CASE WHEN p_size > 10 THEN p_size END AS lat, CASE WHEN p_size < 40 THEN p_size + 100 END AS lon,
  CASE WHEN p_size % 2 = 0 THEN -1 END AS lat2 FROM part),
s AS (SELECT p_partkey, CASE WHEN lat IS NULL OR lon IS NULL THEN lat2 ELSE lat END AS lat, lon FROM r)
SELECT p_partkey, lat, CASE WHEN lat IS NULL OR lon IS NULL THEN -2 ELSE lon END AS lon FROM s"""


def drifting_union(spark, folder):
    t = Tables(spark, folder)
    frames = [
        t.lineitem.where(F.col("l_shipdate") < F.lit("1997-01-01").cast("timestamp_ntz")).select(
            F.col("l_orderkey").alias("ID"), F.col("l_returnflag").alias("STREET_ADDRESS"), F.lit(1).alias("incident_guid")),
        t.lineitem.where(dates.from_year("l_shipdate", 1997) & ~dates.from_year("l_shipdate", 2001)).select(
            F.col("l_orderkey").alias("id"), F.col("l_linestatus").alias("address"), F.lit("ELSEWHERE").alias("City")),
        t.lineitem.where(dates.from_year("l_shipdate", 2001)).select(F.col("l_orderkey").alias("id"), F.lit("9").alias("zip")),
    ]
    return files.union_drifting(frames, {"street_address": "address"}, ["incident_guid"], {"city": "TOWN"})


DRIFTING_UNION = """
SELECT l_orderkey AS id, l_returnflag AS address, 'TOWN' AS city, NULL AS zip FROM lineitem WHERE year(l_shipdate) < 1997
UNION ALL SELECT l_orderkey, l_linestatus, 'ELSEWHERE', NULL FROM lineitem WHERE year(l_shipdate) BETWEEN 1997 AND 2000
UNION ALL SELECT l_orderkey, NULL, 'TOWN', '9' FROM lineitem WHERE year(l_shipdate) >= 2001"""


def joined_addresses(spark, folder):
    rows = Tables(spark, folder).supplier.select(
        "s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, F.col("s_suppkey").cast("string")).alias("number"),
        F.when(F.col("s_suppkey") % 3 == 0, F.lit("W")).alias("dir"), F.lower("s_name").alias("name"))
    return rows.select(
        "s_suppkey", text.joined_address(F.col("number"), F.col("dir"), F.col("name")).alias("address"),
        text.display_address(F.col("number"), F.col("dir"), F.lit("MAIN  street")).alias("shown"))


JOINED_ADDRESSES = """
WITH r AS (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey::VARCHAR END AS n, CASE WHEN s_suppkey % 3 = 0 THEN 'W' END AS d,
  lower(s_name) AS m FROM supplier)
SELECT s_suppkey, concat_ws(' ', n, d, m) AS address, coalesce(n, ' ') || ' ' || coalesce(d, ' ') || ' Main Street' AS shown FROM r"""


def part_times(spark, folder):
    rows = Tables(spark, folder).part.select(
        "p_partkey", F.lit("2014").alias("y"), (F.col("p_size") % 13 + 1).cast("string").alias("m"),
        (F.col("p_partkey") % 28 + 1).cast("string").alias("d"), (F.col("p_partkey") % 24).cast("string").alias("h"))
    return rows.select("p_partkey", dates.timestamp_from_parts("y", "m", "d", "h").alias("date"))


PART_TIMES = """
SELECT p_partkey, CASE WHEN p_size % 13 + 1 <= 12 THEN make_timestamp(2014, p_size % 13 + 1, p_partkey % 28 + 1, p_partkey % 24, 0, 0) END AS date
FROM part"""


def incremental_rows(spark, folder):
    t = Tables(spark, folder)
    loaded = t.events.where(F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz"))
    return increment.rows_after_mark(t.events, loaded, "ts").select("event_id", "ts", "event_type")


INCREMENTAL_ROWS = """
SELECT event_id, ts, event_type FROM events WHERE ts > (SELECT max(ts) FROM events WHERE ts < TIMESTAMP '2024-01-20')"""


def incremental_edges(spark, folder):
    t = Tables(spark, folder)
    marks = t.supplier.agg((F.max("s_suppkey") / 2).cast("long").alias("event_id")).withColumn("table_name", F.lit("address"))
    last = increment.read_mark(marks, "address")
    return rounded(increment.new_edges(t.parcels, t.addresses, "parcel_id", "address_id", 1000, last), ["dist_m"])


INCREMENTAL_EDGES = f"""
WITH {PARCELS}, {ADDRESSES} SELECT parcel_id, address_id,
  round(sqrt(CAST((p.x-a.x)*(p.x-a.x)+(p.y-a.y)*(p.y-a.y) AS DOUBLE))/3.281, 6) AS dist_m FROM parcels p
JOIN addresses a ON {near('p', 'a', 1000)} WHERE address_id > (SELECT max(s_suppkey) // 2 FROM supplier)"""


def moved_marks(spark, folder):
    t = Tables(spark, folder)
    marks = t.orders.groupBy(F.col("o_orderpriority").alias("table_name")).agg(F.min("o_orderkey").alias("event_id"))
    return increment.moved_mark(marks, "2-HIGH", t.orders, "o_orderkey")


MOVED_MARKS = """
SELECT o_orderpriority AS table_name, CASE WHEN o_orderpriority = '2-HIGH' THEN (SELECT max(o_orderkey) FROM orders)
  ELSE min(o_orderkey) END AS event_id FROM orders GROUP BY 1"""


def redelivered_rows(spark, folder):
    """Back-filled rows whose key has been loaded before are left out."""
    t = Tables(spark, folder)
    loaded = t.events.where("event_type <> 'view'")
    return not_loaded_before(t.events, loaded, ["user_id", "event_type"]).select("event_id", "user_id", "event_type")


REDELIVERED_ROWS = """
SELECT event_id, user_id, event_type FROM events WHERE event_type = 'view'"""


def null_share(spark, folder):
    return profile.null_shares(Tables(spark, folder).scored.select("doc_id", "score", "lang", "label", "toxic"))


NULL_SHARE = f"""
WITH {SCORED} {' UNION ALL '.join(f"SELECT '{c}' AS \"column\", avg(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS null_share FROM scored"
                                  for c in ("doc_id", "score", "lang", "label", "toxic"))}"""


def column_profile(spark, folder):
    out = profile.column_profile(Tables(spark, folder).scored, ["score", "label"], ["source", "lang"])
    return rounded(out, ["mean", "std", "missing"], 5)


def _profile_sql(c: str, numeric: bool) -> str:
    moments = (f"round(avg({c}), 5) AS mean, round(stddev_samp({c}), 5) AS std, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, "
               f"quantile_cont({c}, 0.25)::DOUBLE AS q25, quantile_cont({c}, 0.5)::DOUBLE AS q50, quantile_cont({c}, 0.75)::DOUBLE AS q75"
               if numeric else ", ".join(f"NULL::DOUBLE AS {n}" for n in ("mean", "std", "min", "max", "q25", "q50", "q75")))
    return f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END), 5) AS missing,
  count(DISTINCT {c}) AS "distinct", (SELECT {c}::VARCHAR FROM scored WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c}::VARCHAR LIMIT 1) AS top,
  (SELECT max(k) FROM (SELECT count(*) AS k FROM scored WHERE {c} IS NOT NULL GROUP BY {c})) AS freq, {moments} FROM scored"""


COLUMN_PROFILE = f"""
WITH {SCORED} {' UNION ALL '.join(_profile_sql(c, n) for c, n in (("score", True), ("label", True), ("source", False), ("lang", False)))}"""


def column_bounds(spark, folder):
    return profile.bounds(Tables(spark, folder).orders, "o_orderdate")


COLUMN_BOUNDS = "SELECT min(o_orderdate) AS low, max(o_orderdate) AS high FROM orders"


def surplus_rows(spark, folder):
    return profile.repeated_rows(Tables(spark, folder).lineitem.select("l_orderkey", "l_linenumber"))


SURPLUS_ROWS = "SELECT count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS duplicate_rows FROM lineitem"


QUERIES = {
    "fixed_width_parse": (fixed_width_parse, FIXED_WIDTH_PARSE),
    "clean_addresses": (clean_addresses, CLEAN_ADDRESSES),
    "parcel_id_normalize": (parcel_id_normalize, PARCEL_ID_NORMALIZE),
    "owner_entities": (owner_entities, OWNER_ENTITIES),
    "owner_tags": (owner_tags, OWNER_TAGS),
    "flags_and_fees": (flags_and_fees, FLAGS_AND_FEES),
    "location_parse": (location_parse, LOCATION_PARSE),
    "geocoder_lines": (geocoder_lines, GEOCODER_LINES),
    "coordinate_fallback": (coordinate_fallback, COORDINATE_FALLBACK),
    "drifting_union": (drifting_union, DRIFTING_UNION),
    "joined_addresses": (joined_addresses, JOINED_ADDRESSES),
    "part_times": (part_times, PART_TIMES),
    "incremental_rows": (incremental_rows, INCREMENTAL_ROWS),
    "incremental_edges": (incremental_edges, INCREMENTAL_EDGES),
    "moved_marks": (moved_marks, MOVED_MARKS),
    "redelivered_rows": (redelivered_rows, REDELIVERED_ROWS),
    "null_share": (null_share, NULL_SHARE),
    "column_profile": (column_profile, COLUMN_PROFILE),
    "column_bounds": (column_bounds, COLUMN_BOUNDS),
    "surplus_rows": (surplus_rows, SURPLUS_ROWS),
}
