"""Queries on ranks, top lists, row selection and overlap."""

from __future__ import annotations

from pyspark.sql import functions as F

from vicinity.operators import dedupe, order_stats
from vicinity.operators.overlap import list_overlap
from vicinity.plans import models, shortlist
from vicinity.queries.roles import INSPECTIONS, Tables, longs, rounded


def latest_interaction(spark, folder):
    rows = Tables(spark, folder).orders.select("o_custkey", "o_orderdate", "o_orderpriority", "o_orderkey")
    return dedupe.last_by(rows, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderpriority"), F.col("o_orderkey")])


LATEST_INTERACTION = """
SELECT o_custkey, o_orderdate, o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey
  ORDER BY o_orderdate DESC, o_orderpriority DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1"""


def one_inspection_per_parcel(spark, folder):
    rows = Tables(spark, folder).inspections.where(F.col("viol_outcome").isNotNull())
    return dedupe.one_inspection_per_entity(rows, "parcel_id", "inspection_date", "viol_outcome")


ONE_INSPECTION_PER_PARCEL = f"""
WITH {INSPECTIONS} SELECT parcel_id, min(inspection_date) AS inspection_date, CAST(sum(viol_outcome) AS BIGINT) AS viol_count,
  CASE WHEN sum(viol_outcome) > 0 THEN 1 ELSE 0 END AS viol_outcome FROM inspections WHERE viol_outcome IS NOT NULL GROUP BY 1"""


def inspection_results(spark, folder):
    return dedupe.inspection_results(Tables(spark, folder).inspections, "parcel_id", "inspection_date", "viol_outcome")


INSPECTION_RESULTS = f"""
WITH {INSPECTIONS}, s AS (SELECT parcel_id, inspection_date, max(CASE WHEN viol_outcome = 1 THEN 1 ELSE 0 END) AS y
  FROM inspections GROUP BY 1, 2)
SELECT parcel_id, CAST(sum(y) AS BIGINT) AS violations, CAST(sum(1 - y) AS BIGINT) AS non_violations,
  count(*) AS inspections FROM s GROUP BY 1"""


def percentile_of_score(spark, folder):
    rows = Tables(spark, folder).part.select("p_partkey", "p_size")
    return rounded(order_stats.percentile_of_score(rows, "p_size"), ["p_size_percentile"], 9)


PERCENTILE_OF_SCORE = """
SELECT a.p_partkey, a.p_size, round((lt + le + 1) * 50.0::DOUBLE / n, 9) AS p_size_percentile FROM part a
JOIN (SELECT p_size, sum(count(*)) OVER (ORDER BY p_size) - count(*) AS lt, sum(count(*)) OVER (ORDER BY p_size) AS le
      FROM part GROUP BY 1) b USING (p_size), (SELECT count(*)::DOUBLE AS n FROM part) c"""


def score_ranks(spark, folder):
    rows = Tables(spark, folder).lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    return order_stats.with_ranks(rows, ["l_extendedprice", "l_quantity"])


SCORE_RANKS = """
SELECT l_orderkey, l_linenumber, l_extendedprice, l_quantity, rank() OVER (ORDER BY l_extendedprice) AS l_extendedprice_rank,
  rank() OVER (ORDER BY l_quantity) AS l_quantity_rank FROM lineitem"""


def digitize_priority(spark, folder):
    t = Tables(spark, folder)
    scored = t.part.select("p_partkey", F.col("p_retailprice").alias("probability"))
    scored = scored.withColumn("probability_rank", shortlist.probability_rank(scored, "probability")) \
        .select("p_partkey", "probability_rank")
    owned = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(
        shortlist.owner_rank(F.count_if(F.col("l_quantity") > 40)).alias("targeting_rank"))
    out = shortlist.priorities(scored, owned, ["p_partkey"])
    return longs(out, ["probability_rank", "targeting_rank", "rank"])


DIGITIZE_PRIORITY = f"""
WITH e AS (SELECT quantile_cont(p_retailprice, [{', '.join(repr(p) for p in shortlist.PROBABILITY_STEPS)}]) AS q FROM part),
s AS (SELECT p_partkey, CAST(len(list_filter(q, lambda x: x <= p_retailprice)) AS BIGINT) AS p FROM part, e),
o AS (SELECT l_partkey AS p_partkey, count(CASE WHEN l_quantity > 40 THEN 1 END) AS c FROM lineitem GROUP BY 1),
t AS (SELECT p_partkey, CAST((c >= 1)::INT + (c >= 2)::INT + (c >= 5)::INT + (c >= 10)::INT AS BIGINT) AS t FROM o)
SELECT p_partkey, p AS probability_rank, coalesce(t, 1) AS targeting_rank, p * 4 + coalesce(t, 1) - 1 AS rank
FROM s LEFT JOIN t USING (p_partkey)"""


def top_percent(spark, folder):
    rows = Tables(spark, folder).orders.select("o_orderkey", "o_totalprice")
    return order_stats.top_percent(rows, "o_totalprice", "o_orderkey", 5)


TOP_PERCENT = """
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey
LIMIT (SELECT CAST(round_even(count(*) * 5 / 100.0, 0) AS BIGINT) FROM orders)"""


def top_share_ties(spark, folder):
    """A large share cut inside a run of equal scores, which takes the cut-off path."""
    rows = Tables(spark, folder).lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_quantity") \
        .distinct()
    return order_stats.top_percent(rows, "l_quantity", "id", 60)


TOP_SHARE_TIES = """
WITH r AS (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS id, l_quantity FROM lineitem)
SELECT id, l_quantity FROM (SELECT *, row_number() OVER (ORDER BY l_quantity DESC, id) AS rn FROM r)
WHERE rn <= (SELECT CAST(round_even(count(*) * 60 / 100.0, 0) AS BIGINT) FROM r)"""


def _scored_parts(t: Tables):
    return t.part.select("p_partkey", F.col("p_retailprice").alias("prediction"),
                         F.col("p_size").cast("double").alias("density"))


def top_k_subsets(spark, folder):
    return shortlist.top_subsets(_scored_parts(Tables(spark, folder)), "density", "prediction", "p_partkey", 150)


_SUBSETS = """s AS (SELECT p_partkey, p_retailprice AS prediction, CAST(p_size AS DOUBLE) AS density FROM part),
q AS (SELECT quantile_cont(density, 0.25) AS q1, quantile_cont(density, 0.5) AS q2 FROM s),
u AS (SELECT *, 'All Parcels' AS subset FROM s
  UNION ALL SELECT s.*, 'Below Insp. Density Median' FROM s, q WHERE density < q2
  UNION ALL SELECT s.*, 'Below Insp. Density First Quartile' FROM s, q WHERE density < q1),
top AS (SELECT p_partkey, prediction, density, subset FROM (SELECT *, row_number() OVER
  (PARTITION BY subset ORDER BY prediction DESC, p_partkey) AS rn FROM u) WHERE rn <= 150)"""
TOP_K_SUBSETS = f"WITH {_SUBSETS} SELECT * FROM top"


def inspection_list(spark, folder):
    t = Tables(spark, folder)
    top = top_k_subsets(spark, folder).withColumn("model_group", F.lit("1"))
    info = t.part.select("p_partkey", "p_brand", "p_type")
    return shortlist.inspection_list(top, info, "1", "Below Insp. Density Median", "p_partkey")


INSPECTION_LIST = f"""
WITH {_SUBSETS} SELECT p_partkey, prediction, density, subset, '1' AS model_group, p_brand, p_type
FROM top JOIN part USING (p_partkey) WHERE subset = 'Below Insp. Density Median'"""


def feature_crosstab(spark, folder):
    t = Tables(spark, folder)
    top = top_k_subsets(spark, folder).withColumn("model_group", F.lit("7")).select("p_partkey", "model_group", "subset")
    values = t.part.select("p_partkey", "p_size", F.round(F.col("p_retailprice") * 10).cast("long").alias("price"))
    return shortlist.feature_crosstab(top, values, ["p_size", "price"], "p_partkey")


FEATURE_CROSSTAB = f"""
WITH {_SUBSETS}, v AS (SELECT p_partkey, p_size, CAST(round(p_retailprice * 10) AS BIGINT) AS price FROM part),
m AS (SELECT '7' AS model_group, 'Model Top 5% Average' AS quantity, subset, avg(p_size) AS p_size, avg(price) AS price
      FROM top JOIN v USING (p_partkey) GROUP BY subset
      UNION ALL SELECT '1', 'All Parcel Average', 'All Parcels', avg(p_size), avg(price) FROM v)
SELECT model_group, quantity, subset, 'p_size' AS feature, p_size AS value FROM m
UNION ALL SELECT model_group, quantity, subset, 'price', price FROM m"""


def top_per_group(spark, folder):
    rows = Tables(spark, folder).part.select("p_brand", "p_partkey", "p_retailprice")
    return order_stats.top_per_group(rows, "p_brand", [F.col("p_retailprice").desc(), F.col("p_partkey")], 3)


TOP_PER_GROUP = """
SELECT p_brand, p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_brand
  ORDER BY p_retailprice DESC, p_partkey) AS rn FROM part) WHERE rn <= 3"""


def _runs(t: Tables):
    """A run log: every part is a run, its brand the experiment, its price the metric."""
    day = lambda n: F.date_add(F.lit("2014-01-01").cast("date"), n)
    return t.part.select(
        F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("run_id"), F.col("p_brand").alias("experiment"),
        F.col("p_type").alias("name"), (F.col("p_size") % 5).alias("depth"),
        F.col("p_retailprice").alias("prec_at_5"), day(F.lit(0)).alias("start_date"),
        day((F.col("p_size") * 7).cast("int")).alias("fake_today"))


_RUNS = """runs AS (SELECT lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS run_id, p_brand AS experiment, p_type AS name,
  p_size % 5 AS depth, p_retailprice AS prec_at_5, CAST(p_size * 7 AS INT) // 30 AS train_len FROM part)"""


def runs_top_n(spark, folder):
    return models.surplus_runs(_runs(Tables(spark, folder)), "prec_at_5", keep=5).select("experiment", "run_id")


RUNS_TOP_N = f"""
WITH {_RUNS} SELECT experiment, run_id FROM (SELECT *, row_number() OVER (PARTITION BY experiment
  ORDER BY prec_at_5 DESC, run_id) AS rn FROM runs) WHERE rn > 5"""


def best_runs(spark, folder):
    rows = _runs(Tables(spark, folder)).select("experiment", "run_id", "prec_at_5")
    return dedupe.first_by(rows, ["experiment"], [-F.col("prec_at_5"), F.col("run_id")])


BEST_RUNS = f"""
WITH {_RUNS} SELECT experiment, run_id, prec_at_5 FROM (SELECT *, row_number() OVER (PARTITION BY experiment
  ORDER BY prec_at_5 DESC, run_id) AS rn FROM runs) WHERE rn = 1"""


def model_groups(spark, folder):
    groups = models.model_groups(_runs(Tables(spark, folder)), ["name", "depth"])
    return longs(models.numbered_groups(groups), ["train_len"]).select("run_id", "train_len", "model_group")


MODEL_GROUPS = f"""
WITH {_RUNS}, g AS (SELECT name, depth, train_len, min(run_id) AS f FROM runs GROUP BY ALL),
n AS (SELECT *, row_number() OVER (ORDER BY f) AS model_group FROM g)
SELECT run_id, CAST(train_len AS BIGINT) AS train_len, model_group FROM runs JOIN n USING (name, depth, train_len)"""


def validation_table(spark, folder):
    t = Tables(spark, folder)
    ends = F.when(F.col("priority") < "3", F.lit("1998-07-01")).otherwise(F.lit("1999-07-01")).cast("timestamp_ntz")
    lists = order_stats.top_per_group(
        t.inspections.groupBy("priority", "parcel_id").agg(F.max("price").alias("prediction")), "priority",
        [F.col("prediction").desc(), F.col("parcel_id")], 200)
    lists = lists.withColumns({"end": ends, "start": ends - F.make_interval(months=F.lit(6))})
    return rounded(shortlist.validation_table(lists, t.inspections, "priority", "start", "end", 200),
                   ["validation_precision_at_k", "validation_labeled_percent"], 9)


VALIDATION_TABLE = f"""
WITH {INSPECTIONS}, b AS (SELECT priority, parcel_id, max(price) AS s FROM inspections GROUP BY 1, 2),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY priority ORDER BY s DESC, parcel_id) AS rn FROM b) WHERE rn <= 200),
w AS (SELECT *, CASE WHEN priority < '3' THEN TIMESTAMP '1998-07-01' ELSE TIMESTAMP '1999-07-01' END AS hi FROM top),
y AS (SELECT w.priority, w.parcel_id, CASE WHEN count(i.inspection_date) > 0 THEN
  CASE WHEN coalesce(sum(i.viol_outcome), 0) > 0 THEN 1 ELSE 0 END END AS y
  FROM w LEFT JOIN inspections i ON i.parcel_id = w.parcel_id AND i.inspection_date >= hi - INTERVAL 6 MONTH
   AND i.inspection_date <= hi GROUP BY 1, 2)
SELECT priority, round(coalesce(avg(y), 0), 9) AS validation_precision_at_k,
  round(100.0 * count(y) / 200, 9) AS validation_labeled_percent FROM y GROUP BY 1"""


def _lists(t: Tables):
    return order_stats.top_per_group(
        t.inspections.groupBy("priority", "parcel_id").agg(F.max("price").alias("s")), "priority",
        [F.col("s").desc(), F.col("parcel_id")], 100)


_LISTS = f"""{INSPECTIONS}, b AS (SELECT priority, parcel_id, max(price) AS s FROM inspections GROUP BY 1, 2),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY priority ORDER BY s DESC, parcel_id) AS rn FROM b) WHERE rn <= 100),
sz AS (SELECT priority, count(*) AS n FROM top GROUP BY 1),
pr AS (SELECT a.priority AS list_a, c.priority AS list_b, count(*) AS shared FROM top a JOIN top c USING (parcel_id) GROUP BY 1, 2),
g AS (SELECT a.priority AS list_a, c.priority AS list_b, a.n AS na, c.n AS nb, coalesce(shared, 0) AS shared
  FROM sz a CROSS JOIN sz c LEFT JOIN pr ON pr.list_a = a.priority AND pr.list_b = c.priority)"""


def list_overlap_share(spark, folder):
    return list_overlap(_lists(Tables(spark, folder)), "priority", "parcel_id")


LIST_OVERLAP_SHARE = f"""
WITH {_LISTS} SELECT list_a, list_b, shared, shared / CASE WHEN list_a <= list_b THEN na ELSE nb END AS similarity FROM g"""


def list_overlap_jaccard(spark, folder):
    return list_overlap(_lists(Tables(spark, folder)), "priority", "parcel_id", jaccard=True)


LIST_OVERLAP_JACCARD = f"WITH {_LISTS} SELECT list_a, list_b, shared, shared / (na + nb - shared) AS similarity FROM g"


# --- row selection -----------------------------------------------------------------

def drop_all_repeats(spark, folder):
    rows = Tables(spark, folder).lineitem.select("l_orderkey", "l_linenumber", "l_partkey")
    return dedupe.only_unrepeated(rows, ["l_orderkey", "l_linenumber"])


DROP_ALL_REPEATS = """
SELECT l_orderkey, l_linenumber, max(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2 HAVING count(*) = 1"""


def drop_lowest_repeat(spark, folder):
    rows = Tables(spark, folder).orders.select("o_custkey", "o_orderkey")
    return dedupe.drop_lowest_of_repeated(rows, "o_custkey", "o_orderkey")


DROP_LOWEST_REPEAT = """
SELECT o_custkey, o_orderkey FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n,
  min(o_orderkey) OVER (PARTITION BY o_custkey) AS lo FROM orders) WHERE NOT (n > 1 AND o_orderkey = lo)"""


def repeated_keys(spark, folder):
    return dedupe.repeated_keys(Tables(spark, folder).lineitem, ["l_orderkey", "l_linenumber"])


REPEATED_KEYS = "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1"


def fixed_order_pick(spark, folder):
    """One row per key in a stated order, where any row would do."""
    rows = Tables(spark, folder).lineitem.select("l_orderkey", "l_suppkey", "l_partkey")
    return dedupe.first_by(rows, ["l_orderkey"], [F.col("l_suppkey"), F.col("l_partkey")])


FIXED_ORDER_PICK = """
SELECT l_orderkey, l_suppkey, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey
  ORDER BY l_suppkey, l_partkey) AS rn FROM lineitem) WHERE rn = 1"""


def address_canonical(spark, folder):
    t = Tables(spark, folder)
    part = lambda df, key: df.select(F.concat(F.lit("lot "), (F.col(key) % 977).cast("string")).alias("address"),
                                                       F.col(key).alias("id"))
    return dedupe.by_priority([
        part(t.orders, "o_orderkey"), part(t.part, "p_partkey"),
        part(t.customer, "c_custkey")], ["address"], "id")


ADDRESS_CANONICAL = """
WITH u AS (SELECT 'lot ' || (o_orderkey % 977) AS address, o_orderkey AS id, 0 AS s FROM orders
  UNION ALL SELECT 'lot ' || (p_partkey % 977), p_partkey, 1 FROM part
  UNION ALL SELECT 'lot ' || (c_custkey % 977), c_custkey, 2 FROM customer)
SELECT address, id FROM (SELECT *, row_number() OVER (PARTITION BY address ORDER BY s, id) AS rn FROM u) WHERE rn = 1"""


def anti_new_addresses(spark, folder):
    t = Tables(spark, folder)
    known = t.orders.select(F.when(F.col("o_orderstatus") == "F", F.col("o_custkey")).alias("c_custkey"))
    return dedupe.not_yet_known(t.customer.select("c_custkey", "c_name"), known, ["c_custkey"])


ANTI_NEW_ADDRESSES = """
SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')"""


def address_backfill(spark, folder):
    t = Tables(spark, folder)
    rows = t.orders.select("o_orderkey", F.col("o_custkey").alias("k"),
                           F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey")).alias("address_id"))
    lookup = t.customer.select(F.col("c_custkey").alias("k"), F.when(F.col("c_acctbal") > 0, -F.col("c_custkey")).alias("address_id"))
    return dedupe.backfill(rows, lookup, ["k"], "address_id").withColumn("address_id", F.coalesce("address_id", F.lit(0)))


ADDRESS_BACKFILL = """
SELECT o_orderkey, o_custkey AS k, coalesce(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END, CASE WHEN c_acctbal > 0 THEN -c_custkey END, 0) AS address_id
FROM orders LEFT JOIN customer ON c_custkey = o_custkey"""


def surrogate_keys(spark, folder):
    t = Tables(spark, folder)
    new = t.orders.select("o_orderkey")
    return order_stats.continue_keys(new, t.customer, "c_custkey", [F.col("o_orderkey")]) \
        .select("o_orderkey", F.col("c_custkey").alias("address_id"))


SURROGATE_KEYS = """
SELECT o_orderkey, (SELECT max(c_custkey) FROM customer) + row_number() OVER (ORDER BY o_orderkey) AS address_id
FROM orders"""


def runs_by_setting(spark, folder):
    runs = _runs(Tables(spark, folder)).select("run_id", "name", "depth")
    return dedupe.groups_of(runs, F.concat_ws("/", "name", "depth")).select("run_id", "group", "group_size")


RUNS_BY_SETTING = f"""
WITH {_RUNS} SELECT run_id, name || '/' || depth AS "group", count(*) OVER (PARTITION BY name, depth) AS group_size FROM runs"""


QUERIES = {
    "latest_interaction": (latest_interaction, LATEST_INTERACTION),
    "one_inspection_per_parcel": (one_inspection_per_parcel, ONE_INSPECTION_PER_PARCEL),
    "inspection_results": (inspection_results, INSPECTION_RESULTS),
    "percentile_of_score": (percentile_of_score, PERCENTILE_OF_SCORE),
    "score_ranks": (score_ranks, SCORE_RANKS),
    "digitize_priority": (digitize_priority, DIGITIZE_PRIORITY),
    "top_percent": (top_percent, TOP_PERCENT),
    "top_share_ties": (top_share_ties, TOP_SHARE_TIES),
    "top_k_subsets": (top_k_subsets, TOP_K_SUBSETS),
    "inspection_list": (inspection_list, INSPECTION_LIST),
    "feature_crosstab": (feature_crosstab, FEATURE_CROSSTAB),
    "top_per_group": (top_per_group, TOP_PER_GROUP),
    "runs_top_n": (runs_top_n, RUNS_TOP_N),
    "best_runs": (best_runs, BEST_RUNS),
    "model_groups": (model_groups, MODEL_GROUPS),
    "validation_table": (validation_table, VALIDATION_TABLE),
    "list_overlap": (list_overlap_share, LIST_OVERLAP_SHARE),
    "list_overlap_jaccard": (list_overlap_jaccard, LIST_OVERLAP_JACCARD),
    "drop_all_repeats": (drop_all_repeats, DROP_ALL_REPEATS),
    "drop_lowest_repeat": (drop_lowest_repeat, DROP_LOWEST_REPEAT),
    "repeated_keys": (repeated_keys, REPEATED_KEYS),
    "fixed_order_pick": (fixed_order_pick, FIXED_ORDER_PICK),
    "address_canonical": (address_canonical, ADDRESS_CANONICAL),
    "anti_new_addresses": (anti_new_addresses, ANTI_NEW_ADDRESSES),
    "address_backfill": (address_backfill, ADDRESS_BACKFILL),
    "surrogate_keys": (surrogate_keys, SURROGATE_KEYS),
    "runs_by_setting": (runs_by_setting, RUNS_BY_SETTING),
}
