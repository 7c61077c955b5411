from datetime import datetime

import pytest
from pyspark.sql import functions as F

from vicinity.functions import geo
from vicinity.operators import spatial
from vicinity.plans import census, dataset, features, models, population, shortlist
from vicinity.plans.features import Context


# --- data sets --------------------------------------------------------------------

@pytest.mark.parametrize("day,window,end", [
    ("31Dec2013", "6Month", datetime(2014, 6, 30)), ("15Jan2014", "1Month", datetime(2014, 2, 28)),
    ("30Jun2014", "30Day", datetime(2014, 7, 30))])
def test_window_end(day, window, end):
    assert dataset.window_end(dataset.parse_day(day), window) == end


def test_split_errors():
    last = datetime(2015, 1, 1)
    ok = {"fake_today": "30Jun2014", "validation_window": "6Month"}
    assert dataset.temporal_split(ok, last) == dataset.Split(datetime(1970, 1, 1), datetime(2014, 6, 30), datetime(2014, 12, 31))
    for bad in ({"validation_window": "1Year"}, {"fake_today": "31Dec2014"}, {"start_date": "01Jan2016"}, {"validation_window": "x"}):
        with pytest.raises(ValueError):
            dataset.temporal_split({**ok, **bad}, last)


def test_assemble_groups_tables_and_fills(spark):
    d = datetime(2015, 1, 1)
    labels = spark.createDataFrame([(1, d, 1), (2, d, 0), (3, d, None)], "parcel_id int, inspection_date timestamp_ntz, viol_outcome int")
    crime = spark.createDataFrame([(1, d, 4, 1.0), (1, d, 4, 1.0), (2, d, 8, 3.0)],
                                  "parcel_id int, inspection_date timestamp_ntz, total int, avg_x double")
    size = spark.createDataFrame([(3, 7)], "parcel_id int, area int")
    out = dataset.assemble(labels, {"crime": crime, "size": size}, [("crime", "total"), ("size", "area"), ("crime", "avg_x")])
    got = {r["parcel_id"]: (r["crime_total"], r["crime_avg_x"], r["size_area"]) for r in out.collect()}
    assert got == {1: (4.0, 1.0, 7.0), 2: (8.0, 3.0, 7.0), 3: (6.0, 2.0, 7.0)}
    with pytest.raises(ValueError, match="unknown"):
        dataset.assemble(labels, {"size": size}, [("size", "nothing")])


def test_many_buckets_are_read_by_few_tasks(spark):
    """A pass over assembled rows has as many tasks as a shuffle, however many buckets they came from."""
    keys = spark.range(0, 64, 1, 32).selectExpr("id AS parcel_id", "timestamp_ntz '2015-01-01' AS inspection_date", "1 AS viol_outcome")
    size = spark.range(1, 4).selectExpr("id AS parcel_id", "CASE id WHEN 1 THEN 4 WHEN 2 THEN 8 ELSE 6 END AS area")
    out = dataset.assemble(keys, {"size": size}, [("size", "area")])
    assert out.rdd.getNumPartitions() <= int(spark.conf.get("spark.sql.shuffle.partitions")) < 32
    got = {r["parcel_id"]: r["size_area"] for r in out.collect()}
    assert got == {i: {1: 4.0, 2: 8.0}.get(i, 6.0) for i in range(64)}


def test_fits_have_no_more_tasks_than_keep_the_cores_busy(spark, monkeypatch):
    monkeypatch.setattr(models, "ROWS_PER_TASK", 10)
    rows = spark.range(0, 1200, 1, 60).selectExpr("CAST(id % 7 AS DOUBLE) AS x", "CAST(id % 2 AS INT) AS viol_outcome")
    busy = 3 * spark.sparkContext.defaultParallelism
    ready = models.prepared(rows, ["x"])
    assert (ready.count, ready.rows.rdd.getNumPartitions()) == (1200, busy) and busy < 60
    monkeypatch.setattr(models, "NUMBERS_PER_TASK", 50)
    assert models.prepared(rows, ["x"]).rows.rdd.getNumPartitions() == 24


def test_labels_read_the_events_once(spark):
    """A case's outcome is told where its events lie, not by a second reading of them and a join."""
    events = spark.createDataFrame([(1, "CBHCODE", datetime(2015, 1, 1), "Initial inspection"), (1, "CBHCODE", datetime(2015, 2, 1), "Civil 1"),
                                    (2, "CBHCODE", datetime(2015, 3, 1), "Civil 2"), (None, "CBHCODE", datetime(2015, 3, 1), "Civil 2")],
                                   "number_key long, comp_type string, date timestamp_ntz, event string")
    cases = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (None, "c")], "number_key long, parcel_no string")
    out = population.labels_from_events(events, cases)
    assert sorted(tuple(r) for r in out.collect()) == [("a", datetime(2015, 1, 1), 1), ("b", datetime(2015, 3, 1), 1)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def test_labels_drop_conflicts(spark):
    d = lambda n: datetime(2015, 1, n)
    rows = [("k1", "CBHCODE", d(1), "Initial inspection"), ("k1", "CBHCODE", d(5), "Civil 1"),
            ("k2", "CBHCODE", d(1), "Initial inspection"), ("k3", "CBHCODE", d(2), "Orders issued"),
            ("k4", "LTTR-PR", d(3), "Initial inspection"), ("k5", "CBHCODE", d(1), "Initial inspection"),
            ("k6", "CBHCODE", d(1), "Initial inspection"), ("k7", "CBHCODE", d(4), "Reported")]
    events = spark.createDataFrame(rows, "number_key string, comp_type string, date timestamp_ntz, event string")
    cases = spark.createDataFrame([("k1", "p1"), ("k2", "p2"), ("k3", "p3"), ("k4", "p4"), ("k5", "p1"), ("k6", "p2"), ("k7", "p7")],
                                  "number_key string, parcel_no string")
    got = sorted(tuple(r) for r in population.labels_from_events(events, cases).collect())
    assert got == [("p2", d(1), 0), ("p3", d(2), 1)]      # p1 has both outcomes on one day


# --- features ---------------------------------------------------------------------

def test_registry_runs_end_to_end(spark):
    from vicinity.sources.store import FeatureStore
    d = datetime(2015, 6, 1)
    people = spark.createDataFrame([("p1", d), ("p2", d)], "parcel_id string, inspection_date timestamp_ntz")
    parcels = spark.createDataFrame([("p1", 0, 0, 510, 9.0), ("p2", 50, 0, 423, 4.0)],
                                    "parcel_id string, x long, y long, class int, area double")
    crime = spark.createDataFrame([(1, datetime(2015, 5, 1), "x (theft) y", 1), (2, datetime(2015, 5, 2), None, 1),
                                   (3, datetime(2014, 1, 1), "x (arson) y", 2), (4, datetime(2016, 1, 1), "q", 2)],
                                  "id int, occurred_on timestamp_ntz, orc string, address_id int")
    events = spark.createDataFrame([("p2", datetime(2015, 5, 5), "Civil 1"), ("p1", datetime(2014, 1, 5), None),
                                    ("p1", datetime(2016, 1, 5), None)], "parcel_id string, date timestamp_ntz, event string")
    edges = spark.createDataFrame([("p1", 1, 30.0), ("p2", 2, 90.0)], "parcel_id string, address_id int, dist_m double")
    weather = spark.createDataFrame([(datetime(2015, 5, 20), 10, 2, 1000, 0)],
                                    "date timestamp_ntz, air_temp int, wind_speed_rate int, sea_level_pressure int, "
                                    "liquid_precipitation_depth_dimension_one_hour int")
    ctx = Context(people, {"crime": crime, "parcels": parcels, "events_parcel": events, "weather": weather}, edges, months=3, metres=100)
    store = FeatureStore(spark, "features_t")
    names = features.generate(store, ctx, ["crime", "density", "sixweeksweather", "house_type", "parc_area", "quarter"])
    assert names == ["crime_100m_3months", "density_100m_3months", "sixweeksweather", "house_type", "parc_area", "quarter"]
    c = store.read("crime_100m_3months").first()
    assert (c["parcel_id"], c["total"], c["orc_combined_theft"], c["orc_combined_missing"], c["orc_combined_arson"]) == ("p1", 2, 1, 1, 0)
    k = {r["parcel_id"]: r for r in store.read("density_100m_3months").collect()}
    assert k["p1"]["civil_1"] == 1 and k["p1"]["civil_1_per_houses"] == pytest.approx(2 / 6)
    assert {r["parcel_id"]: r["mixed-use"] for r in store.read("house_type").collect()} == {"p1": 0, "p2": 1}
    assert {r["q2"] for r in store.read("quarter").collect()} == {1}
    full = features.crime(Context(people, {"crime": crime}, edges, months=3, metres=100, empty="zero"))
    assert {r["parcel_id"]: r["total"] for r in full.collect()} == {"p1": 2, "p2": 0}


def test_clear_minutes(spark):
    df = spark.createDataFrame([(datetime(2015, 1, 1), datetime(2015, 1, 1, 0, 1, 59, 600000)), (datetime(2015, 1, 1), datetime(2015, 1, 1, 0, 1, 59)),
                                (datetime(2015, 1, 1, 0, 1, 30), datetime(2015, 1, 1))], "a timestamp_ntz, b timestamp_ntz")
    assert [r[0] for r in df.select(features.clear_minutes("b", "a")).collect()] == [2, 1, -1]


def test_census_has_both_sexes_over_75(spark):
    names = {c for parts, whole in census.RATIOS.values() for c in [*parts, whole]} - {"area"}
    blocks = spark.createDataFrame([("t", "1", *map(float, range(1, len(names) + 1)))],
                                   "tract string, block_group string, " + ", ".join(f"{c} double" for c in sorted(names)))
    areas = spark.createDataFrame([("t", "1", 2.0)], "tract string, block_group string, area double")
    out = census.census_features(blocks, areas)
    assert len(out.columns) == 2 + 53
    r, v = out.first(), {c: i for i, c in enumerate(sorted(names), 1)}
    assert r["rate_male_over_75"] != r["rate_female_over_75"]
    assert r["population_density"] == v["P0010001"] / 2.0


# --- lists ------------------------------------------------------------------------

def test_priorities(spark):
    p = spark.createDataFrame([(1, 3), (2, 0)], "k int, probability_rank int")
    t = spark.createDataFrame([(1, 4), (9, 2)], "k int, targeting_rank int")
    assert sorted((r["k"], r["rank"]) for r in shortlist.priorities(p, t, ["k"]).collect()) == [(1, 15), (2, 0)]


def test_experiment_matrix(spark):
    df = shortlist.experiment_matrix(spark, [("01Jan2012", "31Dec2013"), ("01Jan2012", "30Jun2014")], ["6Month"],
                                     [400, 700], [3, 6], ["crime", "fire"], ["tax.%"])
    assert df.count() == 2 * (1 + 2 * 4 * 2)
    upto = df.where("feature_set = 'upto_700m_3months'").first()["features"]
    assert upto == ["tax.%", "crime_400m_3months.%", "crime_700m_3months.%", "fire_400m_3months.%", "fire_700m_3months.%"]


# --- models -----------------------------------------------------------------------

def test_grid_sizes():
    count = {(s, m): len(models.runs_for([m], s)) for s, g in models.GRIDS.items() for m in g}
    assert (count["big", "RandomForestClassifier"], count["medium", "GradientBoostingClassifier"], count["small", "LogisticRegression"]) == (288, 108, 6)
    assert models.runs_for([{"x.SVC": {"C": [1, 2]}}]) == [("SVC", {"C": 1}), ("SVC", {"C": 2})]


@pytest.fixture(scope="module")
def separable(spark):
    rows = [(i, float(i % 2), float(i % 2) * 3 + (i % 7) / 7, float(i % 5) if i % 4 else None) for i in range(200)]
    return spark.createDataFrame(rows, "parcel_id long, viol_outcome double, a double, b double")


@pytest.mark.parametrize("name,params", [
    ("RandomForestClassifier", {"n_estimators": 5, "criterion": "entropy", "max_features": "sqrt"}),
    ("GradientBoostingClassifier", {"n_estimators": 3, "learning_rate": 0.1}),
    ("LogisticRegression", {"penalty": "l1", "C": 1}), ("LogisticRegression", {"penalty": "l2", "C": 0.1}),
    ("SVC", {"C": 0.1, "kernel": "linear"}),
    ("AdaBoostClassifier", {"algorithm": "SAMME", "n_estimators": 2}), ("AdaBoostClassifier", {"algorithm": "SAMME.R", "n_estimators": 2})])
def test_every_model_ranks(spark, separable, name, params):
    from vicinity.operators.evaluate import roc_auc
    fitted = models.fit(separable, ["a", "b"], name, params)
    scored = models.score(fitted, separable, ["a", "b"], ["parcel_id", "viol_outcome"])
    assert roc_auc(scored, "viol_outcome", "prediction").first()[0] == 1.0
    top = models.importances(spark, fitted[1], ["a", "b"]).first()
    assert top["feature"] == "a"


def test_stored_preparation_scales_by_population(spark, separable, tmp_path):
    prep = models.prepare(separable, ["a", "b"])
    models.save(prep, str(tmp_path / "prep"))
    from pyspark.ml import PipelineModel
    from pyspark.ml.functions import vector_to_array
    out = PipelineModel.load(str(tmp_path / "prep")).transform(separable)
    assert out.select(F.stddev_pop(vector_to_array("features")[0])).first()[0] == pytest.approx(1.0)


def test_run_log(spark, separable, tmp_path):
    scored = separable.select("viol_outcome", F.col("a").alias("prediction"))
    path = str(tmp_path / "runs")
    for i, exp in enumerate(["e1", "e1", "e2"]):
        models.log_run(models.run_row(spark, f"r{i}", exp, "svc", {"C": i}, {"fake_today": "31Dec2013", "db": {"x": 1}}, scored), path)
    runs = spark.read.parquet(path)
    assert models.run_exists(runs, "e1") and not models.run_exists(runs, "e9")
    assert models.best_run(runs, "e1", "prec_at_5").first()["run_id"] == "r0"
    assert models.without_experiment(runs, "e1").count() == 1
    assert [r["run_id"] for r in models.surplus_runs(runs, "prec_at_5", keep=1).collect()] == ["r1"]
    assert models.flatten({"a": {"b": 1, "c": {"d": 2}}}) == {"a.b": 1, "a.c.d": 2}
    with pytest.raises(ValueError):
        models.flatten({"a.b": 1})


def test_shifted_window():
    d = datetime
    assert models.shifted_window(d(2012, 1, 1), d(2013, 1, 1), d(2016, 8, 30)) == (d(2015, 8, 30), d(2016, 8, 30))


# --- geometry ---------------------------------------------------------------------

SHAPES = {"square": [(0, 0), (10, 0), (10, 10), (0, 10)], "hook": [(0, 0), (10, 0), (10, 2), (2, 2), (2, 10), (0, 10)],
          "far": [(5, 5), (30, 5), (30, 8), (5, 8)]}


def ring_frame(spark, *names):
    rows = [(n, [(float(x), float(y)) for x, y in SHAPES[n]]) for n in names]
    return spark.createDataFrame(rows, "name string, ring array<struct<x:double,y:double>>")


def test_ring_measures(spark):
    df = ring_frame(spark, "square", "hook").select(
        "name", geo.area(F.col("ring")), geo.perimeter(F.col("ring")), geo.centroid(F.col("ring")).getField("x"))
    assert {r[0]: tuple(r)[1:] for r in df.collect()} == {
        "square": (100.0, 40.0, 5.0), "hook": (36.0, 40.0, pytest.approx((20 * 5 + 16 * 1) / 36))}


def test_points_in_a_concave_ring(spark):
    pts = spark.createDataFrame([(i, x + 0.5, y + 0.5) for i, (x, y) in enumerate((x, y) for x in range(-1, 12) for y in range(-1, 12))],
                                "id int, x double, y double")
    for cell in (3, 100):
        found = {(r["x"], r["y"]) for r in spatial.points_in_polygons(pts, ring_frame(spark, "hook"), ["name"], cell).collect()}
        want = {(x + 0.5, y + 0.5) for x in range(10) for y in range(10) if y < 2 or x < 2}
        assert found == want


def test_shared_areas(spark):
    a = ring_frame(spark, "square", "hook", "far")
    b = a.withColumnRenamed("name", "other")
    for cell in (4, 1000):
        got = {(r["name"], r["other"]): r["overlap_area"] for r in spatial.polygon_overlaps(a, b, ["name"], ["other"], cell).collect()}
        assert got == {("square", "square"): pytest.approx(100), ("hook", "hook"): pytest.approx(36), ("far", "far"): pytest.approx(75),
                       ("square", "hook"): pytest.approx(36), ("hook", "square"): pytest.approx(36),
                       ("square", "far"): pytest.approx(15), ("far", "square"): pytest.approx(15)}
    inner = spatial.polygons_within(a, b, ["name"], ["other"], 4).where("name <> other").collect()
    assert [(r["name"], r["other"]) for r in inner] == [("hook", "square")]


def test_distance_to_a_ring(spark):
    pts = spark.createDataFrame([(1, 5.0, 5.0), (2, 13.0, 14.0), (3, 5.0, -6.562)], "id int, x double, y double")
    got = {r["id"]: r["dist_m"] for r in spatial.polygon_point_edges(ring_frame(spark, "square"), pts, "name", "id", 2).collect()}
    assert got == {1: 0.0, 2: pytest.approx(5 / 3.281), 3: pytest.approx(2.0)}


def test_plane_projection_against_the_zone_origin(spark):
    df = spark.createDataFrame([(-82.5, 38.0)], "lon double, lat double").select(geo.to_plane(F.col("lon"), F.col("lat")).alias("p"))
    p = df.first()["p"]
    assert (p["x"], p["y"]) == (pytest.approx(1968500.0, abs=1e-3), pytest.approx(0.0, abs=1e-3))


def test_forests_keep_small_nodes_whole(spark):
    """No node with fewer rows than asked is split, and what lies above such nodes is as it was."""
    rows = spark.range(400).select((F.col("id") % 7).cast("double").alias("a"), ((F.col("id") * 13) % 11).cast("double").alias("b"),
                                   ((F.col("id") % 7 + F.col("id") % 3) > 5).cast("int").alias("viol_outcome"))
    ready = models.prepared(rows, ["a", "b"])
    runs = [("RandomForestClassifier", {"n_estimators": 4, "max_depth": 6, "min_samples_split": n}) for n in (2, 60, 10_000)]
    grown, cut, roots = models.fit_many(ready, runs, seed=5, side_by_side=3)

    def nodes(node, count):
        yield node.numDescendants(), count(node)
        if node.numDescendants():
            yield from nodes(node.leftChild(), count)
            yield from nodes(node.rightChild(), count)

    count = lambda node: sum(node.impurityStats().stats())
    for whole, part, root in zip(*([t._call_java("rootNode") for t in m.trees] for m in (grown, cut, roots))):
        assert root.numDescendants() == 0
        assert all(n >= 60 for inner, n in nodes(part, count) if inner)
        assert sum(1 for inner, n in nodes(part, count) if inner) == sum(1 for inner, n in nodes(whole, count) if inner and n >= 60)
    scores = [models.score_features(m, ready.rows, ["label"]).agg(F.avg("prediction")).first()[0] for m in (grown, cut)]
    assert 0 < scores[0] < 1 and abs(scores[0] - scores[1]) < 0.2


def test_svm_gives_chances(spark):
    rows = spark.range(300).select((F.col("id") % 50).cast("double").alias("a"), F.when(F.col("id") % 50 + F.col("id") % 9 > 28, 1).otherwise(0).alias("viol_outcome"))
    fitted = models.fit(rows, ["a"], "SVC", {"C": 1.0})
    scored = models.score(fitted, rows, ["a"], ["a", "viol_outcome"]).collect()
    assert all(0 <= r["prediction"] <= 1 for r in scored)
    mean = lambda y: [r["prediction"] for r in scored if r["viol_outcome"] == y]
    assert sum(mean(1)) / len(mean(1)) > 0.8 and sum(mean(0)) / len(mean(0)) < 0.2
    alone = models.fit(rows.where("viol_outcome = 1").limit(30).unionByName(rows.where("viol_outcome = 0").limit(1)), ["a"], "SVC", {"C": 1.0})
    assert alone[1].slope is None


def test_runs_are_logged_as_they_are_run():
    deep = [("RandomForestClassifier", {"max_depth": d, "min_samples_split": m}) for d in (20, 50, 100) for m in (2, 5)]
    assert models.runnable(deep) == [("RandomForestClassifier", {"max_depth": d, "min_samples_split": m}) for d in (20, 30) for m in (2, 5)]
    with pytest.raises(ValueError):
        models.estimator("RandomForestClassifier", {"max_depth": 50}, 10)
    assert models.estimator("RandomForestClassifier", {}, 10).getMaxDepth() == 30
