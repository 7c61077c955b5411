"""Cleaning expressions, dummies, imputation and scaling on small frames."""

import pytest
from pyspark.sql import functions as F

from vicinity.functions import text
from vicinity.operators import impute, levels, panel, pivot


def one(spark, column, **values):
    row = [tuple(values.values())]
    types = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'int'}" for k, v in values.items())
    return spark.createDataFrame(row, types).select(column).first()[0]


@pytest.mark.parametrize("value,want", [("123", "0        123"), ("1234567890123", "012345678901")])
def test_wide_parcel_id(spark, value, want):
    assert one(spark, text.wide_parcel_id(F.col("v")), v=value) == want


@pytest.mark.parametrize("value,want", [("12", "000000000012"), ("1234567890123", "1234567890123")])
def test_zero_padding_keeps_long_text(spark, value, want):
    assert one(spark, text.zero_padded(F.col("v")), v=value) == want


@pytest.mark.parametrize("value,want", [("$12.50", 12.5), ("$x", None), (None, None)])
def test_fee(spark, value, want):
    assert one(spark, text.fee_amount(F.col("v")), v=value) == want


@pytest.mark.parametrize("tags,want", [(["O", "ORG", "ORG"], "ORG"), (["ORG"], None), (["ORG", "PER"], None), ([], None)])
def test_unified_tags(spark, tags, want):
    df = spark.createDataFrame([(tags,)], "t array<string>")
    assert df.select(text.unify_tags(F.col("t"))).first()[0] == want


def test_location_cells(spark):
    cell = "CTY 45211\n(39.152816063000046, -84.60056918599997)"
    df = spark.createDataFrame([(cell,), ("unknown",), (None,)], "c string")
    got = [tuple(r) for r in df.select(*[c.alias(n) for n, c in text.split_location(F.col("c"), {"CTY": "CITY"}).items()]).collect()]
    assert got == [("45211", "CITY", "39.152816063000046", "-84.60056918599997"), (None,) * 4, (None,) * 4]


def test_joined_address_skips_missing(spark):
    df = spark.createDataFrame([("12", None, "MAIN"), (None, "W", ""), (None, None, None)], "n string, d string, m string")
    got = [r[0] for r in df.select(text.joined_address(F.col("n"), F.col("d"), F.col("m"))).collect()]
    assert got == ["12 MAIN", "W", ""]


def test_dummies(spark):
    df = spark.createDataFrame([("val1",), ("val3",), (None,)], "v string")
    wide = levels.fixed_dummies(df, "v", ["val1", "val2", "val3"])
    assert [tuple(r)[1:] for r in wide.collect()] == [(1, 0, 0), (0, 0, 1), (None, None, None)]
    assert levels.fixed_dummies(df.limit(0), "v", ["val1"]).columns == ["v", "val1"]
    with pytest.raises(Exception, match="outside the domain"):
        levels.fixed_dummies(df, "v", ["val1"]).collect()


def test_levels_with_ties_missing_and_rest(spark):
    df = spark.createDataFrame([(v,) for v in ["b", "b", "a", "a", "c", None]], "v string")
    assert levels.top_levels(df, {"x": levels.level_of("v")}, 3) == {"x": (["a", "b", "c"], True)}
    assert levels.top_levels(df, {"x": levels.level_of("v")}, 4) == {"x": (["a", "b", "c", "missing"], False)}
    names = [m.name for m in pivot.level_measures(df, {"x": levels.level_of("v")}, 2)]
    assert names == ["x_a", "x_b", "x_other"]


def test_general_pivot_refuses_repeated_cells(spark):
    df = spark.createDataFrame([(1, "a", 5), (1, "b", 6), (2, "a", 7)], "k int, c string, v int")
    assert sorted(tuple(r) for r in pivot.general_pivot(df, ["k"], ["c"], "v", default=0).collect()) == [(1, 5, 6), (2, 7, 0)]
    with pytest.raises(Exception, match="several rows"):
        pivot.general_pivot(df.unionByName(df), ["k"], ["c"], "v").collect()


def test_names():
    assert pivot.clean_name("Incident Type: A/B") == "incident_type_ab"
    assert pivot.plain_name("A--b C", "p") == "p_a_b_c"


def test_mean_fill(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("b", None, None), ("c", 3.0, None), ("d", float("inf"), None), ("e", float("nan"), None)],
                               "key string, original double, empty double")
    got = {r["key"]: (r["original"], r["imputation_original"]) for r in impute.mean_fill_flagged(df, ["original"]).collect()}
    assert got == {"a": (1.0, 0), "b": (2.0, 1), "c": (3.0, 0), "d": (2.0, 1), "e": (2.0, 1)}
    with pytest.raises(ValueError, match="empty"):
        impute.mean_fill_flagged(df, ["original", "empty"])


def test_median_fill(spark):
    df = spark.createDataFrame([(1, None), (4, None), (None, None), (9, None)], "a int, b int")
    assert sorted(r["a"] for r in impute.median_fill(df, ["a", "b"]).collect()) == [1.0, 4.0, 4.0, 9.0]
    assert sorted(r["a"] for r in impute.median_fill(df, ["a"], "zero").collect()) == [0, 1, 4, 9]


def test_scaler_uses_population_deviation(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (4.0, 5.0)], "a double, b double")
    got = impute.StandardScale(["a", "b"]).fit(df).transform(df).collect()
    assert sorted(r["a"] for r in got) == pytest.approx([-1.069045, -0.267261, 1.336306], abs=1e-6)
    assert {r["b"] for r in got} == {0.0}


def test_panel_changes(spark):
    from datetime import datetime
    asof = spark.createDataFrame([(1, datetime(2015, 6, 1)), (2, datetime(2015, 6, 1))], "p int, d timestamp_ntz")
    rows = spark.createDataFrame([(1, 2011, 1), (1, 2012, 0), (1, 2014, 6), (1, 2015, 99), (2, 2013, 4)], "p int, year int, v int")
    got = {r["p"]: tuple(r)[2:] for r in panel.panel_features(asof, rows, "p", "d", "year", {"v": "v"}).collect()}
    assert got == {1: (3.0, 6, None), 2: (4.0, None, None)}


@pytest.mark.parametrize("year,want", [(2007, None), (2008, 1), (2009, 1), (2010, 2), (2016, None)])
def test_organisation_years(spark, year, want):
    from datetime import datetime
    owners = {f"owner_{y}": "ORGANIZATION" if y in (2007, 2009) else None for y in range(2007, 2016)}
    df = spark.createDataFrame([(datetime(year, 5, 1), *owners.values())],
                               "d timestamp_ntz, " + ", ".join(f"{k} string" for k in owners))
    assert panel.organisation_years(df, "d").first()["owner_ner"] == want


def test_panel_years_are_read_once_a_year(spark, monkeypatch, rows):
    """Many dates of a year share what the years before it give; only years meet the panel."""
    asof = spark.sql("SELECT id % 3 AS p, timestamp_ntz '2012-06-30' + make_dt_interval(cast(id AS int)) AS d FROM range(600)") \
        .unionByName(spark.sql("SELECT 1L AS p, CAST(NULL AS timestamp_ntz) AS d UNION ALL SELECT NULL, timestamp_ntz '2013-01-01'"))
    paid = spark.createDataFrame([(p, y, p * 100 + y, y % 2 == 0) for p in (0, 1) for y in (2009, 2011, 2012)] + [(None, 2012, 1, True)],
                                 "p long, year int, v long, f boolean")
    met, plain = [], panel.prior_years
    monkeypatch.setattr(panel, "prior_years", lambda wanted, *a: met.append(wanted.count()) or plain(wanted, *a))
    got = panel.panel_features(asof, paid, "p", "d", "year", {"v": "v"})
    flags = rows(panel.flagged_years(asof, paid, "p", "d", "year", "f", "n"))
    assert met == [11, 11]  # three parcels in three years, and two rows with nulls
    assert got.columns == ["p", "d", "mean_v", "change_v", "rel_change_v"]
    dates = sorted({(r["p"], r["d"]) for r in asof.where("p < 2 AND d IS NOT NULL").collect()})
    known = {2012: (2009, 2011), 2013: (2011, 2012), 2014: (2011, 2012)}
    want = [(p, d, p * 100 + sum(known[d.year]) / 2, known[d.year][1] - known[d.year][0]) for p, d in dates]
    assert rows(got, "p", "d", "mean_v", "change_v") == want
    assert flags == [(p, d, float(sum(y % 2 == 0 for y in known[d.year]))) for p, d in dates]
