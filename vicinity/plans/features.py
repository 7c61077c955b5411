"""Feature builders and their registry.

A builder takes a :class:`Context` (population, edges, source tables, window)
and returns one row per key with event features, lazily. Nothing but level
lists and date bounds reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vicinity.functions import dates, text
from vicinity.operators import area, asof, panel, spatial
from vicinity.operators.asof import Measure
from vicinity.operators.levels import group_code, level_of
from vicinity.operators.order_stats import with_ranks
from vicinity.operators.pivot import classes_of, clean_name, level_measures, text_categories
from vicinity.operators.spatial import NearPoints
from vicinity.sources.store import table_name

KEYS = ["parcel_id", "inspection_date"]


@dataclass
class Context:
    """What a feature needs: who, where, what happened, and the window."""

    population: DataFrame                     # parcel_id, inspection_date
    tables: dict[str, DataFrame] = field(default_factory=dict)
    edges: DataFrame | NearPoints | None = None        # parcel_id, address_id, dist_m, or the points
    event_edges: DataFrame | NearPoints | None = None  # parcel_id, event_id, dist_m, or the points
    months: int = 3
    metres: float = 1000
    empty: str = "drop"

    def bounded(self, events: DataFrame, when: str) -> DataFrame:
        low_high = asof.date_bounds(self.population, events, "inspection_date", when, self.months)
        return asof.within_bounds(self.population, "inspection_date", low_high)


@dataclass(frozen=True)
class Mean:
    """Average of a per-event expression; ``whole`` numbers are summed exactly."""

    name: str
    expr: Column
    whole: bool = False

    def parts(self) -> list[Measure]:
        total = self.expr.cast("long" if self.whole else "double")
        return [Measure(f"_s_{self.name}", total, "sum" if self.whole else "fsum"),
                Measure(f"_n_{self.name}", self.expr.isNotNull().cast("int"))]

    def result(self) -> Column:
        return F.try_divide(F.col(f"_s_{self.name}").cast("double"), F.col(f"_n_{self.name}")).alias(self.name)


def event_features(ctx: Context, events: DataFrame, place: str, when: str, edges: DataFrame | NearPoints,
                   means: list[Mean] | None = None, sums: list[Measure] | None = None,
                   categories: dict[str, Column] | None = None, levels_from: DataFrame | None = None,
                   deviation: dict[str, Column] | None = None, bounded: bool = True,
                   single_events: bool = False) -> DataFrame:
    """Count, means, sums and level counts of nearby events before each as-of date.

    All measures travel together through one window stage and one final
    aggregate. Levels come from the whole event table unless ``levels_from``
    limits them (for example to rows known at an earlier date). With
    ``single_events`` the edges lead to events instead of shared places.
    """
    people = ctx.bounded(events, when) if bounded else ctx.population
    counts = level_measures(levels_from if levels_from is not None else events, categories or {})
    spread = []
    for name, expr in (deviation or {}).items():
        whole = expr.cast("long")
        spread += [Measure(f"_d_s_{name}", whole), Measure(f"_d_q_{name}", whole * whole),
                   Measure(f"_d_n_{name}", whole.isNotNull().cast("int"))]
    measures = [Measure("total", F.lit(1))] + [p for m in means or [] for p in m.parts()] \
        + (sums or []) + counts + spread
    gather = asof.nearby_event_totals if single_events else asof.nearby_totals
    totals = gather(people, edges, events, "parcel_id", place, when, "inspection_date",
                    measures, ctx.months, ctx.metres)
    devs = []
    for name in deviation or {}:
        s, q, n = (F.col(f"_d_{k}_{name}").cast("decimal(18,0)") for k in "sqn")
        devs.append(F.when(n > 1, F.sqrt((n * q - s * s).cast("double") / (n * (n - 1)).cast("double"))).alias(name))
    out = totals.select(*KEYS, "total", *[m.result() for m in means or []],
                        *[s.name for s in sums or []], *devs, *[c.name for c in counts])
    if ctx.empty == "zero":
        out = ctx.population.select(*KEYS).distinct().join(out, KEYS, "left") \
            .fillna(0, subset=["total", *[c.name for c in counts]])
    return out


# Pattern of the offence group inside an offence code.
OFFENCE_GROUP = r" \((\w*)\) "


def crime(ctx: Context) -> DataFrame:
    events = ctx.tables["crime"]
    return event_features(ctx, events, "address_id", "occurred_on", ctx.edges,
                          categories={"orc_combined": group_code("orc", OFFENCE_GROUP)})


def clear_minutes(end: str = "unit_clear_date_time", start: str = "alarm_date_time") -> Column:
    """Whole minutes between two moments: seconds rounded to whole numbers, then cut to minutes."""
    seconds = F.bround((F.unix_micros(F.col(end).cast("timestamp"))
                        - F.unix_micros(F.col(start).cast("timestamp"))) / 1e6).cast("long")
    return F.when(seconds < 0, -F.floor(-seconds / 60)).otherwise(F.floor(seconds / 60))


def fire(ctx: Context) -> DataFrame:
    events = ctx.tables["fire"]
    minutes = clear_minutes()
    return event_features(
        ctx, events, "address_id", "incident_date", ctx.edges,
        means=[Mean("avg_clear_time_minutes", minutes, whole=True)],
        sums=[Measure("max_clear_time_minutes", minutes, "max"), Measure("min_clear_time_minutes", minutes, "min")],
        deviation={"stddev_clear_time_minutes": minutes},
        categories={"incident_type": level_of("incident_type_desc")})


PERMIT_CATEGORIES = ["proposeduse", "statuscurrent", "workclass", "permitclass", "permittype"]


def permits(ctx: Context) -> DataFrame:
    events = ctx.tables["permits"]
    gap = dates.days_between
    present = lambda c: F.when(F.col(c).isNotNull(), 1).otherwise(0)
    means = [
        Mean("avg_days_applied_to_completed", gap(F.col("completeddate"), F.col("applieddate")), True),
        Mean("avg_days_issued_to_completed", gap(F.col("completeddate"), F.col("issueddate")), True),
        Mean("avg_days_applied_to_issued", gap(F.col("issueddate"), F.col("applieddate")), True),
        Mean("avg_days_issued_to_expires", gap(F.col("expiresdate"), F.col("issueddate")), True),
        Mean("avg_days_completed_to_expires", gap(F.col("expiresdate"), F.col("completeddate")), True),
        Mean("avg_issued", present("issueddate"), True),
        Mean("avg_completed", present("completeddate"), True),
        Mean("avg_expires", present("expiresdate"), True),
        Mean("avg_sqft", F.col("totalsqft")),
        Mean("avg_estcost", F.col("estprojectcostdec")),
        Mean("avg_units", F.col("units")),
        Mean("avg_is_coissued", present("coissueddate"), True),
        Mean("avg_fee", text.fee_amount(F.col("fee"))),
        Mean("avg_owner_is_company", F.when(F.col("companyname") == "OWNER", 1).otherwise(0), True),
    ]
    return event_features(ctx, events, "address_id", "issueddate", ctx.edges, means=means,
                          categories=text_categories(PERMIT_CATEGORIES))


SALE_NUMBERS = ["number_of_parcels", "appraisal_area", "total_sales_records", "sale_price", "total_rooms",
                "full_bath", "half_bath", "fireplaces", "garage_capacity", "num_stories", "year_built",
                "finished_sq_ft", "total_finish_area", "first_floor_area", "half_floor_area", "finished_basement"]
SALE_CATEGORIES = ["instrument_type", "garage_type", "style", "grade", "exterior_wall_type", "basement",
                   "heating", "air_conditioning"]

# Level names of the integer use code for missing and rare codes.
MISSING_CODE, RARE_CODE = "11111", "9999"


def sales(ctx: Context) -> DataFrame:
    events = ctx.tables["sales"]
    out = event_features(
        ctx, events, "address_id", "date_of_sale", ctx.edges,
        means=[Mean(f"avg_{c}", F.col(c)) for c in SALE_NUMBERS],
        categories={"use_code": level_of("use_code", MISSING_CODE), **text_categories(SALE_CATEGORIES)})
    return out.withColumnRenamed("use_code_other", f"use_code_{RARE_CODE}")


# Fixed value: description of requests that came in through the web form.
WEB_REQUEST = "Request entered through the Web. Refer to Intake Questions for further description."


def three11(ctx: Context) -> DataFrame:
    events = ctx.tables["three11"].withColumnRenamed("id", "event_id")
    web = F.when(F.col("description") == WEB_REQUEST, 1).otherwise(0)
    out = event_features(
        ctx, events, "event_id", "requested_datetime", ctx.event_edges,
        sums=[Measure("sum_webrequest", web)], categories={"service_code": level_of("service_code")},
        single_events=True)
    return out.withColumn("avg_webrequest", F.try_divide(F.col("sum_webrequest").cast("double"), F.col("total")))


def density(ctx: Context) -> DataFrame:
    """Nearby inspection events by type, and the same regularised by the number of houses.

    Keys outside the date bounds keep zero counts. Needs tables ``parcels``
    (parcel_id, x, y) and ``events_parcel`` (parcel_id, date, event). Events of
    one point and moment are one row.
    """
    parcels, events = ctx.tables["parcels"], ctx.tables["events_parcel"]
    known = parcels.select("parcel_id", "x", "y")
    subjects = ctx.population.select("parcel_id").distinct().join(known, "parcel_id", "left")
    houses = spatial.neighbour_counts(subjects, parcels, "parcel_id", "parcel_id", ctx.metres)
    kind = level_of("event")
    kinds = classes_of(events, kind)
    counts = [Measure(clean_name(k), (kind == F.lit(k)).cast("int")) for k in kinds]
    placed = asof.fold_measures(events.join(known, "parcel_id"), ["x", "y", "date"], counts)
    people = ctx.bounded(events, "date").join(known, "parcel_id")
    near = asof.totals_around(people, placed, "parcel_id", "inspection_date", "date",
                              [Measure(c.name, F.col(c.name)) for c in counts], ctx.months, ctx.metres)
    names = [c.name for c in counts]
    rows = ctx.population.select("parcel_id", dates.as_moment(F.col("inspection_date")).alias("inspection_date")) \
        .distinct().join(houses, "parcel_id").join(near, KEYS, "left").fillna(0, subset=names)
    rates = [((F.col(n) + 1.0) / (F.col("parcels") + 5.0)).alias(f"{n}_per_houses") for n in names]
    return rows.select(*KEYS, *names, *rates)


_SCORE_COUNTS = ["violations", "non_violations", "inspections",
                 "unique_violations", "unique_non_violations", "unique_inspections"]


def neighborhood_score(population: DataFrame, inspections: DataFrame, parcels: DataFrame, metres: float,
                       months: int, ranks: bool = True) -> DataFrame:
    """Inspections and outcomes around each (parcel, moment), and houses, with ascending ranks.

    ``inspections`` holds ``parcel_id, inspection_date, viol_outcome``; the window
    ``[d - N months, d)`` is read at moments on both sides. For the unique counts
    a neighbour counts once per window: by its last inspection before d, that is
    the one whose successor at the same parcel (of any outcome, or of the same
    one) does not come before d. So all six counts are sums, and no sets of
    neighbours are formed.
    """
    known = parcels.select("parcel_id", "x", "y")
    single = inspections.where(F.col("inspection_date").isNotNull()).groupBy(
        "parcel_id", dates.as_moment(F.col("inspection_date")).alias("at")).agg(
        F.count(F.lit(1)).alias("inspections"),
        F.count(F.when(F.col("viol_outcome") == 1, 1)).alias("violations"),
        F.count(F.when(F.col("viol_outcome") == 0, 1)).alias("non_violations"))
    plain = ["violations", "non_violations", "inspections"]
    later = Window.partitionBy("parcel_id").orderBy("at").rowsBetween(1, Window.unboundedFollowing)
    single = single.withColumns({f"_next_{c}": F.min(F.when(F.col(c) > 0, F.col("at"))).over(later) for c in plain})
    last = lambda c: Measure(f"unique_{c}", (F.col(c) > 0).cast("int"), until=F.col(f"_next_{c}"))
    measures = [*[Measure(c, F.col(c)) for c in plain], *[last(c) for c in plain]]
    counts = asof.totals_around(population.join(known, "parcel_id"), single.join(known, "parcel_id"), "parcel_id",
                                "inspection_date", "at", measures, months, metres)
    who = known.join(population.select("parcel_id").distinct(), "parcel_id", "left_semi")
    houses = spatial.neighbour_counts(who, parcels, "parcel_id", "parcel_id", metres, include_self=True) \
        .withColumnRenamed("parcels", "houses")
    scores = counts.join(houses, "parcel_id").select(*KEYS, *_SCORE_COUNTS, "houses")
    if not ranks:
        return scores
    return with_ranks(scores, [c for c in scores.columns if c not in KEYS])


def inspection_metrics(scores: DataFrame) -> DataFrame:
    """Inspection density, violation rate and violations per house from the neighbourhood counts."""
    ratio = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))
    return scores.select(
        "parcel_id", ratio("unique_inspections", "houses").alias("inspection_density"),
        ratio("unique_violations", "unique_inspections").alias("violation_rate"),
        ratio("unique_violations", "houses").alias("violations_per_house"))


def weather(ctx: Context) -> DataFrame:
    series = {"avg_air_temp": "air_temp", "avg_wind_speed_rate": "wind_speed_rate",
              "avg_sea_level_pressure": "sea_level_pressure",
              "avg_precipitation": "liquid_precipitation_depth_dimension_one_hour"}
    return asof.lookback_average(ctx.population.select(*KEYS), ctx.tables["weather"], "inspection_date", "date",
                                 series).select(*KEYS, *series)


def tax(ctx: Context) -> DataFrame:
    stems = {"mkt_total_val": "market_value", "mkt_land_val": "land_value", "mkt_impr_val": "impr_value"}
    values = ctx.tables["tax_combined"].withColumns({c: F.col(c).cast("int") for c in stems})
    money = panel.panel_features(ctx.population, values, "parcel_id", "inspection_date", "year", stems)
    shut = panel.flagged_years(ctx.population, ctx.tables["tax_foreclosure"], "parcel_id", "inspection_date",
                               "year", "forcl_flag", "tax_foreclosure")
    return money.join(shut, KEYS, "full")


def named_entities(ctx: Context) -> DataFrame:
    rows = ctx.population.select(*KEYS).join(ctx.tables["taxes_owners"], "parcel_id")
    return panel.organisation_years(rows, "inspection_date").select(*KEYS, "owner_ner")


def house_type(ctx: Context) -> DataFrame:
    rows = ctx.population.select("parcel_id").join(ctx.tables["parcels"].select("parcel_id", "class"), "parcel_id")
    return text.home_dummies(rows, "class").drop("class")


def parc_area(ctx: Context) -> DataFrame:
    return ctx.population.select("parcel_id").join(ctx.tables["parcels"].select("parcel_id", "area"), "parcel_id")


def parc_year(ctx: Context) -> DataFrame:
    return ctx.population.select("parcel_id").join(
        ctx.tables["buildings"].select("parcel_id", "year_built"), "parcel_id")


def census_2010(ctx: Context) -> DataFrame:
    """Census ratios of the block group each parcel lies in."""
    where = ctx.tables["parcel_areas"].select("parcel_id", "tract", "block_group")
    return ctx.population.select("parcel_id").join(where, "parcel_id") \
        .join(ctx.tables["census_features"], ["tract", "block_group"]).drop("tract", "block_group")


def quarter(ctx: Context) -> DataFrame:
    return dates.quarter_dummies(ctx.population.select(*KEYS), "inspection_date")


def crime_agg(ctx: Context) -> DataFrame:
    """Monthly event rates per tract over one and three years, for all events and gun events."""
    who = ctx.population.select(*KEYS).distinct().join(ctx.tables["parcel_areas"].select("parcel_id", "tract"), "parcel_id")
    out = None
    for suffix, rule in (("", F.lit(True)), ("_guns", F.col("weapon").like("%GUN%"))):
        for years in (1, 3):
            rate = area.area_rate_months(
                who, ctx.tables["crime_areas"].where(rule), ctx.tables["population"], "tract", "date_reported",
                "inspection_date", 365 * years, 2004, 132)
            part = rate.select(*KEYS, F.col("rate").alias(f"crime_rate_{years}yr{suffix}"))
            out = part if out is None else out.join(part, KEYS)
    return out


@dataclass(frozen=True)
class Feature:
    table: str
    build: Callable[[Context], DataFrame]
    windowed: bool = False


REGISTRY: dict[str, Feature] = {f.table: f for f in [
    Feature("tax", tax), Feature("named_entities", named_entities), Feature("house_type", house_type),
    Feature("parc_area", parc_area), Feature("parc_year", parc_year), Feature("census_2010", census_2010),
    Feature("three11", three11, True), Feature("permits", permits, True), Feature("crime", crime, True),
    Feature("fire", fire, True), Feature("sales", sales, True), Feature("density", density, True),
    Feature("quarter", quarter), Feature("sixweeksweather", weather),
]}


def register(table: str, build: Callable[[Context], DataFrame], windowed: bool = False) -> None:
    REGISTRY[table] = Feature(table, build, windowed)


def generate(store, ctx: Context, names: list[str]) -> list[str]:
    """Build the named features into the store; windowed ones are named by distance and months.

    The store's tables are bucketed by their keys, in a number that follows the population.
    """
    if store.buckets() is None:
        store.set_buckets(ctx.population.count())
    written = []
    for name in names:
        f = REGISTRY[name]
        table = table_name(name, int(ctx.metres), ctx.months) if f.windowed else name
        store.write(f.build(ctx), table)
        written.append(table)
    return written
