"""As-of windows: totals of events in ``[d - N, d)`` for each as-of moment ``d``.

Only events that some window can reach are read. They are folded to one row per
(key, day), with a map-side combine, so a key that owns a third of all events
shrinks to one row per day. As-of days are then laid between the days of their
key and the totals are read from one ordered window; the two days at the ends of a
window are read event by event where as-of moments have a time of day. Sums are
differences of running totals (``S(d) - S(d - N)``) of whole numbers, which is
exact and linear: a floating sum is kept as three of them. Extremes come from an
ordered frame.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from vicinity.functions import dates
from vicinity.operators import blocks, packs, window_sets
from vicinity.operators.blocks import CELL_REACHES, near_windows, reach_squared
from vicinity.operators.order_stats import known
from vicinity.operators.spatial import FEET_PER_METRE, SALTS, NearPoints, cell_of, located, split_hot_keys

#: Rows of a side of a block of visits and events that become pairs.
BLOCK_ROWS = 200_000


@dataclass(frozen=True)
class Measure:
    """One mergeable per-event quantity.

    ``how`` is ``sum`` (integer or decimal), ``fsum`` (floating), ``min`` or
    ``max``. ``expr`` is evaluated on the event rows. A ``sum`` with ``until`` counts
    an event for as-of moments up to that moment only (null: for ever).
    """

    name: str
    expr: Column
    how: str = "sum"
    until: Column | None = None


_FOLD = {"sum": F.sum, "fsum": F.sum, "min": F.min, "max": F.max}


def fold_measures(df: DataFrame, keys: list, measures: list[Measure]) -> DataFrame:
    return df.groupBy(*keys).agg(*[_FOLD[m.how](m.expr).alias(m.name) for m in measures])


def merge_measures(df: DataFrame, keys: list, measures: list[Measure]) -> DataFrame:
    """Fold already folded measures further."""
    return df.groupBy(*keys).agg(*[_FOLD[m.how](F.col(m.name)).alias(m.name) for m in measures])


@dataclass(frozen=True)
class _Reach:
    """What one look at the as-of rows says: their span, and whether some have a time of day."""

    low: object
    high: object
    moments: bool


def _reach(asof: DataFrame, asof_time: str) -> _Reach:
    at = dates.as_moment(F.col(asof_time))
    row = asof.agg(F.min(at).alias("low"), F.max(at).alias("high"), F.max(at != F.date_trunc("day", at)).alias("moments")).first()
    return _Reach(row["low"], row["high"], bool(row["moments"]))


def _span(months: int, days: int) -> str:
    return f"CAST('{months} months {days} days' AS INTERVAL)"


def _within_reach(events: DataFrame, event_time: str, reach: _Reach, months: int, days: int) -> DataFrame:
    """Events that some window can hold; the range is on the raw column, so it reaches the scan."""
    if reach.low is None:
        return events.limit(0)
    first = F.expr(f"TIMESTAMP_NTZ '{reach.low}' - {_span(months, days)}")
    return events.where((F.col(event_time) >= first) & (F.col(event_time) < F.expr(f"TIMESTAMP_NTZ '{reach.high}'")))


#: A floating sum is kept as whole numbers: whole part, and 31 and 31 more bits behind the point.
_LIMBS, _BITS = ("a", "b", "c"), 31


def _whole_numbers(measures: list[Measure]) -> list[Measure]:
    """Sums of whole numbers that stand for ``sum`` and ``fsum`` measures, so that differences of totals lose nothing.

    Floating values are exact down to 2^-62 and up to 2^53; null and NaN are left out.
    """
    out = []
    for m in measures:
        if m.how == "sum":
            out.append(m)
        elif m.how == "fsum":
            v = F.nanvl(m.expr.cast("double"), F.lit(None).cast("double"))
            scale = F.lit(float(1 << _BITS))
            first = (v - F.floor(v)) * scale
            parts = [F.floor(v), F.floor(first), F.floor((first - F.floor(first)) * scale)]
            out += [Measure(f"_{limb}_{m.name}", part.cast("long")) for limb, part in zip(_LIMBS, parts)]
            out.append(Measure(f"_n_{m.name}", v.isNotNull().cast("int")))
    return out


def _floating(name: str) -> Column:
    """The floating sum of its parts; null without any value."""
    a, b, c = (F.col(f"_{limb}_{name}") for limb in _LIMBS)
    return F.when(F.col(f"_n_{name}") > 0, a + (b + c / F.lit(float(1 << _BITS))) / F.lit(float(1 << _BITS)))


def _read_windows(folded: DataFrame, probes: DataFrame, key: str, asof_time: str, measures: list[Measure],
                  months: int, days: int, events: DataFrame | None = None) -> DataFrame:
    """Window totals of day rows ``(key, _at, measures)`` at probes ``(key, _d)``.

    Sums are read from running totals of whole days: one row per day with events
    and, as probes are folded to their days, at most two per day that is asked,
    so a key has no more rows than the calendar has days. Measures travel as one
    struct, which is null in the rows that only ask. Where probes have a time of
    day, ``events`` ``(key, _t, measures)`` add what lies between midnight and either
    end of the window, so only the two edge days are read event by event.
    """
    span = _span(months, days)
    running = _whole_numbers(measures)
    framed = [m for m in measures if m.how in ("min", "max")]
    names = [m.name for m in running]
    midnight = lambda c: F.date_trunc("day", c).cast("timestamp_ntz")

    rows = folded.select(key, "_at", F.lit(2).alias("_side"), F.struct(*names).alias("_m"), F.lit(None).cast("timestamp_ntz").alias("_d"))
    ends = [(1, F.col("_d")), (0, F.expr(f"_d - {span}"))]
    asked = [probes.select(key, midnight(at).alias("_at"), F.lit(side).alias("_side"), "_d") for side, at in ends]
    if events is not None:  # several moments of one day ask for the same totals
        asked = [a.drop("_d").distinct() for a in asked]
    laid = rows.unionByName(asked[0].unionByName(asked[1]), allowMissingColumns=True).repartition(key)

    ordered = f"PARTITION BY `{key}` ORDER BY _at, _side ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    laid = laid.select(key, "_at", "_d", "_side", *[
        F.expr(f"sum(_m.`{n}`) OVER ({ordered})").alias(n) for n in names]).where(F.col("_side") < 2)
    if events is not None:
        both = [probes.select(F.col(key).alias("_key"), "_d", midnight(at).alias("_day"), F.lit(side).alias("_end")) for side, at in ends]
        at = both[0].unionByName(both[1])
        laid = at.join(laid.drop("_d"), (F.col(key) == F.col("_key")) & (F.col("_at") == F.col("_day")) & (F.col("_side") == F.col("_end")))
    sign = F.when(F.col("_side") == 1, 1).otherwise(-1)
    laid = laid.select(key, "_d", *[(F.coalesce(F.col(n), F.lit(0)) * sign).cast("long").alias(n) for n in names])
    if events is not None:
        ends = F.array(F.struct(F.col("_d").alias("_until"), F.lit(1).alias("_sign")),
                       F.struct(F.expr(f"_d - {span}").alias("_until"), F.lit(-1).alias("_sign")))
        edges = probes.select(key, "_d", F.inline(ends)).withColumn("_day", midnight(F.col("_until"))).where("_until > _day")
        parts = edges.join(events.withColumn("_day", midnight(F.col("_t"))), [key, "_day"]).where("_t < _until")
        laid = laid.unionByName(parts.groupBy(key, "_d").agg(*[
            F.sum(F.coalesce(F.col(n), F.lit(0)) * F.col("_sign")).cast("long").alias(n) for n in names]))
    totals = laid.groupBy(key, F.col("_d").alias(asof_time)).agg(*[F.sum(n).cast("long").alias(n) for n in names])
    if framed:
        totals = totals.join(_read_frames(folded, probes, key, asof_time, framed, span, events), [key, asof_time], "left")
    return totals.select(key, asof_time, *[(_floating(m.name) if m.how == "fsum" else F.col(m.name)).alias(m.name) for m in measures])


def _month(when: Column) -> Column:
    return (F.year(when) * 12 + F.month(when)).cast("int")


def _read_frames(folded: DataFrame, probes: DataFrame, key: str, asof_time: str, measures: list[Measure],
                 span: str, events: DataFrame | None) -> DataFrame:
    """Extremes of the window, which a difference of totals cannot give.

    As-of days lie among the day rows of their key, and one ordered frame reaches
    back over the window. Where probes have a time of day, windows of a key
    need not begin in the order in which they end: probes then meet the day rows
    of the months they cover, and days that a window holds only in part are read
    event by event.
    """
    names = [m.name for m in measures]
    if events is None:
        rows = folded.select(key, "_at", F.struct(*names).alias("_m"), F.lit(False).alias("_asks"))
        laid = rows.unionByName(probes.select(key, F.col("_d").alias("_at"), F.lit(True).alias("_asks")), allowMissingColumns=True).repartition(key)
        frame = f"PARTITION BY `{key}` ORDER BY _at RANGE BETWEEN {span} PRECEDING AND {_span(0, 1)} PRECEDING"
        return laid.select(key, F.col("_at").alias(asof_time), "_asks", *[
            F.expr(f"{m.how}(_m.`{m.name}`) OVER ({frame})").alias(m.name) for m in measures]).where("_asks").drop("_asks")
    wanted = probes.withColumn("_from", F.expr(f"_d - {span}")) \
        .withColumn("_month", F.explode(F.sequence(_month(F.col("_from")), _month(F.col("_d")))))
    rows = folded.select(key, "_at", *names, _month(F.col("_at")).alias("_month"))
    whole = (F.col("_from") <= F.col("_at")) & (F.expr("_at + INTERVAL 1 DAY") <= F.col("_d"))
    met = wanted.join(rows, [key, "_month"]).where(whole).select(key, "_d", *names)
    midnight = lambda c: F.date_trunc("day", c).cast("timestamp_ntz")
    ends = probes.withColumn("_from", F.expr(f"_d - {span}")) \
        .withColumn("_day", F.explode(F.array_distinct(F.array(midnight(F.col("_from")), midnight(F.col("_d"))))))
    ends = ends.where("_from > _day OR _d < _day + INTERVAL 1 DAY")
    parts = ends.join(events.withColumn("_day", midnight(F.col("_t"))), [key, "_day"]).where("_from <= _t AND _t < _d")
    met = met.unionByName(parts.select(key, "_d", *names))
    return merge_measures(met.withColumnRenamed("_d", asof_time), [key, asof_time], measures)


def _fold_events(events: DataFrame, key: str, event_time: str, measures: list[Measure]) -> DataFrame:
    held = events.where(F.col(key).isNotNull() & F.col(event_time).isNotNull())
    extremes = [m for m in measures if m.how in ("min", "max")]
    return fold_measures(held, [F.col(key), dates.day_of(F.col(event_time)).alias("_at")], [*_whole_numbers(measures), *extremes])


def _single_events(events: DataFrame, key: str, event_time: str, measures: list[Measure]) -> DataFrame:
    extremes = [m for m in measures if m.how in ("min", "max")]
    return events.where(F.col(key).isNotNull()).select(
        key, dates.as_moment(F.col(event_time)).alias("_t"), *[m.expr.alias(m.name) for m in [*_whole_numbers(measures), *extremes]])


def window_totals(events: DataFrame, asof: DataFrame, key: str, event_time: str, asof_time: str,
                  measures: list[Measure], months: int = 0, days: int = 0) -> DataFrame:
    """Totals over ``[d - window, d)`` per distinct (key, d): ``(key, asof_time, measures...)``; d is any moment."""
    reach = _reach(asof, asof_time)
    events = _within_reach(events, event_time, reach, months, days)
    folded = _fold_events(events, key, event_time, measures)
    probes = asof.select(key, dates.as_moment(F.col(asof_time)).alias("_d")).distinct()
    single = _single_events(events, key, event_time, measures) if reach.moments else None
    return _read_windows(folded, probes, key, asof_time, measures, months, days, single)


def _near_points_totals(asof: DataFrame, near: NearPoints, events: DataFrame, entity: str, place: str, event_time: str,
                        asof_time: str, measures: list[Measure], months: int, max_dist: float | None) -> DataFrame:
    """Totals of events at the right points near each left point, folded to one row per (point, day) first.

    Many sums are not folded first: a row of all of them is much larger than the event, see :func:`blocks.wide_windows`.
    """
    reach = _reach(asof, asof_time)
    points = lambda df, key: df.select(key, F.col("x").alias("_x"), F.col("y").alias("_y"))
    held = _within_reach(events, event_time, reach, months, 0).drop("_x", "_y").join(points(near.right, place), place)
    held = held.where(F.col(event_time).isNotNull())
    at = F.col(event_time)
    at = dates.as_moment(at) if reach.moments else dates.day_of(at)
    running, framed = _whole_numbers(measures), [m for m in measures if m.how in ("min", "max")]
    result = lambda totals: totals.select(entity, F.col("_d").alias(asof_time), *[
        (_floating(m.name) if m.how == "fsum" else F.col(m.name)).alias(m.name) for m in measures])
    asked = asof.select(entity, dates.as_moment(F.col(asof_time)).alias("_d")).distinct().join(points(near.left, entity), entity)
    if len(running) > blocks.WIDE and not framed:
        values = [F.coalesce(m.expr.cast("double"), F.lit(float("nan"))) if m.how == "fsum" else F.coalesce(m.expr, F.lit(0)) for m in measures]
        single = held.select("_x", "_y", at.alias("_t"), *[v.alias(f"_v{i}") for i, v in enumerate(values)])
        real = {f"_v{i}": m.how == "fsum" for i, m in enumerate(measures)}
        if all(r or isinstance(single.schema[c].dataType, T.IntegralType) for c, r in real.items()):
            again = near.left.groupBy(entity).agg(F.count(F.lit(1)).alias("_n")).where(F.col(entity).isNotNull() & (F.col("_n") > 1))
            return result(blocks.wide_windows(asked, single, entity, [m.name for m in running], real, near.metres, months,
                                              max_dist, bool(again.limit(1).count())))
    folded = fold_measures(held, ["_x", "_y", at.alias("_t")], [*running, *framed])
    return result(near_windows(asked, folded, entity, [m.name for m in running], [], [(m.name, m.how) for m in framed],
                               near.metres, months, max_dist))


def nearby_totals(asof: DataFrame, edges: DataFrame | NearPoints, events: DataFrame, entity: str, place: str,
                  event_time: str, asof_time: str, measures: list[Measure], months: int,
                  max_dist: float | None = None, side: str = "place") -> DataFrame:
    """Totals of events near each entity before each as-of moment.

    ``edges`` is the proximity table ``(entity, place, dist_m)``, or the points it
    comes from: then no pair becomes a row, see :mod:`vicinity.operators.blocks`, and
    extremes are those of numbers. Entity x event rows inside the window are never
    formed. For a stored table ``side`` is the caller's choice by
    the meaning of the data: on the ``place`` side the window is read once per
    distinct (place, as-of moment) and shared by every entity near that place,
    which suits busy places; on the ``entity`` side the day totals of the places
    are handed to their entities and folded per (entity, day) first, which suits
    places with few event days. The first measure must be the event count;
    entities without events are left out.
    """
    if isinstance(edges, NearPoints):
        return _near_points_totals(asof, edges, events, entity, place, event_time, asof_time, measures, months, max_dist)
    near = edges if max_dist is None else edges.where(F.col("dist_m") <= max_dist)
    near = near.select(entity, place)
    reach = _reach(asof, asof_time)
    events = _within_reach(events, event_time, reach, months, 0)
    folded = _fold_events(events, place, event_time, measures)
    single = _single_events(events, place, event_time, measures) if reach.moments else None
    visits = asof.select(entity, dates.as_moment(F.col(asof_time)).alias(asof_time)).distinct()
    if side == "entity":
        parts = [*_whole_numbers(measures), *[m for m in measures if m.how in ("min", "max")]]
        handed = merge_measures(near.join(folded, place), [entity, "_at"], parts)
        single = None if single is None else near.join(single, place).drop(place)
        probes = visits.withColumnRenamed(asof_time, "_d")
        totals = _read_windows(handed, probes, entity, asof_time, measures, months, 0, single)
        return totals.where(F.col(measures[0].name) > 0)
    seen = visits.join(near, entity)
    probes = seen.select(place, F.col(asof_time).alias("_d")).distinct()
    totals = _read_windows(folded, probes, place, asof_time, measures, months, 0, single)
    found = totals.where(F.col(measures[0].name) > 0)
    return merge_measures(seen.join(found, [place, asof_time]), [entity, asof_time], measures)


def nearby_event_totals(asof: DataFrame, edges: DataFrame | NearPoints, events: DataFrame, entity: str, event_id: str,
                        event_time: str, asof_time: str, measures: list[Measure], months: int,
                        max_dist: float | None = None) -> DataFrame:
    """Like :func:`nearby_totals` for edges that lead straight to single events.

    Each event has its own place, so events are handed to their entities first
    and folded per (entity, day); work is linear in the number of edges. Given the
    points of entities and events, no event is handed to anyone.
    """
    if isinstance(edges, NearPoints):
        return _near_points_totals(asof, edges, events, entity, event_id, event_time, asof_time, measures, months, max_dist)
    near = edges if max_dist is None else edges.where(F.col("dist_m") <= max_dist)
    handed = near.select(entity, event_id).join(events, event_id)
    totals = window_totals(handed, asof, entity, event_time, asof_time, measures, months=months)
    return totals.where(F.col(measures[0].name) > 0)


def totals_around(visits: DataFrame, events: DataFrame, entity: str, asof_time: str, event_time: str,
                  measures: list[Measure], months: int, metres: float) -> DataFrame:
    """Totals of events at most ``metres`` from a visit in ``[d - N months, d)``, for sparse events.

    ``visits`` (entity, asof_time, x, y) and ``events`` (x, y, event_time, ...)
    meet block against block, see :mod:`vicinity.operators.blocks`, and no pair of them
    becomes a row. Measures are sums of whole numbers. Both ends of a window are
    moments, with the months counted on the calendar (end-of-month days clamp). Only
    visits with events come back.
    """
    reach = _reach(visits, asof_time)
    asked = visits.select(entity, dates.as_moment(F.col(asof_time)).alias("_d"), F.col("x").alias("_x"), F.col("y").alias("_y")).distinct()
    plain, lasts = [m for m in measures if m.until is None], [m for m in measures if m.until is not None]
    held = _within_reach(events, event_time, reach, months, 0).select(
        F.col("x").alias("_x"), F.col("y").alias("_y"), dates.as_moment(F.col(event_time)).alias("_t"),
        F.lit(1).cast("long").alias("_events"), *[m.expr.cast("long").alias(m.name) for m in measures],
        *[dates.as_moment(m.until).alias(f"_until_{m.name}") for m in lasts])
    totals = near_windows(asked, held, entity, ["_events", *[m.name for m in plain]], [m.name for m in lasts], [], metres, months)
    return totals.select(entity, F.col("_d").alias(asof_time), *[m.name for m in measures])


def _near_points_pairs(asof: DataFrame, near: NearPoints, events: DataFrame, entity: str, place: str, event_id: str,
                       event_time: str, asof_time: str, months: int, max_dist: float) -> DataFrame:
    """Visits and events meet in blocks of (cell, month) and leave them as sets, so only rows of the result are pairs.

    Events stay in their block and visits, which are fewer, are handed to those they reach, see :mod:`window_sets`.
    """
    limit = reach_squared(near.metres, max_dist)
    reach = math.sqrt(limit) * 1.000001 + 1e-6
    size = CELL_REACHES * max(reach, 1.0)
    visits = (
        asof.select(entity, dates.as_moment(F.col(asof_time)).alias("_d")).distinct()
        .join(located(near.left, [entity], "_"), entity).where(F.col("_d").isNotNull())
        .select(entity, "_d", dates.months_before(F.col("_d"), months).alias("_from"), "_x", "_y")
    )
    found = events.select(F.col(place).alias("_place"), event_id, dates.as_moment(F.col(event_time)).alias("_t")) \
        .join(located(near.right.withColumnRenamed(place, "_place"), ["_place"], "_"), "_place").where(F.col("_t").isNotNull()).drop("_place")
    reached = {f"_c{c}": (cell_of(F.col(f"_{c}") - reach, size), cell_of(F.col(f"_{c}") + reach, size)) for c in "xy"} \
        | {"_slice": (_month(F.col("_from")), _month(F.col("_d")))}
    home = {f"_c{c}": (cell_of(F.col(f"_{c}"), size),) * 2 for c in "xy"} | {"_slice": (_month(F.col("_t")),) * 2}
    spread = visits
    for c, span in reached.items():
        spread = spread.withColumn(c, F.explode(F.sequence(*span)))
    splits = [packs.crowds(found, [span[0] for span in home.values()], BLOCK_ROWS),
              packs.crowds(spread, [F.col(c) for c in reached], BLOCK_ROWS)]
    crowded = {key: tuple(s.get(key, 1) for s in splits) for key in {*splits[0], *splits[1]}}
    sides = [packs.packed(visits, 0, visits.columns, reached, F.lit(0), [entity, "_d"], crowded),
             packs.packed(found.select(event_id, "_t", "_x", "_y"), 1, [event_id, "_t", "_x", "_y"], home, F.lit(0), [event_id, "_t"], crowded)]
    out = T.StructType([T.StructField("_left", T.ArrayType(visits.schema)),
                        T.StructField("_right", T.ArrayType(found.select(event_id, "_t", "_x", "_y").schema))])
    run = window_sets.kernel(reach, reach * reach, to_arrow_schema(out))
    sets = packs.in_order(sides).mapInArrow(run, out)
    pairs = sets.select(F.explode("_left").alias("_l"), "_right").select("_l", F.explode("_right").alias("_r"))
    dx, dy = F.col("_l._x") - F.col("_r._x"), F.col("_l._y") - F.col("_r._y")
    squared = dx * dx + dy * dy
    return (
        pairs.where((F.col("_l._from") <= F.col("_r._t")) & (F.col("_r._t") < F.col("_l._d")) & (squared <= F.lit(limit)))
        .select(F.col("_l").getField(entity).alias(entity), F.col("_l._d").alias(asof_time),
                (F.sqrt(squared.cast("double")) / FEET_PER_METRE).alias("dist_m"), F.col("_r").getField(event_id).alias(event_id))
    )


def events_in_window(asof: DataFrame, edges: DataFrame | NearPoints, events: DataFrame, entity: str, place: str,
                     event_id: str, event_time: str, asof_time: str, months: int,
                     max_dist: float) -> DataFrame:
    """The pair table itself: ``(entity, as-of date, dist_m, event_id)``.

    Only needed when single pairs are wanted; features use
    :func:`nearby_totals`. As-of dates and events meet on (place, month), then
    the exact half-open window is applied. Given the points, they meet in blocks, and
    dates are not handed to every place near them.
    """
    events = _within_reach(events, event_time, _reach(asof, asof_time), months, 0)
    if isinstance(edges, NearPoints):
        return _near_points_pairs(asof, edges, events, entity, place, event_id, event_time, asof_time, months, max_dist)
    visits = (
        asof.select(entity, dates.as_moment(F.col(asof_time)).alias(asof_time)).distinct()
        .join(edges.where(F.col("dist_m") <= max_dist).select(entity, place, "dist_m"), entity)
        .withColumn("_from", dates.months_before(F.col(asof_time), months))
        .withColumn("_month", F.explode(F.sequence(_month(F.col("_from")), _month(F.col(asof_time)))))
    )
    found = events.select(place, event_id, dates.as_moment(F.col(event_time)).alias("_at"), _month(F.col(event_time)).alias("_month"))
    found, visits = split_hot_keys(found, visits, [place, "_month"], [event_id], [entity, asof_time])
    return (
        visits.join(found, [place, "_month", *SALTS])
        .where((F.col("_from") <= F.col("_at")) & (F.col("_at") < F.col(asof_time)))
        .select(entity, asof_time, "dist_m", event_id)
    )


def prior_years(asof: DataFrame, panel: DataFrame, entity: str, asof_time: str, year: str,
                years: int = 3) -> DataFrame:
    """Panel rows of the ``years`` calendar years before each as-of date (equi-join on year)."""
    last = F.year(asof_time) - 1
    wanted = asof.select(entity, asof_time).distinct() \
        .withColumn(year, F.explode(F.sequence(last - years + 1, last)))
    return wanted.join(panel, [entity, year])


def lookback_average(asof: DataFrame, series: DataFrame, asof_time: str, series_time: str,
                     values: dict[str, str], weeks: int = 6) -> DataFrame:
    """Average of a single series over the weeks before each as-of row: rows in ``[d - N weeks, d)``.

    ``values`` maps output name to series column. The series is folded to one
    row per day and averages are formed once per distinct as-of moment: from the
    days that lie whole in its window and, where moments have a time of day, the
    rows of the two days that do not. Null and NaN values are missing. All as-of
    rows keep their moment even without series rows.
    """
    sums = [*[F.sum(known(series, c)).alias(f"_s_{n}") for n, c in values.items()],
            *[F.count(known(series, c)).alias(f"_c_{n}") for n, c in values.items()]]
    parts = [c for n in values for c in (f"_s_{n}", f"_c_{n}")]
    reach = _reach(asof, asof_time)
    near = _within_reach(series, series_time, reach, 0, 7 * weeks)
    folded = near.groupBy(dates.day_of(F.col(series_time)).alias("_day")).agg(*sums)
    wanted = asof.select(dates.as_moment(F.col(asof_time)).alias(asof_time)).distinct().where(F.col(asof_time).isNotNull()) \
        .withColumn("_from", F.col(asof_time) - F.make_interval(weeks=F.lit(weeks)))
    days = F.sequence(dates.day_of(F.col("_from")), dates.day_of(F.col(asof_time)), F.expr("INTERVAL 1 DAY"))
    spread = wanted.withColumn("_day", F.explode(days))
    whole = (F.col("_from") <= F.col("_day")) & (F.expr("_day + INTERVAL 1 DAY") <= F.col(asof_time))
    met = spread.where(whole).join(folded, "_day").select(asof_time, *parts)
    if reach.moments:
        at = dates.as_moment(F.col(series_time))
        single = near.groupBy(at.alias("_t")).agg(*sums).withColumn("_day", dates.day_of(F.col("_t")))
        met = met.unionByName(spread.where(~whole).join(single, "_day").where(
            (F.col("_from") <= F.col("_t")) & (F.col("_t") < F.col(asof_time))).select(asof_time, *parts))
    means = met.groupBy(asof_time).agg(*[F.try_divide(F.sum(f"_s_{n}"), F.sum(f"_c_{n}")).alias(n) for n in values])
    return asof.withColumn(asof_time, dates.as_moment(F.col(asof_time))).join(means, asof_time, "left")


def date_bounds(inspections: DataFrame, events: DataFrame, inspection_time: str, event_time: str,
                months: int) -> tuple[str, str]:
    """First and last inspection day for which events cover the look-back window; one aggregate per table."""
    at, when = dates.as_moment(F.col(inspection_time)), dates.as_moment(F.col(event_time))
    first_i, last_i, earliest = inspections.agg(
        F.min(at), F.max(at), dates.months_before(F.min(at), months)).first()
    first_e, last_e, shifted = events.agg(
        F.min(when), F.max(when), F.min(when) + F.make_interval(months=F.lit(months))).first()
    low = first_i if first_e <= earliest else shifted
    high = last_i if last_i <= last_e else last_e
    return f"{low:%Y-%m-%d}", f"{high:%Y-%m-%d}"


def within_bounds(inspections: DataFrame, asof_time: str, bounds: tuple[str, str]) -> DataFrame:
    """Inspections between the two bounds, both ends included (bounds are days at midnight)."""
    low, high = (F.lit(b).cast("timestamp_ntz") for b in bounds)
    return inspections.where(F.col(asof_time).between(low, high))
