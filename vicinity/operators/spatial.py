"""Distance and containment joins on plain coordinate columns.

Points are ``x, y`` columns in feet, polygons are ``ring`` columns
(``array<struct<x,y>>``, closed or open). Every join is an equi-join on a grid
cell with the exact predicate as a residual, so Catalyst plans a hash or
sort-merge join instead of a nested loop.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from vicinity.functions import geo
from vicinity.operators import ring_pairs
from vicinity.operators.near_sets import kernel as near_kernel

FEET_PER_METRE = 3.281
HOT_CELL_ROWS = 20_000
#: A cell's side, in distances, where sets of near points are looked for.
CELL_REACHES = 2


def cell_of(value: Column, size: float) -> Column:
    return F.floor(value / F.lit(float(size))).cast("long")


def around(cell: Column) -> Column:
    return F.explode(F.sequence(cell - 1, cell + 1))


def split_hot_keys(build: DataFrame, probe: DataFrame, keys: list[str], build_id: list[str],
                   probe_id: list[str], rows_per_split: int = HOT_CELL_ROWS) -> tuple[DataFrame, DataFrame]:
    """Split join keys that hold more than ``rows_per_split`` rows on either side.

    Adds ``_salt_b`` and ``_salt_p`` to both sides, to be joined with the keys.
    Rows of a hot key are spread over the splits of their own side by a hash of
    their id and repeated over the splits of the other side, so one join task
    meets at most ``rows_per_split`` rows of each. The list of hot keys is a
    plain join side: Spark broadcasts it only when it is small at run time. Both
    sides come back spread over the keys in all shuffle partitions, as few bytes
    of a cell are much work and partitions must not be put together by their size.
    """
    spread = int(build.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def crowded(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows_per_split) \
            .select(*keys, F.ceil(F.col("_n") / rows_per_split).cast("int").alias(name))

    hot = crowded(build, "_splits_b").join(crowded(probe, "_splits_p"), keys, "full")
    one = F.lit(1)
    splits_b, splits_p = F.coalesce("_splits_b", one), F.coalesce("_splits_p", one)

    def salted(df: DataFrame, mine: str, mine_splits: Column, other: str, other_splits: Column,
               ids: list[str]) -> DataFrame:
        return (
            df.join(hot, keys, "left")
            .withColumn(mine, F.pmod(F.xxhash64(*ids), mine_splits).cast("int"))
            .withColumn(other, F.explode(F.sequence(F.lit(0), other_splits - 1)))
            .drop("_splits_b", "_splits_p")
            .repartition(spread, *keys, *SALTS)
        )

    return (salted(build, "_salt_b", splits_b, "_salt_p", splits_p, build_id),
            salted(probe, "_salt_p", splits_p, "_salt_b", splits_b, probe_id))


SALTS = ["_salt_b", "_salt_p"]


def located(df: DataFrame, cols: list[str], side: str) -> DataFrame:
    """The chosen columns of rows that have a place, and the place as two numbers."""
    whole = {f.name for f in df.schema if isinstance(f.dataType, T.IntegralType)}
    real = {f.name for f in df.schema if isinstance(f.dataType, T.FractionalType) and not isinstance(f.dataType, T.DecimalType)}
    kind = lambda c: F.col(c).cast("long") if c in whole else F.col(c) if c in real else F.col(c).cast("double")
    known = " AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in ("x", "y"))
    return df.where(known).select(*cols, kind("x").alias(f"{side}x"), kind("y").alias(f"{side}y"))


def near_sets(left: DataFrame, right: DataFrame, left_cols: list[str], right_cols: list[str],
              metres: float, rows_per_split: int = HOT_CELL_ROWS) -> DataFrame:
    """Pairs of points at most ``metres`` apart, as rows of two sets that are near each other as a whole.

    ``_left`` holds the chosen columns with ``_lx, _ly``, ``_right`` those with ``_rx, _ry``; each pair lies in
    one row, see :mod:`near_sets`. :func:`set_pairs` gives the pairs. ``right`` is repeated over the cells
    it reaches, so pass the smaller side there. Dense cells are split, see :func:`split_hot_keys`.
    """
    feet = metres * FEET_PER_METRE
    reach = max(feet, 1.0) * 1.000001
    size = CELL_REACHES * reach

    build, probe = located(left, left_cols, "_l"), located(right, right_cols, "_r")
    kinds = [T.ArrayType(df.schema) for df in (build, probe)]
    build = build.withColumn("_cx", cell_of(F.col("_lx"), size)).withColumn("_cy", cell_of(F.col("_ly"), size))
    reached = lambda c: F.explode(F.sequence(cell_of(F.col(c) - reach, size), cell_of(F.col(c) + reach, size)))
    probe = probe.withColumn("_cx", reached("_rx")).withColumn("_cy", reached("_ry"))
    build, probe = split_hot_keys(
        build, probe, ["_cx", "_cy"], ["_lx", "_ly", *left_cols], ["_rx", "_ry", *right_cols], rows_per_split)
    out = T.StructType([T.StructField("_left", kinds[0]), T.StructField("_right", kinds[1])])
    run = near_kernel(left_cols, right_cols, feet * feet, to_arrow_schema(out))
    build, probe = (df.groupBy("_cx", "_cy", *SALTS) for df in (build, probe))
    return build.cogroup(probe).applyInArrow(run, out)


def set_pairs(sets: DataFrame) -> DataFrame:
    """The pairs that rows of :func:`near_sets` hold: the chosen columns and ``dist_m``."""
    left, right = ([f.name for f in sets.schema[c].dataType.elementType][:-2] for c in ("_left", "_right"))
    dx, dy = F.col("_l._lx") - F.col("_r._rx"), F.col("_l._ly") - F.col("_r._ry")
    return sets.select(F.explode("_left").alias("_l"), "_right").select("_l", F.explode("_right").alias("_r")).select(
        *[F.col(side).getField(c).alias(c) for side, cols in (("_l", left), ("_r", right)) for c in cols],
        (F.sqrt((dx * dx + dy * dy).cast("double")) / FEET_PER_METRE).alias("dist_m"))


def point_edges(left: DataFrame, right: DataFrame, left_cols: list[str], right_cols: list[str],
                metres: float, rows_per_split: int = HOT_CELL_ROWS) -> DataFrame:
    """Pairs of points at most ``metres`` apart: the chosen columns and ``dist_m``.

    Pass the smaller side as ``right``. The pairs become rows only here, see :func:`near_sets`.
    """
    return set_pairs(near_sets(left, right, left_cols, right_cols, metres, rows_per_split))


@dataclass(frozen=True)
class NearPoints:
    """The proximity table of two point tables by its rule: what is near lies at most ``metres`` apart.

    Operators that sum over what is near read the points themselves, so the pairs,
    whose number is the product of both tables, need not become rows. ``edges``
    gives them where they are wanted.
    """

    left: DataFrame
    right: DataFrame
    metres: float

    def edges(self, left_cols: list[str], right_cols: list[str]) -> DataFrame:
        return point_edges(self.left, self.right, left_cols, right_cols, self.metres)


def neighbour_counts(subjects: DataFrame, places: DataFrame, subject_id: str, place_id: str,
                     metres: float, include_self: bool = False,
                     rows_per_split: int = HOT_CELL_ROWS) -> DataFrame:
    """Number of places within ``metres`` of each subject: ``(subject_id, parcels)``.

    Places at the same point are folded into one weighted point first, so a
    crowded address costs one row. With ``include_self=False`` the subject
    itself is left out and an isolated subject counts 1, as an outer join with
    ``count(*)`` gives.
    """
    crowd = places.groupBy("x", "y").agg(F.count(F.lit(1)).alias("_weight"))
    spots = subjects.select("x", "y").distinct() \
        .select("x", "y", F.col("x").alias("_sx"), F.col("y").alias("_sy"))
    near = (
        point_edges(crowd, spots, ["_weight"], ["_sx", "_sy"], metres, rows_per_split)
        .groupBy(F.col("_sx").alias("x"), F.col("_sy").alias("y")).agg(F.sum("_weight").alias("_all"))
    )
    counted = subjects.select(subject_id, "x", "y").join(near, ["x", "y"], "left") \
        .withColumn("_all", F.coalesce("_all", F.lit(0)))
    if include_self:
        return counted.select(subject_id, F.col("_all").alias("parcels"))
    own = places.groupBy(F.col(place_id).alias(subject_id)).agg(F.count(F.lit(1)).alias("_own"))
    others = F.col("_all") - F.coalesce("_own", F.lit(0))
    return (
        counted.join(own, subject_id, "left")
        .select(subject_id, F.greatest(others, F.lit(1)).cast("long").alias("parcels"))
    )


def _leveled(df: DataFrame, size: float, grown: float = 0.0) -> DataFrame:
    """Add the bounds and the level: cells of ``size * 2^level`` are as large as the box, so it touches at most 2 x 2 of them."""
    boxed = geo.with_bounds(df).where("min_x IS NOT NULL")
    if grown:
        boxed = boxed.withColumns({c: F.col(c) - grown for c in ("min_x", "min_y")} | {c: F.col(c) + grown for c in ("max_x", "max_y")})
    extent = F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y"), F.lit(float(size)))
    return boxed.withColumn("_level", F.ceil(F.log2(extent / F.lit(float(size)))).cast("int"))


def _at_level(value: Column, size: float, level: Column) -> Column:
    return F.floor(value / (F.lit(float(size)) * F.pow(F.lit(2.0), level))).cast("long")


def _box_cells(df: DataFrame, size: float, level: str = "_level") -> DataFrame:
    """Repeat each polygon row over the cells of a level that its bounding box touches."""
    span = lambda low, high: F.explode(F.sequence(*[_at_level(F.col(c), size, F.col(level)) for c in (low, high)]))
    return df.withColumn("_cx", span("min_x", "max_x")).withColumn("_cy", span("min_y", "max_y"))


def _strips(df: DataFrame, size: float) -> DataFrame:
    """Repeat each polygon row over the vertical strips it touches: ``_strip`` and ``_edges``, its edges there."""
    span = F.sequence(cell_of(F.col("min_x"), size), cell_of(F.col("max_x"), size))
    low = F.col("_strip") * F.lit(float(size))
    return df.withColumn("_all", geo.sloped_edges(F.col("ring"))).drop("ring").withColumn("_strip", F.explode(span)) \
        .withColumn("_edges", F.filter("_all", lambda e: (e.x0 < low + float(size)) & (e.x1 > low))).drop("_all")


def points_in_polygons(points: DataFrame, polygons: DataFrame, polygon_cols: list[str],
                       cell: float) -> DataFrame:
    """Inner join of points with the polygons that contain them (even-odd rule).

    Polygons lie on levels by their size. A polygon has one row per strip of
    ``cell`` feet and cell of its level, with its edges in the strip, so a large
    polygon has as many rows as it has strips, however many points it holds; a
    point has one row per level and is tested against the edges of its strip only.
    """
    shaped = _leveled(polygons.select(*polygon_cols, "ring"), cell)
    span = F.sequence(*[_at_level(F.col(c), cell, F.col("_level")) for c in ("min_y", "max_y")])
    probe = _strips(shaped, cell).where(F.size("_edges") > 0).withColumn("_cy", F.explode(span))
    # The levels of a table's polygons: a few numbers, as a level doubles the size.
    sizes = shaped.groupBy("_level").agg(F.max(F.size("ring"))).collect()
    levels = F.array(*[F.lit(r[0]) for r in sorted(sizes)]).cast("array<int>")
    build = points.withColumn("_level", F.explode(levels)).withColumn("_strip", cell_of(F.col("x"), cell)) \
        .withColumn("_cy", _at_level(F.col("y"), cell, F.col("_level")))
    keys = ["_level", "_strip", "_cy"]
    build, probe = split_hot_keys(build, probe, keys, ["x", "y"], polygon_cols)
    x, y = F.col("x"), F.col("y")
    in_box = x.between(F.col("min_x"), F.col("max_x")) & y.between(F.col("min_y"), F.col("max_y"))
    kept = [c for c in points.columns if c not in polygon_cols]
    above = geo.edges_above(F.col("_edges"), x, y, max((r[1] for r in sizes), default=0))
    return (
        build.join(probe, [*keys, *SALTS])
        .where(in_box & (above % 2 == 1))
        .select(*kept, *polygon_cols)
    )


def polygons_within(inner: DataFrame, outer: DataFrame, inner_cols: list[str], outer_cols: list[str],
                    cell: float) -> DataFrame:
    """Inner polygons that lie inside an outer polygon.

    The pair is kept when the shared area equals the inner area, which also
    holds for rings that touch the border.
    """
    shared = polygon_overlaps(inner, outer, inner_cols, outer_cols, cell)
    whole = F.abs(F.col("overlap_area") - F.col("left_area")) <= F.lit(1e-9) * F.col("left_area")
    return shared.where(whole).select(*inner_cols, *outer_cols)


def _kinds_of(df: DataFrame) -> tuple[list[int], bool, bool]:
    """Levels of a table's polygons, whether some are not plain, and whether some repeat an id."""
    rows = df.groupBy("_level").agg(F.min("_plain"), F.max("_repeats")).collect()
    return sorted(r[0] for r in rows), not all(r[1] for r in rows), any(r[2] for r in rows)


def _meeting_boxes(left: DataFrame, right: DataFrame, left_cols: list[str], right_cols: list[str], cell: float,
                   levels: tuple[list[int], list[int]], carried: list[str]) -> DataFrame:
    """Pairs of leveled polygons whose boxes overlap, ``carried`` columns of the sides as ``_l_`` and ``_r_``.

    A pair meets on the level of its larger polygon, in the cell that holds the
    lower corner of the shared box, so each pair comes once. A polygon has at most
    four rows for each level of the other table.
    """
    box = ["_level", "min_x", "min_y", "max_x", "max_y"]

    def spread(df: DataFrame, cols: list[str], side: str, levels: list[int]) -> DataFrame:
        own = df.select(*cols, *[F.col(c).alias(f"{side}{c}") for c in [*box, *carried]], *box[1:])
        larger = F.filter(F.array(*[F.lit(n) for n in levels]).cast("array<int>"), lambda n: n > F.col(f"{side}_level"))
        at = own.withColumn("_at", F.explode(F.array_union(F.array(f"{side}_level"), larger)))
        return _box_cells(at, cell, "_at").drop(*box[1:])

    a = spread(left, left_cols, "_l_", levels[1])
    b = spread(right, right_cols, "_r_", levels[0])
    a, b = split_hot_keys(a, b, ["_at", "_cx", "_cy"], left_cols, right_cols)
    low_x, low_y = F.greatest("_l_min_x", "_r_min_x"), F.greatest("_l_min_y", "_r_min_y")
    high_x, high_y = F.least("_l_max_x", "_r_max_x"), F.least("_l_max_y", "_r_max_y")
    home = (F.col("_at") == F.greatest("_l__level", "_r__level")) \
        & (F.col("_cx") == _at_level(low_x, cell, F.col("_at"))) & (F.col("_cy") == _at_level(low_y, cell, F.col("_at")))
    return a.join(b, ["_at", "_cx", "_cy", *SALTS]).where(home & (low_x < high_x) & (low_y < high_y)).select(
        *left_cols, *right_cols, *[f"{side}{c}" for c in carried for side in ("_l_", "_r_")],
        low_x.alias("_low"), high_x.alias("_high"), F.least("_l_min_y", "_r_min_y").alias("_base"))


def _shaped(df: DataFrame, cols: list[str], cell: float, grown: float = 0.0) -> DataFrame:
    """Leveled polygons with ``_area``, ``_flat`` (the ring), ``_plain`` (few corners) and ``_repeats`` (its id is not its own)."""
    rows = df.select(*cols, "ring").withColumns({
        "_area": geo.area(F.col("ring")), "_flat": ring_pairs.flat(F.col("ring")), "_plain": ring_pairs.small(F.col("ring")),
        "_repeats": F.count(F.lit(1)).over(Window.partitionBy(*cols)) > 1})
    return _leveled(rows, cell, grown)


def polygon_overlaps(left: DataFrame, right: DataFrame, left_cols: list[str], right_cols: list[str],
                     cell: float) -> DataFrame:
    """Pairs of polygons with a positive shared area.

    Output: the id columns, ``left_area``, ``right_area`` and ``overlap_area``.
    Pairs whose boxes overlap carry both rings and are measured where they meet.
    Where a ring is long, or ids do not tell the polygons of a table apart, pairs
    meet the edges of both polygons strip by strip (``cell`` feet wide), and the
    signed areas of the strips are summed. The id columns must have different names.
    """
    known = lambda cols: " AND ".join(f"`{c}` IS NOT NULL" for c in cols)
    shaped = [_shaped(df.where(known(cols)), cols, cell).withColumn("_plain", F.col("_plain") & ~F.col("_repeats"))
              for df, cols in ((left, left_cols), (right, right_cols))]
    (levels_l, odd_l, _), (levels_r, odd_r, _) = (_kinds_of(df) for df in shaped)
    rows = [df.drop("ring") for df in shaped]
    pairs = lambda a, b, carried: _meeting_boxes(a, b, left_cols, right_cols, cell, (levels_l, levels_r), carried)
    areas = [F.col("_l__area").alias("left_area"), F.col("_r__area").alias("right_area")]
    kept = [*left_cols, *right_cols, "left_area", "right_area"]
    met = pairs(*[df.where("_plain") for df in rows], ["_area", "_flat"]).select("*", *areas)
    found = ring_pairs.shared_areas(met, "_l__flat", "_r__flat", "_low", "_high", "_base", kept, "overlap_area")
    if odd_l or odd_r:
        others = pairs(rows[0].where("NOT _plain"), rows[1], ["_area"]).unionByName(
            pairs(rows[0].where("_plain"), rows[1].where("NOT _plain"), ["_area"])).select("*", *areas)
        found = found.unionByName(_overlaps_by_strips(others, *shaped, left_cols, right_cols, cell))
    # What is left where rings only touch, or are no more than lines, is no area.
    smaller = F.least("left_area", "right_area")
    return found.where((smaller > 0) & (F.col("overlap_area") > F.lit(1e-9) * smaller))


def _overlaps_by_strips(pairs: DataFrame, left: DataFrame, right: DataFrame, left_cols: list[str], right_cols: list[str],
                        cell: float) -> DataFrame:
    strips = [_strips(df, cell).select(*cols, "_strip", F.col("_edges").alias(name))
              for df, cols, name in zip((left, right), (left_cols, right_cols), ("_left", "_right"))]
    pairs = pairs.withColumn("_strip", F.explode(F.sequence(cell_of(F.col("_low"), cell), cell_of(F.col("_high"), cell))))
    met = pairs.join(strips[0], [*left_cols, "_strip"]).join(strips[1], [*right_cols, "_strip"])
    low = F.col("_strip") * F.lit(float(cell))
    part = geo.strip_shared_area(F.col("_left"), F.col("_right"), low, low + float(cell), F.col("_base"))
    return met.groupBy(*left_cols, *right_cols, "left_area", "right_area").agg(F.abs(F.sum(part)).alias("overlap_area"))


def polygon_polygon_edges(left: DataFrame, right: DataFrame, left_id: str, right_id: str, metres: float, cell: float) -> DataFrame:
    """Polygons at most ``metres`` apart: ``(left_id, right_id, dist_m)``, 0 where they touch or one holds the other.

    Polygons meet where their boxes, grown by half the distance, overlap, and
    are measured there. Long rings meet by their edges instead.
    """
    feet = metres * FEET_PER_METRE
    size = float(max(cell, feet, 1.0))
    shaped = [_shaped(df, [key], size, feet * 0.5000005 + 1e-6) for df, key in ((left, left_id), (right, right_id))]
    (levels_l, odd_l, again_l), (levels_r, odd_r, again_r) = (_kinds_of(df) for df in shaped)
    met = _meeting_boxes(*[df.drop("ring").where("_plain") for df in shaped], [left_id], [right_id], size, (levels_l, levels_r), ["_flat"])
    near = ring_pairs.squared_distances(met, "_l__flat", "_r__flat", [left_id, right_id], "_d").where(F.col("_d") <= feet * feet)
    if odd_l or odd_r:
        for a, b in (("NOT _plain", "TRUE"), ("_plain", "NOT _plain")):
            near = near.unionByName(_edges_apart(shaped[0].where(a), shaped[1].where(b), left_id, right_id, feet, cell, size))
    if odd_l or odd_r or again_l or again_r:
        near = near.groupBy(left_id, right_id).agg(F.min("_d").alias("_d"))
    return near.select(left_id, right_id, (F.sqrt("_d") / FEET_PER_METRE).alias("dist_m"))


def _edges_apart(left: DataFrame, right: DataFrame, left_id: str, right_id: str, feet: float, cell: float, size: float) -> DataFrame:
    """Pairs of edges at most ``feet`` apart, and pairs of which one holds the other: ``(left_id, right_id, _d)`` squared.

    Edges are cut at the borders of strips of ``size`` feet and meet in grid
    cells, those of the right side in all cells within the distance. Where one polygon
    holds the other, a corner of the inner one lies in the outer one.
    """
    def pieces(df: DataFrame, key: str, name: str, reach: float) -> DataFrame:
        rows = df.select(F.col(key), F.explode(geo.ring_segments(F.col("ring"))).alias("e")).select(key, "e.*")
        strip = rows.withColumn("_s", F.explode(F.sequence(cell_of(F.col("x0"), size), cell_of(F.col("x1"), size))))
        at = lambda x: F.col("y0") + F.coalesce(F.try_divide(x - F.col("x0"), F.col("x1") - F.col("x0")), F.lit(0.0)) * (F.col("y1") - F.col("y0"))
        x0, x1 = F.greatest("x0", F.col("_s") * size), F.least("x1", (F.col("_s") + 1) * size)
        steep = F.col("x0") == F.col("x1")
        cut = strip.select(key, x0.alias("x0"), F.when(steep, F.col("y0")).otherwise(at(x0)).alias("y0"),
                           x1.alias("x1"), F.when(steep, F.col("y1")).otherwise(at(x1)).alias("y1"))
        low, high = F.least("y0", "y1") - reach, F.greatest("y0", "y1") + reach
        cells = cut.withColumn("_cx", F.explode(F.sequence(cell_of(F.col("x0") - reach, size), cell_of(F.col("x1") + reach, size)))) \
            .withColumn("_cy", F.explode(F.sequence(cell_of(low, size), cell_of(high, size))))
        return cells.select(key, "_cx", "_cy", *[F.col(c).alias(f"{name}{c}") for c in ("x0", "y0", "x1", "y1")])

    a, b = pieces(left, left_id, "_l", 0.0), pieces(right, right_id, "_r", feet)
    a, b = split_hot_keys(a, b, ["_cx", "_cy"], [left_id, "_lx0", "_ly0"], [right_id, "_rx0", "_ry0"])
    ends = [(F.col(f"_{s}x{k}"), F.col(f"_{s}y{k}")) for s in "lr" for k in "01"]
    apart = a.join(b, ["_cx", "_cy", *SALTS]).withColumn("_d", geo.segment_distance_squared(*ends)).where(F.col("_d") <= feet * feet)
    first = F.get("ring", F.lit(0))
    corner = lambda df, key: df.select(key, first.x.alias("x"), first.y.alias("y"))
    held = [points_in_polygons(corner(inner, i), outer, [o], cell).select(left_id, right_id, F.lit(0.0).alias("_d"))
            for inner, i, outer, o in ((left, left_id, right, right_id), (right, right_id, left, left_id))]
    return apart.select(left_id, right_id, "_d").unionByName(held[0]).unionByName(held[1])


def largest_overlap(left: DataFrame, right: DataFrame, left_id: str, right_id: str, cell: float) -> DataFrame:
    """For each left polygon the right polygon that shares the most area (null if none)."""
    shared = polygon_overlaps(left, right, [left_id], [right_id], cell)
    best = shared.groupBy(left_id).agg(
        F.min_by(F.col(right_id), F.struct(-F.col("overlap_area"), F.col(right_id))).alias(right_id)
    )
    return left.select(left_id).join(best, left_id, "left")


def apportion(overlaps: DataFrame, values: DataFrame, zone: str, unit: str, fields: list[str],
              how: str = "sum", weight: str | None = None) -> DataFrame:
    """Share unit values out over zones by overlapping area.

    ``overlaps`` holds ``zone, unit, left_area, overlap_area`` with the unit on
    the left. Units with any missing field are dropped. Without ``weight`` each
    field is multiplied by its share and aggregated with ``how``. With
    ``weight`` the weight column times the share, divided by its mean within
    the zone, scales each field before aggregation.
    """
    needed = fields + ([weight] if weight else [])
    share = F.col("overlap_area") / F.col("left_area")
    rows = overlaps.join(values.select(unit, *needed).dropna(subset=needed), unit)
    fold = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max}[how]
    if weight is None:
        return rows.groupBy(zone).agg(*[fold(F.col(f) * share).alias(f) for f in fields])
    rows = rows.withColumn("_w", F.col(weight) * share)
    means = rows.groupBy(zone).agg(F.avg("_w").alias("_mean_w"))
    scaled = rows.join(means, zone)
    return scaled.groupBy(zone).agg(
        *[fold(F.col(f) * F.try_divide(F.col("_w"), F.col("_mean_w"))).alias(f) for f in fields]
    )


def with_distance_to(df: DataFrame, ring: str = "ring", x: str = "x", y: str = "y") -> DataFrame:
    """Metres from a point to a polygon on the same row: 0 inside, else to the nearest edge."""
    inside = geo.contains_point(F.col(ring), F.col(x), F.col(y))
    edge = geo.distance_to_ring(F.col(ring), F.col(x), F.col(y)) / FEET_PER_METRE
    return df.withColumn("dist_m", F.when(inside, F.lit(0.0)).otherwise(edge))


def polygon_point_edges(polygons: DataFrame, points: DataFrame, polygon_id: str, point_id: str,
                        metres: float, cell: float | None = None) -> DataFrame:
    """Points at most ``metres`` from a polygon: ``(polygon_id, point_id, dist_m)``.

    Points at the same place are measured once, and only against polygons whose
    bounding box lies within the distance.
    """
    feet = metres * FEET_PER_METRE
    size = cell or max(feet, 1.0)
    boxed = geo.with_bounds(polygons.select(polygon_id, "ring"))
    probe = (
        boxed
        .withColumn("_cx", F.explode(F.sequence(cell_of(F.col("min_x") - feet, size), cell_of(F.col("max_x") + feet, size))))
        .withColumn("_cy", F.explode(F.sequence(cell_of(F.col("min_y") - feet, size), cell_of(F.col("max_y") + feet, size))))
    )
    build = points.select("x", "y").distinct().select(
        "x", "y", cell_of(F.col("x"), size).alias("_cx"), cell_of(F.col("y"), size).alias("_cy"))
    build, probe = split_hot_keys(build, probe, ["_cx", "_cy"], ["x", "y"], [polygon_id])
    gap = lambda v, low, high: F.greatest(F.col(low) - F.col(v), F.col(v) - F.col(high), F.lit(0.0))
    dx, dy = gap("x", "min_x", "max_x"), gap("y", "min_y", "max_y")
    reach = feet * 1.000001 + 1e-6
    met = build.join(probe, ["_cx", "_cy", *SALTS]).where(dx * dx + dy * dy <= reach * reach)
    near = with_distance_to(met).where(F.col("dist_m") * FEET_PER_METRE <= feet).select("x", "y", polygon_id, "dist_m")
    return points.select(point_id, "x", "y").join(near, ["x", "y"]).select(polygon_id, point_id, "dist_m")
