"""Exact order statistics, global ranks and numbering without a single-task sort.

A missing value is a null or a NaN, here and everywhere in the library: it has no
place among quantiles and cut-offs and comes last in rankings and top lists.

Single places (quantiles, cut-offs) are found by narrowing a bracket with mergeable
sketches and exact counts: rows are never sorted or shuffled, a few values reach the
driver. Ranks, curves and numbering lay rows over range partitions with running counts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vicinity.session import stable


def known(df: DataFrame, column: str) -> Column:
    """The column with NaN read as null."""
    c = F.col(column)
    return F.when(~F.isnan(c), c) if df.schema[column].dataType.typeName() in ("double", "float") else c


def with_known(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: known(df, c) for c in columns})


#: Values of a bracket that are read one by one, and the accuracy of the sketch that narrows larger ones.
BRACKET_ROWS, ACCURACY = 1 << 14, 10_000
_SKETCHED = ("tinyint", "smallint", "int", "bigint", "float", "double", "date", "decimal")


def kth_smallest(df: DataFrame, wanted: dict[str, list[int]], held: dict[str, int] | None = None) -> dict:
    """Exact k-th smallest of the values that are not missing: ``{(column, k): value}``; places beyond them are left out.

    ``held`` may give the number of values of each column. A round asks a sketch for
    two values close around each place and counts exactly what lies below and at
    them: the place is one of the two, or its bracket shrinks to one side of them. What a sketch
    errs only costs rounds. Brackets with few rows are folded per value and read.
    """
    found: dict = {}
    sketched = [c for c in wanted if df.schema[c].dataType.simpleString().split("(")[0] in _SKETCHED]
    for c in wanted:
        if c not in sketched:
            found.update(_kth_by_order(df, c, wanted[c]))
    if not any(wanted[c] for c in sketched):
        return found
    held = held or df.agg(*[F.count(known(df, c)).alias(c) for c in sketched]).first().asDict()
    # (column, k): values above ``low`` and below ``high``, how many are at or below ``low``, how many lie between.
    brackets = {(c, k): (None, None, 0, held[c]) for c in sketched for k in wanted[c] if 1 <= k <= held[c]}
    while brackets:
        few = {at: b for at, b in brackets.items() if b[3] <= BRACKET_ROWS}
        found.update(_read_brackets(df, few))
        brackets = {at: b for at, b in brackets.items() if at not in few}
        if brackets:
            brackets, hit = _narrowed(df, brackets)
            found.update(hit)
    return found


def _inside(value: Column, low, high) -> Column:
    rule = value.isNotNull()
    rule = rule if low is None else rule & (value > F.lit(low))
    return rule if high is None else rule & (value < F.lit(high))


def _read_brackets(df: DataFrame, brackets: dict) -> dict:
    """Places of brackets with few rows, from their values."""
    found = {}
    columns = sorted({c for c, _ in brackets})
    for kind in sorted({df.schema[c].dataType.simpleString() for c in columns}):
        ranges = sorted({(c, b) for (c, _), b in brackets.items() if df.schema[c].dataType.simpleString() == kind}, key=str)
        cells = F.array(*[F.struct(F.lit(i).alias("i"), F.when(_inside(known(df, c), *b[:2]), known(df, c)).alias("v"))
                          for i, (c, b) in enumerate(ranges)])
        rows = df.select(F.explode(cells).alias("m")).where("m.v IS NOT NULL").groupBy("m.i", "m.v").agg(F.count(F.lit(1)).alias("n")).collect()
        values = {i: sorted((r["v"], r["n"]) for r in rows if r["i"] == i) for i in range(len(ranges))}
        for (c, k), b in brackets.items():
            if (c, b) in ranges:
                upto = b[2]
                for v, n in values[ranges.index((c, b))]:
                    upto += n
                    if upto >= k:
                        found[c, k] = v
                        break
    return found


def _narrowed(df: DataFrame, brackets: dict) -> tuple[dict, dict]:
    """One round: smaller brackets, and the places that were hit."""
    places = list(brackets)
    asked = []
    for i, (c, k) in enumerate(places):
        low, high, below, rows = brackets[c, k]
        near = [min(max((k - below + off) / rows, 0.0), 1.0) for off in (-2 * rows / ACCURACY, 2 * rows / ACCURACY)]
        asked.append(F.percentile_approx(F.when(_inside(known(df, c), low, high), known(df, c)), near, ACCURACY).alias(f"p{i}"))
    pivots = df.agg(*asked).first()
    counts = []
    for i, (c, _) in enumerate(places):
        for j, v in enumerate(pivots[f"p{i}"]):
            counts += [F.count(F.when(known(df, c) < F.lit(v), 1)).alias(f"lt{j}_{i}"), F.count(F.when(known(df, c) <= F.lit(v), 1)).alias(f"le{j}_{i}")]
    seen = df.agg(*counts).first()
    smaller, hit = {}, {}
    for i, (c, k) in enumerate(places):
        low, high, below, rows = brackets[c, k]
        (first, last), n = pivots[f"p{i}"], lambda name: seen[f"{name}_{i}"]  # noqa: B023
        if k <= n("lt0"):
            smaller[c, k] = (low, first, below, n("lt0") - below)
        elif k <= n("le0"):
            hit[c, k] = first
        elif k <= n("lt1"):
            smaller[c, k] = (first, last, n("le0"), n("lt1") - n("le0"))
        elif k <= n("le1"):
            hit[c, k] = last
        else:
            smaller[c, k] = (last, high, n("le1"), below + rows - n("le1"))
    return smaller, hit


def _kth_by_order(df: DataFrame, column: str, places: list[int]) -> dict:
    """The same for types that no sketch takes, from running counts over the ordered values."""
    steps = cumulative_by_value(df.select(F.col(column).alias("v")), "v", {"n": F.count(F.lit(1))})
    asked = F.array(*[F.lit(k) for k in sorted(set(places))])
    here = F.filter(asked, lambda k: (k > F.col("cum_n") - F.col("n")) & (k <= F.col("cum_n")))
    return {(column, r["k"]): r["v"] for r in steps.select("v", F.explode(here).alias("k")).collect()}


def exact_quantiles(df: DataFrame, columns: list[str], probs: list[float]) -> dict[str, list]:
    """Quantiles with linear interpolation, missing values left out: ``{column: [value per prob]}``."""
    counts = df.agg(*[F.count(known(df, c)).alias(c) for c in columns]).first().asDict()
    wanted, plan = {}, {}
    for c in columns:
        n = counts[c]
        spots = [(n - 1) * p for p in probs] if n else []
        plan[c] = [(math.floor(s) + 1, math.ceil(s) + 1, s - math.floor(s)) for s in spots]
        wanted[c] = sorted({k for low, high, _ in plan[c] for k in (low, high)})
    found = kth_smallest(df, {c: ks for c, ks in wanted.items() if ks}, counts) if any(wanted.values()) else {}
    out = {}
    for c in columns:
        out[c] = [
            float(found[(c, low)]) + (float(found[(c, high)]) - float(found[(c, low)])) * part
            for low, high, part in plan[c]
        ] or [None] * len(probs)
    return out


# --- ordered tables over range partitions ----------------------------------------

def _placed(df: DataFrame, order: list[Column]) -> DataFrame:
    """Rows in a total order over range partitions, with ``_part`` and their place ``_seq`` inside it.

    The ordered rows are checkpointed once: offsets and rows are then read from
    the same files, also when tasks run again, and the input is computed once.
    The number of ranges follows the data: adaptive execution merges small
    neighbours.
    """
    kept = stable(
        df.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id()))
    return kept.withColumns({"_part": F.shiftright("_at", 33), "_seq": F.col("_at").bitwiseAND((1 << 33) - 1)}) \
        .drop("_at")


def _offsets(placed: DataFrame, groups: list[str], sums: dict[str, Column]) -> DataFrame:
    """Totals of the partitions before each partition; one row per partition (and group)."""
    whole = placed.groupBy(*groups, "_part").agg(*[c.alias(n) for n, c in sums.items()])
    earlier = Window.partitionBy(*(groups or [F.lit(0)])).orderBy("_part") \
        .rowsBetween(Window.unboundedPreceding, -1)
    return whole.select(*groups, "_part", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(n) for n in sums])


def cumulative_by_value(df: DataFrame, value: str, sums: dict[str, Column], groups: list[str] | None = None,
                        descending: bool = False) -> DataFrame:
    """One row per distinct value with each sum and its running total ``cum_<name>``.

    Rows are folded per value first, so hot values become one row. The running
    total is a window inside a range partition plus the totals of the
    partitions before it. Groups must be few (metrics, classes). Nulls are left
    out.
    """
    groups = groups or []
    per_value = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(*[c.alias(n) for n, c in sums.items()])
    order = F.col(value).desc() if descending else F.col(value).asc()
    placed = _placed(per_value, [*[F.col(g) for g in groups], order])
    offsets = _offsets(placed, groups, {f"_o_{n}": F.sum(n) for n in sums})
    inside = Window.partitionBy(*groups, "_part").orderBy("_seq").rowsBetween(Window.unboundedPreceding, 0)
    return (
        placed.join(offsets, [*groups, "_part"])
        .select(*groups, value, *sums, *[
            (F.sum(n).over(inside) + F.col(f"_o_{n}")).alias(f"cum_{n}") for n in sums])
    )


def _run_begins():
    """Batch function that adds ``_run``, the place where the run of a row's value begins in its partition.

    It reads a partition in its order and keeps nothing of it but the last value.
    It brings all it needs with it, so executors need no package of ours.
    """
    def run(batches):
        import numpy as np
        import pyarrow as pa

        names = ["metric", "v", "_row", "_part", "_seq", "_run"]
        last, begun = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            metric, seq = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("metric", "_seq"))
            missing = batch.column("v").is_null().to_numpy(zero_copy_only=False)
            v = batch.column("v").fill_null(0.0).to_numpy(zero_copy_only=False)
            new = np.r_[True, (np.diff(metric) != 0) | (v[1:] != v[:-1]) | (missing[1:] != missing[:-1])]
            first = (metric[0], v[0], missing[0])
            if last is None or first != last:
                begun = int(seq[0])
            starts = np.where(new, seq, -1)
            starts[0] = begun
            starts = np.maximum.accumulate(starts)
            begun, last = int(starts[-1]), (metric[-1], v[-1], missing[-1])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names[:-1]], pa.array(starts)], names=names)
    return run


def with_ranks(df: DataFrame, columns: list[str]) -> DataFrame:
    """Add ``<column>_rank``: SQL ``rank()`` ascending, missing values last, over the whole table, per column.

    All columns go through one range partitioning by (column, value, row): the row
    spreads equal values over partitions, so no value is hot. The rank of a row is
    the place where the run of its value begins: inside its partition, or, for the
    run that goes on from the partition before, in an earlier one; where that is
    follows from one row per partition and column. Runs are marked while the ordered
    rows are read, so neither a hot value nor its run is brought together.
    """
    rows = stable(df).withColumn("_row", F.monotonically_increasing_id())
    cells = F.array(*[F.struct(F.lit(i).alias("metric"), known(df, c).cast("double").alias("v")) for i, c in enumerate(columns)])
    # Only numbers are laid out; the rows themselves meet their ranks once, by row.
    long = rows.select("_row", F.inline(cells))
    placed = _placed(long, [F.col("metric"), F.col("v").asc_nulls_last(), F.col("_row")]).select("metric", "v", "_row", "_part", "_seq")
    runs = placed.mapInArrow(_run_begins(), "metric int, v double, _row long, _part long, _seq long, _run long")
    # One row per partition and column from here.
    per_part = placed.groupBy("metric", "_part").agg(
        F.count(F.lit(1)).alias("n"), F.min("_seq").alias("lead"),
        F.min_by(F.struct("v"), "_seq").alias("first"), F.max_by(F.struct("v"), "_seq").alias("last"))
    last_run = placed.join(per_part.select("metric", "_part", "last"), ["metric", "_part"]).where(F.col("last.v").eqNullSafe(F.col("v"))) \
        .groupBy("metric", "_part").agg(F.min("_seq").alias("last_run"))
    along = Window.partitionBy("metric").orderBy("_part")
    before = F.coalesce(F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = per_part.join(last_run, ["metric", "_part"]).withColumn("before", before) \
        .withColumn("goes_on", F.coalesce(F.lag("last").over(along).eqNullSafe(F.col("first")), F.lit(False)))
    only = F.col("first").eqNullSafe(F.col("last"))
    begun = F.when(~(only & F.col("goes_on")), F.col("before") + F.col("last_run") - F.col("lead"))
    parts = parts.withColumn("_begun", begun).withColumn(
        "carried", F.last("_begun", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))) \
        .select("metric", "_part", "lead", "before", "goes_on", "carried")
    own = F.col("before") + F.col("_run") - F.col("lead")
    place = F.when(F.col("goes_on") & (F.col("_run") == F.col("lead")), F.col("carried")).otherwise(own) + 1
    ranked = runs.join(parts, ["metric", "_part"]).select("_row", "metric", place.alias("_rank"))
    ranks = [F.max(F.when(F.col("metric") == i, F.col("_rank"))).alias(f"{c}_rank") for i, c in enumerate(columns)]
    return rows.join(ranked.groupBy("_row").agg(*ranks), "_row").drop("_row")


def percentile_of_score(df: DataFrame, column: str) -> DataFrame:
    """Add ``<column>_percentile``: mean of the strict and weak percentile rank, in percent; none for missing values."""
    both = df.withColumns({"_up": known(df, column), "_down": -known(df, column)})
    total = both.agg(F.count("_up")).first()[0]
    ranked = with_ranks(both, ["_up", "_down"])
    below, upto = F.col("_up_rank") - 1, F.lit(total) - F.col("_down_rank") + 1
    score = (below + upto + 1) * F.lit(50.0) / F.lit(float(max(total, 1)))
    return ranked.select(*df.columns, F.when(F.col("_up").isNotNull(), score).alias(f"{column}_percentile"))


# --- numbering -----------------------------------------------------------------

def numbered(df: DataFrame, order: list[Column], name: str = "rn", start: int = 1) -> DataFrame:
    """Dense global row number in a total order, spread over range partitions."""
    placed = _placed(df, order)
    offsets = _offsets(placed, [], {"_offset": F.count(F.lit(1))})
    return placed.join(offsets, "_part") \
        .withColumn(name, F.col("_offset") + F.col("_seq") + F.lit(start)) \
        .drop("_part", "_seq", "_offset")


def continue_keys(new_rows: DataFrame, existing: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Give new rows surrogate keys that go on from the largest existing key."""
    last = existing.agg(F.max(key)).first()[0] or 0
    return numbered(new_rows, order, key, last + 1)


def top_n(df: DataFrame, score: str, key: str, n: int) -> DataFrame:
    """The ``n`` rows with the highest score, missing scores last, ties by ascending key.

    The exact cut-off score comes from running counts over the distinct scores; rows
    above it are a filter and only those at it are numbered, so no task holds the list.
    """
    if n <= 0:
        return df.limit(0)
    rows = stable(df.withColumn("_score", known(df, score)))
    steps = cumulative_by_value(rows, "_score", {"n": F.count(F.lit(1))}, descending=True)
    cut = steps.where((F.col("cum_n") - F.col("n") < n) & (F.col("cum_n") >= n)).first()
    if cut is None:
        above = rows.where(F.col("_score").isNotNull())
        level, short, there = rows.where(F.col("_score").isNull()), n - above.count(), None
    else:
        above, level = rows.where(F.col("_score") > F.lit(cut["_score"])), rows.where(F.col("_score") == F.lit(cut["_score"]))
        short, there = n - (cut["cum_n"] - cut["n"]), cut["n"]
    if short != there:
        level = numbered(level, [F.col(key)], "_rn").where(F.col("_rn") <= short).drop("_rn")
    return above.unionByName(level).drop("_score")


def top_percent(df: DataFrame, score: str, key: str, percent: float) -> DataFrame:
    """Top ``percent`` of all rows, the count rounded half to even."""
    return top_n(df, score, key, round(df.count() * percent / 100.0))


def top_per_group(df: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """First ``n`` rows of each group; Spark limits each group before the shuffle."""
    ranked = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(ranked)).where(F.col("_rn") <= n).drop("_rn")


def bin_index(value: Column, edges: list) -> Column:
    """Number of edges at or below the value."""
    total = F.lit(0)
    for edge in edges:
        total = total + F.when(value >= F.lit(edge), 1).otherwise(0)
    return F.when(value.isNotNull(), total)
