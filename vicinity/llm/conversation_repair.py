"""Operator 12: repair of conversation structure by lightest derivations.

A conversation is legal when the initials of its roles read ``(s?(ua)+)?``. A
repair keeps, re-roles or deletes each row and inserts empty rows; what it costs
is the sum of its edits, and among equal costs the least audit (the initials of
the edits in order) counts. Items are (rows read, state of the initials). An edit
is a deduction from one item to the next, a superior function of (cost, audit):
it adds to the cost and appends to the audit, so it never gives less than it got.
An agenda pops items by (cost, audit); the first item popped that has read all
rows in a legal state is the lightest repair (Knuth's generalisation of
Dijkstra's algorithm). Equal costs over the same rows never give an audit that
begins another one, as each insertion costs, so least audits stay least when both
are continued.

A conversation of up to ``SEGMENT`` rows is one group. Rows of a longer one are
dealt over range partitions and cut into segments; in each segment the agenda
finds the lightest derivation between every two states, and segments are joined
in order by the same functions. Its counts, cost and audit come from these
summaries; only the digest of its repaired text reads its rows one after the
other, in one task that holds a row and the audit.

Rows are taken by turn, nulls first, then by role and text in byte order. A null
id, turn, role or text stands as one space where it is text; rows without an id
are one conversation. Repeated rows are duplicates. A role without a first sign is
legal nowhere. Other columns are not read. A conversation without rows after
damage has zeros, an empty audit and the digest of an empty text; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush
from itertools import groupby
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinity.session import stable

#: Rows of a conversation that are repaired in one go.
SEGMENT = 512
#: Long conversations up to which their ids are sent to executors; beyond it rows are joined with them.
BROADCAST_LONG = 100_000
KEEP, REROLE, DELETE, INSERT, LEFT_TRUNCATED = 0, 3, 4, 3, 3
#: States: nothing kept, after a system row, after a user row, after an assistant row.
BEGIN, SYSTEM, USER, ASSISTANT = range(4)
STATES, LEGAL_ENDS = (BEGIN, SYSTEM, USER, ASSISTANT), (BEGIN, ASSISTANT)
#: What may follow by inserting or re-roling, and by keeping a row with an initial.
NEXT = {BEGIN: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
KEPT = {"s": {BEGIN: SYSTEM}, "u": {BEGIN: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
ROLE_OF = {USER: "user", ASSISTANT: "assistant"}
LEGAL_PAIRS = {"su", "ua", "au"}
BLANK, DUPLICATE, TRUNCATED = "blank", "duplicate", "truncated"
SPACES = " \t\n\x0b\x0c\r"

FACTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
REPAIRED = f"conv_id long, {FACTS}, repaired_sha256 string"
SUMMARY = ("conv_id long, segment long, first_turn long, last_turn long, turns long, first_role string, last_role string, "
           "blank long, duplicate long, truncated long, illegal long, costs array<long>, audits array<string>")
Row = tuple  # turn, role, text, fault


def edits_of(role: str, fault: str | None) -> list[tuple[int, str, dict[int, int]]]:
    """Deductions over one row: cost, initial, and the states it leads from and to."""
    still = {q: q for q in STATES}
    if fault in (BLANK, DUPLICATE):
        return [(DELETE, "D", still)]
    left = LEFT_TRUNCATED if fault == TRUNCATED else 0
    return [(KEEP + left, "K", KEPT.get(role[:1], {})), (REROLE + left, "R", NEXT), (DELETE, "D", still)]


def lightest(rows: list[Row], start: int, goals: Iterable[int], first_only: bool) -> dict[int, tuple[int, str]]:
    """(cost, audit) of the lightest derivations from ``start`` over all rows: of the first goal state, or of each one."""
    edits, end = [edits_of(role, fault) for _, role, _, fault in rows], len(rows)
    agenda, final, found = [(0, "", 0, start)], set(), {}
    wanted = set(goals)
    while agenda and wanted - found.keys():
        cost, audit, at, state = heappop(agenda)
        if (at, state) in final:
            continue
        final.add((at, state))
        if at == end and state in wanted:
            found[state] = cost, audit
            if first_only:
                break
        heappush(agenda, (cost + INSERT, audit + "I", at, NEXT[state]))
        if at < end:
            for price, initial, moves in edits[at]:
                if state in moves:
                    heappush(agenda, (cost + price, audit + initial, at + 1, moves[state]))
    return found


def replayed(rows: Iterator[Row], audit: str) -> Iterator[str]:
    """The repaired rows, as ``role:text``."""
    state = BEGIN
    for initial in audit:
        _, role, text, _ = next(rows) if initial != "I" else (None, "", "", None)
        if initial == "D":
            continue
        state = KEPT[role[:1]][state] if initial == "K" else NEXT[state]
        yield f"{role if initial == 'K' else ROLE_OF[state]}:{text}"


def digest_of(lines: Iterable[str]) -> str:
    """SHA-256 of the lines, joined by new lines."""
    digest = hashlib.sha256()
    for k, line in enumerate(lines):
        digest.update((f"\n{line}" if k else line).encode())
    return digest.hexdigest()


def gaps_of(first: int | None, last: int | None, distinct: int) -> int:
    return last - first + 1 - distinct if distinct else 0


def illegal_pairs(initials: list[str]) -> int:
    return sum(a + b not in LEGAL_PAIRS for a, b in zip(initials, initials[1:]))


def faults(rows: list[Row]) -> dict[str, int]:
    return {kind: sum(row[3] == kind for row in rows) for kind in (BLANK, DUPLICATE, TRUNCATED)}


def rows_in(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def to_batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 1024) -> Iterator[pa.RecordBatch]:
    kept = []
    for row in rows:
        kept.append(dict(zip(schema.names, row)))
        if len(kept) == size:
            yield pa.RecordBatch.from_pylist(kept, schema)
            kept = []
    if kept:
        yield pa.RecordBatch.from_pylist(kept, schema)


def arrow_schema(columns: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in columns.split(", "))])


def repair_short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole conversations, sorted: conv_id, turn, role, text, fault (blank, truncated or null)."""
    def repaired() -> Iterator[tuple]:
        for conv_id, group in groupby(rows_in(batches), key=lambda r: r[0]):
            rows, seen = [], set()
            for _, turn, role, text, fault in group:
                rows.append((turn, role, text, fault if fault == BLANK else DUPLICATE if (role, text) in seen else fault))
                seen.add((role, text))
            turns = [r[0] for r in rows if r[0] is not None]
            gaps = gaps_of(min(turns, default=None), max(turns, default=None), len({*turns}))
            (cost, audit), = lightest(rows, BEGIN, LEGAL_ENDS, True).values()
            yield (conv_id, gaps, *faults(rows).values(), illegal_pairs([r[1][:1] for r in rows]), cost, audit,
                   digest_of(replayed(iter(rows), audit)))

    yield from to_batches(repaired(), arrow_schema(REPAIRED))


def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of long conversations, sorted: conv_id, segment, turn, role, text, fault (duplicates of earlier turns known)."""
    def summaries() -> Iterator[tuple]:
        before = None
        for (conv_id, segment), group in groupby(rows_in(batches), key=lambda r: r[:2]):
            rows = []
            for row in group:
                fault = row[5]
                if fault != BLANK and before == row[:1] + row[2:5]:
                    fault = DUPLICATE
                before = row[:1] + row[2:5]
                rows.append((*row[2:5], fault))
            turns, initials = [r[0] for r in rows if r[0] is not None], [r[1][:1] for r in rows]
            between = [lightest(rows, start, STATES, False) for start in STATES]
            ends = [found.get(q) for found in between for q in STATES]
            yield (conv_id, segment, min(turns, default=None), max(turns, default=None), len({*turns}), initials[0], initials[-1],
                   *faults(rows).values(), illegal_pairs(initials), [e and e[0] for e in ends], [e and e[1] for e in ends])

    yield from to_batches(summaries(), arrow_schema(SUMMARY), 64)


def join_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Summaries of each conversation in order: its facts."""
    def joined() -> Iterator[tuple]:
        for conv_id, group in groupby(rows_in(batches), key=lambda r: r[0]):
            best, written, sums, illegal = {BEGIN: (0, "")}, [], [0, 0, 0], 0
            first = last = role = None
            distinct = 0
            for _, _, low, high, turns, first_role, last_role, *counts, inside, costs, audits in group:
                distinct += turns - (low is not None and low == last)
                first, last = low if first is None else first, high if high is not None else last
                illegal += inside + (role is not None and role + first_role not in LEGAL_PAIRS)
                role, sums = last_role, [a + b for a, b in zip(sums, counts)]
                onward = {}
                for p, (cost, audit) in best.items():
                    for q in STATES:
                        if costs[4 * p + q] is not None:
                            item = cost + costs[4 * p + q], audit + audits[4 * p + q]
                            onward[q] = min(item, onward.get(q, item))
                # What all derivations begin with is settled.
                same = commonprefix([audit for _, audit in onward.values()])
                written.append(same)
                best = {q: (cost, audit[len(same):]) for q, (cost, audit) in onward.items()}
            cost, audit = min(best[q] for q in LEGAL_ENDS if q in best)
            yield conv_id, gaps_of(first, last, distinct), *sums, illegal, cost, "".join([*written, audit])

    yield from to_batches(joined(), arrow_schema(f"conv_id long, {FACTS}"), 1)


def digest_long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each conversation its audit, then its rows in order: conv_id, place, audit, role, text."""
    def digests() -> Iterator[tuple]:
        for conv_id, group in groupby(rows_in(batches), key=lambda r: r[0]):
            audit = next(group)[2]
            yield conv_id, digest_of(replayed(((None, r[3], r[4], None) for r in group), audit))

    yield from to_batches(digests(), arrow_schema("conv_id long, repaired_sha256 string"))


def damaged(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The rows after damage by their key, conv_id, turn, role, text and ``copies`` (0, 1 or 2), one row per original row."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spaced(conv_col), F.lit(":"), spaced(turn_col)).cast("binary")) % 20
    text = (F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(spaced(text_col), "[.!?]", "")).otherwise(spaced(text_col)))
    return turns.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        F.when(kind == 4, F.lit("user")).otherwise(spaced(role_col)).alias("role"), text.alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))


def own_fault(text: Column) -> Column:
    """blank or truncated, by the text alone."""
    rest = F.rtrim(text, F.lit(SPACES))
    return F.when(rest == "", BLANK).when(~F.right(rest, F.lit(1)).isin(".", "!", "?"), TRUNCATED)


def repair_long(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """``REPAIRED`` of conversations of any length: conv_id, turn, role, text, fault."""
    seen = (rows.groupBy("conv_id", "role", F.sha2("text", 256).alias("sha"))
            .agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("first"), F.count("*").alias("n"))
            .where("n > 1").select(*(F.col(c).alias(f"seen_{c}") for c in ("conv_id", "role", "sha", "first"))))
    same = (F.col("conv_id").eqNullSafe(F.col("seen_conv_id")) & (F.col("role") == F.col("seen_role")) & (F.sha2("text", 256) == F.col("seen_sha")))
    later = F.struct(F.col("turn").isNotNull().alias("known"), "turn") > F.col("seen_first")
    fault = F.when((F.col("fault").isNull() | (F.col("fault") != BLANK)) & later, DUPLICATE).otherwise(F.col("fault"))
    known = rows.join(seen, same, "left").select("conv_id", "turn", "role", "text", fault.alias("fault"))
    # The beginning of the text is enough to deal rows in order, and equal rows stay together; the sort takes all of it.
    dealt = known.repartitionByRange("conv_id", "turn", "role", F.left("text", F.lit(32))).sortWithinPartitions("conv_id", "turn", "role", "text")
    placed = stable(dealt).withColumn("place", F.monotonically_increasing_id())
    segments = placed.select("conv_id", F.expr(f"place div {segment}").alias("segment"), "turn", "role", "text", "fault")
    summaries = segments.mapInArrow(summarise, SUMMARY)
    facts = stable(summaries.repartition("conv_id").sortWithinPartitions("conv_id", "segment").mapInArrow(join_segments, f"conv_id long, {FACTS}"))
    none = F.lit(None).cast("string")
    read = placed.select("conv_id", "place", none.alias("audit"), "role", "text").unionByName(
        facts.select("conv_id", F.lit(-1).cast("long").alias("place"), "audit", none.alias("role"), none.alias("text")))
    digests = read.repartition("conv_id").sortWithinPartitions("conv_id", "place").mapInArrow(digest_long, "conv_id long, repaired_sha256 string")
    return facts.join(digests.withColumnRenamed("conv_id", "of"), F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")


def repair(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """One row per conversation of ``rows`` (conv_id, turn, role, text, copies): its faults, the lightest repair and its digest."""
    sizes = stable(rows.groupBy("conv_id").agg(F.sum("copies").alias("rows")))
    there = (rows.where("copies > 0").withColumn("fault", own_fault(F.col("text")))
             .withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).drop("copy", "copies"))
    zero = F.lit(0).cast("long")
    empty = sizes.where("rows = 0").select("conv_id", *(zero.alias(c.split()[0]) for c in FACTS.split(", ")[:-1]), F.lit("").alias("audit"),
                                           F.sha2(F.lit(""), 256).alias("repaired_sha256"))
    long_ids = stable(sizes.where(F.col("rows") > segment).select(F.col("conv_id").alias("of")))
    number = long_ids.count()
    short = there
    if number:
        long_ids = F.broadcast(long_ids) if number <= BROADCAST_LONG else long_ids
        same = F.col("conv_id").eqNullSafe(F.col("of"))
        short, long_rows = there.join(long_ids, same, "left_anti"), there.join(long_ids, same, "left_semi")
    short = short.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(repair_short, REPAIRED)
    whole = short.unionByName(empty)
    return whole.unionByName(repair_long(long_rows, segment)) if number else whole


def damage_and_repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                      text_col: str = "text", segment: int = SEGMENT) -> DataFrame:
    """One row per conversation of ``turns``, also of those that damage leaves without rows."""
    return repair(damaged(turns, conv_col, turn_col, role_col, text_col), segment)
