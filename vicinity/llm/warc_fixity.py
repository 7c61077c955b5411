"""Operator 7: Merkle fixity audit of WARC replicas.

A replica is a set of files with records at offsets. A leaf is the digest of a
record's bytes. A node covers a range of record numbers of one file, which in an
intact file is a range of offsets: its digest is made of those below it in the order
in which they lie in the file, with their numbers and with how many records of other
nodes lie between them. So a record that is damaged, lost, added or moved changes
all digests above it. Above the nodes of a file are ranges of files, up to one root.

Each replica's tree is built on its own, leaves inside the lowest nodes. Then
roots are compared, and of nodes that differ only the children are read, down to
the records. A node gathers at most ``FANOUT`` digests; records of a file are laid
in order by one task, as WARC files are cut at about a gigabyte.

Rows: null urls and bodies are empty; records without a number take no part, and
those without a file are one file. Rows that repeat a number in a file make one
leaf of all their digests at the first of their offsets. Records without a column ``offset``
lie in the order of their numbers. Of a moved record all that lie between its old and new
place in their node are reported too; one that lies in another file is reported once, in the first
replica's file. Two empty replicas agree. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vicinity.llm.common import text_of
from vicinity.session import stable

#: Bits of the fanout and of the records in a file.
FANOUT_BITS, FILE_BITS = 5, 10
FANOUT = 1 << FANOUT_BITS
DAMAGED, MISSING, SURPLUS, MOVED = "damaged", "missing", "surplus", "moved"
#: Stands for the file of records that have none.
NO_FILE = -(1 << 62)


def warc_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """number, file and record (the record as text): one response record per page."""
    body = text_of(body_col)
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:record:"), F.col(id_col).cast("string"),
                    F.lit(">\r\nWARC-Target-URI: "), text_of(url_col), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
                    F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    number = F.col(id_col).cast("long")
    return pages.where(F.col(id_col).isNotNull()).select(
        number.alias("number"), F.shiftright(number, FILE_BITS).alias("file"), F.concat(head, body, F.lit("\r\n\r\n")).alias("record"))


def leaves(records: DataFrame) -> DataFrame:
    """file, number, bytes, digest, offset and place of each record, rows of a file in one partition."""
    given = F.col("offset").cast("long") if "offset" in records.columns else F.lit(None).cast("long")
    read = records.where("number is not null").select(
        F.coalesce(F.col("file").cast("long"), F.lit(NO_FILE)).alias("file"), "number", given.alias("given"),
        F.octet_length("record").cast("long").alias("size"), F.sha2(F.coalesce("record", F.lit("")), 256).alias("d"))
    one = read.repartition("file").groupBy("file", "number").agg(
        F.sum(F.coalesce("size", F.lit(0))).alias("bytes"), F.count("*").alias("rows"), F.min("d").alias("least"),
        F.max("d").alias("most"), F.bit_xor(F.xxhash64("d")).alias("mixed"), F.min("given").alias("given"))
    digest = F.when(F.col("rows") == 1, F.col("least")).otherwise(
        F.sha2(F.concat_ws("|", F.lit("several"), "rows", "least", "most", "mixed"), 256))
    order = Window.partitionBy("file").orderBy(F.col("given").asc_nulls_last(), "number")
    laid = F.coalesce("given", F.sum("bytes").over(order) - F.col("bytes"))
    return one.select("file", "number", "bytes", digest.alias("digest"), laid.alias("offset"), (F.row_number().over(order) - 1).alias("place"))


def lowest_nodes(records: DataFrame) -> DataFrame:
    """file, node, digest, place and the leaves (``kids``) of each range of ``FANOUT`` numbers."""
    node = F.shiftright("number", FANOUT_BITS)
    kids = F.sort_array(F.collect_list(F.struct("place", "number", "digest", "bytes", "offset")))
    nodes = leaves(records).groupBy("file", node.alias("node")).agg(kids.alias("kids"))
    between = F.transform("kids", lambda k, i: F.when(i == 0, 0).otherwise(k["place"] - F.get("kids", i - 1)["place"] - 1))
    kids = F.zip_with("kids", between, lambda k, gap: F.struct(*[k[c].alias(c) for c in ("place", "number", "digest", "bytes", "offset")], gap.alias("gap")))
    return stable(nodes.select("file", "node", F.col("kids")[0]["place"].alias("place"), kids.alias("kids")).withColumn(
        "digest", F.sha2(F.array_join(F.transform("kids", lambda k: F.concat_ws(":", k["number"], k["gap"], k["digest"])), ","), 256)))


def above(level: DataFrame, keys: list[str], node: Column) -> DataFrame:
    """The level above: nodes by ``keys``, in the order of their places."""
    kids = F.sort_array(F.collect_list(F.struct("place", "node", "digest")))
    text = F.array_join(F.transform(kids, lambda k: F.concat_ws(":", k["node"], k["digest"])), ",")
    return stable(level.withColumn("_up", node).groupBy(*keys, "_up").agg(F.min("place").alias("place"), F.sha2(text, 256).alias("digest"))
                  .withColumnRenamed("_up", "node"))


def widest(levels: list[DataFrame], keys: list[str]) -> int:
    """Most nodes, by their numbers, that one more level would have to gather."""
    spans = [lv.groupBy(*keys).agg((F.max("node") - F.min("node")).alias("n")).agg(F.max("n")).first()[0] for lv in levels]
    return max((s for s in spans if s is not None), default=0)


def trees(first: DataFrame, second: DataFrame) -> list[list[DataFrame]]:
    """Levels of both replicas' trees, lowest first: nodes of files, the files, ranges of files, and the root."""
    up = F.shiftright("node", FANOUT_BITS)
    levels = [[lowest_nodes(side) for side in (first, second)]]
    while widest(levels[-1], ["file"]) >= FANOUT:
        levels.append([above(lv, ["file"], up) for lv in levels[-1]])
    levels.append([above(lv, ["file"], F.lit(0)).select(F.col("file").alias("node"), F.col("file").alias("place"), "digest") for lv in levels[-1]])
    while widest(levels[-1], []) >= FANOUT:
        levels.append([above(lv.withColumn("place", F.col("node")), [], up) for lv in levels[-1]])
    levels.append([above(lv.withColumn("place", F.col("node")), [], F.lit(0)) for lv in levels[-1]])
    return levels


def side_by_side(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows of both replicas with the same keys: ``<column>_a`` and ``<column>_b``, null where a replica has none."""
    left, right = (df.select(*keys, *[F.col(c).alias(f"{c}_{s}") for c in columns]) for df, s in ((a, "a"), (b, "b")))
    return left.join(right, keys, "full")


def differing(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return stable(side_by_side(a, b, keys, ["digest"]).where(~F.col("digest_a").eqNullSafe(F.col("digest_b"))).select(*keys))


def suspect_nodes(levels: list[list[DataFrame]]) -> DataFrame:
    """file and node of the lowest nodes that differ, found from the root down; children of equal nodes are not read."""
    in_file = [k for k, (lv, _) in enumerate(levels) if "file" in lv.columns]
    found = differing(*levels[-1], ["node"])
    for k in range(len(levels) - 2, in_file[-1], -1):
        parent = F.lit(0) if k == len(levels) - 2 else F.shiftright("node", FANOUT_BITS)
        parents = found.withColumnRenamed("node", "_up")
        found = differing(*[lv.withColumn("_up", parent.cast("long")).join(parents.withColumn("_up", F.col("_up").cast("long")), "_up", "left_semi")
                            for lv in levels[k]], ["node"])
    files = found.withColumnRenamed("node", "file")
    found = differing(*[lv.join(files, "file", "left_semi") for lv in levels[in_file[-1]]], ["file", "node"])
    for k in reversed(in_file[:-1]):
        parents = found.withColumnRenamed("node", "_up")
        found = differing(*[lv.withColumn("_up", F.shiftright("node", FANOUT_BITS)).join(parents, ["file", "_up"], "left_semi") for lv in levels[k]],
                          ["file", "node"])
    return found


def audit(first: DataFrame, second: DataFrame) -> DataFrame:
    """One row per record that differs: file, number, offset and bytes in the first replica, status, both digests.

    ``first`` and ``second`` have number, file and record, and may have offset. The offset is null for surplus records.
    """
    levels = trees(first, second)
    suspects = suspect_nodes(levels)
    sides = [lv.join(suspects, ["file", "node"], "left_semi").select("file", "node", F.inline("kids")) for lv in levels[0]]
    both = side_by_side(*sides, ["file", "node", "number"], ["place", "digest", "bytes", "offset", "gap"])
    # A node has at most FANOUT leaves on either side.
    common = F.col("place_a").isNotNull() & F.col("place_b").isNotNull()
    rank = lambda side: F.sum(common.cast("int")).over(Window.partitionBy("file", "node").orderBy(F.col(f"place_{side}").asc_nulls_last()))
    moved = common & ((rank("a") != rank("b")) | (F.col("gap_a") != F.col("gap_b")))
    status = (F.when(F.col("digest_b").isNull(), MISSING).when(F.col("digest_a").isNull(), SURPLUS)
              .when(F.col("digest_a") != F.col("digest_b"), DAMAGED).when(moved, MOVED))
    found = both.withColumn("status", status).where("status is not null")
    # The same record missing in one file and surplus in another has been moved.
    same = Window.partitionBy("number", F.coalesce("digest_a", "digest_b"))
    elsewhere = (F.count(F.when(F.col("status") == MISSING, 1)).over(same) > 0) & (F.count(F.when(F.col("status") == SURPLUS, 1)).over(same) > 0)
    found = found.withColumn("elsewhere", elsewhere).where(~(F.col("elsewhere") & (F.col("status") == SURPLUS)))
    return found.select(
        F.when(F.col("file") != NO_FILE, F.col("file")).alias("file"), "number", F.col("offset_a").alias("offset"), F.col("bytes_a").alias("bytes"),
        F.when(F.col("elsewhere") & (F.col("status") == MISSING), MOVED).otherwise(F.col("status")).alias("status"), "digest_a", "digest_b")


def aged_replica(records: DataFrame) -> DataFrame:
    """A replica as years on disks may leave it: some records with one changed sign, some cut short, some lost."""
    n = F.col("number")
    changed = F.concat(F.expr("left(record, length(record) - 5)"), F.lit("?"), F.expr("right(record, 4)"))
    record = F.when(n % 97 == 3, changed).when(n % 89 == 7, F.expr("left(record, length(record) div 2)")).otherwise(F.col("record"))
    return records.where(n % 101 != 5).withColumn("record", record)
