"""Overlap between top lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinity.session import stable

#: Lists that meet as many others in one task.
BLOCK_LISTS = 1000


def list_overlap(lists: DataFrame, list_id: str, member: str, jaccard: bool = False) -> DataFrame:
    """Overlap of every pair of lists: ``(list_a, list_b, shared, similarity)``, both ways.

    Share is taken of the list that comes first by name and mirrored; with
    ``jaccard`` it is shared over union. Members are folded to the set of lists
    they are on, so the pairs per member are bounded by the number of lists.
    """
    rows = lists.select(list_id, member).distinct()
    sizes = rows.groupBy(list_id).agg(F.count(F.lit(1)).alias("_n"))
    on = rows.groupBy(member).agg(F.array_sort(F.collect_set(list_id)).alias("_lists"))
    pairs = (
        on.select(F.explode("_lists").alias("list_a"), "_lists")
        .select("list_a", F.explode("_lists").alias("list_b"))
        .groupBy("list_a", "list_b").agg(F.count(F.lit(1)).alias("shared"))
    )
    sizes = stable(sizes)
    blocks = -(-sizes.count() // BLOCK_LISTS)
    own = F.pmod(F.xxhash64(list_id), F.lit(max(blocks, 1))).cast("int")
    # All pairs are the result: blocks of lists meet blocks of lists.
    left = sizes.select(F.col(list_id).alias("list_a"), F.col("_n").alias("_na"), own.alias("_i"),
                        F.explode(F.sequence(F.lit(0), F.lit(max(blocks, 1) - 1))).alias("_j"))
    right = sizes.select(F.col(list_id).alias("list_b"), F.col("_n").alias("_nb"), own.alias("_j"),
                         F.explode(F.sequence(F.lit(0), F.lit(max(blocks, 1) - 1))).alias("_i"))
    full = left.join(right, ["_i", "_j"]).join(pairs, ["list_a", "list_b"], "left").fillna(0, subset=["shared"])
    first = F.when(F.col("list_a") <= F.col("list_b"), F.col("_na")).otherwise(F.col("_nb"))
    whole = F.col("_na") + F.col("_nb") - F.col("shared") if jaccard else first
    return full.select("list_a", "list_b", "shared", (F.col("shared") / whole).alias("similarity"))
