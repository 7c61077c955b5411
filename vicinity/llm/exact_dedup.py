"""Operator 1: exact dedup with counting quotient filters.

Every partition builds counting quotient filters over the 64-bit fingerprints of
its texts: a fingerprint is cut into a block number, a quotient and a remainder,
and a filter keeps, for each occupied quotient, a run of sorted remainders with
their counts. No bit is dropped, so filters of one block merge without loss by
merging their sorted remainders and adding counts. Only texts whose fingerprint
has a merged count above one are compared byte by byte.

Rows: a null text counts as empty; empty texts are equal to each other. Null ids
sort below all others. Repeated rows (same id, same text) form a group like any
other and one of them stays. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinity.llm.common import GROUP_ROWS, bits_for, shuffle_partitions, text_of
from vicinity.session import stable

#: Quotient bits in a block; a block is sized so that a quotient has about one remainder.
QUOTIENT_BITS = 18
#: Repeated fingerprints up to which they go to every executor, 8 bytes each.
BROADCAST_FINGERPRINTS = 1_000_000
FILTER = "block long, quotients binary, runs binary, remainders binary, counts binary"


def filter_of(fingerprints: np.ndarray, counts: np.ndarray, rest_bits: int) -> tuple[bytes, bytes, bytes, bytes]:
    """The filter of sorted distinct fingerprints within one block."""
    remainder_bits = np.uint64(rest_bits - QUOTIENT_BITS)
    inside = fingerprints & np.uint64((1 << rest_bits) - 1)
    quotients, runs = np.unique((inside >> remainder_bits).astype(np.uint32), return_counts=True)
    remainders = inside & ((np.uint64(1) << remainder_bits) - np.uint64(1))
    return quotients.tobytes(), runs.astype(np.uint32).tobytes(), remainders.tobytes(), counts.astype(np.int64).tobytes()


def entries(quotients: bytes, runs: bytes, remainders: bytes, rest_bits: int) -> np.ndarray:
    """Quotient and remainder of every entry of a filter, joined again and in order."""
    q = np.repeat(np.frombuffer(quotients, np.uint32).astype(np.uint64), np.frombuffer(runs, np.uint32))
    return (q << np.uint64(rest_bits - QUOTIENT_BITS)) | np.frombuffer(remainders, np.uint64)


def repeated_fingerprints(thin: DataFrame, fingerprint: str, rows: int) -> DataFrame:
    """The fingerprints that occur in more than one row, as column ``fingerprint``."""
    spark = thin.sparkSession
    block_bits = min(40, max(1, bits_for(rows / GROUP_ROWS), bits_for(4 * shuffle_partitions(spark))))
    rest_bits = 64 - block_bits

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for b in batches]
        if not parts:
            return
        found, counts = np.unique(np.concatenate(parts), return_counts=True)
        blocks = found >> np.uint64(rest_bits)
        starts = np.flatnonzero(np.r_[True, blocks[1:] != blocks[:-1]]) if len(found) else np.array([], int)
        out = [(int(blocks[a]), *filter_of(found[a:b], counts[a:b], rest_bits))
               for a, b in zip(starts, np.r_[starts[1:], len(found)])]
        if out:
            yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=["block", "quotients", "runs", "remainders", "counts"]),
                                             preserve_index=False)

    def merge(filters: pd.DataFrame) -> pd.DataFrame:
        keys = np.concatenate([entries(q, r, m, rest_bits) for q, r, m in
                               zip(filters.quotients, filters.runs, filters.remainders)])
        counts = np.concatenate([np.frombuffer(c, np.int64) for c in filters.counts])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        often = np.add.reduceat(counts, starts) > 1
        block = np.uint64(filters.block.iloc[0]) << np.uint64(rest_bits)
        return pd.DataFrame({fingerprint: (keys[starts][often] | block).view(np.int64)})

    return (thin.select(fingerprint).mapInArrow(build, FILTER)
            .groupBy("block").applyInPandas(merge, f"{fingerprint} long"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id (largest id of the equal texts), group_size, kept, text_sha256."""
    read = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    read = read.select("doc_id", "text", F.xxhash64("text").alias("fingerprint"), F.sha2("text", 256).alias("sha"))
    thin = stable(read.select("doc_id", "fingerprint", "sha", F.monotonically_increasing_id().alias("row")))
    often = stable(repeated_fingerprints(thin, "fingerprint", thin.count()))
    # A checked number of fingerprints spares the other texts a shuffle; beyond it both sides are shuffled.
    often = F.broadcast(often) if often.count() <= BROADCAST_FINGERPRINTS else often
    # Verification: grouping by the text itself compares bytes; the map-side combine folds hot groups.
    equal = (read.join(often, "fingerprint", "left_semi").groupBy("sha", "text").agg(F.count("*").alias("equal_texts"))
             .select("sha", "equal_texts"))
    groups = (thin.join(often, "fingerprint", "left_semi").groupBy("sha")
              .agg(F.count("*").alias("group_size"), F.max(F.struct("doc_id", "row")).alias("last")))
    # Stored, so that the last join has an exchange of its own on both sides, whose hot partitions can be split.
    groups = stable(groups.join(equal, "sha").where("group_size > 1").select(
        "sha", F.when(F.col("group_size") == F.col("equal_texts"), F.col("group_size")).otherwise(
            F.raise_error(F.lit("texts that differ have one digest"))).alias("group_size"), "last"))
    alone = F.col("last").isNull()
    return thin.join(groups, "sha", "left").select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("last.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("last.row") == F.col("row"), F.lit(True)).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text another row with a larger id has; all columns stay as they are.

    The verdicts come from ``exact_groups``; a row is found again by id and digest,
    and of repeated rows one is taken. Rows without an id are kept only where no
    equal text has one.
    """
    stays = (exact_groups(docs, id_col, text_col).where("kept")
             .select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha")))
    names = [f"__{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    at = {c: names[i] for i, c in reversed(list(enumerate(docs.columns)))}
    plain = plain.withColumn("__key", F.sha2(text_of(at[text_col]), 256))
    kept = plain.join(stays, F.col(at[id_col]).eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__sha")), "left_semi")
    return kept.dropDuplicates([at[id_col], "__key"]).select(*names).toDF(*docs.columns)
