"""Operator 9: Jaccard join on word n-grams by a MinHash LSH forest.

Documents with the same set of shingles form a class, which is signed once. Each
tree of the forest has its own part of the signatures. One prefix length holds for
all trees and rows: the longest, of at most ``levels`` labels, at which a pair at
the wanted similarity shares a prefix in some tree with the target probability. So
the forest is reduced to bands of fixed length; no trie is built and no prefix is
shortened row by row. Within such a band's node
signatures are compared and a spanning forest of the pairs that may be near is
kept; its components are clusters that hold every near pair. In a cluster all
pairs are verified on their shingle sets, block against block, and only counts
and a spanning forest of the verified links leave a block. So no task gets more
than two blocks and pairs never become rows, however large a group of near
copies is.

Rows: words are split at white space; a text with fewer words than a shingle has
one shingle of all its words. Null, empty and wordless texts have none: each is a
class of its own and has no links. Repeated rows and equal texts share a class.
A null id is treated like other ids and sorts above them. A row is known by its id
and the hash of its text, so rows that share an id, or have none, are told apart;
the first row of a group by (id, hash) is the one that stays, of repeated rows one.
Other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinity.llm.common import shuffle_partitions, text_of
from vicinity.llm.components import components
from vicinity.session import stable

WORDS, SIMILARITY = 5, 0.8
#: Trees and labels in each; probability with which a pair at the similarity must meet.
TREES, LEVELS, TARGET = 24, 4, 0.99999
#: Deviations by which a near pair's share of equal labels may fall below its similarity.
DEVIATIONS = 6.15
#: Members of a trie node, and sets of a cluster, that one task compares with as many others.
NODE_BLOCK, SET_BLOCK = 512, 256
#: Rows that one group of a Python task gets, about.
NODE_ROWS, SET_ROWS = 20_000, 2_000
REMEMBERED = 120_000
_MIX = np.uint64(0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return x ^ (x >> np.uint64(32))


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        import xxhash
        value = xxhash.xxh64_intdigest(word)
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = value
        return value


@functools.lru_cache(maxsize=1)
def word_hashes() -> WordHashes:
    """One table for a worker process, so that later tasks find its words."""
    return WordHashes()


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word n-grams."""
    found = text.split()
    if not found:
        return np.empty(0, np.uint64)
    known = word_hashes()
    h = np.fromiter((known[w] for w in found), np.uint64, len(found))
    n = min(words, len(h))
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out = mixed(out + h[i:len(h) - n + 1 + i] + np.uint64(i + 1))
    return np.unique(out)


def class_of(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


@functools.lru_cache(maxsize=4)
def multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(9).integers(1 << 62, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(found: np.ndarray, labels: int) -> np.ndarray:
    """The high halves of the least multiplied hashes, one for each multiplier."""
    least = np.full(labels, np.iinfo(np.uint64).max, np.uint64)
    by = multipliers(labels)[:, None]
    for at in range(0, len(found), 2048):
        part = mixed(found[at:at + 2048] ^ np.uint64(0xA5A5A5A5))
        least = np.minimum(least, (part[None, :] * by).min(1))
    return (mixed(least) >> np.uint64(32)).astype(np.uint32)


def prefix_length(similarity: float, trees: int, levels: int, target: float) -> int:
    """Labels of the longest prefix at which a pair meets in some tree with the target probability."""
    for length in range(levels, 0, -1):
        if 1 - (1 - similarity ** length) ** trees >= target:
            return length
    return 1


def may_be_near(similarity: float, labels: int) -> float:
    """Share of equal labels from which signatures may be those of a pair at the similarity."""
    return max(0.0, similarity - DEVIATIONS * math.sqrt(similarity * (1 - similarity) / labels))


def sign(words: int, trees: int, levels: int):
    """mapInArrow function: class and signature of each document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            classes, signatures = [], []
            for cell in batch.column(1):
                found = shingles(cell.as_py(), words)
                classes.append(class_of(found) if len(found) else None)
                signatures.append(signature(found, trees * levels).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:1], batch.column(2), pa.array(classes, pa.binary()), pa.array(signatures, pa.binary())],
                                             ["doc_id", "text_hash", "class", "signature"])
    return run


class Forest:
    """Union of numbers 0..n-1; a root is the least number of its tree."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, x: int, y: int) -> None:
        a, b = self.root(x), self.root(y)
        self.parent[max(a, b)] = min(a, b)

    def stars(self) -> list[tuple[int, int]]:
        """The root of each number that is none. The same root leads in many nodes and blocks, so few edges stay distinct."""
        return [(r, x) for x in range(len(self.parent)) if (r := self.root(x)) != x]


def blocked(rows: DataFrame, group: str, blocks: str, keep: list[str]) -> DataFrame:
    """Rows of ``group`` once for each pair (i, j) of its blocks that their own block is part of.

    Adds ``block`` (own), ``i`` and ``j`` with i <= j.
    """
    own = F.pmod(F.xxhash64("class"), F.col(blocks)).cast("int")
    return rows.withColumn("block", own).withColumn("with", F.explode(F.expr(f"sequence(0, {blocks} - 1)"))).select(
        group, *keep, "block", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"))


def node_edges(similarity: float):
    """Spanning edges of the pairs in each trie node whose signatures may be near."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        a, b = [], []
        for (_, i, j), part in rows.groupby(["node", "i", "j"], sort=False):
            if len(part) < 2:
                continue
            part = part.sort_values("class")
            names, blocks = part["class"].tolist(), part["block"].to_numpy()
            signs = np.array([np.frombuffer(s, np.uint32) for s in part["signature"]])
            left, right = np.flatnonzero(blocks == i), np.flatnonzero(blocks == j)
            forest = Forest(len(part))
            for x in left.tolist():
                alike = (signs[right] == signs[x]).mean(1) >= similarity
                for y in right[alike].tolist():
                    if x != y:
                        forest.join(x, y)
            stars = forest.stars()
            a += [names[x] for x, _ in stars]
            b += [names[y] for _, y in stars]
        return pd.DataFrame({"a": a, "b": b})
    return run


def verified(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, similarity: float) -> Iterator[tuple[int, np.ndarray]]:
    """For each of ``left``, those of ``right`` whose sets are similar enough; exact, by shared elements."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(right)), sizes[right])
    everything = np.concatenate([sets[y] for y in right]) if len(right) else np.empty(0, np.uint64)
    order = np.argsort(everything, kind="stable")
    everything, owner = everything[order], owner[order]
    for x in left.tolist():
        first, last = np.searchsorted(everything, sets[x], "left"), np.searchsorted(everything, sets[x], "right")
        counts = last - first
        total = int(counts.sum())
        at = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first, counts)
        shared = np.bincount(owner[at], minlength=len(right))
        near = shared >= similarity * (sizes[x] + sizes[right] - shared) - 1e-9
        yield x, right[near]


def block_links(similarity: float):
    """Per class, links to others in a pair of blocks; and spanning edges of the links."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        for (_, i, j), part in rows.groupby(["cluster", "i", "j"], sort=False):
            if len(part) < 2:
                continue
            part = part.sort_values("class")
            names, blocks, weight = part["class"].tolist(), part["block"].to_numpy(), part["size"].to_numpy()
            sets = [np.frombuffer(s, np.uint64) for s in part["shingles"]]
            left, right = np.flatnonzero(blocks == i), np.flatnonzero(blocks == j)
            docs, others, forest = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64), Forest(len(part))
            for x, near in verified(sets, left, right, similarity):
                near = near[near > x] if i == j else near
                docs[x] += weight[near].sum()
                others[x] += len(near)
                docs[near] += weight[x]
                others[near] += 1
                for y in near.tolist():
                    forest.join(x, y)
            out += [(names[x], None, int(docs[x]), int(others[x])) for x in np.flatnonzero(others).tolist()]
            out += [(names[x], names[y], 0, 0) for x, y in forest.stars()]
        return pd.DataFrame(out, columns=["class", "other", "docs", "classes"])
    return run


def grouped(rows: DataFrame, keys: list[str], per_group: int) -> DataFrame:
    """Adds ``deal``: whole (keys) groups dealt into about rows / per_group parts."""
    count = rows.count()
    parts = max(1, min(count, max(2 * shuffle_partitions(rows.sparkSession), math.ceil(count / per_group))))
    return rows.withColumn("deal", F.pmod(F.xxhash64(*keys), F.lit(parts)))


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                   similarity: float = SIMILARITY, trees: int = TREES, levels: int = LEVELS, target: float = TARGET) -> DataFrame:
    """One row per row of ``docs``.

    doc_id, class_id (least id among all documents joined by chains of links), copy_id (least id with the
    same shingles), copies, n_links (other documents at the similarity or above, copies counted),
    n_text_links (other classes at the similarity or above). An error tells where no prefix length
    gives a pair at the similarity the target probability of being found.
    """
    return rows_of_groups(docs, id_col, text_col, words, similarity, trees, levels, target).drop("text_hash", "first")


def rows_of_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY,
                   trees: int = TREES, levels: int = LEVELS, target: float = TARGET) -> DataFrame:
    """``jaccard_groups`` with text_hash and first: whether no row of its group has a lesser (id, text_hash).

    Rows that repeat both are all first.
    """
    length = prefix_length(similarity, trees, levels, target)
    if 1 - (1 - similarity ** length) ** trees < target:
        raise ValueError(f"{trees} trees do not find pairs at {similarity} with a probability of {target}")
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    read = read.withColumn("text_hash", F.xxhash64("text"))
    thin = stable(read.mapInArrow(sign(words, trees, levels), "doc_id long, text_hash long, class binary, signature binary"))
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    classes = stable(thin.where("class is not null").groupBy("class").agg(
        F.min(row).alias("copy"), F.count("*").alias("size"), F.first("signature").alias("signature")))

    node = F.expr(f"transform(sequence(0, {trees - 1}), t -> xxhash64(t, substring(signature, t * {4 * levels} + 1, {4 * length})))")
    prefixes = classes.select("class", F.explode(node).alias("node"))
    # Stored, so that the join with it has an exchange of its own, whose hot nodes can be split.
    shared = stable(prefixes.groupBy("node").count().where("count > 1").select(
        "node", F.ceil(F.col("count") / NODE_BLOCK).cast("int").alias("blocks")))
    members = prefixes.join(shared, "node").join(classes.select("class", "signature"), "class")
    near = stable(blocked(members, "node", "blocks", ["class", "signature"]))
    edges = grouped(near, ["node", "i", "j"], NODE_ROWS).groupBy("deal").applyInPandas(node_edges(may_be_near(similarity, trees * levels)), "a binary, b binary")
    clusters = components(stable(edges.distinct())).select(F.col("node").alias("class"), F.col("component").alias("cluster"))

    counts = clusters.groupBy("cluster").agg(F.ceil(F.count("*") / SET_BLOCK).cast("int").alias("blocks"))
    wanted = stable(clusters.join(counts, "cluster").join(classes.select(
        "class", F.col("copy.doc_id").alias("copy_id"), F.col("copy.text_hash").alias("copy_hash"), "size"), "class"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(cell.as_py(), words) for cell in batch.column(0)]
            right = pa.array([class_of(s) == c.as_py() for s, c in zip(found, batch.column(1))], pa.bool_())
            data = pa.array([s.tobytes() for s in found], pa.binary())
            whole = pa.RecordBatch.from_arrays([*batch.columns[1:], data], ["class", "cluster", "blocks", "size", "shingles"])
            yield whole.filter(right)

    same_row = (F.col("text_hash") == F.col("copy_hash")) & F.col("doc_id").eqNullSafe(F.col("copy_id"))
    texts = read.join(wanted, same_row).select("text", "class", "cluster", "blocks", "size")
    with_sets = texts.mapInArrow(sets, "class binary, cluster binary, blocks int, size long, shingles binary").dropDuplicates(["class"])
    pairs = stable(blocked(with_sets, "cluster", "blocks", ["class", "size", "shingles"]))
    found = stable(grouped(pairs, ["cluster", "i", "j"], SET_ROWS).groupBy("deal").applyInPandas(
        block_links(similarity), "class binary, other binary, docs long, classes long"))
    links = found.groupBy("class").agg(F.sum("docs").alias("link_docs"), F.sum("classes").alias("n_text_links"))
    joined = components(found.where("other is not null").select(F.col("class").alias("a"), F.col("other").alias("b"))).select(
        F.col("node").alias("class"), "component")
    # Stored, like the nodes above, so that a hot component can be split in the join with it.
    least = stable(joined.join(classes.select("class", "copy"), "class").groupBy("component").agg(F.min("copy").alias("least")))
    per_class = stable(classes.select("class", "copy", "size").join(links, "class", "left").join(
        joined.join(least, "component").select("class", "least"), "class", "left").withColumn("least", F.coalesce("least", "copy")))
    out = thin.select("doc_id", "text_hash", "class").join(per_class, "class", "left")
    return out.select(
        "doc_id", F.coalesce("least.doc_id", "doc_id").alias("class_id"), F.coalesce("copy.doc_id", "doc_id").alias("copy_id"),
        F.coalesce("size", F.lit(1)).alias("copies"),
        (F.coalesce("size", F.lit(1)) - 1 + F.coalesce("link_docs", F.lit(0))).alias("n_links"),
        F.coalesce("n_text_links", F.lit(0)).alias("n_text_links"), "text_hash",
        (F.col("least").isNull() | row.eqNullSafe(F.col("least"))).alias("first"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """``docs`` with one row of each group: the first by (id, hash of the text); all columns stay as they are.

    Texts without words are groups of their own and all stay. ``settings`` are those of ``jaccard_groups``.
    """
    groups = stable(rows_of_groups(docs, id_col, text_col, **settings).select(
        F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "first", "copies"))
    names = [f"__{i}" for i in range(len(docs.columns))]
    at = {c: names[i] for i, c in reversed(list(enumerate(docs.columns)))}
    plain = docs.toDF(*names).withColumn("__key", F.xxhash64(text_of(at[text_col])))
    same = F.col(at[id_col]).cast("long").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__hash"))
    repeated = stable(groups.where("first and copies > 1").groupBy("__id", "__hash").count().where("count > 1").drop("count"))
    gone = groups.where("not first").select("__id", "__hash").distinct()
    kept = plain.join(gone, same, "left_anti")
    if not repeated.isEmpty():
        one = plain.join(repeated, same, "left_semi").dropDuplicates([at[id_col], "__key"])
        kept = kept.join(repeated, same, "left_anti").unionByName(one)
    return kept.select(*names).toDF(*docs.columns)
