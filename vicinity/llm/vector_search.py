"""Operator 8: nearest neighbours by a hierarchical k-means tree with best-bin-first search.

The tree is fitted on a bounded sample and every vector is put into its leaf. A
query walks the tree through a priority queue, nearest centre first, which lists
leaves in the order they should be visited. How many it visits is calibrated: a
bounded set of queries is compared with all vectors, and visits are widened until
their neighbours' leaves are reached often enough. Leaves are cut into blocks and
so are the queries that visit them, so that no task gets a whole leaf. Vectors
that are equal are searched once; of each, the few smallest ids can be among the
nearest, which are all that is kept.

Rows: vectors that are null, zero, or hold null or non-finite components take no
part, neither do rows without an id or with another than the usual length. With
fewer candidates than asked for, all are returned. Rows that repeat an id count
once for each different vector.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vicinity.session import stable

NEAREST, EVERY = 5, 50
#: Vectors the tree is fitted on, about; children of a node; sample vectors in a leaf.
SAMPLE_VECTORS, BRANCHES, LEAF_SAMPLE = 20_000, 8, 96
#: Queries compared with all vectors, and the share of their neighbours that must be reached.
CALIBRATION_QUERIES, TARGET_RECALL = 128, 0.98
#: Queries whose visits are handed over at once; vectors and queries in one block of a leaf.
WALKED, BLOCK_VECTORS, BLOCK_QUERIES = 16, 4096, 1024


class Tree:
    """Centres of a hierarchical k-means tree over unit vectors."""

    def __init__(self, sample: np.ndarray, branches: int = BRANCHES, leaf_sample: int = LEAF_SAMPLE, seed: int = 0):
        self.centres: list[np.ndarray] = []
        self.children: list[list[int]] = []   # a child below zero is leaf -(child + 1)
        self.leaves = 0
        self.root = self._grow(sample, branches, leaf_sample, np.random.default_rng(seed))

    def _grow(self, x: np.ndarray, branches: int, leaf_sample: int, rng) -> int:
        if len(x) <= leaf_sample or len(np.unique(x, axis=0)) <= 1:
            self.leaves += 1
            return -self.leaves
        centres = x[rng.choice(len(x), min(branches, len(x)), replace=False)]
        for _ in range(12):
            near = np.argmax(x @ centres.T, 1)
            sums = np.zeros_like(centres)
            np.add.at(sums, near, x)
            norms = np.linalg.norm(sums, axis=1)
            centres = np.where(norms[:, None] > 1e-12, sums / np.maximum(norms, 1e-12)[:, None], centres)
        near = np.argmax(x @ centres.T, 1)
        used = np.unique(near)
        if len(used) < 2:
            self.leaves += 1
            return -self.leaves
        node = len(self.centres)
        self.centres.append(centres[used])
        self.children.append([])
        self.children[node] = [self._grow(x[near == u], branches, leaf_sample, rng) for u in used]
        return node

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each unit vector: nearest child at every level."""
        out = np.zeros(len(x), np.int64)
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = -node - 1
                continue
            near = np.argmax(x[rows] @ self.centres[node].T, 1)
            todo += [(c, part) for i, c in enumerate(self.children[node]) if len(part := rows[near == i])]
        return out

    def best_bins(self, query: np.ndarray, visits: int) -> list[int]:
        """The first leaves of a best-first walk."""
        heap, out = [(-1.0, self.root)], []
        while heap and len(out) < visits:
            _, node = heapq.heappop(heap)
            if node < 0:
                out.append(-node - 1)
                continue
            for near, child in zip((self.centres[node] @ query).tolist(), self.children[node]):
                heapq.heappush(heap, (-near, child))
        return out


def matrix(cells) -> np.ndarray:
    return np.array([np.asarray(c, np.float64) for c in cells])


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)   # no overflow or underflow of squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cosines(query: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosine of a vector with each row, in double precision and always summed in one order."""
    # Scaled by powers of two, which changes no digit but keeps squares from overflow.
    query = np.ldexp(query, -np.frexp(np.abs(query).max())[1])
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])
    return (x * query).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((query * query).sum()))


def top_rows(queries: pd.DataFrame, block: pd.DataFrame, most: int) -> list[tuple[int, int, float]]:
    """query, vec_id and score of the nearest ids of a block for each query; with more than asked among close ones."""
    q, x = matrix(queries["v"]), matrix(block["v"])
    rough, out = unit(q) @ unit(x).T, []
    ids = block["ids"].tolist()
    some = min(most + 4, len(x))
    for i, query in enumerate(queries["query"].tolist()):
        near = np.argpartition(-rough[i], some - 1)[:some]
        near = np.flatnonzero(rough[i] >= rough[i][near].min() - 1e-9) if len(near) else near
        found = sorted((-s, int(v)) for s, n in zip(cosines(q[i], x[near]).tolist(), near) for v in ids[n])
        out += [(query, v, -s) for s, v in found[:most]]
    return out


FOUND = "query long, vec_id long, score double"


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and v of the rows that take part."""
    read = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    read = read.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
                      & F.forall("v", fine) & F.exists("v", lambda x: x != 0))
    usual = read.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return read.where(F.size("v") == F.lit(usual["n"] if usual else 0)).dropDuplicates(["vec_id", "v"])


def classes_of(vectors: DataFrame, most: int) -> DataFrame:
    """Different vectors with their smallest ids; the limit within a window is applied before the shuffle too."""
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    few = vectors.withColumn("place", place).where(F.col("place") <= most)
    return few.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))


def brute_force(queries: pd.DataFrame, classes: DataFrame, most: int) -> DataFrame:
    """FOUND rows of a bounded set of queries against all vectors, in Arrow batches."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[int, list[tuple[float, int]]] = {}
        for batch in batches:
            if len(batch):
                for q, v, s in top_rows(queries, batch, most):
                    best.setdefault(q, []).append((-s, v))
                best = {q: heapq.nsmallest(most, found) for q, found in best.items()}
        rows = [(q, v, -s) for q, found in best.items() for s, v in found]
        yield pd.DataFrame(rows, columns=["query", "vec_id", "score"])
    found = classes.select("v", "ids").mapInPandas(run, FOUND)
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("place", place).where(F.col("place") <= most).drop("place")


def visits_needed(tree: Tree, queries: pd.DataFrame, truth: pd.DataFrame, target: float) -> int:
    """Leaves to visit so that the share ``target`` of the true neighbours lies in them."""
    if not len(truth):
        return 1
    units, ranks = dict(zip(queries["query"], unit(matrix(queries["v"])))), []
    for q, rows in truth.groupby("query"):
        place = {leaf: i + 1 for i, leaf in enumerate(tree.best_bins(units[q], tree.leaves))}
        ranks += [place[leaf] for leaf in tree.leaf_of(unit(matrix(rows["v"]))).tolist()]
    return int(np.sort(ranks)[min(len(ranks) - 1, int(np.ceil(target * len(ranks))) - 1)])


def search(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = EVERY,
           nearest: int = NEAREST, sample_vectors: int = SAMPLE_VECTORS, target_recall: float = TARGET_RECALL,
           leaf_sample: int = LEAF_SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest found of each row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    most = nearest + 1   # one may be the query itself
    rows = stable(usable(vectors, id_col, vector_col))
    classes = stable(classes_of(rows, most))
    asked = stable(rows.where(F.col("vec_id") % every == 0).groupBy("v").agg(F.min("vec_id").alias("query")))
    count = classes.count()
    if not count:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    def some(df: DataFrame, rows: int, of: int) -> pd.DataFrame:
        part = min(1.0, rows / max(1, of))
        return df.where(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) <= int(part * (1 << 30))).toPandas()

    sample = some(classes.select("v"), sample_vectors, count)
    first = pd.DataFrame(classes.limit(1).select("v").collect(), columns=["v"]) if not len(sample) else sample
    tree = Tree(unit(np.unique(matrix(first["v"]), axis=0)), leaf_sample=leaf_sample)

    tried = some(asked.select("query", "v"), CALIBRATION_QUERIES, asked.count())
    visits = 1
    if len(tried):
        true = brute_force(tried, classes, most)
        with_vector = true.join(rows, "vec_id").where(F.col("vec_id") != F.col("query"))
        visits = visits_needed(tree, tried, with_vector.toPandas(), target_recall)

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.assign(leaf=tree.leaf_of(unit(matrix(batch["v"]))))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), WALKED):
                some = batch.iloc[at:at + WALKED]
                leaves = [tree.best_bins(u, visits) for u in unit(matrix(some["v"]))]
                yield some.assign(leaf=leaves).explode("leaf").astype({"leaf": "int64"})

    indexed = stable(classes.mapInPandas(put, "v array<double>, ids array<long>, leaf long"))
    probes = stable(asked.select("query", "v").mapInPandas(walk, "query long, v array<double>, leaf long"))
    # One row per leaf: bounded by the sample the tree is fitted on.
    sizes = indexed.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK_VECTORS).cast("int").alias("vector_blocks"))
    asks = probes.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("query_blocks"))
    cut = F.broadcast(stable(sizes.join(asks, "leaf")))
    left = indexed.join(cut, "leaf").select(
        "leaf", F.pmod(F.xxhash64("v"), "vector_blocks").cast("int").alias("vb"), F.explode(F.expr("sequence(0, query_blocks - 1)")).alias("qb"), "v", "ids")
    right = probes.join(cut, "leaf").select(
        "leaf", F.explode(F.expr("sequence(0, vector_blocks - 1)")).alias("vb"),
        F.pmod(F.xxhash64("query"), "query_blocks").cast("int").alias("qb"), "query", "v")

    def meet(block: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        rows = top_rows(queries, block, most) if len(block) and len(queries) else []
        return pd.DataFrame(rows, columns=["query", "vec_id", "score"])

    found = left.groupBy("leaf", "vb", "qb").cogroup(right.groupBy("leaf", "vb", "qb")).applyInPandas(meet, FOUND)
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    found = found.withColumn("place", best).where(F.col("place") <= most).select("query", "vec_id", "score")
    askers = rows.where(F.col("vec_id") % every == 0).join(asked, "v").select(F.col("vec_id").alias("query_id"), "query")
    mine = F.row_number().over(Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id"))
    return (askers.join(found, "query").where(F.col("vec_id") != F.col("query_id")).withColumn("rank", mine)
            .where(F.col("rank") <= nearest).select("query_id", F.col("rank").cast("int"), "vec_id", "score"))
