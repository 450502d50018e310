"""Approximate nearest neighbours: a forest of random-projection trees and an exact reranking.

The trees are fit on a bounded sample: each node projects on a random direction and splits at the
sample's median. Every row is indexed, by its leaf in every tree. A query goes down all trees with one
priority queue of open branches, keyed by the sum of squared distances to the hyperplanes crossed, and
visits leaves until they hold ``share`` times the number of rows (a row counts once a tree). Rows and
visits meet by (tree, leaf, chunk); distances there are exact, in double precision, and each group passes
on its k nearest. A leaf of many rows (a vector repeated often has all its copies in one leaf) is cut
into chunks of about ``CHUNK`` rows, and its visits go to each chunk.

Vectors that are null, zero, or hold null or non-finite components take no part, neither as queries nor
as candidates; nor do those of another length than the most frequent (the longer, if equal). Repeated ids
are rows of their own and don't meet themselves; ties go to the smaller id. With fewer than k candidates
all are returned; an empty table gives an empty result; columns beyond the id and the vector are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from . import _common as C

#: The index: rows in the sample at most, and its bytes; trees; sample rows in a leaf; rows in a chunk.
SAMPLE_ROWS, SAMPLE_BYTES, TREES, LEAF, CHUNK = 16_384, 64 << 20, 8, 64, 256
#: A query visits leaves that hold this share of all rows, counted once a tree, and at least so many rows. For
#: vectors without structure, as random ones, a high share is what a recall of 0.9 takes.
SHARE, LEAST = 0.85, 4096
SEED = 7


class Forest:
    """Trees as arrays: node -> direction, offset and two children; a child below 0 is leaf -child - 1."""

    def __init__(self, sample: np.ndarray, trees: int, leaf: int, seed: int):
        self.trees = []
        for t in range(trees):
            rng = np.random.default_rng([seed, t])
            directions, offsets, children = [], [], []
            leaves = 0
            stack = [(np.arange(len(sample)), None)]
            while stack:
                own, at = stack.pop()
                low = high = None
                if len(own) > leaf:
                    w = rng.normal(size=sample.shape[1])
                    w /= np.linalg.norm(w)
                    p = sample[own] @ w
                    cut = float(np.median(p))
                    low, high = own[p < cut], own[p >= cut]
                if low is None or not len(low) or not len(high):
                    node = -leaves - 1
                    leaves += 1
                else:
                    node = len(offsets)
                    directions.append(w)
                    offsets.append(cut)
                    children.append([0, 0])
                    stack += [(high, (node, 1)), (low, (node, 0))]
                if at:
                    children[at[0]][at[1]] = node
            d = np.array(directions).reshape(-1, sample.shape[1])
            self.trees.append((d, np.array(offsets), np.array(children, dtype="int64").reshape(-1, 2), leaves))

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row in each tree."""
        out = np.zeros((len(x), len(self.trees)), dtype="int32")
        for t, (d, offsets, children, _) in enumerate(self.trees):
            node = np.zeros(len(x), dtype="int64") if len(offsets) else np.full(len(x), -1)
            while len(todo := np.flatnonzero(node >= 0)):
                at = node[todo]
                p = np.einsum("ij,ij->i", x[todo], d[at])
                node[todo] = children[at, (p >= offsets[at]).astype("int64")]
            out[:, t] = -node - 1
        return out

    def visits(self, x: np.ndarray, counts: list[np.ndarray], budget: float) -> list[tuple[int, int]]:
        """(tree, leaf) in the order of the shared queue, until the leaves hold ``budget`` rows."""
        heap = [(0.0, t, 0 if len(tree[1]) else -1) for t, tree in enumerate(self.trees)]
        projections = [tree[0] @ x - tree[1] for tree in self.trees]
        heapq.heapify(heap)
        out, rows = [], 0
        while heap and rows < budget:
            crossed, t, node = heapq.heappop(heap)
            _, _, children, _ = self.trees[t]
            while node >= 0:
                p = projections[t][node]
                near, far = (children[node][1], children[node][0]) if p >= 0 else (children[node][0], children[node][1])
                heapq.heappush(heap, (crossed + p * p, t, int(far)))
                node = int(near)
            if n := int(counts[t][-node - 1]):
                out.append((t, -node - 1))
                rows += n
        return out


def valid(vec: Column) -> Column:
    """True for a vector without null or non-finite components that isn't zero."""
    fine = F.forall(vec, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), F.lit(False)))
    return vec.isNotNull() & fine & F.exists(vec, lambda v: v != 0)


def _matrix(column: pd.Series) -> np.ndarray:
    """Rows of packed doubles as one matrix."""
    return np.frombuffer(b"".join(column), "<f8").reshape(len(column), -1)


def _nearest(rows: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest of some rows to each of some queries."""
    out = []
    x, ids, number = _matrix(rows.vec), rows.vec_id.to_numpy(), rows.row.to_numpy()
    for query, own, vec in zip(queries.query_id.to_numpy(), queries.row.to_numpy(), queries.vec, strict=True):
        d = np.sqrt(((x - np.frombuffer(vec, "<f8")) ** 2).sum(axis=1))
        other = np.flatnonzero(number != own)
        best = other[np.lexsort((number[other], ids[other], d[other]))[:k]]
        out.append(pd.DataFrame({"query_id": query, "query_row": own, "vec_id": ids[best], "row": number[best], "score": d[best]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "query_row": [], "vec_id": [], "row": [], "score": []})


def search(vectors: DataFrame, is_query: Column, k: int = 10, trees: int = TREES, leaf: int = LEAF, share: float = SHARE, id_col: str = "vec_id", vec_col: str = "embedding", seed: int = SEED) -> DataFrame:
    """query_id, rank (from 1), vec_id and score, the Euclidean distance, of each query's k nearest found."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    rows = C.stored(rows.where(valid(F.col("vec"))).withColumn("row", F.monotonically_increasing_id()), "vectors")
    sizes = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], schema)
    dims, total = sizes[0]["d"], sizes[0]["count"]
    rows = rows.where(F.size("vec") == dims)
    most = max(leaf, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * dims)))
    part = min(1.0, 1.1 * most / total)
    chosen = rows.where(F.pmod(F.xxhash64("row"), F.lit(1 << 30)) < int(part * (1 << 30))).select("vec").limit(most).toPandas()
    if not len(chosen):
        chosen = rows.select("vec").limit(1).toPandas()
    forest = spark.sparkContext.broadcast(Forest(np.array(chosen.vec.tolist(), dtype="float64"), trees, leaf, seed))

    def index(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            x = np.array(f.vec.tolist(), dtype="<f8").reshape(len(f), dims)
            yield pd.DataFrame({"vec_id": f.vec_id, "row": f.row, "is_query": f.is_query, "vec": [v.tobytes() for v in x], "leaves": forest.value.leaves(x).tolist()})

    indexed = C.stored(rows.mapInPandas(index, "vec_id long, row long, is_query boolean, vec binary, leaves array<int>"), "index")
    in_leaf = indexed.select("vec_id", "row", "vec", F.posexplode("leaves").alias("tree", "leaf"))
    held = in_leaf.groupBy("tree", "leaf").count().collect()  # at most as many as the sample's leaves
    counts = [np.zeros(tree[3], dtype="int64") for tree in forest.value.trees]
    for r in held:
        counts[r.tree][r.leaf] = r["count"]
    budget = max(share * total, LEAST)
    known = spark.sparkContext.broadcast(counts)

    def visit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for query, own, vec in zip(f.vec_id, f.row, f.vec, strict=True):
                at = forest.value.visits(np.frombuffer(vec, "<f8"), known.value, budget)
                yield pd.DataFrame({"query_id": query, "row": own, "vec": vec, "tree": [t for t, _ in at], "leaf": [n for _, n in at], "chunks": [int(-(-known.value[t][n] // CHUNK)) for t, n in at]}).astype({"tree": "int32", "leaf": "int32"})

    queries = indexed.where("is_query").select("vec_id", "row", "vec").repartition(spark.sparkContext.defaultParallelism * 2)
    visits = queries.mapInPandas(visit, "query_id long, row long, vec binary, tree int, leaf int, chunks int").select("*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")).drop("chunks")
    leaf_chunks = spark.createDataFrame([(r.tree, r.leaf, -(-r["count"] // CHUNK)) for r in held], "tree int, leaf int, chunks int")
    dealt = in_leaf.join(F.broadcast(leaf_chunks), ["tree", "leaf"]).withColumn("chunk", F.pmod(F.xxhash64("row"), F.col("chunks").cast("long")).cast("int")).drop("chunks")
    key = ["tree", "leaf", "chunk"]
    near = dealt.groupBy(*key).cogroup(visits.groupBy(*key)).applyInPandas(lambda a, b: _nearest(a, b, k), "query_id long, query_row long, vec_id long, row long, score double")
    order = W.Window.partitionBy("query_id", "query_row").orderBy("score", "vec_id", "row")
    best = near.dropDuplicates(["query_row", "row"]).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(C.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
