"""Exact top-k inner products by KD-trees, one for each shard.

Vectors are dealt into shards by hash; each shard is a KD-tree with median splits and tight bounding boxes. A query goes through a shard's tree best first: by the largest inner
product that any point of a box could have, until no box can beat the k-th best score so far. That score is propagated: every query first searches one shard, its k-th
score there is the bound with which it enters all the others, where boxes below it are never opened and results below it never leave.

Each shard's tree is built once, in a task of its own, and kept as one packed row. Queries are dealt into blocks; each block meets each tree, so a task holds one
tree and one block, whatever the sizes of the tables.

Products are exact integers: doubles where no product of the two sides can reach 2**53, 64-bit integers up to 2**63, and beyond that Python's integers. A score that
64 bits can't hold is an error, and so is a component. The bounds of boxes are doubles, raised by more than they can be rounded.

Vectors that are null, empty, or hold null or non-finite components take no part. Vectors of unequal length are an error. Repeated rows: each is a
candidate; a query's own vec_id never is; of different vectors of one vec_id the least is the query. A null vec_id takes no part. Ties go to the smaller vec_id. Empty
tables give an empty result. Further columns play no part.
"""

from __future__ import annotations

import heapq
import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillflow.llm.common import durable, tidy
from rillflow.llm.vectors import first_k, matrix, same_length, usable

LEAF = 64
#: A shard's rows: four shards for each core, within these bounds.
LEAST_ROWS, MOST_ROWS = 4096, 65_536
QUERY_BLOCK = 8192


class Tree:
    """Nodes in arrays: the box of each, its children or its rows. ``points``: 64-bit integers, one row a vector."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points))
        self.low, self.high, self.span, self.children = [], [], [], []
        self._grow(points, 0, len(points), leaf)
        self.low, self.high = np.array(self.low), np.array(self.high)
        self.points, self.ids = points[self.order], ids[self.order]

    def _grow(self, points: np.ndarray, a: int, b: int, leaf: int) -> int:
        mine, at = points[self.order[a:b]], len(self.span)
        low, high = mine.min(0), mine.max(0)
        self.low.append(low)
        self.high.append(high)
        self.span.append((a, b))
        self.children.append(None)
        widest = int(np.argmax(high - low))
        if b - a > leaf and high[widest] > low[widest]:
            middle = (b - a) // 2
            self.order[a:b] = self.order[a:b][np.argpartition(mine[:, widest], middle)]
            self.children[at] = (self._grow(points, a, a + middle, leaf), self._grow(points, a + middle, b, leaf))
        return at

    def search(self, queries: np.ndarray, query_ids: np.ndarray, k: int, floor: list[int | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of the query, vec_id, score) of each query's k best among this tree's points that reach ``floor``."""
        same_length(self.points, queries)
        most = int(np.abs(np.concatenate([self.low[:1], self.high[:1]]).astype(object)).max(initial=0)) * int(np.abs(queries.astype(object)).max(initial=0)) * max(1, queries.shape[1])
        kind = np.float64 if most < 1 << 53 else np.int64 if most < 1 << 63 else object
        points, asked = self.points.astype(kind), queries.astype(kind)
        up, down = np.maximum(queries, 0).astype(np.float64), np.minimum(queries, 0).astype(np.float64)
        high, low = self.high.astype(np.float64), self.low.astype(np.float64)
        bounds = up @ high.T + down @ low.T  # the most that a box can give
        if kind is not np.float64:
            bounds += (up @ np.abs(high).T - down @ np.abs(low).T) * 2.0**-40
        out: list[list[np.ndarray]] = [[], [], []]
        for q in range(len(queries)):
            bound, best, kth = bounds[q], [], -np.inf if floor[q] is None else floor[q]
            frontier = [(-bound[0], 0)]
            while frontier and -frontier[0][0] >= kth:
                _, node = heapq.heappop(frontier)
                if self.children[node] is not None:
                    for child in self.children[node]:
                        if bound[child] >= kth:
                            heapq.heappush(frontier, (-bound[child], child))
                    continue
                a, b = self.span[node]
                scores = points[a:b] @ asked[q]
                near = np.flatnonzero((scores >= kth).astype(bool) & (self.ids[a:b] != query_ids[q]))
                if len(near):
                    best += zip((-scores[near]).tolist(), self.ids[a:b][near].tolist(), strict=True)
                    if len(best) >= k:
                        best = heapq.nsmallest(k, best)
                        kth = max(kth, -best[-1][0])
            best = heapq.nsmallest(k, best)
            if any(not -(1 << 63) <= -s < 1 << 63 for s, _ in best):
                raise OverflowError("a score is beyond 64 bits")
            out[0].append(np.full(len(best), q))
            out[1].append(np.array([i for _, i in best], np.int64))
            out[2].append(np.array([int(-s) for s, _ in best], np.int64))
        return tuple(np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in out)


def built(table: pa.Table) -> pa.Table:
    """(shard, tree): a shard's tree, packed."""
    tree = Tree(matrix(table.column("v"), np.int64), table.column("vec_id").to_numpy())
    return pa.table({"shard": table.column("shard")[:1], "tree": pa.array([pickle.dumps(tree, 5)], pa.binary())})


def searched(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        kind = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
        if not (left.num_rows and right.num_rows):
            return kind.empty_table()
        tree, query_ids = pickle.loads(left.column("tree")[0].as_py()), right.column("vec_id").to_numpy()
        row, found, score = tree.search(matrix(right.column("v"), np.int64), query_ids, k, right.column("floor").to_pylist())
        return pa.table({"query_id": query_ids[row], "vec_id": found, "score": score}, schema=kind)

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row that ``is_query`` selects, its k largest inner products of floor(scale * x) among all other rows."""
    whole = lambda y: F.when(F.abs(y) < 2.0**63, F.floor(y)).otherwise(F.raise_error(F.lit("a component is beyond 64 bits")).cast("long"))
    ints = F.transform(F.col(vector_col), lambda x: whole(x.cast("double") * scale))
    rows = vectors.where(usable(vector_col) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), ints.alias("v"), is_query.alias("q"))
    n, n_queries = vectors.agg(F.count(F.lit(1)), F.count_if(is_query)).first()
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    shards = max(1, math.ceil(n / (shard_rows or min(MOST_ROWS, max(LEAST_ROWS, n // (4 * cores))))))
    blocks = max(1, math.ceil(n_queries / QUERY_BLOCK))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    home = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(shards)).cast("int")
    block = F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(blocks)).cast("int")
    # equal vectors have ids of their own, so a hot vector is spread over the shards
    dealt = rows.select("vec_id", "v", F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int").alias("shard"))
    trees = durable(dealt.groupBy("shard").applyInArrow(tidy(built), "shard int, tree binary")).withColumn("block", every(blocks))
    asked = rows.where("q").groupBy("vec_id").agg(F.min("v").alias("v")).select("vec_id", "v", block.alias("block"), home.alias("home"))
    kind = "query_id long, vec_id long, score long"

    def visit(some: DataFrame) -> DataFrame:
        return trees.groupBy("shard", "block").cogroup(some.toDF(*some.columns).groupBy("shard", "block")).applyInArrow(tidy(searched(k)), kind)

    first = durable(visit(asked.select("vec_id", "v", "block", F.col("home").alias("shard"), F.lit(None).cast("long").alias("floor"))))
    kth = first.groupBy("query_id").agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("found")).select("query_id", F.when(F.col("found") >= k, F.col("floor")).alias("floor"))
    others = asked.join(kth, asked["vec_id"] == kth["query_id"], "left").select("vec_id", "v", "block", "home", "floor", every(shards).alias("shard")).where("shard <> home").drop("home")
    return first_k(first.union(visit(others)), k, ascending=False)
