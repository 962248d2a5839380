"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first traversal.

The tree is fitted on a bounded sample of the vectors: one in 64, but ``sample`` at least and four times as many at most; every vector is then put into the leaf that it reaches by going to the nearest centre at
each node. A query walks the tree with a priority queue of unvisited branches ordered by distance to their centres, and visits the leaves it meets, nearest first. How many it visits is calibrated: held-out
vectors of the sample, which the tree isn't fitted on, search it for the sample, the number of leaves widens until their recall against brute force reaches ``recall``, and that number, with a margin, holds for all queries.

The tree has a bounded size and is broadcast. Vectors are dealt by leaf, large leaves in several blocks by hash, and queries follow to the blocks of the leaves they
visit, in blocks of their own, so no task holds more than a block of vectors and a block of queries. Distances are computed in double precision on the original vectors.

Vectors that are null, empty, zero, or hold null or non-finite components take no part, nor does a null vec_id. Vectors of unequal length are an error. A query's own vec_id is no
candidate; of different vectors of one vec_id the least is the query, and each is a candidate. Ties go to the smaller vec_id. A query whose leaves hold fewer than k candidates goes on along its queue until they hold k, or all there are. Empty tables give an empty result. Further columns play no part.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillflow.llm.common import durable, thinned, tidy
from rillflow.llm.vectors import first_k, matrix, same_length, usable

SAMPLE = 16_384
BRANCHES = 8
LEAF_SAMPLE = 64
HELD_OUT = 256
RECALL = 0.97
BLOCK = 4096
QUERY_BLOCK = 8192


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0)


def k_means(points: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    centres = points[rng.choice(len(points), k, replace=False)]
    for _ in range(rounds):
        near = squared(points, centres).argmin(1)
        moved = np.array([points[near == j].mean(0) if (near == j).any() else points[rng.integers(len(points))] for j in range(k)])
        if np.allclose(moved, centres):
            break
        centres = moved
    return centres


@dataclass
class Tree:
    """Inner nodes hold centres and children; a child below 0 is leaf ~child."""

    centres: list[np.ndarray]
    children: list[np.ndarray]
    leaves: int

    def assign(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point."""
        out = np.zeros(len(points), np.int64)
        if not self.centres:
            return out
        work = [(0, np.arange(len(points)))]
        while work:
            node, rows = work.pop()
            if len(rows):
                to = self.children[node][squared(points[rows], self.centres[node]).argmin(1)]
                for child in np.unique(to):
                    if child < 0:
                        out[rows[to == child]] = ~child
                    else:
                        work.append((int(child), rows[to == child]))
        return out

    def visits(self, query: np.ndarray, most: int, sizes: np.ndarray | None = None, least: int = 0) -> list[int]:
        """The leaves that best-bin-first traversal meets, in order: ``most`` of them, and further ones until they hold ``least`` vectors by ``sizes``."""
        if not self.centres:
            return [0]
        out: list[int] = []
        held = 0
        queue = [(0.0, 0)]
        while queue and (len(out) < most or held < least):
            _, at = heapq.heappop(queue)
            while at >= 0:
                away = ((self.centres[at] - query) ** 2).sum(1)
                best = int(away.argmin())
                for j, child in enumerate(self.children[at].tolist()):
                    if j != best:
                        heapq.heappush(queue, (float(away[j]), child))
                at = int(self.children[at][best])
            out.append(~at)
            held += 0 if sizes is None else int(sizes[~at])
        return out


def fit(points: np.ndarray, branches: int = BRANCHES, leaf: int = LEAF_SAMPLE, seed: int = 1) -> Tree:
    rng, tree = np.random.default_rng(seed), Tree([], [], 0)

    def grow(rows: np.ndarray) -> int:
        mine = points[rows]
        if len(rows) <= leaf or (mine == mine[:1]).all():
            tree.leaves += 1
            return ~(tree.leaves - 1)
        centres = np.unique(k_means(mine, min(branches, len(rows)), rng), axis=0)
        near = squared(mine, centres).argmin(1)
        used = np.unique(near)
        if len(used) < 2:
            tree.leaves += 1
            return ~(tree.leaves - 1)
        at = len(tree.centres)
        tree.centres.append(centres[used])
        tree.children.append(np.zeros(0, np.int64))
        tree.children[at] = np.array([grow(rows[near == j]) for j in used], np.int64)
        return at

    if len(points):
        grow(np.arange(len(points)))
    tree.leaves = max(1, tree.leaves)
    return tree


def kept_back(n: int, k: int, held_out: int = HELD_OUT) -> np.ndarray:
    """Which of ``n`` points are held out; none where they are too few to tell."""
    return np.random.default_rng(2).choice(n, min(held_out, n // 4), replace=False) if n >= 4 * k else np.zeros(0, np.int64)


def calibrated(tree: Tree, points: np.ndarray, asked: np.ndarray, k: int, recall: float) -> tuple[int, float]:
    """(leaves to visit, recall reached): the least number of leaves with which the held-out points ``asked`` find ``recall`` of their k nearest, and a quarter more."""
    if not len(asked):
        return tree.leaves, 1.0
    away = squared(points[asked], points)
    away[np.arange(len(asked)), asked] = np.inf
    true = np.argpartition(away, k, axis=1)[:, :k]
    leaf_of = tree.assign(points)
    found = np.zeros(tree.leaves + 1)
    for q, row in enumerate(asked):
        place = {leaf: at for at, leaf in enumerate(tree.visits(points[row], tree.leaves))}
        for j in true[q]:
            found[place[leaf_of[j]] + 1] += 1
    share = np.cumsum(found) / (len(asked) * k)
    needed = int(np.searchsorted(share, recall))
    return min(tree.leaves, math.ceil(needed * 1.25)), float(share[min(needed, tree.leaves)])


def searched(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        kind = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not (left.num_rows and right.num_rows):
            return kind.empty_table()
        points, ids = matrix(left.column("v")), left.column("vec_id").to_numpy()
        queries, query_ids = matrix(right.column("v")), right.column("vec_id").to_numpy()
        same_length(points, queries)
        out: list[list[np.ndarray]] = [[], [], []]
        for at in range(0, len(queries), 256):
            rough = squared(queries[at : at + 256], points)
            for q in range(len(rough)):
                mine = query_ids[at + q]
                near = np.flatnonzero(ids != mine)
                if len(near) > k:
                    # rounding may misplace near ties: keep all within a margin of the k-th, then measure exactly
                    kth = np.partition(rough[q][near], k - 1)[k - 1]
                    near = near[rough[q][near] <= kth + 1e-9 * (1 + kth + (queries[at + q] ** 2).sum())]
                exact = np.sqrt(((points[near] - queries[at + q]) ** 2).sum(1))
                best = np.lexsort((ids[near], exact))[:k]
                out[0].append(np.full(len(best), mine))
                out[1].append(ids[near][best])
                out[2].append(exact[best])
        return pa.table({"query_id": np.concatenate(out[0]), "vec_id": np.concatenate(out[1]), "score": np.concatenate(out[2])}, schema=kind)

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, recall: float = RECALL, sample: int = SAMPLE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for every row that ``is_query`` selects, the k nearest found among all other rows, by Euclidean distance."""
    whole = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = vectors.where(usable(vector_col) & F.exists(vector_col, lambda x: x != 0) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("v"), is_query.alias("q"))
    # one vector of each kind, so a hot vector doesn't fill the sample; twice as many are drawn first
    n, n_queries = vectors.agg(F.count(F.lit(1)), F.count_if(is_query)).first()
    sample = min(4 * sample, max(sample, n // 64))
    drawn = thinned(rows.select("vec_id", "v"), "vec_id", n, 2 * sample)
    chosen = drawn.groupBy("v").agg(F.min("vec_id").alias("vec_id")).orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample)
    points = matrix(pa.table({"v": chosen.select("v").toArrow().column("v")}).column("v"))
    held_out = kept_back(len(points), k)
    tree = fit(np.delete(points, held_out, axis=0))
    visits, _ = calibrated(tree, points, held_out, k, recall)
    shared = vectors.sparkSession.sparkContext.broadcast(tree)

    def placed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(shared.value.assign(matrix(batch.column("v"))), pa.int64())], names=["vec_id", "v", "leaf"])

    def routed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves = [shared.value.visits(x, visits, held.value, k + own) for x, own in zip(matrix(batch.column("v")), batch.column("own").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(leaves, pa.list_(pa.int64()))], names=["vec_id", "v", "leaves"])

    index = rows.select("vec_id", "v").mapInArrow(placed, "vec_id long, v array<double>, leaf long")
    sizes = durable(index.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")))
    counts = np.zeros(tree.leaves, np.int64)
    for leaf, n in sizes.select("leaf", "n").toLocalIterator():
        counts[leaf] = n
    held = vectors.sparkSession.sparkContext.broadcast(counts)
    # the rows of a query's own vec_id are no candidates
    asked = rows.where("q").groupBy("vec_id").agg(F.min("v").alias("v"), F.count(F.lit(1)).alias("own")).mapInArrow(routed, "vec_id long, v array<double>, leaves array<long>")
    blocks = sizes.select("leaf", "blocks")
    # as many blocks of queries as an average leaf's ones fill; a leaf's vectors go to each
    parts = max(1, math.ceil(n_queries * min(1.0, 2 * visits / tree.leaves) / QUERY_BLOCK))
    part = F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(parts)).cast("int").alias("part")
    dealt = index.join(F.broadcast(blocks), "leaf").select("vec_id", "v", "leaf", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    sent = asked.select("vec_id", "v", part, F.explode("leaves").alias("leaf")).join(F.broadcast(blocks), "leaf").select("vec_id", "v", "leaf", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "part")
    found = dealt.groupBy("leaf", "block", "part").cogroup(sent.groupBy("leaf", "block", "part")).applyInArrow(tidy(searched(k)), "query_id long, vec_id long, score double")
    return first_k(found, k, ascending=True)
