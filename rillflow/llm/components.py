"""Connected components of links held in a DataFrame; nothing is gathered on the driver but one row a round."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillflow.llm.common import durable, give_back

#: Links that a task contracts at once.
PIECE = 1_000_000


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over ``links`` (x, y), for every node with a link.

    First links are contracted where they lie, then by their low and by their high ends: a task turns the links that it has into stars about their least nodes, piece by piece. Adaptive execution gathers few
    links in few tasks, and then that is all, and splits an end that very many have. What is left is kept as (high, low) and turned round by round into stars about the least node. Large star: the high end of a link goes to the least neighbour of the
    low end. Small star: all low ends of one high end, and it, go to the least of them. Neither adds links or parts what belongs together. The rounds end when every
    high end has one low end that is no high end itself.

    The least neighbours are aggregates that combine before they shuffle. The joins are merge joins, and the aggregates are dealt anew for them (``redealt``), as adaptive execution splits a hot key only between two shuffles: a node with very many links stays no single task's work. Nothing is broadcast
    through the driver, whatever its size.
    """
    kind = "high long, low long"
    stars = links.where("x <> y").select(F.greatest("x", "y").alias("high"), F.least("x", "y").alias("low")).mapInArrow(contracted, kind)
    for end in ("low", "high"):
        stars = stars.hint("rebalance", end).mapInArrow(contracted, kind)
    stars = durable(stars)
    while not settled(stars):
        near = stars.select(F.col("low").alias("node"), "high").union(stars.select(F.col("high").alias("node"), F.col("low").alias("high")))
        least = near.groupBy("node").agg(F.least("node", F.min("high")).alias("to")).select(redealt("node"), "to")
        large = stars.join(least.hint("merge"), stars["low"] == least["node"]).select("high", F.col("to").alias("low"))
        roots = large.groupBy("high").agg(F.min("low").alias("to")).select(redealt("high"), "to")
        small = large.join(roots.hint("merge"), "high").select(F.explode(F.array(F.struct(F.col("high"), F.col("to").alias("low")), F.struct(F.col("low").alias("high"), F.col("to").alias("low")))).alias("s")).select("s.*")
        stars = durable(small.where("high <> low").distinct())
    return stars.select(F.col("high").alias("node"), F.col("low").alias("component")).union(stars.select("low", "low").distinct())


def contracted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(high, low): for every PIECE links, a star about the least node of each of their components."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= PIECE:
            yield stars_of(*(np.concatenate([b.column(k).to_numpy() for b in held]) for k in (0, 1)))
            held, size = [], 0
    if size:
        yield stars_of(*(np.concatenate([b.column(k).to_numpy() for b in held]) for k in (0, 1)))
    give_back()


def stars_of(x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    nodes, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    a, b = at[: len(x)], at[len(x) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, label[a], least)  # the roots of both ends go to the lesser one
        np.minimum.at(after, label[b], least)
        while (jumped := after[after] != after).any():
            after = np.where(jumped, after[after], after)
        if (after == label).all():
            break
        label = after
    high = np.flatnonzero(label != np.arange(len(nodes)))
    return pa.RecordBatch.from_arrays([pa.array(nodes[high]), pa.array(nodes[label[high]])], names=["high", "low"])


def redealt(column: str) -> Column:
    """The same whole numbers, in a form by which Spark can't tell that they lie as a join wants them."""
    return F.col(column).bitwiseXOR(F.lit(1)).bitwiseXOR(F.lit(1)).alias(column)


def settled(stars: DataFrame) -> bool:
    """Every high end has one low end, and no low end is a high end."""
    ends = stars.select(F.col("high").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(stars.select("low", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1 and up > 0").isEmpty()
