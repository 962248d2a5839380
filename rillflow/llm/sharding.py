"""Sharding by a hierarchical weighted hash tree.

A row descends from the root through regions and racks to a shard. At each node it draws, for each child, an exponential arrival time from a hash
of (key, child's path), with the child's weight as rate, and follows the child that arrives first. So a child gets its share of the weight; a draw depends
on that child alone. When weights change, rows move only among the children of nodes on the changed paths: a heavier child
takes rows into itself, a lighter one gives rows away, and no row moves between two children whose weights stay. A new shard under a node
of its own changes no other child's draw, so it takes rows only into itself.

All is native: hashes and draws are column expressions. The tree's size bounds the expression; the data never does.

A null key is a key like any other; all its rows share one shard. Equal keys share a shard. Null texts have size 16 and checksum 0. Slots number
the rows of each shard without gaps, rows of equal keys in any order. An empty table gives an empty result. Further columns play no part.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OVERHEAD = 16
ROWS_A_BUCKET = 50_000


@dataclass(frozen=True)
class Node:
    """``name`` is unique among its siblings. A leaf has a shard number and a weight; an inner node weighs what its children do."""

    name: str
    children: tuple[Node, ...] = ()
    shard: int | None = None
    own_weight: float = 1.0
    weight: float = field(init=False)

    def __post_init__(self):
        total = sum(c.weight for c in self.children) if self.children else self.own_weight
        if not (math.isfinite(total) and total >= 0) or bool(self.children) == (self.shard is not None):
            raise ValueError(f"node {self.name} needs a finite weight, and either children or a shard")
        object.__setattr__(self, "weight", total)


def regular_tree(regions: int, racks: int, shards: int) -> Node:
    """Regions of racks of shards, all of weight 1, numbered in order."""
    number = iter(range(regions * racks * shards))
    return Node("root", tuple(Node(f"region{a}", tuple(Node(f"rack{b}", tuple(Node(f"shard{c}", shard=next(number)) for c in range(shards))) for b in range(racks))) for a in range(regions)))


def grown_tree(tree: Node, shard: int, weight: float = 1.0) -> Node:
    """The tree with one more shard, in a region and a rack of its own: rows move into that shard and nowhere else."""
    return Node(tree.name, (*tree.children, Node(f"region-of-{shard}", (Node("rack0", (Node("shard0", shard=shard, own_weight=weight),)),))))


def levels_of(tree: Node) -> list[list[list[tuple[str, float, int]]]]:
    """For each level, for each node of it, its children that weigh something: (path, weight, place among the next level's nodes).

    A leaf above the last level stands for itself on every further one. On the last level the places are shard numbers.
    """
    level, out = [(f"/{tree.name}", tree)], []
    while any(node.children for _, node in level):
        following, table = [], []
        for path, node in level:
            heavy = [(f"{path}/{c.name}", c) for c in node.children if c.weight > 0] or [(path, node)]
            if heavy[0][1].weight <= 0:
                raise ValueError(f"{path} has no weight")
            table.append([(p, c.weight, len(following) + k) for k, (p, c) in enumerate(heavy)])
            following += heavy
        level = following
        out.append(table)
    shards = [node.shard for _, node in level]
    if not out:
        return [[[(level[0][0], 1.0, shards[0])]]]
    out[-1] = [[(path, weight, shards[k]) for path, weight, k in children] for children in out[-1]]
    return out


def shard_of(key: Column, tree: Node) -> Column:
    """The shard of a key. Children of weight 0 get nothing."""

    def arrival(child: Column) -> Column:
        uniform = (F.shiftrightunsigned(F.xxhash64(key, child["path"]), 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
        return F.struct((-F.log(uniform) / child["weight"]).alias("at"), child["place"].alias("place"))

    at = F.lit(0)
    for table in levels_of(tree):
        children = F.array(*[F.array(*[F.struct(F.lit(p).alias("path"), F.lit(float(w)).alias("weight"), F.lit(k).alias("place")) for p, w, k in node]) for node in table])
        at = F.array_min(F.transform(F.element_at(children, at + 1), arrival))["place"]
    return at.cast("int")


def numbered(df: DataFrame, shard_col: str, key_col: str, slot_col: str, rows: int) -> DataFrame:
    """``df`` with a gapless number from 0 within each shard.

    Shards are cut into buckets of about ``ROWS_A_BUCKET`` rows by a hash of the whole row; rows are numbered within a bucket and
    moved up by the rows of the buckets before, so no task holds a whole shard. Rows of one key that differ are spread; rows that are equal throughout
    share a bucket, whose numbering sorts outside of memory where it must. ``rows`` only sets the number of buckets.
    """
    shards = max(1, df.sparkSession.sparkContext.defaultParallelism)
    buckets = max(1, math.ceil(rows / ROWS_A_BUCKET), shards // 4)
    placed = df.withColumn("_bucket", F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(buckets)).cast("int"))
    before = Window.partitionBy(shard_col).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy(shard_col, "_bucket").agg(F.count(F.lit(1)).alias("_n")).select(shard_col, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(shard_col, "_bucket").orderBy(F.col(key_col).asc_nulls_first())
    joined = placed.withColumn("_at", F.row_number().over(within) - 1).join(counts, [shard_col, "_bucket"])
    return joined.withColumn(slot_col, (F.col("_before") + F.col("_at")).cast("long")).drop("_bucket", "_at", "_before")


def shard(docs: DataFrame, tree: Node, grown: Node | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, grown_shard): the place of every row, and its place once the tree has grown."""
    key = F.col(id_col).cast("long")
    text = F.coalesce(F.col(text_col).cast("string").cast("binary"), F.lit("").cast("binary"))
    flat = docs.select(
        key.alias("doc_id"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
        shard_of(key, tree).alias("shard"),
        (shard_of(key, grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
    )
    return numbered(flat, "shard", "doc_id", "slot", docs.count())
