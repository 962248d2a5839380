"""Queues, stacks and staging areas as ordered frames: what goes in is a union, what comes out is decided by the order.

A queue is a value: each step gives a new one, or a frame of what was taken. So a program that enqueues, closes and dequeues becomes one plan, and rows that stay are rows of a frame.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillflow.functions.random import draw
from rillflow.operators import window
from rillflow.operators.ordering import numbered


class QueueClosed(RuntimeError):
    """Something was to be put into a closed queue."""


@dataclass(frozen=True)
class Queue:
    """``rows`` by the order in which they come out: ``order``, and for a priority queue ``priority`` before it (smallest first). ``capacity`` counts rows, None: no bound."""

    rows: DataFrame
    order: tuple[str, ...]
    priority: str | None = None
    seed: int | None = None
    capacity: int | None = None
    closed: bool = False

    @classmethod
    def fifo(cls, rows: DataFrame, *order: str, capacity: int | None = None) -> Queue:
        return cls(rows, order, capacity=capacity)

    @classmethod
    def prioritised(cls, rows: DataFrame, priority: str, *order: str) -> Queue:
        return cls(rows, order, priority=priority)

    @classmethod
    def random(cls, rows: DataFrame, seed: int, *order: str) -> Queue:
        """Rows come out in an order that the seed alone decides."""
        return cls(rows, order, seed=seed)

    def _placed(self) -> DataFrame:
        if self.seed is not None:
            return numbered(self.rows.withColumn("_draw", draw(self.seed, *self.order)), ["_draw", *self.order], "at").drop("_draw")
        return numbered(self.rows, [*([self.priority] if self.priority else []), *self.order], "at")

    def enqueue_many(self, rows: DataFrame) -> Queue:
        """With further rows, whose order must follow. What is beyond the capacity is an error when the queue is read."""
        if self.closed:
            raise QueueClosed("the queue is closed")
        return replace(self, rows=self.rows.unionByName(rows))

    def _checked(self) -> DataFrame:
        placed = self._placed()
        if self.capacity is None:
            return placed
        return placed.where(F.when(F.col("at") < self.capacity, F.lit(True)).otherwise(F.raise_error(F.lit("the queue is full")).cast("boolean")))

    def close(self, cancel_pending: bool = False) -> Queue:
        """Takes nothing more; what is in it can still be taken, unless pending rows are cancelled."""
        return replace(self, closed=True, rows=self.rows.limit(0) if cancel_pending else self.rows)

    def is_closed(self) -> bool:
        return self.closed

    def size(self) -> DataFrame:
        """(n)."""
        return self.rows.agg(F.count(F.lit(1)).alias("n"))

    def dequeue(self) -> tuple[DataFrame, Queue]:
        """The first row, and the queue without it."""
        return self.take(1)

    def take(self, n: int) -> tuple[DataFrame, Queue]:
        placed = self._checked()
        return placed.where(F.col("at") < n), replace(self, rows=placed.where(F.col("at") >= n).drop("at"))

    def dequeue_many(self, n: int, value: str | Column) -> DataFrame:
        """(batch, items, n): batches of exactly n; rows that don't fill one stay, as an open queue would wait for more."""
        return window.batch(self._checked(), n, ["at"], value, drop_remainder=True)

    def dequeue_up_to(self, n: int, value: str | Column) -> DataFrame:
        """(batch, items, n): as ``dequeue_many``, and once the queue is closed a short last batch."""
        return window.batch(self._checked(), n, ["at"], value, drop_remainder=not self.closed)

    def dequeue_padded(self, n: int, value: str, padding: Column) -> DataFrame:
        """Batches of arrays, each padded to the longest of its batch."""
        return window.padded_batch(self._checked(), n, ["at"], value, padding)


def popped(rows: DataFrame, order: list[str], n: int) -> tuple[DataFrame, DataFrame]:
    """A stack: the last n rows in, last first as ``at``; and what is left."""
    size = rows.agg(F.count(F.lit(1)).alias("_n"))
    placed = numbered(rows, order, "_pos").join(F.broadcast(size), F.col("_n").isNotNull()).withColumn("at", F.col("_n") - 1 - F.col("_pos")).drop("_n", "_pos")
    return placed.where(F.col("at") < n), placed.where(F.col("at") >= n).drop("at")


def staged(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, fields): a staging area to which the fields of a key come one by one; those of complete keys. Each row holds one field, the others null; a field that comes twice is an error."""
    once = [F.when(F.count(f) <= 1, F.first(f, ignorenulls=True)).otherwise(F.raise_error(F.lit(f"field {f} was staged twice"))).alias(f) for f in fields]
    out = rows.groupBy(key).agg(*once)
    for f in fields:
        out = out.where(F.col(f).isNotNull())
    return out


def unstaged(area: DataFrame, key: str, keys: DataFrame | None = None, n: int = 1) -> tuple[DataFrame, DataFrame]:
    """What is taken, and what is left: the rows of ``keys``, or those of the n smallest keys of an ordered area."""
    if keys is None:
        keys = area.select(key).distinct().orderBy(key).limit(n)
    wanted = keys.select(F.col(key).alias("_k")).distinct()
    return area.join(wanted, F.col(key) == F.col("_k"), "left_semi"), area.join(wanted, F.col(key) == F.col("_k"), "left_anti")
