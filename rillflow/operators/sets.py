"""Set operations on rows of arrays and on tables, and routing between flows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillflow.functions.random import TOP, draw, unit
from rillflow.operators.ordering import numbered, running

OPERATIONS = {"union": F.array_union, "intersection": F.array_intersect, "a-b": F.array_except, "b-a": lambda a, b: F.array_except(b, a)}


def row_sets(a: Column, b: Column, operation: str) -> Column:
    """The sorted distinct result of a set operation on two arrays of one row."""
    return F.array_sort(OPERATIONS[operation](a, b))


def set_size(a: Column) -> Column:
    return F.size(F.array_distinct(a))


def list_diff(x: DataFrame, y: DataFrame, value: str, other: str) -> DataFrame:
    """Rows of x whose value is not in y; their order and repeats stay."""
    return x.join(y.select(F.col(other).alias("_y")).distinct(), x[value] == F.col("_y"), "left_anti")


def dynamic_partition(df: DataFrame, part: str, parts: int) -> list[DataFrame]:
    """One frame for each partition id."""
    return [df.where(F.col(part) == k) for k in range(parts)]


def dynamic_stitch(frames: list[DataFrame], index: str, value: str) -> DataFrame:
    """(index, value): the frames laid over one another; where an index comes twice the later frame wins."""
    tagged = [f.select(F.col(index), F.col(value), F.lit(k).alias("_frame")) for k, f in enumerate(frames)]
    return reduce(DataFrame.unionByName, tagged).groupBy(index).agg(F.max_by(value, "_frame").alias(value))


def choose_from(frames: list[DataFrame], orders: list[list[str]], choices: DataFrame, choice: str, order: list[str]) -> DataFrame:
    """For each choice in order, the next row of the frame it names."""
    wanted = numbered(numbered(choices, order, "at").select("at", F.col(choice).alias("frame")), ["at"], "turn", partition=["frame"])
    rows = [numbered(f, o, "turn").withColumn("frame", F.lit(k)) for k, (f, o) in enumerate(zip(frames, orders, strict=True))]
    return wanted.join(reduce(DataFrame.unionByName, rows), ["frame", "turn"]).drop("turn")


def sample_from(frames: list[DataFrame], orders: list[list[str]], weights: list[float], seed: int) -> DataFrame:
    """(frame, turn, at, ...): a random interleave. Each place takes the next row of a frame drawn with the frames' weights; when a frame is used up, the others go on among themselves.

    Row ``turn`` of a frame arrives when so many exponential waits, each divided by the frame's weight, are over; rows in order of arrival are just such draws, and no row waits for another.
    """
    parts = []
    for k, (frame, order, weight) in enumerate(zip(frames, orders, weights, strict=True)):
        placed = numbered(frame, order, "turn").withColumn("frame", F.lit(k))
        wait = F.floor(-F.log(unit(seed, "frame", "turn")) * F.lit((1 << 20) / weight)).cast("long")
        parts.append(running(placed.withColumn("_wait", wait), "_wait", ["turn"], "_due").drop("_wait"))
    together = reduce(DataFrame.unionByName, parts)
    return numbered(together, ["_due", "frame", "turn"], "at").drop("_due")


def rejection_resample(df: DataFrame, label: str, target: dict, initial: dict, seed: int, key: list[str]) -> DataFrame:
    """Rows kept so that labels come in the ``target`` shares, given their ``initial`` ones."""
    ratio = {k: target[k] / initial[k] for k in target}
    most = max(ratio.values())
    chance = F.create_map(*[x for k, r in ratio.items() for x in (F.lit(k), F.lit(int(r / most * TOP)))])
    return df.where(draw(seed, *key) < F.coalesce(F.try_element_at(chance, F.col(label)), F.lit(0)))


def sparse_set_operation(a: DataFrame, b: DataFrame, group: list[str], value: str, operation: str) -> DataFrame:
    """(group..., value): a set operation on the values of each group, both sides given as one value a row; groups of either side count."""
    both = a.select(*group, value, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(b.select(*group, value, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    met = both.groupBy(*group, value).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    keep = {"union": F.lit(True), "intersection": (F.col("_a") == 1) & (F.col("_b") == 1), "a-b": F.col("_b") == 0, "b-a": F.col("_a") == 0}[operation]
    return met.where(keep).select(*group, value)


def dense_to_sparse_set_operation(a: DataFrame, items: str, b: DataFrame, group: list[str], value: str, operation: str) -> DataFrame:
    """As ``sparse_set_operation``, side ``a`` given as one array a group."""
    return sparse_set_operation(a.select(*group, F.explode(items).alias(value)), b, group, value, operation)
