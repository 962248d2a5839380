"""Orders, limits and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillflow.functions.random import draw
from rillflow.operators.ordering import numbered


def top_k_per_row(df: DataFrame, row: list[str], value: str, k: int, ties: list[str]) -> DataFrame:
    """The k largest of each row with their rank; of equal values those first in ``ties``. Tasks keep k a row before they shuffle."""
    window = Window.partitionBy(*row).orderBy(F.col(value).desc(), *ties)
    return df.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def top_k(df: DataFrame, value: str, k: int, ties: list[str]) -> DataFrame:
    return df.orderBy(F.col(value).desc(), *ties).limit(k)


def in_top_k(predictions: Column, target: Column, k: int) -> Column:
    """Fewer than k predictions are strictly greater than the target's; false if any is not finite or the target is out of range."""
    bad = F.exists(predictions, lambda p: F.isnan(p) | (F.abs(p) == float("inf")))
    chosen = F.get(predictions, target)
    return F.coalesce(chosen.isNotNull() & ~bad & (F.size(F.filter(predictions, lambda p: p > chosen)) < k), F.lit(False))


def shuffled(df: DataFrame, seed: int, order: list[str]) -> DataFrame:
    """A full random order that the seed alone decides, with each row's place in it as ``at``."""
    drawn = df.withColumn("_draw", draw(seed, *order))
    return numbered(drawn, ["_draw", *order], "at").drop("_draw").orderBy("at")


def buffered_shuffle(df: DataFrame, buffer: int, seed: int, order: list[str]) -> DataFrame:
    """``df`` with ``at``: a random order in which rows pass one another only within about ``buffer`` places, as if drawn from a buffer of that size. 1 changes nothing."""
    placed = numbered(df, order, "_pos").withColumn("_key", F.col("_pos") * 65536 + F.shiftright(draw(seed, *order), 16) * (buffer - 1))
    return numbered(placed, ["_key", "_pos"], "at").drop("_key", "_pos")


def shuffle_and_repeat(df: DataFrame, epochs: int, seed: int, order: list[str]) -> DataFrame:
    """``epochs`` permutations one after the other, each of its own; ``at`` is the place in the whole."""
    from rillflow.operators.transform import repeat

    drawn = repeat(df, epochs).withColumn("_draw", draw(seed, "epoch", *order))
    return numbered(drawn, ["epoch", "_draw", *order], "at").drop("_draw").orderBy("at")


def coordinate_sorted(df: DataFrame, ref: str = "ref_index", position: str = "position", *ties: str) -> DataFrame:
    """A table sorted by coordinate across and within partitions, ready to be written."""
    return df.repartitionByRange(ref, position, *ties).sortWithinPartitions(ref, position, *ties)


def merge_sorted(chunks: list[DataFrame], by: list[str]) -> DataFrame:
    """Sorted chunks as one sorted table: ranges of the key meet, each is merged by itself; no chunk is sorted whole again."""
    out = chunks[0]
    for chunk in chunks[1:]:
        out = out.unionByName(chunk)
    return out.repartitionByRange(*by).sortWithinPartitions(*by)


def by_priority(df: DataFrame, priority: str, order: list[str]) -> DataFrame:
    """``df`` with ``at``: smallest priority first, equal ones in ``order``."""
    return numbered(df, [priority, *order], "at")


def ranked(df: DataFrame, partition: list[str], order: list[str], tiles: int = 4) -> DataFrame:
    """``df`` with row_number, rank, dense_rank and ntile in each partition. ``order`` may end in a total order; ties of all its columns share a rank."""
    window = Window.partitionBy(*partition).orderBy(*order)
    return df.withColumns({"row_number": F.row_number().over(window), "rank": F.rank().over(window), "dense_rank": F.dense_rank().over(window), "ntile": F.ntile(tiles).over(window)})


def neighbours(df: DataFrame, value: str, partition: list[str], order: list[str], offset: int = 1, default=None) -> DataFrame:
    """``df`` with ``before`` and ``after``: the values ``offset`` rows away."""
    window = Window.partitionBy(*partition).orderBy(*order)
    return df.withColumns({"before": F.lag(value, offset, default).over(window), "after": F.lead(value, offset, default).over(window)})


def order_violations(df: DataFrame, by: list[str], order: list[str], partition: list[str]) -> DataFrame:
    """Rows whose key is less than that of the row before, within each partition. Without partitions the whole order is checked, edges of chunks included."""
    if not partition:  # neighbours of ranges: each row meets the one before it by position
        placed = numbered(df, order, "_pos")
        ahead = placed.select((F.col("_pos") + 1).alias("_pos"), F.struct(*by).alias("_before"))
        return placed.join(ahead, "_pos").where(F.struct(*by) < F.col("_before")).drop("_before", "_pos")
    window = Window.partitionBy(*partition).orderBy(*order)
    key = F.struct(*by)
    return df.withColumn("_before", F.lag(key).over(window)).where(F.col("_before").isNotNull() & (key < F.col("_before"))).drop("_before")


def reverse_prefix(items: Column, length: Column) -> Column:
    """The array with its first ``length`` elements reversed."""
    n = F.least(length, F.size(items))
    head = F.when(n > 0, F.reverse(F.slice(items, 1, F.greatest(n, F.lit(1))))).otherwise(F.slice(items, 1, 0))
    return F.concat(head, F.slice(items, n + 1, F.size(items)))


def inverted(df: DataFrame, position: str, value: str) -> DataFrame:
    """(value -> position): the inverse permutation."""
    return df.select(F.col(value).alias(position), F.col(position).alias(value))
