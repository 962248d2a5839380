"""Positions in an explicit order, without gathering all rows in one task.

Rows are cut into ranges of the order by bounds taken from a sample of its keys; each range is numbered by itself and moved up by the sizes of
the ranges before it. There are as many ranges as the rows ask for (``ROWS_A_RANGE``), up to ``MOST_RANGES``, so no range grows with the data until there are
that many. The bounds and the ranges' sizes are no more rows than there are ranges: the bounds stand in the plan, the sizes are broadcast.

A pass over the order's columns counts the rows where the plan's statistics don't tell, one samples keys, one counts the ranges; all are pruned to these columns.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_A_RANGE = 1_000_000
LEAST_RANGES, MOST_RANGES = 64, 65_536
#: Sampled keys for each range: the more, the more even the ranges.
OVERSAMPLED = 8
#: Bounds that are told apart at once; more stand in levels.
FAN = 64
#: A size in bytes that a plan's statistics give where they know nothing, or nearly so.
UNKNOWN_BYTES = 1 << 50


def estimated_rows(df: DataFrame) -> int:
    """From the plan's statistics; counted where these are of no use."""
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    if stats.rowCount().isDefined():
        return int(str(stats.rowCount().get()))
    size = int(str(stats.sizeInBytes()))
    return df.count() if size >= UNKNOWN_BYTES else size // 16


def bounds(df: DataFrame, order: list[str]) -> list:
    """The keys at which ranges begin, ascending; the range before the first is one more."""
    keys = df.select(*order).dropna()
    rows = max(1, estimated_rows(keys))
    ranges = min(MOST_RANGES, max(LEAST_RANGES, rows // ROWS_A_RANGE))
    wanted = OVERSAMPLED * ranges
    share = min(1.0, 4 * wanted / rows)
    found: list = []
    for part in dict.fromkeys((share, 1.0)):  # a filter may leave far fewer rows than the statistics say
        thin = keys if part == 1.0 else keys.where(F.pmod(F.xxhash64(F.lit(11), *order), F.lit(1 << 40)) < int(part * (1 << 40)))
        sample = {tuple(r) for r in thin.orderBy(F.xxhash64(*order), *order).limit(wanted).collect()}
        found = sorted(k for k in sample if all(v == v for v in k))  # NaN, which is the greatest, is no bound
        if len(found) >= LEAST_RANGES:
            break
    else:
        return []
    step = max(1, len(found) / ranges)
    return [found[int(k * step)] for k in range(1, math.ceil(len(found) / step))]


def range_of(df: DataFrame, order: list[str]) -> Column:
    """The number of the range that a row's key falls into. A null key, which is the least, is of the first."""
    keys = bounds(df, order)
    if not keys:
        return F.lit(0)
    types = {f.name: f.dataType for f in df.select(*order).schema.fields}
    literal = lambda key: F.lit(key[0]).cast(types[order[0]]) if len(order) == 1 else F.struct(*[F.lit(v).cast(types[c]).alias(c) for v, c in zip(key, order, strict=True)])
    own = F.col(order[0]) if len(order) == 1 else F.struct(*order)

    def halving(low: int, high: int, at: list) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(literal(at[middle]) <= own, halving(middle + 1, high, at)).otherwise(halving(low, middle, at))

    def level(at: list) -> Column:
        """The number of ``at`` that are not above the key: first among every FAN-th, then among those that follow it."""
        if len(at) < FAN:
            return halving(0, len(at), at)
        coarse = level(at[FAN - 1 :: FAN])
        rest = [at[k : k + FAN - 1] for k in range(0, len(at) + 1, FAN)]
        inside = F.array(*[F.array(*[literal(k) for k in part]) if part else F.slice(F.array(literal(at[0])), 1, 0) for part in rest])
        return coarse * FAN + F.coalesce(F.size(F.filter(F.get(inside, coarse), lambda b: b <= own)), F.lit(0))

    return F.coalesce(level(keys), F.lit(0))


def _before(df: DataFrame, total: Column, partition: list[str], reverse: bool = False) -> DataFrame:
    """For each range (of each partition) the total of the ranges before it (after it, if ``reverse``)."""
    by = [*partition] if partition else [F.lit(0)]
    window = Window.partitionBy(*by).orderBy(F.col("_range").desc() if reverse else F.col("_range").asc()).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*partition, "_range").agg(total.alias("_total"))
    return sums.select(*partition, "_range", F.sum("_total").over(window).alias("_before"))


def _with_before(here: DataFrame, sums: DataFrame, partition: list[str]) -> DataFrame:
    """``here`` with ``_before``. Without partitions there are at most MOST_RANGES sums, which are broadcast; else Spark chooses by size. Null keys meet."""
    if not partition:
        return here.join(F.broadcast(sums), "_range")
    renamed = sums.select(*[F.col(c).alias(f"_p{k}") for k, c in enumerate(partition)], F.col("_range").alias("_pr"), "_before")
    same = F.col("_range") == F.col("_pr")
    for k, c in enumerate(partition):
        same = same & F.col(c).eqNullSafe(F.col(f"_p{k}"))
    return here.join(renamed, same).drop("_pr", *[f"_p{k}" for k in range(len(partition))])


def numbered(df: DataFrame, order: list[str], name: str = "pos", start: int = 0, partition: list[str] | None = None, spread: bool = False) -> DataFrame:
    """``df`` with dense positions from ``start`` in ascending ``order``, which must be total; within each ``partition`` if given.

    A partition's rows meet in one task unless ``spread``: then its ranges do, so a few partitions, or one that holds most rows, may be of any size.
    """
    if partition and not spread:
        window = Window.partitionBy(*partition).orderBy(*order)
        return df.withColumn(name, (F.row_number().over(window) - 1 + start).cast("long"))
    by = partition or []
    ranged = df.withColumn("_range", range_of(df, order))
    window = Window.partitionBy(*by, "_range").orderBy(*order)
    here = _with_before(ranged.withColumn("_in_range", F.row_number().over(window)), _before(ranged, F.count(F.lit(1)), by), by)
    return here.withColumn(name, (F.col("_in_range") - 1 + F.coalesce("_before", F.lit(0)) + start).cast("long")).drop("_range", "_in_range", "_before")


def running(df: DataFrame, value: str, order: list[str], name: str, partition: list[str] | None = None, exclusive: bool = False, reverse: bool = False, spread: bool = False) -> DataFrame:
    """``df`` with the running sum of ``value``; over the whole table in two steps, as ``numbered``, or within each ``partition``."""
    cols = [F.col(c).desc() if reverse else F.col(c).asc() for c in order]
    end = -1 if exclusive else 0
    if partition and not spread:
        window = Window.partitionBy(*partition).orderBy(*cols).rowsBetween(Window.unboundedPreceding, end)
        return df.withColumn(name, F.coalesce(F.sum(value).over(window), F.lit(0)))
    by = partition or []
    ranged = df.withColumn("_range", range_of(df, order))
    window = Window.partitionBy(*by, "_range").orderBy(*cols).rowsBetween(Window.unboundedPreceding, end)
    here = _with_before(ranged.withColumn("_up_in_range", F.sum(value).over(window)), _before(ranged, F.sum(value), by, reverse), by)
    return here.withColumn(name, F.coalesce("_up_in_range", F.lit(0)) + F.coalesce("_before", F.lit(0))).drop("_range", "_up_in_range", "_before")
