"""Reducers: keyed, whole-table, segment, counting, quantile and contingency aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillflow.operators.ordering import numbered, running

REDUCERS = {"sum": F.sum, "prod": F.product, "min": F.min, "max": F.max, "mean": F.avg}


def group_by_reducer(df: DataFrame, key: Column, *aggregates: Column) -> DataFrame:
    """One row for each key after all input; the aggregates combine before they shuffle."""
    return df.groupBy(key.alias("key")).agg(*aggregates)


def reduce_all(df: DataFrame, **aggregates: tuple[Column, Column]) -> DataFrame:
    """One row: each aggregate, or its identity on empty input. ``name=(aggregate, identity)``."""
    return df.agg(*[F.coalesce(a, i).alias(n) for n, (a, i) in aggregates.items()])


def segment(df: DataFrame, ids: str, value: str, how: str, segments: int, empty: Column) -> DataFrame:
    """(segment, value): a row for each of ``segments``, ``empty`` where there are no rows; ids out of range are dropped."""
    inside = df.where((F.col(ids) >= 0) & (F.col(ids) < segments)).groupBy(F.col(ids).cast("long").alias("segment")).agg(REDUCERS[how](F.col(value)).alias("value"))
    return df.sparkSession.range(segments).select(F.col("id").alias("segment")).join(inside, "segment", "left").select("segment", F.coalesce("value", empty).alias("value"))


def sorted_segment(df: DataFrame, ids: str, value: str, how: str, order: list[str]) -> DataFrame:
    """(segment, value): a row for each segment up to the largest, 0 where there are no rows. Ids that fall in ``order``, or are negative, are an error.

    One aggregate counts falls: a row's id against the largest before it in its range, and the ranges against each other, so no task sees the whole order.
    """
    from rillflow.operators.ordering import range_of

    ranged = df.withColumn("_range", range_of(df, order))
    here = Window.partitionBy("_range").orderBy(*order)
    falls = ranged.select("_range", F.col(ids).alias("_id"), (F.col(ids) < F.lag(ids).over(here)).alias("_fall"))
    parts = falls.groupBy("_range").agg(F.min("_id").alias("_low"), F.max("_id").alias("_high"), F.coalesce(F.bool_or("_fall"), F.lit(False)).alias("_fall"))
    across = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    checked = parts.withColumn("_before", F.max("_high").over(across)).agg(F.max("_high").alias("_top"), F.bool_or(F.col("_fall") | (F.col("_low") < F.coalesce("_before", F.col("_low"))) | (F.col("_low") < 0)).alias("_bad"))
    top = F.when(F.col("_bad"), F.raise_error(F.lit("segment ids are not sorted")).cast("long")).otherwise(F.col("_top"))
    grid = checked.select(F.explode(F.when(top >= 0, F.sequence(F.lit(0).cast("long"), top.cast("long"))).otherwise(F.array().cast("array<bigint>"))).alias("segment"))
    found = df.groupBy(F.col(ids).cast("long").alias("segment")).agg(REDUCERS[how](F.col(value)).alias("value"))
    return grid.join(found, "segment", "left").fillna(0, ["value"])


def sparse_segment(df: DataFrame, params: DataFrame, index: str, ids: str, params_pos: str, value: str, how: str, segments: int | None = None) -> DataFrame:
    """(segment, value): gathers ``params`` by ``index``, then reduces: sum, mean, or sqrtn (the sum over the square root of the count). With ``segments``, a row for each of so many, 0 where there are none."""
    met = df.join(params, df[index] == params[params_pos])
    total = {"sum": F.sum(value), "mean": F.avg(value), "sqrtn": F.sum(value) / F.sqrt(F.count(F.lit(1)))}[how]
    found = met.groupBy(F.col(ids).alias("segment")).agg(total.alias("value"))
    if segments is None:
        return found
    return df.sparkSession.range(segments).select(F.col("id").alias("segment")).join(found, "segment", "left").fillna(0, ["value"])


def bincount(df: DataFrame, value: str, size: int, weight: str | None = None) -> DataFrame:
    """(value, n): counts, or sums of weights, for 0 to size - 1. Larger values are left out; a negative one is an error."""
    checked = df.where(F.when(F.col(value) < 0, F.raise_error(F.lit("negative value in bincount"))).otherwise(F.lit(True)) & (F.col(value) < size))
    total = F.sum(weight) if weight else F.count(F.lit(1))
    counted = checked.groupBy(F.col(value).cast("long").alias("value")).agg(total.alias("n"))
    return df.sparkSession.range(size).select(F.col("id").alias("value")).join(counted, "value", "left").fillna(0, ["n"])


def unique_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; (key, rest) by minimum, so rows combine before they shuffle."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    order_only = [c for c in order if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*order_only, *rest) if order_only or rest else F.lit(1), F.struct(*order)).alias("_first"))
    return first.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in [*order_only, *rest]])


def unique_with_counts(df: DataFrame, value: str, order: list[str]) -> DataFrame:
    """(value, count, id): distinct values with their counts, numbered from 0 by first occurrence."""
    found = df.groupBy(value).agg(F.count(F.lit(1)).alias("count"), F.min(F.struct(*order)).alias("_first"))
    flat = found.select(value, "count", *[F.col(f"_first.{c}").alias(f"_o_{c}") for c in order])
    return numbered(flat, [f"_o_{c}" for c in order], "id").drop(*[f"_o_{c}" for c in order])


def unique_inverse(df: DataFrame, value: str, order: list[str]) -> DataFrame:
    """``df`` with the number of each row's value in order of first occurrence."""
    return df.join(unique_with_counts(df, value, order).select(value, "id"), value)


def histogram_bin(value: Column, low: float, high: float, bins: int) -> Column:
    """The equal-width bin of a value; the ends take what lies beyond them."""
    return F.least(F.greatest(F.floor(bins * (value - low) / (high - low)), F.lit(0)), F.lit(bins - 1))


def histogram_fixed_width(df: DataFrame, value: Column, low: float, high: float, bins: int) -> DataFrame:
    found = df.groupBy(histogram_bin(value, low, high, bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return df.sparkSession.range(bins).select(F.col("id").alias("bin")).join(found, "bin", "left").fillna(0, ["n"])


def log_histogram(df: DataFrame, value: str, growth: float = 1.1) -> DataFrame:
    """(bucket, n): counts by powers of ``growth`` of the magnitude, with the sign; 0 is bucket 0."""
    size = F.floor(F.log(F.abs(F.col(value)) + 1) / F.log(F.lit(growth))) + 1
    return df.groupBy(F.when(F.col(value) == 0, 0).otherwise(F.signum(value) * size).cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def arg_best(df: DataFrame, keys: list[str], value: str, order: str, largest: bool = True) -> DataFrame:
    """(keys, arg, best): where each group's extreme value stands; of equal ones the first."""
    score = F.struct(F.col(value), -F.col(order)) if largest else F.struct(-F.col(value), -F.col(order))
    return df.groupBy(*keys).agg(F.max_by(F.col(order), score).alias("arg"), (F.max(value) if largest else F.min(value)).alias("best"))


def _up_to(df: DataFrame, keys: list[str], value: str, weight: Column) -> DataFrame:
    """(keys, value, _w, _up, _all): equal values merged, with their weight, the weight up to and with them, and that of their group. Ranges of values are summed by themselves, so a group of any size is spread."""
    merged = df.groupBy(*keys, value).agg(F.sum(weight).alias("_w"))
    ranked = running(merged, "_w", [value], "_up", partition=keys, spread=True)
    total = merged.groupBy(*keys).agg(F.sum("_w").alias("_all"))
    same = F.lit(True)
    for k, c in enumerate(keys):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{k}"))
    return ranked.join(total.withColumnsRenamed({c: f"_k{k}" for k, c in enumerate(keys)}), same).drop(*[f"_k{k}" for k in range(len(keys))])


def quantiles(df: DataFrame, keys: list[str], value: str, at: list[float]) -> DataFrame:
    """Exact interpolated quantiles q0, q1, ... of each group; null values don't count."""
    ranked = _up_to(df.where(F.col(value).isNotNull()), keys, value, F.lit(1))
    out = []
    for k, q in enumerate(at):
        place = F.lit(q) * (F.col("_all") - 1)
        holds = lambda p: (F.col("_up") - F.col("_w") <= p) & (p < F.col("_up"))
        low, high = F.max(F.when(holds(F.floor(place)), F.col(value))), F.max(F.when(holds(F.ceil(place)), F.col(value)))
        share = F.max(place - F.floor(place))
        out.append((low + (high - low) * share).alias(f"q{k}"))
    return ranked.groupBy(*keys).agg(*out)


def weighted_quantile(df: DataFrame, keys: list[str], value: str, weight: str, at: float) -> DataFrame:
    """(keys, value): the least value at which the weights up to it reach ``at`` of all; weights of 0 or less don't count, equal values merge."""
    return weighted_quantiles(df, keys, value, weight, [at]).select(*keys, F.col("q0").alias(value))


def weighted_quantiles(df: DataFrame, keys: list[str], value: str, weight: str, at: list[float]) -> DataFrame:
    """(keys, q0, q1, ...): as ``weighted_quantile``, several at once."""
    ranked = _up_to(df.where(F.col(weight) > 0), keys, value, F.col(weight))
    return ranked.groupBy(*keys).agg(*[F.min(F.when(F.col("_up") >= q * F.col("_all"), F.col(value))).alias(f"q{k}") for k, q in enumerate(at)])


def nth_element(df: DataFrame, keys: list[str], value: str, n: int, ties: list[str], reverse: bool = False) -> DataFrame:
    """(keys, value): the n-th value (from 0) of each group, from the other end if ``reverse``; groups with fewer have no row. A group of any size is spread over ranges of its values."""
    placed = numbered(df, [value, *ties], "_at", partition=keys, spread=True)
    if not reverse:
        return placed.where(F.col("_at") == n).select(*keys, value)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return placed.join(sizes, keys).where(F.col("_at") == F.col("_n") - 1 - n).select(*keys, value)


def confusion_matrix(df: DataFrame, label: str, prediction: str, weight: Column | None = None) -> DataFrame:
    return df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(F.sum(weight if weight is not None else F.lit(1)).cast("long").alias("n"))


def stats_summary(df: DataFrame, keys: list[str], gradient: str, hessian: str) -> DataFrame:
    """Sums of gradients and hessians by feature, node and bucket."""
    return df.groupBy(*keys).agg(F.sum(gradient).alias("gradient"), F.sum(hessian).alias("hessian"))


def reduce_slices(df: DataFrame, ranges: DataFrame, position: str, value: str, how: str = "sum", width: int = 1024) -> DataFrame:
    """(range_id, value): reduces the rows whose position is in [start, end) of each range; joined on blocks of positions, not row by row."""
    blocks = ranges.select("range_id", "start", "end", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))).alias("_block"))
    met = df.withColumn("_block", F.floor(F.col(position) / width)).join(blocks, "_block").where((F.col(position) >= F.col("start")) & (F.col(position) < F.col("end")))
    return met.groupBy("range_id").agg(REDUCERS[how](F.col(value)).alias("value"))


def add_n(frames: list[DataFrame], key: str, value: str) -> DataFrame:
    """The element-wise sum of frames of one key."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out.groupBy(key).agg(F.sum(value).alias(value))


def fold(df: DataFrame, keys: list[str], order: list[str], value: str, initial: Column, step, finish=None, name: str = "value") -> DataFrame:
    """An ordered fold of each key's values: ``step(state, value)``, then ``finish(state)``. A key's values meet in one array."""
    values = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v")))), lambda x: x["_v"])
    gathered = df.groupBy(*keys).agg(values.alias("_values"))
    return gathered.select(*keys, (F.aggregate("_values", initial, step, finish) if finish else F.aggregate("_values", initial, step)).alias(name))


def observed(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, object]:
    """``df`` with metrics gathered as it runs, and what gives them afterwards."""
    from pyspark.sql import Observation

    watch = Observation(name)
    return df.observe(watch, *[c.alias(n) for n, c in metrics.items()]), watch
