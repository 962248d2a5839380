"""Batches and count-based windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillflow.operators.ordering import numbered


def gathered(order: list[str], value: Column | str) -> Column:
    """The values of a group as an array in ``order``."""
    value = F.col(value) if isinstance(value, str) else value
    return F.transform(F.array_sort(F.collect_list(F.struct(*order, value.alias("_v")))), lambda x: x["_v"])


def batch(df: DataFrame, size: int, order: list[str], value: str | Column, drop_remainder: bool = False, partition: list[str] | None = None) -> DataFrame:
    """(partition..., batch, items, n): consecutive groups of ``size`` rows; a short last one is dropped on request."""
    keys = partition or []
    placed = numbered(df, order, "_pos", partition=partition).withColumn("batch", F.floor(F.col("_pos") / size))
    out = placed.groupBy(*keys, "batch").agg(gathered(["_pos"], value).alias("items"), F.count(F.lit(1)).alias("n"))
    return out.where(F.col("n") == size) if drop_remainder else out


def padded(items: Column, length: Column | int, padding: Column) -> Column:
    length = F.lit(length) if isinstance(length, int) else length
    return F.concat(items, F.array_repeat(padding, F.greatest(length - F.size(items), F.lit(0))))


def padded_batch(df: DataFrame, size: int, order: list[str], value: str, padding: Column, length: int = -1) -> DataFrame:
    """Batches of arrays, each padded to the longest of its batch, or to ``length``; a longer array is then an error."""
    out = batch(df, size, order, value)
    longest = F.array_max(F.transform("items", lambda a: F.size(a)))
    to = longest if length < 0 else F.when(F.assert_true(longest <= length, F.lit("an element is longer than the fixed length")).isNull(), F.lit(length))
    return out.withColumn("length", to).withColumn("items", F.transform("items", lambda a: padded(a, F.col("length"), padding)))


def dense_to_sparse_batch(df: DataFrame, size: int, order: list[str], value: str) -> DataFrame:
    """(batch, row, col, value): each batch of arrays as coordinates."""
    placed = numbered(df, order, "_pos")
    return placed.select(F.floor(F.col("_pos") / size).alias("batch"), (F.col("_pos") % size).alias("row"), F.posexplode(value).alias("col", "value"))


def sliding_window(df: DataFrame, size: int, order: list[str], value: str, shift: int = 1, stride: int = 1) -> DataFrame:
    """(start, items): windows of ``size`` values, ``stride`` apart, one for every ``shift`` rows; incomplete ones are dropped.

    Each row goes to the windows that it is in, so the work is spread by window, not held by one ordered pass.
    """
    placed = numbered(df, order, "_pos")
    starts = F.filter(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.col("_pos") - k * stride), lambda s: (s >= 0) & (s % shift == 0))
    out = placed.select("_pos", F.col(value).alias("_v"), F.explode(starts).alias("start")).groupBy("start").agg(gathered(["_pos"], "_v").alias("items"))
    return out.where(F.size("items") == size)


def window_datasets(df: DataFrame, size: int, order: list[str], columns: list[str], shift: int | None = None, stride: int = 1, drop_remainder: bool = True) -> DataFrame:
    """(window, part, item): windows as small tables of their own: each row of a window with its place ``part``. ``shift`` (``size``, if None) rows lie between the starts of windows, ``stride`` between a window's
    rows; windows cut short by the end are kept on request. To be grouped by ``window``, or unnested again."""
    shift = shift or size
    placed = numbered(df, order, "_pos")
    starts = F.filter(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.struct((F.col("_pos") - k * stride).alias("start"), k.alias("part"))), lambda s: (s["start"] >= 0) & (s["start"] % shift == 0))
    out = placed.select(F.struct(*columns).alias("item"), F.explode(starts).alias("_s")).select(F.floor(F.col("_s.start") / shift).alias("window"), F.col("_s.part").alias("part"), "item")
    if not drop_remainder:
        return out
    whole = out.groupBy("window").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == size).select("window")
    return out.join(whole, "window", "left_semi")


def dynamic_batches(df: DataFrame, time: str, order: list[str], most: int, timeout: str, value: str, partition: list[str] | None = None) -> DataFrame:
    """(partition..., open, batch, items, n): batches of at most ``most`` rows that came within one interval of ``timeout``: what a server gathers before it runs."""
    keys = [*(partition or []), "open"]
    opened = df.withColumn("open", F.window(time, timeout)["start"])
    placed = numbered(opened, order, "_pos", partition=keys).withColumn("batch", F.floor(F.col("_pos") / most))
    return placed.groupBy(*keys, "batch").agg(gathered(["_pos"], value).alias("items"), F.count(F.lit(1)).alias("n"))


def group_by_window(df: DataFrame, key: list[str], size: int, order: list[str], *aggregates: Column, spread: bool = False) -> DataFrame:
    """For each key, aggregates over consecutive windows of up to ``size`` rows; the last may be short. ``spread``: for keys of which one may hold a large share of all rows."""
    placed = numbered(df, order, "_pos", partition=key, spread=spread).withColumn("window", F.floor(F.col("_pos") / size))
    return placed.groupBy(*key, "window").agg(*aggregates)


def length_bucket(length: Column, boundaries: list[int]) -> Column:
    """The number of boundaries that are not above ``length``."""
    return F.size(F.filter(F.array(*map(F.lit, boundaries)), lambda b: b <= length))


def bucket_by_length(df: DataFrame, length: Column, boundaries: list[int], sizes: list[int], order: list[str], value: str) -> DataFrame:
    """Batches of rows of like length; ``sizes``: the batch size of each bucket, one more than boundaries."""
    sized = df.withColumn("bucket", length_bucket(length, boundaries)).withColumn("_size", F.element_at(F.array(*map(F.lit, sizes)), F.col("bucket") + 1))
    placed = numbered(sized, order, "_pos", partition=["bucket"], spread=True).withColumn("batch", F.floor(F.col("_pos") / F.col("_size")))
    return placed.groupBy("bucket", "batch").agg(gathered(["_pos"], value).alias("items"), F.count(F.lit(1)).alias("n"))


def scan(df: DataFrame, key: list[str], order: list[str], step: Callable, initial: tuple, schema: str) -> DataFrame:
    """An ordered fold for each key that gives out every step: ``step(state, row) -> (state, output tuple)``. A key's rows meet in one task."""

    def run(pdf):
        import pandas as pd

        state, out = initial, []
        for row in pdf.sort_values(order).itertuples(index=False):
            state, made = step(state, row)
            out.append(made)
        return pd.DataFrame(out, columns=[c.strip().split(" ")[0] for c in schema.split(",")])

    return df.groupBy(*key).applyInPandas(run, schema)


def scan_sums(df: DataFrame, order: list[str], value: str, initial: int | float = 0, name: str = "state") -> DataFrame:
    """The scan whose step adds: the state after each row, over the whole table, spread over ranges."""
    from rillflow.operators.ordering import running

    return running(df, value, order, "_sum").withColumn(name, F.lit(initial) + F.col("_sum")).drop("_sum")


def cumulative_product(df: DataFrame, value: str, order: list[str], partition: list[str], name: str, last: int | None = None) -> DataFrame:
    """``df`` with the product of the values up to each row, or of the ``last`` ones."""
    window = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding if last is None else 1 - last, 0)
    return df.withColumn(name, F.product(F.col(value)).over(window))


def periodic_resample(items: Column, size: int) -> Column:
    """An array of ``size`` elements that repeats or thins ``items`` evenly: element i comes from place i * length div size."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.get(items, F.floor(i * F.size(items) / size).cast("int")))
