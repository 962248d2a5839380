"""Joins and lookups: tables with defaults, out-of-vocabulary buckets, barriers, gather and scatter, contractions, as-of and range joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillflow.functions.strings import hash_bucket_md5
from rillflow.operators.ordering import range_of


def lookup(df: DataFrame, table: DataFrame, key: str, table_key: str, table_value: str, default: Column, name: str = "value") -> DataFrame:
    """Each row with the value of its key, or ``default``. A key that the table has twice is an error. Spark broadcasts the table if its size allows."""
    once = table.groupBy(F.col(table_key).alias("_key")).agg(F.first(table_value).alias("_value"), F.count(F.lit(1)).alias("_n"))
    once = once.select("_key", F.when(F.col("_n") == 1, F.col("_value")).otherwise(F.raise_error(F.lit("duplicate key in lookup table"))).alias("_value"))
    return df.join(once, df[key] == F.col("_key"), "left").withColumn(name, F.coalesce("_value", default)).drop("_key", "_value")


def lookup_oov(df: DataFrame, vocabulary: DataFrame, key: str, term: str, term_id: str, size: int, buckets: int, name: str = "id") -> DataFrame:
    """The id of a term, or, for one that isn't in the vocabulary, ``size`` and its hash bucket."""
    terms = vocabulary.select(F.col(term).alias("_term"), F.col(term_id).cast("long").alias("_id"))
    return df.join(terms, df[key] == F.col("_term"), "left").withColumn(name, F.coalesce("_id", size + hash_bucket_md5(F.col(key), buckets))).drop("_term", "_id")


def barrier(components: dict[str, DataFrame], key: str) -> DataFrame:
    """Keys for which every component has come, with all of them. Each component has the key and one column of its name."""
    out = None
    for name, frame in components.items():
        part = frame.select(key, *[F.when(F.lit(n == name), F.struct(F.col(name).alias("v"))).alias(n) if n == name else F.lit(None).alias(n) for n in components])
        out = part if out is None else out.unionByName(part)
    together = out.groupBy(key).agg(*[F.first(n, ignorenulls=True).alias(n) for n in components])
    complete = together.where(F.forall(F.array(*[F.col(n).isNotNull() for n in components]), lambda x: x))
    return complete.select(key, *[F.col(f"{n}.v").alias(n) for n in components])


def table_from_text(spark: SparkSession, path: str, schema: str, key: str | None = None, value: str | None = None, delimiter: str = "\t", size: int | None = None) -> DataFrame:
    """(key, value) of a text file's columns, for ``lookup``. ``key`` or ``value`` None: the line's number from 0. Another number of lines than ``size``, if given, is an error."""
    from rillflow.sources.files import numbered_lines

    lines = numbered_lines(spark, path)
    fields = F.from_csv("value", schema, {"sep": delimiter, "mode": "FAILFAST"})
    part = lambda name: F.col("line") if name is None else fields[name]
    out = lines.select(part(key).alias("key"), part(value).alias("value"))
    if size is None:
        return out
    count = out.agg(F.count(F.lit(1)).alias("_n")).select(F.when(F.col("_n") == size, F.col("_n")).otherwise(F.raise_error(F.lit("the file has another number of lines"))).alias("_n"))
    return out.join(F.broadcast(count), F.col("_n").isNotNull()).drop("_n")


class MutableTable:
    """A keyed table that changes by whole frames: each change makes a new state, the last put in of equal keys counts. States are plans; ``snapshot`` cuts their lineage."""

    def __init__(self, rows: DataFrame, key: str = "key", value: str = "value"):
        self.key, self.value = key, value
        self.rows = rows.select(key, value)

    def insert(self, rows: DataFrame, order: str | None = None) -> MutableTable:
        """``order``: which of ``rows`` with one key is the last; without it keys must not repeat, else an error."""
        value = F.max_by(self.value, order) if order else F.when(F.count(F.lit(1)) == 1, F.first(self.value)).otherwise(F.raise_error(F.lit("repeated key without an order")))
        new = rows.groupBy(self.key).agg(value.alias(self.value))
        kept = self.rows.join(new.select(F.col(self.key).alias("_k")), F.col(self.key).eqNullSafe(F.col("_k")), "left_anti")
        return MutableTable(kept.unionByName(new), self.key, self.value)

    def replace(self, rows: DataFrame) -> MutableTable:
        """Only ``rows`` are left: an import."""
        return MutableTable(rows, self.key, self.value)

    def remove(self, keys: DataFrame) -> MutableTable:
        gone = keys.select(F.col(self.key).alias("_k")).distinct()
        return MutableTable(self.rows.join(gone, F.col(self.key) == F.col("_k"), "left_anti"), self.key, self.value)

    def find(self, df: DataFrame, key: str, default: Column, name: str = "found") -> DataFrame:
        return lookup(df, self.rows, key, self.key, self.value, default, name)

    def export(self) -> DataFrame:
        return self.rows

    def size(self) -> DataFrame:
        """(n)."""
        return self.rows.agg(F.count(F.lit(1)).alias("n"))

    def snapshot(self) -> MutableTable:
        from rillflow.session import cut

        return MutableTable(cut(self.rows), self.key, self.value)


def gather(indices: DataFrame, params: DataFrame, index: str, position: str) -> DataFrame:
    """The rows of ``params`` at each index; repeated indices repeat them. An index without a row is an error."""
    found = indices.join(params.withColumn("_there", F.lit(True)), indices[index] == params[position], "left")
    inside = F.when(F.col("_there"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("index out of range: "), F.coalesce(indices[index].cast("string"), F.lit("null")))).cast("boolean"))
    return found.where(inside).drop("_there")


def gather_nd(indices: DataFrame, params: DataFrame, columns: list[str], positions: list[str]) -> DataFrame:
    """``gather`` by places of several dimensions: ``columns`` of ``indices`` against ``positions`` of ``params``."""
    named = params.withColumnsRenamed({p: f"_at{k}" for k, p in enumerate(positions)}).withColumn("_there", F.lit(True))
    same = F.lit(True)
    for k, c in enumerate(columns):
        same = same & (F.col(c) == F.col(f"_at{k}"))
    inside = F.when(F.col("_there"), F.lit(True)).otherwise(F.raise_error(F.lit("index out of range")).cast("boolean"))
    return indices.join(named, same, "left").where(inside).drop("_there", *[f"_at{k}" for k in range(len(columns))])


SCATTERS = {"add": F.sum, "sub": F.sum, "mul": F.product, "div": F.product, "min": F.min, "max": F.max}


def scatter(df: DataFrame, base: DataFrame, index: str, value: str, position: str, how: str = "add") -> DataFrame:
    """``base`` with column ``value`` changed at the given indices: add, sub, mul, div, min, max, or update by the last of ``ord``. Repeated indices accumulate; those without a row change nothing."""
    change = df.groupBy(F.col(index).alias("_i")).agg((F.max_by(value, "ord") if how == "update" else SCATTERS[how](F.col(value))).alias("_c"))
    old, new = F.col(value), F.col("_c")
    result = {"add": old + new, "sub": old - new, "mul": old * new, "div": old / new, "min": F.least(old, new), "max": F.greatest(old, new), "update": new}[how]
    return base.join(change, base[position] == F.col("_i"), "left").withColumn(value, F.when(new.isNull(), old).otherwise(result)).drop("_i", "_c")


def scatter_nd(df: DataFrame, index: str, value: str, size: int) -> DataFrame:
    """(position, value): the sums of values at their indices, 0 elsewhere; an index outside [0, size) is an error."""
    checked = df.withColumn("_i", F.when((F.col(index) >= 0) & (F.col(index) < size), F.col(index)).otherwise(F.raise_error(F.lit("index out of range")).cast("long")))
    total = checked.groupBy(F.col("_i").cast("long").alias("position")).agg(F.sum(value).alias("value"))
    return df.sparkSession.range(size).select(F.col("id").alias("position")).join(total, "position", "left").fillna(0, ["value"])


def coo_matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """(i, j, v): the product of matrices given as coordinates (i, k, v) and (k, j, v)."""
    left, right = a.select("i", F.col("k"), F.col("v").alias("_a")), b.select("k", "j", F.col("v").alias("_b"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("_a") * F.col("_b")).alias("v"))


def masked_matmul(a: DataFrame, b: DataFrame, mask: DataFrame) -> DataFrame:
    """The product at the coordinates (i, j) of ``mask`` only; other products are never formed."""
    wanted = mask.select("i", "j").distinct()
    left = wanted.join(a.select("i", "k", F.col("v").alias("_a")), "i")
    return left.join(b.select("k", "j", F.col("v").alias("_b")), ["k", "j"]).groupBy("i", "j").agg(F.sum(F.col("_a") * F.col("_b")).alias("v"))


def feature_cross(df: DataFrame, columns: list[str], name: str = "cross", buckets: int | None = None) -> DataFrame:
    """Every combination of one element of each array column, joined by _X_; or its hash bucket."""
    out = df
    for k, column in enumerate(columns):
        out = out.withColumn(f"_c{k}", F.explode(column))
    crossed = F.concat_ws("_X_", *[F.col(f"_c{k}") for k in range(len(columns))])
    return out.withColumn(name, hash_bucket_md5(crossed, buckets) if buckets else crossed).drop(*[f"_c{k}" for k in range(len(columns))])


def as_of(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, value: str, spread: bool = False) -> DataFrame:
    """Each left row with the latest right ``value`` of its key at or before its time; one pass over the union, in the order of time.

    ``spread``: for keys of which one may hold a large share of all rows. A key's ranges of time are then gone through side by side, and each takes what the ranges before it end with.
    """
    rest = [F.col(c) for c in left.columns]
    events = left.select(F.col(key).alias("_k"), F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.struct(*rest).alias("_row"), F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.lit(None).cast("boolean").alias("_has"))
    facts = right.select(F.col(key).alias("_k"), F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(events.schema["_row"].dataType).alias("_row"), F.col(value).alias("_v"), F.lit(True).alias("_has"))
    window = Window.partitionBy("_k").orderBy("_t", "_side", "_v").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("_has"), F.struct(F.col("_v").alias("v"))), ignorenulls=True).over(window)
    every = events.unionByName(facts)
    if spread:
        every = every.withColumn("_range", range_of(every, ["_t"]))
        here = Window.partitionBy("_k", "_range").orderBy("_t", "_side", "_v").rowsBetween(Window.unboundedPreceding, 0)
        known = F.when(F.col("_has"), F.struct(F.col("_v").alias("v")))
        ends = every.groupBy("_k", "_range").agg(F.max_by(known, F.when(F.col("_has"), F.struct("_t", "_side", "_v"))).alias("_end"))
        before = Window.partitionBy("_k").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.select(F.col("_k").alias("_key"), F.col("_range").alias("_r"), F.last("_end", ignorenulls=True).over(before).alias("_carried"))
        met = every.withColumn("_here", F.last(known, ignorenulls=True).over(here)).where(F.col("_side") == 1)
        met = met.join(carried, F.col("_k").eqNullSafe(F.col("_key")) & (F.col("_range") == F.col("_r"))).withColumn("_last", F.coalesce("_here", "_carried"))
        return met.select("_row.*", F.col("_last.v").alias(value))
    met = every.withColumn("_last", last).where(F.col("_side") == 1)
    return met.select("_row.*", F.col("_last.v").alias(value))


def range_join(points: DataFrame, ranges: DataFrame, point: str, start: str, end: str, width: float) -> DataFrame:
    """Rows of ``points`` with the ranges [start, end) that hold them, joined on blocks of ``width``."""
    blocks = ranges.withColumn("_block", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    return points.withColumn("_block", F.floor(F.col(point) / width)).join(blocks, "_block").where((F.col(point) >= F.col(start)) & (F.col(point) < F.col(end))).drop("_block")


def interval_join(left: DataFrame, right: DataFrame, starts: tuple[str, str], ends: tuple[str, str], width: float) -> DataFrame:
    """Pairs of rows whose intervals [start, end) overlap, met on blocks of ``width``; each pair once, on the first block that both have."""
    block = lambda c: F.floor(F.col(c) / width)
    every = lambda a, b: F.explode(F.sequence(block(a), F.greatest(block(a), F.ceil(F.col(b) / width) - 1)))
    a, b = left.withColumn("_block", every(starts[0], ends[0])), right.withColumn("_block", every(starts[1], ends[1]))
    met = a.join(b, "_block").where((F.col(starts[0]) < F.col(ends[1])) & (F.col(starts[1]) < F.col(ends[0])))
    return met.where(F.col("_block") == F.greatest(block(starts[0]), block(starts[1]))).drop("_block")


def theta_join(left: DataFrame, right: DataFrame, condition: Column, how: str = "inner") -> DataFrame:
    """A join on any condition. Equalities in it become a hash or merge join; without one Spark runs a nested loop, for which one side should be small."""
    return left.join(right, condition, how)
