"""Row transforms of an ordered flow: enumerate, zip, concatenate, repeat, shard, interleave, flat map, unbatch."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.operators.ordering import numbered


def enumerate_rows(df: DataFrame, order: list[str], start: int = 0, name: str = "index") -> DataFrame:
    return numbered(df, order, name, start)


def zip_rows(frames: list[DataFrame], orders: list[list[str]]) -> DataFrame:
    """Rows of equal position side by side, as many as the shortest frame has. Column names must differ."""
    out = None
    for frame, order in zip(frames, orders, strict=True):
        part = numbered(frame, order, "pos")
        out = part if out is None else out.join(part, "pos")
    return out


def concatenate(*frames: DataFrame) -> DataFrame:
    """All of the first, then all of the second, and so on: column ``part`` holds a frame's number and leads the order."""
    out = None
    for k, frame in enumerate(frames):
        part = frame.withColumn("part", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out


def repeat(df: DataFrame, count: int) -> DataFrame:
    """``count`` epochs of all rows; column ``epoch`` leads the order. 1 changes nothing but for the column."""
    if count < 0:
        raise ValueError("an endless repetition needs a stream")
    return df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(count - 1)) if count else F.array().cast("array<int>")))


def shard(df: DataFrame, shards: int, index: int, order: list[str]) -> DataFrame:
    if not 0 <= index < shards:
        raise ValueError("index must be in [0, shards)")
    return numbered(df, order, "pos").where(F.col("pos") % shards == index)


def take(df: DataFrame, count: int, order: list[str]) -> DataFrame:
    """The first ``count`` rows; -1: all."""
    return df if count < 0 else df.orderBy(*order).limit(count)


def skip(df: DataFrame, count: int, order: list[str]) -> DataFrame:
    """All but the first ``count`` rows; -1: none."""
    return df.limit(0) if count < 0 else numbered(df, order, "_pos").where(F.col("_pos") >= count).drop("_pos")


def interleave(frames: list[DataFrame], orders: list[list[str]], block_length: int = 1, cycle_length: int | None = None) -> DataFrame:
    """Blocks of ``block_length`` rows from each frame in turn; ``round``, ``slot`` and ``inner`` are the order.

    ``cycle_length`` frames are open at a time (all, if None). When one is used up, the next frame takes its slot at the next turn of that slot: a slot's frames follow each other, each from
    the round after the last one's. Which frames a slot gets depends on their lengths alone, so the rows needn't be walked: lengths are counted, one row a frame.
    """
    width = len(frames) if cycle_length is None else min(cycle_length, len(frames))
    if width < 1 or block_length < 1:
        raise ValueError("cycle_length and block_length are 1 or more")
    if width == len(frames):
        starts = [(slot, 0) for slot in range(width)]
    else:
        counted = None
        for k, frame in enumerate(frames):
            one = frame.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("k"), "n")
            counted = one if counted is None else counted.union(one)
        rounds = {r.k: -(-r.n // block_length) for r in counted.collect()}
        free, starts = [(0, slot) for slot in range(width)], []
        for k in range(len(frames)):  # the slot that comes free first takes the next frame
            begin, slot = min(free)
            starts.append((slot, begin))
            free[free.index((begin, slot))] = (begin + rounds[k], slot)
    out = None
    for (slot, begin), frame, order in zip(starts, frames, orders, strict=True):
        part = numbered(frame, order, "_pos").withColumns({"round": F.floor(F.col("_pos") / block_length) + begin, "slot": F.lit(slot), "inner": F.col("_pos") % block_length}).drop("_pos")
        out = part if out is None else out.unionByName(part)
    return out


def sloppy_interleave(frames: list[DataFrame]) -> DataFrame:
    """The rows of all frames as they come, with no promise of order and none of its cost."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def filter_by_last(df: DataFrame) -> DataFrame:
    """Keeps the rows whose last column, a boolean, is true, and drops that column."""
    last = df.columns[-1]
    return df.where(F.col(last)).drop(last)


def flat_map(df: DataFrame, items: Column, name: str = "item") -> DataFrame:
    """Each row once for every element of an array, with the element's position."""
    return df.select("*", F.posexplode(items).alias("item_pos", name))


def unbatch(df: DataFrame, column: str) -> DataFrame:
    """The elements of array column ``column``, one a row, under its name, with their position."""
    return df.select(*[c for c in df.columns if c != column], F.posexplode(column).alias("item_pos", column))


def ignore_errors(df: DataFrame, **tried: Column) -> DataFrame:
    """Adds expressions that give null where they fail (try_ functions), and drops the rows in which one of them does."""
    return df.withColumns(tried).dropna(subset=[*tried])


#: Rows that a function is tried on together once it has failed: so many that this share of such groups' rows fails, about. Partitions for each core.
GROUP_SHARE, DEALS = 0.7, 4


def map_ignoring_errors(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """An opaque function of pandas frames, without the rows on which it fails. A batch on which it does is gone through in groups, the smaller the more rows have failed so far, and a group on which it fails in halves;
    only a row on which it fails alone is left out. As that takes up to a call a row, rows are dealt to all cores, however few files they come from."""

    def run(batches):
        seen = bad = 0

        def tried(part):
            try:
                return function(part)
            except Exception:
                return None

        def halves(part):
            """What comes of a group on which the function failed."""
            nonlocal bad
            if len(part) == 1:
                bad += 1
                return
            middle = len(part) // 2
            one, two = part.iloc[:middle], part.iloc[middle:]
            made = tried(one)
            if made is None:
                yield from halves(one)
            else:
                yield made
            # if the first half is sound, the second isn't: it need not be tried as a whole
            again = tried(two) if made is None or len(two) == 1 else None
            if again is None:
                yield from halves(two)
            else:
                yield again

        for pdf in batches:
            whole = tried(pdf)
            if whole is not None:
                seen += len(pdf)
                yield whole
                continue
            found, at = [], 0
            while at < len(pdf):
                group = pdf.iloc[at : at + max(1, int(GROUP_SHARE * (seen + 1) / (bad + 1)))]
                made = tried(group)
                found += halves(group) if made is None else [made]
                at, seen = at + len(group), seen + len(group)
            if found:
                yield pd.concat(found)

    return df.repartition(DEALS * df.sparkSession.sparkContext.defaultParallelism).mapInPandas(run, schema)


def map_batches(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """An opaque function over iterators of Arrow batches."""
    return df.mapInArrow(function, schema)


def single_element(df: DataFrame) -> DataFrame:
    """The only row; an error unless there is exactly one."""
    one = df.groupBy().agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in df.columns])
    return one.where(F.assert_true(F.col("_n") == 1, F.lit("expected exactly one element")).isNull()).drop("_n")


def rate(df: DataFrame, value: str, denominator: str, order: list[str], partition: list[str], name: str = "rate") -> DataFrame:
    """The change of ``value`` over that of ``denominator`` since the row before, both 0 before the first; 0 where the denominator stays."""
    from pyspark.sql import Window

    window = Window.partitionBy(*partition).orderBy(*order)
    change = lambda c: F.col(c) - F.lag(c, 1, 0).over(window)
    return df.withColumn(name, F.coalesce(F.try_divide(change(value), change(denominator)), F.lit(0.0)))


def explained(df: DataFrame) -> str:
    """The formatted physical plan, for plan assertions."""
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def assert_plan(df: DataFrame, *present: str, absent: tuple[str, ...] = ()) -> DataFrame:
    """``df`` itself, if its plan names all of ``present`` and none of ``absent``."""
    plan = explained(df)
    if missing := [x for x in present if x not in plan]:
        raise AssertionError(f"not in the plan: {missing}")
    if found := [x for x in absent if x in plan]:
        raise AssertionError(f"in the plan: {found}")
    return df


def map_and_batch(df: DataFrame, value: Column, size: int, order: list[str], drop_remainder: bool = False) -> DataFrame:
    """(batch, items, n): a map and a batch in one plan; the map runs before the rows are gathered, in the stage that reads them."""
    from rillflow.operators.window import batch

    return batch(df.select(*order, value.alias("_mapped")), size, order, "_mapped", drop_remainder)


def cached(df: DataFrame, path: str | None = None, overwrite: bool = False) -> DataFrame:
    """``df`` computed once: kept by Spark (memory, then disk), or written to ``path`` as Parquet. What stands at ``path`` already is read, unless it is to be overwritten."""
    if path is None:
        return df.persist()
    spark = df.sparkSession
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if overwrite or not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def identity(df: DataFrame) -> DataFrame:
    """``df`` itself: what passes values through, copies them or stops gradients changes no row."""
    return df


def apply_python(df: DataFrame, function: Callable, returns: str, *columns: str, name: str = "value") -> DataFrame:
    """``df`` with ``name``: a Python function of pandas series, a batch at a time."""
    return df.withColumn(name, F.pandas_udf(function, returns)(*columns))


def register_function(spark: SparkSession, name: str, function: Callable, returns: str) -> None:
    """Makes a function of pandas series known to SQL by a name."""
    spark.udf.register(name, F.pandas_udf(function, returns))


def map_elements(items: Column, function: Callable[[Column], Column]) -> Column:
    """A function over the elements of an array, as an expression."""
    return F.transform(items, function)


def while_loop(df: DataFrame, condition: Column, step: Callable[[DataFrame], DataFrame], limit: int) -> DataFrame:
    """Applies ``step`` to the rows for which ``condition`` holds, as long as there are any; ``limit`` rounds at most, more are an error. Each round is one plan, cut by a checkpoint where a folder is set."""
    from rillflow.session import cut

    done, open_ = None, df
    for _ in range(limit):
        open_ = cut(open_)
        finished = open_.where(~F.coalesce(condition, F.lit(False)))
        done = finished if done is None else done.unionByName(finished)
        open_ = open_.where(condition)
        if open_.isEmpty():
            return done
        open_ = step(open_)
    raise RuntimeError(f"the loop didn't end in {limit} rounds")


def if_else(df: DataFrame, condition: Column, then: Callable[[DataFrame], DataFrame], otherwise: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``then`` of the rows for which the condition holds, ``otherwise`` of the others."""
    holds = F.coalesce(condition, F.lit(False))
    return then(df.where(holds)).unionByName(otherwise(df.where(~holds)))


def for_loop(df: DataFrame, start: int, stop: int, step: int, body: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    for k in range(start, stop, step):
        df = body(df, k)
    return df


def call_remote(df: DataFrame, client: Callable[[list[bytes]], list[bytes]], request: str, name: str = "response", errors: bool = False) -> DataFrame:
    """``df`` with what a service answers to each request (bytes), a batch of requests a call. ``errors``: instead of failing, a call's message stands in ``status``."""
    from pyspark.sql import types as T

    added = [T.StructField(name, T.BinaryType()), *([T.StructField("status", T.StringType())] if errors else [])]
    schema = T.StructType([*df.schema.fields, *added])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            asked, status = batch.column(request).to_pylist(), None
            try:
                answers = client(asked)
                if len(answers) != len(asked):
                    raise ValueError("the service gave another number of answers")
            except Exception as e:
                if not errors:
                    raise
                answers, status = [None] * len(asked), str(e)
            columns = [*batch.columns, pa.array(answers, pa.binary())]
            if errors:
                columns.append(pa.array([status] * len(asked), pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return df.mapInArrow(run, schema)
