"""Sources and sinks that Spark's own readers and writers express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillflow.functions import random
from rillflow.functions.random import TOP, draw


def _blocks(spark: SparkSession, *paths: str) -> tuple[DataFrame, DataFrame]:
    """Lines with their file, block and place in it; and for each block the lines of the file before it. A block is what one task reads, so a large file is read and numbered by many."""
    lines = spark.read.text([*paths]).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("_id"))
    sizes = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return lines, sizes.select(F.col("file").alias("_f"), F.col("block").alias("_b"), "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))


def numbered_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """(file, line, value): the lines of text files with their numbers from 0. A block's lines have ids that follow each other, so no file passes a single task."""
    lines, sizes = _blocks(spark, *paths)
    met = lines.join(sizes, (F.col("file") == F.col("_f")) & (F.col("block") == F.col("_b")))
    return met.select("file", (F.col("_id") - F.col("_first") + F.col("_before")).alias("line"), "value")


def text_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """(key, value): the lines of text files, the key ``file:line`` with lines from 1."""
    return numbered_lines(spark, *paths).select(F.concat_ws(":", "file", F.col("line") + 1).alias("key"), "value")


def whole_files(spark: SparkSession, *paths: str) -> DataFrame:
    """(key, value): path and contents."""
    return spark.read.format("binaryFile").load([*paths]).select(F.col("path").alias("key"), F.col("content").alias("value"))


def matching_files(spark: SparkSession, pattern: str) -> DataFrame:
    """(path), sorted; the files are listed, not opened."""
    return spark.read.format("binaryFile").load(pattern).select("path").orderBy("path")


def csv(spark: SparkSession, path: str, schema: str, defaults: dict[str, Column], **options: str) -> DataFrame:
    """Typed CSV: an empty field gets its default, and one without a default is an error."""
    rows = spark.read.schema(schema).options(**options).csv(path)
    out = {}
    for name in rows.columns:
        required = F.when(F.col(name).isNull(), F.raise_error(F.lit(f"field {name} is required"))).otherwise(F.col(name))
        out[name] = F.coalesce(name, defaults[name]) if name in defaults else required
    return rows.withColumns(out)


def random_rows(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """(value): pseudo-random whole numbers below 2**32 that the seed alone decides."""
    return spark.range(n).select(draw(seed, "id").alias("value"))


def from_values(spark: SparkSession, schema: str, *values) -> DataFrame:
    """One row of the given components."""
    return spark.createDataFrame([tuple(values)], schema)


def from_slices(spark: SparkSession, **columns: list) -> DataFrame:
    """A row for each element of equally long lists, with its place ``pos``."""
    sizes = {len(c) for c in columns.values()}
    if len(sizes) > 1:
        raise ValueError("the components differ in length")
    import pyarrow as pa

    return spark.createDataFrame(pa.table({"pos": list(range(sizes.pop() if sizes else 0)), **columns}))


def array_slices(df: DataFrame, *columns: str) -> DataFrame:
    """A row for each place of equally long array columns, under their names, with ``pos``."""
    rest = [c for c in df.columns if c not in columns]
    same = F.lit(True)
    for c in columns[1:]:
        same = same & (F.size(c) == F.size(columns[0]))
    zipped = F.when(same, F.arrays_zip(*columns)).otherwise(F.raise_error(F.lit("the components differ in length")))
    return df.select(*rest, F.posexplode(zipped).alias("pos", "_z")).select(*rest, "pos", *[F.col(f"_z.{c}").alias(c) for c in columns])


def from_generator(spark: SparkSession, generator, schema: str, shards: int = 1, args: tuple = ()) -> DataFrame:
    """(schema..., shard, pos): what a generator function gives out. With several ``shards`` it is called as generator(shard, shards, *args) in a task each, else as generator(*args). Rows go out in batches."""
    from pyspark.sql.types import _parse_datatype_string

    kind = _parse_datatype_string(schema)
    full = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kind.fields], "shard int", "pos long"])

    def run(batches):
        import itertools

        import pandas as pd

        for batch in batches:
            for shard in batch["id"].tolist():
                rows = generator(shard, shards, *args) if shards > 1 else generator(*args)
                at = 0
                while part := list(itertools.islice(rows, 4096) if hasattr(rows, "__next__") else itertools.islice(rows := iter(rows), 4096)):
                    made = pd.DataFrame([r if isinstance(r, tuple) else (r,) for r in part], columns=[f.name for f in kind.fields])
                    yield made.assign(shard=shard, pos=range(at, at + len(made)))
                    at += len(part)

    return spark.range(0, shards, 1, shards).mapInPandas(run, full)


def from_pandas(spark: SparkSession, frame, epochs: int = 1) -> DataFrame:
    """The rows of a pandas frame or of a mapping of numpy arrays, with their place ``pos`` and ``epoch``."""
    import pandas as pd

    data = pd.DataFrame(frame if isinstance(frame, pd.DataFrame) else {k: list(v) for k, v in frame.items()}).reset_index(drop=True)
    return spark.createDataFrame(data.assign(pos=range(len(data)))).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))


def work_items(spark: SparkSession, items: list[str], epochs: int = 1) -> DataFrame:
    """(key, value, epoch): each item of a work queue as its own key and value, in turn."""
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(items)], "pos long, value string")
    return rows.select(F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"), "pos", F.col("value").alias("key"), "value")


class Reader:
    """A cursor over rows in order, for programs that pull: batches of up to n, counters, a state to resume from. Rows are numbered once; each pull reads its range only."""

    def __init__(self, rows: DataFrame, order: list[str], work: str | None = None, position: int = 0):
        from rillflow.operators.ordering import numbered

        self.rows, self.work, self.position = numbered(rows, order, "pos").persist(), work, position

    def read_up_to(self, n: int) -> DataFrame:
        """The next n rows, fewer at the end."""
        out = self.rows.where((F.col("pos") >= self.position) & (F.col("pos") < self.position + n))
        self.position += out.count()
        return out

    def read(self) -> DataFrame:
        """The next row; an error at the end."""
        from rillflow.operators.transform import single_element

        return single_element(self.read_up_to(1))

    def next_or_none(self) -> DataFrame | None:
        """The next row, or None at the end: what a program asks that doesn't want an error there."""
        one = self.read_up_to(1)
        return None if one.isEmpty() else one

    def reset(self) -> None:
        self.position = 0

    def serialize(self) -> bytes:
        return self.position.to_bytes(8, "little")

    def restore(self, state: bytes) -> None:
        if len(state) != 8:
            raise ValueError("not a reader's state")
        self.position = int.from_bytes(state, "little")

    def save(self, path: str) -> None:
        """Writes the state to a file, in any file system that Spark knows: what a training program keeps beside its own checkpoint."""
        write_file(self.rows.sparkSession, path, self.serialize())

    def load(self, path: str) -> None:
        """Goes on from a saved state."""
        rows = self.rows.sparkSession.read.format("binaryFile").load(path).select("content").collect()
        self.restore(bytes(rows[0].content))

    def num_records_produced(self) -> int:
        return self.position

    def num_work_units_completed(self) -> int:
        """Work units (files) all of whose rows have been read."""
        if not self.work:
            return 0
        return self.rows.groupBy(self.work).agg(F.max("pos").alias("last")).where(F.col("last") < self.position).count()


def record_input(records: DataFrame, order: list[str], batch_size: int, seed: int, epochs: int = 1) -> DataFrame:
    """(epoch, batch, items, n): every record once an epoch, in an order of each epoch's own, in batches within the epoch."""
    from rillflow.operators.sort import shuffle_and_repeat
    from rillflow.operators.window import batch

    placed = shuffle_and_repeat(records, epochs, seed, order)
    return batch(placed, batch_size, ["at"], F.struct(*records.columns), partition=["epoch"])


def obtain_next(items: list[str], counter: Column) -> Column:
    """The element that a running counter points at, round and round."""
    return F.element_at(F.array(*map(F.lit, items)), (F.pmod(counter, F.lit(len(items))) + 1).cast("int"))


def counter(spark: SparkSession, n: int, start: int = 0, step: int = 1) -> DataFrame:
    return spark.range(n).select((F.lit(start) + F.col("id") * step).alias("value"))


def number_range(spark: SparkSession, start: int, stop: int, step: int = 1) -> DataFrame:
    if not step:
        raise ValueError("step must not be 0")
    return spark.range(start, stop, step).select(F.col("id").alias("value"))


def at_index(df: DataFrame, index: str, wanted: int) -> DataFrame:
    """The row at an index; an error if there is none."""
    found = df.where(F.col(index) == wanted).agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in df.columns])
    return found.where(F.assert_true(F.col("_n") > 0, F.lit("index out of range")).isNull()).drop("_n")


def key_range(table: DataFrame, key: str, start: str | None = None, end: str | None = None, prefix: str | None = None, probability: float | None = None) -> DataFrame:
    """Rows of a keyed table in [start, end) or with a prefix; a sample of them by hash, on request."""
    out = table
    if start is not None:
        out = out.where(F.col(key) >= start)
    if end is not None:
        out = out.where(F.col(key) < end)
    if prefix is not None:
        out = out.where(F.col(key).startswith(prefix))
    return out if probability is None else out.where(draw(0, key) < int(probability * TOP))


def sample_keys(table: DataFrame, key: str, parts: int) -> DataFrame:
    """(start, end): about ``parts`` ranges of keys that cover the table, for parallel scans; a bounded number of rows."""
    bounds = table.select(key).orderBy(F.xxhash64(key), key).limit(parts - 1).select(F.col(key).alias("start")).distinct()
    every = bounds.union(table.sparkSession.range(1).select(F.lit("").alias("start")))
    return every.select("start", F.lead("start").over(Window.partitionBy(F.lit(0)).orderBy("start")).alias("end"))


def log_events(df: DataFrame, path: str) -> None:
    """Appends rows as CSV with a header."""
    df.write.mode("append").option("header", "true").csv(path)


def discard(df: DataFrame) -> None:
    """Runs a plan and keeps nothing."""
    df.write.format("noop").mode("overwrite").save()


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The table with ``rows`` put in, in place of those with their keys."""
    return table.join(rows.select(key), key, "left_anti").unionByName(rows)


def remove(spark: SparkSession, *paths: str) -> int:
    """Deletes paths of any file system that Spark knows; the number of paths."""
    for p in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return len(paths)


def sequence_file(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) strings of sequence files, split as Hadoop splits them. The keys and values come as Python's strings, for want of a reader in Spark SQL."""
    return spark.createDataFrame(spark.sparkContext.sequenceFile(path).map(lambda kv: (str(kv[0]), str(kv[1]))), "key string, value string")


def write_sequence_file(df: DataFrame, key: str, value: str, path: str) -> None:
    df.select(F.col(key).cast("string"), F.col(value).cast("string")).rdd.map(tuple).saveAsSequenceFile(path)


def log_uniform(spark: SparkSession, n: int, classes: int, seed: int) -> DataFrame:
    """(candidate): n draws from [0, classes), small ones likelier: the chance of k is log((k + 2) / (k + 1)) / log(classes + 1)."""
    return spark.range(n).select(random.log_uniform(classes, seed, "id").alias("candidate"))


def uniform_candidates(spark: SparkSession, n: int, classes: int, seed: int) -> DataFrame:
    """(candidate): n draws from [0, classes), all alike."""
    return spark.range(n).select(random.uniform_int(0, classes, seed, "id").alias("candidate"))


def unigram_candidates(spark: SparkSession, n: int, counts: DataFrame, value: str, count: str, seed: int, distortion: float = 1.0) -> DataFrame:
    """(draw, candidate): n draws of the values of ``counts``, with chances in proportion to count ** distortion. The draws meet the values' shares of the unit interval on blocks, as a range join."""
    from rillflow.operators.join import range_join
    from rillflow.operators.ordering import running

    weighed = running(counts.select(value, F.pow(F.col(count).cast("double"), F.lit(distortion)).alias("_w")), "_w", [value], "_up")
    total = weighed.agg(F.sum("_w").alias("_all"))
    shares = weighed.crossJoin(F.broadcast(total)).select(F.col(value).alias("candidate"), ((F.col("_up") - F.col("_w")) / F.col("_all")).alias("_low"), (F.col("_up") / F.col("_all")).alias("_high"))
    draws = spark.range(n).select(F.col("id").alias("draw"), random.unit(seed, "id").alias("_u"))
    return range_join(draws, shares, "_u", "_low", "_high", 1 / 1024).select("draw", "candidate")


def learned_candidates(spark: SparkSession, n: int, rows: DataFrame, value: str, seed: int) -> DataFrame:
    """(draw, candidate): as ``unigram_candidates``, the counts learned from ``rows``."""
    return unigram_candidates(spark, n, rows.groupBy(value).agg(F.count(F.lit(1)).alias("n")), value, "n", seed)


def save(frames: dict[str, DataFrame], folder: str) -> None:
    """Each frame by its name, as Parquet; a frame that is there is replaced."""
    for name, frame in frames.items():
        frame.write.mode("overwrite").parquet(f"{folder}/{name}")


def restore(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}") for name in names}


def merge_saved(spark: SparkSession, folders: list[str], names: list[str], target: str) -> None:
    """The rows of several saved folders' frames together in one."""
    for name in names:
        spark.read.parquet(*[f"{f}/{name}" for f in folders]).write.mode("overwrite").parquet(f"{target}/{name}")


def write_file(spark: SparkSession, path: str, contents: bytes) -> None:
    """One file with the given bytes, in any file system that Spark knows."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(place, True)
    try:
        out.write(bytearray(contents))
    finally:
        out.close()


def summary_scalars(df: DataFrame, step: Column, path: str, **values: Column) -> None:
    """Appends a row (step, tag, value) for each named aggregate of ``df``."""
    found = df.agg(*[v.cast("double").alias(k) for k, v in values.items()])
    long = found.select(step.cast("long").alias("step"), F.explode(F.array(*[F.struct(F.lit(k).alias("tag"), F.col(k).alias("value")) for k in values])).alias("s")).select("step", "s.*")
    long.write.mode("append").parquet(path)


def summary_histogram(df: DataFrame, value: str, step: int, tag: str, path: str) -> None:
    """Appends the histogram of a column as rows (step, tag, bucket, n)."""
    from rillflow.operators.aggregate import log_histogram

    log_histogram(df, value).select(F.lit(step).cast("long").alias("step"), F.lit(tag).alias("tag"), "bucket", "n").write.mode("append").parquet(path)


def sharded_filespec(base: Column, shards: Column) -> Column:
    """The pattern that stands for all shards of a name."""
    return F.format_string("%s-?????-of-%05d", base, shards)
