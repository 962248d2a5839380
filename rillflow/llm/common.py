"""What the training-data operators share: durable intermediates, Arrow text access and hashing."""

from __future__ import annotations

import ctypes
import gc
import tempfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that the array kernels handle at once; a longer single text is handled alone.
SLICE_BYTES = 1 << 19


def durable(df: DataFrame, large: bool = False) -> DataFrame:
    """The rows of ``df``, kept in the folder that spark.checkpoint.dir names, with the lineage cut.

    Where the setting is absent, a temporary folder is set first on one machine (master ``local``); on a cluster that is an error.
    ``large``: shuffle files that are no longer needed are freed at once.
    A checkpointed plan carries its constraints along, and in a loop they multiply; so none are inferred for it.
    """
    spark = df.sparkSession
    if not checkpoint_dir(spark):
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="rillflow-checkpoint-"))
    key = "spark.sql.constraintPropagation.enabled"
    before = spark.conf.get(key, "true")
    spark.conf.set(key, "false")
    try:
        kept = df.checkpoint(eager=True)
    finally:
        spark.conf.set(key, before)
    if large:
        release(spark)
    return kept


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of what is no longer referred to; else they stay until the driver happens to collect its garbage."""
    spark.range(2).repartition(2).count()  # the scheduler holds on to the last job until there is another
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def checkpoint_dir(spark: SparkSession) -> str | None:
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named:
            return None
        context.setCheckpointDir(named)
    return context._jsc.sc().getCheckpointDir().get()


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just (doc_id, text): column pruning reaches the scan, and further columns, whatever their names, can't clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def slices(batches: Iterable[pa.RecordBatch], limit: int = SLICE_BYTES, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in order, in pieces of about ``limit`` bytes of text, at least one row each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = _ends(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
    give_back()


def tidy(function: Callable[..., pa.Table]) -> Callable[..., pa.Table]:
    """``function`` for groups of Arrow rows, after each of which freed memory goes back to the system: executors hold several Python workers that live on."""

    def done(out: pa.Table) -> pa.Table:
        give_back()
        return out

    if function.__code__.co_argcount == 1:  # Spark counts the arguments
        return lambda table: done(function(table))
    return lambda left, right: done(function(left, right))


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def _ends(column: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    return np.frombuffer(column.buffers()[1], kind)[column.offset :][: len(column) + 1].astype(np.int64)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end, and the n + 1 offsets of the texts in them. A null text is empty."""
    if column.null_count:
        column = column.fill_null("")
    data = column.buffers()[2]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    ends = _ends(column)
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(32))
        x = x * np.uint64(0x9FB21C651E98DF25)
        x = x ^ (x >> np.uint64(29))
        x = x * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def byte_codes(seed: int) -> np.ndarray:
    """256 odd 64-bit codes, drawn from ``seed``."""
    return mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(2 * seed + 1)) | np.uint64(1)


#: Bits of a broadcast filter at most: 16 MB.
MOST_FILTER_BITS = 1 << 27


def filtered(ids: DataFrame) -> Callable[[np.ndarray], np.ndarray]:
    """A function that tells, for an array of 64-bit numbers, which may be in ``ids`` (id): a Bloom filter built on the executors and broadcast, in packed bits.

    The filter has 16 bits a number until it is as large as it may get; from then on more and more pass that aren't in ``ids``: 3 % with 17 million numbers, 15 % with 34, 63 % with 134. With
    more numbers than bits it would tell hardly anything and everything passes. What it feeds must be joined with ``ids`` in any case.
    """
    count = ids.count()
    bits = min(MOST_FILTER_BITS, 1 << max(10, (16 * count).bit_length()))
    if count > bits:
        return lambda x: np.ones(len(x), bool)
    shifts = (0, 20, 37) if 3 * count <= bits else (0,)

    def places(x: np.ndarray) -> list[np.ndarray]:
        h = mixed(x.astype(np.int64).view(np.uint64) + np.uint64(99))
        return [((h >> np.uint64(shift)) & np.uint64(bits - 1)).astype(np.int64) for shift in shifts]

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            for at in places(batch.column(0).to_numpy()):
                np.bitwise_or.at(table, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([table.tobytes()], pa.binary())], names=["bits"])

    table = np.zeros(bits // 8, np.uint8)
    for part in ids.select("id").coalesce(min(16, 1 + count // 100_000)).mapInArrow(build, "bits binary").toLocalIterator():
        table |= np.frombuffer(part[0], np.uint8)
    shared = ids.sparkSession.sparkContext.broadcast(table)

    def keep(x: np.ndarray) -> np.ndarray:
        table, mask = shared.value, np.ones(len(x), bool)
        for at in places(x):
            mask &= (table[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return mask

    return keep


def free_names(names: list[str], taken: list[str]) -> list[str]:
    """The names, with underscores before those that are taken (in whatever case)."""
    used = {t.lower() for t in taken}
    out = []
    for name in names:
        while name.lower() in used:
            name = "_" + name
        used.add(name.lower())
        out.append(name)
    return out


def thinned(df: DataFrame, key: str, rows: int, wanted: int) -> DataFrame:
    """About ``wanted`` to 1.3 times as many of ``rows`` rows, chosen by a hash of ``key``: a filter, so nothing meets in one task. All, if they are fewer."""
    share = min(1.0, (1.3 * wanted + 50) / max(1, rows))
    return df.where(F.pmod(F.xxhash64(key), F.lit(1 << 40)) < int(share * (1 << 40)))
