"""Gates, barriers, accumulators and counters over streams, with keyed state; event-time windows with watermarks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


class EgressProcessor(StatefulProcessor):
    """Counts a request's rows and gives the request out once, when all have come; state of abandoned requests expires."""

    def __init__(self, ttl_ms: int | None):
        self.ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "n bigint", self.ttl) if self.ttl else handle.getValueState("count", "n bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, wanted = (self.count.get()[0] if self.count.exists() else 0), None
        for pdf in rows:
            n += len(pdf)
            wanted = int(pdf["request_count"].max())
        if wanted is not None and n >= wanted:
            self.count.clear()
            yield pd.DataFrame({"request_id": [key[0]], "n": [n]})
        else:
            self.count.update((n,))

    def close(self) -> None:
        pass


def egress(stream: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """(request_id, n) of complete requests of a stream with request_id and request_count."""
    mode = "ProcessingTime" if ttl_ms else "None"
    return stream.select("request_id", "request_count").groupBy("request_id").transformWithStateInPandas(EgressProcessor(ttl_ms), "request_id bigint, n bigint", "append", mode)


class CounterProcessor(StatefulProcessor):
    """A counter for each key: adds deltas, and gives out the total before and after each batch of rows."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.total = handle.getValueState("total", "n bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        old = self.total.get()[0] if self.total.exists() else 0
        new = old + sum(int(pdf["delta"].sum()) for pdf in rows)
        self.total.update((new,))
        yield pd.DataFrame({"key": [key[0]], "old": [old], "new": [new]})

    def close(self) -> None:
        pass


def counters(stream: DataFrame) -> DataFrame:
    """(key, old, new) from a stream of (key bigint, delta bigint)."""
    return stream.groupBy("key").transformWithStateInPandas(CounterProcessor(), "key bigint, old bigint, new bigint", "update", "None")


class BarrierProcessor(StatefulProcessor):
    """Gathers the components of a key and gives them out once, when all have come; a component that comes again before that replaces the former one."""

    def __init__(self, names: list[str], ttl_ms: int | None):
        self.names, self.ttl = names, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        args = ("parts", "component string", "value string")
        self.parts = handle.getMapState(*args, self.ttl) if self.ttl else handle.getMapState(*args)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            for name, value in zip(pdf["component"], pdf["value"], strict=True):
                if name in self.names:
                    self.parts.updateValue((name,), (value,))
        if all(self.parts.containsKey((n,)) for n in self.names):
            found = [self.parts.getValue((n,))[0] for n in self.names]
            self.parts.clear()
            yield pd.DataFrame([[key[0], *found]], columns=["key", *self.names])

    def close(self) -> None:
        pass


def barrier(stream: DataFrame, names: list[str], ttl_ms: int | None = None) -> DataFrame:
    """(key, one column for each name) of keys of which every component has come, from a stream of (key bigint, component string, value string). State of keys that stay incomplete expires."""
    schema = ", ".join(["key bigint", *[f"`{n}` string" for n in names]])
    return stream.groupBy("key").transformWithStateInPandas(BarrierProcessor(names, ttl_ms), schema, "append", "ProcessingTime" if ttl_ms else "None")


#: Rows of a frame that a processor gives out.
FRAME = 100_000


def gathered(rows: Iterator[pd.DataFrame], *columns: str) -> list[np.ndarray]:
    """Columns of all of a key's rows of one batch. They come in frames of Arrow's size, and what is to be put in order must be put in order over all of them."""
    parts = [[pdf[c].to_numpy() for c in columns] for pdf in rows]
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


def framed(columns: dict[str, np.ndarray]) -> Iterator[pd.DataFrame]:
    """Frames of at most FRAME rows."""
    for at in range(0, len(columns["key"]), FRAME):
        yield pd.DataFrame({k: v[at : at + FRAME] for k, v in columns.items()})


class AccumulatorProcessor(StatefulProcessor):
    """Averages the values of a key. Values of a step before the key's own are stale and dropped; when enough have come the mean is taken, and the key goes on to the next step, empty."""

    def __init__(self, at_least: int):
        self.at_least = at_least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "step bigint, n bigint, total double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        step, n, total = self.state.get() if self.state.exists() else (0, 0, 0.0)
        ats, values = gathered(rows, "step", "value")
        order = np.lexsort((values, ats))
        ats, values = ats[order], values[order]
        starts = np.flatnonzero(np.concatenate([[True], ats[1:] != ats[:-1]])) if len(ats) else []
        for start, end in zip(starts, [*starts[1:], len(ats)], strict=True):
            if (ahead := int(ats[start]) - step) < 0:
                continue
            mine = values[start : min(end, start + (ahead + 1) * self.at_least - n)]  # what comes after these is stale
            first = min(len(mine), self.at_least - n)
            for value in mine[:first].tolist():
                n, total = n + 1, total + value
            if n < self.at_least:
                continue
            full = (len(mine) - first) // self.at_least
            groups = mine[first : first + full * self.at_least].reshape(full, self.at_least)
            totals = np.zeros(full)
            for k in range(self.at_least):  # one after the other, as rows would be added
                totals += groups[:, k]
            means = np.concatenate([[total / n], totals / self.at_least])
            yield from framed({"key": np.full(len(means), key[0]), "step": step + np.arange(len(means)), "mean": means, "n": np.full(len(means), n)})
            step, n, total = step + len(means), 0, 0.0
            for value in mine[first + full * self.at_least :].tolist():
                n, total = n + 1, total + value
        self.state.update((int(step), n, total))

    def close(self) -> None:
        pass


def accumulator(stream: DataFrame, at_least: int) -> DataFrame:
    """(key, step, mean, n) each time ``at_least`` values have come, from a stream of (key bigint, step bigint, value double). Values of one batch count by step, then by value, however they came."""
    return stream.groupBy("key").transformWithStateInPandas(AccumulatorProcessor(at_least), "key bigint, step bigint, mean double, n bigint", "append", "None")


class WholeProcessor(StatefulProcessor):
    """Holds a request's values until all have come, then gives them out in order as one row."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.values = handle.getListState("values", "ord bigint, value string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        wanted = 0
        for pdf in rows:
            self.values.appendList([(int(o), v) for o, v in zip(pdf["ord"], pdf["value"], strict=True)])
            wanted = int(pdf["request_count"].max())
        held = sorted(self.values.get()) if self.values.exists() else []
        if held and len(held) >= wanted:
            self.values.clear()
            yield pd.DataFrame({"request_id": [key[0]], "items": [[v for _, v in held]], "n": [len(held)]})

    def close(self) -> None:
        pass


def dequeue_whole(stream: DataFrame) -> DataFrame:
    """(request_id, items, n) of complete requests, from a stream of (request_id bigint, request_count bigint, ord bigint, value string)."""
    return stream.groupBy("request_id").transformWithStateInPandas(WholeProcessor(), "request_id bigint, items array<string>, n bigint", "append", "None")


class BatchProcessor(StatefulProcessor):
    """Gives out a key's values ``size`` at a time; what doesn't fill a batch waits."""

    def __init__(self, size: int):
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.values = handle.getListState("values", "ord bigint, value string")
        self.next = handle.getValueState("next", "batch bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = list(self.values.get()) if self.values.exists() else []
        for pdf in rows:
            held += [(int(o), v) for o, v in zip(pdf["ord"], pdf["value"], strict=True)]
        held.sort()
        batch = self.next.get()[0] if self.next.exists() else 0
        out = []
        while len(held) >= self.size:
            out.append((key[0], batch, [v for _, v in held[: self.size]]))
            held, batch = held[self.size :], batch + 1
        self.values.clear()
        if held:
            self.values.put(held)
        self.next.update((batch,))
        yield pd.DataFrame(out, columns=["request_id", "batch", "items"])

    def close(self) -> None:
        pass


def dequeue_many(stream: DataFrame, size: int) -> DataFrame:
    """(request_id, batch, items) from a stream of (request_id bigint, ord bigint, value string): full batches of one request's values."""
    return stream.groupBy("request_id").transformWithStateInPandas(BatchProcessor(size), "request_id bigint, batch bigint, items array<string>", "append", "None")


class RegisterProcessor(StatefulProcessor):
    """A register for each key: a row sets it, or adds to it, and learns what it held before."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "n bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.held.get()[0] if self.held.exists() else 0
        at, action, value = gathered(rows, "ord", "action", "value")
        codes, names = pd.factorize(action, sort=True)
        order = np.lexsort((value, codes, at))
        at, value, sets = at[order], value[order], (names == "set")[codes[order]]
        # the sum so far, less what it was before the last set
        sums = np.cumsum(value)
        last = np.maximum.accumulate(np.where(sets, np.arange(len(at)), -1))
        after = np.where(last < 0, held + sums, sums - np.where(last < 0, 0, (sums - value)[last]))
        old = np.concatenate([[held], after[:-1]]).astype(np.int64)
        self.held.update((int(after[-1]) if len(after) else held,))
        yield from framed({"key": np.full(len(at), key[0]), "ord": at, "old": old[: len(at)]})

    def close(self) -> None:
        pass


def registers(stream: DataFrame) -> DataFrame:
    """(key, ord, old) from a stream of (key bigint, ord bigint, action string, value bigint): what each key's register held before the row's ``set`` or ``add``, rows of a batch in the order of ``ord``."""
    return stream.groupBy("key").transformWithStateInPandas(RegisterProcessor(), "key bigint, ord bigint, old bigint", "append", "None")


@dataclass(frozen=True)
class Runner:
    """How a stage of gates is driven: ``trigger`` of the stream, exceptions by whose class names a source says that it is closed, and what is called once all of it has run."""

    checkpoint: str
    trigger: dict = field(default_factory=lambda: {"availableNow": True})
    closed: tuple[str, ...] = ()
    on_success: Callable[[], None] | None = None

    def run(self, stream: DataFrame, stage: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], timeout_s: int | None = None) -> bool:
        """Each batch goes through ``stage`` into ``sink(rows, batch_id)``; a batch that is run again after a failure has the id it had, so a sink can tell. True when the stream came to its end or closed."""
        query = stream.writeStream.foreachBatch(lambda rows, n: sink(stage(rows), n)).option("checkpointLocation", self.checkpoint).trigger(**self.trigger).start()
        try:
            ended = query.awaitTermination(timeout_s) if timeout_s else query.awaitTermination() is None
        except Exception as e:
            if not any(name in str(e) for name in self.closed):
                raise
            ended = True
        finally:
            query.stop()
        if ended and self.on_success:
            self.on_success()
        return bool(ended)


def credited(reader, most_files: int):
    """A file stream's reader that takes at most so many files a batch: the credits that a gate downstream grants upstream."""
    if most_files < 1:
        raise ValueError("credits are granted one or more at a time")
    return reader.option("maxFilesPerTrigger", most_files)


def tumbling(df: DataFrame, time: str, size: str, keys: list[str], *aggregates, delay: str | None = None) -> DataFrame:
    source = df.withWatermark(time, delay) if delay else df
    out = source.groupBy(F.window(time, size), *keys).agg(*aggregates)
    return out.select(F.col("window.start").alias("window_start"), *[c for c in out.columns if c != "window"])


def sliding(df: DataFrame, time: str, size: str, slide: str, keys: list[str], *aggregates, delay: str | None = None) -> DataFrame:
    source = df.withWatermark(time, delay) if delay else df
    out = source.groupBy(F.window(time, size, slide), *keys).agg(*aggregates)
    return out.select(F.col("window.start").alias("window_start"), *[c for c in out.columns if c != "window"])


def sessions(df: DataFrame, time: str, gap: str, keys: list[str], *aggregates, delay: str | None = None) -> DataFrame:
    source = df.withWatermark(time, delay) if delay else df
    out = source.groupBy(F.session_window(time, gap), *keys).agg(*aggregates)
    return out.select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), *[c for c in out.columns if c != "session_window"])
