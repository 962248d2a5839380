import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rillflow.streaming import stateful


@pytest.fixture
def run(spark, tmp_path):
    """Runs a stream over rows written as files, all that are there, and gives its rows."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def go(parts, build, mode="append", name="found"):
        for k, part in enumerate(parts):
            part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = build(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.sql(f"select * from {name}").collect()

    yield go
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_requests_come_out_when_complete(spark, run):
    rows = [(1, 2), (2, 3), (2, 3), (3, 2)], [(1, 2), (2, 3)]
    parts = [spark.createDataFrame(r, "request_id long, request_count long") for r in rows]
    assert sorted((r.request_id, r.n) for r in run(parts, stateful.egress)) == [(1, 2), (2, 3)]


def test_counters_give_old_and_new(spark, run):
    parts = [spark.createDataFrame(r, "key long, delta long") for r in ([(1, 5), (1, 2), (2, 1)], [(1, 3)])]
    found = run(parts, stateful.counters, "update")
    last = {k: max(r.new for r in found if r.key == k) for k in (1, 2)}
    assert last == {1: 10, 2: 1} and all(r.new >= r.old for r in found)


def test_windows_close_behind_the_watermark(spark, run):
    times = ["2024-01-01 00:00:10", "2024-01-01 00:30:00", "2024-01-01 05:00:00"]
    parts = [spark.createDataFrame([(t, 1)], "t string, v int").select(F.to_timestamp("t").alias("ts"), "v") for t in times]
    found = run(parts, lambda s: stateful.tumbling(s, "ts", "1 hour", [], F.count(F.lit(1)).alias("n"), delay="10 minutes"))
    assert [r.n for r in found] in ([2], [2, 1])


def test_batch_windows(spark):
    rows = spark.createDataFrame([("2024-01-01 00:00:10",), ("2024-01-01 00:20:00",), ("2024-01-01 02:00:00",)], "t string").select(F.to_timestamp("t").alias("ts"))
    assert sorted(r.n for r in stateful.sessions(rows, "ts", "30 minutes", [], F.count(F.lit(1)).alias("n")).collect()) == [1, 2]
    assert sum(r.n for r in stateful.sliding(rows, "ts", "1 hour", "30 minutes", [], F.count(F.lit(1)).alias("n")).collect()) == 6


def test_barriers_of_three(spark, run):
    rows = [(1, "a", "x"), (2, "a", "y"), (1, "b", "z")], [(1, "c", "w"), (2, "b", "v"), (1, "other", "-")]
    parts = [spark.createDataFrame(r, "key long, component string, value string") for r in rows]
    found = run(parts, lambda s: stateful.barrier(s, ["a", "b", "c"]))
    assert [(r.key, r.a, r.b, r.c) for r in found] == [(1, "x", "z", "w")]


def test_accumulators_drop_stale_values(spark, run):
    rows = [(1, 0, 2.0), (1, 0, 4.0), (2, 0, 1.0)], [(1, 0, 100.0), (1, 1, 7.0)], [(1, 1, 9.0), (2, 0, 3.0)]
    parts = [spark.createDataFrame(r, "key long, step long, value double") for r in rows]
    found = run(parts, lambda s: stateful.accumulator(s, 2))
    assert sorted(map(tuple, found)) == [(1, 0, 3.0, 2), (1, 1, 8.0, 2), (2, 0, 2.0, 2)]


def test_whole_requests_and_batches_of_a_stream(spark, run, tmp_path):
    rows = [(1, 3, 1, "b"), (2, 1, 0, "z")], [(1, 3, 0, "a")], [(1, 3, 2, "c")]
    parts = [spark.createDataFrame(r, "request_id long, request_count long, ord long, value string") for r in rows]
    found = run(parts, stateful.dequeue_whole, name="whole")
    assert sorted((r.request_id, list(r["items"]), r.n) for r in found) == [(1, ["a", "b", "c"], 3), (2, ["z"], 1)]


def test_full_batches_of_a_stream(spark, run):
    parts = [spark.createDataFrame(r, "request_id long, ord long, value string") for r in ([(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (2, 0, "x")], [(1, 3, "d"), (1, 4, "e")])]
    found = run(parts, lambda s: stateful.dequeue_many(s, 2))
    assert sorted((r.request_id, r.batch, list(r["items"])) for r in found) == [(1, 0, ["a", "b"]), (1, 1, ["c", "d"])]


def test_registers_give_what_they_held(spark, run):
    parts = [spark.createDataFrame(r, "key long, ord long, action string, value long") for r in ([(1, 0, "add", 5), (1, 1, "set", 9)], [(1, 2, "add", 1), (1, 3, "add", 1)])]
    found = run(parts, stateful.registers)
    assert sorted((r.ord, r.old) for r in found) == [(0, 0), (1, 5), (2, 9), (3, 10)]


def test_runner_drives_a_stage(spark, tmp_path):
    spark.range(6).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = stateful.credited(spark.readStream.schema("id long"), 1).parquet(str(tmp_path / "in"))
    seen, ended = [], []
    runner = stateful.Runner(str(tmp_path / "cp"), closed=("GateClosed",), on_success=lambda: ended.append(1))
    assert runner.run(stream, lambda rows: rows.where("id > 2"), lambda rows, n: seen.extend(r.id for r in rows.collect()), 120)
    assert sorted(seen) == [3, 4, 5] and ended == [1]

    def shut(rows, n):
        raise ValueError("GateClosed")

    again = stateful.Runner(str(tmp_path / "cp2"), closed=("GateClosed",))
    assert again.run(stream, lambda rows: rows, shut, 120)
    with pytest.raises(Exception, match="GateClosed"):
        stateful.Runner(str(tmp_path / "cp3")).run(stream, lambda rows: rows, shut, 120)
    with pytest.raises(ValueError):
        stateful.credited(spark.readStream, 0)


def test_a_key_of_many_frames_is_put_in_order(spark, run):
    """Rows of a key come in frames of Arrow's size, each of which was put in order by itself."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        rows = spark.range(0, 95, 1, 1).select(F.lit(1).cast("long").alias("key"), F.lit(1 << 40).alias("step"), (F.col("id") * 37 % 95).cast("double").alias("value"))
        found = run([rows], lambda s: stateful.accumulator(s, 10))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(map(tuple, found)) == [(1, k, 10 * k + 4.5, 10) for k in range(9)]


class Held:
    """A value as a processor's handle keeps it."""

    def __init__(self, *value):
        self.value = value

    def exists(self):
        return bool(self.value)

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def test_processors_are_as_row_by_row(monkeypatch):
    """Against plain loops, over several batches of several frames."""
    rng = np.random.default_rng(3)
    monkeypatch.setattr(stateful, "FRAME", 7)
    one, two = stateful.AccumulatorProcessor(4), stateful.RegisterProcessor()
    one.state, two.held = Held(), Held()
    step = n = held = 0
    total = 0.0
    for _ in range(30):
        size = int(rng.integers(1, 60))
        frame = pd.DataFrame({"step": rng.integers(max(0, step - 2), step + 5, size), "value": rng.integers(0, 9, size) / 8, "ord": rng.integers(0, 20, size), "action": rng.choice(["add", "set", "more"], size)})
        parts = [frame.iloc[k : k + 11] for k in range(0, size, 11)]
        want = []
        for at, value in sorted(zip(frame["step"].tolist(), frame["value"].tolist(), strict=True)):
            if at >= step:
                n, total = n + 1, total + value
                if n >= 4:
                    want.append((1, step, total / n, n))
                    step, n, total = step + 1, 0, 0.0
        got = [*one.handleInputRows((1,), iter(parts), None)]
        assert [tuple(r) for f in got for r in f.itertuples(index=False)] == want and one.state.get() == (step, n, total) and max(map(len, got), default=0) <= 7
        want = []
        for at, action, value in sorted(zip(frame["ord"].tolist(), frame["action"].tolist(), (frame["value"] * 8).astype(int).tolist(), strict=True)):
            want.append((1, at, held))
            held = value if action == "set" else held + value
        got = [*two.handleInputRows((1,), iter([p.assign(value=(p["value"] * 8).astype("int64")) for p in parts]), None)]
        assert [tuple(r) for f in got for r in f.itertuples(index=False)] == want and two.held.get() == (held,)
