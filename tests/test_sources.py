import gzip
import sqlite3
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from rillflow.sources import btree, datasources, files


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    datasources.register(spark)


@pytest.mark.parametrize("compression", ["none", "ZLIB", "GZIP"])
def test_records_round_trip(spark, tmp_path, compression):
    rows = spark.range(7).select(F.concat(F.lit("Record "), "id").cast("binary").alias("record"), F.lit("").alias("file"), F.lit(0).cast("long").alias("offset"))
    path = str(tmp_path / "out")
    rows.write.format("record_file").mode("append").option("path", path).option("compression", compression).save()
    found = spark.read.format("record_file").option("path", path).option("compression", compression).load()
    assert sorted(bytes(r.record) for r in found.collect()) == [b"Record %d" % k for k in range(7)]
    again = datasources.records_of(spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path), compression)
    assert again.count() == 7


def test_corrupt_records_are_errors():
    data = datasources.framed(b"hello")
    assert [r for _, r in datasources.record_list(data)] == [b"hello"]
    with pytest.raises(ValueError, match="corrupted"):
        list(datasources.record_list(data[:13] + b"X" + data[14:]))
    with pytest.raises(ValueError, match="truncated"):
        list(datasources.record_list(data[:-1]))


def test_checksum_is_the_known_one():
    plain = (datasources.masked_crc(b"123456789") - datasources.CRC_MASK) & 0xFFFFFFFF
    assert (plain >> 17 | plain << 15) & 0xFFFFFFFF == 0xE3069283


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_chunks_round_trip(spark, tmp_path, compression):
    rows = spark.range(0, 10, 1, 3).select(F.lit("x").alias("record_id"), F.col("id").alias("ordinal"), F.when(F.col("id") != 4, F.repeat(F.lit("A"), F.col("id").cast("int") + 1).cast("binary")).alias("payload"))
    path = str(tmp_path / "out")
    rows.write.format("read_chunks").mode("append").option("path", path).option("column", "bases").option("record_id", "sample" * 9).option("compression", compression).save()
    found = spark.read.format("read_chunks").option("path", path).option("column", "bases").load().orderBy("ordinal").collect()
    assert [(r.ordinal, r.payload and len(r.payload)) for r in found] == [(k, None if k == 4 else k + 1) for k in range(10)]
    assert {r.record_id for r in found} == {("sample" * 9)[:32]}
    assert datasources.chunks_of(spark.read.format("binaryFile").load(path + "/*.bases")).count() == 10


def test_sqlite_types(spark, tmp_path):
    path = str(tmp_path / "d.sqlite")
    with sqlite3.connect(path) as db:
        db.execute("create table people (id integer, name text, score double, ok integer)")
        db.executemany("insert into people values (?, ?, ?, ?)", [(1, "a\0b", 9007199254740992.0, 1), (2, None, None, 0)])
    read = lambda schema: spark.read.format("sqlite").schema(schema).option("path", path).option("query", "select * from people order by id").load()
    assert [tuple(r) for r in read("id int, name string, score double, ok boolean").collect()] == [(1, "a\0b", 9007199254740992.0, True), (2, None, None, False)]
    with pytest.raises(Exception, match="4 columns"):
        read("id int").collect()


@pytest.mark.parametrize("packed", [False, True])
def test_csv_defaults(spark, tmp_path, packed):
    lines = "\n".join(",".join(str(7 * j + i) if (i, j) != (3, 4) else "" for i in range(7)) for j in range(10))
    path = tmp_path / ("a.csv.gz" if packed else "a.csv")
    path.write_bytes(gzip.compress(lines.encode()) if packed else lines.encode())
    schema = ", ".join(f"c{k} int" for k in range(7))
    rows = files.csv(spark, str(path), schema, {"c3": F.lit(0)}).collect()
    assert len(rows) == 10 and {r.c3 for r in rows} == {0} | {7 * j + 3 for j in range(10) if j != 4}
    with pytest.raises(Exception, match="c3 is required"):
        files.csv(spark, str(path), schema, {}).collect()


def test_files(spark, tmp_path):
    (tmp_path / "b.txt").write_text("one\ntwo\n")
    (tmp_path / "a.txt").write_text("three")
    found = files.text_lines(spark, str(tmp_path / "*.txt")).collect()
    assert sorted((r.key.rsplit("/", 1)[1], r.value) for r in found) == [("a.txt:1", "three"), ("b.txt:1", "one"), ("b.txt:2", "two")]
    assert [r.path.rsplit("/", 1)[1] for r in files.matching_files(spark, str(tmp_path / "*.txt")).collect()] == ["a.txt", "b.txt"]
    assert sorted(bytes(r.value) for r in files.whole_files(spark, str(tmp_path / "*.txt")).collect()) == [b"one\ntwo\n", b"three"]
    assert files.remove(spark, f"file://{tmp_path}/a.txt") == 1 and not (tmp_path / "a.txt").exists()


def test_fixed_length_records(spark, tmp_path):
    (tmp_path / "r.bin").write_bytes(b"H" + b"".join(b"%03d" % k for k in range(5)) + b"FF")
    read = spark.read.format("binaryFile").load(str(tmp_path / "r.bin"))
    assert [bytes(r.record) for r in datasources.fixed_length_records(read, 3, 1, 2).orderBy("index").collect()] == [b"%03d" % k for k in range(5)]
    with pytest.raises(Exception, match="doesn't fit"):
        datasources.fixed_length_records(read, 4, 1, 2).collect()


def test_key_ranges_cover_the_table(spark):
    table = spark.range(200).select(F.format_string("k%04d", "id").alias("key"))
    ranges = files.sample_keys(table, "key", 8).orderBy("start").collect()
    assert ranges[0].start == "" and ranges[-1].end is None and len(ranges) == 8
    assert sum(files.key_range(table, "key", r.start, r.end).count() for r in ranges) == 200


def test_indexed_access(spark):
    table = spark.range(16)
    assert files.at_index(table, "id", 3).first().id == 3
    with pytest.raises(Exception, match="out of range"):
        files.at_index(table, "id", 16).collect()
    with pytest.raises(ValueError):
        files.number_range(spark, 0, 5, 0)


def test_upsert(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert sorted(map(tuple, files.upsert(table, spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), "k").collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_compressed_payload(spark):
    from rillflow.functions.strings import decode_compressed

    row = spark.range(1).select(decode_compressed(F.lit(zlib.compress(b"x" * 50)), "ZLIB").alias("z"), decode_compressed(F.lit(gzip.compress(b"y")), "GZIP").alias("g")).first()
    assert (bytes(row.z), bytes(row.g)) == (b"x" * 50, b"y")


def test_records_overwrite_and_abort(spark, tmp_path):
    rows = lambda n, parts: spark.range(0, n, 1, parts).select(F.concat(F.lit("r"), "id").cast("binary").alias("record"), F.lit("").alias("file"), F.lit(0).cast("long").alias("offset"))
    path = str(tmp_path / "out")
    write = lambda df, mode: df.write.format("record_file").mode(mode).option("path", path).save()
    read = lambda: sorted(bytes(r.record) for r in spark.read.format("record_file").option("path", path).load().collect())
    write(rows(9, 4), "overwrite")
    write(rows(3, 2), "overwrite")  # fewer tasks leave no old parts
    assert read() == [b"r0", b"r1", b"r2"]
    write(rows(2, 1), "append")
    assert read() == [b"r0", b"r0", b"r1", b"r1", b"r2"]
    failing = rows(8, 2).withColumn("record", F.when(F.col("record") == b"r7", F.raise_error(F.lit("no more")).cast("binary")).otherwise(F.col("record")))
    with pytest.raises(Exception):
        write(failing, "append")
    assert read() == [b"r0", b"r0", b"r1", b"r1", b"r2"]
    assert spark.read.format("record_file").option("path", f"file://{path}").load().count() == 5


def test_long_records_in_small_pieces(monkeypatch):
    records = [bytes([k % 251]) * (k * 37) for k in range(60)]
    data = datasources.framed_all(records)
    pieces = [data[k : k + 101] for k in range(0, len(data), 101)]
    assert [r for _, r in datasources.framed_records(pieces)] == records
    packed = gzip.compress(data[:5000]) + gzip.compress(data[5000:])
    assert b"".join(datasources.inflated([packed[k : k + 50] for k in range(0, len(packed), 50)], "GZIP")) == data
    with pytest.raises(ValueError, match="truncated"):
        list(datasources.inflated([packed[:-20]], "GZIP"))
    with pytest.raises(ValueError, match="corrupted"):
        list(datasources.framed_records([b"\xff" * 12]))


def test_chunks_of_a_size(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.range(0, 10, 1, 1).select(F.lit("x").alias("record_id"), F.col("id").alias("ordinal"), F.lit(b"ab").alias("payload"))
    rows.write.format("read_chunks").mode("append").option("path", path).option("column", "qual").option("chunk_size", 4).save()
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith((".", "_"))) == ["chunk_0.qual", "chunk_4.qual", "chunk_8.qual"]
    assert spark.read.format("read_chunks").option("path", path).option("column", "qual").load().count() == 10


def test_lines_of_a_split_file(spark, tmp_path):
    lines = [f"line {k} " + "x" * (k % 50) for k in range(3000)]
    (tmp_path / "big.txt").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        df = files.numbered_lines(spark, str(tmp_path / "big.txt"))
        assert spark.read.text(str(tmp_path / "big.txt")).rdd.getNumPartitions() > 4
        found = df.orderBy("line").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.line for r in found] == list(range(3000)) and [r.value for r in found] == lines


def test_sqlite_in_parts(spark, tmp_path):
    path = str(tmp_path / "d.sqlite")
    with sqlite3.connect(path) as db:
        db.execute("create table t (id integer)")
        db.executemany("insert into t values (?)", [(k,) for k in range(-5, 50)])
    df = spark.read.format("sqlite").schema("id int").option("path", path).option("query", "select id from t").option("key", "id").option("parts", 4).load()
    assert sorted(r.id for r in df.collect()) == list(range(-5, 50)) and df.rdd.getNumPartitions() == 4


def test_sequence_files(spark, tmp_path):
    df = spark.createDataFrame([("a", "1"), ("b", "2")], "k string, v string")
    files.write_sequence_file(df, "k", "v", str(tmp_path / "seq"))
    assert sorted(map(tuple, files.sequence_file(spark, str(tmp_path / "seq")).collect())) == [("a", "1"), ("b", "2")]


def test_sinks(spark, tmp_path):
    files.log_events(spark.range(3), str(tmp_path / "log"))
    files.log_events(spark.range(2), str(tmp_path / "log"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "log")).count() == 5
    files.discard(spark.range(4))
    files.write_file(spark, f"file://{tmp_path}/one.bin", b"\x00\x01")
    assert (tmp_path / "one.bin").read_bytes() == b"\x00\x01"
    files.save({"a": spark.range(2), "b": spark.range(3)}, str(tmp_path / "s1"))
    files.save({"a": spark.range(4)}, str(tmp_path / "s2"))
    assert files.restore(spark, str(tmp_path / "s1"), "a", "b")["b"].count() == 3
    files.merge_saved(spark, [str(tmp_path / "s1"), str(tmp_path / "s2")], ["a"], str(tmp_path / "m"))
    assert files.restore(spark, str(tmp_path / "m"), "a")["a"].count() == 6
    files.summary_scalars(spark.range(5), F.lit(3), str(tmp_path / "sum"), n=F.count(F.lit(1)), top=F.max("id"))
    assert {(r.step, r.tag, r.value) for r in spark.read.parquet(str(tmp_path / "sum")).collect()} == {(3, "n", 5.0), (3, "top", 4.0)}
    files.summary_histogram(spark.range(5), "id", 3, "ids", str(tmp_path / "hist"))
    assert spark.read.parquet(str(tmp_path / "hist")).agg(F.sum("n")).first()[0] == 5


def test_connectors_ask_for_what_they_are_told():
    from rillflow.sources import connectors

    kind, options = connectors.kafka("h:9", ["t:0:5:10", "t:1"])
    assert kind == "kafka" and options["startingOffsets"] == '{"t": {"0": 5, "1": 0}}' and options["endingOffsets"] == '{"t": {"0": 15, "1": -1}}'
    assert connectors.kinesis("s", "r", "shard-1", interval_ms=5)[1]["kinesis.executor.idleTimeBetweenReadsInMs"] == "5"
    assert connectors.warehouse("store", "p", "d", "t", ["a", "b"], 7, 3)[1] == {"table": "p.d.t", "readDataFormat": "ARROW", "parentProject": "p", "selectedFields": "a,b", "snapshotTimeMillis": "7", "maxParallelism": "3"}
    assert connectors.object_store("http://x", "k", "s")["spark.hadoop.fs.s3a.endpoint"] == "http://x"


def test_generators_in_tasks(spark):
    found = files.from_generator(spark, lambda n: iter([(k, str(k)) for k in range(n)]), "a long, b string", args=(9000,)).collect()
    assert len(found) == 9000 and [r.pos for r in sorted(found, key=lambda r: r.a)] == list(range(9000))


def test_readers_count_and_resume(spark, tmp_path):
    rows = spark.range(10).select("id", F.floor(F.col("id") / 4).alias("file"))
    reader = files.Reader(rows, ["id"], "file")
    assert [r.id for r in reader.read_up_to(5).orderBy("id").collect()] == [0, 1, 2, 3, 4] and reader.num_records_produced() == 5 and reader.num_work_units_completed() == 1
    assert reader.read().first().id == 5
    state = reader.serialize()
    reader.reset()
    assert reader.num_records_produced() == 0
    reader.restore(state)
    assert reader.read_up_to(100).count() == 4 and reader.num_work_units_completed() == 3
    with pytest.raises(Exception, match="exactly one"):
        reader.read().collect()
    with pytest.raises(ValueError):
        reader.restore(b"x")


def tree_file(entries, size=4096, fan=7, newer=True):
    """A database file of sorted entries, written page by page by the format's rules: leaves of ``fan`` entries, branches over them, values over a quarter page on pages of their own."""
    pages = [b"", b""]

    def page(number, flags, nodes):
        upper, pointers, body = size, [], b""
        for node in nodes:
            node += b"\0" * (len(node) % 2)
            upper -= len(node)
            pointers.append(upper)
            body = node + body
        lower = 16 + 2 * len(nodes)
        head = struct.pack("<QHHHH", number, 0, flags, lower, upper) + struct.pack(f"<{len(nodes)}H", *pointers)
        assert lower <= upper
        return head + b"\0" * (upper - lower) + body

    def leaf(key, value):
        flags = 0
        if len(value) > size // 4:
            flags, first = 1, len(pages)
            whole = struct.pack("<QHHI", first, 0, 4, -(-(16 + len(value)) // size)) + value
            pages.extend((whole + b"\0" * (-len(whole) % size))[k : k + size] for k in range(0, -(-len(whole) // size) * size, size))
            return struct.pack("<HHHH", len(value) & 0xFFFF, len(value) >> 16, flags, len(key)) + key + struct.pack("<Q", first)
        return struct.pack("<HHHH", len(value), 0, flags, len(key)) + key + value

    level = []
    for k in range(0, len(entries), fan):
        nodes = [leaf(*e) for e in entries[k : k + fan]]
        level.append((entries[k][0], len(pages)))
        pages.append(page(len(pages), 2, nodes))
    while len(level) > 1:
        above = []
        for k in range(0, len(level), fan):
            nodes = [struct.pack("<HHHH", p & 0xFFFF, p >> 16 & 0xFFFF, p >> 32, len(key) if j else 0) + (key if j else b"") for j, (key, p) in enumerate(level[k : k + fan])]
            above.append((level[k][0], len(pages)))
            pages.append(page(len(pages), 1, nodes))
        level = above
    root = level[0][1] if level else (1 << 64) - 1
    for n in (0, 1):
        now = n == newer
        free = struct.pack("<IHHQQQQQ", size, 0, 0, 0, 0, 0, 0, (1 << 64) - 1)
        main = struct.pack("<IHHQQQQQ", 0, 0, 1, 0, 0, 0, len(entries) if now else 0, root if now else (1 << 64) - 1)
        meta = struct.pack("<QHHHH", n, 0, 8, 0, 0) + struct.pack("<IIQQ", 0xBEEFC0DE, 1, 0, 1 << 20) + free + main + struct.pack("<QQ", len(pages) - 1, 5 + now)
        pages[n] = meta + b"\0" * (size - len(meta))
    return b"".join(pages)


@pytest.mark.parametrize("n, newer", [(0, True), (1, False), (5, True), (400, False)])
def test_tree_databases(spark, tmp_path, n, newer):
    spark.dataSource.register(btree.TreeSource)
    entries = [(b"key%05d" % k, b"v" * (5000 if k % 97 == 3 else k % 50)) for k in range(n)]
    (tmp_path / "data.mdb").write_bytes(tree_file(entries, newer=newer))
    for parts in (1, 5):
        df = spark.read.format("btree").option("path", str(tmp_path / "data.mdb")).option("parts", parts).load()
        assert sorted((bytes(r.key), bytes(r.value)) for r in df.collect()) == entries
    assert parts == 5 and (n < 100 or df.rdd.getNumPartitions() > 3)
    assert btree.entries_of(spark.read.format("binaryFile").load(str(tmp_path / "data.mdb"))).count() == n
    with pytest.raises(ValueError, match="not a database"):
        btree.state(b"\0" * 9000)


def test_small_chunks_are_read_together(spark, tmp_path):
    """A task for each chunk file is too many."""
    path = str(tmp_path / "out")
    rows = spark.range(0, 900, 1, 1).select(F.lit("x").alias("record_id"), F.col("id").alias("ordinal"), F.col("id").cast("string").cast("binary").alias("payload"))
    rows.write.format("read_chunks").mode("append").option("path", path).option("column", "qual").option("chunk_size", 1).save()
    found = spark.read.format("read_chunks").option("path", path).option("column", "qual").load()
    assert found.rdd.getNumPartitions() == 2
    assert sorted((r.ordinal, bytes(r.payload)) for r in found.collect()) == [(k, b"%d" % k) for k in range(900)]


def test_record_files_end(tmp_path, monkeypatch):
    """A writer's files don't grow with a task's rows, and readers give out batches of a size."""
    import pyspark

    monkeypatch.setattr(datasources, "FILE_BYTES", 400)
    monkeypatch.setattr(datasources, "PIECE", 100)
    monkeypatch.setattr(pyspark.TaskContext, "get", staticmethod(lambda: type("Context", (), {"partitionId": lambda self: 3, "attemptNumber": lambda self: 0})()))
    writer = datasources.RecordWriter({"path": str(tmp_path), "compression": "GZIP"}, True)
    writer.commit([writer.write((b"record %d" % k,) for k in range(200))])
    files_ = sorted(p for p in tmp_path.iterdir() if p.name.startswith("part-"))
    assert len(files_) > 5 and files_[0].name == "part-00003"
    reader = datasources.RecordReader({"path": str(tmp_path), "compression": "GZIP"})
    assert sorted(r for p in reader.partitions() for r, *_ in reader.read(p)) == sorted(b"record %d" % k for k in range(200))
    import pyarrow as pa

    made = [*datasources.batches_of(((k, b"x" * 30) for k in range(10)), ["k", "b"], (pa.int64(), pa.binary()))]
    assert [len(b) for b in made] == [4, 4, 2]
    assert b"".join(datasources.slices(pa.scalar(b"y" * 250, pa.binary()))) == b"y" * 250
