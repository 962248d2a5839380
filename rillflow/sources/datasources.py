"""Python data sources: length-delimited record files, chunked column files of sequencing reads, SQLite queries.

Readers and writers run on the executors and open files through Arrow's file systems (local, HDFS, object stores, by the path's scheme), one partition for each file, read and written piece by piece: what a task
holds is a piece, not a file. Each task of a writer writes files of its own beside their places, and the driver moves them there when all tasks have ended, or deletes them when the job fails. Payloads of
stores that only Spark opens are read with ``records_of`` and ``chunks_of`` on binaryFile rows.
"""

from __future__ import annotations

import gzip
import sqlite3
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: Fixed values of the chunk file's header.
CHUNK_HEADER = struct.Struct("<BBBBHHQQ32s")
CHUNK_RECORD_TYPES = {"text": 0, "structured": 1, "base_compact": 2}
CHUNK_COMPRESSIONS = {"none": 0, "gzip": 2}
CRC_MASK = 0xA282EAD8


def _crc_table() -> list[int]:
    table = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0x82F63B78 if n & 1 else 0)
        table.append(n)
    return table


_CRC = _crc_table()


STRIP = 256


def _shift_tables() -> np.ndarray:
    """For each byte of a checksum, what it becomes when STRIP zero bytes follow."""
    out = np.zeros((4, 256), np.uint32)
    for byte in range(4):
        for bit in range(8):
            crc = 1 << (8 * byte + bit)
            for _ in range(STRIP):
                crc = _CRC[crc & 0xFF] ^ crc >> 8
            at = np.arange(256)
            out[byte] ^= np.where(at >> bit & 1, crc, 0).astype(np.uint32)
    return out


_SHIFT = _shift_tables()
_CRC_ARRAY = np.array(_CRC, np.uint32)


def checksums(records: list[bytes]) -> np.ndarray:
    """The Castagnoli checksums of records, all worked on together: each is cut into strips, the strips of all run side by side, and are joined by what zero bytes after a strip do to its checksum."""
    out = np.zeros(len(records), np.uint32)
    long = [k for k, r in enumerate(records) if len(r) >= 4]
    for k in set(range(len(records))) - set(long):
        crc = 0xFFFFFFFF
        for b in records[k]:
            crc = _CRC[(crc ^ b) & 0xFF] ^ crc >> 8
        out[k] = crc
    if long:
        sizes = np.array([len(records[k]) for k in long])
        counts = -(-sizes // STRIP)
        ends = np.cumsum(counts) * STRIP
        data = np.zeros(int(ends[-1]), np.uint8)
        for k, end in zip(long, ends.tolist(), strict=True):
            start = end - len(records[k])  # zeros before a record change nothing
            data[start:end] = np.frombuffer(records[k], np.uint8)
            data[start : start + 4] ^= 0xFF  # what the checksum begins with
        strips = data.reshape(-1, STRIP)
        crc = np.zeros(len(strips), np.uint32)
        for at in range(STRIP):
            crc = _CRC_ARRAY[(crc ^ strips[:, at]) & 0xFF] ^ (crc >> np.uint32(8))
        first = np.cumsum(counts) - counts
        total = np.zeros(len(long), np.uint32)
        for n in range(int(counts.max())):
            on = np.flatnonzero(counts > n)
            moved = total[on]
            moved = _SHIFT[0][moved & 0xFF] ^ _SHIFT[1][moved >> 8 & 0xFF] ^ _SHIFT[2][moved >> 16 & 0xFF] ^ _SHIFT[3][moved >> 24]
            total[on] = moved ^ crc[first[on] + n]
        out[long] = total
    return out ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    """Checksums rotated and offset as record files store them."""
    return (crc >> np.uint32(15) | crc << np.uint32(17)) + np.uint32(CRC_MASK)


def masked_crc(data: bytes) -> int:
    with np.errstate(over="ignore"):
        return int(masked(checksums([data]))[0])


PIECE = 1 << 22


def inflated(pieces: Iterable[bytes], compression: str) -> Iterator[bytes]:
    if compression in ("", "none", "NONE"):
        yield from pieces
        return
    wbits = {"ZLIB": 15, "GZIP": 31}[compression.upper()]
    machine = zlib.decompressobj(wbits)
    for piece in pieces:
        while piece:
            if out := machine.decompress(piece, PIECE):
                yield out
            piece = machine.unconsumed_tail or machine.unused_data
            if machine.eof and piece:  # members follow one another
                machine = zlib.decompressobj(wbits)
    if out := machine.flush():
        yield out
    if not machine.eof:
        raise ValueError("truncated compressed data")


def framed_records(pieces: Iterable[bytes], verify: bool = True) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of a record file; an error on a checksum that doesn't fit or a cut record."""
    held, begins = b"", 0
    for piece in pieces:
        held += piece
        heads, records, tails, offsets, at = [], [], [], [], 0
        while len(held) - at >= 12:
            (size,) = struct.unpack_from("<Q", held, at)
            if verify and size > len(held) - at and masked_crc(held[at : at + 8]) != struct.unpack_from("<I", held, at + 8)[0]:
                raise ValueError("corrupted record")
            if len(held) - at < size + 16:
                break
            heads.append(held[at : at + 12])
            records.append(held[at + 12 : at + 12 + size])
            tails.append(held[at + 12 + size : at + 16 + size])
            offsets.append(begins + at)
            at += 16 + size
        if verify and records:
            with np.errstate(over="ignore"):
                heads_good = masked(checksums([h[:8] for h in heads])) == np.frombuffer(b"".join(h[8:] for h in heads), "<u4")
                good = heads_good & (masked(checksums(records)) == np.frombuffer(b"".join(tails), "<u4"))
            if not good.all():
                raise ValueError("corrupted record")
        yield from zip(offsets, records, strict=True)
        begins, held = begins + at, held[at:]
    if held:
        raise ValueError("truncated record" if len(held) >= 12 else "truncated record header")


def record_list(data: bytes, verify: bool = True) -> Iterator[tuple[int, bytes]]:
    return framed_records([data], verify)


def framed_all(records: list[bytes]) -> bytes:
    sizes = [struct.pack("<Q", len(r)) for r in records]
    with np.errstate(over="ignore"):
        heads, bodies = masked(checksums(sizes)), masked(checksums(records))
    return b"".join(x for size, head, record, body in zip(sizes, heads.tolist(), records, bodies.tolist(), strict=True) for x in (size, struct.pack("<I", head), record, struct.pack("<I", body)))


def framed(record: bytes) -> bytes:
    return framed_all([record])


#: A task reads chunk files of so many bytes together, or so many files; record files end at so many bytes.
TASK_BYTES, TASK_FILES, FILE_BYTES = 1 << 24, 512, 1 << 25
#: Rows of a batch that a reader gives out.
ROWS = 10_000


class Files(InputPartition):
    def __init__(self, *paths: str):
        self.paths = paths


def store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path in it."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), path[len("file:") :].replace("//", "/", 1) if path.startswith("file://") else path[len("file:") :]
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def listed(path: str, suffix: str = "") -> list[str]:
    """The files of a folder, or the one file, as paths that ``store`` takes."""
    system, place = store(path)
    found = system.get_file_info(place)
    if found.type != pafs.FileType.Directory:
        return [path]
    names = [f.base_name for f in system.get_file_info(pafs.FileSelector(place)) if f.type == pafs.FileType.File]
    return [f"{path.rstrip('/')}/{n}" for n in sorted(names) if not n.startswith(("_", ".")) and n.endswith(suffix)]


def together(path: str, suffix: str = "") -> list[Files]:
    """The files of ``listed``, small ones in one partition."""
    system, place = store(path)
    sizes = {f.base_name: f.size or 0 for f in system.get_file_info(pafs.FileSelector(place))} if system.get_file_info(place).type == pafs.FileType.Directory else {}
    out, held, size = [], [], 0
    for p in listed(path, suffix):
        own = sizes.get(p.rsplit("/", 1)[-1], 0)
        if held and (size + own > TASK_BYTES or len(held) == TASK_FILES):
            out.append(Files(*held))
            held, size = [], 0
        held.append(p)
        size += own
    return [*out, Files(*held)]


def batches_of(rows: Iterable[tuple], names: list[str], kinds: tuple) -> Iterator[pa.RecordBatch]:
    """Batches of ROWS rows, or of PIECE bytes in the last column."""
    held, size = [], 0

    def batch():
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], t) for k, t in enumerate(kinds)], names=names)

    for row in rows:
        held.append(row)
        size += len(row[-1] or b"")
        if len(held) >= ROWS or size >= PIECE:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def pieces_of(path: str) -> Iterator[bytes]:
    system, place = store(path)
    with system.open_input_stream(place) as f:
        while piece := f.read(PIECE):
            yield piece


class Written(WriterCommitMessage):
    """What a task wrote, and where it belongs."""

    def __init__(self, moves: list[tuple[str, str]]):
        self.moves = moves


class Moved:
    """Commit and abort of writers: files are put in place at the end, or deleted. ``overwrite``: what was there before goes first."""

    def __init__(self, options, overwrite: bool):
        self.options, self.overwrite, self.job = options, overwrite, uuid.uuid4().hex

    def commit(self, messages):
        system, top = store(self.options["path"])
        system.create_dir(top, recursive=True)
        kept = {to for m in messages if m for _, to in m.moves}
        if self.overwrite:
            for path in listed(self.options["path"], self.suffix()):
                if store(path)[1] not in kept:
                    system.delete_file(store(path)[1])
        for m in messages:
            for at, to in m.moves if m else ():
                system.move(at, to)
        with system.open_output_stream(f"{top}/_SUCCESS") as f:
            f.write(b"")

    def abort(self, messages):
        system, _ = store(self.options["path"])
        for m in messages:
            for at, _ in m.moves if m else ():
                system.delete_file(at)

    def suffix(self) -> str:
        return ""

    def place(self, name: str) -> tuple[pafs.FileSystem, str, str]:
        """(file system, where a task writes, where it belongs)."""
        from pyspark import TaskContext

        system, top = store(self.options["path"])
        system.create_dir(top, recursive=True)
        return system, f"{top}/_{self.job}-{TaskContext.get().attemptNumber()}-{name}", f"{top}/{name}"


class RecordSource(DataSource):
    """Format ``record_file``: (record binary, file string, offset bigint). Options: path, compression (none, ZLIB, GZIP)."""

    @classmethod
    def name(cls) -> str:
        return "record_file"

    def schema(self) -> str:
        return "record binary, file string, offset bigint"

    def reader(self, schema) -> DataSourceReader:
        return RecordReader(self.options)

    def writer(self, schema, overwrite) -> DataSourceWriter:
        return RecordWriter(self.options, overwrite)


class RecordReader(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def partitions(self):
        return [Files(p) for p in listed(self.options["path"])] or [Files()]

    def read(self, partition):
        for path in partition.paths:
            for offset, record in framed_records(inflated(pieces_of(path), self.options.get("compression", "none"))):
                yield record, path, offset


class RecordWriter(Moved, DataSourceWriter):
    """Files of FILE_BYTES, or as many as end the task's rows, written as these come: what reads a file whole finds none that grows with the table."""

    def write(self, rows):
        from pyspark import TaskContext

        kind = self.options.get("compression", "none").upper()
        part, moves, more, rows = TaskContext.get().partitionId(), [], True, iter(rows)
        while more:
            name = f"part-{part:05d}" + (f"-{len(moves):05d}" if moves else "")
            system, at, to = self.place(name if self.overwrite else f"{name}-{self.job[:8]}")
            machine = zlib.compressobj(6, zlib.DEFLATED, 15 if kind == "ZLIB" else 31) if kind in ("ZLIB", "GZIP") else None
            with system.open_output_stream(at) as out:
                held, size, total, more = [], 0, 0, False
                for row in rows:
                    held.append(bytes(row[0]))
                    size += len(held[-1])
                    if size >= PIECE:
                        data = framed_all(held)
                        out.write(machine.compress(data) if machine else data)
                        held, size, total = [], 0, total + len(data)
                        if total >= FILE_BYTES:
                            more = True
                            break
                data = framed_all(held)
                out.write(machine.compress(data) + machine.flush() if machine else data)
            moves.append((at, to))
        return Written(moves)


def chunk_file(record_id: str, first: int, records: list[bytes], record_type: str = "text", compression: str = "none") -> bytes:
    """A chunk file: header, an index of lengths, the payloads. The last ordinal is exclusive; a record of no bytes is a gap."""
    if any(len(r) > 0xFFFFFFFF for r in records):
        raise ValueError("record too large")
    body = b"".join(struct.pack("<I", len(r)) for r in records) + b"".join(records)
    body = gzip.compress(body) if compression == "gzip" else body
    head = CHUNK_HEADER.pack(0, 1, CHUNK_RECORD_TYPES[record_type], CHUNK_COMPRESSIONS[compression], CHUNK_HEADER.size, 0, first, first + len(records), record_id.encode()[:32])
    return head + body


def chunk_records(data: bytes) -> Iterator[tuple[str, int, bytes | None]]:
    """(record_id, ordinal, payload or None) of a chunk file."""
    _, _, _, compression, start, _, first, last, record_id = CHUNK_HEADER.unpack(data[: CHUNK_HEADER.size])
    body = data[start:]
    if compression == CHUNK_COMPRESSIONS["gzip"]:
        body = gzip.decompress(body)
    elif compression:
        raise ValueError("unknown compression")
    n = last - first
    sizes = struct.unpack(f"<{n}I", body[: 4 * n])
    if len(body) != 4 * n + sum(sizes):
        raise ValueError("chunk size doesn't fit its index")
    at, name = 4 * n, record_id.rstrip(b"\0").decode()
    for k, size in enumerate(sizes):
        yield name, first + k, body[at : at + size] if size else None
        at += size


class ChunkSource(DataSource):
    """Format ``read_chunks``: (record_id string, ordinal bigint, payload binary) of the chunk files of one column. Options: path, column; to write: record_id, record_type, compression, chunk_size (records a file, all of a task's without it)."""

    @classmethod
    def name(cls) -> str:
        return "read_chunks"

    def schema(self) -> str:
        return "record_id string, ordinal bigint, payload binary"

    def reader(self, schema) -> DataSourceReader:
        return ChunkReader(self.options)

    def writer(self, schema, overwrite) -> DataSourceArrowWriter:
        return ChunkWriter(self.options, overwrite)


class ChunkReader(DataSourceReader):
    """A chunk is the unit of the format: it is read whole. Chunks may be small and many: a task reads some hundreds of them."""

    def __init__(self, options):
        self.options = options

    def partitions(self):
        return together(self.options["path"], "." + self.options["column"])

    def read(self, partition):
        rows = (r for path in partition.paths for r in chunk_records(b"".join(pieces_of(path))))
        yield from batches_of(rows, ["record_id", "ordinal", "payload"], (pa.string(), pa.int64(), pa.binary()))


class ChunkWriter(Moved, DataSourceArrowWriter):
    """Chunk files of each task's rows, in the order of their ordinals, which must be consecutive within a file."""

    def suffix(self) -> str:
        return "." + self.options["column"]

    def write(self, batches):
        held = [b.select(["ordinal", "payload"]).cast(pa.schema([("ordinal", pa.int64()), ("payload", pa.large_binary())])) for b in batches]
        table = pa.Table.from_batches(held).sort_by("ordinal") if held else []
        size = int(self.options.get("chunk_size", len(table) or 1))
        moves = []
        for k in range(0, len(table), size):
            cut = table.slice(k, size)
            part = [*zip(cut.column("ordinal").to_pylist(), cut.column("payload").to_pylist(), strict=True)]
            if part[-1][0] - part[0][0] != len(part) - 1:
                raise ValueError("ordinals of a chunk must be consecutive")
            data = chunk_file(self.options.get("record_id", "records"), part[0][0], [p or b"" for _, p in part], self.options.get("record_type", "text"), self.options.get("compression", "none"))
            system, at, to = self.place(f"chunk_{part[0][0]}{self.suffix()}")
            with system.open_output_stream(at) as f:
                f.write(data)
            moves.append((at, to))
        return Written(moves)


class SqliteSource(DataSource):
    """Format ``sqlite``: the rows of a query. Options: path, query, and to read by several tasks: key (a whole-number column of the query), parts. A schema must be given and have as many columns as the query."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def reader(self, schema) -> DataSourceReader:
        return SqliteReader(self.options, schema)


class SqliteReader(DataSourceReader):
    def __init__(self, options, schema):
        self.options, self.fields = options, schema.fields

    def partitions(self):
        return [InputPartition(k) for k in range(int(self.options.get("parts", 1)) if "key" in self.options else 1)]

    def read(self, partition):
        from pyspark.sql import types as T

        cast = {T.BooleanType: bool, T.FloatType: float, T.DoubleType: float, T.StringType: str}
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
            parts = int(self.options.get("parts", 1))
            query = self.options["query"] if "key" not in self.options else f"select * from ({self.options['query']}) where abs({self.options['key']}) % {parts} = {partition.value}"
            cursor = db.execute(query)
            if len(cursor.description) != len(self.fields):
                raise ValueError(f"the query has {len(cursor.description)} columns, the schema {len(self.fields)}")
            for row in cursor:
                yield tuple(None if v is None else cast.get(type(f.dataType), int)(v) for v, f in zip(row, self.fields, strict=True))


def register(spark: SparkSession) -> None:
    for source in (RecordSource, ChunkSource, SqliteSource):
        spark.dataSource.register(source)


def slices(content: pa.Scalar) -> Iterator[bytes]:
    """A file's content piece by piece, each copied as it is asked for."""
    whole = content.as_buffer()
    for at in range(0, whole.size if whole else 0, PIECE):
        yield whole.slice(at, min(PIECE, whole.size - at)).to_pybytes()


def records_of(files: DataFrame, compression: str = "none") -> DataFrame:
    """(path, offset, record) of binaryFile rows, for stores that only Spark opens."""

    def run(batches):
        for batch in batches:
            rows = ((p, o, r) for p, c in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True) for o, r in framed_records(inflated(slices(c), compression)))
            yield from batches_of(rows, ["path", "offset", "record"], (pa.string(), pa.int64(), pa.binary()))

    return files.select("path", "content").mapInArrow(run, "path string, offset bigint, record binary")


def chunks_of(files: DataFrame) -> DataFrame:
    """(record_id, ordinal, payload) of binaryFile rows."""

    def run(batches):
        for batch in batches:
            rows = (r for c in batch.column("content") for r in chunk_records(c.as_py()))
            yield from batches_of(rows, ["record_id", "ordinal", "payload"], (pa.string(), pa.int64(), pa.binary()))

    return files.select("content").mapInArrow(run, "record_id string, ordinal bigint, payload binary")


def fixed_length_records(files: DataFrame, size: int, header: int = 0, footer: int = 0) -> DataFrame:
    """(path, index, record) of binaryFile rows: records of ``size`` bytes between a header and a footer; a remainder is an error."""
    body = F.octet_length("content") - header - footer
    count = F.when(body % size == 0, F.floor(body / size)).otherwise(F.raise_error(F.lit("file size doesn't fit the record size")).cast("long"))
    at = files.select("path", "content", F.explode(F.when(count > 0, F.sequence(F.lit(0).cast("long"), count - 1)).otherwise(F.array().cast("array<bigint>"))).alias("index"))
    return at.select("path", "index", F.expr(f"substring(content, cast(index as int) * {size} + {header + 1}, {size})").alias("record"))
