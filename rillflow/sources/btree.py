"""Memory-mapped B+tree databases of keys and values (LMDB files), read page by page from any file that is at hand as bytes or a map.

A file is pages of one size. The first two hold the state of the last two transactions; the later one counts. From its root, branch pages lead to leaf pages, whose nodes hold keys and values in
order; a large value lies on pages of its own. Named databases and repeated keys are not read.
"""

from __future__ import annotations

import mmap
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Fixed values of the file format.
MAGIC = 0xBEEFC0DE
PAGE_HEADER, NODE_HEADER = 16, 8
BRANCH, LEAF, META = 0x01, 0x02, 0x08
BIG_VALUE, SUB_DATABASE, REPEATED = 0x01, 0x02, 0x04
NO_PAGE = (1 << 64) - 1


def state(data: bytes | mmap.mmap) -> tuple[int, int, int]:
    """(page size, root page, entries) of the later of the two states."""
    found = []
    if len(data) < 2 * (PAGE_HEADER + 136):
        raise ValueError("not a database: too short")
    size = struct.unpack_from("<I", data, PAGE_HEADER + 24)[0]
    for at in (0, size):
        magic, version = struct.unpack_from("<II", data, at + PAGE_HEADER)
        if magic != MAGIC or version != 1:
            raise ValueError("not a database: no state page")
        entries, root = struct.unpack_from("<QQ", data, at + PAGE_HEADER + 24 + 48 + 32)
        (transaction,) = struct.unpack_from("<Q", data, at + PAGE_HEADER + 24 + 96 + 8)
        found.append((transaction, root, entries))
    _, root, entries = max(found)
    return size, root, entries


def nodes(data: bytes | mmap.mmap, size: int, page: int) -> Iterator[tuple[int, int, bytes, int]]:
    """(low number, flags, key, where the value begins) of a page's nodes in order."""
    at = page * size
    (lower,) = struct.unpack_from("<H", data, at + 12)
    for k in range((lower - PAGE_HEADER) // 2):
        (offset,) = struct.unpack_from("<H", data, at + PAGE_HEADER + 2 * k)
        low, high, flags, key_size = struct.unpack_from("<HHHH", data, at + offset)
        begin = at + offset + NODE_HEADER
        yield low | high << 16, flags, bytes(data[begin : begin + key_size]), begin + key_size


def pages_below(data: bytes | mmap.mmap, size: int, page: int) -> list[int]:
    """The children of a branch page."""
    return [low | flags << 32 for low, flags, _, _ in nodes(data, size, page)]


def entries_below(data: bytes | mmap.mmap, size: int, page: int) -> Iterator[tuple[bytes, bytes]]:
    """(key, value) of all leaves below a page, in the order of keys."""
    work = [page]
    while work:
        page = work.pop()
        (flags,) = struct.unpack_from("<H", data, page * size + 10)
        if flags & BRANCH:
            work += reversed(pages_below(data, size, page))
            continue
        if not flags & LEAF:
            raise ValueError(f"page {page} is neither branch nor leaf")
        for length, kind, key, at in nodes(data, size, page):
            if kind & (SUB_DATABASE | REPEATED):
                raise ValueError("named databases and repeated keys are not read")
            if kind & BIG_VALUE:
                (first,) = struct.unpack_from("<Q", data, at)
                at = first * size + PAGE_HEADER
            yield key, bytes(data[at : at + length])


class Subtree(InputPartition):
    def __init__(self, pages: list[int]):
        self.pages = pages


class TreeSource(DataSource):
    """Format ``btree``: (key binary, value binary). Options: path, a file that every executor has or reaches; parts: tasks to read it by, which share the subtrees below the root."""

    @classmethod
    def name(cls) -> str:
        return "btree"

    def schema(self) -> str:
        return "key binary, value binary"

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(self.options)


class TreeReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.parts = options["path"], int(options.get("parts", 1))

    def opened(self) -> mmap.mmap:
        with open(self.path.removeprefix("file://"), "rb") as f:
            return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)

    def partitions(self):
        data = self.opened()
        size, root, _ = state(data)
        if root == NO_PAGE:
            return [Subtree([])]
        level = [root]
        while len(level) < self.parts and struct.unpack_from("<H", data, level[0] * size + 10)[0] & BRANCH:
            level = [child for page in level for child in pages_below(data, size, page)]
        each = -(-len(level) // self.parts)
        return [Subtree(level[k : k + each]) for k in range(0, len(level), each)]

    def read(self, partition):
        data = self.opened()
        size, _, _ = state(data)
        keys, values, held = [], [], 0
        for page in partition.pages:
            for key, value in entries_below(data, size, page):
                keys.append(key)
                values.append(value)
                held += len(key) + len(value)
                if held > 1 << 22:
                    yield batch(keys, values)
                    keys, values, held = [], [], 0
        yield batch(keys, values)


def batch(keys: list[bytes], values: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(values, pa.binary())], names=["key", "value"])


def entries_of(files: DataFrame) -> DataFrame:
    """(path, key, value) of binaryFile rows, for stores that only Spark opens."""

    def run(batches):
        for rows in batches:
            for path, data in zip(rows.column("path").to_pylist(), rows.column("content").to_pylist(), strict=True):
                size, root, _ = state(data)
                found = [] if root == NO_PAGE else [*entries_below(data, size, root)]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(found)), pa.array([k for k, _ in found], pa.binary()), pa.array([v for _, v in found], pa.binary())], names=["path", "key", "value"])

    return files.select("path", "content").mapInArrow(run, "path string, key binary, value binary")
