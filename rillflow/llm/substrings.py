"""Exact-substring deduplication across documents by distributed suffix sorting.

A byte is removed if a string of WINDOW bytes that covers it also starts in a document with a smaller doc_id. All windows of all documents are judged:

1. The windows of a document fall into runs that share an anchor, the gram of least hash in the window. Equal windows have equal anchors, so only runs
   with one anchor need to be compared. Runs are dealt by their anchor's hash, packed. Runs of equal content are one class, whose least document covers the others'.
2. Where an anchor has several classes, the bytes of each class's run are fetched from its document, and the suffixes that start at its windows are
   sorted deep-shallow: multikey quicksort to a shallow depth, then blind tries. Suffixes that agree on WINDOW bytes stand together;
   those in a later document than the least are covered. A window whose hash is no other's in the task has no equal, and is left out of the sort.
   Anchors with very many classes are split by the content of their windows.
3. The covered stretches meet their documents again, and are cut out.

Copies within a task are settled there before anything is shuffled, so a hot passage or a group of copies sends a row from each task. Only bins of bounded
numbers of documents, anchors or windows meet in a task; their number grows with the data. A bin sends at most one row to each other bin, so rows grow with the product of their numbers:
bins of documents are small only while they are few, and a row is packed by one transposition.

Nulls count as empty texts. A text shorter than WINDOW keeps all its bytes. Rows of one doc_id do not remove one another; rows of one doc_id with
different texts are told apart by a checksum of the text. A null doc_id counts as larger than all others. An empty table gives an empty result; further columns play no part.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.llm.common import durable, mixed, release, slices, texts, tidy, utf8
from rillflow.llm.suffixes import WINDOW, U, anchored, deep_shallow, hashes, repeated, segments

LAST = np.iinfo(np.int64).max
HOLD = 400_000
RUNS_A_BIN = 350_000
DOCS_A_BIN = 400
MANY_BINS = 512
TEXT_A_BIN = 1 << 23
MOST_DOCS_A_BIN = 50_000
MANY_CLASSES = 16_384
HOT_AT_ONCE = 20_000

#: Fields of packed rows, each stored plane by plane so that equal high bytes compress.
RUN = (("anchor", "<u4"), ("content", "<u8"), ("doc", "<i8"), ("tag", "<u2"), ("start", "<u4"), ("windows", "u1"))
STRETCH = (("doc", "<i8"), ("tag", "<u2"), ("start", "<u4"), ("length", "<u4"))
REQUEST = (("doc", "<i8"), ("tag", "<u2"), ("start", "<u4"), ("windows", "u1"), ("key", "<u8"), ("hot", "u1"))
ITEM = (("doc", "<i8"), ("tag", "<u2"), ("start", "<u4"), ("windows", "u1"))


def width(layout) -> int:
    return sum(np.dtype(kind).itemsize for _, kind in layout)


def side_by_side(layout, columns: dict[str, np.ndarray], rows=slice(None)) -> np.ndarray:
    """The bytes of each entry's fields: a row for each entry. The planes of some of them are the bytes of the transpose."""
    return np.concatenate([np.ascontiguousarray(columns[name][rows].astype(kind)).view(np.uint8).reshape(-1, np.dtype(kind).itemsize) for name, kind in layout], axis=1)


def packed(layout, columns: dict[str, np.ndarray], rows=slice(None)) -> bytes:
    return side_by_side(layout, columns, rows).T.tobytes()


def unpacked(layout, blobs: list[bytes]) -> dict[str, np.ndarray]:
    wide = width(layout)
    entries, at = np.empty((sum(map(len, blobs)) // wide, wide), np.uint8), 0
    for blob in blobs:
        n = len(blob) // wide
        entries[at : at + n] = np.frombuffer(blob, np.uint8).reshape(wide, n).T
        at += n
    ends = np.cumsum([np.dtype(kind).itemsize for _, kind in layout]).tolist()
    return {name: np.ascontiguousarray(entries[:, a:b]).view(kind).ravel() for (name, kind), a, b in zip(layout, [0, *ends], ends, strict=False)}


def tags(column: pa.Array) -> list[int]:
    return [zlib.crc32((t or "").encode()) & 0xFFFF for t in column.to_pylist()]


def doc_bin(doc: np.ndarray, bins: int) -> np.ndarray:
    return (mixed(doc.astype(np.int64).view(U) + U(3)) % U(bins)).astype(np.int64)


def dealt(layout, columns: dict[str, np.ndarray], box: np.ndarray) -> Iterator[tuple[int, bytes]]:
    order = np.argsort(box, kind="stable")
    entries = side_by_side(layout, columns, order)
    for b, start, stop in parts(box[order]):
        yield b, entries[start:stop].T.tobytes()


def parts(box: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(number, start, stop) of each run of equal numbers."""
    first = np.flatnonzero(np.concatenate([[True], box[1:] != box[:-1]])) if len(box) else np.zeros(0, np.int64)
    return zip(box[first].tolist(), first.tolist(), [*first[1:].tolist(), len(box)], strict=False)


def classes_of(columns: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by anchor, content and document; where classes begin in it; each row's least document of its class."""
    order = np.lexsort((columns["doc"], columns["content"], columns["anchor"]))
    a, c, d = (columns[k][order] for k in ("anchor", "content", "doc"))
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (c[1:] != c[:-1])]))
    return order, first, np.repeat(d[first], np.diff(np.concatenate([first, [len(d)]])))


BINNED = "bin long, kind int, data binary"


def binned(rows: Iterable[tuple[int, int, bytes]]) -> pa.RecordBatch:
    rows = list(rows)
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["bin", "kind", "data"])


def stretches(columns: dict[str, np.ndarray], rows: np.ndarray) -> dict[str, np.ndarray]:
    return {"doc": columns["doc"][rows], "tag": columns["tag"][rows], "start": columns["start"][rows], "length": columns["windows"][rows].astype(np.int64) + WINDOW - 1}


def runs(docs: DataFrame, bins: int, doc_bins: int) -> DataFrame:
    """Kind 0: runs by their anchors' bins. Kind 1, from bin ``bins`` on: stretches that an earlier document of the same task covers, by their documents' bins."""

    def flush(held: list[dict]) -> pa.RecordBatch:
        columns = {k: np.concatenate([h[k] for h in held]) for k in held[0]}
        order, _, least = classes_of(columns)
        late = columns["doc"][order] > least
        rest = order[~late]
        early = {k: v[rest] for k, v in columns.items()}
        out = [(b, 0, data) for b, data in dealt(RUN, early, (early["anchor"] >> U(32)).astype(np.int64) % bins)]
        covered = stretches(columns, order[late])
        return binned(out + [(bins + b, 1, data) for b, data in dealt(STRETCH, covered, doc_bin(covered["doc"], doc_bins))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in slices(batches):
            data, offsets = utf8(batch.column("text"))
            docs_here = batch.column("doc_id").fill_null(LAST).to_numpy()
            tags_here = np.array(tags(batch.column("text")), np.int64)
            for start, end, inner in segments(offsets):
                first, last, anchor, content = anchored(data[start:end], inner)
                if len(first):
                    at = np.searchsorted(offsets, first + start, "right") - 1
                    held.append({"anchor": anchor, "content": content, "doc": docs_here[at], "tag": tags_here[at], "start": first + start - offsets[at], "windows": last - first + 1})
                    size += len(first)
                if size >= HOLD:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    return texts(docs).mapInArrow(run, BINNED)


def compared(bins: int, doc_bins: int):
    """For a bin of runs: stretches that equal runs cover (kind 1), and requests for the bytes of runs of anchors with several classes (kind 2), by documents' bins; a row of kind 3 if any of these is hot."""

    def run(table: pa.Table) -> pa.Table:
        box = table.column("bin")[0].as_py()
        blobs = table.column("data").to_pylist()
        if box >= bins:
            return pa.Table.from_batches([binned([(box - bins, 1, b"".join(dealt_one(STRETCH, blobs)))])])
        columns = unpacked(RUN, blobs)
        order, first, least = classes_of(columns)
        doc, anchor = columns["doc"][order], columns["anchor"][order]
        covered = stretches(columns, order[doc > least])
        out = [(b, 1, data) for b, data in dealt(STRETCH, covered, doc_bin(covered["doc"], doc_bins))]
        begins = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        sizes = np.diff(np.concatenate([begins, [len(anchor)]]))
        is_first = np.zeros(len(anchor), np.int64)
        is_first[first] = 1
        number = np.repeat(np.add.reduceat(is_first, begins), sizes)
        spread = np.repeat(np.maximum.reduceat(least, begins) > np.minimum.reduceat(least, begins), sizes)
        asked = np.flatnonzero((doc == least) & spread)
        if len(asked):
            rows = order[asked]
            request = {k: columns[k][rows] for k in ("doc", "tag", "start", "windows")} | {"key": mixed(anchor[asked].astype(U) | U(box << 32)), "hot": number[asked] > MANY_CLASSES}
            out += [(b, 2, data) for b, data in dealt(REQUEST, request, doc_bin(request["doc"], doc_bins))]
            if request["hot"].any():
                out.append((0, 3, b""))
        return pa.Table.from_batches([binned(out)])

    return run


def dealt_one(layout, blobs: list[bytes]) -> list[bytes]:
    return [packed(layout, unpacked(layout, blobs))]


def by_bin(docs: DataFrame, doc_bins: int) -> DataFrame:
    """(bin, doc_id, text), the bin a hash of doc_id as ``doc_bin`` has it, the text compressed for the shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            box = doc_bin(batch.column("doc_id").fill_null(LAST).to_numpy(), doc_bins)
            small = [machine.compress((t or "").encode()) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(box), batch.column("doc_id"), pa.array(small, pa.binary())], names=["bin", "doc_id", "text"])

    return texts(docs).mapInArrow(run, "bin long, doc_id long, text binary")


def matched(table: pa.Table, wanted: dict[str, np.ndarray]) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """Each document of a bin: its row, its bytes and the places of its entries in ``wanted``."""
    order = np.lexsort((wanted["start"], wanted["tag"], wanted["doc"]))
    doc, tag = wanted["doc"][order], wanted["tag"][order].astype(np.int64)
    ids, machine = table.column("doc_id").to_pylist(), zstandard.ZstdDecompressor()
    for row, (i, text) in enumerate(zip(ids, table.column("text").to_pylist(), strict=True)):
        data, i = machine.decompress(text), LAST if i is None else i
        a, b = np.searchsorted(doc, [i, i], "left")[0], np.searchsorted(doc, i, "right")
        yield row, data, order[a:b][tag[a:b] == zlib.crc32(data) & 0xFFFF]


def windows_of(windows: np.ndarray, pieces: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of runs whose bytes stand end to end: the bytes, where each run's begin, and the run and the place in it of each window."""
    windows = windows.astype(np.int64)
    total = np.cumsum(windows)
    item = np.repeat(np.arange(len(windows)), windows)
    return np.frombuffer(pieces, np.uint8), total - windows + np.arange(len(windows)) * (WINDOW - 1), item, np.arange(len(item)) - (total - windows)[item]


def fetched(bins: int, doc_bins: int):
    """The bytes that requests ask for, packed by the bin of their key; those of hot anchors, to be split, as kind 3."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        asked = unpacked(REQUEST, right.column("data").to_pylist())
        pieces: list[bytes] = []
        found = [np.zeros(0, np.int64)]
        for _, data, places in matched(left, asked):
            if len(places):
                starts = asked["start"][places].astype(np.int64)
                pieces += [data[a:b] for a, b in zip(starts.tolist(), (starts + asked["windows"][places] + WINDOW - 1).tolist(), strict=True)]
                found.append(places)
        rows = np.concatenate(found)
        box = (asked["key"][rows] % U(bins)).astype(np.int64)
        hot = asked["hot"][rows] > 0
        order = np.flatnonzero(~hot)[np.argsort(box[~hot], kind="stable")]
        entries = side_by_side(ITEM, asked, rows[order])
        out = [(b, 0, (stop - start).to_bytes(4, "little") + entries[start:stop].T.tobytes() + b"".join([pieces[k] for k in order[start:stop]])) for b, start, stop in parts(box[order])]
        whole = np.flatnonzero(hot)
        for at in range(0, len(whole), HOT_AT_ONCE):
            part = whole[at : at + HOT_AT_ONCE]
            out.append((0, 3, len(part).to_bytes(4, "little") + packed(ITEM, asked, rows[part]) + b"".join([pieces[k] for k in part])))
        return pa.Table.from_batches([binned(out)])

    return run


def opened(blobs: list[bytes]) -> tuple[dict[str, np.ndarray], bytes]:
    """Items, and their bytes end to end."""
    wide = width(ITEM)
    heads, bodies = [], []
    for blob in blobs:
        n = int.from_bytes(blob[:4], "little")
        heads.append(blob[4 : 4 + n * wide])
        bodies.append(blob[4 + n * wide :])
    return unpacked(ITEM, heads), b"".join(bodies)


def single(items: DataFrame, bins: int, doc_bins: int) -> DataFrame:
    """Kind 3 as kinds 0 and 1, the other rows as they are. Windows are many times the bytes of their runs, so they are made of few runs at a time and yielded at once."""

    def windows(blob: bytes) -> Iterator[tuple[int, int, bytes]]:
        asked, pieces = opened([blob])
        data, begins, item, inner = windows_of(asked["windows"], pieces)
        at = begins[item] + inner
        columns = {"doc": asked["doc"][item], "tag": asked["tag"][item], "start": asked["start"][item] + inner, "windows": np.ones(len(at), np.int64)}
        key = hashes(data)[at]
        order = np.lexsort((columns["doc"], key))
        k, d = key[order], columns["doc"][order]
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        late = d > np.repeat(d[first], np.diff(np.concatenate([first, [len(k)]])))
        covered = stretches(columns, order[late])
        yield from ((bins + b, 1, part) for b, part in dealt(STRETCH, covered, doc_bin(covered["doc"], doc_bins)))
        rest = order[~late]
        box = (key[rest] % U(bins)).astype(np.int64)
        turn = np.argsort(box, kind="stable")
        rest, box = rest[turn], box[turn]
        entries = side_by_side(ITEM, columns, rest)
        content = np.lib.stride_tricks.sliding_window_view(data, WINDOW)[at[rest]]
        yield from ((b, 0, (stop - start).to_bytes(4, "little") + entries[start:stop].T.tobytes() + content[start:stop].tobytes()) for b, start, stop in parts(box))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hot = batch.column("kind").to_numpy() == 3
            yield batch.filter(pa.array(~hot)) if hot.any() else batch
            for row in np.flatnonzero(hot).tolist():
                yield binned(windows(batch.column("data")[row].as_py()))

    return items.mapInArrow(run, BINNED)


def ordered(bins: int, doc_bins: int):
    """Sorts the suffixes of a bin's windows; stretches whose windows also start in an earlier document, by documents' bins."""

    def run(table: pa.Table) -> pa.Table:
        box = table.column("bin")[0].as_py()
        blobs = table.column("data").to_pylist()
        if box >= bins:
            return pa.Table.from_batches([binned([(box - bins, 1, b) for b in dealt_one(STRETCH, blobs)])])
        items, pieces = opened(blobs)
        data, begins, item, inner = windows_of(items["windows"], pieces)
        at = begins[item] + inner
        several = np.flatnonzero(repeated(hashes(data)[at]))
        order, classes = deep_shallow(data, at[several])
        order = several[order]
        doc = items["doc"][item[order]]
        first = np.flatnonzero(np.concatenate([[True], classes[1:] != classes[:-1]])) if len(order) else order
        least = np.repeat(np.minimum.reduceat(doc, first), np.diff(np.concatenate([first, [len(doc)]]))) if len(order) else doc
        covered = np.zeros(len(at), bool)
        covered[order[doc > least]] = True
        change = covered.copy()
        change[1:] &= ~(covered[:-1] & (item[1:] == item[:-1]))
        stop = covered.copy()
        stop[:-1] &= ~(covered[1:] & (item[1:] == item[:-1]))
        a, b = np.flatnonzero(change), np.flatnonzero(stop)
        k = item[a]
        found = {"doc": items["doc"][k], "tag": items["tag"][k], "start": items["start"][k].astype(np.int64) + inner[a], "length": b - a + WINDOW}
        return pa.Table.from_batches([binned([(d, 1, blob) for d, blob in dealt(STRETCH, found, doc_bin(found["doc"], doc_bins))])])

    return run


def merged(start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the bytes that any stretch covers. ``start`` ascends."""
    if not len(start):
        return start, start
    start = start.astype(np.int64)
    end = np.maximum.accumulate(start + length)
    fresh = np.concatenate([[True], start[1:] > end[:-1]])
    return start[fresh], end[np.concatenate([np.flatnonzero(fresh)[1:] - 1, [len(start) - 1]])]


def removed_spans(docs: DataFrame) -> DataFrame:
    """(bin, kind, data): the covered stretches of all documents, packed by documents' bins; the number of bins is in attribute ``doc_bins``."""
    rows = max(1, docs.count())
    size = docs.select(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    # what one bin sends to another grows with both numbers of bins, so bins of documents are small only while they are few
    doc_bins = max(1, min(MANY_BINS, math.ceil(rows / DOCS_A_BIN)), math.ceil(size / TEXT_A_BIN), math.ceil(rows / MOST_DOCS_A_BIN))
    bins = max(1, math.ceil(size * 0.065 / RUNS_A_BIN))
    first = durable(runs(docs, bins, doc_bins).groupBy("bin").applyInArrow(tidy(compared(bins, doc_bins)), BINNED))
    release(docs.sparkSession)
    asked = first.where("kind = 2").groupBy("bin")
    sort_bins = 2 * bins
    items = by_bin(docs, doc_bins).groupBy("bin").cogroup(asked).applyInArrow(tidy(fetched(sort_bins, doc_bins)), BINNED)
    if not first.where("kind = 3").isEmpty():
        items = single(items, sort_bins, doc_bins)
    second = durable(items.groupBy("bin").applyInArrow(tidy(ordered(sort_bins, doc_bins)), BINNED))
    del items, asked
    release(docs.sparkSession)
    return first.where("kind = 1").union(second), doc_bins


def deduplicated(docs: DataFrame) -> DataFrame:
    """(doc_id, text, n_bytes, n_removed, n_spans, kept binary, spans array<struct<start, end>>): every document with what is left of it."""
    spans, doc_bins = removed_spans(docs)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = unpacked(STRETCH, right.column("data").to_pylist())
        size, removed, kept, runs_of = [], [], [], []
        for _, data, places in matched(left, found):
            a, b = merged(found["start"][places], found["length"][places])
            edges = [0, *np.stack([a, b], 1).ravel().tolist(), len(data)]
            kept.append(b"".join(data[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)))
            size.append(len(data))
            removed.append(len(data) - len(kept[-1]))
            runs_of.append([{"start": x, "end": y} for x, y in zip(a.tolist(), b.tolist(), strict=True)])
        return pa.table({"doc_id": left.column("doc_id"), "n_bytes": pa.array(size, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.binary()), "spans": pa.array(runs_of, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))})

    return by_bin(docs, doc_bins).groupBy("bin").cogroup(spans.groupBy("bin")).applyInArrow(run, "doc_id long, n_bytes long, n_removed long, kept binary, spans array<struct<start long, end long>>")


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of ``deduplicated``."""
    return deduplicated(docs).select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
