"""Near-duplicate lines by a deletion-neighbourhood join within one edit.

A line is dropped if an equal line, or one within one edit (a code point put in, taken out or replaced), stands earlier: in a document of smaller doc_id, or
higher up in the same document. Lines count without the white space around them. Lines of fewer than ``min_chars`` code points stay, or with ``short_lines`` are
dropped if an equal line stands earlier, without the edit; blank lines stay.

Two lines within one edit agree outside one of SEGMENTS equal segments. So every distinct line first emits, for each segment, a key of what lies outside it; only lines
that share a key with a different line go on, and only in the segments concerned. There they emit, hashed, every variant with one code point
deleted, and themselves. Lines that share a variant with the deletion at one place differ by a replacement; a line that equals another's variant differs by an
insertion. In a group of equal variants each line's witness is the earliest line of the other kind, so groups need no pairs, however large.
Each witness is verified by edit distance on the lines' text.

Keys are made for the lines of whole texts, packed and dealt into bins whose number grows with the data. Equal lines of one task send their keys once, and
counts and minima are combined before they are shuffled. The places of lines that go are joined with them by the line's hash, a join of two shuffles in which adaptive execution splits
a hot line. Null texts stay null and empty ones empty. Among repeated rows of one doc_id, equal lines at
one place are one line. Null doc_ids come last. An empty table gives an empty result. Further columns are returned as they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.llm.common import byte_codes, durable, filtered, free_names, mixed, release, slices, texts, tidy, utf8

U = np.uint64
MIN_CHARS = 20
SEGMENTS = 8
#: Bytes of text whose lines' keys make a bin.
BYTES_A_BIN = 6_000_000
#: Keys that a task gathers before it deals them.
HOLD = 500_000
LAST = np.iinfo(np.int64).max
BASE = 0xA24BAED4963EE407
CODES = byte_codes(23)
BLANK = np.isin(np.arange(256), [0x20, 0x09, 0x0B, 0x0C, 0x0D])
_powers = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) <= n:
        size = 1 << n.bit_length()
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            made = np.full(size + 1, base, U)
            made[0] = 1
            _powers[k] = np.multiply.accumulate(made)
    return _powers[0], _powers[1]


class Lines:
    """The lines of some texts: row of the text, number in it, bytes [start, end) without surrounding blanks, code points, hash."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(data)
        up, self.down = powers(n)
        self.total = np.zeros(n + 1, U)
        np.cumsum(CODES[data] * up[:n], out=self.total[1:])
        breaks = np.flatnonzero(data == 0x0A)
        starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
        ends = np.sort(np.concatenate([offsets[1:], breaks]), kind="stable")
        texts_of = np.searchsorted(offsets, starts, "right") - 1
        count = np.diff(np.concatenate([[0], np.searchsorted(breaks, offsets[1:])])) + 1  # lines of each text
        self.row = np.repeat(np.arange(len(offsets) - 1), count)
        if len(self.row) != len(starts) or not (texts_of >= self.row).all():
            raise AssertionError("lines and texts don't agree")
        self.number = np.arange(len(starts)) - np.repeat(np.cumsum(count) - count, count)
        full = np.flatnonzero(~BLANK[data])
        a, b = np.searchsorted(full, starts), np.searchsorted(full, ends)
        some = b > a
        self.start, self.end = starts.copy(), starts.copy()
        self.start[some], self.end[some] = full[a[some]], full[b[some] - 1] + 1
        self.points = np.flatnonzero((data & 0xC0) != 0x80)
        self.first = np.searchsorted(self.points, self.start)
        self.size = np.searchsorted(self.points, self.end) - self.first
        self.hash = mixed(self.stretch(self.start, self.end) + (self.end - self.start).astype(U))

    def stretch(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash of the bytes [start, end), the same wherever they stand."""
        return (self.total[end] - self.total[start]) * self.down[start]

    def byte(self, line: np.ndarray, point: np.ndarray) -> np.ndarray:
        """Where code point ``point`` of each line begins; its end for the one past the last."""
        at = self.first[line] + point
        return np.where(point >= self.size[line], self.end[line], self.points[np.minimum(at, len(self.points) - 1)])

    def outside(self, line: np.ndarray) -> np.ndarray:
        """Keys of shape (lines, 2 * SEGMENTS): what lies outside each segment, for the line as the shorter and as the longer of a pair. A key modulo SEGMENTS is its segment."""
        keys = []
        for longer in (0, 1):
            size = (self.size[line] - longer)[:, None]
            cut = size * np.arange(SEGMENTS + 1) // SEGMENTS
            before = self.byte(line[:, None], cut[:, :-1])
            after = self.byte(line[:, None], cut[:, 1:] + longer)
            head = self.stretch(np.broadcast_to(self.start[line][:, None], before.shape), before)
            tail = self.stretch(after, np.broadcast_to(self.end[line][:, None], after.shape))
            keys.append(mixed(mixed(head + size.astype(U)) + tail) // U(SEGMENTS) * U(SEGMENTS) + np.arange(SEGMENTS, dtype=U))
        return np.concatenate(keys, 1)


def outside_bins(docs: DataFrame, bins: int, min_chars: int) -> DataFrame:
    """(bin, keys, lines): the keys of all distinct lines with the lines' hashes, packed."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def dealt():
            keys, names = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            keys, names = distinct(keys, names)
            box = ((keys >> U(32)) % U(bins)).astype(np.int64)
            order = np.argsort(box, kind="stable")
            box, low, names = box[order], keys[order].astype(np.uint32), names[order]
            at = [*np.flatnonzero(np.concatenate([[True], box[1:] != box[:-1]])), len(box)]
            return pa.RecordBatch.from_arrays([pa.array(box[at[:-1]]), pa.array([low[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary()), pa.array([names[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())], names=["bin", "keys", "lines"])

        size = 0
        for batch in slices(batches):
            lines = Lines(*utf8(batch.column("text")))
            chosen = np.flatnonzero(lines.size >= min_chars)
            _, once = np.unique(lines.hash[chosen], return_index=True)
            chosen = chosen[once]
            if len(chosen):
                keys = lines.outside(chosen)
                held.append((keys.ravel(), np.repeat(lines.hash[chosen], 2 * SEGMENTS)))
                size += keys.size
            if size > HOLD:
                yield dealt()
                held, size = [], 0
        if held:
            yield dealt()

    return texts(docs).mapInArrow(run, "bin long, keys binary, lines binary")


def distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    keep = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    return a[keep], b[keep]


def shared(table: pa.Table) -> pa.Table:
    """(line, segments): the lines of a bin that share a key with another line, and the segments concerned as bits."""
    keys = np.frombuffer(b"".join(table.column("keys").to_pylist()), np.uint32)
    lines = np.frombuffer(b"".join(table.column("lines").to_pylist()), U)
    keys, lines = distinct(keys, lines)
    same = np.concatenate([[False], keys[1:] == keys[:-1], [False]])
    met = same[1:] | same[:-1]
    order = np.argsort(lines[met], kind="stable")
    line, bit = lines[met][order].view(np.int64), np.int32(1) << (keys[met][order] % SEGMENTS).astype(np.int32)
    first = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]])) if len(line) else np.zeros(0, np.int64)
    return pa.table({"line": line[first], "segments": np.bitwise_or.reduceat(bit, first) if len(first) else bit})


def chosen_lines(docs: DataFrame, wanted: DataFrame, min_chars: int) -> DataFrame:
    """(line, doc, number, text, segments): the first place and the text of each line in ``wanted`` (id, segments)."""
    keep = filtered(wanted)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, offsets = utf8(batch.column("text"))
            lines = Lines(data, offsets)
            chosen = np.flatnonzero((lines.size >= min_chars) & keep(lines.hash.view(np.int64)))
            docs_here = batch.column("doc_id").fill_null(LAST).to_numpy()
            whole = data.tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array(lines.hash[chosen].view(np.int64)), pa.array(docs_here[lines.row[chosen]]), pa.array(lines.number[chosen]), pa.array([whole[a:b].decode() for a, b in zip(lines.start[chosen].tolist(), lines.end[chosen].tolist(), strict=True)], pa.string())],
                names=["line", "doc", "number", "text"],
            )

    found = texts(docs).mapInArrow(run, "line long, doc long, number long, text string")
    first = found.groupBy("line").agg(F.min(F.struct("doc", "number", "text")).alias("f"))
    return first.join(wanted.select(F.col("id").alias("line"), "segments"), "line").select("line", "f.doc", "f.number", "f.text", "segments")


def variants(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, variant, place, line, doc, number) for the variants of each line with one code point of the segments concerned deleted. Kind 0: for replacements, with the place; 1: for
    insertions, of the longer line; 2: for insertions, the shorter line itself."""
    for batch in slices(batches, 1 << 18):
        made = Lines(*utf8(batch.column("text")))
        line = np.repeat(np.arange(batch.num_rows), made.size)
        place = np.arange(len(line)) - np.repeat(np.cumsum(made.size) - made.size, made.size)
        segments, n = batch.column("segments").to_numpy()[line], made.size[line]
        inside = np.zeros(len(line), bool)
        for k in range(SEGMENTS):
            here = (place >= (n - 1) * k // SEGMENTS) & (place < np.maximum(n * (k + 1) // SEGMENTS, (n - 1) * (k + 1) // SEGMENTS + 1))
            inside |= here & (segments >> k & 1 == 1)
        line, place = line[inside], place[inside]
        start, end = made.start[line], made.end[line]
        a, b = made.byte(line, place), made.byte(line, place + 1)
        hashes = mixed(made.stretch(start, a) + (made.total[end] - made.total[b]) * made.down[start + b - a] + (end - start - (b - a)).astype(U))
        once_hash, once_line = distinct(hashes, line)
        kind = np.repeat([2, 0, 1], [batch.num_rows, len(line), len(once_line)])
        of = np.concatenate([np.arange(batch.num_rows), line, once_line])
        variant = np.concatenate([made.hash, hashes, once_hash]).view(np.int64)
        place = np.concatenate([np.zeros(batch.num_rows, np.int64), place, np.zeros(len(once_line), np.int64)])
        yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(variant), pa.array(place), *[batch.column(c).take(pa.array(of)) for c in ("line", "doc", "number")]], names=["kind", "variant", "place", "line", "doc", "number"])


def near_lines(docs: DataFrame, size: int, min_chars: int) -> DataFrame:
    """(line): distinct lines that an earlier line within one edit makes superfluous."""
    bins = max(1, math.ceil(size / BYTES_A_BIN))
    wanted = durable(outside_bins(docs, bins, min_chars).groupBy("bin").applyInArrow(tidy(shared), "line long, segments int").groupBy(F.col("line").alias("id")).agg(F.bit_or("segments").alias("segments")))
    release(docs.sparkSession)
    known = durable(chosen_lines(docs, wanted, min_chars))
    rows_ = known.mapInArrow(variants, "kind int, variant long, place long, line long, doc long, number long")
    place = F.struct("doc", "number", "line")
    group = F.when(F.col("kind") == 0, F.col("place")).otherwise(-1)
    rows_ = rows_.select((F.col("kind") == 0).alias("replaced"), "variant", group.alias("place"), (F.col("kind") == 2).alias("whole"), place.alias("at"))
    firsts = rows_.groupBy("replaced", "variant", "place").agg(F.min(F.when(F.col("whole"), F.col("at"))).alias("whole_first"), F.min(F.when(~F.col("whole"), F.col("at"))).alias("cut_first"), F.count(F.lit(1)).alias("n")).where("n > 1 and (replaced or (whole_first is not null and cut_first is not null))")
    firsts = firsts.select(F.col("replaced").alias("r"), F.col("variant").alias("v"), F.col("place").alias("p"), "whole_first", "cut_first")
    met = rows_.join(firsts, (F.col("replaced") == F.col("r")) & (F.col("variant") == F.col("v")) & (F.col("place") == F.col("p")))
    witness = F.when(F.col("replaced") | F.col("whole"), F.col("cut_first")).otherwise(F.col("whole_first"))
    pairs = met.select(F.col("at.line").alias("line"), witness.alias("w"), "at").where(F.col("w") < F.col("at")).select("line", F.col("w.line").alias("other")).distinct()
    of = lambda name, text: known.select(F.col("line").alias(name), F.col("text").alias(text))
    checked = pairs.join(of("line", "a"), "line").join(of("other", "b"), "other").where(F.levenshtein("a", "b", 1) >= 0)
    return durable(checked.select("line").distinct())


def removed_lines(docs: DataFrame, max_edits: int = 1, min_chars: int = MIN_CHARS, short_lines: bool = False) -> DataFrame:
    """(doc, gone): for each document that loses lines, their numbers and hashes, packed one after the other."""
    if max_edits not in (0, 1):
        raise ValueError("max_edits is 0 or 1")
    if min_chars < 2:
        raise ValueError("min_chars is 2 or more")
    least = 1 if short_lines else min_chars

    def places(keep) -> DataFrame:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                lines = Lines(*utf8(batch.column("text")))
                chosen = np.flatnonzero(lines.size >= least)
                chosen = chosen[keep(lines.hash[chosen].view(np.int64))] if keep else chosen
                docs_here = batch.column("doc_id").fill_null(LAST).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(docs_here[lines.row[chosen]]), pa.array(lines.number[chosen]), pa.array(lines.hash[chosen].view(np.int64))], names=["doc", "number", "line"])

        return texts(docs).mapInArrow(run, "doc long, number long, line long")

    first = places(None).groupBy("line").agg(F.min(F.struct("doc", "number")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("line", "first", F.lit(False).alias("near"))
    if max_edits:
        size = texts(docs).agg(F.sum(F.octet_length("text"))).first()[0] or 0
        near = near_lines(docs, size, min_chars)
        first = first.join(near.select("line"), "line", "left_anti").union(near.select("line", F.lit(None).cast("struct<doc:bigint,number:bigint>"), F.lit(True)))
    first = durable(first)
    every = places(filtered(first.select(F.col("line").alias("id"))))
    gone = every.join(first, "line").where(F.col("near") | (F.struct("doc", "number") != F.col("first")))
    return durable(gone.groupBy("doc").agg(F.collect_set(F.struct("number", "line")).alias("gone")))


def deduplicated(docs: DataFrame, max_edits: int = 1, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text", short_lines: bool = False) -> DataFrame:
    """All rows and columns of ``docs``, the dropped lines cut out of ``text_col``, then columns _n_lines and _n_removed; where ``docs`` has such a name, underscores are put before the new one."""
    doc_name, gone_name, lines_name, removed_name = free_names(["_doc", "_gone", "_n_lines", "_n_removed"], docs.columns)
    plain = texts(docs, id_col, text_col)
    gone = removed_lines(plain, max_edits, min_chars, short_lines)
    touched = filtered(gone.select(F.col("doc").alias("id")))
    packed = zstandard_texts(docs, id_col, text_col, touched)
    joined = packed.join(gone.select(F.col("doc").alias(doc_name), F.col("gone").alias(gone_name)), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)) == F.col(doc_name), "left").drop(doc_name)
    at, names = docs.columns.index(text_col), docs.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = zstandard.ZstdDecompressor()
        for batch in batches:
            kept, counts, removed = [], [], []
            for data, losses in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                if data is None:
                    kept.append(None)
                    counts.append(0)
                    removed.append(0)
                    continue
                data = machine.decompress(data)
                parts = data.split(b"\n")
                counts.append(len(parts))
                drop = set()
                if losses:
                    lines = Lines(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
                    hashes = lines.hash.view(np.int64)
                    drop = {x["number"] for x in losses if x["number"] < len(parts) and hashes[x["number"]] == x["line"]}
                removed.append(len(drop))
                kept.append(b"\n".join(p for k, p in enumerate(parts) if k not in drop).decode())
            columns = [pa.array(kept, pa.string()) if k == at else batch.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(removed, pa.int64())], names=[*names, lines_name, removed_name])

    def untouched(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(~touched(ids(batch.column(id_col)))))
            counts = [0 if t is None else t.count("\n") + 1 for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64()), pa.array(np.zeros(len(counts), np.int64))], names=[*names, lines_name, removed_name])

    fields = [f"`{f.name}` {'string' if k == at else f.dataType.simpleString()}" for k, f in enumerate(docs.schema.fields)]
    schema = ", ".join([*fields, f"`{lines_name}` long, `{removed_name}` long"])
    return joined.mapInArrow(run, schema).union(docs.mapInArrow(untouched, schema))


def ids(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(LAST).to_numpy()


def zstandard_texts(docs: DataFrame, id_col: str, text_col: str, touched) -> DataFrame:
    """The rows of ``docs`` that may be touched, ``text_col`` compressed."""
    at = docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            batch = batch.filter(pa.array(touched(ids(batch.column(id_col)))))
            small = pa.array([None if t is None else machine.compress(t.encode()) for t in batch.column(at).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([small if k == at else c for k, c in enumerate(batch.columns)], names=batch.schema.names)

    return docs.mapInArrow(run, ", ".join(f"`{f.name}` {'binary' if k == at else f.dataType.simpleString()}" for k, f in enumerate(docs.schema.fields)))
