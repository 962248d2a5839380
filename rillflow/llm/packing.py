"""Hierarchical packing of documents into windows of several context sizes.

Every task encodes its documents and packs them in groups of about ``GROUP_TOKENS`` ids, so nothing is shuffled and no group grows
with the data. Within a group:

1. a document longer than the longest window fills whole windows; the rest of it, and every shorter document, is routed to the
   smallest tier (context size) that holds it;
2. from the longest tier down, each routed piece opens a window of its tier;
3. the gap of a window is filled from the shorter tiers, largest piece that fits first; where none fits, a piece is cut to the gap
   and what is left of it is routed anew;
4. the last window of a group may stay short: it is split into windows of the powers of two that make up its length. So every
   window is full: each has exactly as many ids as its context size, and none is padded;
5. windows go to step groups, longest first, each to the group with the fewest ids so far.

Nulls count as empty texts; an empty text has its end id alone. Equal documents are packed one by one. Further columns play no part. An
empty table gives an empty result. A sequence id joins the task's number and the window's number in it.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heapreplace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from rillflow.llm.bpe import printable_bytes, refuse_model
from rillflow.llm.common import slices, texts

TIERS = (256, 512, 1024, 2048, 4096)
GROUP_TOKENS = 1 << 21
STEP_TOKENS = 1 << 17
REMEMBERED = 400_000
#: Python counts these as white space, the tokenizer doesn't.
SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")
MARKS = ".,;:!?"
#: Fixed by the tokenizer's file: what its words are.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Letters that may change under the tokenizer's normalisation.
BEYOND = re.compile("[^a-zß-öø-ɏ]")

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


class WordMerger:
    """Merges many plain words at once: in each round, every word's pair of least rank, on flat arrays."""

    EMPTY, NEVER, SLOTS = np.int64(-1), np.int32(1 << 30), 20

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        refuse_model(whole, ("</w>",))
        if [x.get("type") for x in (whole["normalizer"] or {}).get("normalizers", [])] != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("tokenizer file: its normalizer is not NFC, white space to blanks, lower case")
        if [(x.get("type"), x.get("behavior"), x.get("invert"), (x.get("pattern") or {}).get("Regex"), x.get("add_prefix_space")) for x in (whole["pre_tokenizer"] or {}).get("pretokenizers", [])] != [("Split", "Removed", True, WORDS, None), ("ByteLevel", None, None, None, False)]:
            raise ValueError("tokenizer file: its words are not those that chunks are cut for")
        spec = whole["model"]
        ids, suffix = spec["vocab"], spec["end_of_word_suffix"] or ""
        letters = {b: c for c, b in printable_bytes().items()}
        self.inner = np.array([ids[letters[b]] for b in range(256)], np.int32)
        self.final = np.array([ids[letters[b] + suffix] for b in range(256)], np.int32)
        self.keys = np.full(1 << self.SLOTS, self.EMPTY)
        self.ranks, self.made = np.full(1 << self.SLOTS, self.NEVER), np.zeros(1 << self.SLOTS, np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["merges"]]
        keys = np.array([ids[a] << 20 | ids[b] for a, b in pairs], np.int64)
        made = np.array([ids[a + b] for a, b in pairs], np.int32)
        at, rest = self.slot(keys), np.arange(len(keys))
        while len(rest):
            free = self.keys[at[rest]] == self.EMPTY
            _, one = np.unique(np.where(free, at[rest], -1 - rest), return_index=True)
            placed = rest[one[free[one]]]
            self.keys[at[placed]], self.ranks[at[placed]], self.made[at[placed]] = keys[placed], placed, made[placed]
            rest = np.setdiff1d(rest, placed)
            at[rest] = (at[rest] + 1) & ((1 << self.SLOTS) - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.SLOTS)).astype(np.int64)

    def places(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, or an empty one."""
        at = self.slot(keys)
        rest = np.flatnonzero((self.keys[at] != keys) & (self.keys[at] != self.EMPTY))
        while len(rest):
            at[rest] = (at[rest] + 1) & ((1 << self.SLOTS) - 1)
            here = self.keys[at[rest]]
            rest = rest[(here != keys[rest]) & (here != self.EMPTY)]
        return at

    def encode(self, words: list[str]) -> list[bytes]:
        """The ids of each word as little-endian 32-bit numbers. Words aren't empty."""
        if not words:
            return []
        coded = [w.encode() for w in words]
        data = np.frombuffer(b"".join(coded), np.uint8)
        ends = np.cumsum([len(c) for c in coded])
        tokens = self.inner[data]
        tokens[ends - 1] = self.final[data[ends - 1]]
        out: list[bytes] = [b""] * len(words)
        names, first = np.arange(len(words)), np.concatenate([[0], ends[:-1]])
        while len(names):
            stop = np.concatenate([first[1:], [len(tokens)]])
            keys = tokens.astype(np.int64) << 20
            keys[:-1] |= tokens[1:]
            at = self.places(keys)
            ranks = np.where(self.keys[at] == keys, self.ranks[at], self.NEVER)
            ranks[stop - 1] = self.NEVER
            least = np.minimum.reduceat(ranks, first)
            done = least == self.NEVER
            if done.any():
                flat = tokens.astype("<u4").tobytes()
                for k, a, b in zip(names[done].tolist(), first[done].tolist(), stop[done].tolist(), strict=True):
                    out[k] = flat[4 * a : 4 * b]
            sizes = stop - first
            chosen = (ranks == np.repeat(least, sizes)) & (ranks != self.NEVER)
            overlap = np.flatnonzero(chosen[1:] & chosen[:-1])
            for k in overlap.tolist():  # of three equal tokens the left two are merged
                if chosen[k]:
                    chosen[k + 1] = False
            tokens[chosen] = self.made[at[chosen]]
            keep = np.repeat(~done, sizes)
            keep[1:] &= ~chosen[:-1]
            left = np.add.reduceat(keep, first, dtype=np.int64)[~done]
            tokens, names = tokens[keep], names[~done]
            first = np.cumsum(left) - left
        return out


class ChunkEncoder:
    """Ids of whole texts from a tokenizer whose words never span white space.

    The ids of frequent chunks are remembered. New chunks that are plain Latin letters, perhaps with end marks, are merged here, many at once; all others,
    and texts with special tokens, go through the library.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        self.merger = WordMerger(path)
        self.special = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {"": b""}

    def library(self, chunks: list[str]) -> list[bytes]:
        out = []
        for at in range(0, len(chunks), 20_000):
            out += [np.array(x.ids, "<u4").tobytes() for x in self.model.encode_batch(chunks[at : at + 20_000], add_special_tokens=False)]
        return out

    def encode_chunks(self, chunks: list[str]) -> dict[str, bytes]:
        plain, other, cores = [], [], {}
        for chunk in chunks:
            core = chunk.rstrip(MARKS)
            low = core.lower()
            if low.isalpha() and (low.isascii() or len(low) == len(core) and not BEYOND.search(low)):
                plain.append((chunk, low, len(core)))
                cores[low] = b""
            else:
                other.append(chunk)
        cores = dict(zip(cores, self.merger.encode([*cores]), strict=True))
        for mark in {chunk[n:] for chunk, _, n in plain} - self.marks.keys():
            self.marks[mark] = self.library([mark])[0]
        marks = self.marks
        out = {chunk: cores[low] + marks[chunk[n:]] for chunk, low, n in plain}
        out.update(zip(other, self.library(other), strict=True))
        if len(marks) > 10_000:
            self.marks = {"": b""}
        return out

    def encode_batch(self, batch: list[str]) -> list[np.ndarray]:
        known, found, gaps, whole = self.known, [], [], []
        for text in batch:
            if any(x in text for x in self.special) or any(x in text for x in SEPARATORS):
                found.append(self.library([text]))
                gaps.append([])
                continue
            words = text.split()
            ids = [*map(known.get, words)]
            found.append(ids)
            gaps.append([(k, words[k]) for k, x in enumerate(ids) if x is None] if None in ids else [])
            whole += [w for _, w in gaps[-1]]
        recent = self.encode_chunks([*dict.fromkeys(whole)])
        for ids, missing in zip(found, gaps, strict=True):
            for k, word in missing:
                ids[k] = recent[word]
        if len(known) < REMEMBERED:
            known.update((w, x) for w, x in recent.items() if len(w) < 64)
        return [np.frombuffer(b"".join(ids), "<u4") for ids in found]


@lru_cache(maxsize=2)
def encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


def pack(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[list[tuple[int, int, int]]]:
    """Windows of pieces (document, start, length) that hold every id of the documents once; each window's ids are a power of two.

    ``tiers``: ascending powers of two.
    """
    longest, windows = tiers[-1], []
    pool: list[tuple[int, int, int]] = []  # (length, document, start), sorted: all that isn't in a window yet
    for doc, n in enumerate(lengths):
        whole = n - n % longest
        windows.extend([(doc, at, longest)] for at in range(0, whole, longest))
        if n > whole:
            pool.append((n - whole, doc, whole))
    pool.sort()
    for below, tier in zip((*reversed(tiers[:-1]), 0), reversed(tiers), strict=True):
        while pool and pool[-1][0] > below:
            n, doc, start = pool.pop()
            window, gap = [(doc, start, n)], tier - n
            while gap and pool:
                at = bisect_right(pool, (gap, 1 << 62, 0)) - 1
                if at >= 0:
                    n, doc, start = pool.pop(at)
                    window.append((doc, start, n))
                    gap -= n
                else:  # all are longer than the gap: cut the shortest
                    n, doc, start = pool.pop(0)
                    window.append((doc, start, gap))
                    insort(pool, (n - gap, doc, start + gap))
                    gap = 0
            windows.extend(powers(window, tier - gap) if gap else [window])
    return windows


def powers(window: list[tuple[int, int, int]], total: int) -> list[list[tuple[int, int, int]]]:
    """The pieces of a short window, cut into windows of descending powers of two."""
    out, rest = [], list(reversed(window))
    while total:
        size = 1 << (total.bit_length() - 1)
        total -= size
        part = []
        while size:
            doc, start, n = rest.pop()
            if n > size:
                rest.append((doc, start + size, n - size))
                n = size
            part.append((doc, start, n))
            size -= n
        out.append(part)
    return out


def balanced(sizes: list[int], step_tokens: int = STEP_TOKENS) -> list[int]:
    """A step group for every window: as many groups as whole steps, the longest windows dealt first to the lightest group."""
    loads = [(0, k) for k in range(max(1, round(sum(sizes) / step_tokens)))]
    heapify(loads)
    out = [0] * len(sizes)
    for at in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        load, group = loads[0]
        out[at] = group
        heapreplace(loads, (load + sizes[at], group))
    return out


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """One row for every piece of every document: where it comes from, where it goes, and the checksum of its ids.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; tier: the window's context size; step_group.
    """
    tiers = tuple(sorted(tiers))
    if any(t < 1 or t & (t - 1) for t in tiers):
        raise ValueError("context sizes are powers of two")

    def rows(doc_ids: list, ids: list[np.ndarray], first: int, first_group: int) -> tuple[pa.RecordBatch, int, int]:
        windows = pack([len(x) for x in ids], tiers)
        sizes = [sum(n for _, _, n in w) for w in windows]
        groups = balanced(sizes, step_tokens)
        found = []
        for k, (window, size, group) in enumerate(zip(windows, sizes, groups, strict=True)):
            offset = 0
            for doc, start, n in window:
                found.append((doc_ids[doc], start, n, zlib.crc32(ids[doc][start : start + n]), len(ids[doc]), first + k, offset, size, first_group + group))
                offset += n
        kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
        columns = [pa.array(x, kind) for x, kind in zip(zip(*found, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SCHEMA.split(", ")]), first + len(windows), first_group + max(groups) + 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, end = encoder(tokenizer), np.array([end_id], "<u4")
        sequence = group = TaskContext.get().partitionId() << 36
        doc_ids: list = []
        ids: list[np.ndarray] = []
        held = 0
        for batch in slices(batches):
            doc_ids += batch.column("doc_id").to_pylist()
            for x in model.encode_batch([t or "" for t in batch.column("text").to_pylist()]):
                ids.append(np.concatenate([x, end]))
                held += len(ids[-1])
            if held >= group_tokens:
                out, sequence, group = rows(doc_ids, ids, sequence, group)
                yield out
                doc_ids, ids, held = [], [], 0
        if ids:
            yield rows(doc_ids, ids, sequence, group)[0]

    return texts(docs).mapInArrow(run, SCHEMA)
