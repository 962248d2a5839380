"""Kernels of suffix-array deduplication: the windows of texts by their anchors, and deep-shallow sorting of suffixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from rillflow.llm.common import byte_codes, mixed

U = np.uint64
WINDOW = 50
GRAM = 20
#: Bytes that multikey quicksort tells suffixes apart by, a word of 8 at a time, before blind tries take over.
SHALLOW = 16
SEGMENT = 1 << 20
BASE = 0x9E6C63D0876A9A47
CODES = byte_codes(11)
_powers = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) <= n:
        size = 1 << n.bit_length()
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            made = np.full(size + 1, base, U)
            made[0] = 1
            _powers[k] = np.multiply.accumulate(made)
    return _powers[0], _powers[1]


def segments(offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Stretches (start, end, offsets of texts within) of up to SEGMENT bytes. A longer text is cut so that each window is in one part."""
    at, last = 0, len(offsets) - 1
    while at < last:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SEGMENT, "right")) - 1)
        start, end = int(offsets[at]), int(offsets[to])
        if end - start <= SEGMENT or to > at + 1:
            yield start, end, offsets[at : to + 1] - start
        else:
            for part in range(start, end - WINDOW + 1, SEGMENT):
                stop = min(end, part + SEGMENT + WINDOW - 1)
                yield part, stop, np.array([0, stop - part])
        at = to


def anchored(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All windows of a segment's texts as runs that share one anchor: (first window, last window, anchor's hash, content's hash).

    The anchor of a window is its gram of least hash, the leftmost of equal ones; equal windows have equal anchors at equal places.
    """
    n = len(data)
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, U)
    if n < WINDOW:
        return none
    left = np.zeros(n, bool)  # windows that end within their text
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        left[a : max(a, b - WINDOW + 1)] = True
    up, down = powers(n)
    total = np.zeros(n + 1, U)
    np.cumsum(CODES[data] * up[:n], out=total[1:])
    grams = mixed((total[GRAM:] - total[:-GRAM]) * down[: n - GRAM + 1])
    low = (grams >> U(24) << U(24)) | np.arange(len(grams), dtype=U)
    span, reach = WINDOW - GRAM + 1, 1
    while reach * 2 <= span:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    low = np.minimum(low[: len(low) - (span - reach)], low[span - reach :])
    at = (low & U((1 << 24) - 1)).astype(np.int64)
    valid = left[: len(at)]
    starts = valid.copy()
    starts[1:] &= (at[1:] != at[:-1]) | ~valid[:-1]
    ends = valid.copy()
    ends[:-1] &= (at[1:] != at[:-1]) | ~valid[1:]
    # texts that touch: a run ends where its text does
    edge = np.zeros(len(at) + 1, bool)
    inner = offsets[1:-1]
    edge[inner[inner <= len(at)]] = True
    starts |= valid & edge[:-1]
    ends[:-1] |= valid[:-1] & edge[1:-1]
    first, last = np.flatnonzero(starts), np.flatnonzero(ends)
    anchor = at[first]
    stop = last + WINDOW
    content = mixed((total[stop] - total[first]) * down[first] + mixed(((stop - first) << 8 | (anchor - first)).astype(U)))
    return first, last, mixed(grams[anchor] + U(5)), content


def hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the WINDOW bytes from each place on, made of those of 1, 2, 4, ... bytes."""
    part, size, out, have = CODES[data], 1, np.zeros(len(data) + 1, U), 0
    while True:
        if WINDOW & size:
            out = part[: max(0, len(out) - size)] * U(pow(BASE, have, 1 << 64)) + out[size:]
            have += size
        if 2 * size > WINDOW:
            return mixed(out)
        part, size = part[:-size] * U(pow(BASE, size, 1 << 64)) + part[size:], 2 * size


def repeated(numbers: np.ndarray) -> np.ndarray:
    """Which may stand more than once among ``numbers``: all that do, and one in sixteen or so of the others."""
    slot = (numbers >> U(64 - max(8, (16 * len(numbers)).bit_length()))).astype(np.int64)
    return np.bincount(slot)[slot] > 1 if len(slot) else slot > 0


def words_at(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place as one number whose order is theirs. ``data`` has 8 spare bytes."""
    out = np.zeros(len(at), U)
    for k in range(8):
        out = out << U(8) | data[at + k].astype(U)
    return out


def deep_shallow(data: np.ndarray, at: np.ndarray, depth: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Sorts the suffixes of ``data`` at ``at`` by their first ``depth`` bytes: (order, class), a class for each distinct prefix, in order.

    Shallow: multikey quicksort, three ways at a time on words of 8 bytes, all groups in step. Deep: groups that agree on SHALLOW bytes go to blind
    tries: a trie's node skips to the first byte in which its suffixes differ and branches on that byte alone. Every suffix has ``depth`` bytes.
    """
    data = np.concatenate([data, np.zeros(8, np.uint8)])
    n = len(at)
    order, group, read = np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
    active = np.arange(n)  # places in ``order`` whose groups are larger than one and shallower than SHALLOW
    while len(active):
        g = group[active]
        firsts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        sizes = np.diff(np.concatenate([firsts, [len(g)]]))
        words = words_at(data, at[order[active]] + read[active])
        three = np.stack([words[firsts], words[firsts + sizes // 2], words[firsts + sizes - 1]])
        pivot = np.repeat(np.sort(three, axis=0)[1], sizes)
        side = np.where(words < pivot, 0, np.where(words == pivot, 1, 2))
        key = np.repeat(np.arange(len(firsts)) * 3, sizes) + side
        turn = np.argsort(key, kind="stable")
        order[active], key = order[active][turn], key[turn]
        read[active] = read[active][turn] + 8 * (side[turn] == 1)
        fresh = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        counts = np.diff(np.concatenate([fresh, [len(key)]]))
        group[active] = np.repeat(active[fresh], counts)
        active = active[np.repeat(counts > 1, counts) & (read[active] < min(SHALLOW, depth))]
    # blind tries, all nodes of one level at a time
    bounds = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if n else np.zeros(0, np.int64)
    sizes = np.diff(np.concatenate([bounds, [n]])) if n else bounds
    active = np.flatnonzero(np.repeat(sizes > 1, sizes)) if n else bounds
    while len(active):
        g = group[active]
        firsts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        sizes = np.diff(np.concatenate([firsts, [len(g)]]))
        here = at[order[active]]
        head = np.repeat(here[firsts], sizes)
        common = np.full(len(here), depth)
        undecided, step = np.arange(len(here)), int(read[active].min() // 8 * 8)
        while len(undecided) and step < depth:
            apart = words_at(data, here[undecided] + step) ^ words_at(data, head[undecided] + step)
            differ = apart != 0
            top = 63 - np.floor(np.log2(apart[differ].astype(np.float64) + 0.5)).astype(np.int64).clip(0, 63)
            common[undecided[differ]] = np.minimum(common[undecided[differ]], step + top // 8)
            undecided, step = undecided[~differ], step + 8
        # rounding to double may lift the highest bit over a byte's border: look at the bytes themselves there
        skip = np.repeat(np.minimum.reduceat(exact(data, here, head, common, depth), firsts), sizes)
        open_ = skip < depth
        key = np.where(open_, data[np.where(open_, here + skip, 0)].astype(np.int64), 0) + np.repeat(np.arange(len(firsts)) << 8, sizes)
        turn = np.argsort(key, kind="stable")
        order[active], key = order[active][turn], key[turn]
        fresh = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        counts = np.diff(np.concatenate([fresh, [len(key)]]))
        group[active] = np.repeat(active[fresh], counts)
        read[active] = skip
        active = active[np.repeat(counts > 1, counts) & open_]
    classes = np.cumsum(np.concatenate([[0], group[1:] != group[:-1]])) if n else group
    return order, classes


def exact(data: np.ndarray, a: np.ndarray, b: np.ndarray, common: np.ndarray, depth: int) -> np.ndarray:
    """``common``, lowered by one where the byte before already differs."""
    before = np.maximum(common - 1, 0)
    return np.where((common > 0) & (data[a + before] != data[b + before]), before, common)
