"""Word shingles of whole texts as sorted sets of 64-bit hashes, computed on whole Arrow buffers at once."""

from __future__ import annotations

import numpy as np

from rillflow.llm.common import byte_codes, mixed

#: Fixed: words are the runs between these bytes.
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
BASE = 0x2545F4914F6CDD1D
U = np.uint64


def _codes() -> np.ndarray:
    codes = byte_codes(7)
    codes[ord("A") : ord("Z") + 1] = codes[ord("a") : ord("z") + 1]
    return codes


CODES = _codes()
SEPARATES = np.isin(np.arange(256), SEPARATORS)
_powers = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i up to n."""
    if len(_powers[0]) <= n:
        size = 1 << n.bit_length()
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            made = np.full(size + 1, base, U)
            made[0] = 1
            _powers[k] = np.multiply.accumulate(made)
    return _powers[0], _powers[1]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word, in order, and the number of words of every text. ASCII letters count in lower case."""
    n = len(data)
    if not n:
        return np.zeros(0, U), np.zeros(len(offsets) - 1, np.int64)
    inside = ~SEPARATES[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | first[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | first[1:n]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    up, down = powers(n)
    total = np.zeros(n + 1, U)
    np.cumsum(CODES[data] * up[:n], out=total[1:])
    hashes = mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U))
    return hashes, np.diff(np.searchsorted(starts, offsets))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """For each text its sorted distinct shingles of ``width`` words; a shorter text that has words is one shingle."""
    words, counts = word_hashes(data, offsets)
    at = np.concatenate([[0], np.cumsum(counts)])
    padded = np.concatenate([words, np.zeros(width, U)])
    text = np.repeat(np.arange(len(counts)), counts)
    text_padded = np.concatenate([text, np.full(width, -1)])
    total = np.zeros(len(words), U)
    factors = mixed(np.arange(1, width + 1, dtype=U)) | U(1)
    for k in range(width):
        part = padded[k : k + len(words)] * factors[k]
        total += part if k == 0 else np.where(text_padded[k : k + len(words)] == text, part, U(0))
    total = mixed(total)
    out = []
    for k, n in enumerate(counts):
        if n == 0:
            out.append(np.zeros(0, U))
            continue
        found = np.sort(total[at[k] : at[k] + max(1, n - width + 1)])
        keep = np.ones(len(found), bool)
        np.not_equal(found[1:], found[:-1], out=keep[1:])
        out.append(found[keep])
    return out


def set_id(shingles: np.ndarray) -> int:
    """A signed 64-bit name of a set: equal for equal sets."""
    if not len(shingles):
        return 0
    return int(mixed(np.array([np.sum(mixed(shingles)) + U(len(shingles))], U)).view(np.int64)[0])
