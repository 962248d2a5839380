"""Byte-level BPE by dynamic programming over prefixes, and its decoding.

Every prefix of a word has one encoding, so one last token. For each prefix, in order of length, the tokens that
end there (matches of a suffix automaton of the vocabulary) are tried, longest first; the one that may follow
the last token of the prefix before it is kept. Following the kept tokens back from the end gives the ids. No merge is
ever carried out, and the time is linear in the text for bounded token length.

A tokenizer file is read on the driver and sent to the executors; one that asks for more than byte-level words, merges and plain special tokens is refused.

Nulls count as empty texts. An empty text has no ids; its digests are those of no bytes. Rows are independent, so repeated rows,
ties and further columns change nothing, and an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from rillflow.llm.automaton import SuffixAutomaton
from rillflow.llm.common import slices, texts

#: Fixed by the vocabulary's format: how a text falls into words before any merge.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
NEVER = 1 << 40
#: Words that a Python worker remembers; rarer ones are encoded anew in each batch.
REMEMBERED = 300_000
PAIRS_REMEMBERED = 1_000_000


def printable_bytes() -> dict[str, int]:
    """Vocabulary files write a byte as a printable character: itself where it is one, else the next free one from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


def refuse(spec: dict, **allowed) -> None:
    """An error unless each dotted field of a tokenizer file has a value that the encoder handles."""
    for field, values in allowed.items():
        value = spec
        for name in field.split("__"):
            value = (value or {}).get(name)
        if value not in values:
            raise ValueError(f"tokenizer file: {field.replace('__', '.')} is {value!r}, not one of {values}")


def refuse_model(spec: dict, suffixes: tuple) -> None:
    no = (None, False, "")
    refuse(spec, model__type=("BPE",), model__dropout=(None, 0.0), model__continuing_subword_prefix=no, model__end_of_word_suffix=suffixes, model__byte_fallback=no, model__ignore_merges=no)
    for token in spec["added_tokens"]:
        refuse(token, single_word=no, lstrip=no, rstrip=no, normalized=no)


class PrefixEncoder:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        refuse_model(spec, (None, ""))
        refuse(spec, normalizer=(None,), pre_tokenizer__type=("ByteLevel",), pre_tokenizer__add_prefix_space=(False,), pre_tokenizer__use_regex=(True,), decoder__type=("ByteLevel",))
        byte_of = printable_bytes()
        ids = spec["model"]["vocab"]
        latin = {token: "".join(chr(byte_of[c]) for c in token) for token in ids}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*ids.values(), *self.special.values()]) + 1
        self.length = [0] * size
        spelled = [b""] * size
        self.born = [-1] * size  # the rank of the merge that makes the token
        self.parts: list[tuple[int, int] | None] = [None] * size
        for token, i in ids.items():
            self.length[i], spelled[i] = len(latin[token]), latin[token].encode("latin-1")
        for text, i in self.special.items():
            spelled[i] = text.encode()
        self.rank: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            made = ids[a + b]
            if self.parts[made] is not None:
                raise ValueError(f"two merges make token {made}")
            self.rank[ids[a], ids[b]] = rank
            self.born[made], self.parts[made] = rank, (ids[a], ids[b])
        self.edges: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self.follows: dict[int, bool] = {}
        sound: dict[int, bool] = {}
        for i in sorted(ids.values(), key=lambda i: self.born[i]):
            parts = self.parts[i]
            sound[i] = parts is None or (sound[parts[0]] and sound[parts[1]] and self._apart(*parts, self.born[i]))
        self.automaton = SuffixAutomaton((latin[token].encode("latin-1"), i) for token, i in ids.items() if sound[i])
        self.spelled_at = np.cumsum([0, *map(len, spelled)])
        self.spelling = np.frombuffer(b"".join(spelled), np.uint8)
        self.id_type = "<u2" if size <= 1 << 16 else "<u4"
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.known: dict[str, bytes] = {}

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens that stand at one edge while ``token`` is built up, each with the rank of the merge that ends it."""
        found = self.edges.get((token, side))
        if found is None:
            found, until, at = [], NEVER, token
            while True:
                found.append((at, until))
                if self.parts[at] is None:
                    break
                until, at = self.born[at], self.parts[at][side]
            found.reverse()
            self.edges[token, side] = found
        return found

    def _apart(self, a: int, b: int, before: int = NEVER) -> bool:
        """No merge across the border of ``a`` and ``b`` comes due before rank ``before`` while both are built up."""
        left, right = self._edge(a, 1), self._edge(b, 0)
        i = j = 0
        while True:
            (x, x_ends), (y, y_ends) = left[i], right[j]
            due = self.rank.get((x, y), NEVER)
            if due < before and due < x_ends and due <= y_ends:
                return False
            if x_ends == NEVER == y_ends:
                return True
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1

    def word(self, text: str) -> list[int]:
        """The ids of one word."""
        data = text.encode()
        n = len(data)
        last, follows = [-1] * (n + 1), self.follows
        sam = self.automaton
        first, find, target, link, length, token_of, below = sam.first, sam.labels.find, sam.target, sam.link, sam.length, sam.token, sam.below
        state = matched = end = 0
        for byte in data:
            # a step of the automaton, as SuffixAutomaton.ends has it, without the lists
            while (k := find(byte, first[state], first[state + 1])) < 0 and state:
                state = link[state]
                matched = length[state]
            if k >= 0:
                state = target[k]
                matched += 1
            end += 1
            here = state if length[state] == matched and token_of[state] >= 0 else below[state]
            while here:
                token, before = token_of[here], end - length[here]
                if not before:
                    last[end] = token
                    break
                previous = last[before]
                if previous >= 0:
                    key = previous << 20 | token
                    good = follows.get(key)
                    if good is None:
                        if len(follows) >= PAIRS_REMEMBERED:
                            follows.clear()
                        good = follows[key] = self._apart(previous, token)
                    if good:
                        last[end] = token
                        break
                here = below[here]
            else:
                raise ValueError(f"no token ends byte {end - 1} of {text!r}")
        out = []
        while n:
            out.append(last[n])
            n -= self.length[last[n]]
        return out[::-1]

    def encode(self, text: str, recent: dict[str, bytes]) -> np.ndarray:
        """The ids of a whole text. ``recent``: words met in this batch beyond the remembered ones."""
        known, made = self.known, []
        for k, piece in enumerate(self.split_special.split(text) if self.split_special else [text]):
            if k % 2:
                made.append(np.array([self.special[piece]], self.id_type).tobytes())
                continue
            words = WORDS.findall(piece)
            found = [*map(known.get, words)]
            if None in found:
                for at, ids in enumerate(found):
                    if ids is None:
                        word = words[at]
                        ids = known.get(word) or recent.get(word)
                        if ids is None:
                            ids = np.array(self.word(word), self.id_type).tobytes()
                            (known if len(known) < REMEMBERED and len(word) < 64 else recent)[word] = ids
                        found[at] = ids
            made.extend(found)
        return np.frombuffer(b"".join(made), self.id_type)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that the ids spell, as UTF-8 in which ill-formed bytes became the replacement character."""
        start, end = self.spelled_at[:-1][ids], self.spelled_at[1:][ids]
        length = end - start
        at = np.repeat(start - np.cumsum(length) + length, length) + np.arange(length.sum())
        data = self.spelling[at].tobytes()
        try:
            data.decode()
            return data
        except UnicodeDecodeError:
            return data.decode("utf-8", "replace").encode()


@lru_cache(maxsize=2)
def encoder(path: str) -> PrefixEncoder:
    return PrefixEncoder(path)


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, decoded string) for every document; one pass, nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(encoder(vocabulary))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches):
            recent: dict[str, bytes] = {}
            ids = [model.encode(t or "", recent) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())), pa.array([model.decode(x).decode() for x in ids], pa.string())], names=["doc_id", "ids", "decoded"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): as ``encode``, with the ids and the decoded text digested where they arise."""
    shared = docs.sparkSession.sparkContext.broadcast(encoder(vocabulary))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches):
            recent: dict[str, bytes] = {}
            ids = [model.encode(t or "", recent) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(model.decode(x)).hexdigest() for x in ids], pa.string()),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
