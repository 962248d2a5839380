"""Secret scans through nested encodings.

A text is the first layer of a worklist. Each layer is scanned; then everything in it that decodes (runs of percent codes, escapes of
code points, base64, UTF-16 and compressed data beneath base64) makes further layers, until no new layer comes up. Letters before a base64 run, or a path that runs
into it, may shift it: each run is decoded at all four places, and compressed data is looked for anywhere in what comes out. A layer that was met before
(same content for the same stretch of the text) is not entered again, so cycles end. Each layer knows which stretch of the
original text each of its characters stands for, and a secret found in it is reported as that stretch.

A decoded layer is scanned whole, whether or not it is text, unless it has no run of printable ASCII as long as the shortest secret.

Spans are code points, end exclusive. Null and empty texts have no spans. Whole texts are scanned; a text's cost is in proportion to its
layers. Compressed data of any ratio, compressed any number of times and of any number of members, is expanded a chunk at a time, and scanned in pieces cut where nothing can go on.
The worklist goes in depth first and makes each piece when its turn comes, so it holds one piece a level; an unbroken run is held whole, so memory follows the longest one. Rows are independent: repeated rows and
further columns change nothing, and an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.llm.common import slices, texts

KINDS = ("assign", "access", "hex")
#: Fixed patterns: what counts as a secret.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
NAMES = ("passw", "secret", "token", "api")
LEAST_ASSIGNED = 6
#: The shortest secret, "token=" and six letters, has 12 printable bytes; percent codes, escapes and base64 only make it longer, and compressed data is opened in any case.
PRINTABLE = re.compile(rb"[\x20-\x7e]{12,}")
#: The same in UTF-16 of either order.
WIDE = re.compile(rb"(?:[\x20-\x7e]\0){12,}|(?:\0[\x20-\x7e]){12,}")

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#[xX]([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});|%u([0-9A-Fa-f]{4})")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Fixed signatures of compressed data.
MAGIC = ((b"\x1f\x8b", lambda: zlib.decompressobj(31)), (b"\x78\x01", zlib.decompressobj), (b"\x78\x5e", zlib.decompressobj), (b"\x78\x9c", zlib.decompressobj), (b"\x78\xda", zlib.decompressobj), (b"BZh", bz2.BZ2Decompressor), (b"\xfd7zXZ", lzma.LZMADecompressor))
CHUNK = 1 << 20
LONGEST_MAGIC = max(len(magic) for magic, _ in MAGIC)
#: Where compressed data may begin.
BEGINS = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]|\xfd7zXZ\0")
#: Where decompressed data may be cut: after a byte that no pattern has, several zero bytes, or between two plain words after another. No encoding hides such a place.
BORDER = re.compile(rb"""[^A-Za-z0-9+/_.=:%\\&#;{}"'\x00\x20\x80-\xff-]|\x00{4,}|[\x80-\xff](?=[\x01-\x7f\xc0-\xff])|\x20[A-Za-z0-9.]+(?=\x20[A-Za-z0-9])""")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the secrets in one layer, in order."""
    found = []
    if "=" in text or ":" in text:
        low = text.lower()
        if any(name in low for name in NAMES):
            found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGNED]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


class Layer:
    """A decoded text. ``origin``: for each character its start and end in the original, or one (start, end) for all, or None where they are the same."""

    def __init__(self, text: str, origin: np.ndarray | tuple[int, int] | None):
        self.text, self.origin = text, origin

    def stretch(self, start: int, end: int) -> tuple[int, int]:
        if self.origin is None:
            return start, end
        if isinstance(self.origin, tuple):
            return self.origin
        return int(self.origin[start, 0]), int(self.origin[end - 1, 1])

    def rewritten(self, pattern: re.Pattern, decode) -> Layer | None:
        """This layer with all matches of ``pattern`` decoded; None where none decodes."""
        parts, origins, at, changed = [], [], 0, False
        for m in pattern.finditer(self.text):
            pieces = decode(m)
            if not pieces:
                continue
            changed = True
            if m.start() > at:
                parts.append(self.text[at : m.start()])
                origins.append(self._origins(at, m.start()))
            for text, start, end in pieces:
                parts.append(text)
                origins.append(np.tile(np.array([self.stretch(m.start() + start, m.start() + end)]), (len(text), 1)))
            at = m.end()
        if not changed:
            return None
        parts.append(self.text[at:])
        origins.append(self._origins(at, len(self.text)))
        return Layer("".join(parts), self.origin if isinstance(self.origin, tuple) else np.concatenate(origins))

    def _origins(self, start: int, end: int) -> np.ndarray:
        if self.origin is None:
            return np.stack([np.arange(start, end), np.arange(start + 1, end + 1)], 1)
        if isinstance(self.origin, tuple):
            return np.tile(np.array([self.origin]), (end - start, 1))
        return self.origin[start:end]


def percent(m: re.Match) -> list[tuple[str, int, int]]:
    """A run of percent codes: one piece for each character that its bytes spell."""
    data, out, at = bytes.fromhex(m[0].replace("%", "")), [], 0
    while at < len(data):
        for n in (1, 2, 3, 4):
            try:
                out.append((data[at : at + n].decode(), 3 * at, 3 * (at + n)))
                break
            except UnicodeDecodeError:
                continue
        else:
            n = 1
            out.append((chr(data[at]), 3 * at, 3 * at + 3))
        at += n
    return out


def escape(m: re.Match) -> list[tuple[str, int, int]]:
    code = int(m[6]) if m[6] else int(next(g for k, g in enumerate(m.groups()) if g and k != 5), 16)
    return [(chr(code), 0, len(m[0]))] if code < 0x110000 and not 0xD800 <= code < 0xE000 else []


def readable(data: bytes) -> Iterator[str]:
    """The texts that ``data`` may be: UTF-8 that is nearly free of control characters, or else has printable ASCII enough for a secret (then bytes that aren't UTF-8 count as Latin-1), and UTF-16."""
    try:
        text = data.decode()
        odd = sum(c < 32 and c not in (9, 10, 13) or c == 127 for c in data[:4096])
        plain = bool(text) and odd * 20 <= min(len(data), 4096)
    except UnicodeDecodeError:
        text, plain = data.decode("latin-1"), False
    if plain or PRINTABLE.search(data):
        yield text
    if b"\0" in data and WIDE.search(data):
        for shifted in (data, data[1:]):
            yield shifted.decode("utf-16-le", "replace")


def compression(data: bytes):
    """What makes a decompressor for ``data``, or None if it doesn't begin as compressed data does."""
    return next((make for magic, make in MAGIC if data.startswith(magic)), None)


def expanded(parts: Iterable[bytes]) -> Iterator[bytes]:
    """The decompressed parts of a compressed stream, all its members one after the other. Damaged or cut data gives what precedes the damage."""
    machine, waiting = None, b""
    for part in parts:
        waiting += part
        while waiting:
            if machine is None:
                waiting = waiting.lstrip(b"\0")  # padding between members
                if len(waiting) < LONGEST_MAGIC:
                    break
                if (make := compression(waiting)) is None:
                    return
                machine = make()
            zipped = hasattr(machine, "unconsumed_tail")
            try:
                while True:
                    out = machine.decompress(waiting, CHUNK)
                    waiting = machine.unconsumed_tail if zipped else b""
                    if out:
                        yield out
                    if machine.eof or (not (waiting or out) if zipped else machine.needs_input):
                        break
            except (zlib.error, OSError, EOFError, lzma.LZMAError, ValueError):
                return
            if machine.eof:
                machine, waiting = None, machine.unused_data


def expanded_times(data: bytes, times: int) -> Iterator[bytes]:
    parts = iter([data])
    for _ in range(times):
        parts = expanded(parts)
    return parts


def pieces(parts: Iterable[bytes]) -> Iterator[bytes]:
    """The same bytes in pieces that end where no secret and no encoded run can go on; a run without such a place is held whole."""
    held: list[bytes] = []
    for part in parts:
        at = 0
        for start in (max(0, len(part) - 4096), 0):
            for m in BORDER.finditer(part, start):
                at = m.end()
            if at:
                break
        if at:
            yield b"".join([*held, part[:at]])
            held = []
        held.append(part[at:])
    if rest := b"".join(held):
        yield rest


def opened(run: str) -> Iterator[str]:
    """The texts within a run of base64 letters, decompressed layers opened."""
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    for shift in range(4):
        part = body[shift:]
        if len(part) % 4 == 1:
            part = part[:-1]
        try:
            data = base64.b64decode(part + "=" * (-len(part) % 4))
        except (binascii.Error, ValueError):
            continue
        yield from readable(data)
        at = 0
        while m := BEGINS.search(data, at):
            yield from unpacked(data[m.start() :])
            at = m.start() + stream_length(data[m.start() :])


def stream_length(data: bytes) -> int:
    """The bytes of the first compressed stream in ``data``; 1 where it doesn't come to its end."""
    machine = (compression(data) or MAGIC[0][1])()
    zipped, rest = hasattr(machine, "unconsumed_tail"), data
    try:
        while not machine.eof:
            out = machine.decompress(rest, CHUNK)
            rest = machine.unconsumed_tail if zipped else b""
            if not machine.eof and not out and not rest:
                return 1
    except (zlib.error, OSError, EOFError, lzma.LZMAError, ValueError):
        return 1
    return max(1, len(data) - len(machine.unused_data))


def unpacked(data: bytes) -> Iterator[str]:
    """The texts in compressed ``data``, compressed any number of times."""
    source, times, seen, most = data, 0, set(), 4 * max(CHUNK, len(data))
    while True:
        head = b""
        for part in expanded_times(source, times):
            head += part[:LONGEST_MAGIC]
            if len(head) >= LONGEST_MAGIC:
                break
        if not compression(head):
            return
        digest, size, whole = hashlib.blake2b(digest_size=16), 0, []
        for part in expanded_times(source, times + 1):
            digest.update(part)
            size += len(part)
            if size <= most:
                whole.append(part)
            else:
                whole.clear()
        if not size or digest.digest() in seen:  # damaged, or data that expands to itself
            return
        seen.add(digest.digest())
        if size <= most:
            source, times = b"".join(whole), 0
        else:
            times += 1
        for piece in pieces(expanded_times(source, times)):
            yield from readable(piece)


def inner(layer: Layer) -> Iterator[Layer]:
    """The layers that one layer decodes into, each made when it is asked for."""
    content = layer.text
    if "%" in content and (made := layer.rewritten(PERCENT, percent)):
        yield made
    if ("\\" in content or "&#" in content or "%u" in content) and (made := layer.rewritten(ESCAPE, escape)):
        yield made
    for m in BASE64.finditer(content):
        for text in opened(m[0]):
            yield Layer(text, layer.stretch(m.start(), m.end()))


def all_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], int]:
    """The spans of the text itself; those of all layers; the number of layers beyond the first."""
    base = base_spans(text)
    spans, seen, layers = set(base), set(), 0
    work = [inner(Layer(text, None))]
    while work:
        if (layer := next(work[-1], None)) is None:
            work.pop()
            continue
        key = (hashlib.blake2b(layer.text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), layer.stretch(0, len(layer.text)))
        if key in seen:
            continue
        seen.add(key)
        layers += 1
        for start, kind, end in base_spans(layer.text):
            a, b = layer.stretch(start, end)
            spans.add((a, kind, b))
        work.append(inner(layer))
    return base, sorted(spans), layers


def written(spans: Iterable[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def redacted(text: str, spans: Iterable[tuple[int, int, int]]) -> str:
    """The text with every stretch that a span covers replaced by one mark."""
    out, at, until = [], 0, -1
    for start, _, end in sorted(spans):
        if start >= until:
            out += [text[at:start], "[SECRET]"]
        until = max(until, end)
        at = until
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end, decoded>>, n_layers): every secret of every document, decoded ones marked."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("decoded", pa.bool_())]))
        for batch in slices(batches):
            found, layers = [], []
            for text in batch.column("text").to_pylist():
                base, spans, n = all_spans(text or "")
                own = set(base)
                found.append([{"kind": KINDS[k], "start": a, "end": b, "decoded": (a, k, b) not in own} for a, k, b in spans])
                layers.append(n)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind), pa.array(layers, pa.int32())], names=["doc_id", "spans", "n_layers"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, spans array<struct<kind string, start long, end long, decoded boolean>>, n_layers int")


def scan_digests(docs: DataFrame) -> DataFrame:
    """``scan`` with the counts and the digest of the spans that need no decoding, and all spans as one string."""
    found = scan(docs)
    base = F.filter("spans", lambda s: ~s["decoded"])
    line = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(F.array_join(F.transform(base, line), ","), 256).alias("base_sha256"), F.array_join(F.transform("spans", line), ",").alias("spans"), F.size(F.filter("spans", lambda s: s["decoded"])).cast("long").alias("n_decoded"), "n_layers")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs``; in ``text_col`` every secret is replaced by a mark. Null texts stay null."""
    schema, names = docs.schema, docs.columns
    at = names.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column=text_col):
            clean = [t if t is None else redacted(t, all_spans(t)[1]) for t in batch.column(at).to_pylist()]
            columns = [pa.array(clean, pa.string()) if k == at else c for k, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, schema)
