"""Encoding, packing, secrets and sharding against the library, exact round trips and plain Python."""

import base64
import bz2
import gzip
import hashlib
import io
import json
import lzma
import math
import random
import tarfile
import zlib
from urllib.parse import quote

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rillflow.llm import automaton, bpe, packing, secrets, sharding

BYTES, WORDS = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/word_bpe_49k.json"


def plain(path):
    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return model


def test_bpe_is_the_librarys(docs, hard_texts):
    model = plain(BYTES)
    want = sorted((i, len(c.ids), hashlib.sha256(np.array(c.ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(model.decode(c.ids, skip_special_tokens=False).encode()).hexdigest()) for i, c in ((i, model.encode(t or "", add_special_tokens=False)) for i, t in hard_texts))
    assert sorted(map(tuple, bpe.encode_digests(docs, BYTES).collect())) == want


def test_bpe_full_output(docs, empty, hard_texts):
    found = {(r.doc_id, r.decoded): r.ids for r in bpe.encode(docs, BYTES).collect()}
    assert set(found) == {(i, t or "") for i, t in hard_texts}
    assert bpe.encode_digests(empty, BYTES).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=6).map(lambda b: bytes(97 + x % 3 for x in b)), min_size=1, max_size=12, unique=True), st.binary(max_size=40).map(lambda b: bytes(97 + x % 4 for x in b)))
def test_automaton_finds_all_tokens_that_end_at_a_place(tokens, text):
    found = automaton.SuffixAutomaton((t, k) for k, t in enumerate(tokens)).ends(text)
    want = [[k for _, k in sorted(((len(t), k) for k, t in enumerate(tokens) if text[: at + 1].endswith(t)), reverse=True)] for at in range(len(text))]
    assert found == want


def test_other_tokenizers_are_refused(tmp_path):
    for path, build, change in ((BYTES, bpe.PrefixEncoder, ("normalizer", {"type": "NFC"})), (BYTES, bpe.PrefixEncoder, ("pre_tokenizer", {"type": "ByteLevel", "add_prefix_space": True, "use_regex": True})), (WORDS, packing.WordMerger, ("normalizer", None)), (WORDS, packing.WordMerger, ("pre_tokenizer", {"type": "Whitespace"}))):
        spec = json.load(open(path, encoding="utf-8"))
        spec[change[0]] = change[1]
        (tmp_path / "t.json").write_text(json.dumps(spec))
        with pytest.raises(ValueError, match="tokenizer file"):
            build(str(tmp_path / "t.json"))
    spec = json.load(open(BYTES, encoding="utf-8"))
    spec["added_tokens"][0]["lstrip"] = True
    (tmp_path / "t.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="lstrip"):
        bpe.PrefixEncoder(str(tmp_path / "t.json"))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" 'stre\n\t1")), max_size=60))
def test_bpe_on_any_text(text):
    model = plain_bytes()
    assert list(bpe.encoder(BYTES).encode(text, {})) == model.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=6).map(lambda b: bytes(97 + x % 3 for x in b)), min_size=1, max_size=12, unique=True), st.binary(max_size=40).map(lambda b: bytes(97 + x % 4 for x in b)))
def test_automaton_finds_all_tokens_that_end_at_a_place(tokens, text):
    found = automaton.SuffixAutomaton((t, k) for k, t in enumerate(tokens)).ends(text)
    want = [[k for _, k in sorted(((len(t), k) for k, t in enumerate(tokens) if text[: at + 1].endswith(t)), reverse=True)] for at in range(len(text))]
    assert found == want


def test_other_tokenizers_are_refused(tmp_path):
    for path, build, change in ((BYTES, bpe.PrefixEncoder, ("normalizer", {"type": "NFC"})), (BYTES, bpe.PrefixEncoder, ("pre_tokenizer", {"type": "ByteLevel", "add_prefix_space": True, "use_regex": True})), (WORDS, packing.WordMerger, ("normalizer", None)), (WORDS, packing.WordMerger, ("pre_tokenizer", {"type": "Whitespace"}))):
        spec = json.load(open(path, encoding="utf-8"))
        spec[change[0]] = change[1]
        (tmp_path / "t.json").write_text(json.dumps(spec))
        with pytest.raises(ValueError, match="tokenizer file"):
            build(str(tmp_path / "t.json"))
    spec = json.load(open(BYTES, encoding="utf-8"))
    spec["added_tokens"][0]["lstrip"] = True
    (tmp_path / "t.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="lstrip"):
        bpe.PrefixEncoder(str(tmp_path / "t.json"))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" 'stre.,\n\tÉé1")), max_size=60))
def test_words_on_any_text(text):
    assert list(packing.encoder(WORDS).encode_batch([text])[0]) == plain_words().encode(text, add_special_tokens=False).ids


_models = {}


def plain_bytes():
    return _models.setdefault(BYTES, plain(BYTES))


def plain_words():
    return _models.setdefault(WORDS, plain(WORDS))


@pytest.mark.parametrize("seed", range(5))
def test_packing_places_every_id_once(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([1, 2, 100, 255, 256, 257, 4096, 5000, 9000, rng.randrange(1, 3000)]) for _ in range(rng.randrange(1, 200))]
    windows = packing.pack(lengths)
    seen = {}
    for w in windows:
        size = sum(n for _, _, n in w)
        assert size & (size - 1) == 0 and size <= 4096
        for doc, start, n in w:
            assert n > 0
            seen.setdefault(doc, []).append((start, n))
    for doc, n in enumerate(lengths):
        at = 0
        for start, size in sorted(seen[doc]):
            assert start == at
            at += size
        assert at == n
    assert packing.pack([]) == []


def test_packed_documents(docs, empty, hard_texts):
    model = plain(WORDS)
    ids = {}
    for i, t in hard_texts:
        ids.setdefault(i, model.encode(t or "", add_special_tokens=False).ids + [2])
    found = packing.pack_documents(docs, WORDS).collect()
    sequences = {}
    for r in found:
        piece = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert len(piece) == r.length and zlib.crc32(piece.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length, r.tier))
    for pieces in sequences.values():
        at = 0
        for offset, length, tier in sorted(pieces):
            assert offset == at
            at += length
        assert at == tier
    assert sum(r.length for r in found) == sum(len(ids[i]) for i, _ in hard_texts)
    assert packing.pack_documents(empty, WORDS).count() == 0


def test_step_groups_are_even():
    groups = packing.balanced([4096] * 64 + [512] * 10 + [16] * 3, 1 << 16)
    loads = [sum(s for s, g in zip([4096] * 64 + [512] * 10 + [16] * 3, groups, strict=True) if g == k) for k in set(groups)]
    assert max(loads) - min(loads) <= 4096


SECRET = "token = abcdef123456"


@pytest.mark.parametrize(
    "wrapped",
    [
        quote(SECRET, safe=""),
        "".join(f"%{b:02X}" for b in SECRET.encode()),
        "".join(f"\\u{ord(c):04x}" for c in SECRET),
        "".join(f"&#{ord(c)};" for c in SECRET),
        "".join(f"%u{ord(c):04X}" for c in SECRET),
        *(base64.b64encode(SECRET.encode(kind)).decode() for kind in ("utf-16-le", "utf-16-be", "utf-16")),
        base64.b64encode(gzip.compress(("x" * 9 + "\n" + SECRET).encode("utf-16-le"))).decode(),
        *(before + base64.b64encode(make(SECRET.encode())).decode() for before in ("a", "ab", "abc", "/x/", "key-", "/a/long/path/to/it/") for make in (bytes, gzip.compress, bz2.compress)),
        base64.b64encode(SECRET.encode()).decode(),
        base64.urlsafe_b64encode(gzip.compress(SECRET.encode())).decode(),
        base64.b64encode(base64.b64encode(zlib.compress(SECRET.encode()))).decode(),
        quote(base64.b64encode(bz2.compress(SECRET.encode())).decode(), safe=""),
        base64.b64encode(gzip.compress(zlib.compress(SECRET.encode()))).decode(),
    ],
)
def test_wrapped_secrets_are_found_where_they_stand(wrapped):
    text = f"before {wrapped} after"
    base, spans, layers = secrets.all_spans(text)
    assert layers and spans
    start, end = min(s[0] for s in spans), max(s[2] for s in spans)
    assert 7 <= start < end <= 7 + len(wrapped)
    assert "abcdef" not in secrets.redacted(text, spans) and secrets.redacted(text, spans).endswith(" after")


@pytest.mark.parametrize(
    "text, want",
    [
        ("password: hunter22", [("assign", 0, 18)]),
        ("API_KEY='abcdef'", [("assign", 0, 15)]),
        ("token=short", []),
        ("token=abc token=abcdefg", [("assign", 10, 23)]),
        ("token=token:abcdefgh", []),
        ("AKIA" + "A" * 16, [("access", 0, 20)]),
        ("AKIA" + "A" * 15, []),
        ("0" * 24, [("hex", 0, 24)]),
        ("0" * 23 + "G" + "a" * 30, [("hex", 24, 54)]),
        ("ſecret=abcdefgh", []),
        ("é token=" + "a" * 24, [("assign", 2, 32), ("hex", 8, 32)]),
        ("", []),
    ],
)
def test_base_patterns(text, want):
    assert [(secrets.KINDS[k], a, b) for a, k, b in secrets.base_spans(text)] == want


def test_secret_scan_of_hard_texts(spark, docs, empty):
    assert secrets.scan_digests(docs).count() == docs.count() and secrets.scan_digests(empty).count() == 0
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "x token=abcdefg y")], "doc_id long, text string")
    assert [(r.n_assign, r.spans) for r in secrets.scan_digests(rows).orderBy("doc_id").collect()] == [(0, ""), (0, ""), (1, "assign:2:15")]
    assert [r.text for r in secrets.redact(rows).orderBy("doc_id").collect()] == [None, "", "x [SECRET] y"]
    assert secrets.redact(docs).columns == docs.columns


def plain_spans(text):
    """The base spans, letter by letter."""
    low = "".join(c.lower() if c.isascii() else c for c in text)
    is_value = lambda c: c.isascii() and (c.isalnum() or c in "+/_.=-")
    found = []

    def run(at, good):
        while at < len(text) and good(text[at]):
            at += 1
        return at

    at = 0
    while at < len(text):
        end = next((at + len(n) for n in ("password", "passwd", "secret", "token", "api_key", "apikey") if low.startswith(n, at)), None)
        if end is not None:
            k = end + (text[end : end + 1] in tuple("\"'"))
            k = run(k, lambda c: c == " ")
            if text[k : k + 1] in (":", "=") and k < len(text):
                k = run(k + 1, lambda c: c == " ")
                k += text[k : k + 1] in tuple("\"'")
                if (stop := run(k, is_value)) > k:
                    if stop - k >= 6:
                        found.append((at, 0, stop))
                    at = stop
                    continue
        at += 1
    for kind, lead, good, least in ((1, "AKIA", lambda c: c.isascii() and (c.isdigit() or c.isupper()), 20), (2, "", lambda c: c in "0123456789abcdef", 24)):
        at = 0
        while at < len(text):
            if text.startswith(lead, at) and (stop := run(at + len(lead), good)) > at + len(lead):
                if stop - at >= least:
                    found.append((at, kind, stop))
                at = stop
            else:
                at += 1
    return sorted(found)


def test_base_spans_are_those_of_a_plain_scan(spark):
    rng = random.Random(12)
    bits = ["password", "Passwd", "SECRET", "token", "api_key", "ApiKey", "api", "AKIA", "AKIAB0", "A" * 9, "9Z", "0123456789abcdef", "deadbeef", "ff", "'", '"', " ", "  ", ":", "=", "==", "-", "/", "x", "é", "😀", "\n", "ſ", "İ", "abcdef", "abc.d_", ","]
    rows = [(k, "".join(rng.choice(bits) for _ in range(rng.randrange(0, 60)))) for k in range(3000)]
    found = {r.doc_id: r for r in secrets.scan_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    met = 0
    for i, text in rows:
        want = plain_spans(text)
        met += len(want)
        assert [found[i].n_assign, found[i].n_access, found[i].n_hex] == [sum(k == kind for _, k, _ in want) for kind in range(3)], text
        assert found[i].base_sha256 == hashlib.sha256(secrets.written(want).encode()).hexdigest(), text
        assert set(secrets.written(want).split(",")) - {""} <= set(found[i].spans.split(","))
    assert met > 1000


def test_endless_nesting_ends():
    text = SECRET
    for _ in range(6):
        text = base64.b64encode(quote(text, safe="").encode()).decode()
    assert secrets.all_spans(text)[1]
    assert secrets.all_spans("%25" * 50 + "%%%2")[1] == []


def test_shards_move_only_into_the_new_one(docs, empty, hard_texts):
    tree = sharding.regular_tree(2, 4, 5)
    found = sharding.shard(docs, tree, sharding.grown_tree(tree, 40)).collect()
    assert len(found) == len(hard_texts)
    assert all(r.grown_shard in (r.shard, 40) for r in found)
    text = dict(hard_texts)
    assert all(r.size == len((text[r.doc_id] or "").encode()) + 16 and r.text_crc32 == zlib.crc32((text[r.doc_id] or "").encode()) for r in found)
    for s in {r.shard for r in found}:
        assert sorted(r.slot for r in found if r.shard == s) == list(range(sum(r.shard == s for r in found)))
    assert sharding.shard(empty, tree).count() == 0


def plain_shard(key, node, path):
    """The shard of a key, by walking the tree."""
    if not node.children:
        return node.shard
    arrivals = []
    for child in node.children:
        below = f"{path}/{child.name}"
        h = 42 if key is None else xxhash.xxh64(int(key).to_bytes(8, "little", signed=True), seed=42).intdigest()
        h = xxhash.xxh64(below.encode(), seed=h).intdigest()
        if child.weight > 0:
            arrivals.append((-math.log(((h >> 11) + 0.5) / (1 << 53)) / child.weight, len(arrivals), child, below))
    _, _, child, below = min(arrivals)
    return plain_shard(key, child, below)


def test_placement_is_that_of_a_plain_walk(spark):
    leaf = lambda k, w: sharding.Node(f"s{k}", shard=k, own_weight=w)
    uneven = sharding.Node("root", (sharding.Node("a", (leaf(0, 1), leaf(1, 2.5))), leaf(7, 0.5), sharding.Node("b", (sharding.Node("c", (leaf(2, 1), leaf(3, 0))), leaf(4, 3)))))
    regular = sharding.regular_tree(2, 4, 5)
    keys = [*range(2000), -5, (1 << 63) - 1, None]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for tree in (uneven, regular, sharding.grown_tree(regular, 40)):
        found = {r.k: r.s for r in df.select("k", sharding.shard_of(df["k"], tree).alias("s")).collect()}
        assert found == {k: plain_shard(k, tree, f"/{tree.name}") for k in keys}


def test_shares_follow_weights_and_moves_stay_in_the_changed_subtree(spark):
    leaf = lambda k, w: sharding.Node(f"s{k}", shard=k, own_weight=w)
    build = lambda w: sharding.Node("root", (sharding.Node("a", (leaf(0, 1), leaf(1, w))), sharding.Node("b", (leaf(2, 1), leaf(3, 1)))))
    keys = spark.range(20_000)
    both = keys.select(sharding.shard_of(keys["id"], build(1)).alias("a"), sharding.shard_of(keys["id"], build(3)).alias("b")).collect()
    share = sum(r.b == 1 for r in both) / len(both)
    assert abs(share - 0.5) < 0.02
    assert not any(r.a in (0, 1) and r.b in (2, 3) for r in both) and not any({r.a, r.b} == {2, 3} for r in both)
    assert {r[0] for r in keys.select(sharding.shard_of(keys["id"], sharding.Node("root", (leaf(5, 1), leaf(6, 0))))).distinct().collect()} == {5}


def coded(data):
    return base64.b64encode(data).decode()


def noise(n):
    """Lines of letters that hardly compress and hold no secret."""
    return random.Random(3).randbytes(n).translate(bytes(10 if b >= 240 else b"GHIJKLMNOPQRSTUVghijklmnopqrstuv"[b % 32] for b in range(256)))


@pytest.mark.parametrize(
    "data",
    [
        gzip.compress(gzip.compress(noise(2_000_000) + b"\n" + SECRET.encode())),
        bz2.compress(lzma.compress(zlib.compress(noise(2_000_000) + b"\n" + SECRET.encode()))),
        gzip.compress(b"word " * 207_000 + b"\n" + coded(zlib.compress(noise(40_000) + b"\n" + SECRET.encode())).encode() + b"\n"),
        gzip.compress(b" " * ((1 << 20) - 6000) + SECRET.replace(" ", " " * 9000).encode()),
        *(make(b"nothing here\n") + make(SECRET.encode()) for make in (gzip.compress, bz2.compress, lzma.compress)),
        gzip.compress(b"nothing here\n") + bytes(512) + gzip.compress(b"nor here\n") + gzip.compress(SECRET.encode()),
    ],
    ids=["twice", "three times", "run over a border", "blanks over a border", "gzip members", "bzip2 members", "xz members", "padded members"],
)
def test_secrets_deep_in_compressed_data(data):
    text = f"before {coded(data)} after"
    assert secrets.redacted(text, secrets.all_spans(text)[1]) == "before [SECRET] after"


def test_pieces_lose_nothing():
    data = (b"word and word " * 50 + b"token = abcdef%20, " + "é😀".encode() * 9) * 40
    parts = [data[k : k + 97] for k in range(0, len(data), 97)]
    assert b"".join(secrets.pieces(parts)) == data and all(p.decode() and p.count(b"token") == p.count(b"token = abcdef%20") for p in secrets.pieces(parts))


def tarred(data):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as made:
        member = tarfile.TarInfo("settings.txt")
        member.size = len(data)
        made.addfile(member, io.BytesIO(data))
    return out.getvalue()


@pytest.mark.parametrize(
    "data",
    [
        gzip.compress(tarred(SECRET.encode())),
        tarred(SECRET.encode()),
        ("café\n" + SECRET).encode("latin-1"),
        gzip.compress(("café\n" * 300_000 + SECRET).encode("latin-1")),
        bytes(range(1, 32)) * 200 + b"token=abcdef\n",
        gzip.compress(b"\xff" + coded(gzip.compress(b"\0" * 9000 + SECRET.encode())).encode()),
    ],
    ids=["tar in gzip", "tar", "latin-1", "latin-1 in gzip", "control characters", "twice"],
)
def test_secrets_in_layers_that_are_not_text(data):
    text = f"before {coded(data)} after"
    assert secrets.redacted(text, secrets.all_spans(text)[1]) == "before [SECRET] after"
