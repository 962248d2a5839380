"""Null ids, very long texts and repeated rows through each operator on texts."""

import hashlib
import random

import numpy as np
import pytest
from test_duplicates import brute_lines
from test_texts import BYTES, WORDS, plain

from rillflow.llm import bpe, jaccard, lines, packing, secrets, sharding, substrings, toxicity

PASSAGE = "this passage of more than fifty bytes stands in several documents, word for word"


def digest(data):
    return hashlib.sha256(data.encode()).hexdigest()


@pytest.fixture(scope="module")
def null_ids(spark):
    rows = [(None, f"one {PASSAGE}"), (7, f"two {PASSAGE}"), (None, None), (None, ""), (None, f"one {PASSAGE}"), (9, "token = abcdef1 here"), (None, "token = abcdef2 here")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_null_ids_in_every_operator(spark, null_ids):
    rows, df = null_ids
    found = jaccard.join(df).collect()
    assert len(found) == 7 and all(r.component_id is None for r in found if r.doc_id is None)
    kept = lines.deduplicated(df, min_chars=20).collect()
    assert sorted(map(repr, ((r.doc_id, r.text) for r in kept))) == sorted(map(repr, ((None if i == 1 << 62 else i, t) for i, t in brute_lines([(1 << 62 if i is None else i, t) for i, t in rows]))))
    cut = substrings.digests(df).collect()  # a null id comes after all others, and rows of one id do not remove one another
    shared = f" {PASSAGE}"
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_removed) for r in cut) == sorted((i or -1, len(t or ""), len(shared) if i is None and t and t.startswith("one") else 0) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_assign) for r in secrets.scan_digests(df).collect()) == sorted((str(i), int("token" in (t or ""))) for i, t in rows)
    placed = sharding.shard(df, sharding.regular_tree(2, 2, 2)).collect()
    assert len(placed) == 7 and len({r.shard for r in placed if r.doc_id is None}) == 1
    for s in {r.shard for r in placed}:
        assert sorted(r.slot for r in placed if r.shard == s) == list(range(sum(r.shard == s for r in placed)))
    chain = toxicity.train(df, spark.createDataFrame([(7, 1), (None, 0), (9, 0)], "doc_id long, toxic int"), ["toxic"])
    assert toxicity.scored(df, chain).count() == 7
    model = plain(WORDS)
    pieces = packing.pack_documents(df, WORDS).collect()
    assert sum(r.length for r in pieces) == sum(len(model.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows) and sum(r.start == 0 for r in pieces) == 7
    assert sorted(str(r.doc_id) for r in bpe.encode_digests(df, BYTES).collect()) == sorted(str(i) for i, _ in rows)


def test_very_long_texts_in_every_operator(spark):
    rng = random.Random(17)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9)))
    made = [" ".join(word() for _ in range(12)) for _ in range(16_000)]
    long = "\n".join(made)  # over a million characters
    near = "\n".join(line if k % 40 else line + " more" for k, line in enumerate(made))
    rows = [(1, long), (2, near + "\npassword = swordfish99"), (3, "x" * 400_000), (4, made[100] + "\n" + PASSAGE)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert {r.doc_id: r.component_id for r in jaccard.join(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    found = {r.doc_id: r for r in lines.deduplicated(df).collect()}
    assert found[1]._n_removed == 0 and found[2]._n_removed == 16_000 - 400 and found[2].text.endswith("\npassword = swordfish99") and found[4].text == PASSAGE
    cut = {r.doc_id: r for r in substrings.deduplicated(df).collect()}
    starts = {long[k : k + 50] for k in range(len(long) - 49)}
    covered = np.zeros(len(rows[1][1]) + 1, int)
    for k in range(len(rows[1][1]) - 49):
        if rows[1][1][k : k + 50] in starts:
            covered[k] += 1
            covered[k + 50] -= 1
    kept = "".join(c for c, n in zip(rows[1][1], np.cumsum(covered)[:-1], strict=True) if not n)
    assert bytes(cut[2].kept).decode() == kept and cut[1].n_removed == cut[3].n_removed == 0
    spans = {r.doc_id: r for r in secrets.scan_digests(df).collect()}
    at = len(near) + 1
    assert spans[2].spans == f"assign:{at}:{at + 22}" and spans[1].spans == ""
    byte, words = plain(BYTES), plain(WORDS)
    want = {i: (len(e.ids), digest(byte.decode(e.ids, skip_special_tokens=False))) for i, e in ((i, byte.encode(t, add_special_tokens=False)) for i, t in rows if i != 3)}
    coded = {r.doc_id: (r.n_tokens, r.decoded_sha256) for r in bpe.encode_digests(df, BYTES).collect()}
    assert {i: coded[i] for i in want} == want and coded[3][1] == digest("x" * 400_000)
    lengths = {}
    for r in packing.pack_documents(df, WORDS).collect():
        lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.length
    assert lengths[1] == len(words.encode(long, add_special_tokens=False).ids) + 1 and set(lengths) == {1, 2, 3, 4}


def test_repeated_rows_in_every_operator(spark):
    rows = [(5, f"a {PASSAGE}"), (5, f"a {PASSAGE}"), (5, f"another {PASSAGE}"), (6, f"a {PASSAGE}")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert sorted((r.doc_id, r.component_id) for r in jaccard.join(df).collect()) == [(5, 5), (5, 5), (5, 5), (6, 5)]
    assert sorted((r.doc_id, r.n_removed > 0) for r in substrings.digests(df).collect()) == [(5, False), (5, False), (5, False), (6, True)]
    for found in (lines.deduplicated(df), secrets.scan_digests(df), sharding.shard(df, sharding.regular_tree(1, 1, 3)), bpe.encode_digests(df, BYTES)):
        assert sorted(r.doc_id for r in found.select("doc_id").collect()) == [5, 5, 5, 6]
