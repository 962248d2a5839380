"""Duplicate operators against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from rillflow.llm import jaccard, lines, substrings, suffixes
from rillflow.llm.components import components, stars_of

LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def brute_components(rows):
    ids = sorted({i for i, _ in rows})
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return sorted((i, len(sets[i]), root(i)) for i, _ in rows)


def test_jaccard_join(docs, empty, hard_texts):
    assert sorted(map(tuple, jaccard.join(docs).drop("text_key").collect())) == brute_components(hard_texts)
    assert jaccard.join(empty).count() == 0


@pytest.mark.parametrize("hold", [600_000, 300])
def test_jaccard_join_of_a_large_ragged_group(spark, monkeypatch, hold):
    """More near copies than make all pairs, many on either side of the threshold; settled in one piece of a task or in many."""
    monkeypatch.setattr(jaccard, "FEW", 3)
    monkeypatch.setattr(jaccard, "HOLD", hold)
    rng = random.Random(3)
    words = [f"w{rng.randrange(5000)}" for _ in range(90)]
    rows = []
    for k in range(90):
        changed = list(words)
        for _ in range(rng.randrange(0, 3)):
            changed[rng.randrange(90)] = f"x{rng.randrange(10**6)}"
        rows.append((k * 3 + 1, " ".join(changed)))
    rows += [(500 + k, f"p{k} q{k} " + " ".join(words[:20]) + f" r{k} s{k} " * (k % 7 + 9)) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, jaccard.join(df).drop("text_key").collect())) == brute_components(rows)


def test_jaccard_join_compares_only_what_can_link(spark, monkeypatch):
    """Texts that share a passage of less than four fifths go before blocks are compared; a chain of near copies among them stays whole."""
    monkeypatch.setattr(jaccard, "FEW", 3)
    rng = random.Random(8)
    drawn = lambda n, top: [f"w{rng.randrange(top)}" for _ in range(n)]
    passage = drawn(72, 5000)
    rows = [(k, " ".join(passage + drawn(26, 10**9))) for k in range(80)]
    chain = passage + drawn(200, 10**9)
    for k in range(100, 130):
        at = 72 + 6 * (k - 100)
        chain[at : at + 6] = drawn(6, 10**9)
        rows.append((k, " ".join(chain)))
    compared, of = [], jaccard.clusters

    def clusters(*args):
        found = of(*args)
        compared.append(0 if found is None else found.where("doc < 100").count())
        return found

    monkeypatch.setattr(jaccard, "clusters", clusters)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, jaccard.join(df).drop("text_key").collect())) == brute_components(rows)
    assert compared == [0]


def test_short_texts_link_when_equal(spark):
    rows = [(1, "a b c"), (2, "A b  c"), (3, "a b"), (4, "a b c d e"), (5, "a b c d e f"), (6, "a b c d e")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard.join(df).drop("text_key").collect())) == brute_components(rows)


@pytest.mark.parametrize("most", [1 << 27, 1 << 12, 1 << 11, 1 << 10])
def test_filters_keep_what_is_there(spark, monkeypatch, most):
    from rillflow.llm import common

    monkeypatch.setattr(common, "MOST_FILTER_BITS", most)
    keep = common.filtered(spark.range(0, 6000, 3))
    passed = keep(np.arange(6000))
    assert passed[::3].all() and (passed.mean() < 0.36 if most > 1 << 12 else True) and (passed.all() if most < 2000 else not passed.all() or most < 2100)


def test_null_ids_link_with_nothing(spark):
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (None, ""), (9, "A b c d e f"), (None, None)]
    found = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).drop("text_key").collect()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, [(None, 2, None), (3, 2, 3), (None, 0, None), (9, 2, 3), (None, 0, None)]))


def test_a_set_with_too_few_partitions_changes_the_seed(spark, monkeypatch):
    assert jaccard.signatures(np.zeros(1, np.uint64) + np.uint64(5), np.zeros(0, np.uint64)) is not None
    close = np.arange(1, 400, dtype=np.uint64)  # all in one partition
    assert jaccard.signatures(close, np.zeros(0, np.uint64)) is None
    assert jaccard.signatures(close, np.zeros(0, np.uint64), 1) is not None


@pytest.mark.parametrize("n", [1, 4, 5, 9, 31, 63, 64, 100, 500, 3000])
def test_linked_sets_share_the_signatures_they_need(n):
    rng = np.random.default_rng(n)
    for _ in range(20):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        drop = rng.integers(0, n // 9 + 1)
        b = np.unique(np.concatenate([rng.permutation(a)[drop:], rng.integers(0, 1 << 63, drop).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both < 80 * (len(a) + len(b) - both):
            continue
        frequent = np.sort(rng.permutation(a)[: n // 3])
        common = np.intersect1d(jaccard.signatures(a, frequent), jaccard.signatures(b, frequent))
        assert len(common) >= min(len(a), len(b)) // jaccard.SPARE + 1


@pytest.mark.parametrize("seed", range(4))
def test_contraction_keeps_components(seed):
    rng = np.random.default_rng(seed)
    x, y = rng.integers(0, 400, (2, 60 * (seed + 2)))
    parent = {int(n): int(n) for n in np.concatenate([x, y])}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in zip(x.tolist(), y.tolist(), strict=True):
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    found = stars_of(x, y)
    assert dict(zip(found.column("high").to_pylist(), found.column("low").to_pylist(), strict=True)) == {n: root(n) for n in parent if root(n) != n}
    assert stars_of(np.arange(3000), np.arange(1, 3001)).num_rows == 3000 and set(stars_of(np.arange(3000), np.arange(1, 3001)).column("low").to_pylist()) == {0}


@pytest.mark.parametrize("parts", [1, 60])
def test_components_of_chains_and_stars(spark, parts):
    """Gathered in few tasks, and spread over many."""
    links = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 300)] + [(7, 7)] + [(1000 + 37 * k % 501, 1000 + 37 * (k + 1) % 501) for k in range(500)]
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = {r.node: r.component for r in components(spark.createDataFrame(links, "x long, y long").repartition(5)).collect()}
        assert {found[k] for k in range(61)} == {0} and {found[k] for k in range(100, 300)} == {100} and {found[k] for k in range(1000, 1501)} == {1000} and len(found) == 61 + 200 + 501
        assert components(spark.createDataFrame([], "x long, y long")).count() == 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def brute_substrings(rows):
    first = {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        data = (t or "").encode()
        for k in range(len(data) - 49):
            first.setdefault(data[k : k + 50], i)
    out = []
    for i, t in rows:
        data = (t or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        for k in range(len(data) - 49):
            if first[data[k : k + 50]] < i:
                gone[k : k + 50] = True
        kept = bytes(b for b, g in zip(data, gone, strict=False) if not g)
        out.append((i, len(data), int(gone.sum()), int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(data) else 0, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_substrings(docs, empty, hard_texts):
    assert sorted(map(tuple, substrings.digests(docs).collect())) == brute_substrings(hard_texts)
    assert substrings.digests(empty).count() == 0


def test_substrings_of_a_hot_passage(spark, monkeypatch):
    monkeypatch.setattr(substrings, "MANY_CLASSES", 4)
    rng = random.Random(5)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = noise(120)
    rows = [(rng.randrange(1000), noise(rng.randrange(0, 60)) + passage[rng.randrange(30) : rng.randrange(80, 120)] + noise(rng.randrange(0, 60))) for _ in range(60)]
    rows = [*{i: (i, t) for i, t in rows}.values()] + [(2000, "x" * 200), (2001, "y" + "x" * 120), (2002, passage * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, substrings.digests(df).collect())) == brute_substrings(rows)


def test_substrings_of_many_bins(spark, monkeypatch):
    """What bins send to one another grows with the product of their numbers, so those of documents stay few while these are small."""
    monkeypatch.setattr(substrings, "DOCS_A_BIN", 1)
    rng = random.Random(8)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(400))
    rows = [(i, f"{i:>20}" + passage[(at := rng.randrange(340)) : at + rng.randrange(40, 90)] + f"{i * 7919:<20}") for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert substrings.removed_spans(df)[1] == 512
    assert sorted(map(tuple, substrings.digests(df).collect())) == brute_substrings(rows)


@pytest.mark.parametrize(("classes", "hot"), [(2000, 0), (20_000, 1)])
def test_runs_of_a_common_gram_are_asked_for_whole(classes, hot):
    """A larger table has more anchors of over 512 classes; their windows, sent singly, are many times the bytes of the runs."""
    columns = {"anchor": np.full(classes, 5), "content": np.arange(classes), "doc": np.arange(classes), "tag": np.zeros(classes), "start": np.zeros(classes), "windows": np.full(classes, 16)}
    rows = pa.Table.from_batches([substrings.binned([(0, 0, substrings.packed(substrings.RUN, columns))])])
    found = substrings.compared(1, 1)(rows).to_pylist()
    asked = substrings.unpacked(substrings.REQUEST, [r["data"] for r in found if r["kind"] == 2])
    assert sorted(asked["doc"].tolist()) == list(range(classes)) and set(asked["hot"].tolist()) == {hot}


def test_window_hashes():
    rng = np.random.default_rng(4)
    data = rng.integers(0, 3, 4000).astype(np.uint8)
    data[1000:1300], data[3000:3070], data[3500:] = data[:300], data[20:90], 1
    content = [data[k : k + 50].tobytes() for k in range(len(data) - 49)]
    found = suffixes.hashes(data)
    assert len(found) == len(content) and len(set(zip(found.tolist(), content, strict=True))) == len(set(content)) == len(set(found.tolist()))
    times = Counter(content)
    several = np.array([times[c] > 1 for c in content])
    assert suffixes.repeated(found)[several].all() and suffixes.repeated(found)[~several].mean() < 0.2
    assert not len(suffixes.repeated(found[:0])) and len(suffixes.hashes(data[:50])) == 1


def test_substrings_across_segments(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "SEGMENT", 300)
    rng = random.Random(6)
    long = "".join(rng.choice("abcdefgh ") for _ in range(2500))
    rows = [(1, long), (2, "zz" + long[100:2300]), (3, long[650:720])]
    assert sorted(map(tuple, substrings.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == brute_substrings(rows)


@pytest.mark.parametrize("seed", range(6))
def test_deep_shallow_sorts_suffixes(seed):
    rng = np.random.default_rng(seed)
    data = rng.integers(97, 97 + seed % 3 + 1, 2000).astype(np.uint8)
    if seed % 2:
        data = np.tile(data[:37], 60)
    at = rng.integers(0, len(data) - 49, 500)
    order, classes = suffixes.deep_shallow(data, at)
    found = [data[a : a + 50].tobytes() for a in at[order]]
    assert found == sorted(found)
    assert all((x == y) == (a == b) for x, y, a, b in zip(found, found[1:], classes, classes[1:]))


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def brute_lines(rows, least=20):
    first = {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        for k, line in enumerate((t or "").split("\n")):
            s = line.strip(" \t\v\f\r")
            if len(s) >= least:
                first[s] = min(first.get(s, (i, k)), (i, k))
    order = sorted(first, key=first.get)
    near = {s for n, s in enumerate(order) if any(one_edit(s, o) for o in order[:n])}
    out = []
    for i, t in rows:
        kept = [line for k, line in enumerate((t or "").split("\n")) if len(s := line.strip(" \t\v\f\r")) < least or s not in near and first[s] == (i, k)]
        out.append((i, None if t is None else "\n".join(kept)))
    return sorted(out, key=repr)


def test_lines(spark, docs, empty, hard_texts):
    rng = random.Random(9)
    base = ["".join(rng.choice("abcdé 😀") for _ in range(rng.randrange(18, 60))) for _ in range(30)]
    rows = list(hard_texts)
    for k in range(100, 160):
        made = []
        for _ in range(rng.randrange(1, 6)):
            s = rng.choice(base)
            p = rng.randrange(len(s))
            made.append(rng.choice([s, s, s[:p] + s[p + 1 :], s[:p] + "Z" + s[p:], s[:p] + "Y" + s[p + 1 :], "  " + s + "\t", "short", ""]))
        rows.append((k, "\n".join(made)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(((r.doc_id, r.text) for r in lines.deduplicated(df).collect()), key=repr) == brute_lines(rows)
    found = lines.deduplicated(docs)
    assert found.columns == [*docs.columns, "_n_lines", "_n_removed"] and found.count() == len(hard_texts)
    clash = docs.withColumnsRenamed({"bin": "_n_lines", "rank": "_Doc"})
    again = lines.deduplicated(clash)
    assert again.columns == [*clash.columns, "__n_lines", "_n_removed"] and {(r._n_lines, r._Doc) for r in again.collect()} == {(1, 2)}
    assert lines.deduplicated(empty).count() == 0
    with pytest.raises(ValueError):
        lines.deduplicated(docs, max_edits=2)


def test_exact_lines_only(spark):
    rows = [(1, "the same long line here\nthe same long linе here"), (2, "the same long line here\nother")]
    found = lines.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"), max_edits=0)
    assert {r.doc_id: r.text for r in found.collect()} == {1: rows[0][1], 2: "other"}


def test_short_lines_are_joined_by_equality(spark):
    long = "a line of more than twenty code points"
    rows = [(1, f"short\n{long}\n\nshorn"), (2, f"  short\n{long}!\n\nother"), (3, f"short\n\n{long}"), (4, "é\nshort\né")]
    found = lines.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), short_lines=True)
    assert {r.doc_id: (r.text, r._n_removed) for r in found.collect()} == {1: (rows[0][1], 0), 2: ("\nother", 2), 3: ("", 2), 4: ("é", 2)}
