"""Each stage of the corpus pipeline, and the whole of it, against plain Python on a small fixture; hard inputs to every stage."""

import math
import random
import zlib

import pytest
from test_duplicates import brute_components, brute_lines, shingles
from test_texts import WORDS, plain, plain_spans

import corpus_pipeline as P
from rillflow.llm import queries, secrets, toxicity

KIND = "doc_id long, text string, lang string, source string, n_chars long"
MASK = (1 << 64) - 1


def prose(rng, n):
    return " ".join("".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with toxic ones, repeated and near lines, near copies, secrets, null and empty texts and ids, and their labels."""
    rng = random.Random(21)
    rude, kind = ["dunderhead", "blighter", "numbskull", "scoundrel"], ["garden", "harbour", "window", "letter"]
    rows, labels = [], []
    for k in range(140):
        words = prose(rng, rng.randrange(30, 60)).split()
        toxic = k % 4 == 0
        for _ in range(8):
            words.insert(rng.randrange(len(words)), rng.choice(rude if toxic else kind))
        at = len(words) // 2
        rows.append((k, " ".join(words[:at]) + "\n" + " ".join(words[at:])))
        labels.append((k, k % 7 > 0, toxic))
    good = [r for r in rows if r[0] % 4]
    rows += [(200 + k, t) for k, (_, t) in enumerate(good[:6])]  # exact copies
    rows += [(220 + k, t.replace("\n", " ") + f" end{k}") for k, (_, t) in enumerate(good[6:12])]  # near copies of other lines
    rows += [(240 + k, t[:9] + "Z" + t[9:] + f"\nown line {k} {prose(rng, 5)}") for k, (_, t) in enumerate(good[12:16])]  # near lines
    rows += [(260 + k, f"{prose(rng, 12)}\npassword: hunter{k}22 and AKIA{'Q' * 18}\n{prose(rng, 9)} {'0123456789abcdef' * 2}") for k in range(5)]
    rows += [(300, None), (301, ""), (302, " \n\t"), (None, prose(rng, 20)), (None, None), (303, prose(rng, 6000)), (1, good[0][1])]
    top = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], KIND).repartition(3).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(i, int(q), int(t)) for i, q, t in labels], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    return str(top)


def mixed(x):
    x ^= x >> 32
    x = x * 0x9FB21C651E98DF25 & MASK
    x ^= x >> 29
    x = x * 0xD6E8FEB86659FD93 & MASK
    return x ^ x >> 32


def features(text):
    """Hashed counts of the words and beginnings of words of one text, word by word."""
    data = bytearray((text or "").encode())
    for k in range(1, len(data)):
        if data[k - 1] == 0xC3 and 0x80 <= data[k] <= 0x9E and data[k] != 0x97:
            data[k] += 0x20
    words, word = [], bytearray()
    for b in [*data, 0x20]:
        if toxicity.LETTER[b]:
            word.append(b)
        elif word:
            words.append(bytes(word))
            word = bytearray()
    counts = {}
    for w in words:
        for size in (0, *(n for n in toxicity.BEGINNINGS if len(w) > n)):
            total = sum(int(toxicity.CODES[b]) * pow(0x2545F4914F6CDD1D, k, 1 << 64) for k, b in enumerate(w[:size] if size else w)) & MASK
            at = mixed((total + size) & MASK) >> 64 - toxicity.BITS
            counts[at] = counts.get(at, 0) + 1
    return counts


def is_toxic(text, chain):
    counts, before = features(text), []
    for model in chain.models:
        scaled = {k: math.log1p(n) * float(model.scale[k]) for k, n in counts.items()}
        size = max(1e-12, math.sqrt(sum(v * v for v in scaled.values())))
        z = sum(v / size * float(model.weights[k]) for k, v in scaled.items()) + sum(p * float(w) for p, w in zip(before, model.extra, strict=True)) + model.bias
        before.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
    return before[-1] >= chain.models[-1].threshold


def key(rows):
    return sorted(((r[0], r[1]) for r in rows), key=repr)


def plain_stage(name, rows, chain):
    """The rows (doc_id, text) that a stage keeps."""
    if name == "toxicity":
        return [r for r in rows if not is_toxic(r[1], chain)]
    if name == "line_dedup":
        ids = {None: 1 << 62}
        named = [(ids.get(i, i), t) for i, t in rows]
        first = {}
        for i, t in sorted(named, key=lambda r: r[0]):
            for k, line in enumerate((t or "").split("\n")):
                if s := line.strip(" \t\v\f\r"):
                    first.setdefault(s, (i, k))
        out = []
        for (i, t), (_, cut) in zip(sorted(named, key=repr), brute_lines(named), strict=True):
            if t is None:
                out.append((i, None))
                continue
            near = {line.strip(" \t\v\f\r") for line in t.split("\n")} - {line.strip(" \t\v\f\r") for line in cut.split("\n")}
            kept = [line for k, line in enumerate(t.split("\n")) if not (s := line.strip(" \t\v\f\r")) or (len(s) >= 20 and s not in near) or (len(s) < 20 and first[s] == (i, k))]
            if len(kept) == len(t.split("\n")) or "\n".join(kept).strip():
                out.append((i, "\n".join(kept)))
        return [(None if i == 1 << 62 else i, t) for i, t in out]
    if name == "near_duplicates":
        known = [r for r in rows if r[0] is not None]
        parts = {}
        for row in known:  # rows of one doc_id with different texts stand for themselves
            parts.setdefault((row[0], shingles(row[1])), row)
        assert len({i for i, _ in parts}) == len(parts)
        component = {i: c for i, _, c in brute_components(known)}
        return [r for r in rows if r[0] is None or component[r[0]] == r[0]]
    return [(i, None if t is None else secrets.redacted(t, plain_spans(t))) for i, t in rows]


def test_stages_against_plain_python(spark, folder):
    docs = queries.table(spark, folder, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    dropped = {}
    for name, stage in P.STAGES[:-1]:
        chain = queries.toxicity_chain(spark, docs, folder) if name == "toxicity" else None
        want = plain_stage(name, rows, chain)
        found = stage(spark, docs, folder).collect()
        assert key(found) == key(want), name
        assert all(r.n_chars == (None if r.text is None else len(r.text)) and r.lang == "en" for r in found)
        dropped[name] = (len(rows) - len(want), sum(a != b for a, b in zip(key(rows), key(want), strict=False)))
        rows = want
        docs = spark.createDataFrame([tuple(r) for r in found], KIND)
    assert 25 <= dropped["toxicity"][0] <= 60 and dropped["line_dedup"][0] >= 6 and dropped["near_duplicates"][0] >= 6 and dropped["secrets"][1]
    model, pieces = plain(WORDS), {}
    ids = sorted([*model.encode(t or "", add_special_tokens=False).ids, 2] for _, t in rows)
    found = P.STAGES[-1][1](spark, docs, folder).collect()
    for r in P.run(spark, folder).collect():
        pieces[r.sequence_id] = pieces.get(r.sequence_id, 0) + r.length
    assert sum(r.length for r in found) == sum(map(len, ids)) == sum(pieces.values()) and max(pieces.values()) <= 4096
    whole = sorted(zlib.crc32(b"".join(x.to_bytes(4, "little") for x in i)) for i in ids if len(i) < 256)
    assert sorted(r.ids_crc32 for r in found if r.length == r.doc_tokens < 256) == [c for c in whole if c in {r.ids_crc32 for r in found if r.length == r.doc_tokens}]


@pytest.mark.parametrize("name, stage", P.STAGES)
def test_stages_take_empty_tables_and_further_columns(spark, folder, name, stage):
    docs = queries.table(spark, folder, "documents")
    assert stage(spark, docs.limit(0), folder).count() == 0
    clash = docs.limit(40).selectExpr("*", "1 as bin", "'x' as _n_removed", "2 as _doc", "3 as p_toxic", "'y' as is_toxic", "4 as set_id", "5 as component_id", "6 as text_key", "7 as copy")
    out = stage(spark, clash, folder)
    assert out.count() > 0
    if name != P.STAGES[-1][0]:
        assert tuple(out.columns) == P.COLUMNS


def test_intermediate_tables_are_removed(spark, folder):
    from rillflow.llm.common import checkpoint_dir

    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(checkpoint_dir(spark))
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    P.run(spark, folder).count()
    assert not [s for s in files.listStatus(path) if "corpus-pipeline" in str(s.getPath())]
