"""Exact Jaccard self-join of documents' word shingles by PartEnum signatures.

Sets of nearly one size are compared: instance j takes the sets of sizes from 0.8 * 2**j up to 2**(j + 1), so every pair that can link meets in the
instance of its larger set. There the domain of shingles is cut into partitions by hash. Two linked sets of sizes a and b differ in at most
k = (a + b) / 9 shingles (for a similarity of 0.8), so of any k + 1 partitions in which a set has shingles at least one is the same in both. A set enumerates
its first k + 1 such partitions, and a twentieth of its size more, in one fixed order; what it has in each of them makes a signature. As each set goes on until
it has so many that aren't empty, the shorter of two enumerations is a common prefix of both, and a linked pair shares at least 1 + size / 20 signatures in it.

Shingles of a common passage would make signatures that many unlinked documents share. Shingles in a fixed share of all documents are
counted first; they have partitions of their own that come last in the order. Any set of such shingles keeps the join exact, so it is
bounded and broadcast.

Signatures are dealt into bins by their hash, packed, each with the id of its set (equal sets have one id, so copies cost nothing). Signatures that many sets of one task have are
settled in the task, and two of their sets stand for them in the bin. In a bin, the sets of one
signature make all pairs if they are few; if they are many, pairs with two of them and between neighbours, and after components
are known, each member outside the largest component of such groups is compared with all members, block by block; members of whose shingles too few stand in another component
are left out of that, as none can link to one of them. So no link that could join two components
is missed, while a group of near copies makes no quadratic number of pairs. A pair goes on only if the signatures counted for it, and those of large groups
that it may share, can reach the number that a link needs. What is left is verified on whole texts.

Hashing deals shingles into partitions, so a set may have fewer non-empty partitions than it must enumerate. That is rare enough never to be seen, but it is
looked for: a task that meets such a set says so, and all signatures are made anew with another seed.

Empty and null texts, and texts without words, have no shingles and no links: each is a component of its own. Repeated doc_ids count as one
document: each row is returned, with the component of its own text. A row whose doc_id is null links with nothing, and its component_id is null. Further columns
play no part. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.llm.common import durable, filtered, give_back, mixed, release, slices, texts, tidy, utf8
from rillflow.llm.components import components, redealt
from rillflow.llm.shingles import U, set_id, shingle_sets

WIDTH = 5
PERCENT = 80
#: A shingle in this share of the documents is frequent; at most so many are told apart.
FREQUENT = 0.0025
MOST_FREQUENT = 200_000
#: Shingles or signatures that a task gathers before it counts or deals them.
HOLD = 600_000
#: Shingles of documents for one bin of signatures; there are about a third as many signatures.
SHINGLES_A_BIN = 1_200_000
#: Sets of one signature that make all pairs.
FEW = 12
#: Documents of a cluster that are compared at once with as many others.
BLOCK = 512
#: One more signature for so many shingles; the more a linked pair is sure to share, the fewer others pass.
SPARE = 20
SMALL = 6


def profile(docs: DataFrame) -> DataFrame:
    """(doc_id, n, set_id, frequent, text_key): a row for each document, and rows whose ``frequent`` lists (hash, count) of shingles that are frequent in a part."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        seen: set[int] = set()

        def row(doc_ids, n, ids, frequent, keys):
            return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.int64()), pa.array(frequent, pa.binary()), pa.array(keys, pa.int64())], names=["doc_id", "n", "set_id", "frequent", "text_key"])

        def counted():
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            many = counts >= max(4, math.ceil(FREQUENT * len(held)))
            return row([None], [None], [None], [np.concatenate([values[many], counts[many].astype(U)]).tobytes()], [None]) if many.any() else None

        size = 0
        for batch in slices(batches):
            sets = shingle_sets(*utf8(batch.column("text")), WIDTH)
            ids = [set_id(s) for s in sets]
            for s, i in zip(sets, ids, strict=True):
                if len(s) and i not in seen:
                    seen.add(i)
                    held.append(s)
                    size += len(s)
            yield row(batch.column("doc_id"), [len(s) for s in sets], ids, [None] * len(sets), batch.column("text_key"))
            if size > HOLD:
                if (found := counted()) is not None:
                    yield found
                held, size = [], 0
                seen.clear()
        if held and (found := counted()) is not None:
            yield found

    return texts(docs).withColumn("text_key", F.xxhash64("text")).mapInArrow(run, "doc_id long, n long, set_id long, frequent binary, text_key long")


def frequent_shingles(profiles: DataFrame, rows: int) -> np.ndarray:
    """Sorted hashes of the shingles in many documents; at most MOST_FREQUENT of them, the most frequent."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                values, counts = np.frombuffer(data, np.int64).reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(counts)], names=["h", "c"])

    counted = profiles.where("frequent is not null").select("frequent").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
    chosen = counted.where(F.col("c") >= max(8, FREQUENT * rows)).orderBy(F.desc("c"), "h").limit(MOST_FREQUENT).select("h")
    return np.sort(chosen.toPandas()["h"].to_numpy(np.int64).view(U))


def instances(n: int) -> Iterator[tuple[int, int, int]]:
    """(instance, partitions, signatures to enumerate) for a set of n shingles."""
    top = n.bit_length() - 1
    for j in (top, top + 1):
        least, most = math.ceil(PERCENT * (1 << j) / 100), (1 << (j + 1)) - 1
        if n < least:
            continue
        partner = min(n * 100 // PERCENT, most)
        differ = (n + partner) * (100 - PERCENT) // (100 + PERCENT)
        yield j, (1 << 20 if j < SMALL else (21 << (j + 1)) // 50), differ + 1 + n // SPARE


def signatures(shingles: np.ndarray, frequent: np.ndarray, seed: int = 0) -> np.ndarray | None:
    """The signatures of one set, of all its instances; None if it has too few non-empty partitions."""
    h = (mixed(shingles + U(seed)) if seed else shingles) >> U(1)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)
        common = frequent[at] == shingles
        h = np.where(common, h | U(1 << 63), h)
    h = np.sort(h)
    codes, out = mixed(h + U(0x51ED270B)), []
    for j, partitions, wanted in instances(len(shingles)):
        part = ((h >> U(32)) * U(2 * partitions)) >> U(32)
        first = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1])
        if len(first) < wanted:
            return None
        sums = np.add.reduceat(codes, first)[:wanted]
        out.append(mixed(sums + part[first[:wanted]] * U(0x9E3779B97F4A7C15) + U(j << 40 | 1)))
    return np.concatenate(out)


def signature_bins(docs: DataFrame, frequent: np.ndarray, bins: int, seed: int) -> DataFrame:
    """(bin, sigs, sets, large, known): the signatures of all distinct sets, dealt by their high bits; low bits, set ids and marks are packed. Bin -1: a set had too few partitions.

    A signature that many sets of one task have is settled there: its pairs and members are in ``known``, and only two of its sets go on to the bin, marked as of a large group.
    So a bin gets two sets from a task of a signature that a share of all sets have, and the number of tasks bounds it, not the number of sets.
    """
    shift = U(64 - bins.bit_length() + 1)
    shared, few, hold = docs.sparkSession.sparkContext.broadcast(frequent), FEW, HOLD

    def batch(bins_: list, columns: dict[str, list]) -> pa.RecordBatch:
        empty = [b""] * len(bins_)
        return pa.RecordBatch.from_arrays([pa.array(bins_, pa.int64()), *[pa.array(columns.get(c, empty), pa.binary()) for c in ("sigs", "sets", "large", "known")]], names=["bin", "sigs", "sets", "large", "known"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        seen: set[int] = set()
        held: list[np.ndarray] = []
        names: list[np.ndarray] = []

        def dealt() -> Iterator[pa.RecordBatch]:
            sigs, sets = np.concatenate(held), np.concatenate(names)
            order = np.lexsort((sets, sigs))
            sigs, sets = sigs[order], sets[order]
            box = (sigs >> shift).astype(np.int64) if bins > 1 else np.zeros(len(sigs), np.int64)
            first = np.flatnonzero(np.concatenate([[True], sigs[1:] != sigs[:-1]]))
            sizes = np.diff(np.concatenate([first, [len(sigs)]]))
            many = np.flatnonzero(sizes > few)
            large = np.repeat(sizes > few, sizes)
            if len(many):
                rows = [sets[a : a + n] for a, n in zip(first[many].tolist(), sizes[many].tolist(), strict=True)]
                found = spread(rows, box[first[many]] << 32 | sigs[first[many]].astype(np.uint32).astype(np.int64))
                yield batch([int(sets[0]) % bins], {"known": [np.stack(found).tobytes()]})
                go = ~large
                go[first[many]] = go[first[many] + sizes[many] // 2] = True
                sigs, sets, box, large = sigs[go], sets[go], box[go], large[go]
            low = sigs.astype(np.uint32)
            at = [*np.flatnonzero(np.concatenate([[True], box[1:] != box[:-1]])).tolist(), len(box)]
            pieces = lambda x: [x[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)]
            yield batch(box[at[:-1]].tolist(), {"sigs": pieces(low), "sets": pieces(sets), "large": pieces(large)})

        size = 0
        for part in slices(batches):
            for s in shingle_sets(*utf8(part.column("text")), WIDTH):
                if not len(s):
                    continue
                name = set_id(s)
                if name in seen:
                    continue
                seen.add(name)
                if (made := signatures(s, known, seed)) is None:
                    yield batch([-1], {})
                    continue
                held.append(made)
                names.append(np.full(len(held[-1]), name, np.int64))
                size += len(held[-1])
            if size > hold:
                yield from dealt()
                held, names, size = [], [], 0
        if held:
            yield from dealt()

    return texts(docs).mapInArrow(run, "bin long, sigs binary, sets binary, large binary, known binary")


def counted_pairs(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    first = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])) if len(x) else np.zeros(0, np.int64)
    return x[first], y[first], np.diff(np.concatenate([first, [len(x)]]))


def tabled(x: np.ndarray, y: np.ndarray, group: np.ndarray, member: np.ndarray) -> np.ndarray:
    """Rows x, y, shared, group of the pairs, counted, then of the members of large groups, whose count is 0; a pair's group is -1."""
    x, y, shared = counted_pairs(x, y)
    return np.stack([np.concatenate([x, group * 0]), np.concatenate([y, member]), np.concatenate([shared, group * 0]), np.concatenate([x * 0 - 1, group])])


def spread(rows: list[np.ndarray], groups: np.ndarray) -> np.ndarray:
    """``tabled`` of large groups: pairs with two of the sets and between neighbours. The sets of a group ascend."""
    left, right = [], []
    for r in rows:
        middle = len(r) // 2
        for a, b in ((np.full(len(r) - 1, r[0]), r[1:]), (r[:middle], np.full(middle, r[middle])), (np.full(len(r) - middle - 1, r[middle]), r[middle + 1 :]), (r[:-1], r[1:])):
            left.append(a)
            right.append(b)
    return tabled(np.concatenate(left), np.concatenate(right), np.repeat(groups, [len(r) for r in rows]), np.concatenate(rows))


def grouped(table: pa.Table, most: int) -> pa.Table:
    """The pairs (x, y) of one bin's signatures and how many they share, and, with group not null, the members y of groups of more than ``most``, too large for all pairs. Of bin -1, a mark."""
    box = table.column("bin")[0].as_py()
    if box < 0:
        return pa.table({c: pa.array([-1 if c == "shared" else None], pa.int64()) for c in ("x", "y", "shared", "group")})
    sigs, sets, large = (np.frombuffer(b"".join(table.column(c).to_pylist()), kind) for c, kind in (("sigs", np.uint32), ("sets", np.int64), ("large", bool)))
    order = np.lexsort((large, sets, sigs))
    sigs, sets, large = sigs[order], sets[order], large[order]
    last = np.flatnonzero(np.concatenate([(sigs[1:] != sigs[:-1]) | (sets[1:] != sets[:-1]), [True]])) if len(sigs) else np.zeros(0, np.int64)
    sigs, sets, large = sigs[last], sets[last], large[last]  # of equal entries one that is marked, if any is
    first = np.flatnonzero(np.concatenate([[True], sigs[1:] != sigs[:-1]])) if len(sigs) else np.zeros(0, np.int64)
    sizes = np.diff(np.concatenate([first, [len(sigs)]]))
    marked = np.logical_or.reduceat(large, first) if len(first) else np.zeros(0, bool)
    few = (sizes <= most) & ~marked
    found = [np.frombuffer(data, np.int64).reshape(4, -1) for data in table.column("known").to_pylist() if data]
    left, right = [], []
    for n in range(2, most + 1):
        if len(at := first[(sizes == n) & few]):
            rows = sets[at[:, None] + np.arange(n)]
            a, b = np.triu_indices(n, 1)
            left.append(rows[:, a].ravel())
            right.append(rows[:, b].ravel())
    if left:
        none = np.zeros(0, np.int64)
        found.append(tabled(np.concatenate(left), np.concatenate(right), none, none))
    if len(many := np.flatnonzero(~few)):
        found.append(spread([sets[a : a + n] for a, n in zip(first[many].tolist(), sizes[many].tolist(), strict=True)], int(box) << 32 | sigs[first[many]].astype(np.int64)))
    x, y, shared, group = np.concatenate(found, 1) if found else np.zeros((4, 0), np.int64)
    member = group >= 0
    return pa.table({"x": pa.array(x), "y": pa.array(y), "shared": pa.array(shared), "group": pa.array(group, mask=~member)})


def candidates(docs: DataFrame, frequent: np.ndarray, shingles: int) -> DataFrame:
    bins, most = 1 << max(0, math.ceil(shingles / SHINGLES_A_BIN) - 1).bit_length(), FEW
    for seed in range(64):
        found = durable(signature_bins(docs, frequent, bins, seed).groupBy("bin").applyInArrow(tidy(lambda table: grouped(table, most)), "x long, y long, shared long, group long"))
        if found.where("shared < 0").isEmpty():
            return found
    raise RuntimeError("no seed gives every set enough partitions")


def zipped(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, packed): of at least the documents in ``ids`` (id), read past a filter of them, the texts, compressed for the shuffles to come."""
    keep = filtered(ids)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            batch = batch.filter(pa.array(keep(batch.column("doc_id").fill_null(-1).to_numpy())))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([machine.compress((t or "").encode()) for t in batch.column("text").to_pylist()], pa.binary())], names=["doc_id", "packed"])

    return texts(docs).mapInArrow(run, "doc_id long, packed binary")


def unzipped(machine: zstandard.ZstdDecompressor, data: bytes) -> np.ndarray:
    """The shingles of a compressed text."""
    plain = np.frombuffer(machine.decompress(data), np.uint8)
    return shingle_sets(plain, np.array([0, len(plain)]), WIDTH)[0]


def linked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows (x, y) whose texts link: 100 * intersection >= 80 * union."""
    machine = zstandard.ZstdDecompressor()
    last: tuple[bytes, np.ndarray] = b"", np.zeros(0, U)
    for batch in batches:
        keep = []
        for left, right in zip(batch.column("px").to_pylist(), batch.column("py").to_pylist(), strict=True):
            if last[0] != left:
                last = left, unzipped(machine, left)
            a, b = last[1], unzipped(machine, right)
            small, large = (a, b) if len(a) < len(b) else (b, a)
            both = 0
            if 100 * len(small) >= PERCENT * len(large) and len(small):
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                both = int((large[at] == small).sum())
            keep.append(both > 0 and 100 * both >= PERCENT * (len(a) + len(b) - both))
        yield batch.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))
    give_back()


def verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of candidate ``pairs`` (x, y) of documents, the linked ones."""
    pairs = durable(pairs.select("x", "y"))
    rows = zipped(docs, pairs.select(F.explode(F.array("x", "y")).alias("id")).distinct())
    right = rows.select(F.col("doc_id").alias("y"), F.col("packed").alias("py"))
    left = rows.select(F.col("doc_id").alias("x"), F.col("packed").alias("px"))
    return durable(pairs.join(right.hint("merge"), "y").join(left.hint("merge"), "x").select("x", "y", "px", "py").mapInArrow(linked, "x long, y long").distinct())


def needed(a, b):
    """The signatures that a linked pair of sets of sizes ``a`` and ``b`` shares at least."""
    return F.floor(F.least(a, b) / SPARE) + 1


def described(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, component, packed) with each text's set_id and its number n of shingles."""
    machine = zstandard.ZstdDecompressor()
    for batch in batches:
        sets = [unzipped(machine, data) for data in batch.column("packed").to_pylist()]
        more = [pa.array([set_id(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64())]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc", "component", "packed")), *more], names=["doc", "component", "packed", "set_id", "n"])
    give_back()


def spelled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, set_id, component, h): a row for each shingle."""
    machine = zstandard.ZstdDecompressor()
    for batch in batches:
        for part in slices([batch], column="packed"):
            sets = [unzipped(machine, data) for data in part.column("packed").to_pylist()]
            times = [len(s) for s in sets]
            columns = [pa.array(np.repeat(part.column(c).to_numpy(), times)) for c in ("doc", "set_id", "component")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate(sets).view(np.int64))], names=["doc", "set_id", "component", "h"])


def connectable(texts_of: DataFrame) -> DataFrame:
    """Of the texts (doc, component, packed, set_id, n), those that have PERCENT of their shingles, at least, in common with other components taken together: no other can link to one of them."""
    cells = texts_of.mapInArrow(spelled, "doc long, set_id long, component long, h long")
    lone = cells.groupBy("h").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least = most").select(redealt("h"))
    own = cells.join(lone.hint("merge"), "h").groupBy("doc", "set_id").agg(F.count(F.lit(1)).alias("lone"))
    kept = texts_of.join(own.hint("merge"), ["doc", "set_id"], "left").where(100 * (F.col("n") - F.coalesce("lone", F.lit(0))) >= PERCENT * F.col("n"))
    return kept.select(texts_of.columns)


def mixed_groups(members: DataFrame) -> DataFrame:
    """The rows (group, doc, component) of groups that have several components, with the least doc of the group as its ``head``."""
    several = members.groupBy("group").agg((F.min("component") < F.max("component")).alias("several"), F.min("doc").alias("head")).where("several").select(redealt("group"), "head")
    return durable(members.join(several.hint("merge"), "group"))


def clusters(docs: DataFrame, members: DataFrame, labels: DataFrame) -> DataFrame | None:
    """(super, doc, component, packed, minor, blocks, minor_blocks): large groups that span several components, those with documents in common made one; None if there are none.

    Groups meet in documents, so clusters grow faster than the table, and comparing all with all in them would cost its square. But most of their documents share just a passage: those that can't link to another component,
    whatever they are compared with, go first, again and again while at least one in ten goes, and what is left falls into small clusters.

    ``minor``: the document isn't of the cluster's largest component. Block counts are those of all its documents and of its minor ones.
    """
    named = members.join(labels.withColumnRenamed("node", "doc").hint("merge"), "doc", "left").select("group", "doc", F.coalesce("component", "doc").alias("component"))
    touching = mixed_groups(named)
    if touching.isEmpty():
        return None
    parts = touching.select("doc", "component").distinct()
    rows = zipped(docs, parts.select(F.col("doc").alias("id")))
    able = durable(parts.join(rows.withColumnRenamed("doc_id", "doc").hint("merge"), "doc").select("doc", "component", "packed").mapInArrow(described, "doc long, component long, packed binary, set_id long, n long").dropDuplicates(["doc", "set_id"]))
    before = able.count()
    while True:
        able = durable(connectable(able))
        if not (left := able.count()):
            return None
        if 10 * left > 9 * before:
            break
        before = left
    touching = mixed_groups(touching.drop("head").join(able.select("doc").distinct().hint("merge"), "doc"))
    if touching.isEmpty():
        return None
    heads = touching.where("doc <> head").select(F.col("head").alias("x"), F.col("doc").alias("y"))
    of = components(heads).select(F.col("node").alias("doc"), F.col("component").alias("super"))
    of_super = durable(able.join(of.hint("merge"), "doc").select("super", "doc", "component", "packed"))
    sizes = of_super.groupBy("super", "component").agg(F.count(F.lit(1)).alias("size"))
    main = sizes.groupBy("super").agg(F.max_by("component", F.struct("size", "component")).alias("main"), F.sum("size").alias("all"), F.max("size").alias("largest"))
    block = lambda c: F.ceil(c / BLOCK).cast("int")
    main = main.where("all > largest").select(redealt("super"), "main", block(F.col("all")).alias("blocks"), block(F.col("all") - F.col("largest")).alias("minor_blocks"))
    return durable(of_super.join(main.hint("merge"), "super").withColumn("minor", F.col("component") != F.col("main")).drop("main"))


def block_links(left: pa.Table, right: pa.Table) -> pa.Table:
    """Of a block of minor documents and a block of any, a link from each minor one to each other component that it links to."""
    machine = zstandard.ZstdDecompressor()

    def side(table: pa.Table):
        sets = [unzipped(machine, data) for data in table.column("packed").to_pylist()]
        sizes = np.array([len(x) for x in sets], np.int64)
        return table.column("doc").to_numpy(), table.column("component").to_numpy(), sizes, np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)

    empty = pa.table({"x": pa.array([], pa.int64()), "y": pa.array([], pa.int64())})
    if not (left.num_rows and right.num_rows):
        return empty
    (da, ca, na, fa, ia), (db, cb, nb, fb, ib) = side(left), side(right)
    common = np.intersect1d(fa, fb)
    both = np.zeros((len(da), len(db)), np.float32)
    if len(common):
        pa_, pb_ = np.searchsorted(common, fa), np.searchsorted(common, fb)
        pa_, pb_ = np.minimum(pa_, len(common) - 1), np.minimum(pb_, len(common) - 1)
        ka, kb = common[pa_] == fa, common[pb_] == fb
        pa_, ia, pb_, ib = pa_[ka], ia[ka], pb_[kb], ib[kb]
        oa, ob = np.argsort(pa_, kind="stable"), np.argsort(pb_, kind="stable")
        pa_, ia, pb_, ib = pa_[oa], ia[oa], pb_[ob], ib[ob]
        for at in range(0, len(common), 4096):
            x, y = slice(*np.searchsorted(pa_, [at, at + 4096])), slice(*np.searchsorted(pb_, [at, at + 4096]))
            width = min(4096, len(common) - at)
            a, b = np.zeros((len(da), width), np.float32), np.zeros((len(db), width), np.float32)
            a[ia[x], pa_[x] - at] = 1
            b[ib[y], pb_[y] - at] = 1
            both += a @ b.T
    shared = both.astype(np.int64)
    good = (shared > 0) & (100 * shared >= PERCENT * (na[:, None] + nb[None, :] - shared)) & (ca[:, None] != cb[None, :])
    xs, ys = [], []
    for i in np.flatnonzero(good.any(1)):
        js = np.flatnonzero(good[i])
        _, first = np.unique(cb[js], return_index=True)
        ys.append(db[js[first]])
        xs.append(np.full(len(first), da[i]))
    return pa.table({"x": np.concatenate(xs), "y": np.concatenate(ys)}) if xs else empty


def cluster_links(full: DataFrame) -> DataFrame:
    """Links between components of one cluster: every minor document against all, block by block."""
    spread = lambda c: F.pmod(F.xxhash64("doc"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    columns = ["super", "a", "b", "doc", "component", "packed"]
    minor = full.where("minor").withColumn("a", spread("minor_blocks")).withColumn("b", every("blocks")).select(columns)
    other = full.withColumn("b", spread("blocks")).withColumn("a", every("minor_blocks")).select(columns).toDF(*columns)
    return durable(minor.groupBy("super", "a", "b").cogroup(other.groupBy("super", "a", "b")).applyInArrow(tidy(block_links), "x long, y long"))


def join(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, text_key): the size of every document's shingle set and the smallest doc_id that links lead to. ``text_key``: a hash of the text."""
    profiles = durable(profile(docs))
    base = profiles.where("frequent is null")
    rows, shingles = base.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    frequent = frequent_shingles(profiles, max(1, rows))
    found = candidates(docs, frequent, shingles)
    release(docs.sparkSession)
    members = found.where("group is not null").select(F.col("y").alias("set_id"), "group").distinct()
    reps = base.where("n > 0 and doc_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"))
    sets = durable(reps.join(members.groupBy("set_id").agg(F.count(F.lit(1)).alias("large")).hint("merge"), "set_id", "left").fillna(0, ["large"]))
    of = lambda c: sets.select(F.col("set_id").alias(c), F.col("rep").alias(f"d{c}"), F.col("n").alias(f"n{c}"), F.col("large").alias(f"l{c}")).hint("merge")
    shared = found.where("group is null").groupBy("x", "y").agg(F.sum("shared").alias("shared"))
    likely = shared.join(of("x"), "x").join(of("y"), "y").where(F.col("shared") + F.least("lx", "ly") >= needed(F.col("nx"), F.col("ny")))
    links = verified(docs, likely.select(F.least("dx", "dy").alias("x"), F.greatest("dx", "dy").alias("y")))
    labels = components(links)
    viable = members.join(sets.hint("merge"), "set_id").where(F.col("large") >= F.floor(F.floor(F.col("n") * PERCENT / 100) / SPARE) + 1).select("group", F.col("rep").alias("doc"), "n", "large")
    found = clusters(docs, viable, labels)
    if found is not None and not (further := cluster_links(found)).isEmpty():
        labels = components(labels.select(F.col("node").alias("x"), F.col("component").alias("y")).union(further))
    named = sets.select("set_id", "rep").join(labels.hint("merge"), F.col("rep") == F.col("node"), "left").select("set_id", F.coalesce("component", "rep").alias("c"))
    own = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("c")).otherwise(F.col("doc_id"))
    return base.join(named.hint("merge"), "set_id", "left").select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), "text_key")
