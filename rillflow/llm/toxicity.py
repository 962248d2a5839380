"""Toxicity categories by a chain of linear classifiers.

The categories have an order. The first one's logistic model sees a text's features; each later one also sees the probabilities that the models before it give. In
training, those are out-of-fold predictions: every labelled text's come from a model that never saw it, so a later model meets the same
kind of errors as in use. The decision threshold of each category is set on its out-of-fold predictions.

Features are hashed counts of the words of whole texts and of the words' beginnings, damped by a logarithm, scaled by each feature's log-count ratio in the training rows and set to
length 1. Models are fitted on a bounded sample of the labelled rows (``sample_per_class`` rows of each class of the last category, chosen by hash); scoring covers
every text and shuffles nothing. The models of a category, one without each fold and one of all rows, are fitted side by side as tasks.

Null and empty texts have no features and get the models' base rates. Labels of unknown documents and null labels are left out; of several labels of a document, the
largest counts. With no labels, or one class only, a category's probability is that class's share and nothing is rejected for it unless all labels are positive. Repeated rows are scored one by one;
further columns play no part; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.llm.common import byte_codes, free_names, give_back, mixed, slices, texts, thinned, utf8
from rillflow.llm.shingles import powers

U = np.uint64
BITS = 20
#: Bytes of a word's beginning that make a feature.
BEGINNINGS = (4, 6, 8)
SAMPLE_PER_CLASS = 2000
FOLDS = 5
FIT_TASKS = 3
MOST_FEATURES = 1 << 16
CODES = byte_codes(31)
CODES[ord("A") : ord("Z") + 1] = CODES[ord("a") : ord("z") + 1]
LETTER = np.zeros(256, bool)
LETTER[ord("a") : ord("z") + 1] = LETTER[ord("A") : ord("Z") + 1] = LETTER[0x80:] = True


def folded(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with the capital letters of Latin-1 made small."""
    upper = np.flatnonzero((data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97) & (data[:-1] == 0xC3)) + 1
    if len(upper):
        data = data.copy()
        data[upper] += 0x20
    return data


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, count), ordered by row: hashed words and beginnings of words of each text."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    data = folded(data)
    inside = LETTER[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1] | first[1:n]
    ends[:-1] &= ~inside[1:] | first[1:n]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    row = np.searchsorted(offsets, starts, "right") - 1
    up, down = powers(n)
    total = np.zeros(n + 1, U)
    np.cumsum(CODES[data] * up[:n], out=total[1:])
    rows, hashes = [row], [mixed((total[ends] - total[starts]) * down[starts])]
    for size in BEGINNINGS:
        long = ends - starts > size
        a = starts[long]
        rows.append(row[long])
        hashes.append(mixed((total[a + size] - total[a]) * down[a] + U(size)))
    key = np.concatenate(rows) << BITS | (np.concatenate(hashes) >> U(64 - BITS)).astype(np.int64)
    key, count = np.unique(key, return_counts=True)
    return key >> BITS, key & ((1 << BITS) - 1), count


@dataclass
class Rows:
    """Sparse rows: ``first`` marks where each begins in ``index`` and ``value``."""

    first: np.ndarray
    index: np.ndarray
    value: np.ndarray

    @property
    def n(self) -> int:
        return len(self.first) - 1

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(self.n, dtype=np.int32), np.diff(self.first))

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row(), self.value * weights[self.index], self.n) if len(self.index) else np.zeros(self.n)

    def unit(self) -> Rows:
        size = np.sqrt(np.bincount(self.row(), self.value**2, self.n))
        return Rows(self.first, self.index, self.value / np.maximum(size, 1e-12)[self.row()] if len(self.index) else self.value)

    def take(self, chosen: np.ndarray) -> Rows:
        sizes = np.diff(self.first)[chosen]
        at = np.repeat(self.first[:-1][chosen] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        return Rows(np.concatenate([[0], np.cumsum(sizes)]), self.index[at], self.value[at])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Linear:
    """A logistic model. ``scale``: what each feature is multiplied by before a row is set to length 1; ``extra``: weights of the dense columns."""

    scale: np.ndarray
    weights: np.ndarray
    extra: np.ndarray
    bias: float
    threshold: float = field(default=0.5)

    def score(self, rows: Rows, dense: np.ndarray) -> np.ndarray:
        scaled = Rows(rows.first, rows.index, rows.value * self.scale[rows.index]).unit()
        return scaled.times(self.weights) + dense @ self.extra + self.bias


def fit(rows: Rows, dense: np.ndarray, y: np.ndarray, weight: np.ndarray, size: int, steps: int = 120, penalty: float = 1e-4) -> Linear:
    """Weighted logistic regression on features scaled by their log-count ratios, by accelerated gradient steps."""
    total = weight.sum()
    share = float((weight * y).sum() / total) if total else 0.0
    none = Linear(np.zeros(size, np.float32), np.zeros(size, np.float32), np.zeros(dense.shape[1]), float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    if not len(rows.index) or share in (0.0, 1.0):
        return none
    at = rows.row()
    count = np.bincount(rows.index, minlength=size)
    with_y = np.bincount(rows.index, y[at], size)
    rate_y, rate_n = (with_y + 0.5) / (y.sum() + 1), (count - with_y + 0.5) / ((1 - y).sum() + 1)
    ratio = np.where(count >= 3, np.log(rate_y / rate_n), 0)
    # how sure a feature's ratio is, against chance
    sure = np.abs(ratio) * np.sqrt(count)
    if (sure > 0).sum() > MOST_FEATURES:
        ratio[sure < np.partition(sure, -MOST_FEATURES)[-MOST_FEATURES]] = 0
    scaled = Rows(rows.first, rows.index, rows.value * ratio[rows.index])
    keep = scaled.value != 0
    kept = np.concatenate([[0], np.cumsum(keep)])[scaled.first]
    scaled = Rows(kept, scaled.index[keep], scaled.value[keep]).unit()
    used = np.zeros(size, bool)
    used[scaled.index] = True
    columns, index = np.flatnonzero(used), (np.cumsum(used, dtype=np.int32) - 1)[scaled.index]
    row = scaled.row()
    del at, count, with_y, rate_y, rate_n, sure, keep, used
    w, extra, bias = np.zeros(len(columns)), np.zeros(dense.shape[1]), none.bias
    seen = w.copy(), extra.copy(), bias
    rate = 4.0 / (1.0 + 0.25 * (dense**2).sum(1).mean() if dense.size else 1.0)
    for step in range(steps):
        pull = step / (step + 3)
        wl, el, bl = w + pull * (w - seen[0]), extra + pull * (extra - seen[1]), bias + pull * (bias - seen[2])
        seen = w, extra, bias
        z = np.bincount(row, scaled.value * wl[index], scaled.n) + dense @ el + bl
        off = weight * (sigmoid(z) - y) / total
        w = wl - rate * (np.bincount(index, scaled.value * off[row], len(columns)) + penalty * wl)
        extra = el - rate * (dense.T @ off + penalty * el)
        bias = bl - rate * float(off.sum())
    weights = np.zeros(size, np.float32)
    weights[columns] = w
    return Linear(ratio.astype(np.float32), weights, extra, float(bias))


def best_threshold(p: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The probability from which on rejecting gives the best F1 on out-of-fold predictions."""
    if not len(y) or not 0 < y.sum() < len(y):
        return 0.5
    order = np.argsort(-p)
    hit, all_ = np.cumsum((weight * y)[order]), np.cumsum(weight[order])
    score = 2 * hit / (all_ + (weight * y).sum())
    best = int(np.argmax(score))
    after = p[order[best + 1]] if best + 1 < len(p) else 0.0
    return float((p[order[best]] + after) / 2)


@dataclass
class Chain:
    names: list[str]
    models: list[Linear]
    report: dict

    def predict(self, rows: Rows) -> list[np.ndarray]:
        dense, out = np.zeros((rows.n, 0)), []
        for model in self.models:
            out.append(sigmoid(model.score(rows, dense)))
            dense = np.column_stack([dense, out[-1]])
        return out


def fit_folds(spark: SparkSession, rows: Rows, dense: np.ndarray, y: np.ndarray, weight: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, Linear]:
    """The probability of each row by a model of the other folds, and a model of all rows, fitted by FIT_TASKS tasks one after the other: a fit takes some 200 MB, beside all else that a worker holds."""
    shared = spark.sparkContext.broadcast((rows, dense, y, weight, fold))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, dense, y, weight, fold = shared.value
        for batch in batches:
            for part in batch.column(0).to_pylist():
                if part == FOLDS:
                    made = fit(rows, dense, y, weight, 1 << BITS)
                else:
                    inside, outside = np.flatnonzero(fold == part), np.flatnonzero(fold != part)
                    made = fit(rows.take(outside), dense[outside], y[outside], weight[outside], 1 << BITS).score(rows.take(inside), dense[inside]) if len(inside) else np.zeros(0)
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([zlib.compress(pickle.dumps(made, 5), 1)], pa.binary())], names=["part", "made"])
                del made
                give_back()

    found = {r.part: pickle.loads(zlib.decompress(r.made)) for r in spark.range(0, FOLDS + 1, 1, FIT_TASKS).mapInArrow(run, "part long, made binary").collect()}
    shared.unpersist()
    p = np.zeros(rows.n)
    for part in range(FOLDS):
        p[fold == part] = sigmoid(found[part])
    return p, found[FOLDS]


def fit_chain(spark: SparkSession, rows: Rows, labels: np.ndarray, names: list[str], weight: np.ndarray, fold: np.ndarray) -> Chain:
    """``labels``: a column for each category; ``fold``: which part each row is predicted in by a model of the other parts."""
    dense = np.zeros((rows.n, 0))
    models, report = [], {}
    for k, name in enumerate(names):
        y = labels[:, k].astype(float)
        p, model = fit_folds(spark, rows, dense, y, weight, fold)
        model.threshold = best_threshold(p, y, weight)
        flagged = p >= model.threshold
        report[name] = {"precision": float((weight * y * flagged).sum() / max(1e-9, (weight * flagged).sum())), "recall": float((weight * y * flagged).sum() / max(1e-9, (weight * y).sum())), "rows": int(rows.n)}
        models.append(model)
        dense = np.column_stack([dense, p])
    return Chain(list(names), models, report)


def gathered(found: list[bytes]) -> Rows:
    """The rows of the sample, without the features that fewer than three of them have: no model uses those."""
    pairs = [np.frombuffer(x, "<i4").reshape(2, -1) for x in found]
    sizes = np.array([p.shape[1] for p in pairs], np.int64)
    if not sizes.sum():
        return Rows(np.zeros(len(pairs) + 1, np.int64), np.zeros(0, np.int32), np.zeros(0, np.float32))
    index, count = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
    keep = (np.bincount(index, minlength=1 << BITS) >= 3)[index]
    kept = np.concatenate([[0], np.cumsum(keep)])[np.concatenate([[0], np.cumsum(sizes)])]
    return Rows(kept, index[keep], damped(count[keep]).astype(np.float32))


def damped(count: np.ndarray) -> np.ndarray:
    return np.log1p(count)


def train(docs: DataFrame, labels: DataFrame, categories: list[str], id_col: str = "doc_id", text_col: str = "text", sample_per_class: int = SAMPLE_PER_CLASS) -> Chain:
    """A chain for the ``categories``, columns of 0 and 1 in ``labels``. The sample, and so what comes to the driver, is bounded by ``sample_per_class``."""
    names = [f"y{k}" for k in range(len(categories))]
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), *[F.col(c).cast("int").alias(n) for c, n in zip(categories, names, strict=True)]).dropna()
    known = known.groupBy("doc_id").agg(*[F.max(n).alias(n) for n in names])
    counts = {r[0]: r[1] for r in known.groupBy(F.col(names[-1]) > 0).count().collect()}
    parts = []
    for positive in (False, True):
        part = thinned(known.where((F.col(names[-1]) > 0) == F.lit(positive)), "doc_id", counts.get(positive, 0), sample_per_class)
        part = part.orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)), "doc_id").limit(sample_per_class)
        parts.append(part)
    sample = parts[0].union(parts[1])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            row, index, count = features(*utf8(batch.column("text")))
            first = np.searchsorted(row, np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[batch.column(n) for n in names], pa.array([np.concatenate([index[a:b].astype("<i4"), count[a:b].astype("<i4")]).tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary())], names=["doc_id", *names, "found"])

    texts_of = texts(docs, id_col, text_col).join(F.broadcast(sample), "doc_id").select("doc_id", *names, "text")
    got = texts_of.mapInArrow(run, "doc_id long, " + ", ".join(f"{n} int" for n in names) + ", found binary").dropDuplicates(["doc_id"]).toPandas().sort_values("doc_id")
    rows = gathered([*got.pop("found")])
    y = got[names].to_numpy(np.int64).reshape(len(got), len(names))
    y = (y > 0).astype(np.int64)
    weight = np.ones(len(got))
    for positive in (False, True):
        mask = y[:, -1] == positive
        if mask.any():
            weight[mask] = counts.get(positive, 0) / mask.sum()
    fold = (mixed(got["doc_id"].to_numpy(np.int64).astype(np.int64).view(U)) % U(FOLDS)).astype(np.int64)
    return fit_chain(docs.sparkSession, rows, y, categories, weight, fold)


def scored(docs: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs``, then a column p_<category> for each category of the chain and a column is_<category> of 0 and 1; where ``docs`` has such a name, underscores are put before the new one."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    added = free_names([f"p_{n}" for n in chain.names] + [f"is_{n}" for n in chain.names], docs.columns)
    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches, column=text_col):
            row, index, count = features(*utf8(batch.column(text_col)))
            p = model.predict(Rows(np.searchsorted(row, np.arange(batch.num_rows + 1)), index, damped(count)))
            flags = [(x >= m.threshold).astype(np.int32) for x, m in zip(p, model.models, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, p), *map(pa.array, flags)], names=[*batch.schema.names, *added])

    return docs.mapInArrow(run, ", ".join(schema + [f"`{n}` {'double' if k < len(chain.names) else 'int'}" for k, n in enumerate(added)]))
