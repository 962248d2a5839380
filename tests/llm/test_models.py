"""Vector searches against brute force; the classifier chain by held-out accuracy; the pipeline."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillflow.llm import kdtree, kmeanstree, queries, toxicity

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(k, [float(x) for x in v], k % 3, "clash") for k, v in enumerate(np.round(rng.normal(size=(700, 8)), 3))]
    rows += [(700 + k, rows[5][1], 0, "copy") for k in range(40)]
    rows += [(800, None, 0, "x"), (900, [0.0] * 8, 0, "x"), (901, [float("nan")] + [1.0] * 7, 0, "x"), (902, [None] + [1.0] * 7, 0, "x"), (903, [float("inf")] * 8, 0, "x"), (904, [], 0, "x")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, block int, shard string").repartition(4)


def usable(vectors, zero):
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    good = [(i, v) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and (zero or any(v))]
    good.sort()
    return np.array([i for i, _ in good]), np.array([v for _, v in good], dtype=np.float64)


def test_kd_trees_are_exact(vectors):
    ids, points = usable(vectors, zero=True)
    ints = np.floor(points * 1024).astype(np.int64)
    want = []
    for k in np.flatnonzero(ids % 100 == 0):
        score = ints @ ints[k]
        order = [j for j in np.lexsort((ids, -score)) if j != k][:10]
        want += [(int(ids[k]), r + 1, int(ids[j]), int(score[j])) for r, j in enumerate(order)]
    found = kdtree.top_k(vectors, F.col("vec_id") % 100 == 0, shard_rows=100)
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert kdtree.top_k(vectors.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    few = vectors.where("vec_id in (100, 101, 102)")
    assert kdtree.top_k(few, F.col("vec_id") == 100).count() == 2


def test_kd_tree_opens_few_boxes_on_clustered_points(monkeypatch):
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.integers(-20, 20, (500, 3)) + c for c in rng.integers(-2000, 2000, (8, 3))])
    tree = kdtree.Tree(points, np.arange(len(points)))
    assert all((tree.points[a:b] >= lo).all() and (tree.points[a:b] <= hi).all() for (a, b), lo, hi in zip(tree.span, tree.low, tree.high, strict=True))
    row, found, score = tree.search(points[:3], np.array([-1, -1, -1]), 10, [None] * 3)
    for q in range(3):
        assert sorted(score[row == q].tolist()) == sorted(np.sort(points @ points[q])[-10:].tolist())


@pytest.mark.parametrize("most", [1 << 10, 1 << 27, 1 << 31])
def test_kd_tree_scores_are_exact_at_any_size(most):
    """Doubles, 64-bit integers, Python's integers: products of components near ``most``, of either sign."""
    rng = np.random.default_rng(most % 1000)
    points = rng.integers(-most, most, (300, 4)) | 1
    points[:, 3] //= 8
    asked, ids = np.concatenate([points[:5], -np.abs(points[5:8])]), np.arange(300)
    ids[20:25] = 20  # repeated ids
    row, found, score = kdtree.Tree(points, ids, leaf=8).search(asked, np.array([0, 1, 2, 3, 4, -1, -1, -1]), 10, [None] * 8)
    for q in range(8):
        every = sorted((-sum(int(a) * int(b) for a, b in zip(asked[q], p, strict=True)), int(i)) for p, i in zip(points, ids, strict=True) if i != (q if q < 5 else -1))
        assert sorted(zip((-score[row == q]).tolist(), found[row == q].tolist(), strict=True)) == every[:10]


def test_kd_tree_keeps_scores_far_below_zero():
    points, low = np.array([[-(1 << 30), -(1 << 30)]] * 3), np.array([[1 << 26, 0]])
    _, found, score = kdtree.Tree(points, np.arange(3)).search(low, np.array([9]), 10, [None])
    assert found.tolist() == [0, 1, 2] and set(score.tolist()) == {-(1 << 56)}
    with pytest.raises(OverflowError):
        kdtree.Tree(np.array([[1 << 62, 1 << 62]]), np.arange(1)).search(np.array([[1 << 62, 1 << 62]]), np.array([9]), 10, [None])


@pytest.mark.parametrize("search", [kdtree.top_k, kmeanstree.nearest])
def test_unequal_lengths_null_ids_and_repeated_ids(spark, search):
    kind = "vec_id long, embedding array<double>"
    with pytest.raises(Exception, match="lengths differ"):
        search(spark.createDataFrame([(0, [1.0, 2.0, 3.0]), (1, [4.0])], kind).coalesce(1), F.col("vec_id") == 0).collect()
    rows = [(None, [1.0, 1.0]), (0, [1.0, 2.0]), (0, [0.5, 1.0]), (1, [2.0, 2.0]), (2, [2.0, 2.0]), (2, [3.0, 1.0]), (3, [2.0, 2.0])]
    found = sorted(map(tuple, search(spark.createDataFrame(rows, kind).repartition(3), F.col("vec_id") == 0).collect()))
    assert [(r, i) for _, r, i, _ in found if i != 2] and [i for _, _, i, _ in found].count(2) == 2 and {i for _, _, i, _ in found} == {1, 2, 3}
    if search is kdtree.top_k:  # the query is [0.5, 1], the lesser vector of id 0
        assert [(r, i, s) for _, r, i, s in found] == [(k + 1, i, s) for k, (i, s) in enumerate([(1, 3 << 20), (2, 3 << 20), (3, 3 << 20), (2, 5 << 19)])]
    else:
        assert [i for _, _, i, _ in found][:3] == [1, 2, 3] and found[0][3] == found[1][3] == found[2][3]


def test_k_means_tree_reaches_its_recall(vectors):
    ids, points = usable(vectors, zero=False)
    place = {int(i): k for k, i in enumerate(ids)}
    found = {}
    for r in kmeanstree.nearest(vectors, F.col("vec_id") % 100 == 0).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hit = total = 0
    for k in np.flatnonzero(ids % 100 == 0):
        away = np.sqrt(((points - points[k]) ** 2).sum(1))
        want = [int(ids[j]) for j in np.lexsort((ids, away)) if j != k][:10]
        mine = sorted(found[int(ids[k])])
        assert [r for r, _, _ in mine] == list(range(1, 11)) and [s for _, _, s in mine] == sorted(s for _, _, s in mine)
        assert all(abs(away[place[v]] - s) < 1e-12 for _, v, s in mine)
        hit += len({v for _, v, _ in mine} & set(want))
        total += 10
    assert hit / total >= 0.9
    assert kmeanstree.nearest(vectors.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_chain_on_held_out_documents(spark):
    from pyspark.sql import Row

    docs = queries.table(spark, "/root/testdata/sf0.1", "documents").select("doc_id", "text", F.lit(1).alias("p_toxic"))
    labels = queries.table(spark, "/root/testdata/sf0.1", "labels").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    chain = toxicity.train(docs, labels.where("doc_id % 4 <> 0"), ["low_quality", "toxic"])
    assert isinstance(labels.first(), Row) and [len(m.extra) for m in chain.models] == [0, 1]
    found = toxicity.scored(docs.where("doc_id % 4 = 0"), chain).join(labels, "doc_id").select("toxic", "is_toxic").collect()
    hit = sum(r.toxic and r.is_toxic for r in found)
    assert hit / sum(r.toxic for r in found) > 0.8 and hit / sum(r.is_toxic for r in found) > 0.9


def test_chain_without_labels_or_texts(spark, docs, empty):
    labels = spark.createDataFrame([(3, 1, 1), (4, None, 1)], "doc_id long, low_quality int, toxic int")
    for some in (labels.limit(0), labels):
        chain = toxicity.train(docs, some, ["low_quality", "toxic"])
        assert toxicity.scored(docs, chain).count() == docs.count() and toxicity.scored(empty, chain).count() == 0
    found = toxicity.scored(docs, toxicity.train(docs, labels.limit(0), ["toxic"]))
    assert found.columns == [*docs.columns, "p_toxic", "_is_toxic"]  # docs has a column is_toxic
    assert found.where("_is_toxic = 1 or is_toxic <> 'z'").count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline as P
    from rillflow.llm.common import durable

    docs = queries.table(spark, SMALL, "documents")
    before = docs.count()
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert tuple(out.columns) == P.COLUMNS, name
        docs = durable(out)
        assert 0 < docs.count() <= before
        before = docs.count()
    assert docs.where("n_chars <> length(text)").count() == 0
    assert P.STAGES[-1][1](spark, docs, SMALL).select("doc_id").distinct().count() == before
    assert P.run(spark, SMALL).count() > 0


def test_exact_copies_with_short_lines_leave_the_pipeline(spark, tmp_path):
    import corpus_pipeline as P

    texts = [f"Title {k}\n\nA first line that is long enough to be joined, number {k * 7919}.\nyes\n- item {k}" for k in range(6)]
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate(texts)] + [(100 + k, t, "en", "s", len(t)) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert {r.doc_id for r in P.run(spark, str(tmp_path)).select("doc_id").distinct().collect()} == set(range(6))


def test_outliers_beside_tight_clusters_get_k_rows(spark):
    rng = np.random.default_rng(6)
    clusters = (rng.normal(size=(300, 1, 8)) * 10 + rng.normal(size=(300, 20, 8)) * 1e-3).reshape(-1, 8)
    outliers = np.zeros((20, 8))
    outliers[:, 0] = 1000 * 3.0 ** np.arange(20)
    points = np.concatenate([outliers, clusters])
    rows = [(k, v.tolist()) for k, v in enumerate(points)] + [(19, outliers[19].tolist())] * 12
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    found = {}
    for r in kmeanstree.nearest(df, F.col("vec_id") < 25).collect():
        found.setdefault(r.query_id, []).append(r.rank)
    assert {q: sorted(ranks) for q, ranks in found.items()} == {q: list(range(1, 11)) for q in range(25)}


def test_calibrating_vectors_are_held_out(vectors, monkeypatch):
    fitted, searched, fit, visits = [], [], kmeanstree.fit, kmeanstree.Tree.visits
    monkeypatch.setattr(kmeanstree, "fit", lambda points: fitted.append(points) or fit(points))
    monkeypatch.setattr(kmeanstree.Tree, "visits", lambda self, query, most, *more: searched.append(query) or visits(self, query, most, *more))
    kmeanstree.nearest(vectors, F.col("vec_id") % 100 == 0)
    known = {tuple(x) for x in fitted[0].tolist()}
    assert len(searched) == 175 and len(known) == 525 and not any(tuple(x) in known for x in searched)
