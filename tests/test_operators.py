"""Small fixed inputs with known results."""

import hashlib
import math
import os

import pytest
from pyspark.sql import functions as F

from rillflow.functions import arrays, strings
from rillflow.functions import math as M
from rillflow.operators import aggregate, gate, genome, join, ordering, sets, sort, sparse, transform, window
from rillflow.plans.flow import Flow


def frame(spark, values, kind="long", name="x"):
    return spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"ord long, {name} {kind}")


@pytest.mark.parametrize("values, kind, want", [([], "long", []), ([9], "long", [9]), ([5] * 4, "long", [5]), ([8, 3, 8, 6, 3, 11, 6, 8], "long", [8, 3, 6, 11]), (["kiwi", "plum", "kiwi", "fig", "plum"], "string", ["kiwi", "plum", "fig"]), ([[2], [2, 2], [2]], "array<long>", [[2], [2, 2]])])
def test_unique(spark, values, kind, want):
    found = aggregate.unique_first(frame(spark, values, kind), ["x"], ["ord"]).orderBy("ord").collect()
    assert [r.x for r in found] == want


@pytest.mark.parametrize("size, shift, stride, want", [(3, 1, 1, [[1, 2, 3], [2, 3, 4], [3, 4, 5], [4, 5, 6]]), (3, 2, 1, [[1, 2, 3], [3, 4, 5]]), (3, 1, 2, [[1, 3, 5], [2, 4, 6]]), (9, 1, 1, [])])
def test_sliding_window(spark, size, shift, stride, want):
    found = window.sliding_window(frame(spark, [1, 2, 3, 4, 5, 6]), size, ["ord"], "x", shift, stride).orderBy("start").collect()
    assert [list(r["items"]) for r in found] == want


def test_numbering_over_ranges_is_dense(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k"))
    found = ordering.numbered(df, ["k"], "pos").orderBy("k").collect()
    assert [r.pos for r in found] == list(range(1000))
    assert ordering.numbered(df.limit(0), ["k"], "pos").count() == 0


@pytest.mark.parametrize("rows", [300, 3000, 20_000])
def test_ranges_grow_with_the_rows(spark, monkeypatch, rows):
    """More rows, more ranges, through one level of bounds and more; a partition that holds most rows is spread over them."""
    monkeypatch.setattr(ordering, "ROWS_A_RANGE", 100)
    df = spark.range(rows).select((F.col("id") * 7919 % 100_003).alias("k"), F.lit(1).alias("one"), F.when(F.col("id") % 10 == 0, F.lit(None)).otherwise("hot").alias("p"))
    placed = df.withColumn("r", ordering.range_of(df, ["k", "one"]))
    sizes = [r["count"] for r in placed.groupBy("r").count().collect()]
    assert len(sizes) >= min(rows // 100, 64) - 1 and max(sizes) <= max(rows / len(sizes) * 4, 40)
    assert placed.select("k", "r").orderBy("k").collect() == sorted(placed.select("k", "r").collect(), key=lambda x: (x.r, x.k))
    found = ordering.numbered(df, ["k"], "pos").orderBy("k").collect()
    assert [r.pos for r in found] == list(range(rows))
    spread = ordering.numbered(df, ["k"], "pos", partition=["p"], spread=True).collect()
    plain = ordering.numbered(df, ["k"], "pos", partition=["p"]).collect()
    assert sorted((r.k, r.pos) for r in spread) == sorted((r.k, r.pos) for r in plain)


def test_running_sum_over_ranges(spark):
    df = spark.range(500).select("id", (F.col("id") % 7).alias("v"))
    up = ordering.running(df, "v", ["id"], "s", exclusive=True).orderBy("id").collect()
    assert [r.s for r in up] == [sum(k % 7 for k in range(n)) for n in range(500)]
    down = ordering.running(df, "v", ["id"], "s", reverse=True).orderBy("id").collect()
    assert [r.s for r in down] == [sum(k % 7 for k in range(n, 500)) for n in range(500)]


def test_group_by_window_flushes_short_windows(spark):
    values = [3, 5, 3, 3, 5, 3, 3, 7, 3, 5]
    found = window.group_by_window(frame(spark, values), ["x"], 4, ["ord"], F.count(F.lit(1)).alias("n")).orderBy("x", "window").collect()
    assert [(r.x, r.window, r.n) for r in found] == [(3, 0, 4), (3, 1, 2), (5, 0, 3), (7, 0, 1)]


def test_scan_of_pairs(spark):
    rows = frame(spark, [0] * 5).withColumn("g", F.lit(0))
    found = window.scan(rows, ["g"], ["ord"], lambda s, r: ((s[1], s[0] + s[1]), (r.ord, s[1])), (0, 1), "ord long, v long").orderBy("ord").collect()
    assert [r.v for r in found] == [1, 1, 2, 3, 5]


def test_interleave_takes_blocks_in_turn(spark):
    a, b = frame(spark, [1, 2, 3, 4]), frame(spark, [10, 20, 30])
    found = transform.interleave([a, b], [["ord"], ["ord"]], 2).orderBy("round", "slot", "inner").collect()
    assert [r.x for r in found] == [1, 2, 10, 20, 3, 4, 30]


def test_rate(spark):
    df = spark.createDataFrame([(0, 1, 1.0, 1.0), (1, 1, 2.0, 2.0), (2, 1, 4.0, 3.0), (3, 1, 16.0, 3.0)], "ord long, g int, v double, d double")
    assert [r.rate for r in transform.rate(df, "v", "d", ["ord"], ["g"]).orderBy("ord").collect()] == [1, 1, 2, 0]


def test_bincount_rejects_negative_values(spark):
    assert [r.n for r in aggregate.bincount(frame(spark, [1, 1, 3, 9]), "x", 4).orderBy("value").collect()] == [0, 2, 0, 1]
    with pytest.raises(Exception, match="negative"):
        aggregate.bincount(frame(spark, [1, -1]), "x", 4).collect()


def test_histogram_clips(spark):
    found = aggregate.histogram_fixed_width(frame(spark, [-1.0, 0.0, 1.5, 2.0, 5.0, 15.0], "double"), F.col("x"), 0.0, 5.0, 5).orderBy("bin").collect()
    assert [r.n for r in found] == [2, 1, 1, 0, 2]


def test_unique_with_counts(spark):
    found = aggregate.unique_with_counts(frame(spark, [1, 1, 2, 4, 4, 4, 7, 8, 8]), "x", ["ord"]).orderBy("id").collect()
    assert [(r.x, r["count"]) for r in found] == [(1, 2), (2, 1), (4, 3), (7, 1), (8, 2)]


def test_weighted_quantile_ignores_weights_of_zero(spark):
    df = spark.createDataFrame([(1, 1.0, 0.0), (1, 2.0, 1.0), (1, 3.0, -4.0), (1, 4.0, 1.0), (1, 4.0, 1.0)], "g int, v double, w double")
    assert aggregate.weighted_quantile(df, ["g"], "v", "w", 0.5).first().v == 4.0


def test_list_diff_and_stitch(spark):
    x = frame(spark, [1, 2, 3, 4, 3])
    assert [(r.x, r.ord) for r in sets.list_diff(x, frame(spark, [1, 2]), "x", "x").orderBy("ord").collect()] == [(3, 2), (4, 3), (3, 4)]
    assert [r.x for r in sets.dynamic_stitch([frame(spark, [1, 2]), frame(spark, [5])], "ord", "x").orderBy("ord").collect()] == [5, 2]


def test_in_top_k_is_false_on_bad_numbers(spark):
    df = spark.createDataFrame([([0.1, 0.3, 0.2], 1), ([0.1, 0.3, 0.2], 0), ([math.nan, 0.3, 0.2], 1), ([0.1, 0.1, 0.1], 2), ([0.1], 5)], "p array<double>, t int")
    assert [r.h for r in df.select(sort.in_top_k(F.col("p"), F.col("t"), 1).alias("h")).collect()] == [True, False, False, True, False]


def test_lookup_refuses_double_keys(spark):
    table = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    df = spark.createDataFrame([(2,), (3,)], "key int")
    assert [r.value for r in join.lookup(df, table.where("k = 2"), "key", "k", "v", F.lit("-")).orderBy("key").collect()] == ["c", "-"]
    with pytest.raises(Exception, match="duplicate key"):
        join.lookup(df.union(spark.createDataFrame([(1,)], "key int")), table, "key", "k", "v", F.lit("-")).collect()


def test_feature_cross(spark):
    df = spark.createDataFrame([(0, ["a"], ["d"], ["f"]), (1, ["b", "c"], ["e"], ["g"])], "i int, a array<string>, b array<string>, c array<string>")
    assert [r.cross for r in join.feature_cross(df, ["a", "b", "c"]).orderBy("i", "cross").collect()] == ["a_X_d_X_f", "b_X_e_X_g", "c_X_e_X_g"]


def test_scatter_accumulates(spark):
    base = frame(spark, [1, 2, 3])
    change = spark.createDataFrame([(0, 5), (0, 6), (2, 1)], "i long, x long")
    assert [r.x for r in join.scatter(change, base, "i", "x", "ord").orderBy("ord").collect()] == [12, 2, 4]


def test_as_of_takes_the_latest_before(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 9)], "k string, t int")
    right = spark.createDataFrame([("a", 2, None), ("a", 1, 7), ("a", 6, 8)], "k string, at int, v int")
    assert {(r.k, r.t): r.v for r in join.as_of(left, right, "k", "t", "at", "v").collect()} == {("a", 5): None, ("a", 1): 7, ("b", 9): None}


def test_number_rules(spark):
    df = spark.createDataFrame([(7, 2), (-7, 2), (7, -2), (-7, -2), (7, 0)], "a long, b long")
    a, b = F.col("a"), F.col("b")
    found = df.select(M.truncate_div(a, b), M.floor_div(a, b), M.truncate_mod(a, b), M.floor_mod(a, b), M.div_no_nan(a, b)).collect()
    assert [tuple(r) for r in found] == [(3, 3, 1, 1, 3.5), (-3, -4, -1, 1, -3.5), (-3, -4, 1, -1, -3.5), (3, 3, -1, -1, 3.5), (None, None, None, None, 0.0)]
    x = spark.createDataFrame([(v,) for v in (-1.7, -1.5, -0.2, 0.2, 1.5, 1.7, 2.0)], "x double")
    assert [r[0] for r in x.select(M.round_half_even(F.col("x"))).collect()] == [-2, -2, 0, 0, 2, 2, 2]
    assert [r[0] for r in spark.createDataFrame([(v,) for v in (-5, 10000, 150, 10, 5, 100)], "x int").select(M.bucketize(F.col("x"), [0, 10, 100])).collect()] == [0, 3, 3, 2, 1, 3]


def test_strings(spark):
    df = spark.createDataFrame([("  a b\t\n", "x,,y")], "s string, c string")
    row = df.select(strings.strip(F.col("s")).alias("s"), strings.split_chars(F.col("c"), ",").alias("v1"), strings.split_by(F.col("c"), ",").alias("v2"), strings.encode_base64(F.lit("a?>")).alias("b"), strings.substr_bytes(F.lit("héllo"), 1, 2).cast("string").alias("u"), strings.as_string(F.lit(3.14159), 2, width=8, fill="0").alias("w")).first()
    assert (row.s, row.v1, row.v2, row.b, row.u, row.w) == ("a b", ["x", "y"], ["x", "", "y"], "YT8-", "é", "00003.14")
    with pytest.raises(Exception, match="out of range"):
        df.select(strings.substr_bytes(F.col("c"), 50, 2)).collect()


def test_arrays(spark):
    df = spark.createDataFrame([([1, 2, 3, 4, 5],), ([],)], "a array<int>")
    a = F.col("a")
    first, empty = df.select(arrays.roll(a, 2).alias("r"), arrays.strided_slice(a, 1, 5, 2).alias("s"), arrays.where_indices(F.transform(a, lambda x: x > 3)).alias("w"), sort.reverse_prefix(a, F.lit(3)).alias("p"), arrays.tile(a, 2).alias("t")).collect()
    assert (first.r, first.s, first.w, first.p, len(first.t)) == ([4, 5, 1, 2, 3], [2, 4], [3, 4], [3, 2, 1, 4, 5], 10)
    assert (empty.r, empty.s, empty.w, empty.p, empty.t) == ([], [], [], [], [])
    assert df.limit(1).select(arrays.mirror_pad(a, 2, 1)).first()[0] == [3, 2, 1, 2, 3, 4, 5, 4]
    assert df.limit(1).select(arrays.linspace(0.0, 1.0, 5)).first()[0] == [0, 0.25, 0.5, 0.75, 1]


def test_sparse_fill(spark):
    coo = spark.createDataFrame([(0, 1, 5), (2, 0, 7)], "row long, col int, v int")
    found = sparse.fill_empty_rows(coo, 3, F.lit(-1)).orderBy("row").collect()
    assert [(r.row, r.col, r.v, r.was_empty) for r in found] == [(0, 1, 5, False), (1, 0, -1, True), (2, 0, 7, False)]


def test_sparse_values_without_cells_are_stored(spark):
    coo = spark.createDataFrame([(1, 0, 2, 5), (1, 0, 1, 4), (None, 3, 0, 9)], "h long, row long, col int, v int")
    stored = sparse.serialized(coo, "h", spark.createDataFrame([(1,), (2,), (2,), (None,)], "h long"))
    assert {r.h: [tuple(c) for c in r.cells] for r in stored.collect()} == {1: [(0, 1, 4), (0, 2, 5)], 2: [], None: [(3, 0, 9)]}
    handles = spark.createDataFrame([(0, 2), (1, 1), (2, 2), (3, 1)], "handle_pos int, h long")
    assert sorted(map(tuple, sparse.deserialized(stored, "h", handles).collect())) == [(p, 0, c, c + 3) for p in (1, 3) for c in (1, 2)]
    with pytest.raises(Exception, match="no value of that handle"):
        sparse.deserialized(stored, "h", spark.createDataFrame([(0, 7)], "handle_pos int, h long")).collect()


@pytest.mark.parametrize("vectors", [3, 20])
def test_sparse_storage_of_vectors_without_cells(spark, duck, tmp_path, vectors):
    """One vector has no component over 0.2; of the smaller table most handles name no vector."""
    from rillflow.queries import catalogue

    rows = [(k, [0.01 * (j + k) if k != 2 else 0.1 for j in range(64)]) for k in range(vectors)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    c = duck.cursor()
    c.execute(f"create temp view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    df = catalogue.queries()["sparse_storage"](spark, str(tmp_path))
    want = c.execute(catalogue.oracle_sql()["sparse_storage"])
    assert df.columns == [x[0] for x in want.description] and sorted(map(tuple, df.collect())) == sorted(want.fetchall())


@pytest.mark.parametrize("size, words", [(0, 1), (20, 1), (21, 2), (22, 2), (42, 3)])
def test_base_codec(size, words):
    bases = ("ACGTNacgtn" * 5)[:size]
    packed = genome.pack_bases(bases)
    assert len(packed) == words and genome.unpack_bases(packed) == bases.upper()
    assert max(packed) < 1 << 63
    with pytest.raises(ValueError):
        genome.pack_bases("AX")


def test_fastq_drops_a_cut_record(spark):
    lines = [x for k in range(3) for x in (f"@r{k}", "ACGT", "+", "!!!!")][:-1]
    found = genome.fastq_records(frame(spark, lines, "string", "line"), "ord", 2).orderBy("record").collect()
    assert [(r.meta, r.chunk) for r in found] == [("r0", 0), ("r1", 0)]


def test_gate_keeps_requests_apart(spark):
    df = spark.createDataFrame([(r, k) for r, n in (("a", 1), ("b", 3), ("c", 5)) for k in range(n)], "r string, k int")
    tagged = gate.ingress(df, ["r"], ["k"], 7)
    assert {(x.r, x.request_id, x.request_count) for x in tagged.collect()} == {("a", 7, 1), ("b", 8, 3), ("c", 9, 5)}
    assert {x.request_id for x in gate.egress(tagged.where("not (r = 'c' and k = 2)")).collect()} == {7, 8}
    batches = gate.dequeue_many(tagged, 2).groupBy("request_id", "batch").count().collect()
    assert sorted((x.request_id, x.batch, x["count"]) for x in batches) == [(7, 0, 1), (8, 0, 2), (8, 1, 1), (9, 0, 2), (9, 1, 2), (9, 2, 1)]


def test_verify_sort(spark):
    df = spark.createDataFrame([(0, 0, 1, 5), (1, 0, 1, 5), (2, 0, 1, 3), (3, 1, 0, 9), (4, 1, 2, 1)], "ordinal long, chunk int, ref_index int, position long")
    assert [r.ordinal for r in sort.order_violations(df.withColumn("all", F.lit(0)), ["ref_index", "position"], ["ordinal"], ["all"]).orderBy("ordinal").collect()] == [2, 3]


def test_flow_skips_steps_that_change_nothing(spark):
    flow = Flow.of(spark.range(5), "id")
    assert flow.repeat(1) is flow and flow.take(-1) is flow and flow.skip(0) is flow
    assert flow.take(-1).skip(-1).df.count() == 0
    assert [r.id for r in flow.repeat(2).df.orderBy("epoch", "id").collect()] == [0, 1, 2, 3, 4] * 2
    assert [len(r["items"]) for r in flow.batch(2, "id").df.orderBy("batch").collect()] == [2, 2, 1]


def test_single_element_is_checked(spark):
    assert transform.single_element(spark.range(1)).first().id == 0
    with pytest.raises(Exception, match="exactly one"):
        transform.single_element(spark.range(2)).collect()


def test_epochs_are_permutations(spark):
    found = [r.id for r in sort.shuffle_and_repeat(spark.range(20), 3, 10, ["id"]).orderBy("at").collect()]
    parts = [found[k : k + 20] for k in (0, 20, 40)]
    assert all(sorted(p) == list(range(20)) for p in parts) and parts[0] != parts[1]


def test_examples_have_defaults_and_required_features(spark):
    from rillflow.functions import examples

    df = spark.range(1).select(examples.example(bytes_={"title": F.array(F.lit(b"x"))}, floats={"score": F.array(F.lit(1.5), F.lit(2.5))}).alias("e"))
    e = F.col("e")
    row = df.select(examples.dense(e, "score", "floats", 2).alias("s"), examples.dense(e, "age", "ints", 1, F.lit(7).cast("long")).alias("a"), examples.ragged(e, "none", "ints").alias("r")).first()
    assert (row.s, row.a, row.r) == ([1.5, 2.5], [7], [])
    for key, size in (("age", 1), ("title", 2)):
        with pytest.raises(Exception, match=f"feature {key}"):
            df.select(examples.dense(e, key, "bytes", size)).collect()


def test_observed_metrics(spark):
    df, watch = aggregate.observed(spark.range(10), "rows", n=F.count(F.lit(1)), top=F.max("id"))
    assert df.count() == 10 and watch.get == {"n": 10, "top": 9}


def test_fold_keeps_the_order(spark):
    df = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), ("b", 1, "z")], "k string, o int, v string")
    found = aggregate.fold(df, ["k"], ["o"], "v", F.lit(""), lambda s, x: F.concat(s, x), F.upper)
    assert {r.k: r.value for r in found.collect()} == {"a": "XY", "b": "Z"}


def test_numbers_with_nulls_and_ties_keep_their_order(spark):
    values = [None, 5.0, float("nan"), -1.0, None, 2.0] + [float(k) for k in range(100, 200)] + [float("nan")] * 40
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "i long, v double")
    found = ordering.numbered(df, ["v", "i"], "pos").orderBy("pos").collect()
    want = [r.i for r in df.orderBy("v", "i").collect()]
    assert [r.i for r in found] == want


def test_whole_number_division_is_exact(spark):
    from decimal import Decimal

    pairs = [(9007199254740993, 1), ((1 << 63) - 1, 2), (-(1 << 62) - 1, 3), (-9007199254740993, 2), (5, -(1 << 62))]
    df = spark.createDataFrame(pairs, "a long, b long")
    a, b = F.col("a"), F.col("b")
    for (x, y), r in zip(pairs, df.select(M.truncate_div(a, b), M.floor_div(a, b), M.truncate_mod(a, b), M.floor_mod(a, b)).collect(), strict=True):
        cut = int(Decimal(x) / Decimal(y)) if abs(x) < 10**15 else abs(x) // abs(y) * (1 if (x < 0) == (y < 0) else -1)
        assert tuple(r) == (cut, x // y, x - cut * y, x % y)


def test_gather_refuses_a_missing_row(spark):
    rows, index = frame(spark, [5, 6, 7]), spark.createDataFrame([(2,), (0,), (2,)], "at long")
    assert sorted(r.x for r in join.gather(index, rows, "at", "ord").collect()) == [5, 7, 7]
    with pytest.raises(Exception, match="index out of range: 9"):
        join.gather(spark.createDataFrame([(9,)], "at long"), rows, "at", "ord").collect()
    with pytest.raises(Exception, match="out of range"):
        join.scatter_nd(spark.createDataFrame([(9, 1)], "i long, x long"), "i", "x", 5).collect()


def test_tables_that_change(spark):
    table = join.MutableTable(spark.createDataFrame([(1, "a"), (2, "b")], "key long, value string"))
    after = table.insert(spark.createDataFrame([(2, "c"), (3, "d")], "key long, value string")).snapshot()
    assert {r.key: r.value for r in after.export().collect()} == {1: "a", 2: "c", 3: "d"} and after.size().first().n == 3
    assert {r.key for r in after.replace(spark.createDataFrame([(7, "x")], "key long, value string")).export().collect()} == {7}
    with pytest.raises(Exception, match="repeated key"):
        table.insert(spark.createDataFrame([(2, "c"), (2, "d")], "key long, value string")).export().collect()


def test_tables_from_text(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("a\t10\nb\t20\nc\t30\n")
    found = join.table_from_text(spark, str(tmp_path / "t.tsv"), "k string, v int", "k", "v", size=3)
    assert {r.key: r.value for r in found.collect()} == {"a": 10, "b": 20, "c": 30}
    assert {r.key: r.value for r in join.table_from_text(spark, str(tmp_path / "t.tsv"), "k string, v int", "k").collect()} == {"a": 0, "b": 1, "c": 2}
    with pytest.raises(Exception, match="another number of lines"):
        join.table_from_text(spark, str(tmp_path / "t.tsv"), "k string, v int", "k", "v", size=4).collect()


def test_vocabulary_files(spark, tmp_path):
    from rillflow.operators import feature_columns

    (tmp_path / "v.txt").write_text("red\ngreen\n")
    df = spark.createDataFrame([("green",), ("red",), ("blue",)], "c string")
    assert {r.c: r.id for r in feature_columns.vocabulary_file(df, "c", str(tmp_path / "v.txt")).collect()} == {"green": 1, "red": 0, "blue": -1}
    assert {r.c: r.id for r in feature_columns.vocabulary_file(df, "c", str(tmp_path / "v.txt"), oov_buckets=1).collect()} == {"green": 1, "red": 0, "blue": 2}


def test_queues(spark):
    from rillflow.operators.queues import Queue, QueueClosed, popped, staged, unstaged

    queue = Queue.fifo(frame(spark, [10, 11, 12, 13, 14]), "ord", capacity=5)
    first, rest = queue.dequeue()
    assert [r.x for r in first.collect()] == [10] and rest.size().first().n == 4
    assert [list(r["items"]) for r in queue.dequeue_many(2, "x").orderBy("batch").collect()] == [[10, 11], [12, 13]]
    shut = queue.close()
    assert [list(r["items"]) for r in shut.dequeue_up_to(2, "x").orderBy("batch").collect()][-1] == [14] and shut.is_closed() and queue.close(True).size().first().n == 0
    with pytest.raises(QueueClosed):
        shut.enqueue_many(frame(spark, [1]))
    with pytest.raises(Exception, match="full"):
        queue.enqueue_many(spark.createDataFrame([(9, 1)], "ord long, x long")).dequeue_many(2, "x").collect()
    last, left = popped(frame(spark, [1, 2, 3]), ["ord"], 2)
    assert [r.x for r in last.orderBy("at").collect()] == [3, 2] and [r.x for r in left.collect()] == [1]
    rows = spark.createDataFrame([(1, "a", None), (1, None, "b"), (2, "c", None)], "k int, x string, y string")
    area = staged(rows, "k", ["x", "y"])
    assert [tuple(r) for r in area.collect()] == [(1, "a", "b")]
    with pytest.raises(Exception, match="staged twice"):
        staged(rows.union(rows), "k", ["x", "y"]).collect()
    taken, kept = unstaged(frame(spark, [4, 2, 9]), "x", n=2)
    assert sorted(r.x for r in taken.collect()) == [2, 4] and [r.x for r in kept.collect()] == [9]


def test_loops_and_services(spark, tmp_path):
    with pytest.raises(RuntimeError, match="didn't end"):
        transform.while_loop(spark.range(3), F.lit(True), lambda d: d, 2)
    asked = spark.createDataFrame([(1, b"x")], "i int, request binary")
    failing = lambda _: (_ for _ in ()).throw(ValueError("down"))
    assert transform.call_remote(asked, failing, "request", errors=True).first().status == "down"
    with pytest.raises(Exception, match="down"):
        transform.call_remote(asked, failing, "request").collect()
    kept = transform.cached(spark.range(5), str(tmp_path / "c"))
    assert kept.count() == 5 and transform.cached(spark.range(9), str(tmp_path / "c")).count() == 5 and transform.cached(spark.range(9), str(tmp_path / "c"), overwrite=True).count() == 9


def test_shapes_are_checked(spark):
    df = spark.createDataFrame([([1, 2, 3, 4],)], "a array<int>")
    a = F.col("a")
    assert df.select(arrays.reshape(a, [2, 2])).first()[0] == [[1, 2], [3, 4]] and df.select(arrays.transpose(arrays.reshape(a, [2, 2]))).first()[0] == [[1, 3], [2, 4]]
    assert df.select(arrays.gather_nd(arrays.reshape(a, [2, 2]), F.array(F.array(F.lit(1), F.lit(0)), F.array(F.lit(0), F.lit(1))), 2)).first()[0] == [3, 2]
    for bad, message in ((arrays.reshape(a, [3, 2]), "doesn't fit"), (arrays.squeeze(a), "must have 1"), (arrays.split_even(a, 3)[0], "doesn't split"), (arrays.set_item(a, 7, F.lit(0)), "out of range"), (arrays.get_value(F.lit(None).cast("struct<value: int>")), "no value"), (arrays.pop_back(F.slice(a, 1, 0))[0], "empty list")):
        with pytest.raises(Exception, match=message):
            df.select(bad).collect()


def test_bits_and_checks(spark):
    df = spark.createDataFrame([(1.0,), (-0.0,), (float("nan"),), (None,)], "x double")
    bits = [r[0] for r in df.select(M.bitcast(F.col("x"), "double", "bigint")).collect()]
    assert bits[:2] == [1023 << 52, -(1 << 63)] and bits[3] is None
    with pytest.raises(ValueError, match="widths"):
        M.bitcast(F.col("x"), "double", "int")
    with pytest.raises(Exception, match="bad number"):
        df.select(M.check_numerics(F.col("x"), "bad number")).collect()


def test_special_functions_by_identities(spark):
    from rillflow.functions import special

    xs = [-4.5, -1.2, 0.3, 1.0, 2.5, 8.0, 40.0]
    df = spark.createDataFrame([(x,) for x in [*xs, None]], "x double")
    found = df.select(special.lgamma(F.col("x")), special.erf(F.col("x")), special.erfc(F.col("x"))).collect()
    for x, r in zip(xs, found, strict=False):
        assert r[0] == pytest.approx(math.lgamma(x), abs=1e-12) and r[1] == pytest.approx(math.erf(x), abs=1e-14) and r[2] == pytest.approx(math.erfc(x), rel=1e-12, abs=1e-300)
    assert tuple(found[-1]) == (None, None, None)


def test_wire_format():
    from rillflow.functions import wire

    spec = {"a": (1, "int64"), "b": (2, ["sint64"]), "c": (3, {"d": (1, "string"), "e": (2, ["double"])}), "f": (16, "bytes"), "g": (5, "float")}
    message = {"a": -5, "b": [0, -1, 1, -(1 << 62)], "c": {"d": "né", "e": [1.5, -2.0]}, "f": b"\x00\xff", "g": 0.5}
    data = wire.encode(message, spec)
    assert wire.decode(data, spec) == message
    assert wire.decode(data + wire.put(99, wire.LENGTH, b"other") + wire.put(1, wire.VARINT, 7), spec)["a"] == 7  # unknown fields are skipped, the last value counts
    assert wire.decode(b"", spec) == {"a": None, "b": [], "c": None, "f": None, "g": None}
    assert wire.put(1, wire.VARINT, 150) == b"\x08\x96\x01" and wire.put(2, wire.LENGTH, b"testing") == b"\x12\x07testing"
    unpacked = b"".join(wire.put(2, wire.VARINT, n) for n in (3, 4))
    assert wire.decode(unpacked, spec)["b"] == [-2, 2]
    for cut in range(1, len(data)):
        try:
            wire.decode(data[:cut], spec)
        except (ValueError, UnicodeDecodeError):
            pass
    with pytest.raises(ValueError, match="truncated"):
        wire.decode(data[:-1], spec)


def test_sequences_and_tensors(spark):
    from rillflow.functions import wire

    data = wire.sequence_bytes({"id": {"ints": [7]}}, {"words": [{"bytes": [b"a"]}, {"bytes": [b"b", b"c"]}], "none": []})
    row = wire.parse_sequences(spark.createDataFrame([(data,), (None,)], "record binary")).collect()
    assert row[0].sequence.context["id"].ints == [7] and [[bytes(b) for b in f.bytes] for f in row[0].sequence.lists["words"]] == [[b"a"], [b"b", b"c"]] and row[1].sequence is None
    tensors = [wire.tensor_bytes([1.5, 2.5], [2, 1], "double"), wire.tensor_bytes([], [0], "double")]
    found = wire.parse_tensors(spark.createDataFrame([(t,) for t in tensors], "data binary"), "data", "double").collect()
    assert [(r.tensor.dims, r.tensor.values) for r in found] == [([2, 1], [1.5, 2.5]), ([0], [])]
    assert wire.tensor_of(wire.tensor_bytes(["x", "yz"], [2], "string"), "string")["values"] == [b"x", b"yz"]
    with pytest.raises(ValueError, match="not float"):
        wire.tensor_of(tensors[0], "float")


def test_paired_reads_are_even(spark):
    refs = spark.createDataFrame([(0, "ACGTACGGTCATTGCA" * 10)], "ref_index int, bases string")
    reads = spark.createDataFrame([(0, "ACGTACGGTCATTGCAACGT")], "ordinal long, bases string")
    with pytest.raises(Exception, match="odd number"):
        genome.align_paired(reads, genome.genome_index(refs, 8), refs, 8).collect()
    with pytest.raises(Exception, match="odd number"):
        genome.align_with(reads, lambda: lambda pdf: pdf, "ordinal long, bases string", 2, paired=True).collect()
    lost = genome.align_single(spark.createDataFrame([(5, "T" * 30)], "ordinal long, bases string"), genome.genome_index(refs, 8), refs, 8).collect()
    assert [(r.ordinal, r.flag, r.position) for r in lost] == [(5, 4, -1)]
    assert genome.aligner_options("-t 8 -so -k 1.5 -x -3") == {"t": "8", "so": True, "k": "1.5", "x": "-3"}


def test_base_codec_of_columns(spark):
    reads = ["", "A", "acgtn" * 5, "ACGTN" * 13, None]
    df = spark.createDataFrame([(r,) for r in reads], "b string")
    found = df.select("b", genome.encode_bases("b").alias("w")).withColumns({"back": genome.decode_bases("w"), "bytes": genome.packed_bytes(F.col("w"))}).collect()
    for r in found:
        if r.b is None:
            assert r.w is None and r.back is None
            continue
        assert r.w == genome.pack_bases(r.b) and r.back == r.b.upper() and bytes(r.bytes) == b"".join(w.to_bytes(8, "little") for w in r.w)
    with pytest.raises(Exception, match="not a base"):
        spark.createDataFrame([("AX",)], "b string").select(genome.encode_bases("b")).collect()


def test_sorted_segments_refuse_falls(spark):
    good = spark.createDataFrame([(k, s, 1.0) for k, s in enumerate([0, 0, 2, 3, 3])], "ord long, s long, v double")
    assert [r.value for r in aggregate.sorted_segment(good, "s", "v", "sum", ["ord"]).orderBy("segment").collect()] == [2.0, 0.0, 1.0, 2.0]
    bad = good.union(spark.createDataFrame([(9, 1, 1.0)], "ord long, s long, v double"))
    with pytest.raises(Exception, match="not sorted"):
        aggregate.sorted_segment(bad, "s", "v", "sum", ["ord"]).collect()


def test_seeds_by_chain():
    from rillflow.operators.similarity import chain_seeds

    assert chain_seeds([1.0, 4.0, 2.0], [0.5, 0.9]) == 1 and chain_seeds([0.0, 4.0], [0.99]) == 1 and chain_seeds([3.0], []) == 0


def genome_of(spark, folder, bases):
    """References from a file so small that Spark would broadcast whatever comes of it."""
    spark.createDataFrame(bases, "ref_index int, bases string").write.parquet(f"{folder}/refs")
    return spark.read.parquet(f"{folder}/refs")


def test_index_of_stretches(spark, tmp_path, monkeypatch):
    """Runs across the ends of stretches come once; those at too many places not at all."""
    monkeypatch.setattr(genome, "STRETCH", 16)
    texts = ["".join("ACGT"[int(c, 16) % 4] for c in hashlib.sha512(str(k).encode()).hexdigest()[:n]) for k, n in enumerate((3, 4, 15, 16, 17, 19, 20, 100))] + ["a" * 40, ""]
    found = genome.genome_index(genome_of(spark, tmp_path, [*enumerate(texts), (99, None)]), 4, 20).collect()
    places = [(t.upper()[p : p + 4], k, p) for k, t in enumerate(texts) for p in range(len(t) - 3)]
    assert sorted(map(tuple, found)) == sorted(x for x in places if x[0] != "AAAA")


def test_alignments_broadcast_no_index(spark, tmp_path):
    """What explode makes of a small table counts as small, and went by way of the driver."""
    refs = genome_of(spark, tmp_path, [(0, "ACGTACGGTCATTGCAGGATCCATTTGACC" * 4), (1, "TTGACCAGGATTACAGATTACACCGGTTAA" * 4)])
    reads = spark.createDataFrame([(0, "ACGTACGGTCATTGCAGGAT"), (1, "TTGACCAGGATTACAGATTA"), (2, "G" * 20)], "ordinal long, bases string")
    found = genome.align_single(reads, genome.genome_index(refs, 8), refs, 8, 4, 0, 1)
    plan = transform.explained(found)
    assert "SortMergeJoin Inner" in plan and "BroadcastHashJoin Inner" not in plan
    rows = sorted(map(tuple, found.collect()))
    assert [r[0] for r in rows] == [0, 0, 1, 1, 2] and [(r[2], r[3], r[4]) for r in rows] == [(0, 0, 0), (0, 30, 256), (1, 0, 0), (1, 30, 256), (-1, -1, 4)] and {r[5] for r in rows} == {0}


def test_pairs_look_for_candidates_once(spark, tmp_path):
    """The plan held the search for candidates dozens of times."""
    bases = "".join("ACGT"[int(c, 16) % 4] for k in range(4) for c in hashlib.md5(str(k).encode()).hexdigest())
    refs = genome_of(spark, tmp_path, [(0, bases)])
    turned = lambda x: x[::-1].translate(str.maketrans("ACGT", "TGCA"))
    reads = [(0, bases[3:27]), (1, turned(bases[60:84])), (2, bases[10:34]), (3, turned(bases[66:90])), (4, bases[20:44]), (5, "A" * 24)]
    found = genome.align_paired(spark.createDataFrame(reads, "ordinal long, bases string"), genome.genome_index(refs, 8), refs, 8, 4, 0)
    assert "Generate" not in transform.explained(found)
    assert sorted(map(tuple, found.collect())) == [(0, 0, 3, 99), (1, 0, 60, 147), (2, 0, 10, 99), (3, 0, 66, 147), (4, 0, 20, 65), (5, -1, -1, 133)]


def test_rows_that_fail_cost_few_calls(spark, tmp_path):
    """Groups on which the function works are kept whole, rows are dealt to all cores, and only rows that fail alone are left out."""
    log = tmp_path / "calls"

    def run(pdf):
        with log.open("a") as f:
            f.write(f"{os.getpid()} ")
        if (pdf["id"] % 100 == 7).any():
            raise ValueError("not these")
        return pdf

    df = spark.range(0, 4000, 1, 1)
    assert sorted(r.id for r in transform.map_ignoring_errors(df, run, "id long").collect()) == [k for k in range(4000) if k % 100 != 7]
    assert len(log.read_text().split()) < 2000
    assert transform.map_ignoring_errors(df, run, "id long").rdd.getNumPartitions() >= 4
    assert not transform.map_ignoring_errors(df, lambda pdf: 1 / 0, "id long").collect()


def test_estimates_are_not_kept_for_each_user(spark):
    from rillflow.queries import catalogue

    plan = transform.explained(catalogue.queries()["approx_distinct"](spark, "/root/testdata/sf0.001"))
    keys = [line for line in plan.splitlines() if line.startswith("Functions") and "approx_count_distinct" in line and "user_id" in line]
    assert keys and not [line for line in plan.splitlines() if line.startswith("Functions") and "merge_approx_count_distinct" in line]


def test_lines_are_dealt_before_they_are_sorted(spark):
    lines = frame(spark, ["@a", "ACGT", "+", "!!!!", "@b", "AC"], "string", "line")
    found = genome.fastq_records(lines, "ord", 2)
    plan = transform.explained(found)
    assert plan.index("(4) Exchange") < plan.index("SortAggregate\nInput") if "(4) Exchange" in plan else plan.index("Exchange\nInput") < plan.index("Sort\nInput")
    assert [tuple(r) for r in found.collect()] == [(0, 0, "a", "ACGT", "!!!!")]


def test_base_codec_is_of_text(spark):
    """Words are octal numbers: no array of a read's bases is made."""
    reads = ["ACGTN" * 100, "A" * 21, "n" * 20]
    df = spark.createDataFrame([(r,) for r in reads], "b string").select("b", genome.encode_bases("b").alias("w"))
    assert "split(" not in transform.explained(df)
    assert [(r.w, r.back) for r in df.select("w", genome.decode_bases("w").alias("back")).collect()] == [(genome.pack_bases(r), r.upper()) for r in reads]
    with pytest.raises(Exception, match="not a base"):
        spark.createDataFrame([("AC\n",)], "b string").select(genome.encode_bases("b")).collect()
    for words, error in (([0], "no end mark"), ([5 | 7 << 3], "not the code"), ([None, 7], "not the code")):
        with pytest.raises(Exception, match=error):
            spark.createDataFrame([(words,)], "w array<long>").select(genome.decode_bases("w")).collect()


def test_quick_examples_are_as_the_general_ones(spark):
    from rillflow.functions import wire

    features = [{}, {"a": {"ints": [1, -1, 300, 1 << 62] + [7] * 90}, "é": {"floats": [0.5, -2.0]}, "": {"bytes": [b"", b"x" * 300]}}, {"none": {}, "empty": {"ints": [], "floats": [], "bytes": []}}, {"two": {"ints": [1], "bytes": [b"a"]}}]
    data = [wire.example_bytes(f) for f in features]
    twice = b"".join(wire.put(1, 2, wire.put(1, 2, b"k") + wire.put(2, 2, wire.put(3, 2, wire.put(1, 0, v)))) for v in (1, 2))  # not packed, the key twice
    data += [wire.put(1, 2, twice), wire.put(9, 0, 5) + data[1], b""]
    plain = lambda x: [(k, {n: v for n, v in f.items()}) for k, f in x]
    for d in data[:4]:
        assert [(k, dict(zip(("bytes", "floats", "ints"), v, strict=True))) for k, v in wire.quick_example(d).items()] == plain(wire.example_of(d))
    rows = wire.parse_examples(spark.createDataFrame([(d,) for d in [*data, None]], "record binary"))
    for r in rows.collect():
        assert r.example is None if r.record is None else {k: (v.bytes and [bytes(b) for b in v.bytes], v.floats, v.ints) for k, v in r.example.items()} == {k: (f["bytes"], f["floats"], f["ints"]) for k, f in wire.example_of(bytes(r.record))}
    again = rows.select("record", wire.write_examples(F.col("example")).alias("again")).collect()
    assert [r.again and bytes(r.again) for r in again][:4] == data[:4] and again[-1].again is None
    with pytest.raises(Exception, match="truncated"):
        wire.parse_examples(spark.createDataFrame([(data[1][:-1],)], "record binary")).collect()


def test_whole_requests_are_counted_in_place(spark):
    """The gate went through its rows twice, and joined them to themselves."""
    rows = spark.createDataFrame([(1, 2, 0), (1, 2, 1), (2, 2, 0), (None, 1, 0), (3, 1, 0)], "request_id long, request_count long, ord long")
    done = gate.pipeline(rows, [("batch", 2, lambda d: d), ("whole", None, lambda d: d)])
    assert "Join" not in transform.explained(done)
    assert sorted((r.request_id, r.ord, r.batch) for r in done.collect()) == [(1, 0, 0), (1, 1, 0), (3, 0, 0)]
    assert sorted((r.request_id, r.n) for r in gate.dequeue_whole(rows, F.col("ord")).collect()) == [(1, 2), (3, 1)]


def test_fourier_of_columns(spark):
    """Arrays of several lengths, empty and null ones; no Python object for a number."""
    import numpy as np

    rows = [[(1.0, 0.0), (2.0, -1.0), (0.5, 3.0)], [], None, [(4.0, 1.0)], [(1.0, 1.0), (0.0, 2.0), (3.0, 0.0)]]
    df = spark.createDataFrame([(k, z) for k, z in enumerate(rows)], "k int, z array<struct<re: double, im: double>>")
    found = df.select("k", "z", M.fft(F.col("z")).alias("f"), M.fft(M.fft(F.col("z")), True).alias("back"))
    assert ", 250\n" in transform.explained(found)  # of Arrow arrays
    for r in found.collect():
        if r.z is None:
            assert r.f is None and r.back is None
            continue
        want = np.fft.fft([complex(*c) for c in r.z]) if r.z else []
        assert np.allclose([complex(c.re, c.im) for c in r.f], want) and np.allclose([complex(*c) for c in r.back], [complex(*c) for c in r.z])
