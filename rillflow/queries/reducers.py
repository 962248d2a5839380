"""Queries of reducers and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.operators import aggregate as A
from rillflow.operators import metrics as MT
from rillflow.queries.registry import Tables, query


@query("select l_orderkey % 5 as key, sum(l_linenumber)::bigint as total, count(*) as n from lineitem group by 1")
def group_by_reducer_mod5(t: Tables) -> DataFrame:
    return A.group_by_reducer(t.lineitem, F.col("l_orderkey") % 5, F.sum("l_linenumber").alias("total"), F.count(F.lit(1)).alias("n"))


@query("select coalesce(sum(o_orderkey), 0)::bigint as total, count(*) as n from orders where false")
def reduce_empty_identity(t: Tables) -> DataFrame:
    return A.reduce_all(t.orders.where("false"), total=(F.sum("o_orderkey"), F.lit(0)), n=(F.count(F.lit(1)), F.lit(0)))


@query("select round(sum(l_quantity), 2) as s, round(avg(l_quantity), 6) as m, min(l_quantity) as lo, max(l_quantity) as hi, bool_and(l_tax < 1) as every, bool_or(l_quantity > 49) as some from lineitem")
def reductions(t: Tables) -> DataFrame:
    return t.lineitem.agg(F.round(F.sum("l_quantity"), 2).alias("s"), F.round(F.avg("l_quantity"), 6).alias("m"), F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"), F.bool_and(F.col("l_tax") < 1).alias("every"), F.bool_or(F.col("l_quantity") > 49).alias("some"))


SEGMENT = "select s.range as segment, coalesce(v, {empty}) as value from range({n}) s left join (select {key} as k, {agg} as v from {table} where {key} between 0 and {n} - 1 group by 1) g on g.k = s.range"


@query(SEGMENT.format(n=12, key="l_linenumber", agg="round(sum(l_quantity), 2)", table="lineitem", empty="0.0"))
def segment_sum_dense(t: Tables) -> DataFrame:
    return A.segment(t.lineitem, "l_linenumber", "l_quantity", "sum", 12, F.lit(0.0)).select("segment", F.round("value", 2).alias("value"))


@query(SEGMENT.format(n=30, key="(s_nationkey - 5)", agg="sum(s_suppkey)::bigint", table="supplier", empty="0"))
def unsorted_segment_sum(t: Tables) -> DataFrame:
    return A.segment(t.supplier.withColumn("g", F.col("s_nationkey") - 5), "g", "s_suppkey", "sum", 30, F.lit(0))


@query(SEGMENT.format(n=30, key="(n_regionkey - 1)", agg="product((1 + n_nationkey % 3)::double)", table="nation", empty="1.0"))
def unsorted_segment_prod(t: Tables) -> DataFrame:
    return A.segment(t.nation.select((F.col("n_regionkey") - 1).alias("g"), (1 + F.col("n_nationkey") % 3).alias("v")), "g", "v", "prod", 30, F.lit(1.0))


@query(SEGMENT.format(n=30, key="(s_nationkey - 5)", agg="min(s_suppkey)", table="supplier", empty="9223372036854775807"))
def unsorted_segment_min(t: Tables) -> DataFrame:
    return A.segment(t.supplier.withColumn("g", F.col("s_nationkey") - 5), "g", "s_suppkey", "min", 30, F.lit((1 << 63) - 1))


@query(SEGMENT.format(n=30, key="(s_nationkey - 5)", agg="max(s_suppkey)", table="supplier", empty="(-9223372036854775807 - 1)"))
def unsorted_segment_max(t: Tables) -> DataFrame:
    return A.segment(t.supplier.withColumn("g", F.col("s_nationkey") - 5), "g", "s_suppkey", "max", 30, F.lit(-(1 << 63)))


SPARSE = "select l_suppkey as segment, round({agg}, 4) as value from lineitem join part on l_partkey = p_partkey group by 1"


@query(SPARSE.format(agg="sum(p_retailprice) / sqrt(count(*))"))
def sparse_segment_sqrtn(t: Tables) -> DataFrame:
    return A.sparse_segment(t.lineitem, t.part, "l_partkey", "l_suppkey", "p_partkey", "p_retailprice", "sqrtn").select("segment", F.round("value", 4).alias("value"))


@query(SPARSE.format(agg="avg(p_retailprice)"))
def sparse_segment_mean(t: Tables) -> DataFrame:
    return A.sparse_segment(t.lineitem, t.part, "l_partkey", "l_suppkey", "p_partkey", "p_retailprice", "mean").select("segment", F.round("value", 4).alias("value"))


@query("select s.range as value, coalesce(n, 0) as n from range(6) s left join (select l_linenumber as v, count(*) as n from lineitem group by 1) g on g.v = s.range")
def bincount(t: Tables) -> DataFrame:
    return A.bincount(t.lineitem, "l_linenumber", 6)


@query("select s.range as value, coalesce(n, 0) as n from range(10) s left join (select l_linenumber as v, sum(l_quantity::bigint)::bigint as n from lineitem group by 1) g on g.v = s.range")
def bincount_weighted(t: Tables) -> DataFrame:
    return A.bincount(t.lineitem.withColumn("w", F.col("l_quantity").cast("long")), "l_linenumber", 10, "w")


@query("select event_type, event_id, user_id from (select *, row_number() over (partition by event_type order by event_id) as r from events) where r = 1")
def unique_first(t: Tables) -> DataFrame:
    return A.unique_first(t.events.select("event_type", "event_id", "user_id"), ["event_type"], ["event_id"])


@query("select user_id, n as count, row_number() over (order by f) - 1 as id from (select user_id, count(*) as n, min(event_id) as f from events group by 1)")
def unique_with_counts(t: Tables) -> DataFrame:
    return A.unique_with_counts(t.events, "user_id", ["event_id"])


@query("select event_id, id from events join (select user_id, row_number() over (order by min(event_id)) - 1 as id from events group by 1) using (user_id)")
def unique_inverse_index(t: Tables) -> DataFrame:
    return A.unique_inverse(t.events.select("event_id", "user_id"), "user_id", ["event_id"]).select("event_id", "id")


@query("select b.range as bin, coalesce(n, 0) as n from range(10) b left join (select least(greatest(floor(10 * (p_retailprice - 950) / 800), 0), 9)::bigint as k, count(*) as n from part group by 1) g on g.k = b.range")
def histogram_fixed_width(t: Tables) -> DataFrame:
    return A.histogram_fixed_width(t.part, F.col("p_retailprice"), 950.0, 1750.0, 10)


@query("select (case when c_acctbal = 0 then 0 else sign(c_acctbal) * (floor(ln(abs(c_acctbal) + 1) / ln(1.1)) + 1) end)::bigint as bucket, count(*) as n from customer group by 1")
def histogram_summary(t: Tables) -> DataFrame:
    return A.log_histogram(t.customer, "c_acctbal")


@query("select o_custkey, arg, best from (select o_custkey, o_orderkey as arg, o_totalprice as best, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as r from orders) where r = 1")
def argmax_by_group(t: Tables) -> DataFrame:
    return A.arg_best(t.orders, ["o_custkey"], "o_totalprice", "o_orderkey")


@query("select o_custkey, arg, best from (select o_custkey, o_orderkey as arg, o_totalprice as best, row_number() over (partition by o_custkey order by o_totalprice, o_orderkey) as r from orders) where r = 1")
def argmin_by_group(t: Tables) -> DataFrame:
    return A.arg_best(t.orders, ["o_custkey"], "o_totalprice", "o_orderkey", largest=False)


@query("select l_returnflag, v as l_extendedprice from (select l_returnflag, l_extendedprice as v, row_number() over (partition by l_returnflag order by l_extendedprice, l_orderkey, l_linenumber) - 1 as i from lineitem) where i = 10")
def nth_element(t: Tables) -> DataFrame:
    return A.nth_element(t.lineitem.select("l_returnflag", "l_extendedprice", "l_orderkey", "l_linenumber"), ["l_returnflag"], "l_extendedprice", 10, ["l_orderkey", "l_linenumber"])


@query("select l_returnflag, v as l_extendedprice from (select l_returnflag, l_extendedprice as v, row_number() over (partition by l_returnflag order by l_extendedprice desc, l_orderkey desc, l_linenumber desc) - 1 as i from lineitem) where i = 3")
def nth_element_reverse(t: Tables) -> DataFrame:
    return A.nth_element(t.lineitem.select("l_returnflag", "l_extendedprice", "l_orderkey", "l_linenumber"), ["l_returnflag"], "l_extendedprice", 3, ["l_orderkey", "l_linenumber"], reverse=True)


@query("select l_returnflag, round(quantile_cont(l_extendedprice, 0.25), 4) as q0, round(quantile_cont(l_extendedprice, 0.5), 4) as q1, round(quantile_cont(l_extendedprice, 0.9), 4) as q2 from lineitem group by 1")
def quantiles(t: Tables) -> DataFrame:
    found = A.quantiles(t.lineitem, ["l_returnflag"], "l_extendedprice", [0.25, 0.5, 0.9])
    return found.select("l_returnflag", *[F.round(c, 4).alias(c) for c in ("q0", "q1", "q2")])


@query("""
with m as (select l_returnflag, l_extendedprice as v, sum(l_quantity) as w from lineitem where l_quantity > 0 group by 1, 2),
     c as (select *, sum(w) over (partition by l_returnflag order by v) as up, sum(w) over (partition by l_returnflag) as total from m)
select l_returnflag, min(v) as l_extendedprice from c where up >= 0.5 * total group by 1
""")
def weighted_quantile(t: Tables) -> DataFrame:
    return A.weighted_quantile(t.lineitem, ["l_returnflag"], "l_extendedprice", "l_quantity", 0.5)


@query("select quality as label, toxic as prediction, count(*) as n from labels group by 1, 2")
def confusion_matrix(t: Tables) -> DataFrame:
    return A.confusion_matrix(t.labels, "quality", "toxic")


@query("select round(avg((quality = toxic)::int), 6) as accuracy, count(*)::double as n from labels")
def accuracy(t: Tables) -> DataFrame:
    return MT.accuracy(t.labels, "quality", "toxic").select(F.round("accuracy", 6).alias("accuracy"), "n")


CELLS = "with c as (select count(*) filter (a and b)::double as tp, count(*) filter (not a and b)::double as fp, count(*) filter (a and not b)::double as fn, count(*) filter (not a and not b)::double as tn from (select l_quantity > 25 as a, l_extendedprice > 40000 as b from lineitem)) "


@query(CELLS + "select tp, fp, fn, tn, round(tp / (tp + fp), 9) as precision, round(tp / (tp + fn), 9) as recall, round(2 * tp / (2 * tp + fp + fn), 9) as f1 from c")
def precision_recall(t: Tables) -> DataFrame:
    found = MT.precision_recall(t.lineitem, F.col("l_quantity") > 25, F.col("l_extendedprice") > 40000)
    return found.select("tp", "fp", "fn", "tn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query("with s as (select l_extendedprice as x, count(*) filter (l_quantity > 25) as p, count(*) filter (l_quantity <= 25) as n from lineitem group by 1), r as (select *, sum(n) over (order by x) - n as below from s) select round(sum(p * (below + n / 2.0)) / (sum(p) * sum(n)), 9)::double as auc from r")
def auc(t: Tables) -> DataFrame:
    return MT.auc(t.lineitem, F.col("l_quantity") > 25, "l_extendedprice").select(F.round("auc", 9).alias("auc"))


@query("with l as (select l_linenumber as a, least(7, 1 + l_quantity::int // 8) as b from lineitem), k as (select distinct a as c from l union select distinct b from l) select round(avg((select count(*) from l where a = c and b = c) / (select count(*) from l where a = c or b = c)), 9) as mean_iou from k")
def mean_iou(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_linenumber").cast("long").alias("a"), F.least(F.lit(7).cast("long"), 1 + F.floor(F.rint("l_quantity") / 8)).alias("b"))
    return MT.mean_iou(rows, "a", "b").select(F.round("mean_iou", 9).alias("mean_iou"))


@query("with e as (select o_totalprice as y, o_custkey * 100.0 as p from orders) select round(avg((y - p) * (y - p)), 2) as mse, round(sqrt(avg((y - p) * (y - p))), 5) as rmse, round(avg(abs(y - p)), 5) as mae, round(1 - avg((y - p) * (y - p)) / var_pop(y), 6) as r2 from e")
def regression_metrics(t: Tables) -> DataFrame:
    found = MT.regression(t.orders.select("o_totalprice", (F.col("o_custkey") * 100.0).alias("p")), "o_totalprice", "p")
    return found.select(F.round("mse", 2).alias("mse"), F.round("rmse", 5).alias("rmse"), F.round("mae", 5).alias("mae"), F.round("r2", 6).alias("r2"))


@query("select round(avg(((select count(*) from unnest(embedding) as u(p) where p > embedding[label + 1]) < 8)::int), 9) as accuracy from embeddings")
def top_k_accuracy(t: Tables) -> DataFrame:
    return MT.top_k_accuracy(t.embeddings, F.col("embedding"), F.col("label"), 8).select(F.round("accuracy", 9).alias("accuracy"))


@query("with c as (select l_suppkey, count(*)::double as n from lineitem group by 1) select round(ln(sum(n)) - sum(n * ln(n)) / sum(n), 9) as entropy from c")
def entropy(t: Tables) -> DataFrame:
    return MT.entropy(t.lineitem, "l_suppkey").select(F.round("entropy", 9).alias("entropy"))


JOINED = "orders join customer on o_custkey = c_custkey"


@query(f"select c_mktsegment, o_orderpriority, count(*) as n from {JOINED} group by cube (c_mktsegment, o_orderpriority)")
def cube(t: Tables) -> DataFrame:
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).cube("c_mktsegment", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query(f"select c_mktsegment, o_orderpriority, count(*) as n from {JOINED} group by rollup (c_mktsegment, o_orderpriority)")
def rollup(t: Tables) -> DataFrame:
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).rollup("c_mktsegment", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query(f"select c_mktsegment, o_orderpriority, count(*) as n from {JOINED} group by grouping sets ((c_mktsegment), (o_orderpriority))")
def grouping_sets(t: Tables) -> DataFrame:
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupingSets([[F.col("c_mktsegment")], [F.col("o_orderpriority")]], "c_mktsegment", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("select event_type, count(distinct user_id) as users, true as close from events group by 1")
def approx_distinct(t: Tables) -> DataFrame:
    """Estimates of a relative error of 2 % lie within three times that of the counts."""
    pairs = t.events.select("event_type", "user_id").distinct()  # else each user of each type carries the registers of an estimate
    found = pairs.groupBy("event_type").agg(F.count("user_id").alias("users"), F.approx_count_distinct("user_id", 0.02).alias("about"))
    return found.select("event_type", "users", (F.abs(F.col("about") - F.col("users")) <= 0.06 * F.col("users") + 1).alias("close"))


@query("select event_type, count(distinct user_id) as users from events group by 1")
def count_distinct(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.count_distinct("user_id").alias("users"))


@query("select r.range as range_id, sum(l_linenumber)::bigint as value from lineitem join range(50) r on l_orderkey >= r.range * 100 and l_orderkey < r.range * 100 + 250 group by 1")
def reduce_slices(t: Tables) -> DataFrame:
    ranges = t.spark.range(50).select(F.col("id").alias("range_id"), (F.col("id") * 100).alias("start"), (F.col("id") * 100 + 250).alias("end"))
    return A.reduce_slices(t.lineitem, ranges, "l_orderkey", "l_linenumber")


@query("select l_linenumber, l_returnflag, (l_suppkey % 4)::int as bucket, round(sum(l_extendedprice - 1000), 2) as gradient, round(sum(l_quantity), 2) as hessian from lineitem group by 1, 2, 3")
def stats_summary(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_linenumber", "l_returnflag", (F.col("l_suppkey") % 4).cast("int").alias("bucket"), (F.col("l_extendedprice") - 1000).alias("g"), "l_quantity")
    found = A.stats_summary(rows, ["l_linenumber", "l_returnflag", "bucket"], "g", "l_quantity")
    return found.withColumns({"gradient": F.round("gradient", 2), "hessian": F.round("hessian", 2)})


@query("select k, sum(v)::bigint as v from (select n_nationkey as k, 1 as v from nation union all select s_nationkey, 2 from supplier union all select c_nationkey, 3 from customer) group by 1")
def add_n(t: Tables) -> DataFrame:
    return A.add_n([t.nation.select(F.col("n_nationkey").alias("k"), F.lit(1).alias("v")), t.supplier.select(F.col("s_nationkey").alias("k"), F.lit(2).alias("v")), t.customer.select(F.col("c_nationkey").alias("k"), F.lit(3).alias("v"))], "k", "v")


@query("select user_id, string_agg(event_type[1], '' order by event_id) as path from events group by 1")
def fold_reducer(t: Tables) -> DataFrame:
    return A.fold(t.events.select("user_id", "event_id", F.substring("event_type", 1, 1).alias("c")), ["user_id"], ["event_id"], "c", F.lit(""), lambda s, x: F.concat(s, x), name="path")


@query("select c_custkey as position, row_number() over (order by c_custkey) - 1 as value from customer")
def invert_permutation(t: Tables) -> DataFrame:
    from rillflow.operators.ordering import numbered
    from rillflow.operators.sort import inverted

    return inverted(numbered(t.customer.select(F.col("c_custkey").alias("value")), ["value"], "position"), "position", "value")


SORTED = "with r as (select (row_number() over (order by o_orderkey) - 1) // 3 * 2 as segment, o_custkey::double as v from orders), g as (select segment, {0} as value from r group by 1) select s.range as segment, coalesce(value, 0)::double as value from range((select max(segment) + 1 from r)) s left join g on g.segment = s.range"


def sorted_rows(t: Tables) -> DataFrame:
    """Orders by threes, every second segment empty."""
    from rillflow.operators.ordering import numbered

    placed = numbered(t.orders.select("o_orderkey", F.col("o_custkey").cast("double").alias("v")), ["o_orderkey"])
    return placed.select("o_orderkey", "v", (F.floor(F.col("pos") / 3) * 2).alias("segment"))


@query(SORTED.format("sum(v)"))
def segment_sum(t: Tables) -> DataFrame:
    return A.sorted_segment(sorted_rows(t), "segment", "v", "sum", ["o_orderkey"])


@query("select segment, round(value, 6) as value from (" + SORTED.format("avg(v)") + ")")
def segment_mean(t: Tables) -> DataFrame:
    return A.sorted_segment(sorted_rows(t), "segment", "v", "mean", ["o_orderkey"]).select("segment", F.round("value", 6).alias("value"))


@query("select segment, round(value, 3) as value from (" + SORTED.format("product(v)") + ")")
def segment_prod(t: Tables) -> DataFrame:
    return A.sorted_segment(sorted_rows(t), "segment", "v", "prod", ["o_orderkey"]).select("segment", F.round("value", 3).alias("value"))


@query(SORTED.format("min(v)"))
def segment_min(t: Tables) -> DataFrame:
    return A.sorted_segment(sorted_rows(t), "segment", "v", "min", ["o_orderkey"])


@query(SORTED.format("max(v)"))
def segment_max(t: Tables) -> DataFrame:
    return A.sorted_segment(sorted_rows(t), "segment", "v", "max", ["o_orderkey"])


@query("select s.range as segment, coalesce(v, 0)::double as value from range(150) s left join (" + SPARSE.format(agg="sum(p_retailprice)").replace("round(sum(p_retailprice), 4) as value", "round(sum(p_retailprice), 4) as v") + ") g on g.segment = s.range")
def sparse_segment_sum_dense(t: Tables) -> DataFrame:
    found = A.sparse_segment(t.lineitem, t.part, "l_partkey", "l_suppkey", "p_partkey", "p_retailprice", "sum", 150)
    return found.select("segment", F.round("value", 4).alias("value"))


@query("""
with m as (select l_returnflag, l_extendedprice as v, sum(l_quantity) as w from lineitem where l_quantity > 0 group by 1, 2),
     c as (select *, sum(w) over (partition by l_returnflag order by v) as up, sum(w) over (partition by l_returnflag) as total from m)
select l_returnflag, min(v) filter (up >= 0.1 * total) as q0, min(v) filter (up >= 0.9 * total) as q1 from c group by 1
""")
def weighted_quantiles(t: Tables) -> DataFrame:
    return A.weighted_quantiles(t.lineitem, ["l_returnflag"], "l_extendedprice", "l_quantity", [0.1, 0.9])


@query("select count(*) as n, max(o_orderkey) as top, round(avg(o_totalprice), 4) as mean from orders")
def observed_metrics(t: Tables) -> DataFrame:
    """The counters that a pass over the rows leaves behind."""
    df, watch = A.observed(t.orders, "orders", n=F.count(F.lit(1)), top=F.max("o_orderkey"), mean=F.round(F.avg("o_totalprice"), 4))
    df.write.format("noop").mode("overwrite").save()
    found = watch.get
    return t.spark.createDataFrame([(found["n"], found["top"], found["mean"])], "n long, top long, mean double")
