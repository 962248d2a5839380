"""Queries of sources, row transforms, windows and orders."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.operators import ordering, queues, sort, transform, window
from rillflow.operators.join import gather
from rillflow.operators.queues import Queue
from rillflow.plans.flow import Flow
from rillflow.queries.registry import Tables, query
from rillflow.sources import files

text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


@query("""
with e as (select *, (row_number() over (partition by user_id order by event_id) - 1) // 4 as w from events where value > 1),
     g as (select user_id, cast(w as bigint) as "window", round(sum(value * 2), 4) as total, count(*) as n from e group by user_id, w)
select user_id, "window", total, n from (select *, row_number() over (partition by user_id order by total desc, "window") as r from g) where r <= 3
""")
def flagship(t: Tables) -> DataFrame:
    flow = Flow.of(t.events, "event_id").filter("value > 1").map("user_id", (F.col("value") * 2).alias("v"))
    windows = flow.group_by_window(["user_id"], 4, F.round(F.sum("v"), 4).alias("total"), F.count(F.lit(1)).alias("n"))
    return sort.top_k_per_row(windows.df, ["user_id"], "total", 3, ["window"]).drop("rank")


@query("select event_id, user_id from events where value > 10 and event_type <> 'click' and user_id % 3 = 0")
def filter_chain(t: Tables) -> DataFrame:
    return Flow.of(t.events, "event_id").filter("value > 10").filter("event_type <> 'click'").filter("user_id % 3 = 0").map("user_id").df


@query("select l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) as net from lineitem where l_quantity > 25")
def map_filter_fused(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("net"), (F.col("l_quantity") > 25).alias("keep"))
    return transform.filter_by_last(rows)


@query('select n_nationkey, n_name, row_number() over (order by n_nationkey) + 19 as "index" from nation')
def enumerate_start(t: Tables) -> DataFrame:
    return Flow.of(t.nation.select("n_nationkey", "n_name"), "n_nationkey").enumerate(20).df


@query("""
select n_name, r_name, n.i as pos from (select n_name, row_number() over (order by n_nationkey) - 1 as i from nation) n
join (select r_name, row_number() over (order by r_regionkey) - 1 as i from region) r on n.i = r.i
""")
def zip_positional(t: Tables) -> DataFrame:
    return Flow.of(t.nation, "n_nationkey").zip(Flow.of(t.region, "r_regionkey")).df.select("n_name", "r_name", "pos")


@query("select least((select count(*) from supplier), (select count(*) from part)) as n")
def zip_shortest_len(t: Tables) -> DataFrame:
    zipped = transform.zip_rows([t.supplier.select("s_suppkey"), t.part.select("p_partkey")], [["s_suppkey"], ["p_partkey"]])
    return zipped.agg(F.count(F.lit(1)).alias("n"))


@query("select 0 as part, r_name as name from region union all select 1, n_name from nation")
def concatenate_ordered(t: Tables) -> DataFrame:
    return transform.concatenate(t.region.select(F.col("r_name").alias("name")), t.nation.select(F.col("n_name").alias("name")))


@query("select e.range::int as epoch, r_regionkey from region, range(3) e")
def repeat_epochs(t: Tables) -> DataFrame:
    return Flow.of(t.region.select("r_regionkey"), "r_regionkey").repeat(3).df


@query("select o_orderkey from orders order by o_orderkey limit 50 offset 100")
def take_skip(t: Tables) -> DataFrame:
    return Flow.of(t.orders.select("o_orderkey"), "o_orderkey").skip(100).take(50).df


@query("select o_orderkey from (select o_orderkey, row_number() over (order by o_orderkey) - 1 as i from orders) where i % 7 = 3")
def shard_mod(t: Tables) -> DataFrame:
    return Flow.of(t.orders.select("o_orderkey"), "o_orderkey").shard(7, 3).df


@query("""
select round, slot, "inner", name from (
  select (i // 2)::bigint as round, 0 as slot, (i % 2)::bigint as "inner", name from (select n_name as name, row_number() over (order by n_nationkey) - 1 as i from nation)
  union all
  select (i // 2)::bigint, 1, (i % 2)::bigint, name from (select s_name as name, row_number() over (order by s_suppkey) - 1 as i from supplier))
""")
def interleave_blocks(t: Tables) -> DataFrame:
    return transform.interleave([t.nation.select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("k")), t.supplier.select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("k"))], [["k"], ["k"]], 2).drop("k")


@query("""
with e as (select event_id, (row_number() over (order by event_id) - 1) // 32 as batch from events)
select cast(batch as bigint) as batch, count(*) as n, min(event_id) as first_id, max(event_id) as last_id from e group by batch having count(*) = 32
""")
def batch_drop_remainder(t: Tables) -> DataFrame:
    b = Flow.of(t.events.select("event_id"), "event_id").batch(32, "event_id", drop_remainder=True).df
    return b.select("batch", "n", F.array_min("items").alias("first_id"), F.array_max("items").alias("last_id"))


@query("""
with c as (select *, row_number() over (order by conv_id, turn) - 1 as i, string_split(text, ' ') as w from conversations),
     b as (select *, i // 4 as batch, max(len(w)) over (partition by i // 4) as longest from c)
select cast(batch as bigint) as batch, longest::int as length, sum(len(w))::bigint as words, sum(longest - len(w))::bigint as padding from b group by batch, longest
""")
def padded_batch(t: Tables) -> DataFrame:
    rows = t.conversations.select("conv_id", "turn", F.split("text", " ").alias("w"))
    b = Flow.of(rows, "conv_id", "turn").padded_batch(4, "w", F.lit("<pad>").cast("string")).df
    pads = F.aggregate(F.transform("items", lambda a: F.size(F.filter(a, lambda x: x == "<pad>"))), F.lit(0), lambda s, x: s + x)
    every = F.aggregate(F.transform("items", lambda a: F.size(a)), F.lit(0), lambda s, x: s + x)
    return b.select("batch", "length", (every - pads).cast("long").alias("words"), pads.cast("long").alias("padding"))


@query("""
with c as (select row_number() over (order by conv_id, turn) - 1 as i, string_split(text, ' ') as w from conversations)
select (i // 4)::bigint as batch, (i % 4)::bigint as "row", j::int as col, w[j + 1] as value from c, unnest(range(len(w))) as u(j)
""")
def dense_to_sparse_batch(t: Tables) -> DataFrame:
    rows = t.conversations.select("conv_id", "turn", F.split("text", " ").alias("w"))
    return window.dense_to_sparse_batch(rows, 4, ["conv_id", "turn"], "w")


@query("""
with e as (select row_number() over (order by event_id) - 1 as i, event_id as a, lead(event_id) over (order by event_id) as b, lead(event_id, 2) over (order by event_id) as c from events)
select i as start, concat(a, ',', b, ',', c) as items from e where i % 2 = 0 and c is not null
""")
def sliding_window(t: Tables) -> DataFrame:
    return Flow.of(t.events.select("event_id"), "event_id").window(3, "event_id", shift=2).df.select("start", text("items").alias("items"))


@query("""
with e as (select row_number() over (order by event_id) - 1 as i, event_id as a, lead(event_id, 2) over (order by event_id) as b, lead(event_id, 4) over (order by event_id) as c from events)
select i as start, concat(a, ',', b, ',', c) as items from e where c is not null
""")
def sliding_window_strided(t: Tables) -> DataFrame:
    return Flow.of(t.events.select("event_id"), "event_id").window(3, "event_id", stride=2).df.select("start", text("items").alias("items"))


@query("""
with e as (select *, (row_number() over (partition by user_id order by event_id) - 1) // 4 as w from events)
select user_id, cast(w as bigint) as "window", count(*) as n, round(sum(value), 4) as total from e group by user_id, w
""")
def group_by_window(t: Tables) -> DataFrame:
    return Flow.of(t.events, "event_id").group_by_window(["user_id"], 4, F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).df


@query("""
with e as (select *, (row_number() over (partition by event_type order by event_id) - 1) // 100 as w from events)
select event_type, cast(w as bigint) as "window", count(*) as n, min(event_id) as first_id from e group by event_type, w
""")
def group_by_window_spread(t: Tables) -> DataFrame:
    """Few keys of many rows."""
    return window.group_by_window(t.events, ["event_type"], 100, ["event_id"], F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"), spread=True)


@query("""
with d as (select doc_id, case when n_chars < 500 then 0 when n_chars < 2000 then 1 when n_chars < 8000 then 2 else 3 end as bucket from documents),
     r as (select *, row_number() over (partition by bucket order by doc_id) - 1 as i from d)
select bucket, cast(i // (case bucket when 0 then 64 when 1 then 32 when 2 then 16 else 4 end) as bigint) as batch, count(*) as n, min(doc_id) as first_id from r group by 1, 2
""")
def bucket_by_length(t: Tables) -> DataFrame:
    b = window.bucket_by_length(t.documents.select("doc_id", "n_chars"), F.col("n_chars"), [500, 2000, 8000], [64, 32, 16, 4], ["doc_id"], "doc_id")
    return b.select("bucket", "batch", "n", F.array_min("items").alias("first_id"))


@query("select o_orderkey, round(sum(o_totalprice) over (partition by o_custkey order by o_orderkey), 2) as running from orders")
def scan_running_sum(t: Tables) -> DataFrame:
    rows = ordering.running(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), "o_totalprice", ["o_orderkey"], "s", partition=["o_custkey"])
    return rows.select("o_orderkey", F.round("s", 2).alias("running"))


@query("""
select c_custkey, i, b from (select c_custkey, row_number() over (order by c_custkey) as i from customer), lateral (select
  cast(round((power((1 + sqrt(5)) / 2, ((i - 1) % 20) + 1) - power((1 - sqrt(5)) / 2, ((i - 1) % 20) + 1)) / sqrt(5)) as bigint) as b)
""")
def scan_pairs(t: Tables) -> DataFrame:
    """The fold (a, b) -> (b, a + b) from (0, 1), giving out b of each step, started anew every 20 rows."""
    rows = ordering.numbered(t.customer.select("c_custkey"), ["c_custkey"], "i", 1).withColumn("g", F.floor((F.col("i") - 1) / 20))
    return window.scan(rows, ["g"], ["i"], lambda s, r: ((s[1], s[0] + s[1]), (r.c_custkey, r.i, s[1])), (0, 1), "c_custkey long, i long, b long")


@query("select o_orderkey, coalesce(sum(cast(o_totalprice as bigint)) over (order by o_orderkey rows between unbounded preceding and 1 preceding), 0)::bigint as before from orders")
def cumsum_exclusive(t: Tables) -> DataFrame:
    return Flow.of(t.orders.select("o_orderkey", F.rint("o_totalprice").cast("long").alias("v")), "o_orderkey").cumsum("v", "before", exclusive=True).df.drop("v")


@query("select o_orderkey, sum(cast(o_totalprice as bigint)) over (order by o_orderkey desc)::bigint as after from orders")
def cumsum_reverse(t: Tables) -> DataFrame:
    return Flow.of(t.orders.select("o_orderkey", F.rint("o_totalprice").cast("long").alias("v")), "o_orderkey").cumsum("v", "after", reverse=True).df.drop("v")


@query("select p_partkey, product(1 + p_size % 2) over (partition by p_brand order by p_partkey rows between 9 preceding and current row) as p from part")
def cumprod_window(t: Tables) -> DataFrame:
    rows = t.part.select("p_brand", "p_partkey", (1 + F.col("p_size") % 2).alias("v"))
    return window.cumulative_product(rows, "v", ["p_partkey"], ["p_brand"], "p", last=10).select("p_partkey", "p")


@query("select p_brand, p_partkey, product((1 + p_size % 2)::double) over (partition by p_brand, p_size order by p_partkey) as p from part")
def cumprod_partition(t: Tables) -> DataFrame:
    rows = t.part.select("p_brand", "p_size", "p_partkey", (1 + F.col("p_size") % 2).alias("v"))
    return window.cumulative_product(rows, "v", ["p_partkey"], ["p_brand", "p_size"], "p").select("p_brand", "p_partkey", "p")


@query("select user_id, event_id, r::int as r from (select user_id, event_id, row_number() over (partition by user_id order by value desc, event_id) as r from events) where r <= 3")
def topk_per_row(t: Tables) -> DataFrame:
    return sort.top_k_per_row(t.events.select("user_id", "event_id", "value"), ["user_id"], "value", 3, ["event_id"]).select("user_id", "event_id", F.col("rank").alias("r"))


@query("select l_orderkey, l_linenumber, l_extendedprice from lineitem order by l_extendedprice desc, l_orderkey, l_linenumber limit 20")
def topk_global(t: Tables) -> DataFrame:
    return sort.top_k(t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice"), "l_extendedprice", 20, ["l_orderkey", "l_linenumber"])


@query("select vec_id, (select count(*) from unnest(embedding) as u(p) where p > embedding[label + 1]) < 8 as hit from embeddings")
def in_topk(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", sort.in_top_k(F.col("embedding"), F.col("label"), 8).alias("hit"))


#: A draw of the library's own random numbers, in SQL.
DRAW = "cast(('0x' || substring(md5({}), 1, 8)) as bigint)"


@query("with d as (select e.range::int as epoch, r_regionkey, " + DRAW.format("concat_ws(':', 10, e.range, r_regionkey)") + " as d from region, range(5) e) select epoch, r_regionkey, row_number() over (order by epoch, d, r_regionkey) - 1 as \"at\" from d")
def shuffle_and_repeat(t: Tables) -> DataFrame:
    return sort.shuffle_and_repeat(t.region.select("r_regionkey"), 5, 10, ["r_regionkey"])


@query("select o_orderkey, row_number() over (order by " + DRAW.format("concat_ws(':', 7, o_orderkey)") + ", o_orderkey) - 1 as \"at\" from orders")
def shuffle_all(t: Tables) -> DataFrame:
    return Flow.of(t.orders.select("o_orderkey"), "o_orderkey").shuffle(7)


@query("with p as (select o_orderkey, row_number() over (order by o_orderkey) - 1 as pos from orders) select o_orderkey, row_number() over (order by pos * 65536 + (" + DRAW.format("concat_ws(':', 3, o_orderkey)") + " >> 16) * 99, pos) - 1 as \"at\" from p")
def shuffle_buffered(t: Tables) -> DataFrame:
    return sort.buffered_shuffle(t.orders.select("o_orderkey"), 100, 3, ["o_orderkey"])


@query("with r as (select item_id, row_number() over (order by epoch, d, item_id) - 1 as i, epoch from (select item_id, e.range::int as epoch, " + DRAW.format("concat_ws(':', 9, e.range, item_id)") + " as d from benchmark, range(2) e)), n as (select count(*) as n from benchmark) select epoch, ((i - epoch * n) // 16)::bigint as batch, count(*) as n, min(item_id) as least, sum(item_id)::bigint as total from r, n group by 1, 2")
def record_input(t: Tables) -> DataFrame:
    found = files.record_input(t.benchmark.select("item_id"), ["item_id"], 16, 9, 2)
    ids = F.transform("items", lambda x: x["item_id"])
    return found.select("epoch", "batch", "n", F.array_min(ids).alias("least"), F.aggregate(ids, F.lit(0).cast("long"), lambda a, b: a + b).alias("total"))


@query("select user_id, event_id, round(case when value - pv = 0 then 0 else (event_id - pe) / (value - pv) end, 4) as rate from (select *, lag(value, 1, 0) over w as pv, lag(event_id, 1, 0) over w as pe from events window w as (partition by user_id order by event_id))")
def rate_of_change(t: Tables) -> DataFrame:
    return transform.rate(t.events, "event_id", "value", ["event_id"], ["user_id"]).select("user_id", "event_id", F.round("rate", 4).alias("rate"))


@query("select event_id, w, pos::int as item_pos from (select event_id, unnest(string_split(event_type, 'i')) as w, generate_subscripts(string_split(event_type, 'i'), 1) - 1 as pos from events)")
def flat_map_split(t: Tables) -> DataFrame:
    return transform.flat_map(t.events.select("event_id", "event_type"), F.split("event_type", "i"), "w").drop("event_type")


@query("select vec_id, (j - 1)::int as item_pos, round(embedding[j], 5)::double as embedding from embeddings, unnest(range(1, 65)) as u(j)")
def unbatch_rows(t: Tables) -> DataFrame:
    return transform.unbatch(t.embeddings.select("vec_id", F.transform("embedding", lambda x: F.round(x.cast("double"), 5)).alias("embedding")), "embedding")


@query("select event_id, try_cast(json_extract_string(props, '$.k') as bigint) as k from events where try_cast(json_extract_string(props, '$.k') as bigint) is not null")
def ignore_errors(t: Tables) -> DataFrame:
    return transform.ignore_errors(t.events.select("event_id", "props"), k=F.get_json_object("props", "$.k").try_cast("bigint")).drop("props")


@query("select r_name from region where r_regionkey = 2")
def single_element(t: Tables) -> DataFrame:
    return transform.single_element(t.region.where("r_regionkey = 2").select("r_name"))


@query("select range * 3 + 5 as value from range(100)")
def counter_source(t: Tables) -> DataFrame:
    return files.counter(t.spark, 100, 5, 3)


@query("select range as value from range(10, -10, -3)")
def range_source(t: Tables) -> DataFrame:
    return files.number_range(t.spark, 10, -10, -3)


@query("select " + DRAW.format("concat_ws(':', 7, range)") + " as value from range(1000)")
def random_source(t: Tables) -> DataFrame:
    return files.random_rows(t.spark, 1000, 7)


@query("select c_name from customer where c_name >= 'Customer#000000100' and c_name < 'Customer#000000200' or c_name >= 'Customer#0100' and c_name < 'Customer#0200'")
def key_range_scan(t: Tables) -> DataFrame:
    names = t.customer.select("c_name")
    return files.key_range(names, "c_name", "Customer#000000100", "Customer#000000200").union(files.key_range(names, "c_name", "Customer#0100", "Customer#0200"))


@query("select o_orderkey, o_totalprice from orders where o_orderkey = 7")
def indexed_get(t: Tables) -> DataFrame:
    return files.at_index(t.orders.select("o_orderkey", "o_totalprice"), "o_orderkey", 7)


@query("select p.i as i, p_partkey from (select i, (i * 37) % 200 as at from range(300) r(i)) p join (select p_partkey, row_number() over (order by p_partkey) - 1 as pos from part) q on p.at = q.pos")
def gather_rows(t: Tables) -> DataFrame:
    wanted = t.spark.range(300).select(F.col("id").alias("i"), (F.col("id") * 37 % 200).alias("at"))
    return gather(wanted, ordering.numbered(t.part.select("p_partkey"), ["p_partkey"]), "at", "pos").select("i", "p_partkey")


@query("select count(*) as n, candidate from (select least(floor(exp((" + DRAW.format("concat_ws(':', 5, range)") + " + 0.5) / 4294967296 * ln(101)) - 1)::bigint, 99) as candidate from range(20000)) group by candidate")
def log_uniform_candidates(t: Tables) -> DataFrame:
    return files.log_uniform(t.spark, 20_000, 100, 5).groupBy("candidate").agg(F.count(F.lit(1)).alias("n"))


@query("select candidate, count(*) as n from (select (" + DRAW.format("concat_ws(':', 5, range)") + " * 50) >> 32 as candidate from range(20000)) group by 1")
def uniform_candidates(t: Tables) -> DataFrame:
    return files.uniform_candidates(t.spark, 20_000, 50, 5).groupBy("candidate").agg(F.count(F.lit(1)).alias("n"))


@query("with c as (select event_type, count(*) as n from events group by 1), w as (select event_type, sum(n) over (order by event_type) - n as low, sum(n) over (order by event_type) as high, sum(n) over () as total from c), d as (select range as draw, (" + DRAW.format("concat_ws(':', 8, range)") + " + 0.5) / 4294967296 as u from range(3000)) select draw, event_type as candidate from d join w on u >= low / total and u < high / total")
def learned_candidates(t: Tables) -> DataFrame:
    return files.learned_candidates(t.spark, 3000, t.events, "event_type", 8)


@query("select range::int as pos, range * 2 as a, 'v' || range as b from range(40)")
def slices_source(t: Tables) -> DataFrame:
    return files.from_slices(t.spark, a=[2 * k for k in range(40)], b=[f"v{k}" for k in range(40)]).select(F.col("pos").cast("int").alias("pos"), "a", "b")


@query("select 7 as a, 'x' as b")
def tensor_source(t: Tables) -> DataFrame:
    return files.from_values(t.spark, "a int, b string", 7, "x")


@query("select p_partkey, i::int as pos, p_size + i as a, p_size * i as b from part, range(3) r(i)")
def array_slices(t: Tables) -> DataFrame:
    three = F.array(*map(F.lit, range(3)))
    rows = t.part.select("p_partkey", F.transform(three, lambda i: F.col("p_size") + i).alias("a"), F.transform(three, lambda i: F.col("p_size") * i).alias("b"))
    return files.array_slices(rows, "a", "b").select("p_partkey", "pos", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))


@query("select s.range::int as shard, p.range as pos, s.range * 100 + p.range * p.range as value from range(4) s, range(50) p")
def generator_source(t: Tables) -> DataFrame:
    return files.from_generator(t.spark, lambda shard, shards: (shard * 100 + k * k for k in range(50)), "value long", 4).select("shard", "pos", "value")


@query("select n_nationkey::bigint as k, e.range::int as epoch from nation, range(3) e")
def pandas_source(t: Tables) -> DataFrame:
    import numpy as np

    return files.from_pandas(t.spark, {"k": np.arange(25)}, 3).select("k", "epoch")


@query("select ['a', 'b', 'c'][(n_nationkey % 3 + 1)::int] as item, n_nationkey from nation")
def obtain_next(t: Tables) -> DataFrame:
    return t.nation.select(files.obtain_next(["a", "b", "c"], F.col("n_nationkey")).alias("item"), "n_nationkey")


@query("select e.range::int as epoch, v as key, v as value from range(2) e, (values ('a'), ('b')) x(v)")
def identity_reader(t: Tables) -> DataFrame:
    return files.work_items(t.spark, ["a", "b"], 2).select("epoch", "key", "value")


@query("select o_orderkey from (select o_orderkey, row_number() over (order by o_orderkey) - 1 as i from orders) where i >= 30 and i < 50")
def read_up_to(t: Tables) -> DataFrame:
    """The third pull of a cursor, after its state was written and taken up by another."""
    reader = files.Reader(t.orders.select("o_orderkey"), ["o_orderkey"])
    reader.read_up_to(10)
    reader.read_up_to(20)
    other = files.Reader(t.orders.select("o_orderkey"), ["o_orderkey"])
    other.restore(reader.serialize())
    return other.read_up_to(20).select("o_orderkey")


@query("select c_name, concat(c_name, '-?????-of-', lpad(c_nationkey::varchar, 5, '0')) as spec from customer")
def sharded_filespec(t: Tables) -> DataFrame:
    return t.customer.select("c_name", files.sharded_filespec(F.col("c_name"), F.col("c_nationkey")).alias("spec"))


@query("select c_name from customer where c_name like 'Customer%7%' and starts_with(c_name, 'Customer#00')")
def key_prefix_scan(t: Tables) -> DataFrame:
    return files.key_range(t.customer.select("c_name"), "c_name", prefix="Customer#00").where("c_name like '%7%'")


@query("select c_name from customer where " + DRAW.format("concat_ws(':', 0, c_name)") + " < 1073741824")
def key_sampled_scan(t: Tables) -> DataFrame:
    return files.key_range(t.customer.select("c_name"), "c_name", probability=0.25)


@query("""
with e as (select event_id, (row_number() over (order by event_id) - 1) // 16 as batch, event_id * 2 as v from events)
select cast(batch as bigint) as batch, count(*) as n, sum(v)::bigint as total from e group by 1
""")
def map_and_batch(t: Tables) -> DataFrame:
    found = transform.map_and_batch(t.events, F.col("event_id") * 2, 16, ["event_id"])
    return found.select("batch", "n", F.aggregate("items", F.lit(0).cast("long"), lambda a, b: a + b).alias("total"))


@query("""
with s as (select s_suppkey as k, row_number() over (partition by s_suppkey % 4 order by s_suppkey) - 1 as i, s_suppkey % 4 as f from supplier),
 r as (select f, ceil(count(*) / 2)::bigint as rounds from s group by 1), g as (select (select rounds from r where f = 0) as r0, (select rounds from r where f = 1) as r1, coalesce((select rounds from r where f = 2), 0) as r2),
 p as (select 0 as f, 0 as slot, 0::bigint as b union all select 1, 1, 0 union all select 2, case when r0 <= r1 then 0 else 1 end, least(r0, r1) from g
   union all select 3, case when r0 <= r1 then (case when r0 + r2 <= r1 then 0 else 1 end) else (case when r0 <= r1 + r2 then 0 else 1 end) end, case when r0 <= r1 then least(r0 + r2, r1) else least(r0, r1 + r2) end from g)
select s.k, (i // 2 + b)::bigint as round, slot, (i % 2)::bigint as "inner" from s join p on p.f = s.f
""")
def interleave_cycle(t: Tables) -> DataFrame:
    """Four frames through two slots."""
    frames = [t.supplier.where(F.col("s_suppkey") % 4 == f).select(F.col("s_suppkey").alias("k")) for f in range(4)]
    return transform.interleave(frames, [["k"]] * 4, 2, 2)


@query("select n_name as name from nation union all select r_name from region")
def interleave_sloppy(t: Tables) -> DataFrame:
    return transform.sloppy_interleave([t.nation.select(F.col("n_name").alias("name")), t.region.select(F.col("r_name").alias("name"))])


@query("""
with e as (select event_id, row_number() over (order by event_id) - 1 as i, count(*) over () as n from events)
select (i - k) // 3 as "window", k::int as part, event_id from e, range(4) r(k) where i - k >= 0 and (i - k) % 3 = 0 and i - k + 4 <= n
""")
def window_datasets(t: Tables) -> DataFrame:
    found = window.window_datasets(t.events, 4, ["event_id"], ["event_id"], shift=3)
    return found.select("window", "part", F.col("item.event_id").alias("event_id"))


@query("select time_bucket(interval '1 hour', ts) as open, ((row_number() over (partition by time_bucket(interval '1 hour', ts) order by event_id) - 1) // 5)::bigint as batch, event_id from events")
def dynamic_batches(t: Tables) -> DataFrame:
    found = window.dynamic_batches(t.events, "ts", ["event_id"], 5, "1 hour", "event_id")
    return found.select("open", "batch", F.explode("items").alias("event_id"))


@query("select o_orderkey, 100 + sum(o_custkey) over (order by o_orderkey)::bigint as state from orders")
def scan_sums(t: Tables) -> DataFrame:
    return window.scan_sums(t.orders.select("o_orderkey", "o_custkey"), ["o_orderkey"], "o_custkey", 100).select("o_orderkey", "state")


@query("select o_orderkey, o_custkey, row_number() over w as row_number, rank() over w as rank, dense_rank() over w as dense_rank, ntile(3) over w as ntile from orders window w as (partition by o_custkey order by o_orderpriority, o_orderkey)")
def ranking(t: Tables) -> DataFrame:
    return sort.ranked(t.orders.select("o_orderkey", "o_custkey", "o_orderpriority"), ["o_custkey"], ["o_orderpriority", "o_orderkey"], 3).drop("o_orderpriority")


@query("select o_orderkey, lag(o_totalprice, 2, 0.0) over w as before, lead(o_totalprice, 2, 0.0) over w as after from orders window w as (partition by o_custkey order by o_orderkey)")
def lag_lead(t: Tables) -> DataFrame:
    return sort.neighbours(t.orders, "o_totalprice", ["o_custkey"], ["o_orderkey"], 2, 0.0).select("o_orderkey", "before", "after")


@query("select o_orderkey, row_number() over (order by o_custkey % 7, o_custkey, o_orderkey) - 1 as \"at\" from orders")
def priority_queue(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", "o_custkey", (F.col("o_custkey") % 7).alias("priority"))
    found, left = Queue.prioritised(rows, "priority", "o_custkey", "o_orderkey").take(1 << 40)
    return found.unionByName(left.rows.withColumn("at", F.lit(-1).cast("long"))).select("o_orderkey", "at")


@query("with q as (select k, row_number() over (order by k) - 1 as i from (select r_regionkey as k from region union all select 100 + n_nationkey from nation)) select (i // 4)::bigint as batch, count(*) as n, sum(k)::bigint as total from q group by 1 having count(*) = 4")
def fifo_queue(t: Tables) -> DataFrame:
    queue = Queue.fifo(t.region.select(F.col("r_regionkey").cast("long").alias("k")), "k").enqueue_many(t.nation.select((100 + F.col("n_nationkey")).cast("long").alias("k")))
    return queue.dequeue_many(4, "k").select("batch", "n", F.aggregate("items", F.lit(0).cast("long"), lambda a, b: a + b).alias("total"))


@query("with q as (select n_nationkey as k, row_number() over (order by n_nationkey) - 1 as i from nation) select (i // 4)::bigint as batch, count(*) as n from q group by 1")
def queue_up_to(t: Tables) -> DataFrame:
    return Queue.fifo(t.nation.select(F.col("n_nationkey").alias("k")), "k").close().dequeue_up_to(4, "k").select("batch", "n")


@query("with c as (select row_number() over (order by conv_id, turn) - 1 as i, len(string_split(text, ' ')) as n from conversations) select (i // 8)::bigint as batch, max(n)::int as length, count(*) as n from c group by 1 having count(*) = 8")
def padding_queue(t: Tables) -> DataFrame:
    rows = t.conversations.select("conv_id", "turn", F.split("text", " ").alias("w"))
    return Queue.fifo(rows, "conv_id", "turn").dequeue_padded(8, "w", F.lit("")).where("n = 8").select("batch", "length", "n")


@query("select s_suppkey, row_number() over (order by " + DRAW.format("concat_ws(':', 4, s_suppkey)") + ", s_suppkey) - 1 as \"at\" from supplier")
def shuffle_queue(t: Tables) -> DataFrame:
    return Queue.random(t.supplier.select("s_suppkey"), 4, "s_suppkey").take(1 << 40)[0]


@query("select o_orderkey, \"at\" from (select o_orderkey, row_number() over (order by o_orderkey desc) - 1 as \"at\" from orders) where \"at\" < 500")
def stack_pop(t: Tables) -> DataFrame:
    return queues.popped(t.orders.select("o_orderkey"), ["o_orderkey"], 500)[0]


@query("select o_custkey as k, max(o_orderkey) filter (o_orderkey % 2 = 0) as a, max(o_orderkey) filter (o_orderkey % 2 = 1) as b from orders group by 1 having a is not null and b is not null")
def map_stage(t: Tables) -> DataFrame:
    last = t.orders.groupBy(F.col("o_custkey").alias("k"), (F.col("o_orderkey") % 2).alias("side")).agg(F.max("o_orderkey").alias("v"))
    rows = last.select("k", F.when(F.col("side") == 0, F.col("v")).alias("a"), F.when(F.col("side") == 1, F.col("v")).alias("b"))
    return queues.staged(rows, "k", ["a", "b"])


@query("select c_custkey from customer where c_custkey in (select c_custkey from customer order by c_custkey limit 7)")
def ordered_unstage(t: Tables) -> DataFrame:
    return queues.unstaged(t.customer.select("c_custkey"), "c_custkey", n=7)[0]


@query("select n_nationkey, n_name from nation")
def cached(t: Tables) -> DataFrame:
    rows = transform.cached(t.nation.select("n_nationkey", "n_name"))
    return transform.identity(rows)


@query("select o_orderkey, upper(o_orderpriority) as value from orders")
def python_function(t: Tables) -> DataFrame:
    return transform.apply_python(t.orders.select("o_orderkey", "o_orderpriority"), upper, "string", "o_orderpriority").drop("o_orderpriority")


def upper(s: pd.Series) -> pd.Series:
    return s.str.upper()


@query("select vec_id, list_sum(list_transform(embedding, lambda x: round(x::double * 100)))::double as total from embeddings")
def map_defun(t: Tables) -> DataFrame:
    found = transform.map_elements(F.col("embedding"), lambda x: F.round(x.cast("double") * 100))
    return t.embeddings.select("vec_id", F.aggregate(found, F.lit(0.0), lambda a, b: a + b).alias("total"))


@query("with recursive c as (select n_nationkey as k, n_nationkey + 1 as v, 0 as steps from nation union all select k, case when v % 2 = 0 then v // 2 else 3 * v + 1 end, steps + 1 from c where v > 1) select k::bigint as k, max(steps)::bigint as steps from c group by 1")
def while_loop(t: Tables) -> DataFrame:
    """Halve what is even, else treble it and add one, until it is one."""
    rows = t.nation.select(F.col("n_nationkey").cast("long").alias("k"), (F.col("n_nationkey") + 1).cast("long").alias("v"), F.lit(0).cast("long").alias("steps"))
    step = lambda df: df.select("k", F.when(F.col("v") % 2 == 0, F.shiftright("v", 1)).otherwise(F.col("v") * 3 + 1).alias("v"), (F.col("steps") + 1).alias("steps"))
    return transform.while_loop(rows, F.col("v") > 1, step, 40).select("k", "steps")


@query("select n_nationkey, case when n_regionkey = 1 then 'one' else 'other' end as kind, n_regionkey + 3 as v from nation")
def conditional(t: Tables) -> DataFrame:
    rows = t.nation.select("n_nationkey", "n_regionkey")
    named = transform.if_else(rows, F.col("n_regionkey") == 1, lambda d: d.withColumn("kind", F.lit("one")), lambda d: d.withColumn("kind", F.lit("other")))
    return transform.for_loop(named.withColumn("v", F.col("n_regionkey")), 0, 3, 1, lambda d, k: d.withColumn("v", F.col("v") + 1)).drop("n_regionkey")


@query("select n_nationkey, reverse(n_name) as answer, null::varchar as status from nation")
def remote_call(t: Tables) -> DataFrame:
    """A service that reverses what it is sent."""
    rows = t.nation.select("n_nationkey", F.col("n_name").cast("binary").alias("request"))
    found = transform.call_remote(rows, lambda asked: [a[::-1] for a in asked], "request", errors=True)
    return found.select("n_nationkey", F.col("response").cast("string").alias("answer"), "status")


@query("select n_nationkey, concat('<', n_name, '>') as name from nation")
def registered_function(t: Tables) -> DataFrame:
    transform.register_function(t.spark, "rillflow_bracketed", bracketed, "string")
    return t.nation.selectExpr("n_nationkey", "rillflow_bracketed(n_name) as name")


def bracketed(s: pd.Series) -> pd.Series:
    return "<" + s + ">"


@query("select o_orderkey from (select o_orderkey, row_number() over (order by o_orderkey) - 1 as i from orders) where i = 25")
def iterator_resume(t: Tables) -> DataFrame:
    """A cursor's state saved to a file, loaded by another, which gives the next row."""
    from rillflow.session import cut, scratch

    with scratch(t.spark) as folder:
        one = files.Reader(t.orders.select("o_orderkey"), ["o_orderkey"])
        one.read_up_to(25)
        one.save(f"{folder}/state")
        two = files.Reader(t.orders.select("o_orderkey"), ["o_orderkey"])
        two.load(f"{folder}/state")
        return cut(two.next_or_none().select("o_orderkey"))


@query("select o_orderkey, 100 // o_custkey as share from orders where o_custkey % 5 <> 0")
def ignore_errors_opaque(t: Tables) -> DataFrame:
    """A function that fails on every fifth customer."""
    return transform.map_ignoring_errors(t.orders.select("o_orderkey", "o_custkey"), shares, "o_orderkey long, share long")


def shares(pdf: pd.DataFrame) -> pd.DataFrame:
    if (pdf["o_custkey"] % 5 == 0).any():
        raise ValueError("not this one")
    return pd.DataFrame({"o_orderkey": pdf["o_orderkey"], "share": 100 // pdf["o_custkey"]})


@query("select n_nationkey, n_name, 1 as one from nation")
def batches_of_arrow(t: Tables) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([1] * b.num_rows, pa.int32())], names=[*b.schema.names, "one"])

    return transform.map_batches(t.nation.select("n_nationkey", "n_name"), run, "n_nationkey int, n_name string, one int")
