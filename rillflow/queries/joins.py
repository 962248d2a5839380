"""Queries of joins, lookups and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.operators import feature_columns as FC
from rillflow.operators import join as J
from rillflow.operators import sets
from rillflow.operators.ordering import numbered
from rillflow.queries.registry import Tables, query


@query("select n_nationkey, coalesce(r_name, 'none') as value from nation left join (select * from region where r_regionkey < 3) on n_regionkey = r_regionkey")
def lookup_default(t: Tables) -> DataFrame:
    return J.lookup(t.nation, t.region.where("r_regionkey < 3"), "n_regionkey", "r_regionkey", "r_name", F.lit("none")).select("n_nationkey", "value")


MD5 = "cast(('0x' || substring(md5({}), 1, 8)) as bigint)"


@query(f"""
with v as (select event_type, row_number() over (order by event_type) - 1 as id from (select distinct event_type from events) where event_type < 'p')
select event_id, coalesce(id, 3 + {MD5.format('e.event_type')} % 5) as id from events e left join v on e.event_type = v.event_type
""")
def lookup_oov_buckets(t: Tables) -> DataFrame:
    terms = numbered(t.events.where("event_type < 'p'").select("event_type").distinct(), ["event_type"], "id")
    return J.lookup_oov(t.events.select("event_id", "event_type"), terms, "event_type", "event_type", "id", 3, 5, "id").select("event_id", "id")


@query("select o_orderkey as k, o_totalprice as price, q as quantity from orders join (select l_orderkey, sum(l_quantity) as q from lineitem group by 1) on l_orderkey = o_orderkey")
def barrier_complete(t: Tables) -> DataFrame:
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.sum("l_quantity").alias("quantity"))
    return J.barrier({"price": t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price")), "quantity": lines}, "k")


@query("select p_partkey, p_size + coalesce(c, 0) as p_size from (select p_partkey, p_size::bigint as p_size from part) left join (select l_partkey, sum(l_linenumber)::bigint as c from lineitem group by 1) on l_partkey = p_partkey")
def scatter_add(t: Tables) -> DataFrame:
    change = t.lineitem.select("l_partkey", F.col("l_linenumber").cast("long").alias("p_size"))
    return J.scatter(change, t.part.select("p_partkey", F.col("p_size").cast("long").alias("p_size")), "l_partkey", "p_size", "p_partkey")


@query("select c_custkey, coalesce(v, c_acctbal) as c_acctbal from customer left join (select o_custkey, max_by(o_totalprice, o_orderkey) as v from orders group by 1) on o_custkey = c_custkey")
def scatter_update(t: Tables) -> DataFrame:
    change = t.orders.select("o_custkey", F.col("o_totalprice").alias("c_acctbal"), F.col("o_orderkey").alias("ord"))
    return J.scatter(change, t.customer.select("c_custkey", "c_acctbal"), "o_custkey", "c_acctbal", "c_custkey", "update")


#: Vectors as the rows of a sparse matrix, their components in hundredths; and a matrix of weights, 64 by 8.
COO = "with e as (select vec_id, (j - 1)::int as k, cast(round(embedding[j]::double * 100) as bigint) as v from embeddings, unnest(range(1, 65)) as u(j)), w as (select k.range as k, j.range as j, (3 * k.range + 5 * j.range) % 7 - 3 as v from range(64) k, range(8) j)"


def coo(t: Tables) -> DataFrame:
    scaled = F.transform("embedding", lambda x: F.round(x.cast("double") * 100).cast("long"))
    return t.embeddings.select(F.col("vec_id").alias("i"), F.posexplode(scaled).alias("k", "v"))


def weights(t: Tables) -> DataFrame:
    cells = t.spark.range(512).select(F.floor(F.col("id") / 8).cast("int").alias("k"), (F.col("id") % 8).alias("j"))
    return cells.withColumn("v", (3 * F.col("k") + 5 * F.col("j")) % 7 - 3)


@query(COO + " select vec_id as i, j, sum(e.v * w.v)::bigint as v from e join w on e.k = w.k group by 1, 2")
def coo_matmul(t: Tables) -> DataFrame:
    return J.coo_matmul(coo(t), weights(t))


@query(COO + " select vec_id as i, j, sum(e.v * w.v)::bigint as v from e join w on e.k = w.k where (vec_id + j) % 7 = 0 group by 1, 2")
def masked_matmul(t: Tables) -> DataFrame:
    columns = F.filter(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long")), lambda j: (j + F.col("vec_id")) % 7 == 0)
    return J.masked_matmul(coo(t), weights(t), t.embeddings.select(F.col("vec_id").alias("i"), F.explode(columns).alias("j")))


@query("select c_custkey, concat_ws('_X_', s, n) as cross from (select c_custkey, unnest([c_mktsegment, 'ANY']) as s, c_nationkey::varchar as n from customer)")
def feature_cross(t: Tables) -> DataFrame:
    rows = t.customer.select("c_custkey", F.array("c_mktsegment", F.lit("ANY")).alias("a"), F.array(F.col("c_nationkey").cast("string")).alias("b"))
    return J.feature_cross(rows, ["a", "b"]).select("c_custkey", "cross")


@query(f"select c_custkey, {MD5.format('concat_ws($$_X_$$, c_mktsegment, c_nationkey::varchar)')} % 100 as bucket from customer")
def crossed_column(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", FC.crossed(["c_mktsegment", "c_nationkey"], 100).alias("bucket"))


@query("select c_custkey from customer where c_custkey in (select o_custkey from orders where o_totalprice > 100000)")
def semi_join(t: Tables) -> DataFrame:
    return t.customer.join(t.orders.where("o_totalprice > 100000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders)")
def anti_join(t: Tables) -> DataFrame:
    return t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("select n_name, r_name, s_suppkey from nation left join region on n_regionkey = r_regionkey full join supplier on s_nationkey = n_nationkey")
def outer_joins(t: Tables) -> DataFrame:
    left = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return left.join(t.supplier, F.col("s_nationkey") == F.col("n_nationkey"), "full").select("n_name", "r_name", "s_suppkey")


@query("select p_partkey, r.range as band from part join range(40) r on p_retailprice >= 900 + r.range * 25 and p_retailprice < 960 + r.range * 25")
def range_join(t: Tables) -> DataFrame:
    bands = t.spark.range(40).select(F.col("id").alias("band"), (F.lit(900.0) + F.col("id") * 25).alias("low"), (F.lit(960.0) + F.col("id") * 25).alias("high"))
    return J.range_join(t.part, bands, "p_retailprice", "low", "high", 50.0).select("p_partkey", "band")


@query("""
select e.event_id, (select max_by(v, (ts, v)) from (select user_id as u, ts, value as v from events where event_type = 'purchase') p where p.u = e.user_id and p.ts <= e.ts) as last_value
from events e where event_type = 'click'
""")
def asof_join(t: Tables) -> DataFrame:
    clicks = t.events.where("event_type = 'click'").select("event_id", "user_id", "ts")
    bought = t.events.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("at"), F.col("value").alias("last_value"))
    return J.as_of(clicks, bought, "user_id", "ts", "at", "last_value").select("event_id", "last_value")


@query("""
select e.event_id, (select max_by(v, (ts, v)) from (select user_id as u, ts, value as v from events where event_type = 'purchase') p where p.u = e.user_id and p.ts <= e.ts) as last_value
from events e where event_type = 'click'
""")
def asof_join_spread(t: Tables) -> DataFrame:
    """The same, a key's rows spread over ranges of time."""
    clicks = t.events.where("event_type = 'click'").select("event_id", "user_id", "ts")
    bought = t.events.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("at"), F.col("value").alias("last_value"))
    return J.as_of(clicks, bought, "user_id", "ts", "at", "last_value", spread=True).select("event_id", "last_value")


USERS = """with u as (select user_id, list(distinct event_type) filter (event_id % 2 = 0) as a, list(distinct event_type) filter (event_id % 3 = 0) as b from events group by 1),
 w as (select user_id, coalesce(a, []) as a, coalesce(b, []) as b from u) """


def user_sets(t: Tables) -> DataFrame:
    kinds = lambda n: F.collect_set(F.when(F.col("event_id") % n == 0, F.col("event_type")))
    return t.events.groupBy("user_id").agg(kinds(2).alias("a"), kinds(3).alias("b"))


@query(USERS + "select user_id, array_to_string(list_sort(list_distinct(list_concat(a, b))), ',') as s from w")
def set_union(t: Tables) -> DataFrame:
    return user_sets(t).select("user_id", F.array_join(sets.row_sets(F.col("a"), F.col("b"), "union"), ",").alias("s"))


@query(USERS + "select user_id, array_to_string(list_sort(list_intersect(a, b)), ',') as s from w")
def set_intersection(t: Tables) -> DataFrame:
    return user_sets(t).select("user_id", F.array_join(sets.row_sets(F.col("a"), F.col("b"), "intersection"), ",").alias("s"))


@query(USERS + "select user_id, array_to_string(list_sort(list_filter(a, lambda x: not list_contains(b, x))), ',') as s from w")
def set_difference(t: Tables) -> DataFrame:
    return user_sets(t).select("user_id", F.array_join(sets.row_sets(F.col("a"), F.col("b"), "a-b"), ",").alias("s"))


@query("select user_id, count(distinct event_type)::int as n from events group by 1")
def set_size(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.collect_list("event_type").alias("a")).select("user_id", sets.set_size(F.col("a")).alias("n"))


@query("select o_custkey, o_orderkey, pos from (select *, row_number() over (order by o_orderkey) - 1 as pos from orders) where o_custkey not in (select c_custkey from customer where c_acctbal > 0)")
def list_diff(t: Tables) -> DataFrame:
    x = numbered(t.orders.select("o_custkey", "o_orderkey"), ["o_orderkey"])
    return sets.list_diff(x, t.customer.where("c_acctbal > 0"), "o_custkey", "c_custkey")


@query("select c_nationkey as k from customer intersect all select s_nationkey from supplier")
def intersect_all(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_nationkey").alias("k")).intersectAll(t.supplier.select("s_nationkey"))


@query("select c_nationkey as k from customer except all select s_nationkey from supplier")
def except_all(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_nationkey").alias("k")).exceptAll(t.supplier.select("s_nationkey"))


@query("select event_id, (event_id % 3)::int as part from events where event_id % 3 <> 1")
def dynamic_partition(t: Tables) -> DataFrame:
    parts = sets.dynamic_partition(t.events.select("event_id", (F.col("event_id") % 3).cast("int").alias("part")), "part", 3)
    return parts[0].union(parts[2])


@query("select k, max_by(v, src) as v from (select event_id as k, event_type as v, 0 as src from events union all select event_id, upper(event_type), 1 from events where event_id % 2 = 0) group by 1")
def dynamic_stitch(t: Tables) -> DataFrame:
    first = t.events.select(F.col("event_id").alias("k"), F.col("event_type").alias("v"))
    second = t.events.where("event_id % 2 = 0").select(F.col("event_id").alias("k"), F.upper("event_type").alias("v"))
    return sets.dynamic_stitch([first, second], "k", "v")


@query("""
with c as (select event_id, (event_id % 2)::int as f from events), w as (select row_number() over (order by event_id) - 1 as "at", f, row_number() over (partition by f order by event_id) - 1 as turn from c),
r as (select 0 as f, c_name as name, row_number() over (order by c_custkey) - 1 as turn from customer union all select 1, s_name, row_number() over (order by s_suppkey) - 1 from supplier)
select "at", w.f as frame, name from w join r on w.f = r.f and w.turn = r.turn
""")
def choose_from(t: Tables) -> DataFrame:
    frames = [t.customer.select(F.col("c_name").alias("name"), F.col("c_custkey").alias("k")), t.supplier.select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("k"))]
    choices = t.events.select("event_id", (F.col("event_id") % 2).cast("int").alias("c"))
    return sets.choose_from(frames, [["k"], ["k"]], choices, "c", ["event_id"]).select("at", "frame", "name")


@query(f"with l as (select doc_id, quality, {MD5.format('concat_ws($$:$$, 3, doc_id)')} as d from labels) select doc_id, quality from l where d < (case quality when 0 then 4294967296 else floor(4294967296 * 0.5)::bigint end)")
def rejection_resample(t: Tables) -> DataFrame:
    """From shares of 1/3 and 2/3, as they are said to be, to equal ones."""
    return sets.rejection_resample(t.labels.select("doc_id", "quality"), "quality", {0: 0.5, 1: 0.5}, {0: 1 / 3, 1: 2 / 3}, 3, ["doc_id"])


@query(f"""
with r as (select 0 as frame, o_orderkey as k, row_number() over (order by o_orderkey) - 1 as turn, 1.0 as w from orders union all select 1, c_custkey, row_number() over (order by c_custkey) - 1, 0.25 from customer),
 d as (select *, sum(floor(-ln(({MD5.format('concat_ws($$:$$, 5, frame, turn)')} + 0.5) / 4294967296) * (1048576 / w))::bigint) over (partition by frame order by turn) as due from r)
select frame, k, turn, row_number() over (order by due, frame, turn) - 1 as "at" from d
""")
def sample_from(t: Tables) -> DataFrame:
    frames = [t.orders.select(F.col("o_orderkey").alias("k")), t.customer.select(F.col("c_custkey").alias("k"))]
    return sets.sample_from(frames, [["k"], ["k"]], [1.0, 0.25], 5)


@query("select k, p_partkey, p_size from (select range as k, (range * 37) % 100 as a, range % 2 as b from range(300)) i join (select p_partkey, p_size, (row_number() over (order by p_partkey) - 1) // 2 as x, (row_number() over (order by p_partkey) - 1) % 2 as y from part) p on i.a = p.x and i.b = p.y")
def gather_nd(t: Tables) -> DataFrame:
    wanted = t.spark.range(300).select(F.col("id").alias("k"), (F.col("id") * 37 % 100).alias("a"), (F.col("id") % 2).alias("b"))
    placed = numbered(t.part.select("p_partkey", "p_size"), ["p_partkey"])
    params = placed.select("p_partkey", "p_size", F.floor(F.col("pos") / 2).alias("x"), (F.col("pos") % 2).alias("y"))
    return J.gather_nd(wanted, params, ["a", "b"], ["x", "y"]).select("k", "p_partkey", "p_size")


SCATTERED = "select n_nationkey, coalesce({0}, v) as v from (select n_nationkey, 100.0 + n_nationkey as v from nation) left join (select s_nationkey, {1} as c from (select s_nationkey, 1.0 + s_suppkey % 3 as x from supplier) group by 1) on s_nationkey = n_nationkey"


def scattered(t: Tables, how: str) -> DataFrame:
    base = t.nation.select("n_nationkey", (F.lit(100.0) + F.col("n_nationkey")).alias("v"))
    change = t.supplier.select("s_nationkey", (F.lit(1.0) + F.col("s_suppkey") % 3).alias("v"))
    return J.scatter(change, base, "s_nationkey", "v", "n_nationkey", how)


@query("select n_nationkey, round(v::double, 4) as v from (" + SCATTERED.format("v * c", "product(x)") + ")")
def scatter_mul(t: Tables) -> DataFrame:
    return scattered(t, "mul").select("n_nationkey", F.round("v", 4).alias("v"))


@query("select n_nationkey, round(v::double, 9) as v from (" + SCATTERED.format("v / c", "product(x)") + ")")
def scatter_div(t: Tables) -> DataFrame:
    return scattered(t, "div").select("n_nationkey", F.round("v", 9).alias("v"))


@query("select n_nationkey, v::double as v from (" + SCATTERED.format("v - c", "sum(x)") + ")")
def scatter_sub(t: Tables) -> DataFrame:
    return scattered(t, "sub")


@query("select n_nationkey, v::double as v from (" + SCATTERED.format("least(v, c)", "min(x)") + ")")
def scatter_min(t: Tables) -> DataFrame:
    return scattered(t, "min")


@query("select n_nationkey, v::double as v from (" + SCATTERED.format("greatest(v, c)", "max(x)") + ")")
def scatter_max(t: Tables) -> DataFrame:
    return scattered(t, "max")


@query("select r.range as position, coalesce(v, 0)::bigint as value from range(30) r left join (select s_nationkey as k, sum(s_suppkey) as v from supplier group by 1) on k = r.range")
def scatter_nd(t: Tables) -> DataFrame:
    return J.scatter_nd(t.supplier, "s_nationkey", "s_suppkey", 30)


@query("with t as (select r_regionkey as key, r_name as value from region where r_regionkey <> 2 and r_regionkey <> 3 union all select 3, 'new' union all select 9, 'far') select n_nationkey, coalesce(value, '-') as found from nation left join t on n_regionkey = key")
def mutable_table(t: Tables) -> DataFrame:
    rows = t.region.select(F.col("r_regionkey").cast("long").alias("key"), F.col("r_name").alias("value"))
    extra = t.spark.createDataFrame([(3, "old", 0), (3, "new", 1), (9, "far", 0)], "key long, value string, ord int")
    table = J.MutableTable(rows).insert(extra, "ord").remove(t.spark.createDataFrame([(2,)], "key long"))
    return table.find(t.nation.select("n_nationkey", F.col("n_regionkey").cast("long").alias("r")), "r", F.lit("-")).select("n_nationkey", "found")


@query("select 6::bigint as n")
def mutable_table_size(t: Tables) -> DataFrame:
    rows = t.region.select(F.col("r_regionkey").cast("long").alias("key"), F.col("r_name").alias("value"))
    return J.MutableTable(rows).insert(t.spark.createDataFrame([(9, "far"), (0, "x")], "key long, value string")).size()


@query("select a.p_partkey as a, b.p_partkey as b from part a join part b on a.p_retailprice < b.p_retailprice + 1 and b.p_retailprice < a.p_retailprice + 2 and a.p_size = 1 and b.p_size = 2")
def interval_join(t: Tables) -> DataFrame:
    side = lambda size, p, width: t.part.where(f"p_size = {size}").select(F.col("p_partkey").alias(p), F.col("p_retailprice").alias(f"{p}_from"), (F.col("p_retailprice") + width).alias(f"{p}_to"))
    return J.interval_join(side(1, "a", 2), side(2, "b", 1), ("a_from", "b_from"), ("a_to", "b_to"), 10.0).select("a", "b")


@query("select n_nationkey, r_regionkey from nation join region on n_regionkey < r_regionkey and n_nationkey % 2 = 0")
def theta_join(t: Tables) -> DataFrame:
    return J.theta_join(t.nation, t.region, (F.col("n_regionkey") < F.col("r_regionkey")) & (F.col("n_nationkey") % 2 == 0)).select("n_nationkey", "r_regionkey")


KINDS = "with a as (select distinct user_id, event_type from events where event_id % 2 = 0), b as (select distinct user_id, event_type from events where event_id % 3 = 0) "


@query(KINDS + "select * from a union select * from b")
def sparse_set_union(t: Tables) -> DataFrame:
    e = t.events.select("user_id", "event_type", "event_id")
    return sets.sparse_set_operation(e.where("event_id % 2 = 0"), e.where("event_id % 3 = 0"), ["user_id"], "event_type", "union")


@query(KINDS + "select * from a except select * from b")
def dense_to_sparse_set_difference(t: Tables) -> DataFrame:
    e = t.events.select("user_id", "event_type", "event_id")
    dense = e.where("event_id % 2 = 0").groupBy("user_id").agg(F.collect_list("event_type").alias("kinds"))
    return sets.dense_to_sparse_set_operation(dense, "kinds", e.where("event_id % 3 = 0"), ["user_id"], "event_type", "a-b")
