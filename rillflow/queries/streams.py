"""Queries of keyed stream state: a table's rows as a stream of files, run to its end, all results gathered. The state store is the one that these operators need, for as long as a query runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.queries.registry import Tables, query
from rillflow.session import cut, scratch
from rillflow.streaming import stateful

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SHUFFLES = "spark.sql.shuffle.partitions"


def streamed(t: Tables, rows: DataFrame, build: Callable[[DataFrame], DataFrame], batches: int = 1) -> DataFrame:
    """The rows that ``build`` makes of a stream of ``rows``, which come in about so many batches. State lies in four partitions."""
    spark = t.spark
    before = {k: spark.conf.get(k) for k in (PROVIDER, SHUFFLES)}
    with scratch(spark) as folder:
        rows.repartition(batches).write.parquet(f"{folder}/in")
        stream = spark.readStream.schema(rows.schema)
        stream = stateful.credited(stream, 1).parquet(f"{folder}/in") if batches > 1 else stream.parquet(f"{folder}/in")
        spark.conf.set(PROVIDER, ROCKS)
        spark.conf.set(SHUFFLES, "4")
        try:
            out = build(stream)
            writer = out.writeStream.foreachBatch(lambda part, n: part.write.mode("append").parquet(f"{folder}/out")).outputMode("update")
            if not writer.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination(600):
                raise RuntimeError("the stream didn't end in time")
        finally:
            for k, v in before.items():
                spark.conf.set(k, v)
        return cut(spark.read.schema(out.schema).parquet(f"{folder}/out"))


@query("select o_custkey % 20 as key, count(*) as new from orders group by 1")
def stream_counters(t: Tables) -> DataFrame:
    rows = t.orders.select((F.col("o_custkey") % 20).alias("key"), F.lit(1).cast("long").alias("delta"))
    return streamed(t, rows, stateful.counters, 3).groupBy("key").agg(F.max("new").alias("new"))


@query("select o_custkey % 20 as key, o_orderkey as ord, row_number() over (partition by o_custkey % 20 order by o_orderkey) - 1 as old from orders")
def stream_registers(t: Tables) -> DataFrame:
    rows = t.orders.select((F.col("o_custkey") % 20).alias("key"), F.col("o_orderkey").alias("ord"), F.lit("add").alias("action"), F.lit(1).cast("long").alias("value"))
    return streamed(t, rows, stateful.registers)


@query("with r as (select o_custkey % 20 as key, o_totalprice as v, (row_number() over (partition by o_custkey % 20 order by o_totalprice) - 1) // 10 as step from orders) select key, step, round(avg(v), 4) as mean, count(*) as n from r group by 1, 2 having count(*) = 10")
def stream_accumulator(t: Tables) -> DataFrame:
    rows = t.orders.select((F.col("o_custkey") % 20).alias("key"), F.lit(1 << 40).alias("step"), F.col("o_totalprice").alias("value"))
    return streamed(t, rows, lambda s: stateful.accumulator(s, 10)).select("key", "step", F.round("mean", 4).alias("mean"), "n")


@query("select n_nationkey::bigint as key, n_name as name, r_name as region, n::varchar as suppliers from nation join region on n_regionkey = r_regionkey join (select s_nationkey, count(*) as n from supplier group by 1) on s_nationkey = n_nationkey")
def stream_barrier(t: Tables) -> DataFrame:
    """A nation's name, its region and the number of its suppliers come one by one; nations without suppliers stay incomplete."""
    key = F.col("n_nationkey").cast("long").alias("key")
    named = t.nation.select(key, F.lit("name").alias("component"), F.col("n_name").alias("value"))
    region = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(key, F.lit("region").alias("component"), F.col("r_name").alias("value"))
    counted = t.supplier.groupBy(F.col("s_nationkey").cast("long").alias("key")).agg(F.lit("suppliers").alias("component"), F.count(F.lit(1)).cast("string").alias("value"))
    return streamed(t, named.unionByName(region).unionByName(counted), lambda s: stateful.barrier(s, ["name", "region", "suppliers"]), 3)


SUPPLIERS = "with q as (select s_nationkey::bigint as request_id, count(*) over (partition by s_nationkey) as request_count, row_number() over (partition by s_nationkey order by s_suppkey) - 1 as ord, s_name as value from supplier) "


def suppliers(t: Tables) -> DataFrame:
    """A nation's suppliers as a request's rows."""
    from rillflow.operators import gate

    rows = gate.ingress(t.supplier.select("s_nationkey", "s_suppkey", "s_name"), ["s_nationkey"], ["s_suppkey"])
    return rows.select(F.col("s_nationkey").cast("long").alias("request_id"), "request_count", "ord", F.col("s_name").alias("value"))


@query(SUPPLIERS + "select request_id, string_agg(value, ',' order by ord) as items, count(*) as n from q group by 1")
def stream_whole_requests(t: Tables) -> DataFrame:
    return streamed(t, suppliers(t), stateful.dequeue_whole, 3).select("request_id", F.array_join("items", ",").alias("items"), "n")


@query(SUPPLIERS + "select request_id, ord // 3 as batch, string_agg(value, ',' order by ord) as items from q group by 1, 2 having count(*) = 3")
def stream_batches(t: Tables) -> DataFrame:
    return streamed(t, suppliers(t), lambda s: stateful.dequeue_many(s, 3)).select("request_id", "batch", F.array_join("items", ",").alias("items"))


@query(SUPPLIERS + "select request_id, count(*) as n from q where request_id % 3 <> 0 or ord > 0 group by 1 having count(*) = max(request_count)")
def stream_egress(t: Tables) -> DataFrame:
    return streamed(t, suppliers(t).where("request_id % 3 <> 0 or ord > 0").select("request_id", "request_count"), stateful.egress, 3)
