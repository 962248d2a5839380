"""Queries of sources and sinks: tables written to a folder that all executors share, and read back. The rows are checkpointed and the folder removed before a query returns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.operators import feature_columns as FC
from rillflow.operators import genome as G
from rillflow.operators import join as J
from rillflow.operators.ordering import numbered
from rillflow.queries.domain import READS, alignments
from rillflow.queries.registry import Tables, query
from rillflow.session import cut, scratch
from rillflow.sources import datasources, files


def through(t: Tables, steps: Callable[[str], DataFrame]) -> DataFrame:
    """What ``steps`` reads from the folder that it has written to."""
    datasources.register(t.spark)
    with scratch(t.spark) as folder:
        return cut(steps(folder))


def base_name(path: str) -> object:
    return F.element_at(F.split(path, "/"), -1)


@query("select row_number() over (order by n_nationkey)::bigint as line, n_name as value from nation")
def text_line_source(t: Tables) -> DataFrame:
    def steps(folder: str) -> DataFrame:
        t.nation.orderBy("n_nationkey").select("n_name").coalesce(1).write.text(folder)
        return files.text_lines(t.spark, folder).select(F.element_at(F.split("key", ":"), -1).cast("long").alias("line"), "value")

    return through(t, steps)


@query("select 'a.bin' as name, 5::bigint as size, 'hello' as contents union all select 'b.bin', 3, 'abc'")
def whole_file_source(t: Tables) -> DataFrame:
    def steps(folder: str) -> DataFrame:
        files.write_file(t.spark, f"{folder}/a.bin", b"hello")
        files.write_file(t.spark, f"{folder}/b.bin", b"abc")
        return files.whole_files(t.spark, f"{folder}/*.bin").select(base_name("key").alias("name"), F.octet_length("value").cast("long").alias("size"), F.col("value").cast("string").alias("contents"))

    return through(t, steps)


@query("select 'a.txt' as name union all select 'c.txt'")
def matching_files_source(t: Tables) -> DataFrame:
    def steps(folder: str) -> DataFrame:
        for name in ("a.txt", "b.bin", "c.txt", "d.txt"):
            files.write_file(t.spark, f"{folder}/{name}", b"x")
        files.remove(t.spark, f"{folder}/d.txt")
        return files.matching_files(t.spark, f"{folder}/*.txt").select(base_name("path").alias("name"))

    return through(t, steps)


@query("select c_custkey, c_name, case when c_custkey % 3 = 0 then -1.5 else c_acctbal end as c_acctbal from customer")
def csv_source(t: Tables) -> DataFrame:
    """Every third balance is left empty and gets its default."""

    def steps(folder: str) -> DataFrame:
        t.customer.select("c_custkey", "c_name", F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal")).alias("c_acctbal")).write.csv(folder)
        return files.csv(t.spark, folder, "c_custkey bigint, c_name string, c_acctbal double", {"c_acctbal": F.lit(-1.5)})

    return through(t, steps)


@query("select concat(o_orderkey, '|', o_orderpriority) as record from orders")
def record_file_source(t: Tables) -> DataFrame:
    def steps(folder: str) -> DataFrame:
        rows = t.orders.select(F.concat(F.col("o_orderkey").cast("string"), F.lit("|"), "o_orderpriority").cast("binary").alias("record"), F.lit("").alias("file"), F.lit(0).cast("long").alias("offset"))
        rows.write.format("record_file").mode("overwrite").option("compression", "GZIP").option("path", folder).save()
        return t.spark.read.format("record_file").option("compression", "GZIP").option("path", folder).load().select(F.col("record").cast("string").alias("record"))

    return through(t, steps)


@query("select concat(o_orderkey, '|', o_orderpriority) as record from orders")
def record_files_by_spark(t: Tables) -> DataFrame:
    """The same files by Spark's own reader, as for a store that nothing else opens."""

    def steps(folder: str) -> DataFrame:
        rows = t.orders.select(F.concat(F.col("o_orderkey").cast("string"), F.lit("|"), "o_orderpriority").cast("binary").alias("record"), F.lit("").alias("file"), F.lit(0).cast("long").alias("offset"))
        rows.write.format("record_file").mode("overwrite").option("path", folder).save()
        found = datasources.records_of(t.spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder))
        return found.select(F.col("record").cast("string").alias("record"))

    return through(t, steps)


@query(READS + "select ordinal, case when ordinal % 10 = 3 then null else bases end as bases from a")
def read_chunks_source(t: Tables) -> DataFrame:
    """A column of reads in chunk files of 500, every tenth read a gap."""

    def steps(folder: str) -> DataFrame:
        rows = alignments(t).select(F.lit("x").alias("record_id"), "ordinal", F.when(F.col("ordinal") % 10 != 3, F.col("bases")).cast("binary").alias("payload"))
        ranges = rows.repartitionByRange(F.floor(F.col("ordinal") / 500)).sortWithinPartitions("ordinal")
        ranges.write.format("read_chunks").mode("overwrite").option("path", folder).option("column", "bases").option("record_id", "sample").option("record_type", "base_compact").option("compression", "gzip").option("chunk_size", 500).save()
        found = t.spark.read.format("read_chunks").option("path", folder).option("column", "bases").load()
        return found.select("ordinal", F.col("payload").cast("string").alias("bases"))

    return through(t, steps)


@query("select row_number() over (order by s_suppkey) - 1 as index, lpad(s_suppkey::varchar, 7, '0') as record from supplier")
def fixed_length_source(t: Tables) -> DataFrame:
    def steps(folder: str) -> DataFrame:
        t.supplier.orderBy("s_suppkey").select(F.lpad(F.col("s_suppkey").cast("string"), 7, "0")).coalesce(1).write.text(folder)
        found = datasources.fixed_length_records(t.spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder), 8)
        return found.select("index", F.substring(F.col("record").cast("string"), 1, 7).alias("record"))

    return through(t, steps)


@query("select r_regionkey as k, r_name as v from region union all select n_nationkey + 100, n_name from nation")
def save_restore_merge(t: Tables) -> DataFrame:
    def steps(folder: str) -> DataFrame:
        files.save({"rows": t.region.select(F.col("r_regionkey").cast("long").alias("k"), F.col("r_name").alias("v"))}, f"{folder}/a")
        files.save({"rows": t.nation.select((F.col("n_nationkey") + 100).cast("long").alias("k"), F.col("n_name").alias("v"))}, f"{folder}/b")
        files.merge_saved(t.spark, [f"{folder}/a", f"{folder}/b"], ["rows"], f"{folder}/all")
        return files.restore(t.spark, f"{folder}/all", "rows")["rows"].withColumn("k", F.col("k").cast("int"))

    return through(t, steps)


@query("select n_nationkey, n_name from nation union all select n_nationkey, n_name from nation where n_nationkey < 5")
def event_log_sink(t: Tables) -> DataFrame:
    def steps(folder: str) -> DataFrame:
        files.log_events(t.nation.select("n_nationkey", "n_name"), folder)
        files.log_events(t.nation.where("n_nationkey < 5").select("n_nationkey", "n_name"), folder)
        return t.spark.read.option("header", "true").schema("n_nationkey int, n_name string").csv(folder)

    return through(t, steps)


@query("select 7::bigint as step, 'n' as tag, count(*)::double as value from orders union all select 7, 'top', max(o_orderkey)::double from orders")
def summary_sink(t: Tables) -> DataFrame:
    def steps(folder: str) -> DataFrame:
        files.discard(t.orders)
        files.summary_scalars(t.orders, F.lit(7), folder, n=F.count(F.lit(1)), top=F.max("o_orderkey"))
        return t.spark.read.parquet(folder)

    return through(t, steps)


@query("select r_regionkey::varchar as key, r_name as value from region")
def sequence_file_source(t: Tables) -> DataFrame:
    def steps(folder: str) -> DataFrame:
        files.write_sequence_file(t.region, "r_regionkey", "r_name", folder)
        return files.sequence_file(t.spark, folder)

    return through(t, steps)


@query("select c_custkey, case when c_custkey % 4 = 0 then 'changed' else c_name end as c_name from customer union all select 999999999, 'new'")
def upsert_rows(t: Tables) -> DataFrame:
    rows = t.customer.where("c_custkey % 4 = 0").select("c_custkey", F.lit("changed").alias("c_name"))
    new = t.spark.createDataFrame([(999999999, "new")], "c_custkey long, c_name string")
    return files.upsert(t.customer.select("c_custkey", "c_name"), rows.unionByName(new), "c_custkey")


@query("select c_custkey, coalesce(i, -1)::bigint as value from customer left join (select n_nationkey as k, row_number() over (order by n_nationkey desc) - 1 as i from nation where n_nationkey > 2) on k = c_nationkey")
def lookup_from_file(t: Tables) -> DataFrame:
    """A table whose keys are a file's fields and whose values are its line numbers."""

    def steps(folder: str) -> DataFrame:
        t.nation.where("n_nationkey > 2").orderBy(F.desc("n_nationkey")).select(F.concat_ws("\t", F.col("n_nationkey").cast("string"), "n_name")).coalesce(1).write.text(folder)
        table = J.table_from_text(t.spark, folder, "k int, name string", key="k")
        return J.lookup(t.customer.select("c_custkey", "c_nationkey"), table, "c_nationkey", "key", "value", F.lit(-1).cast("long")).select("c_custkey", "value")

    return through(t, steps)


@query("select c_custkey, coalesce(i, 3 + cast(('0x' || substring(md5(c_mktsegment), 1, 8)) as bigint) % 4) as id from customer left join (values ('BUILDING', 0), ('MACHINERY', 1), ('FURNITURE', 2)) v(s, i) on s = c_mktsegment")
def vocabulary_from_file(t: Tables) -> DataFrame:
    def steps(folder: str) -> DataFrame:
        files.write_file(t.spark, f"{folder}/terms", b"BUILDING\nMACHINERY\nFURNITURE\n")
        return FC.vocabulary_file(t.customer.select("c_custkey", "c_mktsegment"), "c_mktsegment", f"{folder}/terms", oov_buckets=4).select("c_custkey", "id")

    return through(t, steps)


@query("select \"end\" - start as n from (select 0 as start, 200 as \"end\")")
def sample_key_ranges(t: Tables) -> DataFrame:
    """Ranges of sampled keys cover the table: the rows that they hold together are all there are."""
    table = t.spark.range(200).select(F.format_string("k%04d", "id").alias("key"))
    ranges = files.sample_keys(table, "key", 8)
    met = table.join(ranges, (F.col("key") >= F.col("start")) & (F.col("end").isNull() | (F.col("key") < F.col("end"))))
    return met.agg(F.count_distinct("key").cast("int").alias("n"))


@query(READS + "select ordinal // 500 as chunk, min(ordinal) as first_ordinal, count(*) as n, max(ordinal) + 1 as last_ordinal from a group by 1")
def chunk_index(t: Tables) -> DataFrame:
    return G.chunks(numbered(alignments(t).select("ordinal"), ["ordinal"], "at"), "at", 500)
