"""Queries of text vocabularies, similarity, feature columns, sequencing reads, gates and time windows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.functions import examples
from rillflow.functions import text as X
from rillflow.operators import feature_columns as FC
from rillflow.operators import gate, similarity
from rillflow.operators import genome as G
from rillflow.operators import sort
from rillflow.operators.ordering import numbered
from rillflow.queries.registry import Tables, query
from rillflow.session import cut
from rillflow.streaming import stateful

VOCAB = """with k as (select conv_id, turn, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') as w from conversations),
 c as (select term, count(*) as n from (select unnest(w) as term from k) group by 1 having count(*) >= 3),
 v as (select term, n, row_number() over (order by n desc, term) as id from c) """


def vocabulary(t: Tables) -> DataFrame:
    return X.vocabulary(t.conversations, X.tokens(F.col("text")), 3)


@query(VOCAB + "select term, n, id from v")
def vocab_fit(t: Tables) -> DataFrame:
    return vocabulary(t)


@query(VOCAB + ", f as (select conv_id * 1000 + turn as k, w, unnest(range(len(w))) as pos from k) select k, pos::int as pos, w[pos + 1] as term, coalesce(id, 0) as id from f left join v on w[pos + 1] = term")
def vocab_transform(t: Tables) -> DataFrame:
    rows = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("k"), X.tokens(F.col("text")).alias("w"))
    return X.to_ids(rows, "k", F.col("w"), vocabulary(t))


@query("""
with k as (select conv_id, turn, string_split(text, ' ') as w from conversations), f as (select conv_id, turn, unnest(range(len(w))) as i, w from k)
select a.conv_id, a.turn, a.i::int as i, a.w[a.i + 1] as token, b.i::int as j, b.w[b.i + 1] as label from f a join f b on a.conv_id = b.conv_id and a.turn = b.turn and abs(a.i - b.i) between 1 and 2
""")
def skipgram_fixed(t: Tables) -> DataFrame:
    return X.skip_grams(t.conversations, ["conv_id", "turn"], F.split("text", " "), 2)


@query(VOCAB + """, bc as (select term, count(*) as n from (select unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) as term from benchmark) group by 1),
 bv as (select term, row_number() over (order by n desc, term) as id from bc) select bv.id as new_id, bv.term, coalesce(v.id, -1) as old_id from bv left join v using (term)""")
def vocab_remap(t: Tables) -> DataFrame:
    return X.remap(X.vocabulary(t.benchmark, X.tokens(F.col("text"))), vocabulary(t))


PLANES = [[((3 * k + 5 * j) % 7) - 3 for j in range(64)] for k in range(8)]


@query("select vec_id, sum(case when d >= 0 then 1 << k else 0 end)::bigint as bits from (select vec_id, k, sum(embedding[j + 1]::double * (((3 * k + 5 * j) % 7) - 3)) as d from embeddings, unnest(range(8)) as a(k), unnest(range(64)) as b(j) group by 1, 2) group by 1")
def lsh_sign_bits(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", similarity.sign_bits(F.col("embedding"), PLANES).alias("bits"))


@query("""
with d as (select vec_id, k, sum(embedding[j + 1]::double * (((3 * k + 5 * j) % 7) - 3)) as d from embeddings, unnest(range(8)) as a(k), unnest(range(64)) as b(j) group by 1, 2),
 h as (select vec_id, sum(case when d >= 0 then 1 << k else 0 end)::bigint as base from d group by 1),
 r as (select *, row_number() over (partition by vec_id order by abs(d), 1 << k) as r from d)
select vec_id, 0 as pos, base as probe from h union all select vec_id, r::int, xor(base, (1 << k)::bigint) from r join h using (vec_id) where r <= 2
""")
def lsh_probes(t: Tables) -> DataFrame:
    found = t.embeddings.select("vec_id", similarity.probes(F.col("embedding"), PLANES, 2).alias("p"))
    return found.select("vec_id", F.posexplode("p").alias("pos", "probe"))


@query("""
with p as (select vec_id as point, embedding as e from embeddings where vec_id % 100 = 0), o as (select vec_id as other, embedding as f from embeddings),
 s as (select point, other, list_sum(list_transform(list_zip(e, f), lambda z: (z[1]::double - z[2]::double) * (z[1]::double - z[2]::double))) as d from p join o on point <> other)
select point, other, r::int as rank, round(d, 5) as distance from (select *, row_number() over (partition by point order by d, other) as r from s) where r <= 5
""")
def nearest_neighbors(t: Tables) -> DataFrame:
    found = similarity.nearest_rows(t.embeddings.where("vec_id % 100 = 0"), t.embeddings, "vec_id", "vec_id", "embedding", 5, parts=8)
    return found.select("point", "other", "rank", F.round("distance", 5).alias("distance"))


@query("""
with c as (select k, list_transform(range(64), lambda j: ((k * 3 + j) % 5 - 2) / 10.0) as f from range(4) r(k)),
 s as (select vec_id, k, list_sum(list_transform(list_zip(embedding, f), lambda z: (z[1]::double - z[2]::double) * (z[1]::double - z[2]::double))) as d from embeddings, c)
select vec_id, (r - 1)::int as rank, k::int as center, round(d, 5) as distance from (select *, row_number() over (partition by vec_id order by d, k) as r from s) where r <= 2
""")
def nearest_centers(t: Tables) -> DataFrame:
    centers = [(k, [((k * 3 + j) % 5 - 2) / 10.0 for j in range(64)]) for k in range(4)]
    return similarity.nearest_centers(t.embeddings, centers, "embedding", 2).select("vec_id", "rank", "center", F.round("distance", 5).alias("distance"))


@query()
def kmeans(t: Tables) -> DataFrame:
    return similarity.kmeans(t.embeddings.select("vec_id", "embedding"), "embedding", 5).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


@query()
def als(t: Tables) -> DataFrame:
    rated = t.lineitem.groupBy((F.col("l_suppkey") % 50).cast("int").alias("u"), (F.col("l_partkey") % 80).cast("int").alias("i")).agg(F.avg("l_quantity").alias("r"))
    return similarity.als(rated, "u", "i", "r").select("id", F.size("factors").alias("n"))


@query("select c_custkey, coalesce(nullif(c_acctbal, 0), -1.0) / 1000 as x, (case when c_acctbal < 0 then 0 when c_acctbal < 5000 then 1 else 2 end) as b, case when c_nationkey between 0 and 9 then c_nationkey else 99 end as i, case c_mktsegment when 'BUILDING' then 0 when 'MACHINERY' then 1 else -1 end::bigint as v from customer")
def feature_columns(t: Tables) -> DataFrame:
    rows = t.customer.withColumn("bal", F.nullif("c_acctbal", F.lit(0.0)))
    return rows.select(
        "c_custkey",
        FC.numeric("bal", -1.0, lambda x: x / 1000).alias("x"),
        FC.bucketized(F.col("c_acctbal"), [0.0, 5000.0]).alias("b"),
        FC.identity("c_nationkey", 10, 99).alias("i"),
        FC.vocabulary_list("c_mktsegment", ["BUILDING", "MACHINERY"]).alias("v"),
    )


@query("select user_id, j::int as kind, count(*) filter (event_id % 4 = j)::int as n from events, unnest(range(4)) as u(j) group by 1, 2")
def indicator_column(t: Tables) -> DataFrame:
    ids = t.events.groupBy("user_id").agg(F.collect_list((F.col("event_id") % 4).cast("int")).alias("ids"))
    return ids.select("user_id", F.posexplode(FC.indicator(F.col("ids"), 4)).alias("kind", "n"))


@query("select o_custkey as k, d.range as dim, round(sum((o_orderkey % 10) * (d.range + 1)) / sqrt(count(*)), 5) as value from orders, range(3) d group by 1, 2")
def embedding_column(t: Tables) -> DataFrame:
    rows = t.orders.groupBy(F.col("o_custkey").alias("k")).agg(F.collect_list(F.col("o_orderkey") % 10).alias("ids"))
    table = t.spark.range(30).select((F.col("id") % 10).alias("id"), F.floor(F.col("id") / 10).alias("dim")).withColumn("value", F.col("id") * (F.col("dim") + 1))
    return FC.embedded(rows, "k", "ids", table, "sqrtn").withColumn("value", F.round("value", 5))


@query("select p_partkey, round(0.5 + p_size * 0.25 + p_retailprice * 0.001, 6) as logit from part")
def linear_model(t: Tables) -> DataFrame:
    return FC.linear_model(t.part, "p_partkey", {"p_size": 0.25, "p_retailprice": 0.001}, 0.5).withColumn("logit", F.round("logit", 6))


# Reads drawn from lineitem, which has none of its own.
READS = """with a as (select row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 as ordinal, (l_suppkey % 25)::int as ref_index, l_partkey as position,
 (l_linenumber % 2 + case l_returnflag when 'R' then 4 when 'A' then 16 else 0 end + case l_linestatus when 'F' then 1024 else 0 end)::int as flag,
 l_quantity::int as mapq, concat(l_orderkey, ':', l_linenumber) as meta, translate(md5(concat(l_orderkey, ':', l_linenumber)), '0123456789abcdef', 'ACGTNACGTNACGTNA') as bases from lineitem) """


def reads_of(t: Tables) -> DataFrame:
    """The reads as they come, without their ordinals."""
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    extra = F.when(F.col("l_returnflag") == "R", 4).when(F.col("l_returnflag") == "A", 16).otherwise(0) + F.when(F.col("l_linestatus") == "F", 1024).otherwise(0)
    meta = F.concat(k.cast("string"), F.lit(":"), n.cast("string"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", (F.col("l_suppkey") % 25).cast("int").alias("ref_index"), F.col("l_partkey").alias("position"), (n % 2 + extra).cast("int").alias("flag"), F.col("l_quantity").cast("int").alias("mapq"), meta.alias("meta"), F.translate(F.md5(meta), "0123456789abcdef", "ACGTNACGTNACGTNA").alias("bases"))


def alignments(t: Tables) -> DataFrame:
    return numbered(reads_of(t), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "ordinal")


@query(READS + "select ordinal, bases, length(bases) // 21 + 1 as words from a")
def base_codec_roundtrip(t: Tables) -> DataFrame:
    packed = alignments(t).withColumn("w", G.encode_bases("bases"))
    return packed.select("ordinal", G.decode_bases("w").alias("bases"), F.size("w").cast("long").alias("words"))


@query(READS + "select ordinal, translate(bases, 'ACGTN', '01234') as digits from a")
def two_bit(t: Tables) -> DataFrame:
    return alignments(t).select("ordinal", G.two_bit(F.lower("bases")).alias("digits"))


@query(READS + "select ordinal as record, ordinal // 100 as chunk, meta, bases, replace(bases, 'N', '!') as quals from a where ordinal < (select count(*) - 1 from a)")
def fastq_chunks(t: Tables) -> DataFrame:
    """Four lines a read, the last read's last line lost."""
    reads = alignments(t)
    lines = F.array(F.concat(F.lit("@"), "meta"), "bases", F.lit("+"), F.translate("bases", "N", "!"))
    flat = reads.select("ordinal", F.posexplode(lines).alias("k", "line")).select((F.col("ordinal") * 4 + F.col("k")).alias("at"), "line")
    end = t.lineitem.agg((F.count(F.lit(1)) * 4 - 1).alias("end"))
    return G.fastq_records(flat.join(F.broadcast(end), F.col("at") < F.col("end")), "at", 100)


@query(READS + "select count(*) as total, " + ", ".join(f"count(*) filter (flag & {bit} <> 0) as {name}" for name, bit in G.FLAGS.items()) + ", count(*) filter (flag & 4 = 0) as mapped, count(*) filter (flag & 256 = 0 and flag & 2048 = 0) as \"primary\" from a")
def flagstat(t: Tables) -> DataFrame:
    return G.flagstat(reads_of(t))


@query(READS + "select meta, flag & 1 <> 0 as paired, flag & 16 <> 0 as reverse, flag & 1024 <> 0 as duplicate, flag & 256 = 0 and flag & 2048 = 0 as \"primary\" from a")
def sam_flag_predicates(t: Tables) -> DataFrame:
    return reads_of(t).select("meta", *[G.flag(F.col("flag"), n).alias(n) for n in ("paired", "reverse", "duplicate")], G.is_primary(F.col("flag")).alias("primary"))


@query(READS + "select ordinal from (select *, lag(ref_index) over w as r, lag(position) over w as p from a window w as (order by ordinal)) where ordinal // 1000 = (ordinal - 1) // 1000 and (ref_index < r or ref_index = r and position < p)")
def coordinate_sort_verify(t: Tables) -> DataFrame:
    chunked = alignments(t).withColumn("chunk", F.floor(F.col("ordinal") / 1000))
    return sort.order_violations(chunked, ["ref_index", "position"], ["ordinal"], ["chunk"]).select("ordinal")


@query(READS + "select ordinal, row_number() over (order by ref_index, position, ordinal) - 1 as \"at\" from a")
def coordinate_sort(t: Tables) -> DataFrame:
    """The rows as they lie after the sort, partition by partition."""
    ordered = sort.coordinate_sorted(alignments(t).select("ordinal", "ref_index", "position"), "ref_index", "position", "ordinal")
    return numbered(cut(ordered.select("ordinal", F.monotonically_increasing_id().alias("id"))), ["id"], "at").select("ordinal", "at")


@query(READS + "select ordinal, row_number() over (order by ref_index, position, ordinal) - 1 as \"at\" from a")
def coordinate_merge(t: Tables) -> DataFrame:
    """Three sorted chunks as one."""
    rows = alignments(t).select("ordinal", "ref_index", "position")
    chunks = [rows.where(F.col("ordinal") % 3 == k) for k in range(3)]
    merged = sort.merge_sorted(chunks, ["ref_index", "position", "ordinal"])
    return numbered(cut(merged.select("ordinal", F.monotonically_increasing_id().alias("id"))), ["id"], "at").select("ordinal", "at")


@query(READS + "select ordinal from (select *, lag(ref_index) over w as r, lag(position) over w as p from a window w as (order by ordinal)) where ref_index < r or ref_index = r and position < p")
def coordinate_verify_whole(t: Tables) -> DataFrame:
    """The edges of chunks included."""
    return sort.order_violations(alignments(t), ["ref_index", "position"], ["ordinal"], []).select("ordinal")


@query(READS + "select ordinal, ref_index, position from a where ordinal % 5 <> 0")
def results_index(t: Tables) -> DataFrame:
    """Alignments as a column with gaps, written and read, and their index."""
    position = F.when(F.col("ordinal") % 5 != 0, F.col("position"))
    rows = alignments(t).select("ordinal", G.alignment_result({"ref_index": F.col("ref_index"), "position": position, "flag": F.col("flag"), "mapping_quality": F.col("mapq")}).alias("result"))
    stored = rows.select("ordinal", G.result_payload(F.col("result")).alias("payload"))
    return G.results_index(stored.select("ordinal", G.parsed_payload(F.col("payload")).alias("result")))


@query(READS + "select ref_index, position, mapq as mapping_quality from a where ordinal = 777")
def result_at_position(t: Tables) -> DataFrame:
    rows = alignments(t).select("ordinal", G.alignment_result({"ref_index": F.col("ref_index"), "position": F.col("position"), "mapping_quality": F.col("mapq")}).alias("result"))
    return G.result_at(rows, F.lit(777)).select("result.ref_index", "result.position", "result.mapping_quality")


@query(READS + "select ordinal, meta, 8 * (length(bases) // 21 + 1) as size, lower(hex(encode(substr(meta, 1, 1)))) as first_meta from a")
def agd_convert(t: Tables) -> DataFrame:
    found = G.convert_reads(alignments(t).withColumn("quals", F.translate("bases", "N", "!")))
    return found.select("ordinal", F.col("meta").cast("string").alias("meta"), F.octet_length("bases").cast("long").alias("size"), F.lower(F.hex(F.substring("meta", 1, 1))).alias("first_meta"))


@query(READS + "select ordinal, 8 * (length(bases) // 21 + 1) as length from a")
def base_buffer_convert(t: Tables) -> DataFrame:
    found = G.convert_bases(alignments(t).select("ordinal", F.col("bases").cast("binary").alias("payload")))
    return found.select("ordinal", F.col("length").cast("long").alias("length"))


# References and reads whose places are known: references from digests of part names, reads cut from them with one base changed.
GENOME = """with h as (select (row_number() over (order by p_partkey) - 1) as n, md5(concat(p_partkey, ':', p_name)) || md5(concat(p_name, ':', p_partkey)) as d from part),
 g as (select n // 40 as ref_index, string_agg(translate(d, '0123456789abcdef', 'ACGTTGCACGATTCAG'), '' order by n) as bases from h group by 1), f as (select ref_index::int as ref_index, bases from g where length(bases) >= 2560),
 r as (select ref_index * 20 + i as ordinal, ref_index, 97 * i + 13 as position, i % 3 = 1 as turned, substring(bases, (97 * i + 14)::int, 60) as cut from f, range(20) x(i)) """


def genome(t: Tables) -> tuple[DataFrame, DataFrame]:
    """(references, reads): see GENOME. The references are checkpointed, as each alignment goes through them several times."""
    digest = F.concat(F.md5(F.concat(F.col("p_partkey").cast("string"), F.lit(":"), "p_name")), F.md5(F.concat("p_name", F.lit(":"), F.col("p_partkey").cast("string"))))
    parts = numbered(t.part.select("p_partkey", F.translate(digest, "0123456789abcdef", "ACGTTGCACGATTCAG").alias("d")), ["p_partkey"], "n")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "d"))), lambda x: x["d"]), "")
    refs = cut(parts.groupBy(F.floor(F.col("n") / 40).cast("int").alias("ref_index")).agg(joined.alias("bases")).where(F.length("bases") >= 2560))
    cuts = refs.select("ref_index", "bases", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("i")).withColumn("cut", F.substr("bases", F.col("i") * 97 + 14, F.lit(60)))
    changed = F.concat(F.substr("cut", F.lit(1), F.lit(29)), F.translate(F.substr("cut", F.lit(30), F.lit(1)), "ACGT", "CGTA"), F.substr("cut", F.lit(31), F.lit(30)))
    turned = F.when(F.col("i") % 3 == 1, G.reverse_complement(changed)).otherwise(changed)
    return refs, cuts.select((F.col("ref_index").cast("long") * 20 + F.col("i")).alias("ordinal"), turned.alias("bases"))


@query(GENOME + "select ordinal, ref_index, position::bigint as position, case when turned then 16 else 0 end as flag from r")
def align_single(t: Tables) -> DataFrame:
    refs, reads = genome(t)
    found = G.align_single(reads, G.genome_index(refs, 16), refs, 16, 8, 3)
    return found.select("ordinal", "ref_index", "position", "flag")


@query(GENOME + ", p as (select ref_index, i, 97 * i + 13 as a, 97 * i + 13 + 120 + i % 9 as b from f, range(20) x(i)) select (ref_index * 20 + i) * 2 + s as ordinal, ref_index, (case s when 0 then a else b end)::bigint as position, case s when 0 then 1 + 2 + 32 + 64 else 1 + 2 + 16 + 128 end as flag from p, range(2) y(s)")
def align_paired(t: Tables) -> DataFrame:
    refs, _ = genome(t)
    pairs = refs.select("ref_index", "bases", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("i")).withColumn("a", F.col("i") * 97 + 14)
    ends = F.array(F.substr("bases", F.col("a"), F.lit(50)), G.reverse_complement(F.substr("bases", F.col("a") + 120 + F.col("i") % 9, F.lit(50))))
    reads = pairs.select(((F.col("ref_index").cast("long") * 20 + F.col("i")) * 2).alias("first"), F.posexplode(ends).alias("s", "bases")).select((F.col("first") + F.col("s")).alias("ordinal"), "bases")
    return G.align_paired(reads, G.genome_index(refs, 16), refs, 16, 8, 2)


@query(GENOME + "select substring(bases, (p + 1)::int, 16) as kmer, count(*) as n from f, unnest(range(length(bases) - 15)) as x(p) group by 1")
def genome_index(t: Tables) -> DataFrame:
    return G.genome_index(genome(t)[0], 16).groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))


@query(GENOME + "select ordinal, length(cut) as n, 60 - length(replace(cut, 'A', '')) as a from r")
def align_external(t: Tables) -> DataFrame:
    """An outside program, here one that counts letters, over batches of reads."""
    _, reads = genome(t)
    back = reads.withColumn("bases", F.when(F.col("ordinal") % 20 % 3 == 1, G.reverse_complement(F.col("bases"))).otherwise(F.col("bases")))
    cut_ = F.concat(F.substr("bases", F.lit(1), F.lit(29)), F.translate(F.substr("bases", F.lit(30), F.lit(1)), "CGTA", "ACGT"), F.substr("bases", F.lit(31), F.lit(30)))
    return G.align_with(back.withColumn("bases", cut_), counter, "ordinal long, n long, a long", 64)


def counter():
    return lambda pdf: pd.DataFrame({"ordinal": pdf["ordinal"], "n": pdf["bases"].str.len(), "a": pdf["bases"].str.count("A")})


@query("select n_nationkey as ref_index, n_name as name, length(n_name)::int as length from nation")
def reference_lengths(t: Tables) -> DataFrame:
    return G.reference_lengths(t.nation.select(F.col("n_nationkey").alias("ref_index"), F.col("n_name").alias("name"), F.col("n_name").alias("bases")))


@query(READS + "select ordinal, bases, mapq, meta from a where ordinal % 3 <> 0 and ordinal % 2 = 0")
def assembler_join(t: Tables) -> DataFrame:
    a = alignments(t).withColumn("record_id", F.lit("x"))
    part = lambda column, keep: a.where(keep).select("record_id", "ordinal", column)
    return G.assemble(part("bases", "ordinal % 3 <> 0"), part("mapq", "ordinal % 2 = 0"), part("meta", "true")).drop("record_id")


@query(READS + "select ordinal, row_number() over (partition by ref_index, position, flag & 16 order by mapq desc, ordinal) > 1 as duplicate from a")
def mark_duplicates(t: Tables) -> DataFrame:
    a = alignments(t).withColumn("strand", F.col("flag").bitwiseAND(16))
    return G.mark_duplicates(a, ["ref_index", "position", "strand"], "mapq", "ordinal").select("ordinal", "duplicate")


@query(READS + "select ordinal // 700 as chunk, min(ordinal) as first_ordinal, count(*) as n, max(ordinal) + 1 as last_ordinal from a group by 1")
def read_chunks(t: Tables) -> DataFrame:
    return G.chunks(alignments(t), "ordinal", 700)


@query("select string_agg(n_name, '|' order by n_nationkey) as names from nation")
def reference_names(t: Tables) -> DataFrame:
    return G.references(t.nation, "n_name", "n_nationkey")


REQUESTS = """with q as (select l_orderkey, l_linenumber, dense_rank() over (order by l_orderkey) + 99 as request_id, count(*) over (partition by l_orderkey) as request_count,
 row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) - 1 as ord from lineitem) """


def requests(t: Tables) -> DataFrame:
    return gate.ingress(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], 100)


@query(REQUESTS + "select l_orderkey, l_linenumber, request_id, request_count, ord from q")
def ingress_ids(t: Tables) -> DataFrame:
    return requests(t).select("l_orderkey", "l_linenumber", "request_id", "request_count", "ord")


@query(REQUESTS + "select request_id, count(*) as n from q where request_id % 5 <> 0 or ord > 0 group by request_id having count(*) = max(request_count)")
def egress_complete(t: Tables) -> DataFrame:
    return gate.egress(requests(t).where("request_id % 5 <> 0 or ord > 0"))


@query(REQUESTS + "select request_id, ord // 2 as batch, count(*) as n from q group by 1, 2")
def dequeue_many(t: Tables) -> DataFrame:
    return gate.dequeue_many(requests(t), 2).groupBy("request_id", "batch").agg(F.count(F.lit(1)).alias("n"))


@query(REQUESTS + "select request_id, ord, ord // 3 as partition_id, count(*) over (partition by request_id, ord // 3) as partition_count from q")
def dequeue_partition(t: Tables) -> DataFrame:
    return gate.dequeue_partition(requests(t), 3).select("request_id", "ord", "partition_id", "partition_count")


@query(REQUESTS + "select count(*) as n from (select request_id from q where request_id % 5 <> 0 or ord > 0 group by request_id having count(*) < max(request_count))")
def open_requests(t: Tables) -> DataFrame:
    return gate.open_requests(requests(t).where("request_id % 5 <> 0 or ord > 0"))


@query("select time_bucket(interval '1 hour', ts) as window_start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def tumbling_window(t: Tables) -> DataFrame:
    return stateful.tumbling(t.events, "ts", "1 hour", ["event_type"], F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("select time_bucket(interval '15 minutes', ts) - to_minutes(15 * k::int) as window_start, count(*) as n from events, unnest(range(4)) as u(k) group by 1")
def sliding_time_window(t: Tables) -> DataFrame:
    return stateful.sliding(t.events, "ts", "1 hour", "15 minutes", [], F.count(F.lit(1)).alias("n"))


@query("""
with g as (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval '30 minutes' then 0 else 1 end as fresh from events),
 s as (select *, sum(fresh) over (partition by user_id order by ts, event_id) as sid from g)
select user_id, min(ts) as session_start, max(ts) + interval '30 minutes' as session_end, count(*) as n from s group by user_id, sid
""")
def session_windows(t: Tables) -> DataFrame:
    return stateful.sessions(t.events, "ts", "30 minutes", ["user_id"], F.count(F.lit(1)).alias("n"))


@query(REQUESTS + "select request_id, ((dense_rank() over (order by request_id) - 1) // 10)::bigint as round from q group by request_id")
def gate_rounds(t: Tables) -> DataFrame:
    return gate.rounds(requests(t), 10).select("request_id", "round").distinct()


@query(REQUESTS + "select ceil(count(distinct request_id) / 10)::bigint as n from q")
def num_rounds(t: Tables) -> DataFrame:
    return gate.num_rounds(requests(t), 10)


@query(REQUESTS + ", k as (select request_id, count(*) = max(request_count) as done from q where request_id % 5 <> 0 or ord > 0 group by 1) select (n // 10)::bigint as round, count(*) as supplied, count(*) filter (done) as released from (select *, row_number() over (order by request_id) - 1 as n from k) group by 1")
def released_credits(t: Tables) -> DataFrame:
    return gate.released_credits(requests(t).where("request_id % 5 <> 0 or ord > 0"), 10)


@query(REQUESTS + ", k as (select * from q where ord < 3) select request_id, ord from k where request_id in (select request_id from k group by request_id having count(*) = max(request_count))")
def gate_close(t: Tables) -> DataFrame:
    """The gate closes before any request's fourth row; what is not complete by then is cancelled."""
    return gate.closed(requests(t), F.col("ord") >= 3, cancel_pending=True).select("request_id", "ord")


@query(REQUESTS + "select request_id, string_agg(l_linenumber::varchar, ',' order by ord) as items, count(*) as n from q group by 1")
def dequeue_whole(t: Tables) -> DataFrame:
    found = gate.dequeue_whole(requests(t), F.col("l_linenumber").cast("string"))
    return found.select("request_id", F.array_join("items", ",").alias("items"), "n")


@query(REQUESTS + "select request_id, ord // 2 as batch, sum(l_linenumber * 2)::bigint as total, ((dense_rank() over (order by request_id) - 1) // 50)::bigint as round from q where request_count > 1 group by request_id, ord // 2")
def gate_pipeline(t: Tables) -> DataFrame:
    """Row by row, then by batches of a request, then whole requests."""
    rows = requests(t).where("request_count > 1").withColumn("v", F.col("l_linenumber"))
    stages = [("each", None, lambda d: d.withColumn("v", F.col("v") * 2)), ("batch", 2, lambda d: d), ("whole", None, lambda d: d)]
    done = gate.pipeline(rows, stages, 50)
    return done.groupBy("request_id", "batch", "round").agg(F.sum("v").alias("total")).select("request_id", "batch", "total", "round")


@query("""
with k as (select conv_id, turn, string_split(text, ' ') as w from conversations), f as (select conv_id, turn, unnest(range(len(w))) as i, w from k),
 d as (select *, 1 + ((""" + "cast(('0x' || substring(md5(concat_ws(':', 6, conv_id, turn, i)), 1, 8)) as bigint)" + """ * 3) >> 32) as reach from f)
select a.conv_id, a.turn, a.i::int as i, a.w[a.i + 1] as token, b.i::int as j, b.w[b.i + 1] as label from d a join f b on a.conv_id = b.conv_id and a.turn = b.turn and abs(a.i - b.i) between 1 and a.reach
""")
def skipgram_drawn(t: Tables) -> DataFrame:
    return X.skip_grams_drawn(t.conversations, ["conv_id", "turn"], F.split("text", " "), 1, 3, 6)


@query(VOCAB + """, f as (select conv_id, turn, unnest(range(len(w))) as p, w from k), g as (select conv_id, turn, id, row_number() over (partition by conv_id, turn order by p) - 1 as i from f join v on w[p + 1] = term),
 d as (select *, 1 + ((cast(('0x' || substring(md5(concat_ws(':', 4, conv_id, turn, i)), 1, 8)) as bigint) * 2) >> 32) as reach from g)
select a.conv_id, a.turn, a.i::int as i, a.id as example, b.i::int as j, b.id as label from d a join g b on a.conv_id = b.conv_id and a.turn = b.turn and abs(a.i - b.i) between 1 and a.reach
""")
def word_pairs(t: Tables) -> DataFrame:
    return X.training_pairs(t.conversations, ["conv_id", "turn"], X.tokens(F.col("text")), 2, 3, 4)


@query("with m as (select range as row, range * 10 as v from range(30)), r as (select range as new_id, case when range % 4 = 0 then -1 else (range * 7) % 30 end as old_id from range(40)) select new_id as row, v from r join m on old_id = row")
def remap_matrix(t: Tables) -> DataFrame:
    matrix = t.spark.range(30).select(F.col("id").alias("row"), (F.col("id") * 10).alias("v"))
    remapping = t.spark.range(40).select(F.col("id").alias("new_id"), F.when(F.col("id") % 4 == 0, -1).otherwise(F.col("id") * 7 % 30).alias("old_id"))
    return X.remapped_rows(matrix, remapping)


@query("select c_custkey, cast(('0x' || substring(md5(c_mktsegment), 1, 8)) as bigint) % 10 as h, c_nationkey as id, c_acctbal as weight, c_acctbal as f0, c_nationkey::double as f1 from customer")
def hashed_weighted_input(t: Tables) -> DataFrame:
    rows = t.customer.select("c_custkey", "c_mktsegment", F.array("c_nationkey").alias("ids"), F.array("c_acctbal").alias("ws"), "c_acctbal", "c_nationkey")
    pairs = FC.weighted("ids", "ws")
    layer = FC.input_layer(F.array(F.col("c_acctbal")), F.array(F.col("c_nationkey").cast("double")))
    return rows.select("c_custkey", FC.hash_bucketed("c_mktsegment", 10).alias("h"), pairs[0]["id"].alias("id"), pairs[0]["weight"].alias("weight"), layer[0].alias("f0"), layer[1].alias("f1"))


TABLE = "with e as (select range % 10 as id, range // 10 as dim, (range * (range // 10 + 1))::double as value from range(30)) "


def embedding_table(t: Tables) -> DataFrame:
    return t.spark.range(30).select((F.col("id") % 10).alias("id"), F.floor(F.col("id") / 10).alias("dim"), (F.col("id") * (F.floor(F.col("id") / 10) + 1)).cast("double").alias("value"))


@query(TABLE + "select o_custkey as k, dim, round(avg(value), 6) as value from orders join e on id = o_orderkey % 10 group by 1, 2")
def bow_encoder(t: Tables) -> DataFrame:
    rows = t.orders.groupBy(F.col("o_custkey").alias("k")).agg(F.collect_list(F.col("o_orderkey") % 10).alias("ids"))
    return FC.bow_encoded(rows, "k", "ids", embedding_table(t)).withColumn("value", F.round("value", 6))


@query(TABLE + "select o_orderkey as k, pos, dim, value from orders, range(2) p(pos) join e on id = (case pos when 0 then o_orderkey % 10 else o_custkey % 10 end)")
def embedding_unique(t: Tables) -> DataFrame:
    rows = t.orders.select(F.col("o_orderkey").alias("k"), F.array(F.col("o_orderkey") % 10, F.col("o_custkey") % 10).alias("ids"))
    return FC.embedding_lookup_unique(rows, "k", "ids", embedding_table(t)).withColumn("pos", F.col("pos").cast("long"))


@query(TABLE + "select o_orderkey as k, f.f as feature, dim, value from orders, (values ('a'), ('b')) f(f) join e on id = (case f.f when 'a' then o_orderkey % 10 else o_custkey % 10 end)")
def shared_embedding(t: Tables) -> DataFrame:
    rows = t.orders.select(F.col("o_orderkey").alias("k"), F.array(F.col("o_orderkey") % 10).alias("a"), F.array(F.col("o_custkey") % 10).alias("b"))
    return FC.shared_embedded(rows, "k", ["a", "b"], embedding_table(t))


@query("select vec_id as \"row\", (j - 1)::int as col, round(embedding[j], 5)::double as v from embeddings, unnest(range(1, 65)) as u(j) where round(embedding[j], 5)::double <> 0")
def dense_to_sparse(t: Tables) -> DataFrame:
    rows = t.embeddings.select("vec_id", F.transform("embedding", lambda x: F.round(x.cast("double"), 5)).alias("e"))
    return FC.dense_to_sparse(rows, "vec_id", "e", F.lit(0.0))


@query("select c_custkey, c_acctbal::float::double as balance, c_mktsegment as segment, c_nationkey::bigint as nation from customer")
def parse_by_spec(t: Tables) -> DataFrame:
    """Examples parsed as their feature columns ask."""
    spec = FC.parsing_spec({"balance": {"type": "numeric", "default": 0.0}, "segment": {"type": "vocabulary"}, "nation": {"type": "identity"}, "b": {"type": "bucketized", "of": "balance"}, "x": {"type": "crossed", "of": ["segment", "nation"]}})
    e = examples.example(bytes_={"segment": F.array(F.col("c_mktsegment").cast("binary"))}, floats={"balance": F.array("c_acctbal")}, ints={"nation": F.array("c_nationkey")})
    found = t.customer.select("c_custkey", *FC.parsed(e, spec))
    return found.select("c_custkey", F.col("balance")[0].cast("double").alias("balance"), F.col("segment")[0].cast("string").alias("segment"), F.col("nation")[0].alias("nation"))


@query("select 5 as n, 5 as d, true as inside")
def kmeans_seeds(t: Tables) -> DataFrame:
    """Five different vectors of the table."""
    found = similarity.seeds(t.embeddings, "vec_id", "embedding", 5)
    there = found.join(t.embeddings.select(F.col("vec_id").alias("key")), "key", "left_semi")
    return found.agg(F.count(F.lit(1)).cast("int").alias("n"), F.count_distinct("key").cast("int").alias("d")).crossJoin(there.agg((F.count(F.lit(1)) == 5).alias("inside")))


@query("""
with r as (select l_suppkey % 50 as u, l_partkey % 80 as i, avg(l_quantity) as q from lineitem group by 1, 2), f as (select range as id, [range % 3 + 1.0, range % 5 - 2.0] as x from range(80))
select u as row, round(sum(x[1] * x[1]), 4)::double as a, round(sum(x[1] * x[2]), 4)::double as b, round(sum(x[2] * x[2]), 4)::double as d, round(sum(x[1] * q * 1.5), 4)::double as r0, round(sum(x[2] * q * 1.5), 4)::double as r1 from r join f on id = i group by 1
""")
def wals_partial_sides(t: Tables) -> DataFrame:
    rated = t.lineitem.groupBy((F.col("l_suppkey") % 50).alias("row"), (F.col("l_partkey") % 80).alias("i")).agg(F.avg("l_quantity").alias("q"))
    factors = t.spark.range(80).select("id", F.array(F.col("id") % 3 + 1.0, F.col("id") % 5 - 2.0).alias("factors"))
    found = similarity.partial_sides(rated, "row", "i", "q", factors, 0.5)
    return found.select("row", *[F.round(F.col("lhs")[k], 4).alias(n) for k, n in ((0, "a"), (1, "b"), (3, "d"))], *[F.round(F.col("rhs")[k], 4).alias(f"r{k}") for k in (0, 1)])


@query("select s_suppkey, concat_ws(',', s_suppkey + 100, 2, 7) as first, concat_ws(',', s_suppkey + 101, 9, 9) as second from supplier")
def gather_tree(t: Tables) -> DataFrame:
    """Two beams over three times; the second one's second step comes from the other, and ends."""
    k, lit = F.col("s_suppkey") + 100, lambda x: F.lit(x).cast("long")
    steps = F.array(F.array(k, k + 1), F.array(lit(9), lit(2)), F.array(lit(7), lit(5)))
    parents = F.array(F.array(F.lit(0), F.lit(0)), F.array(F.lit(1), F.lit(0)), F.array(F.lit(1), F.lit(0)))
    beams = similarity.gather_tree(steps, parents, 9)
    line = lambda i: F.array_join(F.transform(beams[i], lambda x: x.cast("string")), ",")
    return t.supplier.select("s_suppkey", line(0).alias("first"), line(1).alias("second"))


@query("select s_suppkey, '3,1,3' as labels from supplier")
def ctc_decode(t: Tables) -> DataFrame:
    best = F.array(*map(F.lit, [0, 3, 3, 0, 1, 1, 0, 3, 0]))
    return t.supplier.select("s_suppkey", F.array_join(F.transform(similarity.ctc_greedy(best, 0), lambda x: x.cast("string")), ",").alias("labels"))


@query("select user_id, floor(epoch(ts))::bigint as times, list_value(value) as values_ from events")
def timeseries(t: Tables) -> DataFrame:
    """The two features that a time series is given as."""
    return t.events.select("user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("times"), F.array("value").alias("values_"))
