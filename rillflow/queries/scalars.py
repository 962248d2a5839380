"""Queries of string, parsing, numeric and array functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.functions import arrays as A
from rillflow.functions import examples
from rillflow.functions import linalg as LA
from rillflow.functions import math as M
from rillflow.functions import random as R
from rillflow.functions import special as SP
from rillflow.functions import strings as S
from rillflow.functions import wire
from rillflow.operators import sparse
from rillflow.operators.sort import reverse_prefix
from rillflow.operators.window import gathered, periodic_resample
from rillflow.queries.joins import COO, MD5, coo
from rillflow.queries.registry import Tables, query

text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


@query("select p_partkey, concat(p_name, '|', p_brand, '|', p_type) as s from part")
def string_join(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", S.join(F.col("p_name"), F.col("p_brand"), F.col("p_type"), separator="|").alias("s"))


@query("select conv_id, string_agg(role, '>' order by turn) as s from conversations group by 1")
def reduce_join(t: Tables) -> DataFrame:
    return t.conversations.groupBy("conv_id").agg(F.array_join(gathered(["turn"], "role"), ">").alias("s"))


@query("select doc_id, octet_length(encode(text))::int as n from documents")
def string_length_bytes(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", S.byte_length(F.col("text")).alias("n"))


@query(r"select conv_id, turn, md5(regexp_replace(' ' || chr(9) || text || chr(10), '^\s+|\s+$', '', 'g')) as s from conversations")
def string_strip(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", F.md5(S.strip(F.concat(F.lit(" \t"), "text", F.lit("\n")))).alias("s"))


@query("select p_partkey, substring(p_brand, 2, 4) as s from part")
def string_substr(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", S.substr_bytes(F.col("p_brand"), 1, 4).cast("string").alias("s"))


@query("""
select page_id, (j - 1)::int as pos, w[j] as token from (select page_id, list_filter(regexp_split_to_array(url, '[/:.]'), lambda x: x <> '') as w from pages), unnest(range(1, len(w) + 1)) as u(j)
""")
def string_split_coo(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.posexplode(S.split_chars(F.col("url"), "/:.")).alias("pos", "token"))


@query("select page_id, (j - 1)::int as pos, w[j] as token from (select page_id, string_split(url, '/') as w from pages), unnest(range(1, len(w) + 1)) as u(j)")
def string_split_v2(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.posexplode(S.split_by(F.col("url"), "/")).alias("pos", "token"))


@query("select page_id, regexp_full_match(url, 'https?://[a-z0-9.]+/.*') as m from pages")
def regex_full_match(t: Tables) -> DataFrame:
    return t.pages.select("page_id", S.full_match(F.col("url"), "https?://[a-z0-9.]+/.*").alias("m"))


@query(r"select page_id, regexp_replace(url, '([a-z]+)([0-9])', '\2\1', 'g') as s from pages")
def regex_replace(t: Tables) -> DataFrame:
    return t.pages.select("page_id", S.regex_replace(F.col("url"), "([a-z]+)([0-9])", r"\2\1").alias("s"))


@query("select page_id, regexp_replace(url, '[aeiou]', '_') as s from pages")
def regex_replace_first(t: Tables) -> DataFrame:
    return t.pages.select("page_id", S.regex_replace(F.col("url"), "[aeiou]", "_", everywhere=False).alias("s"))


@query(f"select c_custkey, {MD5.format('c_name')} % 64 as bucket from customer")
def hash_bucket_md5(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", S.hash_bucket_md5(F.col("c_name"), 64).alias("bucket"))


@query("select a.p_partkey, levenshtein(a.p_name, b.p_name)::double as d, levenshtein(a.p_name, b.p_name) / length(b.p_name) as share from part a join part b on b.p_partkey = a.p_partkey + 1")
def edit_distance(t: Tables) -> DataFrame:
    b = t.part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other"))
    letters = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    rows = t.part.select("p_partkey", "p_name").join(b, "p_partkey").select("p_partkey", letters("p_name").alias("a"), letters("other").alias("b"))
    return rows.select("p_partkey", S.edit_distance(F.col("a"), F.col("b")).alias("d"), S.edit_distance(F.col("a"), F.col("b"), normalize=True).alias("share"))


@query("select p_partkey, levenshtein(p_type, reverse(p_type))::double as d from part")
def token_edit_distance(t: Tables) -> DataFrame:
    letters = F.split("p_type", "")
    return t.part.select("p_partkey", S.edit_distance(letters, F.reverse(letters)).alias("d"))


@query("select p_partkey, try_cast(regexp_replace(p_brand, '[^0-9]', '', 'g') as bigint) as n from part")
def string_to_number(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", S.to_number(F.regexp_replace("p_brand", "[^0-9]", ""), "bigint", strict=False).alias("n"))


@query("select p_partkey, printf('%.2f', p_retailprice) as s, lpad(p_size::varchar, 6, '0') as w from part")
def as_string(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", S.as_string(F.col("p_retailprice"), 2).alias("s"), S.as_string(F.col("p_size"), width=6, fill="0").alias("w"))


@query("select o_orderkey, o_custkey + 1 as a, 'x' as b, 7 as c from orders")
def decode_csv(t: Tables) -> DataFrame:
    line = F.concat_ws(",", (F.col("o_custkey") + 1).cast("string"), F.lit('"x"'), F.lit(""))
    fields = S.decode_csv(line, "a bigint, b string, c int", {"c": F.lit(7)})
    return t.orders.select("o_orderkey", *fields)


@query("select event_id, json_extract_string(props, '$.k') as k from events")
def decode_json(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.from_json("props", "k string")["k"].alias("k"))


@query("select c_custkey, rtrim(translate(base64(encode(c_name)), '+/', '-_'), '=') as s, c_name as back from customer")
def base64_websafe(t: Tables) -> DataFrame:
    coded = S.encode_base64(F.col("c_name"))
    return t.customer.select("c_custkey", coded.alias("s"), S.decode_base64(coded).cast("string").alias("back"))


@query("select r_regionkey, printf('%s-%05d-of-%05d', r_name, r_regionkey, 5) as s from region")
def sharded_filename(t: Tables) -> DataFrame:
    return t.region.select("r_regionkey", S.sharded_filename(F.col("r_name"), F.col("r_regionkey"), F.lit(5)).alias("s"))


@query("select o_orderkey, o_custkey::double as label, k::bigint as k, v::double as v from orders, (values (1, 0.5), (7, 2.25)) x(k, v)")
def decode_libsvm(t: Tables) -> DataFrame:
    label, values = S.decode_libsvm(F.concat(F.col("o_custkey").cast("string"), F.lit(" 1:0.5 7:2.25")))
    return t.orders.select("o_orderkey", label.alias("label"), F.explode(values).alias("k", "v"))


@query("select o_orderkey, o_orderkey as n, concat(o_orderpriority, '/', o_orderstatus) as s from orders")
def decode_raw_compressed(t: Tables) -> DataFrame:
    """Numbers from their bytes, least first, and texts from gzip members that hold them as they are."""
    little = lambda n, width: F.unhex(F.array_join(F.reverse(F.filter(F.split(F.regexp_replace(F.lpad(F.hex(n), width, "0"), "(..)", "$1 "), " "), lambda x: x != "")), ""))
    text_ = F.concat("o_orderpriority", F.lit("/"), "o_orderstatus").cast("binary")
    size = F.octet_length(text_)
    member = F.concat(F.unhex(F.lit("1f8b08000000000000ff01")), little(size, 4), little(F.lit(65535) - size, 4), text_, little(F.crc32(text_), 8), little(size, 8))
    raw = S.decode_raw(little(F.col("o_orderkey"), 16), "i8")[0]
    return t.orders.select("o_orderkey", raw.alias("n"), S.decode_compressed(member, "GZIP").cast("string").alias("s"))


@query("""
with x as (select l_orderkey, l_linenumber, l_partkey - 100 as a, l_suppkey % 7 - 3 as b, 9007199254740993 * (case l_linenumber % 2 when 0 then -1 else 1 end) + l_partkey as big from lineitem)
select l_orderkey, l_linenumber, trunc(a / nullif(b, 0))::bigint as td, floor(a / nullif(b, 0))::bigint as fd, a % nullif(b, 0) as tm, (a - floor(a / nullif(b, 0)) * b)::bigint as fm, coalesce(round(a / nullif(b, 0), 6), 0) as dn,
 (big // 3) as bt, case when big % 3 < 0 then big // 3 - 1 else big // 3 end as bf, (big % 3 + 3) % 3 as bm from x
""")
def math_division(t: Tables) -> DataFrame:
    a, b = F.col("l_partkey") - 100, F.col("l_suppkey") % 7 - 3
    big, three = F.lit(9007199254740993) * F.when(F.col("l_linenumber") % 2 == 0, -1).otherwise(1) + F.col("l_partkey"), F.lit(3)
    return t.lineitem.select("l_orderkey", "l_linenumber", M.truncate_div(a, b).alias("td"), M.floor_div(a, b).alias("fd"), M.truncate_mod(a, b).alias("tm"), M.floor_mod(a, b).cast("long").alias("fm"), F.round(M.div_no_nan(a, b), 6).alias("dn"), M.truncate_div(big, three).alias("bt"), M.floor_div(big, three).alias("bf"), M.floor_mod(big, three).alias("bm"))


@query("select p_partkey, round_even(p_retailprice / 2, 0) as r, least(greatest(p_retailprice, 1000), 1500) as c, ceil(p_retailprice)::bigint as u, sign(p_retailprice - 1200)::int as s from part")
def math_rint(t: Tables) -> DataFrame:
    x = F.col("p_retailprice")
    return t.part.select("p_partkey", M.round_half_even(x / 2).alias("r"), M.clip(x, 1000.0, 1500.0).alias("c"), F.ceil(x).alias("u"), F.signum(x - 1200).cast("int").alias("s"))


@query("select p_partkey, round(exp(p_size / 10.0), 5) as e, round(ln(p_size + 1), 6) as l, round(sqrt(p_size), 6) as q, round(sin(p_size), 6) as s, round(tanh(p_size / 50.0), 6) as h, round(atan2(p_size, 7), 6) as a from part")
def math_elementwise(t: Tables) -> DataFrame:
    x = F.col("p_size")
    return t.part.select("p_partkey", F.round(F.exp(x / 10), 5).alias("e"), F.round(F.log1p(x), 6).alias("l"), F.round(F.sqrt(x), 6).alias("q"), F.round(F.sin(x), 6).alias("s"), F.round(F.tanh(x / 50), 6).alias("h"), F.round(F.atan2(x, F.lit(7)), 6).alias("a"))


@query("""
with s as (select s_suppkey, (s_suppkey % 20 + 1) as n, (s_suppkey % 40) / 10.0 - 2 as x from supplier),
 e as (select s_suppkey, 2 / sqrt(pi()) * list_sum(list_transform(range(0, 60), lambda k: (case when k % 2 = 0 then 1 else -1 end) * pow(x, 2 * k + 1) / (gamma(k + 1) * (2 * k + 1)))) as erf from s)
select s_suppkey, round(lgamma(n + 0.5), 6) as lgamma, round(-0.5772156649015329 + coalesce(list_sum(list_transform(range(1, n), lambda k: 1.0::double / k)), 0), 8) as digamma, round(erf, 8) as erf, round(1 - erf, 8) as erfc,
 round(pi() * pi() / 6 - coalesce(list_sum(list_transform(range(1, n), lambda k: 1.0::double / (k * k))), 0), 8) as zeta, round(pi() * pi() / 6 - coalesce(list_sum(list_transform(range(1, n), lambda k: 1.0::double / (k * k))), 0), 8) as trigamma,
 round(1 - exp(-3.0) * list_sum(list_transform(range(0, n), lambda k: pow(3.0::double, k) / gamma(k + 1))), 8) as igamma, round(exp(-3.0) * list_sum(list_transform(range(0, n), lambda k: pow(3.0::double, k) / gamma(k + 1))), 8) as igammac,
 round(1 - pow(0.7::double, n), 8) as betainc, round(exp(-n / 10.0) * list_sum(list_transform(range(0, 40), lambda k: pow(n / 20.0, 2 * k) / pow(gamma(k + 1), 2))), 8) as i0e,
 round(exp(-n / 10.0) * list_sum(list_transform(range(0, 40), lambda k: pow(n / 20.0, 2 * k + 1) / (gamma(k + 1) * gamma(k + 2)))), 8) as i1e
from s join e using (s_suppkey)
""")
def math_special(t: Tables) -> DataFrame:
    n, x = F.col("s_suppkey") % 20 + 1, (F.col("s_suppkey") % 40) / 10 - 2
    r = lambda c, name, places=8: F.round(c, places).alias(name)
    return t.supplier.select(
        "s_suppkey", r(SP.lgamma(n + F.lit(0.5)), "lgamma", 6), r(SP.digamma(n), "digamma"), r(SP.erf(x), "erf"), r(SP.erfc(x), "erfc"), r(SP.zeta(F.lit(2.0), n), "zeta"), r(SP.polygamma(F.lit(1), n), "trigamma"),
        r(SP.igamma(n, F.lit(3.0)), "igamma"), r(SP.igammac(n, F.lit(3.0)), "igammac"), r(SP.betainc(F.lit(1.0), n, F.lit(0.3)), "betainc"), r(SP.bessel_i0e(n / 10), "i0e"), r(SP.bessel_i1e(n / 10), "i1e"),
    )


@query("select p_partkey, round(asinh(p_size), 6) as a, round(acosh(p_size), 6) as b, round(atanh(1.0 / (p_size + 1)), 6) as c, round(sinh(p_size / 50.0), 6) as d, round(cosh(p_size / 50.0), 6) as e, round(asin(1.0 / p_size), 6) as f, round(acos(1.0 / p_size), 6) as g, round(tan(p_size), 4) as h from part")
def math_inverse_hyperbolic(t: Tables) -> DataFrame:
    x = F.col("p_size")
    parts = {"a": F.asinh(x), "b": F.acosh(x), "c": F.atanh(F.lit(1.0) / (x + 1)), "d": F.sinh(x / 50), "e": F.cosh(x / 50), "f": F.asin(F.lit(1.0) / x), "g": F.acos(F.lit(1.0) / x)}
    return t.part.select("p_partkey", *[F.round(c, 6).alias(n) for n, c in parts.items()], F.round(F.tan(x), 4).alias("h"))


@query("select c_custkey, c_acctbal = 0 as eq, c_acctbal < 1000 as lt, c_acctbal >= 1000 as ge, abs(c_acctbal - 5000) < 500 as near, c_acctbal < 1000 and c_nationkey > 5 as a, c_acctbal < 1000 or c_nationkey > 5 as o, (c_acctbal < 1000) <> (c_nationkey > 5) as x, not c_nationkey > 5 as n from customer")
def comparisons(t: Tables) -> DataFrame:
    b, n = F.col("c_acctbal"), F.col("c_nationkey")
    p, q = M.compare(b, "<", F.lit(1000)), M.compare(n, ">", F.lit(5))
    return t.customer.select("c_custkey", M.equal(b, F.lit(0.0)).alias("eq"), p.alias("lt"), M.compare(b, ">=", F.lit(1000)).alias("ge"), M.approximately_equal(b, F.lit(5000.0), 500).alias("near"), M.logical("and", p, q).alias("a"), M.logical("or", p, q).alias("o"), M.logical("xor", p, q).alias("x"), M.logical("not", q).alias("n"))


@query("select c_custkey, case when c_acctbal < 0 then -c_acctbal else 2 * c_acctbal end as v from customer")
def select_where(t: Tables) -> DataFrame:
    b = F.col("c_acctbal")
    return t.customer.select("c_custkey", M.select(b < 0, -b, b * 2).alias("v"))


@query("select vec_id, (j - 1)::int as pos, round(case when embedding[j] > 0 then embedding[j] else 0 end, 5)::double as v from embeddings, unnest(range(1, 65)) as u(j)")
def select_elements(t: Tables) -> DataFrame:
    e = F.transform("embedding", lambda x: F.round(x.cast("double"), 5))
    found = M.select_elements(F.transform(e, lambda x: x > 0), e, F.transform(e, lambda _: F.lit(0.0)))
    return t.embeddings.select("vec_id", F.posexplode(found).alias("pos", "v"))


@query("select o_orderkey, o_orderkey as back, (1023::bigint << 52) as one, o_orderkey::int as narrow from orders")
def bitcast(t: Tables) -> DataFrame:
    """Bits of whole numbers as doubles and back; the bits of one."""
    there = M.bitcast(F.col("o_orderkey"), "bigint", "double")
    return t.orders.select("o_orderkey", there.alias("d")).select("o_orderkey", M.bitcast(F.col("d"), "double", "bigint").alias("back"), M.bitcast(F.lit(1.0) + F.col("o_orderkey") * 0, "double", "bigint").alias("one"), F.col("o_orderkey").cast("int").alias("narrow"))


@query("select c_custkey, c_acctbal > 0 as finite, false as nan, c_acctbal <= 0 as infinite from customer")
def nan_tests(t: Tables) -> DataFrame:
    x = F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).otherwise(F.lit(float("inf")))
    return t.customer.select("c_custkey", M.is_finite(x).alias("finite"), F.isnan(x).alias("nan"), M.is_infinite(x).alias("infinite"))


@query("select vec_id, round(sum(embedding[j + 1]::double * cos(-2 * pi() * j * k / 64)), 4) as re, round(sum(embedding[j + 1]::double * sin(-2 * pi() * j * k / 64)), 4) as im, k::int as k from embeddings, range(0, 64) a(j), range(0, 3) b(k) group by vec_id, k")
def fourier(t: Tables) -> DataFrame:
    z = F.transform("embedding", lambda x: M.complex_(x, F.lit(0)))
    found = t.embeddings.select("vec_id", F.posexplode(F.slice(M.fft(z), 1, 3)).alias("k", "z"))
    return found.select("vec_id", F.round("z.re", 4).alias("re"), F.round("z.im", 4).alias("im"), "k")


@query("select s_suppkey, round(s_acctbal + 2, 4) as re, round(-s_nationkey::double, 4) as im, round(atan2(s_nationkey, s_acctbal), 6) as angle, round((s_acctbal * 2 + s_nationkey * 3) / 13, 6) as qr from supplier")
def complex_parts(t: Tables) -> DataFrame:
    z, w = M.complex_(F.col("s_acctbal"), F.col("s_nationkey")), M.complex_(F.lit(2), F.lit(3))
    both = M.conjugate(M.complex_add(z, M.complex_(F.lit(2), F.lit(0))))
    return t.supplier.select("s_suppkey", F.round(both["re"], 4).alias("re"), F.round(both["im"], 4).alias("im"), F.round(M.angle(z), 6).alias("angle"), F.round(M.complex_div(z, w)["re"], 6).alias("qr"))


@query("select '0! == 1' as fact")
def fact(t: Tables) -> DataFrame:
    return t.spark.range(1).select(M.fact().alias("fact"))


@query("select true as seconds, true as micros")
def timestamps(t: Tables) -> DataFrame:
    """The time now lies after that of the last event, in either unit."""
    last = t.events.agg(F.unix_micros(F.max("ts").cast("timestamp")).alias("last"))
    return last.select((M.timestamp_seconds() * 1e6 > F.col("last")).alias("seconds"), (M.timestamp_micros() > F.col("last")).alias("micros"))


@query("select o_orderkey, date_trunc('month', o_orderdate)::date as month, (o_orderdate + interval 10 day)::date as later, date_diff('day', date_trunc('year', o_orderdate)::date, o_orderdate::date)::int as day, extract(dow from o_orderdate)::int as dow from orders")
def dates(t: Tables) -> DataFrame:
    d = F.col("o_orderdate").cast("date")
    return t.orders.select("o_orderkey", F.trunc(d, "month").alias("month"), F.date_add(d, 10).alias("later"), F.datediff(d, F.trunc(d, "year")).alias("day"), (F.dayofweek(d) - 1).alias("dow"))


DRAWN = "cast(('0x' || substring(md5(concat_ws(':', {0}, o_orderkey)), 1, 8)) as bigint)"
UNIT = f"(({DRAWN} + 0.5) / 4294967296)"
DRAWS = {
    "uniform": f"round(2 + 3 * {UNIT.format(1)}, 8)",
    "whole": f"(({DRAWN.format(2)} * 10) >> 32) + 5",
    "normal": f"""round(1 + 2 * sqrt(-2 * ln({UNIT.format("'3a'")})) * cos(2 * pi() * {UNIT.format("'3b'")}), 6)""",
    "exponential": f"round(-ln({UNIT.format(4)}) / 2, 8)",
    "gamma": f"""round(-(ln({UNIT.format("'5g0'")}) + ln({UNIT.format("'5g1'")})) / 3, 7)""",
    "class": f"case when {DRAWN.format(6)} < 1073741824 then 0 when {DRAWN.format(6)} < 2147483648 then 1 else 2 end",
}


@query("select o_orderkey, " + ", ".join(f"{sql} as {name}" for name, sql in DRAWS.items()) + " from orders")
def random_draws(t: Tables) -> DataFrame:
    k = "o_orderkey"
    return t.orders.select(k, F.round(R.uniform(2.0, 5.0, 1, k), 8).alias("uniform"), R.uniform_int(5, 15, 2, k).alias("whole"), F.round(R.normal(1.0, 2.0, 3, k), 6).alias("normal"), F.round(R.exponential(2.0, 4, k), 8).alias("exponential"), F.round(R.gamma(2, 3.0, 5, k), 7).alias("gamma"), R.categorical([1.0, 1.0, 2.0], 6, k).alias("class"))


@query("with u as (select o_orderkey, " + UNIT.format(7) + " as u from orders), c as (select range as k, (select sum(exp(-2.0) * pow(2.0, j) / gamma(j + 1)) from range(0, 30) x(j) where j <= range) as up from range(30)) select o_orderkey, (select count(*) from c where up < u) as n from u")
def random_poisson(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", R.poisson(2.0, 7, "o_orderkey").alias("n"))


@query("select count(*) as n, bool_and(ok) as ok from (select true as ok from orders)")
def random_truncated(t: Tables) -> DataFrame:
    """Truncated normals lie within two deviations; classes drawn by logits are among those there are."""
    rows = t.orders.select(R.truncated_normal(5.0, 2.0, 8, "o_orderkey").alias("x"), R.multinomial([0.0, 1.0, 2.0], 4, 9, "o_orderkey").alias("m"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("x").between(1, 9) & (F.array_min("m") >= 0) & (F.array_max("m") <= 2)).alias("ok"))


@query("select c_custkey, cast(('0x' || substring(sha256(concat('0000000000000001', '0000000000000002', ':', c_name)), 1, 12)) as bigint) % 50 as strong, round(cast(('0x' || substring(md5(c_name), 1, 8)) as bigint) / 4294967296.0, 5) as bits from customer")
def hash_bucket_strong(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", S.hash_bucket_strong(F.col("c_name"), 50, (1, 2)).alias("strong"), F.round(S.string_to_float_bits(F.col("c_name")).cast("double"), 5).alias("bits"))


@query("select count(*) as n, true as inside, true as same from customer")
def hash_bucket_fast(t: Tables) -> DataFrame:
    """Every bucket lies in range, and equal strings share one."""
    rows = t.customer.select(S.hash_bucket(F.col("c_name"), 64).alias("a"), S.hash_bucket(F.concat(F.lit(""), F.col("c_name")), 64).alias("b"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("a").between(0, 63)).alias("inside"), F.bool_and(F.col("a") == F.col("b")).alias("same"))


@query("select s_suppkey, round(s_acctbal * 2 - s_nationkey * 3, 4) as re, round(s_acctbal * 3 + s_nationkey * 2, 4) as im, round(sqrt(s_acctbal * s_acctbal + s_nationkey * s_nationkey), 4) as m from supplier")
def complex_numbers(t: Tables) -> DataFrame:
    z = M.complex_(F.col("s_acctbal"), F.col("s_nationkey"))
    p = M.complex_mul(z, M.complex_(F.lit(2), F.lit(3)))
    return t.supplier.select("s_suppkey", F.round(p["re"], 4).alias("re"), F.round(p["im"], 4).alias("im"), F.round(M.complex_abs(z), 4).alias("m"))


@query("select o_orderkey, o_orderkey & 255 as a, o_orderkey | 7 as o, xor(o_orderkey, 21) as x, (o_orderkey << 3)::bigint as l, o_orderkey >> 2 as r, bit_count(o_orderkey)::int as c from orders")
def bitwise_ops(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    return t.orders.select("o_orderkey", k.bitwiseAND(255).alias("a"), k.bitwiseOR(7).alias("o"), k.bitwiseXOR(21).alias("x"), F.shiftleft(k, 3).alias("l"), F.shiftright(k, 2).alias("r"), F.bit_count(k).alias("c"))


@query("select c_custkey, (case when c_acctbal < 0 then 0 when c_acctbal < 1000 then 1 when c_acctbal < 5000 then 2 else 3 end) as b from customer")
def bucketize(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", M.bucketize(F.col("c_acctbal"), [0.0, 1000.0, 5000.0]).alias("b"))


@query("select vec_id, (j - 1)::int as pos, case when j - 1 = label then 1.0 else 0.0 end::double as v from embeddings, unnest(range(1, 11)) as u(j)")
def one_hot(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", F.posexplode(A.one_hot(F.col("label"), 10)).alias("pos", "v"))


@query("select s_suppkey, concat(s % 5, ',', (s + 1) % 5, ',', (s + 2) % 5) as rolled from (select s_suppkey, s_suppkey + 3 as s from supplier)")
def roll(t: Tables) -> DataFrame:
    k = F.col("s_suppkey") + 3
    items = F.array((k + 1) % 5, (k + 2) % 5, k % 5)
    return t.supplier.select("s_suppkey", text(A.roll(items, 1)).alias("rolled"))


@query("select s_suppkey, concat_ws(',', s_suppkey + 1, s_suppkey + 3) as sliced, concat_ws(',', 0, s_suppkey, 0, 0) as padded, concat_ws(',', s_suppkey + 1, s_suppkey, s_suppkey + 1, s_suppkey) as mirrored, concat_ws(',', s_suppkey, 9, s_suppkey, 9) as tiled from supplier")
def slice_pad_tile(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    five = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: k + i)
    return t.supplier.select("s_suppkey", text(A.strided_slice(five, 1, 5, 2)).alias("sliced"), text(A.pad(F.array(k), 1, 2, F.lit(0).cast("long"))).alias("padded"), text(A.mirror_pad(F.array(k, k + 1), 1, 1)).alias("mirrored"), text(A.tile(F.array(k, F.lit(9).cast("long")), 2)).alias("tiled"))


@query("select vec_id, (j - 1)::int as i from embeddings, unnest(range(1, 65)) as u(j) where embedding[j] > 0.2")
def where_indices(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", F.explode(A.where_indices(F.transform("embedding", lambda x: x.cast("double") > 0.2))).alias("i"))


@query("select o_orderkey, o_orderkey // 20 as a, (o_orderkey // 5 % 4)::bigint as b, o_orderkey % 5 as c from orders")
def unravel_index(t: Tables) -> DataFrame:
    a, b, c = A.unravel(F.col("o_orderkey"), [1 << 40, 4, 5])
    return t.orders.select("o_orderkey", a.alias("a"), b.alias("b"), c.alias("c"))


@query("select s_suppkey, j::int as i, s_suppkey + (j * 5 // 10) as v from supplier, unnest(range(10)) as u(j)")
def periodic_resampling(t: Tables) -> DataFrame:
    five = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.col("s_suppkey") + i)
    return t.supplier.select("s_suppkey", F.posexplode(periodic_resample(five, 10)).alias("i", "v"))


@query(COO + " select k as row_, max(v)::bigint as v from e group by 1")
def sparse_reduce_max(t: Tables) -> DataFrame:
    return sparse.reduced(coo(t).select(F.col("k").alias("row_"), "v"), "row_", "max")


@query(COO + " select vec_id as i, sum(v)::bigint as v from e group by 1")
def sparse_reduce(t: Tables) -> DataFrame:
    return sparse.reduced(coo(t), "i")


@query(COO + " select vec_id as \"row\", k::int as col, (case when k % 2 = 0 then 2 * v else v end)::bigint as v from e")
def sparse_add(t: Tables) -> DataFrame:
    rows = coo(t).toDF("row", "col", "v")
    return sparse.combined(rows, rows.where("col % 2 = 0")).select("row", "col", "v")


@query(COO + " select vec_id as \"row\", k::int as col, round(exp(v / 50.0 - max(v / 50.0) over (partition by vec_id)) / sum(exp(v / 50.0)) over (partition by vec_id) * exp(max(v / 50.0) over (partition by vec_id)), 6) as v from e")
def sparse_softmax(t: Tables) -> DataFrame:
    rows = coo(t).select(F.col("i").alias("row"), F.col("k").alias("col"), (F.col("v") / 50).alias("v"))
    return sparse.softmax(rows).select("row", "col", F.round("v", 6).alias("v"))


def n_rows(t: Tables) -> int:
    """Two rows more than there are vectors."""
    return t.embeddings.agg(F.max("vec_id")).first()[0] + 3


@query(COO + " select r.range as \"row\", j::int as col, coalesce(case when v > 0 then v end, -1)::bigint as v from range((select max(vec_id) + 3 from embeddings)) r cross join unnest(range(64)) u(j) left join e on vec_id = r.range and k = j")
def sparse_to_dense(t: Tables) -> DataFrame:
    rows = coo(t).where("v > 0").select(F.col("i").alias("row"), F.col("k").cast("long").alias("col"), "v")
    return sparse.to_dense(rows, n_rows(t), 64, F.lit(-1).cast("long")).select("row", F.posexplode("items").alias("col", "v"))


@query(COO + " select r.range as \"row\", coalesce(k, 0)::int as col, coalesce(v, -7)::bigint as v, v is null as was_empty from range((select max(vec_id) + 3 from embeddings)) r left join (select * from e where v > 10) f on vec_id = r.range")
def sparse_fill_empty_rows(t: Tables) -> DataFrame:
    return sparse.fill_empty_rows(coo(t).where("v > 10").toDF("row", "col", "v"), n_rows(t), F.lit(-7).cast("long"))


@query(COO + " select ((vec_id * 64 + k) // 4)::bigint as \"row\", ((vec_id * 64 + k) % 4)::bigint as col, v from e")
def sparse_reshape(t: Tables) -> DataFrame:
    return sparse.reshaped(coo(t).toDF("row", "col", "v"), 64, 4)


@query(COO + " select vec_id - 2 as \"row\", (k - 1)::int as col, v from e where vec_id between 2 and 401 and k between 1 and 60 and vec_id - 2 - (k - 1) <= 300")
def sparse_slice_band(t: Tables) -> DataFrame:
    return sparse.band(sparse.sliced(coo(t).toDF("row", "col", "v"), (2, 1), (400, 60)), 300, -1)


@query("select o_orderkey, o_totalprice::float::double as price, o_custkey as cust, -1::bigint as missing, 2 as n from orders")
def parse_example(t: Tables) -> DataFrame:
    e = examples.example(floats={"price": F.array("o_totalprice")}, ints={"cust": F.array("o_custkey"), "pair": F.array("o_custkey", "o_orderkey")})
    rows = t.orders.select("o_orderkey", e.alias("e"))
    get = lambda *a: examples.dense(F.col("e"), *a)[0]
    return rows.select("o_orderkey", get("price", "floats", 1).cast("double").alias("price"), get("cust", "ints", 1).alias("cust"), get("none", "ints", 1, F.lit(-1).cast("long")).alias("missing"), F.size(examples.ragged(F.col("e"), "pair", "ints")).alias("n"))


@query("select n_nationkey, n_nationkey::bigint as age, n_name as name from nation")
def decode_json_example(t: Tables) -> DataFrame:
    name = F.base64(F.col("n_name").cast("binary"))
    line = F.format_string('{"features":{"feature":{"age":{"int64List":{"value":[%d]}},"name":{"bytesList":{"value":["%s"]}}}}}', "n_nationkey", name)
    rows = t.nation.select("n_nationkey", examples.from_json(line).alias("e"))
    return rows.select("n_nationkey", examples.dense(F.col("e"), "age", "ints", 1)[0].alias("age"), examples.dense(F.col("e"), "name", "bytes", 1)[0].cast("string").alias("name"))


@query("select s_suppkey, concat_ws(',', s_suppkey + 2, s_suppkey + 1, s_suppkey, s_suppkey + 3) as r from supplier")
def reverse_sequence(t: Tables) -> DataFrame:
    four = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.col("s_suppkey") + i)
    return t.supplier.select("s_suppkey", text(reverse_prefix(four, F.lit(3))).alias("r"))


@query(COO + " select vec_id as \"row\", k as col, v from e where k < 10 union all select vec_id, k + 10, v from e where k >= 60")
def sparse_concat_split(t: Tables) -> DataFrame:
    """The first of six parts of the columns but one, and the last, side by side again."""
    parts = sparse.split(coo(t).toDF("row", "col", "v"), 60, 6)
    last = sparse.sliced(coo(t).toDF("row", "col", "v"), (0, 0), (1 << 40, 64)).where("col >= 60")
    return sparse.concatenated([(parts[0], 10), (last, 64)])


@query(COO + " select vec_id as \"row\", k as col, v, row_number() over (order by vec_id, k) - 1 as \"at\" from e where v > 20")
def sparse_reorder(t: Tables) -> DataFrame:
    return sparse.reordered(coo(t).toDF("row", "col", "v").where("v > 20"))


@query(COO + " select h.range::int as handle_pos, vec_id as \"row\", k as col, v from range(50) h join e on vec_id = (h.range * 7) % 20 where v > 20")
def sparse_storage(t: Tables) -> DataFrame:
    """Sparse rows stored by handle, those without cells too, and taken by handles that repeat, as far as there are such rows."""
    every = t.embeddings.select(F.col("vec_id").alias("handle"))
    stored = sparse.serialized(coo(t).where("v > 20").select(F.col("i").alias("handle"), F.col("i").alias("row"), F.col("k").alias("col"), "v"), "handle", every)
    handles = t.spark.range(50).select(F.col("id").cast("int").alias("handle_pos"), (F.col("id") * 7 % 20).alias("handle")).join(every, "handle", "left_semi")
    return sparse.deserialized(stored, "handle", handles)


@query(COO + " select vec_id as \"row\", vec_id as col, 5 as v from e where k = 0 and vec_id < 64 union all select vec_id, k, v from e where vec_id <> k")
def sparse_set_diag(t: Tables) -> DataFrame:
    diagonal = t.embeddings.where("vec_id < 64").select(F.col("vec_id").alias("i"), F.lit(5).cast("long").alias("v"))
    rows = coo(t).toDF("row", "col", "v").withColumn("col", F.col("col").cast("long"))
    return sparse.set_diag(rows, diagonal)


@query(COO + " select vec_id as i, v from e where k = vec_id")
def sparse_diag_part(t: Tables) -> DataFrame:
    return sparse.diag_part(coo(t).toDF("row", "col", "v"))


@query(COO + " select vec_id as \"row\", k as col, v * (vec_id + k) as v from e where (vec_id + k) % 2 = 0")
def sparse_times_dense(t: Tables) -> DataFrame:
    dense = coo(t).select(F.col("i").alias("row"), F.col("k").alias("col"), (F.col("i") + F.col("k")).alias("d")).where("d % 2 = 0")
    return sparse.times_dense(coo(t).toDF("row", "col", "v"), dense)


@query(COO + " select k::bigint as \"row\", vec_id as col, v from e")
def sparse_transpose(t: Tables) -> DataFrame:
    return sparse.transposed(coo(t).toDF("row", "col", "v")).withColumn("row", F.col("row").cast("long"))


@query("select vec_id, n::int as n, least from (select vec_id, count(*) as n, min(k) as least from (" + COO + " select * from e where v > 20) group by 1)")
def sparse_row_slices(t: Tables) -> DataFrame:
    found = sparse.row_slices(coo(t).where("v > 20").toDF("row", "col", "v"))
    return found.select(F.col("row").alias("vec_id"), F.size("cells").alias("n"), F.col("cells")[0]["col"].alias("least"))


SIX = "list_transform(range(1, 7), lambda i: s_suppkey * i)"


def six() -> object:
    return F.transform(F.array(*map(F.lit, range(1, 7))), lambda i: F.col("s_suppkey") * i)


@query("select s_suppkey, s_suppkey as a, s_suppkey * 6 as b, '2,3' as shape, concat_ws(';', concat_ws(',', s_suppkey, s_suppkey * 4), concat_ws(',', s_suppkey * 2, s_suppkey * 5), concat_ws(',', s_suppkey * 3, s_suppkey * 6)) as turned, concat_ws(',', s_suppkey, s_suppkey * 2, s_suppkey * 3, s_suppkey * 4, s_suppkey * 5, s_suppkey * 6) as flat from supplier")
def reshape_transpose(t: Tables) -> DataFrame:
    rows = A.reshape(six(), [2, -1])
    first = A.unpack(six(), 6)
    lines = F.array_join(F.transform(A.transpose(rows), lambda r: text(r)), ";")
    back = A.squeeze(A.expand_dims(A.reshape(rows, [-1], rank=2)))
    return t.supplier.select("s_suppkey", first[0].alias("a"), first[5].alias("b"), text(A.shape(rows, 2)).alias("shape"), lines.alias("turned"), text(back).alias("flat"))


@query("select s_suppkey, concat_ws(',', s_suppkey, s_nationkey) as packed, concat_ws(',', s_suppkey * 3, s_suppkey * 4) as middle, concat_ws(',', s_suppkey, s_suppkey * 2, s_suppkey, s_suppkey * 2) as wide, concat_ws(',', s_suppkey * 5, s_suppkey * 6) as last from supplier")
def pack_concat_split(t: Tables) -> DataFrame:
    thirds = A.split_even(six(), 3)
    wide = A.flattened(A.concat(F.array(thirds[0]), F.array(thirds[0]), axis=1), 2)
    return t.supplier.select("s_suppkey", text(A.pack(F.col("s_suppkey"), F.col("s_nationkey").cast("long"))).alias("packed"), text(thirds[1]).alias("middle"), text(wide).alias("wide"), text(A.split_sizes(six(), [4, 2])[1]).alias("last"))


@query("select s_suppkey, '7,7,7' as filled, '0,0,0,0,0,0' as zeros, concat_ws(',', s_suppkey, s_suppkey, s_suppkey * 2, s_suppkey * 2) as each_, 2 as rows from supplier")
def fill_like_repeat(t: Tables) -> DataFrame:
    return t.supplier.select("s_suppkey", text(A.fill(3, F.lit(7))).alias("filled"), text(A.like(six(), F.lit(0))).alias("zeros"), text(A.repeat_each(F.slice(six(), 1, 2), 2)).alias("each_"), F.size(A.broadcast_to(six(), 2)).alias("rows"))


@query("select s_suppkey, i::int as i, j::int as j, (case when i = j then 9 when j - i > 1 then 0 else s_suppkey * (3 * i + j + 1) end)::bigint as v from supplier, range(3) a(i), range(3) b(j) where s_suppkey < 50")
def matrix_bands(t: Tables) -> DataFrame:
    nine = F.transform(F.array(*map(F.lit, range(1, 10))), lambda i: F.col("s_suppkey") * i)
    banded = A.band_part(A.set_diag(A.reshape(nine, [3, 3]), F.array(*[F.lit(9).cast("long")] * 3)), -1, 1, F.lit(0).cast("long"))
    return t.supplier.where("s_suppkey < 50").select("s_suppkey", F.posexplode(banded).alias("i", "r")).select("s_suppkey", "i", F.posexplode("r").alias("j", "v"))


@query("select s_suppkey, concat_ws(',', s_suppkey, 0, 0, s_suppkey * 2) as d, concat_ws(',', s_suppkey, s_suppkey * 2) as part, s_suppkey * s_suppkey * 5.0 as corner from supplier")
def matrix_diag(t: Tables) -> DataFrame:
    made = A.diag(F.slice(six(), 1, 2), F.lit(0).cast("long"))
    square = A.matmul(A.reshape(F.slice(six(), 1, 2), [1, 2]), A.reshape(F.slice(six(), 1, 2), [2, 1]))
    return t.supplier.select("s_suppkey", text(A.flattened(made, 2)).alias("d"), text(A.diag_part(made)).alias("part"), F.get(F.get(square, F.lit(0)), F.lit(0)).alias("corner"))


@query("select s_suppkey, concat_ws(',', s_suppkey, s_suppkey * 2, 5) as pushed, s_suppkey * 6 as popped, concat_ws(',', s_suppkey, 8) as changed, concat_ws(',', s_suppkey * 6, s_suppkey) as gathered, concat_ws(',', 0, s_suppkey * 2, 0, s_suppkey) as scattered, s_suppkey * 4 as nd from supplier")
def growable_lists(t: Tables) -> DataFrame:
    two = F.slice(six(), 1, 2)
    return t.supplier.select(
        "s_suppkey", text(A.push_back(two, F.lit(5).cast("long"))).alias("pushed"), A.pop_back(six())[1].alias("popped"), text(A.set_item(two, 1, F.lit(8).cast("long"))).alias("changed"), text(A.gather(six(), F.array(F.lit(5), F.lit(0)))).alias("gathered"),
        text(A.scatter(F.array(F.lit(3), F.lit(1)), two, 4, F.lit(0).cast("long"))).alias("scattered"), F.get(A.gather_nd(A.reshape(six(), [2, 3]), F.array(F.array(F.lit(1), F.lit(0))), 2), F.lit(0)).alias("nd"),
    )


@query("select c_custkey, c_acctbal > 0 as has, case when c_acctbal > 0 then c_acctbal else -1 end as v from customer")
def optionals(t: Tables) -> DataFrame:
    x = F.when(F.col("c_acctbal") > 0, A.some(F.col("c_acctbal")))
    return t.customer.select("c_custkey", A.has_value(x).alias("has"), F.when(A.has_value(x), A.get_value(x)).otherwise(F.lit(-1.0)).alias("v"))


@query("select s_suppkey, concat_ws(',', 0.0, 0.5, 1.0) as line, 6 as n from supplier")
def linspace_ensure(t: Tables) -> DataFrame:
    return t.supplier.select("s_suppkey", text(A.linspace(0.0, 1.0, 3)).alias("line"), F.size(A.ensure_size(six(), 6)).alias("n"))


# small matrices: [[a, 1], [1, a + 1]] with a = 2 + s_suppkey % 7, whose inverse, determinant and factors have plain formulas
A_OF = "with m as (select s_suppkey, (2 + s_suppkey % 7)::double as a from supplier) "


def matrices(t: Tables) -> DataFrame:
    a = (2 + F.col("s_suppkey") % 7).cast("double")
    return t.supplier.select("s_suppkey", F.array(F.array(a, F.lit(1.0)), F.array(F.lit(1.0), a + 1)).alias("m"), F.array(F.array(F.lit(1.0)), F.array(F.lit(2.0))).alias("b"))


@query(A_OF + "select s_suppkey, round(a * (a + 1) - 1, 8) as det, round(ln(a * (a + 1) - 1), 8) as log, round((a + 1) / (a * (a + 1) - 1), 8) as inv, round(sqrt(a), 8) as chol, round(((a + 1) - 2) / (a * (a + 1) - 1), 8) as x0, round((2 * a - 1) / (a * (a + 1) - 1), 8) as x1 from m")
def linear_solve(t: Tables) -> DataFrame:
    at = lambda c, i, j: F.round(F.get(F.get(c, F.lit(i)), F.lit(j)), 8)
    found = matrices(t).select("s_suppkey", F.round(LA.determinant("m"), 8).alias("det"), LA.log_determinant("m").alias("l"), LA.inverse("m").alias("i"), LA.cholesky("m").alias("c"), LA.solve("m", "b").alias("x"), LA.least_squares("m", "b").alias("y"))
    return found.select("s_suppkey", "det", F.round("l.log", 8).alias("log"), at(F.col("i"), 0, 0).alias("inv"), at(F.col("c"), 0, 0).alias("chol"), at(F.col("x"), 0, 0).alias("x0"), at(F.col("y"), 1, 0).alias("x1"))


@query(A_OF + "select s_suppkey, round(a + 0.5 - sqrt(5) / 2, 8) as low, round(a + 0.5 + sqrt(5) / 2, 8) as high, round(a + 0.5 + sqrt(5) / 2, 8) as s, round(sqrt(a * a + 1), 8) as r, round(a / sqrt(a * a + 1), 8) as q from m")
def factorizations(t: Tables) -> DataFrame:
    found = matrices(t).select("s_suppkey", LA.eigen("m").alias("e"), LA.svd("m").alias("s"), LA.qr("m").alias("q"))
    return found.select("s_suppkey", F.round(F.col("e.values")[0], 8).alias("low"), F.round(F.col("e.values")[1], 8).alias("high"), F.round(F.col("s.s")[0], 8).alias("s"), F.round(F.col("q.r")[0][0], 8).alias("r"), F.round(F.col("q.q")[0][0], 8).alias("q"))


@query("select o_orderkey, o_totalprice::float::double as price, o_custkey as cust, o_orderpriority as priority, -1::bigint as missing from orders")
def parse_wire_example(t: Tables) -> DataFrame:
    """Examples written as bytes and parsed from them."""
    e = examples.example(bytes_={"priority": F.array(F.col("o_orderpriority").cast("binary"))}, floats={"price": F.array("o_totalprice")}, ints={"cust": F.array("o_custkey")})
    rows = wire.parse_examples(t.orders.select("o_orderkey", wire.write_examples(e).alias("record")))
    get = lambda *a: examples.dense(F.col("example"), *a)[0]
    return rows.select("o_orderkey", get("price", "floats", 1).cast("double").alias("price"), get("cust", "ints", 1).alias("cust"), get("priority", "bytes", 1).cast("string").alias("priority"), get("none", "ints", 1, F.lit(-1).cast("long")).alias("missing"))


ORDER = {"key": (1, "int64"), "price": (2, "double"), "status": (3, "string"), "tags": (4, ["int32"]), "inner": (5, {"custkey": (1, "sint64"), "urgent": (2, "bool")})}


@query("select o_orderkey, o_orderkey as key, o_totalprice as price, o_orderstatus as status, 3 as tags, -o_custkey as custkey, o_orderpriority = '1-URGENT' as urgent from orders")
def protocol_messages(t: Tables) -> DataFrame:
    """Declared messages encoded and decoded."""
    inner = F.struct((-F.col("o_custkey")).alias("custkey"), (F.col("o_orderpriority") == "1-URGENT").alias("urgent"))
    message = F.struct(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"), F.array(F.lit(1), F.lit(-2), F.lit(300)).alias("tags"), inner.alias("inner"))
    rows = t.orders.select("o_orderkey", wire.encode_column(message, ORDER).alias("data")).select("o_orderkey", wire.decode_column(F.col("data"), ORDER).alias("m"))
    return rows.select("o_orderkey", "m.key", "m.price", "m.status", F.size("m.tags").alias("tags"), "m.inner.custkey", "m.inner.urgent")


@query("select vec_id, 2 as rank, 32::bigint as wide, round(embedding[64], 5)::double as last from embeddings")
def tensor_bytes(t: Tables) -> DataFrame:
    data = wire.serialize_tensor(F.transform("embedding", lambda x: x.cast("double")), [2, 32], "double")
    rows = wire.parse_tensors(t.embeddings.select("vec_id", data.alias("data")), "data", "double")
    return rows.select("vec_id", F.size("tensor.dims").alias("rank"), F.col("tensor.dims")[1].alias("wide"), F.round(F.col("tensor.values")[63], 5).alias("last"))
