"""String and parsing functions as column expressions; lengths and offsets count bytes where the name says so."""

from __future__ import annotations

import re
import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def join(*columns: Column, separator: str = "") -> Column:
    """Null if any part is."""
    parts = [c if k == 0 else F.concat(F.lit(separator), c) for k, c in enumerate(columns)]
    return F.concat(*parts)


def byte_length(s: Column) -> Column:
    return F.octet_length(s)


def strip(s: Column) -> Column:
    """Without any white space at either end, tabs and line ends too."""
    return F.regexp_replace(s, r"^\s+|\s+$", "")


def substr_bytes(s: Column, position: int, length: int) -> Column:
    """``length`` bytes from byte ``position``; an error where the string is shorter than ``position``."""
    data = s.cast("binary")
    checked = F.when(F.abs(F.lit(position)) <= F.octet_length(data), data).otherwise(F.raise_error(F.lit("position out of range")).cast("binary"))
    return F.substring(checked, position + 1 if position >= 0 else position, length)


def split_chars(s: Column, delimiters: str, skip_empty: bool = True) -> Column:
    """Splits at any one of the characters; with none, into characters."""
    parts = F.split(s, "[" + re.escape(delimiters) + "]") if delimiters else F.split(s, "")
    return F.filter(parts, lambda t: t != "") if skip_empty else parts


def split_by(s: Column, separator: str | None = None, max_split: int = -1) -> Column:
    """Splits at a whole separator and keeps empty parts; with none, at runs of white space."""
    if not separator:
        return F.filter(F.split(strip(s), r"\s+", max_split + 1 if max_split >= 0 else -1), lambda t: t != "")
    return F.split(s, re.escape(separator), max_split + 1 if max_split >= 0 else -1)


def full_match(s: Column, pattern: str) -> Column:
    return s.rlike(f"^(?:{pattern})$")


def regex_replace(s: Column, pattern: str, rewrite: str, everywhere: bool = True) -> Column:
    r"""``rewrite`` names groups as \1. The first match only, on request; the pattern then has no groups of its own."""
    java = re.sub(r"\\(\d)", r"$\1", rewrite)
    if everywhere:
        return F.regexp_replace(s, pattern, java)
    return F.regexp_replace(s, rf"(?s)^(.*?)(?:{pattern})", "$1" + rewrite.replace("$", r"\$"))


def md5_number(s: Column) -> Column:
    """The first 32 bits of the MD5 digest: the same in any engine."""
    return F.conv(F.substring(F.md5(s.cast("string")), 1, 8), 16, 10).cast("long")


def hash_bucket_md5(s: Column, buckets: int) -> Column:
    return md5_number(s) % buckets


def hash_bucket(s: Column, buckets: int) -> Column:
    """The fast bucket, for use within Spark."""
    return F.pmod(F.xxhash64(s), F.lit(buckets))


def hash_bucket_strong(s: Column, buckets: int, key: tuple[int, int]) -> Column:
    """A keyed bucket, which who doesn't know ``key`` can't steer: from SHA-256 of the key and the string."""
    digest = F.sha2(F.concat(F.lit(f"{key[0]:016x}{key[1]:016x}:"), s.cast("string")), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 12), 16, 10).cast("long"), F.lit(buckets))


def string_to_float_bits(s: Column) -> Column:
    """A string as a float in [0, 1) that its hash decides: a feature of no order."""
    return (md5_number(s) / F.lit(float(1 << 32))).cast("float")


def to_number(s: Column, kind: str = "double", strict: bool = True) -> Column:
    """A parsed number; an error on bad input, or null if not ``strict``."""
    return s.cast(kind) if strict else s.try_cast(kind)


def as_string(x: Column, precision: int | None = None, scientific: bool = False, width: int = 0, fill: str = " ") -> Column:
    if precision is None and not scientific:
        out = x.cast("string")
    else:
        out = F.format_string(f"%.{6 if precision is None else precision}{'e' if scientific else 'f'}", x.cast("double"))
    return F.when(F.length(out) < width, F.lpad(out, width, fill)).otherwise(out) if width else out


def encode_base64(s: Column, pad: bool = False) -> Column:
    """With the alphabet that is safe in addresses."""
    out = F.translate(F.regexp_replace(F.base64(s.cast("binary")), r"\s", ""), "+/", "-_")
    return out if pad else F.regexp_replace(out, "=+$", "")


def decode_base64(s: Column) -> Column:
    plain = F.translate(s, "-_", "+/")
    return F.unbase64(F.rpad(plain, F.ceil(F.length(plain) / 4).cast("int") * 4, "="))


def sharded_filename(base: Column, shard: Column, shards: Column) -> Column:
    return F.format_string("%s-%05d-of-%05d", base, shard, shards)


#: Characters that stand for tokens, each of one code point; no pair of arrays may have more distinct tokens.
LETTERS = "".join(map(chr, range(0x100, 0xD800)))


def token_edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance of two token arrays: their tokens are written as letters of one row's own alphabet, and the words compared, all within the JVM."""
    known = F.array_distinct(F.concat(a, b))
    fits = F.when(F.size(known) <= len(LETTERS), known).otherwise(F.raise_error(F.lit("too many distinct tokens")))
    word = lambda tokens: F.array_join(F.transform(tokens, lambda t: F.substr(F.lit(LETTERS), F.array_position(fits, t).cast("int"), F.lit(1))), "")
    return F.levenshtein(word(a), word(b)).cast("double")


def edit_distance(hypothesis: Column, truth: Column, normalize: bool = False) -> Column:
    """Over tokens; normalised by the truth's length, where an empty truth gives 0 to an empty hypothesis and infinity to others."""
    away = token_edit_distance(hypothesis, truth)
    if not normalize:
        return away
    return F.when(F.size(truth) > 0, away / F.size(truth)).otherwise(F.when(away == 0, 0.0).otherwise(float("inf")))


def decode_raw(data: Column, kind: str, little_endian: bool = True) -> Column:
    """Bytes as an array of numbers of a numpy kind such as i4 or f8."""
    number = T.DoubleType() if kind[0] == "f" else T.LongType()
    order = ("<" if little_endian else ">") + kind

    @F.pandas_udf(T.ArrayType(number))
    def parse(series: pd.Series) -> pd.Series:
        import numpy as np

        return series.map(lambda b: None if b is None else np.frombuffer(b, order).astype("f8" if kind[0] == "f" else "i8"))

    return parse(data)


def decode_compressed(data: Column, compression: str = "ZLIB") -> Column:
    """ZLIB, GZIP or '' for none."""
    wbits = {"ZLIB": 15, "GZIP": 31}.get(compression)

    @F.pandas_udf(T.BinaryType())
    def expand(series: pd.Series) -> pd.Series:
        return series.map(lambda b: None if b is None else zlib.decompress(b, wbits))

    return data if wbits is None else expand(data)


def decode_csv(s: Column, schema: str, defaults: dict[str, Column], options: dict[str, str] | None = None) -> list[Column]:
    """The fields of a CSV line, each its default where empty; a field without a default is required."""
    parsed = F.from_csv(s, schema, options or {})
    out = []
    for name in [c.strip().split()[0] for c in schema.split(",")]:
        field = parsed[name]
        required = F.when(field.isNull(), F.raise_error(F.lit(f"field {name} is required"))).otherwise(field)
        out.append((F.coalesce(field, defaults[name]) if name in defaults else required).alias(name))
    return out


def decode_libsvm(s: Column) -> tuple[Column, Column]:
    """(label, map of index to value) of a line 'label index:value ...'."""
    parts = F.split(strip(s), r"\s+")
    entries = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.struct(F.split(p, ":")[0].cast("long").alias("k"), F.split(p, ":")[1].cast("double").alias("v")))
    return parts[0].cast("double"), F.map_from_entries(entries)
