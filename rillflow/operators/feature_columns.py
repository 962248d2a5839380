"""Declarative feature columns: each builds a column expression or a small plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillflow.functions.arrays import multi_hot
from rillflow.functions.math import bucketize
from rillflow.functions.strings import hash_bucket_md5


def numeric(key: str, default: float | None = None, normalizer=None) -> Column:
    value = F.col(key).cast("double")
    value = value if default is None else F.coalesce(value, F.lit(default))
    return normalizer(value) if normalizer else value


def bucketized(source: Column, boundaries: list[float]) -> Column:
    return bucketize(source, boundaries)


def identity(key: str, buckets: int, default: int | None = None) -> Column:
    """Ids in [0, buckets); others become the default, or are an error without one."""
    other = F.lit(default) if default is not None else F.raise_error(F.lit(f"{key} out of range")).cast("long")
    return F.when(F.col(key).between(0, buckets - 1), F.col(key)).otherwise(other)


def hash_bucketed(key: str, buckets: int) -> Column:
    return hash_bucket_md5(F.col(key), buckets)


def vocabulary_list(key: str, terms: list[str], default: int = -1, oov_buckets: int = 0) -> Column:
    """A term's place in a fixed list; another term's hash bucket after it, or the default."""
    place = F.array_position(F.array(*map(F.lit, terms)), F.col(key))
    other = len(terms) + hash_bucket_md5(F.col(key), oov_buckets) if oov_buckets else F.lit(default).cast("long")
    return F.when(place > 0, place - 1).otherwise(other)


def crossed(keys: list[str], buckets: int) -> Column:
    return hash_bucket_md5(F.concat_ws("_X_", *[F.col(k).cast("string") for k in keys]), buckets)


def weighted(ids: str, weights: str) -> Column:
    return F.arrays_zip(F.col(ids).alias("id"), F.col(weights).alias("weight"))


def indicator(ids: Column, depth: int) -> Column:
    return multi_hot(ids, depth)


def embedded(df: DataFrame, key: str, ids: str, table: DataFrame, combiner: str = "mean") -> DataFrame:
    """(key, dim, value): the embeddings of a row's ids combined by mean, sqrtn or sum. ``table``: (id, dim, value)."""
    met = df.select(key, F.explode(ids).alias("id")).join(table, "id")
    total = {"mean": F.avg("value"), "sum": F.sum("value"), "sqrtn": F.sum("value") / F.sqrt(F.count(F.lit(1)))}[combiner]
    return met.groupBy(key, "dim").agg(total.alias("value"))


def linear_model(df: DataFrame, key: str, weights: dict[str, float], bias: float = 0.0) -> DataFrame:
    """(key, logit): the weighted sum of numeric columns."""
    total = F.lit(bias)
    for name, w in weights.items():
        total = total + F.coalesce(F.col(name).cast("double"), F.lit(0.0)) * w
    return df.select(key, total.alias("logit"))


def input_layer(*arrays: Column) -> Column:
    return F.concat(*arrays)


def vocabulary_file(df: DataFrame, key: str, path: str, default: int = -1, oov_buckets: int = 0, name: str = "id") -> DataFrame:
    """``df`` with the line number of each term in a file of one term a line; other terms get the default, or a hash bucket after the last line."""
    from rillflow.sources.files import numbered_lines

    terms = numbered_lines(df.sparkSession, path).select(F.col("value").alias("_term"), F.col("line").alias("_id"))
    found = df.join(terms, F.col(key) == F.col("_term"), "left")
    if not oov_buckets:
        return found.withColumn(name, F.coalesce("_id", F.lit(default).cast("long"))).drop("_term", "_id")
    size = terms.agg(F.count(F.lit(1)).alias("_size"))
    return found.join(F.broadcast(size), F.col("_size").isNotNull()).withColumn(name, F.coalesce("_id", F.col("_size") + hash_bucket_md5(F.col(key), oov_buckets))).drop("_term", "_id", "_size")


def shared_embedded(df: DataFrame, key: str, columns: list[str], table: DataFrame, combiner: str = "mean") -> DataFrame:
    """(key, feature, dim, value): several id columns looked up in one embedding table in one join."""
    flat = None
    for c in columns:
        part = df.select(key, F.lit(c).alias("feature"), F.explode(c).alias("id"))
        flat = part if flat is None else flat.unionByName(part)
    total = {"mean": F.avg("value"), "sum": F.sum("value"), "sqrtn": F.sum("value") / F.sqrt(F.count(F.lit(1)))}[combiner]
    return flat.join(table, "id").groupBy(key, "feature", "dim").agg(total.alias("value"))


def bow_encoded(df: DataFrame, key: str, ids: str, table: DataFrame) -> DataFrame:
    """(key, dim, value): the mean of the embeddings of a bag of words; a bag without known words has no rows."""
    return embedded(df, key, ids, table, "mean")


def embedding_lookup_unique(df: DataFrame, key: str, ids: str, table: DataFrame) -> DataFrame:
    """(key, pos, dim, value): the embedding of each id in place. Each distinct id is looked up once, then handed to all its places."""
    flat = df.select(key, F.posexplode(ids).alias("pos", "id"))
    found = flat.select("id").distinct().join(table, "id")
    return flat.join(found, "id").select(key, "pos", "dim", "value")


def dense_to_sparse(df: DataFrame, key: str, items: str, ignored: Column | None = None) -> DataFrame:
    """(row, col, v) of an array column, without nulls and the ignored value."""
    cells = df.select(F.col(key).alias("row"), F.posexplode(items).alias("col", "v")).where(F.col("v").isNotNull())
    return cells if ignored is None else cells.where(F.col("v") != ignored)


def parsing_spec(columns: dict[str, dict]) -> dict[str, dict]:
    """For named feature columns, what to parse an example's features as: kind (bytes, floats, ints), size (None: any number) and default. Columns made of others bring those in.

    A column is {"type": numeric, identity, hash, vocabulary, bucketized, crossed, indicator, embedding or weighted, ...}; ``of`` names its source or sources.
    """
    out: dict[str, dict] = {}

    def add(name: str, column: dict) -> None:
        kind = column["type"]
        if kind in ("bucketized", "indicator", "embedding"):
            add(column["of"], columns.get(column["of"], {"type": "numeric" if kind == "bucketized" else "vocabulary"}))
        elif kind == "crossed":
            for source in column["of"]:
                add(source, columns.get(source, {"type": "hash"}))
        elif kind == "weighted":
            add(column["of"], columns.get(column["of"], {"type": "vocabulary"}))
            out[column["weight"]] = {"kind": "floats", "size": None}
        elif kind == "numeric":
            spec = {"kind": "floats", "size": column.get("size", 1)}
            out[name] = spec | ({"default": column["default"]} if "default" in column else {})
        elif kind == "identity":
            out[name] = {"kind": "ints", "size": None}
        elif kind in ("hash", "vocabulary"):
            out[name] = {"kind": column.get("kind", "bytes"), "size": None}
        else:
            raise ValueError(f"unknown feature column {kind}")

    for name, column in columns.items():
        add(name, column)
    return out


def parsed(example: Column, spec: dict[str, dict]) -> list[Column]:
    """The features of an example column as ``parsing_spec`` says."""
    from rillflow.functions import examples

    out = []
    for name, want in spec.items():
        if want["size"] is None:
            out.append(examples.ragged(example, name, want["kind"]).alias(name))
        else:
            out.append(examples.dense(example, name, want["kind"], want["size"], F.lit(want["default"]).cast("float") if "default" in want else None).alias(name))
    return out
