"""Vocabularies and token pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillflow.operators.ordering import numbered


def tokens(s: Column) -> Column:
    """Words in lower case: runs of letters and digits of ASCII."""
    return F.filter(F.split(F.lower(s), "[^a-z0-9]+"), lambda t: t != "")


def vocabulary(df: DataFrame, words: Column, min_count: int = 1, max_count: int | None = None) -> DataFrame:
    """(term, n, id): terms that occur at least ``min_count`` times, numbered from 1 by falling count, then by term; 0 is the unknown term."""
    counted = df.select(F.explode(words).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)
    if max_count is not None:
        counted = counted.where(F.col("n") < max_count)
    return numbered(counted.withColumn("_minus", -F.col("n")), ["_minus", "term"], "id", 1).drop("_minus")


def to_ids(df: DataFrame, key: str, words: Column, vocab: DataFrame) -> DataFrame:
    """(key, pos, term, id): every word with its id, 0 if unknown."""
    flat = df.select(key, F.posexplode(words).alias("pos", "term"))
    return flat.join(vocab.select("term", "id"), "term", "left").select(key, "pos", "term", F.coalesce("id", F.lit(0)).alias("id"))


def skip_grams(df: DataFrame, keys: list[str], words: Column, skips: int) -> DataFrame:
    """(keys, i, token, label): each word with each other one up to ``skips`` places away. Pairs are formed within the row's array, no join."""
    placed = df.select(*keys, words.alias("_w")).select(*keys, "_w", F.posexplode("_w").alias("i", "token"))
    near = F.filter(F.transform("_w", lambda w, j: F.struct(j.alias("j"), w.alias("w"))), lambda x: (F.abs(x["j"] - F.col("i")) <= skips) & (x["j"] != F.col("i")))
    return placed.select(*keys, "i", "token", F.explode(near).alias("_p")).select(*keys, "i", "token", F.col("_p.j").alias("j"), F.col("_p.w").alias("label"))


def skip_grams_drawn(df: DataFrame, keys: list[str], words: Column, least: int, most: int, seed: int, start: int = 0, limit: int = -1, with_self: bool = False) -> DataFrame:
    """As ``skip_grams``, the reach of each word drawn from [least, most] by ``seed``; of ``limit`` words from place ``start`` only; with the word itself as a label on request."""
    from rillflow.functions.random import uniform_int

    cut = F.slice(words, start + 1, limit if limit >= 0 else 1 << 30)
    placed = df.select(*keys, cut.alias("_w")).select(*keys, "_w", F.posexplode("_w").alias("i", "token")).withColumn("_reach", uniform_int(least, most + 1, seed, *keys, "i"))
    near = F.filter(F.transform("_w", lambda w, j: F.struct(j.alias("j"), w.alias("w"))), lambda x: (F.abs(x["j"] - F.col("i")) <= F.col("_reach")) & (F.lit(with_self) | (x["j"] != F.col("i"))))
    return placed.select(*keys, "i", "token", F.explode(near).alias("_p")).select(*keys, "i", "token", F.col("_p.j").alias("j"), F.col("_p.w").alias("label"))


def training_pairs(df: DataFrame, keys: list[str], words: Column, window: int, min_count: int, seed: int, subsample: float = 0.0) -> DataFrame:
    """(keys, i, example, label): ids of words and of their neighbours up to a drawn distance of 1 to ``window``. Words rarer than ``min_count`` are left out first, and of frequent ones,
    whose share is over ``subsample``, some: each with a chance of 1 - (sqrt(r) + r), r being subsample over the word's share."""
    from rillflow.functions.random import unit

    vocab = vocabulary(df, words, min_count)
    total = vocab.agg(F.sum("n").alias("_all"))
    flat = df.select(*keys, F.posexplode(words).alias("_i", "term")).join(vocab, "term").join(F.broadcast(total), F.col("_all").isNotNull())
    if subsample:
        r = F.lit(subsample) / (F.col("n") / F.col("_all"))
        flat = flat.where(unit(f"{seed}s", *keys, "_i") < F.sqrt(r) + r)
    kept = flat.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "id"))), lambda x: x["id"]).alias("_ids"))
    pairs = skip_grams_drawn(kept, keys, F.col("_ids"), 1, window, seed)
    return pairs.select(*keys, "i", F.col("token").alias("example"), "j", "label")


def remapped_rows(matrix: DataFrame, remapping: DataFrame, row: str = "row") -> DataFrame:
    """The rows of a matrix of old ids under their new ones: ``remapping`` is (new_id, old_id), -1 for none. New rows without an old one are left out, to be initialised by the caller."""
    known = remapping.where("old_id >= 0").select(F.col("old_id").alias("_old"), F.col("new_id").alias("_new"))
    return matrix.join(known, F.col(row) == F.col("_old")).withColumn(row, F.col("_new")).drop("_old", "_new")


def remap(new: DataFrame, old: DataFrame) -> DataFrame:
    """(new_id, old_id): for each new term its old id, -1 if it had none."""
    before = old.select("term", F.col("id").alias("old_id"))
    return new.select("term", F.col("id").alias("new_id")).join(before, "term", "left").select("new_id", "term", F.coalesce("old_id", F.lit(-1)).alias("old_id"))
