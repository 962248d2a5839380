"""The queries of the training-data operators, over whole tables."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.llm import bpe, jaccard, kdtree, kmeanstree, lines, packing, secrets, sharding, substrings, toxicity


def tokenizer(name: str) -> str:
    """The place of a public tokenizer's file: in the folder that RILLFLOW_TOKENIZERS names, or where the package of public tokenizers has it."""
    if folder := os.environ.get("RILLFLOW_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_partenum_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents")).drop("text_key")


def op2_layered_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_digests(table(spark, sf_dir, "documents"))


def op3_weighted_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = sharding.regular_tree(regions=2, racks=4, shards=5)
    placed = sharding.shard(table(spark, sf_dir, "documents"), tree, sharding.grown_tree(tree, 40))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op4_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeanstree.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def toxicity_chain(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Chain:
    labels = table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("low_quality"), F.col("toxic"))
    return toxicity.train(docs, labels, ["low_quality", "toxic"])


def op5_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs.select("doc_id", "text"), toxicity_chain(spark, docs, sf_dir)).drop("text")


def op6_deletion_neighbourhood_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.deduplicated(table(spark, sf_dir, "documents"), short_lines=True)
    return kept.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op7_deep_shallow_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(table(spark, sf_dir, "documents"))


def op8_hierarchical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=2)


def op9_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op10_kd_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdtree.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f) and name[2].isdigit()}


OP10_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as e from embeddings
           where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
     s as (select q.vec_id as query_id, c.vec_id as vec_id, cast(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) as bigint) as score
           from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0)
select query_id, cast(rank as integer) as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op10_kd_trees": OP10_SQL}
