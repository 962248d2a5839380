"""From raw documents to packed training sequences: toxicity, line dedup, near duplicates, secrets, packing.

Each stage takes the documents that the one before kept, written as Parquet and read again, and returns the columns of documents; the last returns the pieces of
packed sequences. Counted as part of the subpackage ``rillflow.llm``.

- toxicity: documents that the classifier chain finds toxic go.
- line_dedup: lines that stand earlier, up to one edit (short lines: equal ones), are cut; a document that loses all it had goes.
- near_duplicates: of each component of documents whose word shingles link, the one of the smallest doc_id stays.
- secrets: every secret, nested ones included, is replaced by a mark; all documents stay.
- packing: every document's ids, packed.

Null and empty texts pass through all stages; n_chars follows the text. Repeated rows are kept as they come unless a stage's operator says otherwise.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.llm import jaccard, lines, packing, queries, secrets, toxicity
from rillflow.llm.common import checkpoint_dir, durable

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def remeasured(docs: DataFrame) -> DataFrame:
    """The columns of documents, n_chars as the text now has it."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    chain = queries.toxicity_chain(spark, docs, sf_dir)
    return toxicity.scored(docs.select(*COLUMNS), chain).where("is_toxic = 0").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = lines.deduplicated(docs.select(*COLUMNS), short_lines=True)
    gone = (F.col("_n_removed") > 0) & F.regexp_replace("text", r"\s", "").eqNullSafe("")
    return remeasured(kept.where(~gone))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    copies = jaccard.join(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("copy"), "text_key").distinct()
    same = (F.col("doc_id") == F.col("copy")) & (F.xxhash64("text") == F.col("text_key"))
    return docs.select(*COLUMNS).join(copies.hint("merge"), same, "left_anti")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return remeasured(secrets.redact(docs.select(*COLUMNS)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, queries.tokenizer("word_bpe_49k.json"), end_id=2)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_repeated_lines), ("near_duplicates", drop_near_duplicates), ("secrets", redact_secrets), ("packing", pack)]

#: The classifier and the tokenizer have no SQL form; tests/llm/test_pipeline.py holds every stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents. Intermediate tables go to the folder of spark.checkpoint.dir, and each is removed once the next is written; the last one's rows are checkpointed."""
    if not checkpoint_dir(spark):
        durable(spark.range(1))
    top = f"{checkpoint_dir(spark)}/corpus-pipeline-{uuid.uuid4()}"

    def remove(place: str) -> None:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    docs, before = queries.table(spark, sf_dir, "documents"), None
    try:
        for name, stage in STAGES[:-1]:
            stage(spark, docs, sf_dir).write.parquet(f"{top}/{name}")
            docs = spark.read.parquet(f"{top}/{name}")
            if before:
                remove(before)
            before = f"{top}/{name}"
        return durable(STAGES[-1][1](spark, docs, sf_dir))
    finally:
        remove(top)
