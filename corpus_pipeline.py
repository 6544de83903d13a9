"""From raw documents to a mixed, tokenized training set, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written and read again as the
next stage's documents.  Ids may repeat or be null and texts may be null or empty anywhere: no
stage drops a document for that, except that a text without letters has no language.

Documents reach Python in batches of about a thousand rows: the stages set the session to that
where it takes more, as ten thousand long texts, once in the executor's JVM and once in each of its
Python workers, are hundreds of megabytes.
"""

from __future__ import annotations

import functools
import os
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.byte_bpe import encode_decode
from tidewater.llm.cluster import broadcast_if_small, checkpoint_folder, cut, delete_folder
from tidewater.llm.language_id import UNKNOWN, identify_language, is_held_out, train_language_id
from tidewater.llm.line_dedup import dedup_lines
from tidewater.llm.mixing import mixed_documents
from tidewater.llm.ngram_join import jaccard_groups

BATCH_ROWS, ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1024


def _in_small_batches(stage):
    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if int(spark.conf.get(BATCH_ROWS)) > ROWS or int(spark.conf.get(BATCH_ROWS)) <= 0:
            spark.conf.set(BATCH_ROWS, str(ROWS))
        return stage(spark, docs, sf_dir)

    return run_stage


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; the learned classifier rejects the others."""
    model = train_language_id(docs.where(~is_held_out()))
    named = identify_language(docs, model)
    return named.where((F.col("_lang") != UNKNOWN) & ~F.col("_ambiguous")).select(*docs.columns)


def without_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that three or more share, but for one holder of each line."""
    kept = dedup_lines(docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies.

    Texts without words and rows without an id are in no group and stay.  Rows that repeat an id
    stay if their texts differ.
    """
    groups = cut(jaccard_groups(docs, k=5, percent=80).select("_id", (F.col("_id") == F.col("_group")).alias("_first")))
    first = groups.where("_first").groupBy("_id").agg(F.count(F.lit(1)).alias("_rows"))
    kept = docs.join(broadcast_if_small(first, 500_000), F.col("doc_id") == F.col("_id"))
    once = kept.where("_rows = 1").select(*docs.columns)
    again = kept.where("_rows > 1").select(*docs.columns).dropDuplicates(["doc_id", "text"])
    return once.unionByName(again).unionByName(docs.where("doc_id is null"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the weights of their sources take them."""
    return mixed_documents(docs)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document, and the digest of what they decode to."""
    encoded = encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)
    return encoded.select("doc_id", "lang", "source", F.col("_ids").alias("ids"), F.col("_n_tokens").alias("n_tokens"), F.col("_decoded_sha256").alias("decoded_sha256"))


STAGES = [
    ("language ID", _in_small_batches(identified)),
    ("line dedup", _in_small_batches(without_shared_lines)),
    ("n-gram Jaccard join", _in_small_batches(without_near_copies)),
    ("mixing sources to target weights", mixed),
    ("byte-level BPE encoding and decoding", _in_small_batches(tokenized)),
]

# SQL can express neither the classifier nor the merges; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written to the shared folder and read again.

    What a later stage has replaced is deleted; the last stage's input stays, as the result reads it.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = os.path.join(checkpoint_folder(spark), f"pipeline-{uuid.uuid4()}")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k:
                delete_folder(spark, f"{folder}/{k - 1}")
    return docs
